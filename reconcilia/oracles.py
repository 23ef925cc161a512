"""DuckDB SQL for the registered queries: views that equal those of ``views``, and one statement for each query."""

from __future__ import annotations

WORDS = r"""
tok AS (SELECT doc_id::VARCHAR AS file_id, unnest(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) AS text,
  generate_subscripts(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), 1) - 1 AS i FROM documents),
words AS (SELECT file_id, i AS seq, (i // 12 // 42 + 1)::INTEGER AS page, text, i // 12 AS ln, (10 + 48 * (i % 12))::DOUBLE AS x0, (10 + 48 * (i % 12) + least(45, 5 * length(text)))::DOUBLE AS x1,
  20 + 18 * ((i // 12) % 42) + (i % 3)::DOUBLE * 0.8 AS top, 20 + 18 * ((i // 12) % 42) + (i % 3)::DOUBLE * 0.8 + 9 AS bottom,
  (i // 12 // 42) * 792 + (20 + 18 * ((i // 12) % 42) + (i % 3)::DOUBLE * 0.8) AS doctop FROM tok WHERE text <> '')
"""

PAGES = """
pages_v AS (SELECT (doc_id // 5)::VARCHAR AS file_id, (doc_id % 5 + 1)::INTEGER AS page, CASE WHEN doc_id % 11 = 0 OR doc_id % 15 = 0 THEN '' ELSE text END AS text FROM documents)
"""

MOVEMENTS = """
mov AS (SELECT o_custkey AS statement_id, o_orderkey, row_number() OVER w AS numero_movimiento,
  CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN o_totalprice::DECIMAL(18,2) END AS cargo, CASE WHEN o_orderstatus IN ('F', 'O') THEN o_totalprice::DECIMAL(18,2) END AS abono,
  (sum(CASE WHEN o_orderstatus IN ('F', 'O') THEN o_totalprice::DECIMAL(18,2) ELSE -(o_totalprice::DECIMAL(18,2)) END) OVER w)::DECIMAL(18,2) AS saldo_operacion
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
sums AS (SELECT statement_id, sum(coalesce(abono, 0)) AS a, sum(coalesce(cargo, 0)) AS c FROM mov GROUP BY 1),
summ AS (SELECT c_custkey AS statement_id, c_acctbal::DECIMAL(18,2) AS saldo_anterior,
  CASE WHEN c_custkey % 13 <> 0 THEN (coalesce(a, 0) + CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END)::DECIMAL(18,2) END AS depositos_abonos, coalesce(c, 0)::DECIMAL(18,2) AS retiros_cargos,
  CASE WHEN c_custkey % 17 <> 0 THEN (c_acctbal::DECIMAL(18,2) + coalesce(a, 0) - coalesce(c, 0))::DECIMAL(18,2) END AS saldo_final FROM customer LEFT JOIN sums ON statement_id = c_custkey)
"""

CHECKS = f"""
{MOVEMENTS},
tot AS (SELECT statement_id, sum(coalesce(abono, 0))::DECIMAL(18,2) AS a, sum(coalesce(cargo, 0))::DECIMAL(18,2) AS c, arg_max(saldo_operacion, numero_movimiento) AS last FROM mov GROUP BY 1),
both_ AS (SELECT t.*, s.* EXCLUDE (statement_id) FROM tot t JOIN summ s USING (statement_id)),
chk AS (
  SELECT statement_id, 1 AS orden, depositos_abonos AS esperado, a AS obtenido FROM both_ UNION ALL SELECT statement_id, 2, retiros_cargos, c FROM both_
  UNION ALL SELECT statement_id, 3, saldo_final, nullif(last, 0) FROM both_ WHERE saldo_final IS NOT NULL
  UNION ALL SELECT statement_id, 4, saldo_final, (saldo_anterior + depositos_abonos - retiros_cargos)::DECIMAL(18,2) FROM both_),
checks AS (SELECT statement_id, orden, ['Total depósitos / abonos', 'Total retiros / cargos', 'Saldo final', 'Ecuación financiera'][orden] AS nombre, esperado, obtenido,
  (obtenido - esperado)::DECIMAL(18,2) AS diferencia, abs(obtenido - esperado) <= 0.01 AS correcto,
  ['Suma de movimientos vs resumen financiero', 'Suma de movimientos vs resumen financiero', 'Último movimiento vs saldo final', 'Saldo anterior + abonos - cargos'][orden] AS mensaje FROM chk)
"""

CLABE = """
num AS (SELECT *, ['012','002','014','072','044','021','638','062','059','999'][c_custkey % 10 + 1] || lpad(c_custkey::VARCHAR, 15, '0') AS n FROM customer),
ident AS (SELECT c_custkey::VARCHAR AS file_id, CASE WHEN c_custkey % 6 <> 4 THEN n END AS clabe, CASE WHEN c_custkey % 6 <> 4 THEN n[1:3] END AS prefix FROM num),
bank(prefix, bank_key, display, supported) AS (VALUES ('012','bbva','BBVA México',true),('002','banamex','Citibanamex',true),('014','santander','Santander',false),('072','banorte','Banorte',true),
  ('044','scotiabank','Scotiabank',false),('021','hsbc','HSBC México',false),('638','nu','Nu México',false),('062','afirme','Banca Afirme',false),('059','invex','Banco Invex',false))
"""


def facts(place: int) -> str:
    """What a printed statement says, straight from the orders."""
    return f"""
f AS (SELECT o_custkey AS custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n, strftime(o_orderdate, '%d') AS dd,
  ['ENE','FEB','MAR','ABR','MAY','JUN','JUL','AGO','SEP','OCT','NOV','DIC'][month(o_orderdate)] AS mon, strftime(o_orderdate, '%Y') AS yyyy, o_orderstatus IN ('F', 'O') AS credit, o_totalprice::DECIMAL(18,2) AS price,
  o_orderkey % 4 AS kind, lpad(o_orderkey::VARCHAR, 10, '0') AS k10, '0721800' || lpad(o_orderkey::VARCHAR, 11, '0') AS k18, o_orderkey::VARCHAR AS key, 'ABC' || lpad((o_orderkey % 1000000)::VARCHAR, 6, '0') || 'XY1' AS rfc,
  lpad((o_orderkey % 24)::VARCHAR, 2, '0') || ':' || lpad((o_orderkey % 60)::VARCHAR, 2, '0') AS hhmm, 'CLIENTE ' || o_custkey::VARCHAR AS who, o_custkey // 3 % 2 = 1 AS premium, NOT (o_custkey % 3 = 1 AND o_orderkey % 7 = 0) AS shown FROM orders WHERE o_custkey % 3 = {place})
"""


def movement_sql(place: int, **columns: str) -> str:
    from reconcilia.operators.movements import MOVEMENT

    money = ("cargo", "abono", "saldo_operacion", "saldo_liquidacion")
    picks = [f"{columns.get(c, 'NULL')}::{'DECIMAL(18,2)' if c in money else 'VARCHAR'} AS {c}" for c in MOVEMENT]
    return f"WITH {facts(place)} SELECT custkey::VARCHAR AS file_id, n::INTEGER AS numero_movimiento, {', '.join(picks)} FROM f"


SIDES = {"cargo": "CASE WHEN credit THEN 0 ELSE price END", "abono": "CASE WHEN credit THEN price ELSE 0 END", "saldo_operacion": "price", "tipo_operacion": "CASE WHEN credit THEN 'ABONO' ELSE 'CARGO' END"}


def _kinds(*v: str | None) -> str:
    return "CASE kind " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(v) if x) + " END"


BBVA = movement_sql(0, **SIDES, fecha_operacion="dd || '/' || mon", fecha_liquidacion="dd || '/' || mon", saldo_liquidacion="price",
    concepto=_kinds("concat_ws(chr(10), 'SPEI RECIBIDO BANCO', 'PAGO ' || key, '00 ' || k18, 'CLAVE', who)", "'PAGO CUENTA DE TERCERO' || chr(10) || 'BNET ' || k10 || ' RENTA'", "'COMPRA RFC: ABC ' || rfc[4:] || chr(10) || 'AUT: ' || key || ' ' || hhmm || CASE WHEN premium THEN ' Referencia:' ELSE '' END", "'RETIRO CAJERO' || chr(10) || '**' || key"),
    referencia=_kinds(None, None, "'R' || key", "'**' || key"), autorizacion=_kinds(None, None, "key"), beneficiario=_kinds("who", "k10"), cuenta_beneficiario=_kinds(None, "k10"), clabe_beneficiario=_kinds("k18"),
    rfc=_kinds(None, None, "rfc"), hora_operacion=_kinds(None, None, "hhmm"), concepto_original=_kinds("'PAGO ' || key", "'RENTA'"))

SIDES_2 = SIDES | {"cargo": "CASE WHEN credit OR NOT shown THEN 0 ELSE price END", "abono": "CASE WHEN credit AND shown THEN price ELSE 0 END",
    "tipo_operacion": "CASE WHEN NOT shown THEN CASE kind WHEN 0 THEN 'ABONO' WHEN 1 THEN 'CARGO' END WHEN credit THEN 'ABONO' ELSE 'CARGO' END"}

_X = _kinds("'DEPOSITO SUC 12' || chr(10) || 'REF ' || key || ' AUT 99' || chr(10) || 'BENEFICIARIO ' || who", "'PAGO CAJA 7' || chr(10) || 'HORA ' || hhmm || chr(10) || 'A FAVOR DE ' || who", "'TRASPASO CUENTA ' || k10 || chr(10) || 'RFC ' || rfc || chr(10) || k18", "'COMISION' || chr(10) || '**' || key")
BANAMEX = movement_sql(1, **SIDES_2, fecha_operacion="dd || ' ' || mon", saldo_liquidacion="0", concepto=_X, concepto_original=_X, referencia=_kinds("key", None, None, "'**' || key"), autorizacion=_kinds("'99'"), sucursal=_kinds("'12'"), caja=_kinds(None, "'7'"),
    beneficiario=_kinds("who", "who"), cuenta_beneficiario=_kinds(None, None, "k10"), clabe_beneficiario=_kinds(None, None, "k18"), rfc=_kinds(None, None, "rfc"), hora_operacion=_kinds(None, "hhmm"))

BANORTE = movement_sql(2, **SIDES, fecha_operacion="dd || '-' || mon || '-' || yyyy", saldo_liquidacion="0",
    concepto=_kinds("concat_ws(chr(10), 'SPEI RECIBIDO', 'DEL CLIENTE ' || who || ' DE LA CLABE ' || k18, 'CON RFC ' || rfc || ' CONCEPTO: RENTA', 'REFERENCIA: ' || key || ' CVE RAST: 1', 'HR LIQ: ' || hhmm)",
        "concat_ws(chr(10), 'ORDEN DE PAGO SPEI ' || key || ' =REFERENCIA', 'CTA/CLABE: ' || k18 || ' BENEF: ' || who, '(DATO NO VERIF POR ESTA INST), Pago 97', 'CVE RASTREO: 8 RFC: ' || rfc, 'HORA LIQ: ' || hhmm)", "'COMPRA AL RFC ' || rfc", "'DEPOSITO EFECTIVO'"),
    referencia=_kinds("key", "key"), beneficiario=_kinds("who", "who"), clabe_beneficiario=_kinds("k18", "k18"), rfc=_kinds("rfc", "rfc || 'HORA'", "rfc"), hora_operacion=_kinds("hhmm", "hhmm"), concepto_original=_kinds("'RENTA'", "'Pago 97'"))


def account_sql(place: int, prefix: str, product: str, month: str) -> str:
    start, end = (f"lpad(({day} + o_custkey % 9)::VARCHAR, 2, '0') || '{month}'" for day in (1, 20))
    return f"""SELECT DISTINCT o_custkey::VARCHAR AS file_id, '{product}' || o_custkey % 4 AS producto_principal, {start} AS periodo_inicio, {end} AS periodo_fin, {end} AS fecha_corte,
  lpad(o_custkey::VARCHAR, 10, '0') AS numero_cuenta, lpad(o_custkey::VARCHAR, 10, '0') AS numero_cliente, 'ABC010101XY' || o_custkey % 10 AS rfc, '{prefix}' || lpad(o_custkey::VARCHAR, 15, '0') AS clabe, c_name AS nombre_cliente
FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_custkey % 3 = {place}"""


def boxed(mode: str) -> str:
    """Words in the boxes of ``box`` (field, page, xmin, xmax, ymin, ymax)."""
    inside = {
        "center": "(x0 + x1) / 2 BETWEEN xmin AND xmax AND (top + bottom) / 2 BETWEEN ymin AND ymax", "overlap": "x0 < xmax AND x1 > xmin AND top < ymax AND bottom > ymin",
        "band": "least(x1, xmax + 1.5) > greatest(x0, xmin - 1.5) AND top BETWEEN ymin - 1.5 AND ymax + 1.5",
    }[mode]
    return f"{WORDS}, hit AS (SELECT * FROM words w JOIN box b ON w.page = b.box_page AND {inside})"


def box_values(bank: str, section: str, mode: str) -> str:
    from reconcilia.sources.layouts import BOXES

    rows = ", ".join(f"('{b['field']}', {b['page']}, {b['xmin']}, {b['xmax']}, {b['ymin']}, {b['ymax']})" for b in BOXES[bank, section])
    return rf"""WITH box(field, box_page, xmin, xmax, ymin, ymax) AS (VALUES {rows}), {boxed(mode)}
SELECT file_id, field, string_agg(text, ' ' ORDER BY page, top, x0, seq) AS text, nullif(coalesce(string_agg(regexp_replace(text, '\D', '', 'g'), '' ORDER BY page, top, x0, seq), ''), '') AS digits, count(*) AS n_words FROM hit GROUP BY file_id, field"""


def stepped_lines(kinds: str) -> str:
    """Line numbers of the stepped words under a rule that breaks lines of these kinds before their last third."""
    return f"""WITH {WORDS}, s AS (SELECT file_id, page, seq, (seq % 12 = 0 OR (seq % 12 = 8 AND {kinds}))::INTEGER AS start FROM words)
SELECT file_id, page, seq, (page * 100000 + sum(start) OVER (PARTITION BY file_id, page ORDER BY seq))::BIGINT AS line_no FROM s"""


def quality(source: str, name: str = "u") -> str:
    """(k, usable) of ``source`` (k, raw)."""
    return rf"""{name}_t AS (SELECT k, trim(regexp_replace(coalesce(raw, ''), '\s+', ' ', 'g')) AS t FROM {source}),
{name}_m AS (SELECT k, length(t) AS n, len(regexp_extract_all(t, '(?i)\(cid:\d+\)')) AS cid, length(regexp_replace(t, '[^ˆ˜¯ª˛˚˙¨´¸łøØıŒœŠšŽžƒ]', '', 'g')) AS odd, length(regexp_replace(t, '[^\p{{L}}\p{{N}}]', '', 'g')) AS alnum,
  len(regexp_extract_all(t, '[A-Za-zÁÉÍÓÚÜÑáéíóúüñ]{{2,}}')) AS w FROM {name}_t),
{name} AS (SELECT k, NOT (n = 0 OR (cid = 1 AND n < 100) OR (cid > 0 AND cid * 8 / n >= 0.05) OR (odd > 0 AND alnum = 0) OR (odd / n >= 0.08) OR (w < 2 AND alnum / n < 0.20)) AS usable FROM {name}_m)"""


#: The odd texts; the seventh is what compatibility composition makes of it.
ODD = """odd AS (SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN NULL WHEN 1 THEN '  ' || chr(10) || ' ' WHEN 2 THEN '(cid:12) corto' WHEN 3 THEN repeat('(cid:3) ', 40) || text[1:100] WHEN 4 THEN '— · — •'
  WHEN 5 THEN repeat('ƒ', 20) || text[1:100] WHEN 6 THEN '12 -- .. == ## ** 3 ** -- == ++' WHEN 7 THEN '(cid:5) corto' ELSE text END AS text FROM documents)"""

ODD_WORDS = f"""{WORDS}, ow AS (SELECT * REPLACE (CASE WHEN file_id::BIGINT % 4 = 1 THEN '(cid:7)' ELSE text END AS text) FROM words)"""

USABLE_WORDS = f"""{ODD_WORDS}, w500 AS (SELECT file_id AS k, string_agg(text, ' ' ORDER BY seq) AS raw FROM ow WHERE seq < 500 GROUP BY 1), {quality("w500", "uw")}"""

ROUTES = f"""{ODD}, {USABLE_WORDS}, st AS (SELECT doc_id::VARCHAR AS k, coalesce(text, '') AS raw, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) <> '' AS filled, doc_id FROM odd), {quality("st", "us")},
route AS (SELECT st.k AS file_id, CASE WHEN NOT filled THEN 2 WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END::INTEGER AS initial_empty_pages,
  CASE WHEN us.usable OR (filled AND coalesce(uw.usable, false)) THEN 'pdf_digital' ELSE 'pdf_imagen' END AS document_type FROM st JOIN us ON us.k = st.k LEFT JOIN uw ON uw.k = st.k)"""


def value(i: int) -> str:
    return f"((k * 100 + {7 * i}) / 100.0)::DECIMAL(18,2)"


def printed(i: int, then: str | None = None, otherwise: str = "NULL") -> str:
    return f"CASE WHEN (k + {i}) % 11 <> 0 THEN {then or value(i)} ELSE {otherwise} END"


DAYS, RATE = "(28 + k % 4)::INTEGER", "(k % 7 + 0.375)::DOUBLE"
TYPES = {"dias_periodo": "INTEGER", "cheques_pagados": "INTEGER", "tasa_bruta_anual": "DOUBLE"}


def summary_sql(bank: str) -> str:
    """The sixteen fields of a bank's printed summaries, from the customers' numbers alone."""
    from reconcilia.operators.fields import SUMMARY

    own = {"dias_periodo": DAYS, "cheques_pagados": "(k % 50)::INTEGER", "tasa_bruta_anual": RATE}
    if bank == "bbva":
        values = {f: printed(i, own.get(f), "NULL" if f == "saldo_promedio" else "0") for i, f in enumerate(SUMMARY)}
    elif bank == "banamex":  # where a field is missing, the nearest amount of its box is a neighbour's
        p = [printed(i) for i in range(5)]
        nearest = {"saldo_anterior": (0, 1), "depositos_abonos": (1, 0, 2), "retiros_cargos": (2, 1, 3), "saldo_final": (3, 2)}
        values = {f: f"coalesce({', '.join(p[i] for i in order)})" for f, order in nearest.items()}
        values |= {"saldo_promedio": f"coalesce({p[4]}, {printed(5, DAYS)})", "dias_periodo": printed(5, DAYS)}
    else:
        v = {f: printed(i) for i, f in enumerate("_ anterior depositos retiros intereses manejo comisiones iva cobrados isr final _ minimo promedio".split())}
        zero = lambda f: f"coalesce({v[f]}, 0)"
        values = {
            "saldo_promedio": v["promedio"], "dias_periodo": printed(14, DAYS), "tasa_bruta_anual": printed(15, RATE), "intereses_a_favor": v["intereses"], "isr_retenido": v["isr"], "manejo_cuenta": f"coalesce({v['manejo']}, {v['comisiones']})",
            "saldo_anterior": v["anterior"], "depositos_abonos": f"{v['depositos']} + {zero('intereses')} + {zero('cobrados')}", "retiros_cargos": f"{v['retiros']} + {zero('iva')} + {zero('comisiones')}", "saldo_final": v["final"], "saldo_promedio_minimo_mensual": v["minimo"],
        }
    picks = [f"({values.get(c, 'NULL')})::{TYPES.get(c, 'DECIMAL(18,2)')} AS {c}" for c in SUMMARY]
    place = ["bbva", "banamex", "banorte"].index(bank)
    return f"SELECT k::VARCHAR AS file_id, {', '.join(picks)} FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey % 3 = {place})"


def products_sql(numbers: bool = False) -> str:
    """The six printed product fields, or the numbers in the last four."""
    from reconcilia.operators.fields import PRODUCTS

    texts = ["'CON0 ' || k", "'PRO1 ' || k", "(k % 7)::VARCHAR || '.375%'", "'N/A'", "(k % 9)::VARCHAR || '.375%'", "'$1,' || lpad((k % 900)::VARCHAR, 3, '0') || '.50'"]
    values = ["", "", "(k % 7 + 0.375)::DECIMAL(18,6)", "NULL::DECIMAL(18,6)", "(k % 9 + 0.375)::DECIMAL(18,6)", "(1000.5 + k % 900)::DECIMAL(18,6)"]
    picks = [f"{x if f == 'gat_nominal_anual' else printed(i, x)} AS {f}{'_num' if numbers else ''}" for i, (f, x) in enumerate(zip(PRODUCTS, values if numbers else texts, strict=True)) if x]
    return f"SELECT k::VARCHAR AS file_id, {', '.join(picks)} FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_custkey % 3 = 0)"


PROCESS = f"""
WITH s AS ({" UNION ALL ".join(f"SELECT file_id, saldo_anterior, depositos_abonos, retiros_cargos, saldo_final FROM ({summary_sql(b)})" for b in ("bbva", "banamex", "banorte"))}),
o AS (SELECT *, o_totalprice::DECIMAL(18,2) AS price, o_orderstatus IN ('F', 'O') AS credit, NOT (o_custkey % 3 = 1 AND o_orderkey % 7 = 0) AS shown FROM orders),
c AS (SELECT o_custkey::VARCHAR AS file_id, sum(CASE WHEN credit AND shown THEN price ELSE 0 END)::DECIMAL(18,2) AS a, sum(CASE WHEN NOT credit AND shown THEN price ELSE 0 END)::DECIMAL(18,2) AS c, arg_max(price, (o_orderdate, o_orderkey)) AS last FROM o GROUP BY 1),
x AS (SELECT file_id, 1 AS orden, depositos_abonos AS e, a AS o FROM s JOIN c USING (file_id) UNION ALL SELECT file_id, 2, retiros_cargos, c FROM s JOIN c USING (file_id)
  UNION ALL SELECT file_id, 3, saldo_final, last FROM s JOIN c USING (file_id) WHERE saldo_final IS NOT NULL UNION ALL SELECT file_id, 4, saldo_final, (saldo_anterior + depositos_abonos - retiros_cargos)::DECIMAL(18,2) FROM s JOIN c USING (file_id))
SELECT file_id AS statement_id, orden, e::DECIMAL(18,2) AS esperado, o::DECIMAL(18,2) AS obtenido, (o - e)::DECIMAL(18,2) AS diferencia FROM x"""


def fourth(columns: str) -> str:
    """What the statements of the fourth layout say, straight from orders and customers."""
    return f"""WITH m AS (SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n, o_orderstatus IN ('F', 'O') AS credit, o_totalprice::DECIMAL(18,2) AS price, o_orderdate, o_orderkey FROM orders),
s AS (SELECT k::VARCHAR AS file_id, {columns} FROM (SELECT DISTINCT o_custkey AS k, c_name FROM orders JOIN customer ON c_custkey = o_custkey))"""


FOURTH_FIELDS = fourth(", ".join([
    "'SUPER ' || k % 4 AS producto_principal", "lpad((1 + k % 9)::VARCHAR, 2, '0') || '/Enero/2026' AS periodo_inicio", "lpad((20 + k % 9)::VARCHAR, 2, '0') || '/Enero/2026' AS fecha_corte", "lpad(k::VARCHAR, 10, '0') AS numero_cuenta", "'014' || lpad(k::VARCHAR, 15, '0') AS clabe",
    "c_name AS nombre_cliente", "'ABC010101XY' || k % 10 AS rfc", *(f"({printed(i)})::DECIMAL(18,2) AS {f}" for i, f in enumerate(("saldo_anterior", "depositos_abonos", "retiros_cargos", "saldo_final"))), f"{printed(4, DAYS)} AS dias_periodo", f"{printed(5, RATE, '0')} AS tasa_bruta_anual",
    f"({printed(6, None, '0')})::DECIMAL(18,2) AS saldo_promedio", *(f"{printed(20 + i, f"'{t}' || k")} AS {f}" for i, (f, t) in enumerate((("contrato", "C"), ("producto", "P"), ("total_comisiones", "T")))), "'santander' AS bank_key",
])) + " SELECT * FROM s"

FOURTH_MOVEMENTS = fourth("1 AS one") + """
SELECT k::VARCHAR AS file_id, n::INTEGER AS numero_movimiento, strftime(o_orderdate, '%d') || '-' || ['ENE','FEB','MAR','ABR','MAY','JUN','JUL','AGO','SEP','OCT','NOV','DIC'][month(o_orderdate)] || '-' || strftime(o_orderdate, '%Y') AS fecha_operacion,
  'PEDIDO ' || lpad(o_orderkey::VARCHAR, 10, '0') || chr(10) || 'CLIENTE ' || k || ' 1,000.00' AS concepto, CASE WHEN credit THEN 'ABONO' ELSE 'CARGO' END AS tipo_operacion, (CASE WHEN credit THEN 0 ELSE price END)::DECIMAL(18,2) AS cargo, (CASE WHEN credit THEN price ELSE 0 END)::DECIMAL(18,2) AS abono, price AS saldo_operacion FROM m"""

#: The JSON words as they ought to be read: what is refused, and which coordinates get a default.
TYPED_WORDS = f"""WITH {WORDS}, k AS (SELECT *, seq % 11 AS kind FROM words)"""
