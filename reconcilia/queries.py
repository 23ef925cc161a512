"""Registered queries of the statement engine; each runs over its whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reconcilia import oracles as sql
from reconcilia import storage, views
from reconcilia.functions import clabe as cl
from reconcilia.functions import concepts, dates
from reconcilia.functions import money as m
from reconcilia.functions import text as t
from reconcilia.operators import banks, banorte_summary, fields, lines, movements, quality, reconcile, tables, trimming
from reconcilia.plans import statements
from reconcilia.sources import layouts, readers
from reconcilia.storage import saved, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = oracle
        return f

    return add


def _printed(spark: SparkSession, d: str, bank: str) -> DataFrame:
    """A bank's printed statements, written once as the word table that each section and filter reads."""
    return saved(views.statement_words(spark, d, bank))


# --- reconciliation ---------------------------------------------------------------------------------


@query(f"WITH {sql.CHECKS} SELECT statement_id, orden, nombre, esperado, obtenido, diferencia, correcto, mensaje FROM checks")
def reconcile_statements(spark, d):
    return reconcile.validations(views.movements(spark, d), views.summaries(spark, d))


@query(f"WITH {sql.CHECKS} SELECT statement_id, count(*) AS n_checks, count(*) FILTER (WHERE correcto) AS n_correct, count(*) FILTER (WHERE correcto) / count(*) AS score FROM checks GROUP BY 1")
def integrity_score(spark, d):
    return reconcile.integrity(reconcile_statements(spark, d))


@query(f"WITH {sql.MOVEMENTS} SELECT statement_id, sum(coalesce(abono, 0))::DECIMAL(18,2) AS total_abonos, sum(coalesce(cargo, 0))::DECIMAL(18,2) AS total_cargos, nullif(arg_max(saldo_operacion, numero_movimiento), 0) AS last_balance, count(*) AS n_movements FROM mov GROUP BY 1")
def statement_totals(spark, d):
    return reconcile.totals(views.movements(spark, d))


@query(f"WITH {sql.MOVEMENTS} SELECT statement_id, (coalesce(saldo_final, 0) - coalesce(saldo_anterior, 0))::DECIMAL(18,2) AS variacion FROM summ")
def balance_change(spark, d):
    return reconcile.balance_change(views.summaries(spark, d))


# --- sources ----------------------------------------------------------------------------------------


@query(f"WITH {sql.WORDS} SELECT file_id, seq, page, text, x0, x1, top, bottom, doctop FROM words")
def scan_words(spark, d):
    """The word table as a reader finds it: written as files, read with the given schema."""
    rows = readers.read(spark, "words", written(views.words(spark, d)))
    return rows.select("file_id", "seq", "page", "text", "x0", "x1", "top", "bottom", "doctop")


@query(f"WITH {sql.PAGES} SELECT file_id, string_agg(text, chr(10) ORDER BY page) AS text FROM pages_v WHERE page <= 5 AND text <> '' GROUP BY 1")
def head_text(spark, d):
    return readers.head_text(views.pages(spark, d))


@query(rf"""WITH {sql.PAGES} SELECT file_id, coalesce(string_agg(text, chr(10) ORDER BY page) FILTER (WHERE page <= 5 AND text <> ''), '') AS text,
  coalesce(min(page) FILTER (WHERE trim(text) <> '') - 1, count(*))::INTEGER AS initial_empty_pages, bool_or(trim(text) <> '') AS has_text FROM pages_v GROUP BY 1""")
def text_stage(spark, d):
    return readers.text_stage(views.pages(spark, d))


@query(f"""WITH {sql.PAGES}, {sql.WORDS}, skip AS (SELECT file_id, coalesce(min(page) FILTER (WHERE trim(text) <> '') - 1, count(*))::INTEGER AS n FROM pages_v GROUP BY 1)
SELECT w.file_id, seq, (page - coalesce(n, 0))::INTEGER AS page, text FROM words w LEFT JOIN skip s USING (file_id) WHERE page > coalesce(n, 0)""")
def logical_pages(spark, d):
    return readers.logical_pages(views.words(spark, d), readers.text_stage(views.pages(spark, d))).select("file_id", "seq", "page", "text")


@query(f"""WITH {sql.PAGES}, {sql.WORDS}, h AS (SELECT file_id, string_agg(text, chr(10) ORDER BY page) AS t FROM pages_v WHERE text <> '' GROUP BY 1)
SELECT w.file_id, count(*) AS n_words, coalesce(max(length(t)), 0)::INTEGER AS head_chars FROM words w LEFT JOIN h USING (file_id) GROUP BY 1""")
def full_read(spark, d):
    read = readers.full_read(views.pages(spark, d), views.words(spark, d, by_file=True))
    return read.groupBy("file_id").agg(F.count("*").alias("n_words"), F.coalesce(F.max("head_chars"), F.lit(0)).alias("head_chars"))


OCR = f"""{sql.WORDS}, ocr AS (SELECT file_id, page, ((ln // 6) % 7)::INTEGER AS block_num, ln AS line_num, seq AS token_idx, CASE WHEN seq % 17 = 5 THEN '  ' ELSE text END AS text,
  floor(x0 * 2550 / 612)::INTEGER AS l, floor(top * 2550 / 612)::INTEGER AS t, floor(x1 * 2550 / 612)::INTEGER - floor(x0 * 2550 / 612)::INTEGER AS w, CASE WHEN seq % 13 = 0 THEN '-' ELSE (seq % 100)::VARCHAR END AS conf FROM words)"""


@query(f"""WITH {OCR} SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY page, token_idx) - 1 AS seq, page, text, round(l * 0.24, 6) AS x0, round(l * 0.24 + w * 0.24, 6) AS x1, round(t * 0.24, 6) AS top,
  round((page - 1) * 792.0 + t * 0.24, 6) AS doctop, coalesce(try_cast(conf AS DOUBLE), -1.0) AS confidence FROM ocr WHERE trim(text) <> ''""")
def ocr_words(spark, d):
    w = readers.ocr_words(views.ocr_tokens(spark, d))
    r = lambda c: F.round(c, 6).alias(c)
    return w.select("file_id", "seq", "page", "text", r("x0"), r("x1"), r("top"), r("doctop"), "confidence")


@query(f"""WITH {OCR}, l AS (SELECT file_id, page, block_num, line_num, min(token_idx) AS f, string_agg(text, ' ' ORDER BY token_idx) AS line FROM ocr WHERE trim(text) <> '' AND page <= 5 GROUP BY 1, 2, 3, 4)
SELECT file_id, page, string_agg(line, chr(10) ORDER BY f) AS text FROM l GROUP BY 1, 2""")
def ocr_page_text(spark, d):
    return readers.ocr_page_text(views.ocr_tokens(spark, d))


@query(f"WITH {sql.CLABE}, n AS (SELECT prefix, count(*) AS n FROM ident GROUP BY 1) SELECT bank_key, display AS display_name, b.prefix, supported, coalesce(n, 0) AS n_statements FROM bank b LEFT JOIN n USING (prefix)")
def bank_catalogue(spark, d):
    """The catalogue, and how many of the customers' statements each bank issued."""
    issued = saved(banks.with_bank(views.clabe_texts(spark, d)).select("prefix")).groupBy("prefix").agg(F.count("*").alias("n"))
    return layouts.banks(spark).join(issued, "prefix", "left").select("bank_key", "display_name", "prefix", "supported", F.coalesce("n", F.lit(0)).alias("n_statements"))


def _json_words(spark, d):
    folder = f"{storage.shared_dir(spark)}/json-{uuid.uuid4().hex}"
    views.json_words(spark, d).write.text(folder, compression="gzip")
    return readers.quarantined(spark, folder)


@query(f"""{sql.TYPED_WORDS} SELECT file_id, seq, page, text, x0, CASE kind WHEN 1 THEN x0 ELSE x1 END AS x1, CASE kind WHEN 2 THEN 0 ELSE top END AS top, CASE kind WHEN 3 THEN top ELSE bottom END AS bottom, CASE kind WHEN 9 THEN 0 ELSE doctop END AS doctop,
  CASE kind WHEN 1 THEN 'x1' WHEN 2 THEN 'top' WHEN 3 THEN 'bottom' WHEN 9 THEN 'doctop' ELSE '' END AS defaulted FROM k WHERE kind NOT IN (4, 5, 6, 7, 8)""")
def typed_words(spark, d):
    """Words of JSON lines with defaults for coordinates that are missing or no numbers."""
    words, _ = _json_words(spark, d)
    return words.select("file_id", "seq", "page", "text", *readers.COORDINATES, F.array_join("defaulted", ",").alias("defaulted"))


@query(f"""{sql.TYPED_WORDS} SELECT CASE kind WHEN 6 THEN NULL WHEN 7 THEN ' ' ELSE file_id END AS file_id, CASE kind WHEN 6 THEN 'malformed' WHEN 7 THEN 'no_file' WHEN 8 THEN 'no_place' ELSE 'no_page' END AS reason,
  CASE kind WHEN 6 THEN '{{"file_id": "' || file_id || '", "seq": ' END AS malformed FROM k WHERE kind IN (4, 5, 6, 7, 8)""")
def rejected_words(spark, d):
    """Records of the same lines that are no words, and why; malformed ones as they stand."""
    _, rejects = _json_words(spark, d)
    return rejects.select("file_id", "reason", F.when(F.col("reason") == "malformed", F.col("record")).alias("malformed"))


# --- documents --------------------------------------------------------------------------------------

@query(f"WITH {sql.ODD}, src AS (SELECT doc_id AS k, text AS raw FROM odd), {sql.quality('src')} SELECT k AS doc_id, usable, CASE WHEN usable THEN 'pdf_digital' ELSE 'pdf_imagen' END AS document_type FROM u")
def document_quality(spark, d):
    docs = quality.usable_text(views.odd_texts(spark, d)).select("doc_id", "usable")
    return docs.withColumn("document_type", quality.document_type(F.col("usable"), F.lit(False)))


@query(f"WITH {sql.ROUTES} SELECT file_id, initial_empty_pages, document_type, CASE document_type WHEN 'pdf_digital' THEN 'words' ELSE 'ocr' END AS word_source FROM route")
def document_routing(spark, d):
    return quality.routed(readers.text_stage(views.odd_pages(spark, d)), views.odd_words(spark, d))


@query(f"WITH {sql.USABLE_WORDS} SELECT k AS file_id, usable FROM uw")
def usable_words(spark, d):
    return quality.usable_words(views.odd_words(spark, d))


#: Words of digital files as they are, but for leading empty pages; those of images from the OCR tokens.
CHOSEN = f"""WITH {sql.ROUTES}, ocr AS (SELECT file_id, page, seq AS i, CASE WHEN seq % 17 = 5 THEN '  ' ELSE text END AS text, floor(x0 * 2550 / 612)::INTEGER AS l, floor(top * 2550 / 612)::INTEGER AS t FROM words)
SELECT w.file_id, seq, (page - initial_empty_pages)::INTEGER AS page, text, round(x0, 6) AS x0, round(top, 6) AS top FROM ow w JOIN route USING (file_id) WHERE document_type = 'pdf_digital' AND page > initial_empty_pages
UNION ALL SELECT o.file_id, row_number() OVER (PARTITION BY o.file_id ORDER BY page, i) - 1, page, text, round(l * 0.24, 6), round(t * 0.24, 6) FROM ocr o JOIN route USING (file_id) WHERE document_type = 'pdf_imagen' AND trim(text) <> ''"""


@query(CHOSEN)
def chosen_words(spark, d):
    words = views.odd_words(spark, d)
    route = saved(quality.routed(readers.text_stage(views.odd_pages(spark, d)), words))
    out = quality.chosen_words(route, words, readers.ocr_words(views.ocr_tokens(spark, d)))
    return out.select("file_id", "seq", "page", "text", F.round("x0", 6).alias("x0"), F.round("top", 6).alias("top"))


@query(f"WITH {sql.CLABE} SELECT file_id, clabe, i.prefix, bank_key, coalesce(display, 'Desconocido') AS display_name, coalesce(supported, false) AS supported FROM ident i LEFT JOIN bank b ON b.prefix = i.prefix")
def bank_identification(spark, d):
    return banks.with_bank(views.clabe_texts(spark, d)).select("file_id", "clabe", "prefix", "bank_key", "display_name", "supported")


@query(f"WITH {sql.CLABE} SELECT file_id, CASE WHEN bank_key IS NULL THEN 'bank_not_identified' ELSE 'bank_not_supported' END AS reason FROM ident i LEFT JOIN bank b ON b.prefix = i.prefix WHERE NOT coalesce(supported, false)")
def bank_rejects(spark, d):
    return banks.rejects(banks.with_bank(views.clabe_texts(spark, d)))


@query("SELECT c_custkey::VARCHAR AS file_id, CASE WHEN c_custkey % 6 IN (1, 2, 3, 5) THEN ['012','002','014','072','044','021','638','062','059','999'][c_custkey % 10 + 1] || lpad(c_custkey::VARCHAR, 15, '0') END AS tabular FROM customer")
def tabular_clabe(spark, d):
    return views.clabe_texts(spark, d).select("file_id", cl.tabular_clabe(t.canonical(F.col("text"))).alias("tabular"))


# --- words, lines, boxes ----------------------------------------------------------------------------


@query(f"""WITH {sql.WORDS} SELECT file_id, seq, (x0 + x1) / 2 AS cx, round((top + bottom) / 2, 6) AS cy, round(abs(bottom - top), 6) AS h, (x0 + x1) / 2 BETWEEN 100 AND 315 AS in_column,
  (x0 + x1) / 2 BETWEEN 46 AND 261 AS in_wide_column, least(x1, 352) > greatest(x0, 84) AS overlaps, x1 BETWEEN 255 AND 324 AS right_edge FROM words""")
def word_geometry(spark, d):
    box = lambda a, b: F.struct(F.lit(float(a)).alias("xmin"), F.lit(float(b)).alias("xmax"))
    w = views.words(spark, d).withColumns({"c1": box(100, 315), "c2": box(52, 255), "c3": box(84, 352), "c4": box(255, 324)})
    return w.select(
        "file_id", "seq", lines.center_x().alias("cx"), F.round(lines.center_y(), 6).alias("cy"), F.round(lines.height(), 6).alias("h"), movements.in_column("c1").alias("in_column"),
        movements.in_column("c2", movements.BANAMEX_SLACK).alias("in_wide_column"), movements.overlaps("c3").alias("overlaps"), movements.right_edge_in("c4").alias("right_edge"),
    )


def _numbered(make):
    def run(spark, d):
        return make(views.stepped_words(spark, d)).select("file_id", "page", "seq", "line_no")

    return run


FIXED_RULE = "ln % 6 IN (2, 4, 5)"


@query(sql.stepped_lines("ln % 6 <> 0"))
def lines_by_anchor(spark, d):
    return _numbered(lines.anchored_lines)(spark, d)


@query(sql.stepped_lines("ln % 6 >= [4, 5, 2][file_id::BIGINT % 3 + 1] AND ln % 6 <> 3"))
def lines_by_mean(spark, d):
    return _numbered(lines.mean_lines)(spark, d)


@query(sql.stepped_lines(FIXED_RULE))
def lines_by_fixed_mean(spark, d):
    return _numbered(lines.fixed_mean_lines)(spark, d)


@query(sql.stepped_lines(FIXED_RULE))
def lines_by_doctop(spark, d):
    return _numbered(lambda w: lines.fixed_mean_lines(w, by_doctop=True))(spark, d)


@query(f"""WITH {sql.WORDS} SELECT file_id, page, page * 100000 + (ln % 42) + 1 AS line_no, string_agg(text, ' ' ORDER BY x0, seq) AS text, min(x0) AS x0, max(x1) AS x1, round(min(top), 6) AS top, max(x1) - min(x0) AS width,
  (min(x0) + max(x1)) / 2 AS center_x, count(*) AS n_words FROM words GROUP BY file_id, page, ln""")
def line_texts(spark, d):
    out = lines.line_texts(lines.anchored_lines(views.words(spark, d, by_file=True)))
    return out.select("file_id", "page", "line_no", "text", "x0", "x1", F.round("top", 6).alias("top"), "width", "center_x", "n_words")


@query(f"WITH {sql.WORDS} SELECT file_id, page, min(x0) AS page_xmin, max(x1) AS page_xmax FROM words GROUP BY 1, 2")
def page_bounds(spark, d):
    return lines.page_bounds(views.words(spark, d))


#: Heights of the words in points, for the median: some files have larger type, some words have no height.
HEIGHT = "(seq % 7 - 2) * 5 * (1 + file_id::BIGINT % 4)"


@query(f"WITH {sql.WORDS}, v AS (SELECT file_id, abs({HEIGHT}) AS h FROM words), h AS (SELECT file_id, list(h ORDER BY h) FILTER (WHERE h > 0) AS h FROM v GROUP BY 1) SELECT file_id, round(greatest(3.5, 0.45 * coalesce(h[len(h) // 2 + 1], 0)), 6)::DOUBLE AS tolerance FROM h")
def line_tolerance(spark, d):
    words = views.words(spark, d)
    words = words.withColumn("bottom", F.col("top") + (F.col("seq") % 7 - 2) * 5 * (1 + F.col("file_id").cast("long") % 4))
    return lines.line_tolerance(words.withColumns({"top": F.lit(0.0), "bottom": F.round(F.col("bottom") - F.col("top"))})).withColumn("tolerance", F.round("tolerance", 6))


def _boxes(bank: str, section: str, mode: str) -> Query:
    def run(spark, d):
        boxes = layouts.field_boxes(spark, bank, section).withColumns({"shift": F.lit(False), "first_row": F.lit(False)})
        hits = fields.words_in_boxes(views.words(spark, d), boxes.withColumns({"dx": F.lit(1.5 if mode == "band" else 0.0), "dy": F.lit(1.5 if mode == "band" else 0.0)}))
        values = fields.box_values(hits).select("file_id", "field", "text", "digits")
        return values.join(hits.groupBy("file_id", "field").agg(F.count("*").alias("n_words")), ["file_id", "field"])

    run.__name__ = f"boxes_{bank}_{section}"
    return query(sql.box_values(bank, section, mode))(run)


for _bank, _section, _mode in (("bbva", "datos", "center"), ("bbva", "resumen", "overlap"), ("bbva", "productos", "center"), ("banamex", "datos", "center"), ("banorte", "datos", "band")):
    _boxes(_bank, _section, _mode)


@query("SELECT DISTINCT o_custkey::VARCHAR AS file_id, CASE WHEN o_custkey // 3 % 2 = 1 AND o_custkey % 5 <> 0 THEN -13.073555 ELSE 0 END::DOUBLE AS shift_y FROM orders WHERE o_custkey % 3 = 0")
def layout_shift(spark, d):
    """Premium statements print their anchor higher; where both anchors stand, the normal one counts."""
    return fields.layout_shift(views.statement_words(spark, d, "bbva"), "resumen").withColumn("shift_y", F.round("shift_y", 6))


@query(f"WITH {sql.WORDS}, h AS (SELECT file_id, min(top) AS t FROM words WHERE page = 1 AND x0 BETWEEN 50 AND 300 AND top BETWEEN 200 AND 230 GROUP BY 1) SELECT w.file_id, count(*) AS n FROM words w JOIN h USING (file_id) WHERE page = 1 AND x0 BETWEEN 50 AND 300 AND top BETWEEN 200 AND 230 AND top - t <= 1.5 GROUP BY 1")
def first_row_of_box(spark, d):
    hits = views.words(spark, d).where("page = 1 AND x0 BETWEEN 50 AND 300 AND top BETWEEN 200 AND 230").withColumn("field", F.lit("x"))
    return fields.first_rows(hits).groupBy("file_id").agg(F.count("*").alias("n"))


# --- trimming ---------------------------------------------------------------------------------------


@query(f"WITH {sql.WORDS}, v AS (SELECT *, CASE WHEN seq % 5 = 0 THEN 'GAT' ELSE text END AS x FROM words), f AS (SELECT file_id, page, min(top) AS t FROM v WHERE top >= 750 AND x0 < 50 AND upper(x) IN ('BBVA','MEXICO,','MEXICO','R.F.C.','RFC','BBA830831LJ2','GAT') GROUP BY 1, 2) SELECT v.file_id, v.page, count(*) AS n FROM v LEFT JOIN f USING (file_id, page) WHERE t IS NULL OR top < t GROUP BY 1, 2")
def trim_bbva_footer(spark, d):
    words = views.words(spark, d).withColumn("text", F.when(F.col("seq") % 5 == 0, "GAT").otherwise(F.col("text")))
    return trimming.without_bbva_footer(words).groupBy("file_id", "page").agg(F.count("*").alias("n"))


@query(f"WITH {sql.WORDS} SELECT file_id, count(*) AS n FROM words WHERE NOT (top BETWEEN 0 AND 65) GROUP BY 1")
def trim_banamex_header(spark, d):
    return trimming.without_banamex_header(views.words(spark, d)).groupBy("file_id").agg(F.count("*").alias("n"))


@query(f"WITH {sql.WORDS} SELECT file_id, count(*) AS n FROM words WHERE top < 743 GROUP BY 1")
def trim_banorte_footer(spark, d):
    return trimming.without_banorte_footer(views.words(spark, d)).groupBy("file_id").agg(F.count("*").alias("n"))


CHART = "CASE WHEN seq % 997 IN (500, 900) THEN 'Gráfico' WHEN seq % 997 = 501 THEN 'transaccional' ELSE text END"


@query(f"WITH {sql.WORDS}, v AS (SELECT *, {CHART} AS x FROM words), l AS (SELECT *, lead(upper(x)) OVER o AS nx, lead(page) OVER o AS np FROM v WINDOW o AS (PARTITION BY file_id ORDER BY seq)), c AS (SELECT file_id, min(seq) AS cut FROM l WHERE upper(x) IN ('GRÁFICO', 'GRAFICO') AND nx = 'TRANSACCIONAL' AND np = page GROUP BY 1) SELECT v.file_id, count(*) AS n FROM v LEFT JOIN c USING (file_id) WHERE cut IS NULL OR seq < cut GROUP BY 1")
def trim_chart(spark, d):
    return trimming.without_chart(views.words(spark, d).withColumn("text", F.expr(CHART))).groupBy("file_id").agg(F.count("*").alias("n"))


#: In every 97th line: one with the words in order, one without its third, one in which the second is too far off.
MARK = "CASE seq % 1164 WHEN 361 THEN 'TOTAL' WHEN 362 THEN 'DE' WHEN 366 THEN 'MOVIMIENTOS' WHEN 1 THEN 'TOTAL' WHEN 2 THEN 'DE' WHEN 121 THEN 'TOTAL' WHEN 123 THEN 'DE' WHEN 124 THEN 'MOVIMIENTOS' ELSE text END"


@query(f"""WITH {sql.WORDS}, v AS (SELECT *, upper({MARK}) AS x FROM words), c AS (SELECT a.file_id, min({{'p': a.page, 't': a.top}}) AS cut FROM v a JOIN v b ON a.file_id = b.file_id AND a.page = b.page AND a.x = 'TOTAL' AND b.x = 'DE' AND abs(a.top - b.top) <= 2 AND b.x0 - a.x0 > 0 AND b.x0 - a.x0 < 60 AND (b.top, b.x0) > (a.top, a.x0)
  JOIN v m ON m.file_id = a.file_id AND m.page = a.page AND m.x = 'MOVIMIENTOS' AND abs(m.top - a.top) <= 2 AND (m.top, m.x0) > (b.top, b.x0) GROUP BY 1)
SELECT v.file_id, count(*) AS n FROM v LEFT JOIN c USING (file_id) WHERE cut IS NULL OR (page, top) < (cut.p, cut.t) GROUP BY 1""")
def trim_after_total(spark, d):
    words = views.words(spark, d).withColumn("text", F.expr(MARK))
    return trimming.cut_at(words, trimming.end_marker(words)).groupBy("file_id").agg(F.count("*").alias("n"))


HEADS = "CASE WHEN seq % 331 = 40 THEN 'Referencia' WHEN seq % 331 IN (37, 28) THEN 'Descripción' WHEN seq % 331 = 41 THEN 'x' ELSE text END"


@query(f"""WITH {sql.WORDS}, v AS (SELECT *, {HEADS} AS t, CASE WHEN seq % 331 = 40 THEN 220.0 ELSE x0 END AS x FROM words),
r AS (SELECT file_id, page AS p, top AS h, row_number() OVER (PARTITION BY file_id ORDER BY page, top) AS n FROM v WHERE upper(t) = 'REFERENCIA' AND x BETWEEN 215 AND 225),
term(name, a, b) AS (VALUES ('FECHA', 30, 70), ('SALDO', 510, 550), ('OPER', 15, 50), ('LIQ', 55, 80), ('DESCRIPCION', 80, 150), ('REFERENCIA', 215, 275), ('CARGOS', 365, 415), ('ABONOS', 425, 470), ('OPERACION', 470, 535), ('LIQUIDACION', 535, 605)),
gone AS (SELECT DISTINCT v.file_id, v.seq FROM v JOIN term ON upper(strip_accents(t)) = name AND x BETWEEN a AND b JOIN r ON r.file_id = v.file_id AND r.p = v.page AND n > 1 AND top BETWEEN h - 18 AND h + 3)
SELECT file_id, count(*) AS n FROM v ANTI JOIN gone USING (file_id, seq) GROUP BY 1""")
def trim_repeated_headers(spark, d):
    words = views.words(spark, d).withColumns({"text": F.expr(HEADS), "x0": F.when(F.col("seq") % 331 == 40, 220.0).otherwise(F.col("x0"))})
    return trimming.without_repeated_headers(words).groupBy("file_id").agg(F.count("*").alias("n"))


#: Every 20th line starts with a date; every 50th has two words in the middle; two of 70 lack their right end.
SECTION = "CASE WHEN seq % 240 = 1 THEN '05-ENE-2026' ELSE text END"
SECTION_ROWS = "CASE WHEN ln % 50 = 30 AND file_id::BIGINT % 3 = 0 THEN seq % 12 IN (5, 6) WHEN ln % 70 IN (64, 65) THEN seq % 12 < 9 ELSE true END"


@query(rf"""WITH {sql.WORDS}, v AS (SELECT * REPLACE ({SECTION} AS text) FROM words WHERE {SECTION_ROWS}),
p AS (SELECT file_id, page, min(x0) AS pmin, max(x1) AS pmax FROM v GROUP BY 1, 2),
k AS (SELECT *, regexp_matches(text, '(?i)^\d{{1,2}}-(ENE|FEB|MAR|ABR|MAY|JUN|JUL|AGO|SEP|OCT|NOV|DIC)') AS dated, regexp_full_match(text, '[+-]?\(?\$?\d{{1,3}}(?:,\d{{3}})*(?:\.\d{{1,2}})?\)?') AS amount FROM v),
l AS (SELECT file_id, page, ln, min(x0) AS a, max(x1) AS b, min(doctop) AS y, max(doctop) AS ymax, bool_or(dated AND x0 BETWEEN 45 AND 88) AS is_date, NOT bool_or(dated OR amount) AS plain FROM k GROUP BY 1, 2, 3),
m AS (SELECT *, plain AND b - a <= (pmax - pmin) * 0.35 AND abs((a + b) / 2 - (pmin + pmax) / 2) <= (pmax - pmin) * 0.15 AND a >= pmin + (pmax - pmin) * 0.30 AS centred, plain AND a <= pmin + greatest(7, (pmax - pmin) * 0.025) AND b - a <= (pmax - pmin) * 0.90 AS lone FROM l JOIN p USING (file_id, page)),
n AS (SELECT *, lead(lone) OVER w AS lone2, lead(y) OVER w AS y2, lead(page) OVER w AS p2, min(ln) FILTER (WHERE is_date) OVER (PARTITION BY file_id) AS first_date, max(ymax) FILTER (WHERE is_date) OVER (PARTITION BY file_id) AS last_date FROM m WINDOW w AS (PARTITION BY file_id ORDER BY ln)),
c AS (SELECT file_id, coalesce(arg_min(y, ln) FILTER (WHERE centred AND NOT is_date AND ln > first_date), arg_min(y, ln) FILTER (WHERE lone AND lone2 AND p2 = page AND y2 - y <= 28 AND y > last_date)) AS cut FROM n GROUP BY 1)
SELECT v.file_id, count(*) AS n, max(page) AS last_page FROM v JOIN c USING (file_id) WHERE cut IS NULL OR doctop < cut GROUP BY 1""")
def trim_last_section(spark, d):
    words = views.words(spark, d, by_file=True).withColumn("ln", F.floor(F.col("seq") / 12)).withColumn("k3", F.col("file_id").cast("long") % 3)
    rows = F.when((F.col("ln") % 50 == 30) & (F.col("k3") == 0), (F.col("seq") % 12).isin(5, 6)).when((F.col("ln") % 70).isin(64, 65), F.col("seq") % 12 < 9).otherwise(True)
    words = words.where(rows).drop("ln", "k3").withColumn("text", F.expr(SECTION))
    return trimming.without_last_section(words).groupBy("file_id").agg(F.count("*").alias("n"), F.max("page").alias("last_page"))


@query(f"""WITH {sql.WORDS}, v AS (SELECT *, {CHART} AS x FROM words), l AS (SELECT file_id, page, ln, string_agg(x, ' ' ORDER BY x0, seq) AS line, arg_min(top, x0) AS t FROM v GROUP BY 1, 2, 3),
c AS (SELECT file_id, arg_min({{'p': page, 't': t}}, ln) AS cut FROM l WHERE regexp_matches(upper(line), 'GR[ÁA]FICO TRANSACCIONAL') GROUP BY 1) SELECT v.file_id, count(*) AS n FROM v LEFT JOIN c USING (file_id) WHERE cut IS NULL OR (page, top) < (cut.p, cut.t) GROUP BY 1""")
def trim_marker_line(spark, d):
    words = views.words(spark, d, by_file=True).withColumn("text", F.expr(CHART))
    return trimming.cut_at(words, trimming.marker_line(words)).groupBy("file_id").agg(F.count("*").alias("n"))


# --- scalar functions -------------------------------------------------------------------------------


#: Letters with one and two marks in several scripts, and letters with loose marks.
MARKED_TEXTS = ["Việt Nam ế ộ ữ", "ά έ Ή ώ ϋ ΐ", "ё й Ї ў ѓ", "ǖ ǭ ḗ ẗ Å", "e\u0301 n\u0303"]


@query(r"""SELECT o_orderkey, upper(strip_accents(regexp_replace(trim(o_comment), '\s+', ' ', 'g'))) AS canonical, regexp_replace(o_clerk, '\D', '', 'g') AS digits, trim(regexp_replace('  ' || o_comment || ' – ', '\s+', ' ', 'g')).replace('–', '-') AS word,
  nullif(trim(regexp_replace(o_orderpriority, '\s+', ' ', 'g')), '') AS collapsed, 'ABC010101XY' || o_orderkey % 10 AS rfc, CASE WHEN o_orderkey % 2 = 0 THEN lpad(o_orderkey::VARCHAR, 18, '0') END AS clabe, upper(strip_accents(['Việt Nam ế ộ ữ', 'ά έ Ή ώ ϋ ΐ', 'ё й Ї ў ѓ', 'ǖ ǭ ḗ ẗ Å', 'e' || chr(769) || ' n' || chr(771)][o_orderkey % 5 + 1])) || ' ' || o_orderkey AS marked FROM (SELECT *, o_clerk || ' ' || o_orderpriority AS o_comment FROM (SELECT *, 'Clérk#' || lpad(o_custkey::VARCHAR, 9, '0') AS o_clerk FROM orders))""")
def text_functions(spark, d):
    o = views.table(spark, d, "orders").withColumn("o_clerk", F.concat(F.lit("Clérk#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))).withColumn("o_comment", F.concat_ws(" ", "o_clerk", "o_orderpriority"))
    number = F.lpad(F.col("o_orderkey").cast("string"), 18, "0")
    return o.select(
        "o_orderkey", t.canonical(F.concat(F.lit(" "), F.lower("o_comment"), F.lit("\n"))).alias("canonical"), t.digits(F.col("o_clerk")).alias("digits"), t.word_text(F.concat(F.lit("  "), "o_comment", F.lit(" – "))).alias("word"),
        t.collapsed_or_null(F.col("o_orderpriority")).alias("collapsed"), t.rfc_labelled(F.concat(F.lit("RFC: RFC:abc 010101 xy"), (F.col("o_orderkey") % 10).cast("string"))).alias("rfc"), t.clabe_or_null(F.when(F.col("o_orderkey") % 2 == 0, number).otherwise("12 3")).alias("clabe"),
        t.canonical(F.concat_ws(" ", F.get(F.array(*map(F.lit, MARKED_TEXTS)), (F.col("o_orderkey") % 5).cast("int")), F.col("o_orderkey").cast("string"))).alias("marked"),
    )


@query("""WITH p AS (SELECT o_orderkey, o_totalprice::DECIMAL(18,2) AS v, format('{:,}', floor(o_totalprice)::BIGINT) || '.' || lpad(((o_totalprice::DECIMAL(18,2) * 100)::BIGINT % 100)::VARCHAR, 2, '0') AS s FROM orders)
SELECT o_orderkey, v AS plain, CASE WHEN o_orderkey % 2 = 0 THEN -v ELSE v END AS wrapped, CASE WHEN o_orderkey % 3 = 0 THEN -v ELSE v END AS trailing, CASE WHEN o_orderkey % 5 <> 0 THEN v END AS optional, o_orderkey % 4 <> 1 AS is_money, o_orderkey % 3 = 0 AS is_money_bare,
  v::DOUBLE::BIGINT * 0 + floor(v)::INTEGER AS whole, (o_orderkey % 9)::DOUBLE + 0.5 AS pct FROM p""")
def money_functions(spark, d):
    s = F.format_number(F.col("o_totalprice").cast(m.MONEY), 2)
    k = F.col("o_orderkey")
    cat = lambda *v: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in v))
    return views.table(spark, d, "orders").select(
        "o_orderkey", m.plain(s).alias("plain"), m.in_parentheses(F.when(k % 2 == 0, cat("($", s, ")")).otherwise(cat("$", s))).alias("wrapped"), m.in_parentheses(F.when(k % 3 == 0, cat("$", s, "-")).otherwise(s), True).alias("trailing"),
        m.optional(F.when(k % 5 == 0, "N/A").otherwise(cat("$", s))).alias("optional"), m.is_amount(F.when(k % 4 == 1, cat("$", s, ".5")).otherwise(cat("$", s)), m.BANAMEX).alias("is_money"), m.is_amount(F.when(k % 3 == 0, "123.5").otherwise("1234.00"), m.BANORTE).alias("is_money_bare"),
        m.whole(s).alias("whole"), m.percent(cat((k % 9).cast("string"), ".5%")).alias("pct"),
    )


@query("""SELECT o_orderkey, o_orderkey % 3 <> 2 AS is_date, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%d') || '-ENE-' || strftime(o_orderdate, '%Y') ELSE strftime(o_orderdate, '%d') || '-ENE-' || strftime(o_orderdate, '%y') END AS prefix, 'PAGO' || o_orderkey AS rest,
  strftime(o_orderdate, '%d') || '/Enero/' || strftime(o_orderdate, '%Y') AS slashed FROM orders""")
def date_functions(spark, d):
    day, year, short = F.date_format("o_orderdate", "dd"), F.date_format("o_orderdate", "yyyy"), F.date_format("o_orderdate", "yy")
    k = F.col("o_orderkey")
    printed = F.concat(day, F.lit("-ene-"), F.when(k % 2 == 0, year).otherwise(short), F.lit("PAGO"), k.cast("string"))
    return views.table(spark, d, "orders").select(
        "o_orderkey", dates.is_day_month(F.when(k % 3 == 0, F.concat(day, F.lit(" ene"))).when(k % 3 == 1, F.concat(day, F.lit("/ENE/"), year)).otherwise(F.concat(day, F.lit(" X")))).alias("is_date"),
        dates.date_prefix(printed).alias("prefix"), dates.without_date_prefix(printed).alias("rest"), dates.slashed_date(F.concat(F.lit("al "), day, F.lit("/Enero/"), year, F.lit("."))).alias("slashed"),
    )


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice::DECIMAL(18,2) ELSE 0 END AS credit, CASE WHEN o_orderkey % 3 = 1 THEN o_totalprice::DECIMAL(18,2) ELSE 0 END AS debit FROM orders")
def signed_amounts(spark, d):
    sign = F.when(F.col("o_orderkey") % 3 == 0, 1).when(F.col("o_orderkey") % 3 == 1, -1).otherwise(0)
    credit, debit = m.signed(sign, F.col("o_totalprice").cast(m.MONEY))
    return views.table(spark, d, "orders").select("o_orderkey", credit.alias("credit"), debit.alias("debit"))


# --- concepts ---------------------------------------------------------------------------------------



def _concepts(spark, d, bank: str) -> DataFrame:
    facts = views.order_facts(spark, d).where(F.col("custkey") % 3 == {"bbva": 0, "banamex": 1, "banorte": 2}[bank])
    return facts.withColumn("c", F.concat_ws("\n", *views.concept_lines(bank)))


def _concept_query(bank: str, make, oracle: str, columns: str) -> Query:
    def run(spark, d):
        return _concepts(spark, d, bank).select(F.col("custkey").cast("string").alias("file_id"), "n", *(v.cast("string").alias(k) for k, v in make(F.col("c")).items()))

    run.__name__ = f"concepts_{bank}"
    return query(f"SELECT file_id, numero_movimiento AS n, {columns} FROM ({oracle})")(run)


_concept_query("bbva", concepts.bbva_fields, sql.BBVA, "beneficiario, clabe_beneficiario, cuenta_beneficiario, concepto_original, rfc, autorizacion, hora_operacion")
_concept_query("banamex", concepts.banamex_fields, sql.BANAMEX, "referencia, autorizacion, sucursal, caja, hora_operacion, rfc, beneficiario, cuenta_beneficiario, clabe_beneficiario, concepto_original")
_concept_query("banorte", concepts.banorte_fields, sql.BANORTE, "hora_operacion, beneficiario, clabe_beneficiario, cuenta_beneficiario, rfc, concepto_original, referencia")


# --- printed statements, end to end -----------------------------------------------------------------


@query(sql.BBVA)
def movements_bbva(spark, d):
    return movements.movements_of(_printed(spark, d, "bbva"), "bbva")


@query(sql.BANAMEX)
def movements_banamex(spark, d):
    return movements.movements_of(_printed(spark, d, "banamex"), "banamex")


@query(sql.BANORTE)
def movements_banorte(spark, d):
    return movements.movements_of(_printed(spark, d, "banorte"), "banorte")


@query(sql.account_sql(0, "012", "MAESTRA", "/01/2026"))
def account_bbva(spark, d):
    return fields.account_data(_printed(spark, d, "bbva"), "bbva")


@query(sql.account_sql(1, "002", "PERFILES", "/ENE/2026"))
def account_banamex(spark, d):
    return fields.account_data(_printed(spark, d, "banamex"), "banamex")


@query(sql.account_sql(2, "072", "ENLACE", "/Enero/2026"))
def account_banorte(spark, d):
    return fields.account_data(_printed(spark, d, "banorte"), "banorte")


@query(sql.summary_sql("bbva"))
def summary_bbva(spark, d):
    return fields.bbva_summary(_printed(spark, d, "bbva"))


@query(sql.summary_sql("banamex"))
def summary_banamex(spark, d):
    return fields.banamex_summary(_printed(spark, d, "banamex"))


@query(sql.summary_sql("banorte"))
def summary_banorte(spark, d):
    files = views.statement_files(spark, d).where("bank_key = 'banorte'").select("file_id")
    return banorte_summary.banorte_summary(views.statement_words(spark, d, "banorte"), files)


@query(sql.products_sql())
def products_bbva(spark, d):
    return fields.bbva_products(_printed(spark, d, "bbva"))


@query(sql.products_sql(numbers=True))
def product_numbers(spark, d):
    found = fields.with_numbers(fields.bbva_products(_printed(spark, d, "bbva")))
    return found.select("file_id", *(f"{f}_num" for f in fields.PRODUCTS[2:]))


@query("SELECT DISTINCT o_custkey::VARCHAR AS file_id, CASE WHEN o_custkey // 3 % 2 = 1 THEN 'premium' ELSE 'normal' END AS variant FROM orders WHERE o_custkey % 3 = 0")
def layout_variant(spark, d):
    return trimming.layout_variant(_printed(spark, d, "bbva"), False)


@query("""WITH p AS (SELECT o_custkey, (count(*) - 1) // 9 + 2 AS last FROM orders WHERE o_custkey % 3 = 1 GROUP BY 1)
SELECT o_custkey::VARCHAR AS file_id, page::INTEGER AS page, CASE WHEN page NOT BETWEEN 2 AND last THEN 324 WHEN page % 2 = 0 THEN 341.75 ELSE 338.75 END::DOUBLE AS border_1, CASE WHEN page NOT BETWEEN 2 AND last THEN 408 WHEN page % 2 = 0 THEN 419.75 ELSE 418.75 END::DOUBLE AS border_2 FROM p, range(1, last + 1) r(page)""")
def page_columns(spark, d):
    words = _printed(spark, d, "banamex").withColumn("bank_key", F.lit("banamex"))
    known = layouts.BUILT_IN.only(["banamex"])
    bounds = movements.page_bounds(movements.placed_pages(movements.trimmed_pages(words, known), words, known))
    return bounds.select("file_id", "page", F.col("cargo.xmax").alias("border_1"), F.col("abono.xmax").alias("border_2"))


def _every(spark, d) -> statements.Statements:
    """All statements; they are printed once, and words and OCR tokens are read from that table."""
    return statements.process(*views.every_statement(spark, d, saved(views.all_statement_words(spark, d))))


@query(sql.PROCESS)
def process_statements(spark, d):
    out = _every(spark, d)
    return out.validations.select("statement_id", "orden", "esperado", "obtenido", "diferencia")


def _fourth(spark, d):
    """Statements of a bank that the package doesn't know, read by the rows of its layout and no code."""
    words, pages = views.fourth_statements(spark, d)  # fields or movements read the words, once
    return statements.process(words, pages, known=layouts.BUILT_IN.plus(layouts.packaged("santander")))


@query(sql.FOURTH_MOVEMENTS)
def fourth_bank_movements(spark, d):
    return _fourth(spark, d).movements.select("file_id", "numero_movimiento", "fecha_operacion", "concepto", "tipo_operacion", "cargo", "abono", "saldo_operacion")


@query(sql.FOURTH_FIELDS)
def fourth_bank_fields(spark, d):
    out = _fourth(spark, d)
    account = out.account.drop("periodo_fin", "numero_cliente")
    summary = out.summary.select("file_id", "saldo_anterior", "depositos_abonos", "retiros_cargos", "saldo_final", "dias_periodo", "tasa_bruta_anual", "saldo_promedio")
    found = account.join(summary, "file_id").join(out.products.select("file_id", "contrato", "producto", "total_comisiones"), "file_id")
    return found.join(out.identified.select("file_id", "bank_key"), "file_id")


def _keys(files: DataFrame) -> DataFrame:
    """Of ``files`` (file_id, bank_key), all parsed, in the order of their numbers."""
    named = files.withColumns({"file_name": F.concat("file_id", F.lit(".pdf")), "input_ord": F.col("file_id").cast("long"), "parsed": F.lit(True)})
    return tables.statement_keys(named)


MONEY_2 = "WITH m AS (SELECT o_custkey AS k, o_totalprice::DECIMAL(18,2) AS price, o_orderstatus IN ('F', 'O') AS credit, NOT (o_custkey % 3 = 1 AND o_orderkey % 7 = 0) AS shown FROM orders), ids AS (SELECT k, row_number() OVER (ORDER BY k) AS id FROM (SELECT DISTINCT k FROM m))"


@query(MONEY_2 + """ SELECT id::INTEGER AS "id_estado", k::VARCHAR || '.pdf' AS "Nombre del Archivo", ['bbva', 'banamex', 'banorte'][k % 3 + 1] AS "Banco", lpad(k::VARCHAR, 10, '0') AS "Número de Cuenta", count(*) AS n,
  sum(CASE WHEN credit AND shown THEN price ELSE 0 END)::DECIMAL(28,2) AS "Abono", sum(CASE WHEN NOT credit AND shown THEN price ELSE 0 END)::DECIMAL(28,2) AS "Cargo", sum(price)::DECIMAL(28,2) AS "Saldo" FROM m JOIN ids USING (k) GROUP BY id, k""")
def normalised_tables(spark, d):
    """The movements table of all statements, summed up by account."""
    out = _every(spark, d)
    made = tables.normalised(_keys(out.identified.select("file_id", "bank_key")), out.account, out.products, out.summary, out.movements)
    keys = ["id_estado", "Nombre del Archivo", "Banco", "Número de Cuenta"]
    return made["Movimientos"].groupBy(*keys).agg(F.count("*").alias("n"), F.sum("Abono").alias("Abono"), F.sum("Cargo").alias("Cargo"), F.sum("Saldo de Operación").alias("Saldo"))


def _tables(spark, d) -> dict[str, DataFrame]:
    """The normalised tables of all banks' printed statements, but for the movements'."""
    words = saved(fields.front(reduce(DataFrame.unionByName, (views.statement_words(spark, d, b).withColumn("bank_key", F.lit(b)) for b in BANKS))), "bank_key")
    files = saved(views.statement_files(spark, d))
    found = saved(fields.sections(words, files))
    none = words.select("file_id", *(F.lit(None).alias(c) for c in ("numero_movimiento", *movements.MOVEMENT))).limit(0)
    return tables.normalised(_keys(files), fields.section(found, "datos"), fields.section(found, "productos"), statements.summaries(found, words), none)


def _all_tables(spark, d) -> dict[str, DataFrame]:
    """The four tables of all statements, with those behind blank pages and those that are images."""
    out = _every(spark, d)
    return tables.normalised(_keys(out.identified.select("file_id", "bank_key")), out.account, out.products, out.summary, out.movements)


def _sunk(spark, d) -> dict[str, DataFrame]:
    """The same from the versioned sink: written, committed and read back."""
    store = tables.Versions(spark, f"{storage.shared_dir(spark)}/sink-{uuid.uuid4().hex}")
    store.commit(_all_tables(spark, d), "all")
    return store.tables()


BANKS = ["bbva", "banamex", "banorte"]
OF_ALL = {
    "account": " UNION ALL ".join(f"SELECT * FROM ({sql.account_sql(*a)})" for a in ((0, "012", "MAESTRA", "/01/2026"), (1, "002", "PERFILES", "/ENE/2026"), (2, "072", "ENLACE", "/Enero/2026"))),
    "summary": " UNION ALL ".join(f"SELECT * FROM ({sql.summary_sql(b)})" for b in BANKS),
    "products": f"SELECT * FROM ({sql.products_sql()}) UNION ALL SELECT DISTINCT o_custkey::VARCHAR AS file_id, {', '.join(['$na'] * 6)} FROM orders WHERE o_custkey % 3 <> 0".replace("$na", "'N/A'"),
    "movements": " UNION ALL ".join(f"SELECT * FROM ({m})" for m in (sql.BBVA, sql.BANAMEX, sql.BANORTE)),
}


def _titled(titles: dict[str, str], made: str, more: str = "") -> str:
    """The SQL of a normalised table of all banks from that of its fields."""
    columns = ", ".join(f'x.{c} AS "{t}"' for c, t in titles.items())
    ids = "(SELECT k::VARCHAR AS file_id, (row_number() OVER (ORDER BY k))::INTEGER AS id_estado FROM (SELECT DISTINCT o_custkey AS k FROM orders))"
    return f"""SELECT id_estado, x.file_id || '.pdf' AS "Nombre del Archivo", ['bbva', 'banamex', 'banorte'][x.file_id::BIGINT % 3 + 1] AS "Banco", {columns} FROM ({made}) x JOIN {ids} i USING (file_id)"""


@query(_titled(tables.ACCOUNT, OF_ALL["account"]))
def table_accounts(spark, d):
    return _tables(spark, d)["Datos de la Cuenta"]


@query(_titled(tables.PRODUCT, OF_ALL["products"]))
def table_products(spark, d):
    """A layout without products has N/A in each field, by definition."""
    return _tables(spark, d)["Otros Productos"]


@query(_titled(tables.PRODUCT, "SELECT DISTINCT o_custkey::VARCHAR AS file_id, 'N/A' AS contrato, 'N/A' AS producto, 'N/A' AS tasa_interes_anual, 'N/A' AS gat_nominal_anual, 'N/A' AS gat_real_anual, 'N/A' AS total_comisiones FROM orders WHERE o_custkey % 3 = 1"))
def table_no_products(spark, d):
    return _tables(spark, d)["Otros Productos"].where("Banco = 'banamex'")


@query(_titled(tables.SUMMARY, OF_ALL["summary"]))
def table_summaries(spark, d):
    return _tables(spark, d)["Resumen Financiero"]


@query(_titled(tables.MOVEMENTS, f"SELECT m.*, a.fecha_corte, a.numero_cuenta FROM ({OF_ALL['movements']}) m JOIN ({OF_ALL['account']}) a USING (file_id)"))
def table_movements(spark, d):
    """All 24 columns of every movement of every bank, read back from the sink."""
    return _sunk(spark, d)["Movimientos"]


@query(f"WITH {sql.MOVEMENTS} SELECT count(DISTINCT statement_id) AS n_statements, count(*) AS n_movements FROM mov")
def statement_count(spark, d):
    return reconcile.statement_count(views.movements(spark, d))


@query("SELECT t AS name, CASE t WHEN 'Movimientos' THEN (SELECT count(*) FROM orders) ELSE (SELECT count(DISTINCT o_custkey) FROM orders) END AS n FROM (VALUES ('Datos de la Cuenta'), ('Otros Productos'), ('Resumen Financiero'), ('Movimientos')) v(t)")
def sink_tables(spark, d):
    """Rows of each table in the sink's version."""
    return reduce(DataFrame.unionByName, (df.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, df in _sunk(spark, d).items()))


def _batch_files(spark, d, number: int) -> DataFrame:
    """Files of three batches: every file in the batch of its remainder, and a fifth of them again in the next."""
    files = views.table(spark, d, "orders").select(F.col("o_custkey").alias("input_ord")).distinct()
    mine = (F.col("input_ord") % 3 == number) | ((F.col("input_ord") % 3 == number - 1) & (F.col("input_ord") % 5 == 0))
    return files.where(mine).withColumns({"file_id": F.col("input_ord").cast("string"), "parsed": F.col("input_ord") % 7 != 0})


@query("""WITH k AS (SELECT DISTINCT o_custkey AS k, o_custkey % 3 AS b FROM orders), id AS (SELECT k, b, row_number() OVER (ORDER BY b, k)::INTEGER AS id_estado FROM k)
SELECT b::INTEGER AS batch, k::VARCHAR AS file_id, id_estado FROM id WHERE k % 7 <> 0 UNION ALL SELECT b::INTEGER + 1, k::VARCHAR, id_estado FROM id WHERE b < 2 AND k % 5 = 0 AND k % 7 <> 0""")
def keys_over_batches(spark, d):
    """Ids of three batches, the last of which comes twice: new files go on where the batch before ended, and known ones keep theirs."""
    keys = tables.KeyDimension(spark, f"{storage.shared_dir(spark)}/keys-{uuid.uuid4().hex}")
    made = [saved(keys.assign(_batch_files(spark, d, n), f"batch {n}").select(F.lit(n).alias("batch"), "file_id", "id_estado")) for n in (0, 1, 2, 2)]
    return reduce(DataFrame.unionByName, made[:2] + made[3:])


@query("SELECT row_number() OVER (ORDER BY o_custkey)::INTEGER AS id_estado, o_custkey::VARCHAR AS file_id FROM (SELECT DISTINCT o_custkey FROM orders) QUALIFY o_custkey % 5 <> 0")
def statement_keys(spark, d):
    files = views.table(spark, d, "orders").select(F.col("o_custkey").alias("input_ord")).distinct()
    files = files.withColumns({"file_id": F.col("input_ord").cast("string"), "parsed": F.col("input_ord") % 5 != 0})
    return tables.statement_keys(files).select("id_estado", "file_id")


@query("SELECT n_name AS a, n_regionkey AS b, NULL::VARCHAR AS c FROM nation UNION ALL SELECT NULL, r_regionkey, r_name FROM region UNION ALL SELECT c_name, c_nationkey, NULL FROM customer")
def header_union(spark, d):
    n = views.table(spark, d, "nation").select(F.col("n_name").alias("a"), F.col("n_regionkey").alias("b"))
    r = views.table(spark, d, "region").select(F.col("r_regionkey").alias("b"), F.col("r_name").alias("c"))
    c = views.table(spark, d, "customer").select(F.col("c_name").alias("a"), F.col("c_nationkey").alias("b"))
    return tables.header_union([n, r, c])


@query(f"WITH {sql.WORDS} SELECT DISTINCT file_id, page FROM words")
def distinct_pages(spark, d):
    return views.words(spark, d).select("file_id", "page").distinct()
