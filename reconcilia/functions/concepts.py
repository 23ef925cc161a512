"""What a movement's concept says: counterparty, tax id, reference, time. One family for each layout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reconcilia.functions.text import digits, filled, found, rfc_compact, word_text, word_upper

# The labels and forms below are those the layouts print.
I = "(?iU)"  # noqa: E741
TIME = r"(?:[01]?\d|2[0-3]):[0-5]\d"
TIME_S = rf"{TIME}(?::[0-5]\d)?"
CODE = r"\s*[:#-]?\s*([A-Z0-9]+)\b"
#: Labels of three or four letters: with a number of six or nine digits behind them they look like a tax id.
NO_LABEL = r"(?!(?:REF|AUT|SUC|CAJA|CTA|HORA|RFC)\b)"


def lines_of(concept: Column) -> Column:
    """Non-blank trimmed lines."""
    return F.filter(F.transform(F.split(concept, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def line_of(concept: Column, place: int, lines: Column | None = None) -> Column:
    """``lines``: ``lines_of`` the concept where it is a column already; otherwise they are made again for each line."""
    return F.get(lines_of(concept) if lines is None else lines, place)


def flat(concept: Column, lines: Column | None = None) -> Column:
    """One line for searching."""
    return word_text(F.array_join(lines_of(concept) if lines is None else lines, " "))


def clean(text: Column) -> Column:
    return filled(word_text(text))


# --- first layout -----------------------------------------------------------------------------------


def bbva_is_spei(c: Column, lines: Column | None = None) -> Column:
    return F.coalesce(line_of(c, 0, lines).rlike(I + r"^SPEI\s+(RECIBIDO|ENVIADO)"), F.lit(False))


def bbva_is_third_party(c: Column, lines: Column | None = None) -> Column:
    return F.coalesce(line_of(c, 0, lines).rlike(I + r"^PAGO\s+CUENTA\s+DE\s+TERCERO$"), F.lit(False))


def bbva_fields(c: Column, lines: Column | None = None) -> dict[str, Column]:
    spei, third = bbva_is_spei(c, lines), bbva_is_third_party(c, lines)
    second, number = line_of(c, 1, lines), digits(line_of(c, 2, lines))
    account = found(second, I + r"^BNET\s+(\d+)(?:\s|$)")
    clabe = F.when(F.length(number) >= 18, F.right(number, F.lit(18)))
    rest = filled(F.trim(found(second, I + r"^BNET\s+\d+\s*(.*)$")))
    return {
        "beneficiario": F.when(spei, filled(line_of(c, 4, lines))).when(third, account),
        "clabe_beneficiario": F.when(spei, clabe),
        "cuenta_beneficiario": F.when(third, account),
        "concepto_original": F.when(spei, second).when(third, rest),
        "rfc": rfc_compact(found(c, I + r"RFC:\s*([A-Z&Ñ]{3,4}\s?\d{6}[A-Z0-9]{3})")),
        "autorizacion": found(c, I + r"AUT:\s*([A-Z0-9]+)"),
        "hora_operacion": found(c, r"(\d{1,2}:\d{2})"),
    }


# --- second layout ----------------------------------------------------------------------------------


def kind_said(upper: Column) -> Column:
    """What the words of a concept (upper case) say where there is no amount on either side."""
    credit = upper.rlike("DEPOSITO|DEPÓSITO|ABONO|TRANSFERENCIA RECIBIDA|TRASPASO RECIBIDO")
    debit = upper.rlike("RETIRO|CARGO|PAGO|TRANSFERENCIA ENVIADA|TRASPASO ENVIADO")
    return F.when(credit, "ABONO").when(debit, "CARGO")


def banamex_type(cargo: Column, abono: Column, c: Column) -> Column:
    return F.when(cargo > 0, "CARGO").when(abono > 0, "ABONO").otherwise(kind_said(word_upper(c)))


def banamex_fields(c: Column) -> dict[str, Column]:
    reference = [found(c, I + rf"\b{label}\s*[:#-]?\s*([A-Z0-9*_-]+)") for label in ("REFERENCIA", "REF")]
    explicit = found(c, I + rf"\bHORA\s*[:#-]?\s*({TIME})\b")
    return {
        "referencia": F.coalesce(*reference, found(c, I + r"(?<!\S)(\*{2,}[A-Z0-9_-]+)")),
        "autorizacion": found(c, I + r"\bAUT" + CODE),
        "sucursal": found(c, I + r"\bSUC" + CODE),
        "caja": found(c, I + r"\bCAJA" + CODE),
        "hora_operacion": F.coalesce(explicit, found(c, rf"(?U)\b{TIME}\b", 0)),
        "rfc": F.upper(F.regexp_replace(found(c, I + rf"\b{NO_LABEL}([A-Z&Ñ]{{3,4}}\s?\d{{6}}\s?[A-Z0-9]{{3}})\b"), r"(?U)\s+", "")),
        "beneficiario": F.coalesce(clean(found(c, I + r"\bBENEFICIARIO\s*[:#-]?\s*(.+)")), clean(found(c, I + r"\bA\s+FAVOR\s+DE\s+(.+)"))),
        "cuenta_beneficiario": F.coalesce(found(c, I + r"\bCUENTA\s*[:#-]?\s*(\d{4,20})\b"), found(c, I + r"\bCTA\s*[:#-]?\s*(\d{4,20})\b")),
        "clabe_beneficiario": found(c, r"(?<!\d)(\d{18})(?!\d)"),
        "concepto_original": c,
    }


# --- third layout -----------------------------------------------------------------------------------


def banorte_is_received(c: Column, lines: Column | None = None) -> Column:
    return F.coalesce(line_of(c, 0, lines).rlike(I + r"\bSPEI\s+RECIBIDO\b"), F.lit(False))


def banorte_is_order(c: Column, lines: Column | None = None) -> Column:
    return F.coalesce(word_text(line_of(c, 0, lines)).rlike(I + r"\bORDEN\s+DE\s+PAGO\s+SPEI\b"), F.lit(False))


def _compact_time(text: Column) -> Column:
    """hhmmss behind HR LIQ, if it is a time of day."""
    six = found(text, I + r"\bHR\s+LIQ\s*:\s*(\d{6})\b")
    pair = [F.substring(six, k, 2) for k in (1, 3, 5)]
    return F.when((pair[0] <= "23") & (pair[1] <= "59") & (pair[2] <= "59"), F.concat_ws(":", *pair))


def banorte_general_rfc(text: Column) -> Column:
    form = r"([A-Z&Ñ]{3,4}\s*\d{6}\s*[A-Z0-9]{2,3})\b"
    either = F.coalesce(found(text, I + r"\bRFC\s*:\s*" + form), found(text, I + r"\bAL\s+RFC\s+" + form))
    return F.upper(F.regexp_replace(either, r"(?U)\s+", ""))


def banorte_fields(c: Column, one_line: Column | None = None, lines: Column | None = None) -> dict[str, Column]:
    """``one_line``: ``flat`` of the concept where it is a column already; otherwise it is made again in each search. ``lines``: its lines in the same way."""
    received, order, t = banorte_is_received(c, lines), banorte_is_order(c, lines), flat(c, lines) if one_line is None else one_line
    kinds = lambda r, o: F.when(received, r).when(order, o)
    order_rfc = clean(found(t, I + r"\bRFC\s*:\s*([A-Z&Ñ0-9]+(?:\s+[A-Z&Ñ0-9]+)?)\b"))
    order_rfc = F.when(~F.upper(order_rfc).isin("ND", "N D", "NO CAPTURADO"), F.upper(F.regexp_replace(order_rfc, r"(?U)\s+", "")))
    unverified = r"\s*\(?\s*DATO\s+NO\s+VERIF\s+POR\s+ESTA\s+INST\s*\)?"
    payee = F.when(t.rlike(I + r"\bBENEF\s*:\s*(.*?)" + unverified), clean(found(t, I + r"\bBENEF\s*:\s*(.*?)" + unverified))).otherwise(clean(found(t, I + r"\bBENEF\s*:\s*(.*?)(?:,\s*(?:PAGO|PGO)\b)")))
    return {
        "hora_operacion": kinds(F.coalesce(found(t, I + rf"\bHR\s+LIQ\s*:\s*({TIME_S})"), _compact_time(t)), found(t, I + rf"\bHORA\s+LIQ\s*:\s*({TIME_S})")),
        "beneficiario": kinds(clean(found(t, I + r"\bDEL\s+CLIENTE\s+(.*?)\s+DE\s+LA\s+CLABE\b")), payee),
        "clabe_beneficiario": kinds(F.coalesce(found(t, I + r"\bDE\s+LA\s+CLABE\s+(\d{18})\b"), found(t, I + r"\bCLABE\s+(\d{18})\b")), F.coalesce(found(t, I + r"\bCTA/CLABE\s*:\s*(\d{16,18})\b"), found(t, I + r"\bCTA\s*/\s*CLABE\s*:\s*(\d{16,18})\b"))),
        "cuenta_beneficiario": F.lit(None).cast("string"),
        "rfc": F.when(received, F.upper(found(t, I + r"\bCON\s+RFC\s+([A-Z&Ñ]{3,4}\d{6}[A-Z0-9]{3})\b"))).when(order, order_rfc).otherwise(banorte_general_rfc(t)),
        "concepto_original": kinds(clean(found(t, I + r"\bCONCEPTO\s*:\s*(.*?)\s+REFERENCIA\s*:")), clean(found(t, I + r"\)\s*,\s*(.*?)\s+CVE\s+RASTREO\s*:"))),
        "referencia": kinds(clean(found(t, I + r"\bREFERENCIA\s*:\s*(.*?)\s+CVE\s+RAST\s*:")), found(word_text(line_of(c, 0, lines)), I + r"\bORDEN\s+DE\s+PAGO\s+SPEI\s+([A-Z0-9]+)\s*=?\s*REFERENCIA\b")),
    }


