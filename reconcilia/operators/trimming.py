"""Filters that take headers, footers and trailing sections out of a statement's words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reconcilia.functions import money as m
from reconcilia.functions.dates import LOOSE_PREFIX
from reconcilia.functions.text import header_text, word_text, word_upper
from reconcilia.operators.lines import LEAST_TOLERANCE, LINES, line_rows, middle, number, page_rows, page_tolerance, word_places
from reconcilia.storage import saved

# Terms and places of the layouts.
FOOTER_TERMS = ["BBVA", "MEXICO,", "MEXICO", "R.F.C.", "RFC", "BBA830831LJ2", "GAT"]
FOOTER_TOP, FOOTER_X = 750.0, 50.0
PREMIUM_X, NORMAL_X = (215.0, 225.0), (318.0, 325.0)
HEADER_TERMS = {"FECHA": (30, 70), "SALDO": (510, 550), "OPER": (15, 50), "LIQ": (55, 80), "DESCRIPCION": (80, 150), "REFERENCIA": (215, 275), "CARGOS": (365, 415), "ABONOS": (425, 470), "OPERACION": (470, 535), "LIQUIDACION": (535, 605)}
HEADER_ABOVE, HEADER_SLACK = 15.0, 3.0
END_TERMS = ["TOTAL", "DE", "MOVIMIENTOS"]
MARKER_LINE, MARKER_STEP = 2.0, 60.0
BANAMEX_HEADER = 65.0
BANORTE_FOOTER = 743.0
DATE_X = (45.0, 88.0)


def footer_tops(words: DataFrame) -> DataFrame:
    """file_id, page, footer_top of pages with a footer."""
    term = (F.col("top") >= FOOTER_TOP) & (F.col("x0") < FOOTER_X) & F.upper(F.trim("text")).isin(FOOTER_TERMS)
    return words.where(term).groupBy("file_id", "page").agg(F.min("top").alias("footer_top"))


def without_bbva_footer(words: DataFrame) -> DataFrame:
    out = words.join(footer_tops(words), ["file_id", "page"], "left")
    return out.where(F.col("footer_top").isNull() | (F.col("top") < F.col("footer_top"))).drop("footer_top")


def _reference_word() -> Column:
    return F.upper(F.trim("text")) == "REFERENCIA"


def layout_variant(words: DataFrame, first_page_only: bool) -> DataFrame:
    """file_id, variant by the first word REFERENCIA in reading order that stands at either place; normal if none."""
    at = F.when(F.col("x0").between(*PREMIUM_X), "premium").when(F.col("x0").between(*NORMAL_X), "normal")
    ok = _reference_word() & at.isNotNull() & ((F.col("page") == 1) if first_page_only else F.lit(True))
    return words.groupBy("file_id").agg(F.coalesce(F.min_by(at, F.when(ok, F.col("seq"))), F.lit("normal")).alias("variant"))


def header_ordinals(words: DataFrame) -> DataFrame:
    """file_id, header_page, header_top, ordinal of the premium headers."""
    heads = words.where(_reference_word() & F.col("x0").between(*PREMIUM_X)).select("file_id", F.col("page").alias("header_page"), F.col("top").alias("header_top"))
    return heads.withColumn("ordinal", F.row_number().over(Window.partitionBy("file_id").orderBy("header_page", "header_top")))


def marker_words(words: DataFrame) -> DataFrame:
    """The words that headers and the end marker consist of: a small part of a statement."""
    return words.where(header_text(F.col("text")).isin(*HEADER_TERMS) | F.upper(F.trim("text")).isin("REFERENCIA", *END_TERMS))


def repeated_header_words(marks: DataFrame) -> DataFrame:
    """(file_id, seq) of the words of a premium document's table headers behind its first. ``marks``: its marker words."""
    later = header_ordinals(marks).where("ordinal > 1")
    premium = layout_variant(marks, False).where("variant = 'premium'").select("file_id")
    later = later.join(premium, "file_id", "left_semi").select(F.col("file_id").alias("_f"), "header_page", "header_top")
    known = F.lit(False)
    for term, (a, b) in HEADER_TERMS.items():
        known |= (header_text(F.col("text")) == term) & F.col("x0").between(float(a), float(b))
    near = F.col("top").between(F.col("header_top") - HEADER_ABOVE - HEADER_SLACK, F.col("header_top") + HEADER_SLACK)
    return marks.where(known).join(later, (F.col("file_id") == F.col("_f")) & (F.col("page") == F.col("header_page")) & near).select("file_id", "seq").distinct()


def without_repeated_headers(words: DataFrame) -> DataFrame:
    """Premium documents keep their first table header only."""
    return words.join(repeated_header_words(saved(marker_words(words))), ["file_id", "seq"], "left_anti")


def end_marker(words: DataFrame) -> DataFrame:
    """file_id, cut_page, cut_top: the first TOTAL with DE close behind it and MOVIMIENTOS after that, on one line."""
    mark = words.withColumn("_u", F.upper(F.trim("text"))).where(F.col("_u").isin(*END_TERMS))
    place = F.struct("top", "x0", "seq")
    mark = mark.select("file_id", "page", "_u", F.col("top").alias("_top"), F.col("x0").alias("_x"), place.alias("_p"))
    a, b, c = (mark.where(F.col("_u") == w).alias(n) for w, n in zip(END_TERMS, "abc", strict=True))
    same = lambda x: (F.col("a.file_id") == F.col(f"{x}.file_id")) & (F.col("a.page") == F.col(f"{x}.page")) & (F.abs(F.col(f"{x}._top") - F.col("a._top")) <= MARKER_LINE)
    step = F.col("b._x") - F.col("a._x")
    pairs = a.join(b, same("b") & (F.col("b._p") > F.col("a._p")) & (step > 0) & (step < MARKER_STEP))
    found = pairs.join(c, same("c") & (F.col("c._p") > F.col("b._p")))
    return found.groupBy(F.col("a.file_id").alias("file_id")).agg(F.min(F.struct(F.col("a.page").alias("page"), F.col("a._p").alias("p"))).alias("_c")).select("file_id", F.col("_c.page").alias("cut_page"), F.col("_c.p.top").alias("cut_top"))


def cut_at(words: DataFrame, cut: DataFrame) -> DataFrame:
    """Words before (cut_page, cut_top)."""
    out = words.join(cut, "file_id", "left")
    return out.where(F.col("cut_page").isNull() | (F.struct("page", "top") < F.struct(F.col("cut_page").alias("page"), F.col("cut_top").alias("top")))).drop("cut_page", "cut_top")


def trimmed_bbva(words: DataFrame) -> DataFrame:
    """Without footers, repeated headers and what follows the end marker: cuts come from the marker words, then one pass filters all."""
    plain = words.join(saved(footer_tops(words)), ["file_id", "page"], "left")
    plain = plain.where(F.col("footer_top").isNull() | (F.col("top") < F.col("footer_top"))).drop("footer_top")
    marks = saved(marker_words(plain))
    again = saved(repeated_header_words(marks))
    cut = saved(end_marker(marks.join(again, ["file_id", "seq"], "left_anti")))
    return cut_at(plain.join(again, ["file_id", "seq"], "left_anti"), cut)


def chart_start(words: DataFrame) -> DataFrame:
    """file_id, cut: seq of the first GRÁFICO directly followed by TRANSACCIONAL on its page; only pages with the first word are put in order."""
    name = F.replace(word_upper(F.col("text")), F.lit("Á"), F.lit("A"))
    some = saved(words.where(name == "GRAFICO").select("file_id", "page").distinct())
    order = Window.partitionBy("file_id", "page").orderBy("seq")
    two = words.join(some, ["file_id", "page"], "left_semi").select("file_id", "page", "seq", name.alias("_u"))
    two = two.withColumn("_n", F.lead("_u").over(order))
    return two.where("_u = 'GRAFICO' AND _n = 'TRANSACCIONAL'").groupBy("file_id").agg(F.min("seq").alias("cut"))


def without_chart(words: DataFrame) -> DataFrame:
    out = words.join(chart_start(words), "file_id", "left")
    return out.where(F.col("cut").isNull() | (F.col("seq") < F.col("cut"))).drop("cut")


def without_banamex_header(words: DataFrame) -> DataFrame:
    return words.where(~F.col("top").between(0, BANAMEX_HEADER))


def trimmed_banamex(words: DataFrame) -> DataFrame:
    return without_banamex_header(without_chart(words))


def without_banorte_footer(words: DataFrame) -> DataFrame:
    return words.where(number("top") < BANORTE_FOOTER)


#: What cuts need to know of a word, as bits of its marks: a date and an amount at its start, any text, a section that goes on, the chart's title.
DATED, AMOUNT, FILLED, AGAIN, CHART = 1, 2, 4, 8, 16


def word_marks(text: Column) -> Column:
    """Those bits of a word's clean text. No pattern reaches over a space, so a line has what one of its words has."""
    bits = {DATED: text.rlike(LOOSE_PREFIX), AMOUNT: text.rlike(m.BANORTE), FILLED: text != "", AGAIN: text.rlike(r"(?iU)\bCONTINUACI(?:Ó|O)N\b"), CHART: F.upper(text).rlike("GR[ÁA]FICO")}
    return sum((F.when(v, k).otherwise(0) for k, v in bits.items()), F.lit(0))


def marked_pages(words: DataFrame) -> DataFrame:
    """Page rows with marks."""
    cleaned = words.withColumn("_clean", word_text(F.col("text")))
    return page_rows(cleaned, clean=F.col("_clean"), marks=word_marks(F.col("_clean")))


def section_lines(pages: DataFrame) -> DataFrame:
    """Lines with what decides where a statement's last section starts. ``pages``: page rows with marks, from which each line takes least, greatest and any."""
    fields = {c: F.col(f"words.{c}") for c in ("x0", "x1", "top", "bottom", "doctop", "marks")}
    placed = pages.select("file_id", "page", *(v.alias(c) for c, v in fields.items())).withColumn("place", word_places("doctop", "top", "bottom", F.lit(LEAST_TOLERANCE), F.lit(True)))
    bounds = [F.array_min("x0").alias("page_xmin"), F.array_max("x1").alias("page_xmax")]
    words = placed.select("file_id", "page", *bounds, F.inline(F.arrays_zip("place", "x0", "x1", "doctop", "marks")))
    has = lambda bit: F.col("marks").bitwiseAND(bit) > 0
    lines = words.groupBy("file_id", "page", "place").agg(
        F.first("page_xmin").alias("page_xmin"), F.first("page_xmax").alias("page_xmax"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("doctop").alias("doctop"), F.max("doctop").alias("doctop_max"),
        F.bool_or(has(DATED) & F.col("x0").between(*DATE_X)).alias("is_date"), F.bit_or("marks").alias("marks"),
    ).withColumns({"line_no": F.col("page").cast("long") * LINES + F.col("place"), "text_only": has(FILLED) & ~has(DATED) & ~has(AMOUNT)})
    width, page = F.col("x1") - F.col("x0"), F.col("page_xmax") - F.col("page_xmin")
    off = F.abs((F.col("x0") + F.col("x1")) / 2 - (F.col("page_xmin") + F.col("page_xmax")) / 2)
    lines = lines.withColumns({
        "is_continuation": has(AGAIN),
        "is_centered": F.col("text_only") & (page > 0) & (width <= page * 0.35) & (off <= page * 0.15) & (F.col("x0") >= F.col("page_xmin") + page * 0.30),
        "is_plain": F.col("text_only") & (page > 0) & (F.col("x0") <= F.col("page_xmin") + F.greatest(F.lit(7.0), page * 0.025)) & (width <= page * 0.90),
    })
    return lines.select("file_id", "page", "line_no", "doctop", "doctop_max", "is_date", "is_continuation", "is_centered", "is_plain")


def passed_over(lines: DataFrame) -> DataFrame:
    """``lines`` with skipped: a line that continues a section makes the next line of its page be passed over.

    A passed-over line has no such effect, so a line is passed over if the run of continuing lines right before it is odd.
    """
    page = Window.partitionBy("file_id", "page").orderBy("line_no")
    out = lines.withColumns({"_again": ~F.col("is_date") & F.col("is_continuation"), "_row": F.row_number().over(page)})
    other = F.max(F.when(~F.col("_again"), F.col("_row"))).over(page.rowsBetween(Window.unboundedPreceding, -1))
    return out.withColumn("skipped", (F.col("_row") - 1 - F.coalesce(other, F.lit(0))) % 2 == 1).drop("_again", "_row")


def section_cutoff(lines: DataFrame) -> DataFrame:
    """file_id, centered, plain: where the last section starts.

    centered: doctop of the first centred line behind any movement date. plain: doctop of the first of two close
    plain-text lines of a page behind the last movement date. Null where there is none.
    """
    page = Window.partitionBy("file_id", "page").orderBy("line_no")
    lines = saved(passed_over(lines).withColumns({f"next_{c}": F.lead(c).over(page) for c in ("is_plain", "doctop")}))
    dates = lines.where("is_date").groupBy("file_id").agg(F.min(F.when(~F.col("skipped"), F.col("line_no"))).alias("first_date"), F.max_by("doctop_max", "line_no").alias("last_date"))
    both = lines.join(dates, "file_id")
    centred = ~F.col("skipped") & ~F.col("is_date") & ~F.col("is_continuation") & F.col("is_centered") & (F.col("line_no") > F.col("first_date"))
    close = F.col("is_plain") & F.col("next_is_plain") & (F.col("next_doctop") - F.col("doctop") <= 28.0) & (F.col("doctop") > F.col("last_date"))
    return both.groupBy("file_id").agg(F.min_by("doctop", F.when(centred, F.col("line_no"))).alias("centered"), F.min_by("doctop", F.when(close, F.col("line_no"))).alias("plain"))


def section_cut(pages: DataFrame) -> DataFrame:
    """file_id, cut (a doctop): the centred cutoff, else the plain-text one. ``pages``: saved page rows."""
    return section_cutoff(section_lines(pages)).select("file_id", F.coalesce("centered", "plain").alias("cut")).where("cut IS NOT NULL")


def without_last_section(words: DataFrame) -> DataFrame:
    """Words before the centred cutoff, else before the plain-text one, else all."""
    out = words.join(saved(section_cut(marked_pages(words))), "file_id", "left")
    return out.where(F.col("cut").isNull() | (number("doctop") < F.col("cut"))).drop("cut")


def marker_line(words: DataFrame) -> DataFrame:
    """file_id, cut_page, cut_top of the first line that says GRÁFICO TRANSACCIONAL."""
    return marker_cut(saved(marker_rows(marked_pages(words))))


def marker_rows(pages: DataFrame) -> DataFrame:
    """Page rows with no more of each word than lines and their cleaned texts need."""
    return pages.select("file_id", "page", F.transform("words", lambda w: F.struct(*(w[c].alias(c) for c in ("x0", "seq", "top", "bottom", "clean", "marks")))).alias("words"))


def marker_cut(pages: DataFrame) -> DataFrame:
    """The same from page rows with marks; only pages with the first word are cut into lines, and only those meet their file's tolerance."""
    some = marker_rows(pages.where(F.exists("words.marks", lambda x: x.bitwiseAND(CHART) > 0)))
    lines = line_rows(some.join(page_tolerance(pages), "file_id"), middle, middle, F.col("tolerance"), F.lit(True))
    said = F.array_join(F.filter(F.transform("words", lambda w: w["clean"]), lambda x: x != ""), " ")
    hit = lines.where(F.upper(said).rlike("GR[ÁA]FICO TRANSACCIONAL")).withColumn("top", F.get("words", 0)["top"])
    return hit.groupBy("file_id").agg(F.min_by(F.struct("page", "top"), "line_no").alias("_c")).select("file_id", F.col("_c.page").alias("cut_page"), F.col("_c.top").alias("cut_top"))


def cut_pages(pages: DataFrame) -> DataFrame:
    """Page rows (saved, with marks) without the last section and what follows the chart's title; pages that lose all of their words go."""
    cut = saved(section_cut(pages))
    kept = pages.join(cut, "file_id", "left")
    kept = kept.withColumn("words", F.filter("words", lambda w: F.col("cut").isNull() | (w["doctop"] < F.col("cut")))).drop("cut").where(F.size("words") > 0)
    kept = kept.join(saved(marker_cut(kept)), "file_id", "left")
    before = lambda w: F.col("cut_page").isNull() | (F.col("page") < F.col("cut_page")) | ((F.col("page") == F.col("cut_page")) & (w["top"] < F.col("cut_top")))
    return kept.withColumn("words", F.filter("words", before)).drop("cut_page", "cut_top").where(F.size("words") > 0)
