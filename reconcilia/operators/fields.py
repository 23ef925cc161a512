"""Field values from boxes: one broadcast join of words and the boxes of all banks, one grouping, one pivot.

How a field is read is a value in its box's row, looked up in ``READINGS``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reconcilia.functions import money as m
from reconcilia.functions import text as t
from reconcilia.functions.dates import slashed_date
from reconcilia.operators.lines import center_x, center_y
from reconcilia.sources import layouts
from reconcilia.sources.layouts import BUILT_IN, Layouts

ANCHOR_TOLERANCE = 2.0
FIRST_ROW = 1.5
#: Sections whose boxes move with an anchor.
MOVING = ("resumen", "productos")


def anchor_shifts(words: DataFrame, anchors: DataFrame) -> DataFrame:
    """file_id, section, shift_y: 0 with the normal anchor, the difference with the other one only; files without an anchor have no row."""
    a = F.broadcast(anchors.select("section", "normal", "premium", F.split("words", r"\|").alias("_names"), F.col("bank_key").alias("_bank")))
    met = words.where("page = 1").join(a, (F.col("bank_key") == F.col("_bank")) & F.array_contains("_names", F.lower(F.trim("text"))))
    near = lambda top: F.coalesce(F.bool_or(F.abs(F.col("top") - F.col(top)) <= ANCHOR_TOLERANCE), F.lit(False))
    return met.groupBy("file_id", "section").agg(F.when(near("normal"), 0.0).when(near("premium"), F.first(F.col("premium") - F.col("normal"))).otherwise(0.0).alias("shift_y"))


def layout_shift(words: DataFrame, section: str, bank: str = "bbva", known: Layouts = BUILT_IN) -> DataFrame:
    """file_id, shift_y of every file in ``words``."""
    anchors = known.frame(words.sparkSession, "anchors").where(F.col("section") == section)
    found = anchor_shifts(words.withColumn("bank_key", F.lit(bank)), anchors).select("file_id", "shift_y")
    return words.select("file_id").distinct().join(found, "file_id", "left").withColumn("shift_y", F.coalesce("shift_y", F.lit(0.0)))


def words_in_boxes(words: DataFrame, boxes: DataFrame, shifts: DataFrame | None = None) -> DataFrame:
    """Words with the field of every box they are in; a word may be in several.

    ``words`` with bank_key meet their bank's boxes, others all. ``shifts``: file_id, section, shift_y; sections move by them where a box says so.
    """
    b = boxes.withColumnsRenamed({"page": "box_page", "shift": "box_shift", "bank_key": "box_bank"})
    left = words
    if shifts is not None:
        moved = shifts.groupBy("file_id").pivot("section", list(MOVING)).agg(F.first("shift_y")).withColumnsRenamed({s: f"_{s}" for s in MOVING})
        left = words.join(moved, "file_id", "left")
        own = F.coalesce(*(F.when(F.col("section") == s, F.col(f"_{s}")) for s in MOVING), F.lit(0.0))
    else:
        own = F.lit(0.0)
    move = F.when(F.col("box_shift"), own).otherwise(0.0)
    low, high = F.col("ymin") + move, F.col("ymax") + move
    cx, cy = center_x(), center_y()
    centre = cx.between(F.col("xmin") - F.col("dx"), F.col("xmax") + F.col("dx")) & cy.between(low - F.col("dy"), high + F.col("dy"))
    overlap = (F.col("x0") < F.col("xmax")) & (F.col("x1") > F.col("xmin")) & (F.col("top") < high) & (F.col("bottom") > low)
    band = (F.least("x1", F.col("xmax") + F.col("dx")) > F.greatest("x0", F.col("xmin") - F.col("dx"))) & F.col("top").between(low - F.col("dy"), high + F.col("dy"))
    inside = ((F.col("mode") == "center") & centre) | ((F.col("mode") == "overlap") & overlap) | ((F.col("mode") == "band") & band)
    same = (F.col("bank_key") == F.col("box_bank")) if "bank_key" in words.columns else F.lit(True)
    met = left.join(F.broadcast(b), same & (F.col("page") == F.col("box_page")) & inside)
    return met.withColumn("_distance", F.sqrt(F.pow(cx - (F.col("xmin") + F.col("xmax")) / 2, 2) + F.pow(cy - (low + high) / 2, 2))).drop(*(f"_{s}" for s in MOVING))


def _texts(words: Column, each: Callable[[Column], Column] = F.trim, separator: str = " ", where: Callable[[Column], Column] | None = None) -> Column:
    """Texts of a box's words in reading order, joined; null if there are none."""
    some = F.filter(words, where) if where else words
    return F.nullif(F.array_join(F.filter(F.transform(some, lambda w: each(w["text"])), lambda x: x != ""), separator), F.lit(""))


def _digit_words(words: Column) -> Column:
    return _texts(words, lambda x: x, "", lambda w: w["text"].rlike(r"^\d+$"))


def _digits(words: Column) -> Column:
    return _texts(words, t.digits, "")


def _nearest(words: Column, fits: Callable[[Column], Column]) -> Column:
    """The fitting word nearest to the box's centre; of ties the first in reading order."""
    return F.array_min(F.transform(F.filter(words, lambda w: fits(w["text"])), lambda w: F.struct(w["distance"], w["top"], w["x0"], w["seq"], w["text"])))["text"]


#: Ways to read a box's words, as texts: what a row of ``boxes`` may name.
READINGS: dict[str, Callable[[Column], Column]] = {
    "text": _texts,
    "collapsed": lambda w: t.collapsed_or_null(_texts(w)),
    "digit_words": _digit_words,
    "digits": lambda w: t.digits_or_null(_digits(w)),
    "clabe": lambda w: t.clabe_or_null(_texts(w)),
    "digits_clabe": lambda w: t.clabe_or_null(_digits(w)),
    "rfc_compact": lambda w: t.rfc_compact(_texts(w)),
    "rfc_labelled": lambda w: t.rfc_labelled(_texts(w)),
    "slashed_date": lambda w: slashed_date(_texts(w)),
    "amount": lambda w: m.spaced_or_null(_texts(w)).cast("string"),
    "whole": lambda w: F.translate(_texts(w), ", ", "").try_cast("double").cast("int").cast("string"),
    "rate": lambda w: F.translate(_texts(w), ", ", "").try_cast("double").cast("string"),
    "first_amount": lambda w: m.number(F.replace(F.get(F.filter(F.transform(w, lambda x: F.trim(x["text"])), lambda x: x.rlike(m.BBVA_GLOBAL)), 0), F.lit(","), F.lit(""))).cast("string"),
    "nearest_amount": lambda w: m.optional(_nearest(w, lambda x: m.is_amount(x, m.BANAMEX_SUMMARY))).cast("string"),
    "nearest_integer": lambda w: m.optional_whole(_nearest(w, lambda x: t.word_text(x).rlike(m.SHORT_INTEGER))).cast("string"),
}


def box_words(hits: DataFrame, *keys: str) -> DataFrame:
    """file_id, ``keys``, field, _words: the words of each box in reading order, only its first row where the box says so."""
    word = F.struct("page", "top", "x0", "seq", "text", F.col("_distance").alias("distance"))
    made = hits.withColumn("_word", word).groupBy("file_id", *keys, "field").agg(F.sort_array(F.collect_list("_word")).alias("_words"), F.first("reading").alias("reading"), F.first("first_row").alias("first_row"))
    first = F.array_min(F.transform("_words", lambda w: w["top"]))
    return made.withColumn("_words", F.when(F.col("first_row"), F.filter("_words", lambda w: w["top"] - first <= FIRST_ROW)).otherwise(F.col("_words")))


def box_values(hits: DataFrame) -> DataFrame:
    """file_id, field, text, digits."""
    return box_words(hits).select("file_id", "field", _texts(F.col("_words")).alias("text"), _digits(F.col("_words")).alias("digits"))


def first_rows(hits: DataFrame, tolerance: float = FIRST_ROW) -> DataFrame:
    """Only the words of each box's first row."""
    tops = hits.groupBy("file_id", "field").agg(F.min("top").alias("_first"))
    return hits.join(tops, ["file_id", "field"]).where(F.col("top") - F.col("_first") <= tolerance).drop("_first")


def front(words: DataFrame, known: Layouts = BUILT_IN) -> DataFrame:
    """The words (with bank_key) of the pages on which their bank's layout has fields: all that any section or summary reads."""
    return words.where(reduce(or_, ((F.col("bank_key") == b) & (F.col("page") <= last) for b, last in known.last_pages().items())))


def files_of(words: DataFrame, files: DataFrame | None) -> DataFrame:
    """The files that get a row: those given, else all that have words."""
    return words.select("file_id").distinct() if files is None else files


ACCOUNT = ["producto_principal", "periodo_inicio", "periodo_fin", "fecha_corte", "numero_cuenta", "numero_cliente", "rfc", "clabe", "nombre_cliente"]

SUMMARY = [
    "saldo_promedio", "dias_periodo", "tasa_bruta_anual", "saldo_promedio_gravable", "intereses_a_favor", "isr_retenido", "cheques_pagados", "manejo_cuenta",
    "cargos_objetados", "abonos_objetados", "saldo_anterior", "depositos_abonos", "retiros_cargos", "saldo_final", "saldo_promedio_minimo_mensual", "saldo_global",
]


def summary_type(field: str) -> str:
    """Whole numbers for days and cheques, a rate with all its decimals, else money."""
    return {"dias_periodo": "int", "cheques_pagados": "int", "tasa_bruta_anual": "double"}.get(field, m.MONEY)


PRODUCTS = ["contrato", "producto", "tasa_interes_anual", "gat_nominal_anual", "gat_real_anual", "total_comisiones"]
SECTIONS = {"datos": ACCOUNT, "resumen": SUMMARY, "productos": PRODUCTS}


def sections(words: DataFrame, files: DataFrame, known: Layouts = BUILT_IN, wanted: tuple[str, ...] = tuple(SECTIONS)) -> DataFrame:
    """file_id, bank_key and a text ``section_field`` for each field of the wanted sections, for files of all banks at once.

    ``words`` and ``files`` have bank_key. What a file doesn't print is what its layout puts for missing values, null by default.
    """
    spark = words.sparkSession
    boxes = known.frame(spark, "boxes").where(F.col("section").isin(*wanted))
    anchors = known.frame(spark, "anchors").where(F.col("section").isin(*wanted))
    moving = any(r["section"] in wanted for r in known.rows["anchors"])
    hits = words_in_boxes(front(words, known), boxes.where("mode <> 'none'"), anchor_shifts(words, anchors) if moving else None)
    named = {r["reading"] for r in known.rows["boxes"] if r["section"] in wanted}
    read = F.coalesce(*(F.when(F.col("reading") == name, f(F.col("_words"))) for name, f in READINGS.items() if name in named))
    values = box_words(hits, "section").select("file_id", F.concat_ws("_", "section", "field").alias("_name"), read.alias("value"))
    names = [f"{s}_{f}" for s in wanted for f in SECTIONS[s]]
    found = files.join(values.groupBy("file_id").pivot("_name", names).agg(F.first("value")), "file_id", "left")
    default = boxes.where("missing IS NOT NULL").groupBy("bank_key").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("_", "section", "field"), "missing"))).alias("_default"))
    out = found.join(F.broadcast(default), "bank_key", "left")
    return out.select("file_id", "bank_key", *(F.coalesce(n, F.try_element_at("_default", F.lit(n))).alias(n) for n in names))


def section(read: DataFrame, name: str) -> DataFrame:
    """file_id and the typed fields of one section."""
    kind = summary_type if name == "resumen" else lambda _: "string"
    return read.select("file_id", *(F.col(f"{name}_{f}").try_cast(kind(f)).alias(f) for f in SECTIONS[name]))


def of_bank(words: DataFrame, bank: str, name: str, files: DataFrame | None = None, known: Layouts = BUILT_IN) -> DataFrame:
    """One section of one bank's statements."""
    mark = lambda df: df.withColumn("bank_key", F.lit(bank))
    return section(sections(mark(words), mark(files_of(words, files).select("file_id")), known.only([bank]), (name,)), name)


def account_data(words: DataFrame, bank: str, files: DataFrame | None = None) -> DataFrame:
    """file_id and the nine account fields, as texts."""
    return of_bank(words, bank, "datos", files)


def bbva_summary(words: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """The sixteen fields; what is missing is 0, but the average balance null."""
    return of_bank(words, "bbva", "resumen", files)


def banamex_summary(words: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Six fields by the valid word nearest to the box's centre; the others are null."""
    return of_bank(words, "banamex", "resumen", files)


def bbva_products(words: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Six fields as texts, null where the box is empty."""
    return of_bank(words, "bbva", "productos", files)


def with_numbers(products: DataFrame) -> DataFrame:
    """``products`` with the numbers in its rates and fee beside their texts; null where there is none."""
    number = lambda c: F.translate(F.trim(c), "$,% ", "").try_cast("decimal(18,6)")
    return products.withColumns({f"{f}_num": number(F.col(f)) for f in PRODUCTS[2:]})


def no_products(words: DataFrame, files: DataFrame | None = None, bank: str = "banamex") -> DataFrame:
    return of_bank(words, bank, "productos", files)
