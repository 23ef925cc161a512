"""The third layout's summary: a section of labelled lines on the first page, amounts at its right edge."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reconcilia.functions import money as m
from reconcilia.functions.text import word_text
from reconcilia.operators.fields import SUMMARY, files_of, summary_type
from reconcilia.operators.lines import fixed_mean_lines, joined_texts
from reconcilia.sources.layouts import LABELS

# Where the section and its amounts stand.
HEADER_TOP, HEADER_BOTTOM, SECTION_TOP = (240.0, 252.0), 258.0, 258.0
AMOUNT_X1 = (252.0, 262.0)
AHEAD = 5


def summary_lines(words: DataFrame) -> DataFrame:
    """Lines of the section: upper text, amount (right-most in the band), sign, days, rate."""
    first = fixed_mean_lines(words.where("page = 1").repartition("file_id"))  # pages, lines and files are grouped where this puts them
    # columns of their own, so that each word is cleaned once
    first = first.withColumn("clean", word_text(F.col("text"))).withColumn("rate", F.when(F.col("clean").endswith("%"), m.percent(F.col("clean"))))
    text = F.col("clean")
    amount = F.max(F.when(F.col("x1").between(*AMOUNT_X1) & text.rlike(m.BANORTE_SUMMARY), F.struct("x1", "seq", F.col("text").alias("t"))))
    mark = F.when(text.startswith("+"), 1).when(text.startswith("-"), -1)
    number = F.when(text.rlike(r"^\d+$"), text.try_cast("int"))
    lines = first.groupBy("file_id", "page", "line_no").agg(
        F.upper(joined_texts(text=text)).alias("line"), F.min("top").alias("top"), F.max("bottom").alias("bottom"), m.in_parentheses(amount["t"], True).alias("amount"), amount.isNotNull().alias("has_amount"),
        F.coalesce(F.min_by(mark, F.when(mark.isNotNull(), F.struct("x0", "seq"))), F.lit(0)).alias("sign"),
        F.min_by(number, F.when(number.between(1, 366), F.struct("x0", "seq"))).alias("days"), F.min_by("rate", F.when(F.col("rate").isNotNull(), F.struct("x0", "seq"))).alias("rate"),
    ).withColumn("amount", F.when(F.col("has_amount"), F.col("amount")))
    has = lambda *w: F.lit(True) if not w else F.contains("line", F.lit(w[0])) & has(*w[1:])
    file = Window.partitionBy("file_id")
    header = F.min(F.when(F.col("top").between(*HEADER_TOP) & (F.col("bottom") <= HEADER_BOTTOM), F.col("line_no"))).over(file)
    lines = lines.withColumn("_h", header)
    start = F.min(F.when((F.col("line_no") > F.col("_h")) & (F.col("top") >= SECTION_TOP) & has("RESUMEN", "PERIODO"), F.col("line_no"))).over(file)
    lines = lines.withColumn("_s", start).where("line_no >= _s")
    end = F.min(F.when(has("TOTAL DE USOS"), F.col("line_no"))).over(file)
    return lines.withColumn("_e", end).where("_e IS NULL OR line_no <= _e").drop("_h", "_s", "_e")


def fits(alternatives: list[str]) -> Column:
    """Whether a line has all words of one of them."""
    every = (reduce(and_, (F.contains("line", F.lit(w)) for w in a.split())) for a in alternatives)
    return reduce(or_, every)


def with_average(lines: DataFrame) -> DataFrame:
    """``lines`` with average: what a line SALDO PROMEDIO says, its own amount or one of the next five lines', past the minimum's."""
    has = lambda *w: F.lit(True) if not w else F.contains("line", F.lit(w[0])) & has(*w[1:])
    order = Window.partitionBy("file_id").orderBy("line_no")
    usable = F.when(F.col("has_amount") & ~(F.contains("line", F.lit("SALDO PROMEDIO")) & F.contains("line", F.lit("MÍNIMO"))), F.col("amount"))
    ahead = F.first(usable, True).over(order.rowsBetween(1, AHEAD))
    return lines.withColumn("average", F.when(has("SALDO", "PROMEDIO") & ~has("MÍNIMO"), F.coalesce("amount", ahead)))


def banorte_summary(words: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """The sixteen fields; files without the section get nulls. A file's lines meet once: the first line of each label, days, rate and average come from one grouping."""
    lines = with_average(summary_lines(words))
    has = lambda w: F.contains("line", F.lit(w))
    first = lambda value, where: F.min_by(value, F.when(where, F.col("line_no")))
    each = [first(c, fits(a)).alias(f"{f}_{c[0] if c == 'sign' else 'v'}") for f, a in LABELS.items() for c in ("amount", "sign")]
    found = lines.groupBy("file_id").agg(
        *each, first("days", has("DÍAS") & F.col("days").isNotNull()).alias("dias_periodo"), first("rate", has("TASA") & has("BRUTA") & has("ANUAL") & F.col("rate").isNotNull()).alias("tasa"),
        first("average", F.col("average").isNotNull()).alias("saldo_promedio"),
    )
    out = files_of(words, files).join(found, "file_id", "left")
    v = lambda f: F.col(f"{f}_v")
    parts = {f: m.signed(F.col(f"{f}_s"), v(f)) for f in ("comisiones_cobradas_pagadas", "intereses_cobrados_pagados")}
    plus = lambda base, other, side: v(base) + F.coalesce(v(other), m.zero()) + sum(p[side] for p in parts.values())
    values: dict[str, Column] = {
        "saldo_promedio": F.col("saldo_promedio"), "dias_periodo": F.col("dias_periodo"), "tasa_bruta_anual": F.col("tasa"), "intereses_a_favor": v("intereses_a_favor"),
        "isr_retenido": v("isr_retenido"), "manejo_cuenta": v("manejo_cuenta"), "saldo_anterior": v("saldo_anterior"),
        "depositos_abonos": plus("total_depositos", "intereses_a_favor", 0), "retiros_cargos": plus("total_retiros", "iva_sobre_comisiones", 1),
        "saldo_final": v("saldo_final"), "saldo_promedio_minimo_mensual": v("saldo_promedio_minimo"),
    }
    return out.select("file_id", *(values.get(f, F.lit(None)).cast(summary_type(f)).alias(f) for f in SUMMARY))
