"""Layouts as data: banks, field boxes, table columns, labels, anchors, variants and reading rules, a row each.

The rows of a layout stand in a folder of CSV files. Those of the known banks come with the package; a further bank is a
further folder, anywhere that Spark reads, and no code: ``BUILT_IN.plus(read(spark, path))``. Layouts are fixed and small, whatever the statements, so joins broadcast them.

| file | a row for each |
|---|---|
| banks | bank: name, account-number prefix, whether it is read |
| boxes | field: section, page, box, how words belong to it (center: closed, overlap: strict, band: overlap across and top inside; none: never), slack, whether it moves with the anchor, how it is read (``fields.READINGS``), whether only the first row counts, what stands for a missing value |
| columns | role of a table column in a variant, and its bounds |
| labels | words of a labelled line |
| anchors | words that tell where a section's boxes stand, and the tops of both variants |
| variants | word and place that tell a document's variant; the first variant in ``columns`` is the default |
| rules | bank: trimming, lines, segmentation, amounts, what isn't a movement, enrichment; lists are separated by | |
"""

from __future__ import annotations

import csv
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = {
    "banks": "bank_key string, display_name string, prefix string, supported boolean",
    "boxes": "bank_key string, section string, field string, page int, xmin double, xmax double, ymin double, ymax double, mode string, shift boolean, dx double, dy double, reading string, first_row boolean, missing string",
    "columns": "bank_key string, variant string, role string, xmin double, xmax double",
    "labels": "bank_key string, field string, words string",
    "anchors": "bank_key string, section string, words string, normal double, premium double",
    "variants": "bank_key string, variant string, word string, xmin double, xmax double",
    "rules": "bank_key string, trim string, drop_from double, drop_to double, below double, line_rule string, first_page int, text_rule string, start string, slack double, concept_by string, amounts string, money string, opening string, skip string, titles string, titles_least int, titles_columns boolean, drop_empty string, kind string, fields string, value_balance string, summary string",
}
CASTS = {"string": str, "double": float, "int": int, "boolean": lambda v: v == "true"}
#: Roles of a table's columns.
ROLES = ["fecha_operacion", "fecha_liquidacion", "concepto", "cargo", "abono", "saldo_operacion", "saldo_liquidacion", "referencia_label", "referencia_value"]


def typed(name: str, row: dict[str, str | None]) -> dict:
    """A row of a file with its types; empty is null."""
    kinds = (c.split() for c in FILES[name].split(", "))
    return {c: CASTS[kind](row[c]) if row.get(c) not in (None, "") else None for c, kind in kinds}


@dataclass(frozen=True)
class Layouts:
    rows: dict[str, list[dict]]

    def plus(self, other: Layouts) -> Layouts:
        """Both; a bank that ``other`` has rows for takes all of its rows from there."""
        theirs = {r["bank_key"] for rows in other.rows.values() for r in rows}
        return Layouts({n: [r for r in self.rows[n] if r["bank_key"] not in theirs] + other.rows[n] for n in FILES})

    def only(self, banks: list[str]) -> Layouts:
        """The rows of some banks, so that plans hold nothing that others need."""
        return Layouts({n: [r for r in rows if r["bank_key"] in banks] for n, rows in self.rows.items()})

    def frame(self, spark: SparkSession, name: str) -> DataFrame:
        columns = [c.split()[0] for c in FILES[name].split(", ")]
        return spark.createDataFrame([tuple(r[c] for c in columns) for r in self.rows[name]], FILES[name])

    def known(self) -> list[str]:
        """Banks that are read: supported, with rules."""
        ruled = {r["bank_key"] for r in self.rows["rules"]}
        return [b["bank_key"] for b in self.rows["banks"] if b["supported"] and b["bank_key"] in ruled]

    def banks_where(self, **values: str) -> list[str]:
        """Banks whose rules have these values."""
        return [r["bank_key"] for r in self.rows["rules"] if all(r[k] == v for k, v in values.items())]

    def fields(self, bank: str, section: str) -> list[str]:
        return [r["field"] for r in self.rows["boxes"] if (r["bank_key"], r["section"]) == (bank, section)]

    def last_pages(self) -> dict[str, int]:
        """The last page of each bank on which a field stands; labels, anchors and variants are on the first."""
        named = {r["bank_key"]: 1 for rows in self.rows.values() for r in rows}
        return named | {b: max(r["page"] for r in self.rows["boxes"] if r["bank_key"] == b and r["mode"] != "none") for b in named if any(r["bank_key"] == b and r["mode"] != "none" for r in self.rows["boxes"])}

    def bounds(self, spark: SparkSession) -> DataFrame:
        """bank_key, variant and a struct (xmin, xmax) for each role, null where a table has no such column."""
        made = self.frame(spark, "columns").groupBy("bank_key", "variant").pivot("role", ROLES).agg(F.first(F.struct("xmin", "xmax")))
        return made.select("bank_key", "variant", *ROLES)

    def default_variants(self) -> dict[str, str]:
        out: dict[str, str] = {}
        for r in self.rows["columns"]:
            out.setdefault(r["bank_key"], r["variant"])
        return out

    def bounds_columns(self, bank: str) -> dict[str, Column]:
        """Each table column's (xmin, xmax) struct in a bank's default variant."""
        mine = [r for r in self.rows["columns"] if (r["bank_key"], r["variant"]) == (bank, self.default_variants()[bank])]
        return {r["role"]: F.struct(F.lit(r["xmin"]).alias("xmin"), F.lit(r["xmax"]).alias("xmax")) for r in mine}


@lru_cache
def packaged(name: str) -> Layouts:
    """The rows of a folder that comes with the package."""
    folder = Path(__file__).parent / "data" / name
    files = {n: list(csv.DictReader((folder / f"{n}.csv").open(encoding="utf-8"))) if (folder / f"{n}.csv").exists() else [] for n in FILES}
    return Layouts({n: [typed(n, r) for r in rows] for n, rows in files.items()})


def read(spark: SparkSession, path: str) -> Layouts:
    """The rows of a folder that Spark reads; files may be missing."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    rows: dict[str, list[dict]] = {n: [] for n in FILES}
    for n in FILES:
        at = there(f"{path}/{n}.csv")
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            rows[n] = [typed(n, r.asDict()) for r in spark.read.option("header", True).option("escape", '"').csv(f"{path}/{n}.csv").collect()]
    return Layouts(rows)


BUILT_IN = packaged("builtin")
#: Boxes of each (bank, section) of the known banks.
BOXES: dict[tuple[str, str], list[dict]] = {}
for _row in BUILT_IN.rows["boxes"]:
    if _row["mode"] != "none":
        BOXES.setdefault((_row["bank_key"], _row["section"]), []).append(_row)
#: Alternatives of each label; every word of one must occur in the line.
LABELS: dict[str, list[str]] = {}
for _row in BUILT_IN.rows["labels"]:
    LABELS.setdefault(_row["field"], []).append(_row["words"])


def banks(spark: SparkSession, layouts: Layouts = BUILT_IN) -> DataFrame:
    return layouts.frame(spark, "banks")


def field_boxes(spark: SparkSession, bank: str, section: str, layouts: Layouts = BUILT_IN) -> DataFrame:
    return layouts.frame(spark, "boxes").where((F.col("bank_key") == bank) & (F.col("section") == section))
