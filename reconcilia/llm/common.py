"""Helpers that several training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reconcilia.storage import saved

#: A word: a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: What ``bytes.translate`` needs to lower-case A-Z and nothing else.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


__all__ = ["CRC_SQL", "HOT_KEYS", "LOWER", "WORD", "arrow_rows", "attach", "columns_of", "crc_sql", "fresh", "marked", "maybe_among", "saved", "table", "without"]


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Inside, at most so many rows (fewer where the session says so) go to a Python worker at a time: for rows that are large, and jobs that run inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns_of(df: DataFrame, *names: str) -> list[Column]:
    """Columns by name, whatever characters the names hold."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


#: Keys that hold more rows than the limit below are joined by broadcast. As group sizes add up to
#: the row count, at most this many keys can be above rows / HOT_KEYS.
HOT_KEYS = 50_000


def attach(rows: DataFrame, groups: DataFrame, key: Sequence[str], size: str) -> DataFrame:
    """Inner join of ``rows`` with one ``groups`` row for each key, where a few keys may hold most rows.

    ``size`` is the groups' column of row counts. Keys over ``max(256, rows / HOT_KEYS)`` rows number
    at most HOT_KEYS, whatever the data, so they are broadcast: a few MB, as a row of ``groups`` holds hashes,
    ids and counts, never a text. The rest is a shuffled join in which no key is large. Both inputs should be saved tables, as each is read twice.
    """
    key = list(key)
    total = groups.agg(F.sum(size)).first()[0] or 0
    limit = max(256, total // HOT_KEYS)
    hot = F.broadcast(groups.where(F.col(size) > limit))
    cold = groups.where(F.col(size) <= limit)
    return rows.join(hot, key).unionByName(rows.join(hot.select(*key), key, "left_anti").join(cold, key))


#: Bits of the bitmap below; it is 2 MB, whatever the data.
BITMAP_BITS = 24


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them where ``df`` has such columns already."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name = "_" + name
        out.append(name)
    return out


def marked(rows: DataFrame, column: str, keys: DataFrame, name: str) -> DataFrame:
    """``rows`` with ``name``: false only where ``column`` is not among the values of ``keys`` (one column).

    The values' hashes go into a bitmap of fixed size, so it can be broadcast; with far more values than
    bits everything is marked.
    """
    part, bit, bits = fresh(rows, "_part", "_bit", "_map")
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << BITMAP_BITS))
    part_of, bit_of = (lambda c: F.shiftright(place(c), 15)), (lambda c: F.pmod(place(c), F.lit(1 << 15)))
    key, mine = columns_of(keys, *keys.columns)[0], columns_of(rows, column)[0]
    maps = keys.select(part_of(key).alias(part), bit_of(key).alias(bit)).groupBy(part).agg(F.bitmap_construct_agg(bit).alias(bits))
    met = rows.withColumns({part: part_of(mine), bit: bit_of(mine)}).join(F.broadcast(maps), part, "left")
    byte = F.conv(F.hex(F.substring(F.col(bits), F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(F.call_function("getbit", byte, F.pmod(F.col(bit), F.lit(8)).cast("int")) == 1, F.lit(False))
    return met.withColumn(name, found).drop(part, bit, bits)


def maybe_among(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """``rows`` without most of those whose ``column`` is not among ``keys``: a filter before a join, which drops no partner."""
    (flag,) = fresh(rows, "_maybe")
    return marked(rows, column, keys, flag).where(flag).drop(flag)


def without(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """``rows`` whose ``column`` is not among ``keys``; only rows that may be among them are dealt out. Nulls stay."""
    flag, other = fresh(rows, "_maybe", "_key")
    some = marked(rows, column, keys, flag)
    doubtful = some.where(flag).drop(flag)
    left = doubtful.join(keys.select(columns_of(keys, *keys.columns)[0].alias(other)), columns_of(rows, column)[0] == F.col(other), "left_anti")
    return some.where(~F.col(flag)).drop(flag).unionByName(left)


#: CRC-32 in SQL: a table of 256 values by its rule, and a fold over a text's bytes.
CRC_SQL = """crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""


def crc_sql(text: str) -> str:
    """SQL of the unsigned CRC-32 of a text's UTF-8 bytes, where crc_table is joined."""
    octets = f"list_transform(range(length(hex(encode({text}))) // 2), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"
