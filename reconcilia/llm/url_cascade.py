"""URL rules by a cascade of Bloom filters.

A rule is a host and the beginning of a path, allowed or blocked; it fits its host and all subdomains, and of
several that fit a URL the longest (host and path together; then the longer host) decides. A URL's candidate keys are
the suffixes of its host, cut at dots, each with a beginning of its path, where only lengths that some rule has are
taken. All candidates of all URLs are the key universe of the corpus.

Level 1 of a cascade encodes the listed keys. The keys of the universe that pass it without being listed are its false
positives, which level 2 encodes; level 3 encodes the listed keys that pass level 2, and so on until none is left. So the first
level that a key doesn't pass tells whether it is listed, exactly, for every key of the universe. The corpus is read
once for its universe; looking up a URL needs no join and no list, only the filters, which are broadcast. Blocked and allowed keys
have a cascade each; a key listed as both is blocked.

Level 1 passes about (listed / (sqrt(2) * universe)) of what isn't listed, the other levels a half, so a cascade's size is
known before it is built: some log2(universe / listed) + 4 bits for each listed key. Beyond ``LIMIT`` bytes rules are joined instead.

Nulls and texts without ``://`` have an empty host and path, and a path that doesn't start with a rule's fits none. URLs that no
rule fits get ``otherwise``. Rules with a null host, path or verdict are no rules; a rule's host is lower-cased (A-Z), and its path
starts with a slash. Repeated rows get equal results, an empty table an empty result; URLs of any length are read whole.
Further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reconcilia.llm.common import saved
from reconcilia.llm.hyperminhash import scrambled

#: Bytes of all filters of a cascade.
LIMIT = 256 << 20
#: More levels than this can only mean that two keys share both of their hashes.
MOST_LEVELS = 200
#: Bits of a bitmap as ``bitmap_construct_agg`` builds it.
PART = 1 << 15


@dataclass
class Cascade:
    """Levels of (bits, number of hashes, bytes)."""

    levels: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def passes(self, level: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        bits, hashes, data = self.levels[level]
        found = np.ones(len(h1), bool)
        for at in places(h1, h2, level, bits, hashes):
            found &= (data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1
        return found

    def lists(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Which keys are listed: those whose first level that they don't pass is an even one, counted from 1."""
        listed, open_ = np.zeros(len(h1), bool), np.arange(len(h1))
        for level in range(len(self.levels)):
            passed = self.passes(level, h1[open_], h2[open_])
            listed[open_[~passed]] = level % 2 == 1
            open_ = open_[passed]
        listed[open_] = len(self.levels) % 2 == 1
        return listed


def places(h1: np.ndarray, h2: np.ndarray, level: int, bits: int, hashes: int) -> Iterator[np.ndarray]:
    """The bits of keys in a level, one array for each hash."""
    start = scrambled(h1.view(np.uint64) + np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64)))
    step = scrambled(h2.view(np.uint64) ^ start) | np.uint64(1)
    for k in range(hashes):
        yield (start + np.uint64(k) * step) % np.uint64(bits)


def hashed(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(key, F.lit(1)).alias("h2")]


def first_size(listed: int, others: int) -> tuple[int, int]:
    """Bits and hashes of level 1."""
    share = min(0.5, max(listed, 1) / (math.sqrt(2) * max(others, 1)))
    return max(64, math.ceil(listed * -math.log2(share) / math.log(2))), max(1, round(-math.log2(share)))


def _bits(keys: DataFrame, level: int, bits: int, hashes: int) -> np.ndarray:
    """A level's filter. Each part of it is put together by one task; what reaches the driver is the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(np.concatenate(list(places(b.column(0).to_numpy(), b.column(1).to_numpy(), level, bits, hashes)))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at // PART), pa.array(at % PART)], names=["part", "bit"])

    made = keys.mapInArrow(run, "part long, bit long").groupBy("part").agg(F.bitmap_construct_agg("bit").alias("map"))
    out = np.zeros(-(-bits // PART) * PART // 8, np.uint8)
    for part, data in made.collect():
        out[part * PART // 8 : (part + 1) * PART // 8] = np.frombuffer(data, np.uint8)
    return out


def _passing(keys: DataFrame, cascade: Cascade) -> DataFrame:
    """The keys that pass the cascade's last level."""
    shared, level = keys.sparkSession.sparkContext.broadcast(cascade), len(cascade.levels) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(shared.value.passes(level, b.column(0).to_numpy(), b.column(1).to_numpy())))

    return keys.mapInArrow(run, "h1 long, h2 long")


def cascade_of(listed: DataFrame, universe: DataFrame) -> Cascade | None:
    """The cascade of listed keys (one column) over a universe of keys (one column, no key twice); None beyond LIMIT."""
    listed, out = listed.toDF("key").distinct(), Cascade()
    inside = saved(listed.select(*hashed(F.col("key"))))
    outside = saved(universe.toDF("key").join(listed, "key", "left_anti").select(*hashed(F.col("key"))))
    n = inside.count()
    bits, hashes = first_size(n, outside.count())
    if (bits + 8 * n) // 8 > LIMIT:
        return None
    while n:
        level = len(out.levels)
        if level == MOST_LEVELS:
            raise ValueError("two keys can't be told apart")
        out.levels.append((bits, hashes, _bits(inside, level, bits, hashes)))
        inside, outside = saved(_passing(outside, out)), inside
        n = inside.count()
        bits, hashes = max(64, math.ceil(n / math.log(2))), 1
    return out


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next slash, question mark or hash; A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(_behind(url), r"^[^/?#]*", 0), F.lit("")), ascii_uppercase, ascii_lowercase)


def path_of(url: Column) -> Column:
    """From there to the question mark or hash."""
    return F.coalesce(F.regexp_extract(_behind(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _behind(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3))


def candidates(host: Column, path: Column, hosts: list[int], paths: list[int]) -> Column:
    """Keys that can fit, in the order in which they decide: structs of (minus length, minus host length, key)."""
    numbers = lambda x: F.array(*map(F.lit, x)).cast("array<int>")
    mine = F.filter(numbers(hosts), lambda n: (n == F.length(host)) | ((n < F.length(host)) & (F.substr(host, F.length(host) - n, F.lit(1)) == ".")))
    begins = F.filter(numbers(paths), lambda n: n <= F.length(path))
    key = lambda n, p: F.struct((-n - p).alias("a"), (-n).alias("b"), F.concat(F.right(host, n), F.left(path, p)).alias("key"))
    return F.array_sort(F.flatten(F.transform(mine, lambda n: F.transform(begins, lambda p: key(n, p)))))


def decided(urls: DataFrame, rules: DataFrame, otherwise: str = "allow", url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The columns ``keep``, host, path, rule, verdict of every URL. ``rules``: host, path, verdict (allow or block)."""
    whole = rules.where("host IS NOT NULL AND startswith(path, '/') AND verdict IN ('allow', 'block')")
    listed = whole.select(F.translate("host", ascii_uppercase, ascii_lowercase).alias("host"), "path", "verdict").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    listed = saved(listed.withColumn("key", F.concat("host", "path")))
    sizes = listed.agg(F.sort_array(F.collect_set(F.length("host"))), F.sort_array(F.collect_set(F.length("path")))).first()
    named = [F.col(f"`{c}`") for c in keep]
    rows = urls.select(*named, host_of(F.col(f"`{url}`")).alias("_host"), path_of(F.col(f"`{url}`")).alias("_path"))
    rows = rows.withColumn("_keys", candidates(F.col("_host"), F.col("_path"), *sizes))
    universe = saved(rows.select(F.explode("_keys.key").alias("key")).distinct())
    cascades = [cascade_of(listed.where(F.col("verdict") == v).select("key"), universe) for v in ("block", "allow")]
    found = _joined(rows, listed, keep) if None in cascades else _looked_up(rows, cascades)
    return found.select(*named, F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), F.coalesce("_verdict", F.lit(otherwise)).alias("verdict"))


def _looked_up(rows: DataFrame, cascades: list[Cascade]) -> DataFrame:
    """``rows`` with _rule and _verdict of the first key that a cascade lists."""
    shared = rows.sparkSession.sparkContext.broadcast(cascades)
    kind = T.StructType([T.StructField("place", T.IntegerType()), T.StructField("blocked", T.BooleanType())])

    @F.arrow_udf(kind)
    def first(h1: pa.Array, h2: pa.Array) -> pa.Array:
        flat = [h.flatten().to_numpy() for h in (h1, h2)]
        size = h1.value_lengths().fill_null(0).to_numpy()
        starts = np.cumsum(size) - size
        blocked, allowed = (c.lists(*flat) for c in shared.value)
        hits = np.flatnonzero(blocked | allowed)
        row = np.repeat(np.arange(len(size)), size)[hits]
        owners, at = np.unique(row, return_index=True)
        place, block = np.full(len(size), -1, np.int32), np.zeros(len(size), bool)
        place[owners], block[owners] = hits[at] - starts[owners], blocked[hits[at]]
        return pa.StructArray.from_arrays([pa.array(place, mask=place < 0), pa.array(block)], names=["place", "blocked"])

    out = rows.withColumn("_first", first(F.transform("_keys.key", lambda k: hashed(k)[0]), F.transform("_keys.key", lambda k: hashed(k)[1])))
    return out.withColumns({"_rule": F.get("_keys.key", F.col("_first.place")), "_verdict": F.when(F.col("_first.place").isNotNull(), F.when(F.col("_first.blocked"), "block").otherwise("allow"))})


def _joined(rows: DataFrame, listed: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """The same by a join, for lists that are too long for filters. Each row gets a number of its own, since rows may repeat."""
    own = saved(rows.withColumn("_row", F.monotonically_increasing_id()))
    found = own.select("_row", F.explode("_keys").alias("k")).join(listed.select(F.col("key").alias("_key"), "verdict"), F.col("k.key") == F.col("_key"))
    best = found.groupBy("_row").agg(F.min_by(F.struct("_key", "verdict"), "k").alias("_best"))
    return own.join(best, "_row", "left").withColumns({"_rule": F.col("_best._key"), "_verdict": F.col("_best.verdict")})
