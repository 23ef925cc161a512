"""Importance resampling towards a target by hashed features, with a head-tail vocabulary.

A document's features are all runs of 1 to ``longest`` consecutive words, joined by one space; a feature's bucket is the
CRC-32 of its bytes modulo ``buckets``. A bucket's gain is the floored log ratio of its smoothed shares in the target texts and in all
documents. A document's weight is the sum of its features' gains, and the documents of highest weight plus a seeded Gumbel variable are drawn.

Most words of a text belong to a small head of frequent words. The head's words are broadcast with their exact CRC states (the
CRC of a longer feature goes on from its first word's state), and its frequent pairs with their buckets. All else is the
tail, whose features take a direct CRC. Head and tail give the same values, so totals and weights are exact whatever the head holds; it
only saves work. Words and pairs get into the head when they make up more than one in ``HEAD`` of the tallied words or pairs, of which there are at most HEAD; tallies keep ``TALLY``
entries (each task subtracts what falls below, as frequent-item counters do), and words of over ``LONGEST`` bytes are never remembered. Pairs are tallied only if both
of their words are in the head.

Nulls and empty texts have no features and weigh 0. Null ids take the Gumbel variable of an empty id. Ties go to the smaller id, null ids last; repeated rows get
equal weights and scores, and ranks of their own if drawn. Without target texts, all gains but for the smoothing are those of an empty target. Long texts are cut into
slices between words, so no slice holds more than about ``SLICE`` bytes of words at a time, and runs go on over the cuts. An empty table gives an empty result. Further
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reconcilia.llm.common import CRC_SQL, arrow_rows, crc_sql, saved

BUCKETS = 10_000
SEED = "2024"
HEAD, TALLY, LONGEST, SLICE = 1 << 14, 1 << 16, 64, 1 << 20
#: Texts that go to a worker at a time.
BATCH = 500

#: A-Z to a-z; digits, a-z and all bytes from 0x80 stay; the rest separates words.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def slices(body: bytes | None) -> Iterator[list[bytes]]:
    """The words of a UTF-8 text, some at a time."""
    text = (body or b"").translate(LETTERS)
    at = 0
    while at < len(text):
        end = text.find(b" ", at + SLICE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


class States(dict):
    """CRC states of the head's words; any other word's is computed."""

    def __missing__(self, word: bytes) -> int:
        return zlib.crc32(word)


class Pairs(dict):
    """Buckets' CRCs of the head's pairs; any other pair's goes on from its first word's state."""

    def __init__(self, states: States, head: dict) -> None:
        super().__init__(head)
        self.states = states

    def __missing__(self, pair: tuple[bytes, bytes]) -> int:
        return zlib.crc32(b" " + pair[1], self.states[pair[0]])


class Features:
    """Buckets of a text's features."""

    def __init__(self, words: list[bytes], pairs: list[tuple[bytes, bytes]], longest: int, buckets: int) -> None:
        self.states = States((w, zlib.crc32(w)) for w in words)
        self.pairs = Pairs(self.states, {p: zlib.crc32(b" ".join(p)) for p in pairs})
        self.longest, self.buckets = longest, buckets

    def of(self, body: bytes | None) -> Iterator[tuple[int, np.ndarray]]:
        """Slice by slice: how many words, and the buckets of the features that end there."""
        before: list[bytes] = []
        for some in slices(body):
            words = before + some
            new = len(before)
            crcs = [np.fromiter(map(self.states.__getitem__, some), np.int64, len(some))]
            if self.longest > 1:
                starts = words[max(new - 1, 0) :]
                crcs.append(np.fromiter(map(self.pairs.__getitem__, zip(starts, starts[1:], strict=False)), np.int64, max(len(starts) - 1, 0)))
            for n in range(3, self.longest + 1):
                runs = range(max(new - n + 1, 0), len(words) - n + 1)
                crcs.append(np.fromiter((zlib.crc32(b" " + b" ".join(words[i + 2 : i + n]), self.pairs[words[i], words[i + 1]]) for i in runs), np.int64, len(runs)))
            before = words[-(self.longest - 1) :] if self.longest > 1 else []
            yield len(some), np.concatenate(crcs) % self.buckets


def _bodies(df: DataFrame, text: str) -> DataFrame:
    return df.select(F.col(f"`{text}`").cast("binary").alias("body"))


def _frequent(rows: DataFrame) -> list[bytes]:
    """Items of at most HEAD that make up more than one in HEAD of what was tallied. ``rows``: item, n."""
    sums = saved(rows.groupBy("item").agg(F.sum("n").alias("n")))
    total = sums.agg(F.sum("n")).first()[0] or 0
    return [bytes(r["item"]) for r in sums.where(F.col("n") > total / HEAD).select("item").collect()]


def _tallied(bodies: DataFrame, head: frozenset[bytes] | None = None) -> DataFrame:
    """item, n: frequent words of each task, or frequent pairs of words that are in ``head``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter = Counter()
        for batch in batches:
            for body in batch.column(0):
                last = None
                for words in slices(body.as_py()):
                    if head is None:
                        tally.update(words)
                    else:
                        words = [last, *words] if last is not None else words
                        tally.update((a, b) for a, b in zip(words, words[1:], strict=False) if a in head and b in head)
                        last = words[-1] if words else last
                    if len(tally) > 4 * TALLY:
                        least = np.partition(np.fromiter(tally.values(), np.int64, len(tally)), -TALLY)[-TALLY]
                        tally = Counter({k: n - least for k, n in tally.items() if n > least})
        items = [(k if head is None else b" ".join(k), n) for k, n in tally.items() if n > 1 and len(k) <= LONGEST]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in items], pa.binary()), pa.array([n for _, n in items], pa.int64())], names=["item", "n"])

    return bodies.mapInArrow(run, "item binary, n long")


def totals(bodies: DataFrame, features) -> np.ndarray:
    """Features in each bucket; ``features`` is a broadcast ``Features``. What reaches the driver is a count for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(features.value.buckets, np.int64)
        for batch in batches:
            for body in batch.column(0):
                for _, found in features.value.of(body.as_py()):
                    some = np.bincount(found)
                    counts[: len(some)] += some
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["bucket", "n"])

    out = np.zeros(features.value.buckets, np.int64)
    for bucket, n in bodies.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored log ratios, in thousandths."""
    s, t, size = raw.astype(float), target.astype(float), float(len(raw))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + size) / ((s + 1) * (t.sum() + size)))).astype(np.int64)


def gumbel(doc_id: Column, seed: str = SEED) -> Column:
    """A document's Gumbel variable in thousandths, from the first 32 bits of a digest of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.left(digest, F.lit(8)), 16, 10).cast("long")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with their place (1, 2, ...) in an order: dealt out by ranges, numbered in each, moved on by the counts of the ranges before."""
    dealt = saved(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("_row", own).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_row")).drop("_part", "_row", "_before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, buckets: int = BUCKETS, seed: str = SEED, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; ``rank`` of those that aren't drawn is null.

    Of the documents with ``least_words`` words or more, ``percent`` in a hundred are drawn (rounded down).
    """
    spark = docs.sparkSession
    with arrow_rows(spark, BATCH):
        bodies = _bodies(docs, text)
        words = _frequent(_tallied(bodies))
        pairs = [tuple(p.split(b" ")) for p in _frequent(_tallied(bodies, frozenset(words)))] if longest > 1 else []
        features = spark.sparkContext.broadcast(Features(words, pairs, longest, buckets))
        gain = gains(totals(bodies, features), totals(_bodies(target, text), features))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sums = np.zeros((3, len(batch)), np.int64)
                for i, body in enumerate(batch.column(1)):
                    for n, found in features.value.of(body.as_py()):
                        sums[:, i] += len(found), gain[found].sum(), n
                yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, sums)], names=["doc_id", "n_features", "weight", "n_words"])

        scored = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("body")).mapInArrow(run, "doc_id long, n_features long, weight long, n_words long")
        scored = saved(scored.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)))
    some = scored.where(F.col("n_words") >= least_words)
    drawn = some.count() * percent // 100
    placed = ranked(some, [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight")], "rank")
    placed = placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")).cast("long"))
    others = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return placed.unionByName(others).select("doc_id", "n_features", "weight", "score", "rank")


RESAMPLE_SQL = f"""
WITH {CRC_SQL},
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM benchmark),
dw AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(words) AS w FROM d) GROUP BY ALL),
v AS (SELECT w, {crc_sql("w")} % 10000 AS bucket FROM (SELECT w FROM dw UNION SELECT w FROM b), crc_table),
s AS (SELECT bucket, sum(n) AS s FROM dw JOIN v USING (w) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM b JOIN v USING (w) GROUP BY 1),
size AS (SELECT (SELECT coalesce(sum(s), 0) FROM s)::DOUBLE AS big_s, (SELECT coalesce(sum(t), 0) FROM t)::DOUBLE AS big_t),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (big_s + 10000) / ((coalesce(s, 0)::DOUBLE + 1) * (big_t + 10000))))::BIGINT AS gain FROM s FULL JOIN t USING (bucket), size),
w AS (SELECT doc_id, sum(n * gain)::BIGINT AS weight FROM dw JOIN v USING (w) JOIN g USING (bucket) GROUP BY 1),
r AS (SELECT d.doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || d.doc_id), 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN w USING (doc_id)),
k AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM r WHERE n_features >= 20 QUALIFY row_number() OVER (ORDER BY score DESC, doc_id) <= (SELECT count(*) * 10 // 100 FROM r WHERE n_features >= 20))
SELECT doc_id, n_features, weight, score, rank FROM r LEFT JOIN k USING (doc_id)
"""
