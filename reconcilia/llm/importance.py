"""Quality by importance resampling.

Two generative models of hashed word n-grams (one and two words, 65 536 buckets) are fitted: one of
target text, the documents that labels call good, one of raw text, all documents. A document's
importance weight is the ratio of its probabilities, in logs the sum over its n-grams of
``log(p_target / p_raw)``. The sample of k documents without replacement with those weights is the top k
of log weight plus a Gumbel variable (Gumbel top-k); the variable is a seeded hash of the id, so reruns
agree. k is the number of documents times the share of good ones among all labels.

The target model is smoothed towards the raw one, because it has seen fewer documents. The raw model and the selection use all documents. The target model is fitted on at most
``target_rows`` labelled documents, the first by a hash of the id; their ids are the only thing that
is broadcast. The k-th largest key is found by counting in ever finer bins.

Nulls and empty texts have no n-grams and log weight 0. Documents whose keys tie with the k-th are all
kept. Null ids share one Gumbel variable. Repeated rows get equal results. Without labels everything
is kept; an empty table gives an empty result. Texts of any length are read whole. Further columns, whatever their
names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reconcilia.llm.common import LOWER, saved
from reconcilia.llm.hyperminhash import HASHES, scrambled, tidied

BUCKET_BITS = 16
#: Target n-grams that a bucket gets from the raw model: rare n-grams then say little either way.
SMOOTHING = 8.0
TARGET_ROWS = 20_000
SEED = 11


def ngrams(body: bytes | None) -> np.ndarray:
    """Buckets of a UTF-8 text's words and word pairs."""
    tokens = (body or b"").translate(LOWER).split()
    ids = np.fromiter(map(HASHES.__getitem__, tokens), np.uint64, len(tokens))
    pairs = scrambled(ids[:-1] * np.uint64(3) + ids[1:])
    return (np.concatenate([ids, pairs]) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, 1 << BUCKET_BITS), np.int64)
    for batch in batches:
        for body, target in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            found = np.bincount(ngrams(body.as_py()), minlength=1) if body.is_valid else np.zeros(1, np.int64)
            counts[0, : len(found)] += found
            if target:
                counts[1, : len(found)] += found
    used = np.flatnonzero(counts[0])
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[0, used]), pa.array(counts[1, used])], names=["bucket", "raw", "target"])


def log_ratios(docs: DataFrame, targets: DataFrame) -> np.ndarray:
    """log(p_target / p_raw) of every bucket. ``targets``: a bounded table of doc_id."""
    chosen = F.broadcast(targets.select("doc_id").distinct().withColumn("target", F.lit(True)))
    bodies = docs.select("doc_id", F.col("text").cast("binary").alias("body"))
    marked = bodies.join(chosen, "doc_id", "left").select("body", F.coalesce("target", F.lit(False)).alias("target"))
    sums = marked.mapInArrow(tidied(_count), "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    counts = np.zeros((2, 1 << BUCKET_BITS))
    counts[:, sums["bucket"].to_numpy(np.int64)] = sums[["raw", "target"]].to_numpy().T
    if not counts[1].any():
        return np.zeros(1 << BUCKET_BITS)
    raw, target = counts
    expected = raw * (target.sum() / raw.sum())
    return np.log((target + SMOOTHING) / (expected + SMOOTHING))


def weighed(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """doc_id, n_grams, log_weight."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_grams", pa.int64()), ("log_weight", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [ngrams(b.as_py()) for b in batch.column(1)]
            weights = [float(ratios[f].sum()) for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, found)), pa.int64()), pa.array(weights, pa.float64())], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("body")).mapInArrow(tidied(run), "doc_id long, n_grams long, log_weight double")


def kth_largest(rows: DataFrame, key: str, k: int, bins: int = 4096) -> float | None:
    """The k-th largest value of a column, by counting rows in bins; a round sends ``bins`` counts to the driver."""
    low, high = rows.agg(F.min(key), F.max(key)).first()
    while low is not None and low < high:
        width = (high - low) / bins
        if width == 0 or low + width == low:
            break
        place = F.least(F.lit(bins - 1), F.floor((F.col(key) - F.lit(low)) / F.lit(width))).cast("int")
        counted = rows.where(F.col(key).between(low, high)).groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).orderBy(F.desc("bin")).collect()
        for row in counted:
            if k <= row["n"]:
                low, high = row["low"], row["high"]
                break
            k -= row["n"]
    return low


def resample(docs: DataFrame, labels: DataFrame, target_rows: int = TARGET_ROWS, seed: int = SEED) -> DataFrame:
    """doc_id, n_grams, log_weight, key, kept of every document. ``labels``: doc_id and quality (1: good)."""
    good = labels.where("quality = 1 AND doc_id IS NOT NULL")
    targets = saved(good.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(target_rows))
    rows = weighed(docs, log_ratios(docs, targets))
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) + 0.5) / float(1 << 53)
    rows = saved(rows.withColumn("key", F.col("log_weight") - F.log(-F.log(uniform))))
    share = labels.where("quality IS NOT NULL").agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
    n = rows.count()
    k = n if share is None else round(n * share)
    least = kth_largest(rows, "key", k) if k else None
    return rows.withColumn("kept", F.lit(bool(k)) if least is None else F.col("key") >= F.lit(least))
