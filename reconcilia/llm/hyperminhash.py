"""Near-duplicate documents with HyperMinHash sketches.

A document is its set of distinct word shingles (64-bit hashes; the whole sequence if it has fewer
words than a shingle). The top bits of a hash choose one of 128 buckets. A bucket's register keeps
the smallest hash there in 16 bits: the number of leading zeros (6 bits) and the 10 bits behind the
first one. For banding, an empty register borrows a filled one along a fixed random order of buckets, so that
a short document's band rests on as many shingles as a long one's. Five registers are a band;
documents that share a band are candidates. Candidates whose Jaccard estimate from the registers, corrected for chance
collisions, is within six standard deviations of the limit or above are confirmed on their full shingle sets; the others are left to step 3.

Only what decides components is verified:

1. Documents with equal sets are one class (its smallest id stands for it).
2. Within a band's group every member is compared with the group's hub, the member that shares the
   most bands overall. That is one pair for each member, not all pairs, and joins a base text with
   its variants.
3. Members of one group that are still in different components are joined exactly, by the prefix and
   position filters of set-similarity joins, so that no candidate pair is left that is neither
   verified, nor refuted by an exact bound, nor already connected. No estimate decides there.

A pair at Jaccard 0.85 shares none of the 25 bands with probability (1 - 0.85^5)^25 < 5e-7.

Nulls and empty texts have no shingles and link with nothing. Rows with one doc_id count as one
document: they share a component, and the links of the first text in byte order count. Rows with a null doc_id take the component of their text's class, or null. Ties between
hubs go to the smaller id. Texts of any length are read whole; an empty table gives an empty result. Further
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reconcilia.llm.common import LOWER, arrow_rows, attach, maybe_among, saved
from reconcilia.llm.components import components

BUCKET_BITS = 7
MANTISSA_BITS = 10
BAND = 5
BANDS = (1 << BUCKET_BITS) // BAND
EMPTY = 0xFFFF
#: Texts or pairs of sets that go to a worker at a time.
BATCH = 500
#: Word hashes that a task remembers, and bytes of the longest word among them: some 20 MB at most.
REMEMBERED, LONGEST = 100_000, 64


class WordHashes(dict):
    """64-bit hashes of words; long words, such as texts without spaces, are never remembered, the others up to a bound."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = value
        return value


HASHES = WordHashes()


def forget() -> None:
    """At the end of a task: workers live on, and what they keep adds up over the stages."""
    HASHES.clear()
    pa.default_memory_pool().release_unused()


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` that leaves nothing behind in its worker."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            forget()

    return whole


def scrambled(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit values whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(body: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a UTF-8 text's word shingles."""
    tokens = (body or b"").translate(LOWER).split()
    if not tokens:
        return np.zeros(0, np.uint64)
    width = min(words, len(tokens))
    ids = np.fromiter(map(HASHES.__getitem__, tokens), np.uint64, len(tokens))
    out = np.full(len(ids) - width + 1, width, np.uint64)
    for k in range(width):
        out = scrambled(out + ids[k : k + len(out)])
    return np.unique(out)


def registers(hashes: np.ndarray) -> np.ndarray:
    """HyperMinHash registers of a sorted set: uint16, EMPTY where no hash fell."""
    edges = np.arange(1 << BUCKET_BITS, dtype=np.uint64) << np.uint64(64 - BUCKET_BITS)
    at = np.searchsorted(hashes, edges)
    filled = at < np.append(at[1:], len(hashes))
    low = hashes[at[filled]] << np.uint64(BUCKET_BITS)  # hashes are sorted: the first of a bucket is its least
    zeros = 53 - np.frexp((low >> np.uint64(11)).astype(np.float64))[1]
    zeros = np.clip(np.where(low >> np.uint64(11), zeros, 53), 0, 53).astype(np.uint64)
    mantissa = (low << zeros << np.uint64(1)) >> np.uint64(64 - MANTISSA_BITS)
    out = np.full(1 << BUCKET_BITS, EMPTY, np.uint16)
    out[filled] = (zeros << np.uint64(MANTISSA_BITS) | mantissa).astype(np.uint16)
    return out


@lru_cache(maxsize=1)
def donors() -> np.ndarray:
    """For each bucket the order in which it looks for a filled one: itself, then all in a fixed random order."""
    n, rng = 1 << BUCKET_BITS, np.random.default_rng(3)
    return np.array([[i, *(j for j in rng.permutation(n) if j != i)] for i in range(n)])


def band_keys(sketch: np.ndarray) -> list[int]:
    """A 64-bit key for each band of a sketch with at least one filled register."""
    order = donors()
    empty = np.flatnonzero(sketch == EMPTY)
    full = sketch.copy()
    full[empty] = sketch[order[empty, (sketch != EMPTY)[order[empty]].argmax(axis=1)]]
    return [xxhash.xxh3_64_intdigest(full[i * BAND : (i + 1) * BAND].tobytes(), i) - (1 << 63) for i in range(BANDS)]


def chance_collisions(n: float, m: float) -> float:
    """Expected share of equal registers of disjoint sets of n and m elements.

    In a bucket with rates a and b the two minima fall into one cell of width w = 2^-(level + mantissa
    bits) with probability of about w times the integral of a*b*exp(-(a+b)x) over the level.
    """
    a, b = n / (1 << BUCKET_BITS), m / (1 << BUCKET_BITS)
    s, level = a + b, np.arange(1, 54)
    mass = a * b / s * (np.exp(-s * 2.0**-level) - np.exp(-s * 2.0 ** -(level - 1)))
    return float((mass * 2.0 ** -(level + MANTISSA_BITS)).sum())


def estimated(x: np.ndarray, y: np.ndarray, n: int, m: int) -> tuple[float, int]:
    """Collision-corrected Jaccard estimate and the number of buckets it rests on."""
    used = (x != EMPTY) | (y != EMPTY)
    buckets = int(used.sum())
    extra = chance_collisions(n, m) * (1 << BUCKET_BITS)
    return max(0.0, int((x == y)[used].sum()) - extra) / max(1, buckets), buckets


def _sketch(words: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, bands = [], [], []
            for body in batch.column(1):
                found = shingle_set(body.as_py(), words)
                n.append(len(found))
                keys.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                bands.append(band_keys(registers(found)) if len(found) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], schema=schema)

    return run


def sketches(docs: DataFrame, words: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, set_key (a hash of the whole set), bands (keys of the sketch's bands)."""
    bodies = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("body"))
    return bodies.mapInArrow(tidied(_sketch(words)), "doc_id long, n_shingles long, set_key binary, bands array<long>")


def _sets(words: int):
    schema = pa.schema([("id", pa.int64()), ("registers", pa.binary()), ("hashes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), 500):
                part = batch.slice(start, 500)
                found = [shingle_set(b.as_py(), words) for b in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([registers(f).tobytes() for f in found], pa.binary()), pa.array([f.tobytes() for f in found], pa.binary())], schema=schema)

    return run


def similar(x: np.ndarray, y: np.ndarray, share: int) -> bool:
    """100 * |x and y| >= share * |x or y| for sorted distinct arrays."""
    if 100 * min(len(x), len(y)) < share * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= share * (len(x) + len(y) - both)


def _verify(share: int, estimate: bool):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for a, b, *rest in zip(*(batch.column(i) for i in range(6)), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in rest[2:])
                if estimate:
                    p, q = (np.frombuffer(v.as_buffer(), np.uint16) for v in rest[:2])
                    guess, buckets = estimated(p, q, len(x), len(y))
                    if guess < share / 100 - 6 * (share / 100 * (1 - share / 100) / max(1, buckets)) ** 0.5:
                        continue
                if similar(x, y, share):
                    found.append((a.as_py(), b.as_py()))
            yield pa.RecordBatch.from_pydict({"a": [f[0] for f in found], "b": [f[1] for f in found]}, schema)

    return run


def verified(pairs: DataFrame, sets: DataFrame, share: int, estimate: bool) -> DataFrame:
    """Those (a, b) pairs whose full sets are similar enough; with ``estimate``, pairs far below it by their registers are left for later."""
    first = sets.select(F.col("id").alias("a"), F.col("registers").alias("ra"), F.col("hashes").alias("ha"))
    second = sets.select(F.col("id").alias("b"), F.col("registers").alias("rb"), F.col("hashes").alias("hb"))
    joined = pairs.join(first, "a").join(second, "b").select("a", "b", "ra", "rb", "ha", "hb")
    return joined.mapInArrow(tidied(_verify(share, estimate)), "a long, b long")


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, len(batch), 200):
            part = batch.slice(start, 200)
            found = [np.frombuffer(h.as_buffer(), np.uint64) for h in part.column(2)]
            n = [len(f) for f in found]
            owner = np.repeat(np.arange(len(n)), n)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner)), part.column(1).take(pa.array(owner)), pa.array(np.array(n)[owner]), pa.array(np.concatenate(found).view(np.int64))], names=["id", "component", "n", "token"])


def possible_pairs(docs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """(a, b) of every two ``docs`` (id, component) in different components whose sets may be similar enough.

    Exact prefix and position filters: with tokens in order of frequency, similar sets share a token
    among the first of each, and if that is the first shared one, neither can have passed over more
    tokens than the similarity allows. As the rare tokens come first, variants of a text that differ
    too much never meet. A token's rows are joined from all but its commonest component, by size.
    """
    bin_of = lambda n: F.floor(F.log(n.cast("double")) / F.lit(np.log(1.05))).cast("int")
    rows = saved(sets.join(docs, "id").select("id", "component", "hashes").mapInArrow(tidied(_tokens), "id long, component long, n long, token long"))
    common = saved(rows.groupBy("token").agg(F.count("*").alias("df"), F.min("component").alias("least"), F.max("component").alias("most")))
    ranked = rows.join(common, "token").withColumn("i", F.row_number().over(Window.partitionBy("id").orderBy("df", "token")) - 1)
    # the most that a set can share with one of m tokens if its first shared token is at place i
    most = F.floor((F.col("n") - F.col("i")) * F.lit((100 + share) / share) + F.lit(1e-9)) - F.col("n")
    low, high = F.ceil(F.col("n") * share / 100), F.least(F.floor(F.col("n") * 100 / share), most)
    prefix = saved(ranked.where(F.col("least") != F.col("most")).withColumns({"low": low, "high": high}).where("low <= high").select("token", "id", "component", "n", "i", "low", "high"))
    usual = prefix.groupBy("token", "component").agg(F.count("*").alias("times")).groupBy("token").agg(F.max(F.struct("times", "component")).alias("usual"), F.count("*").alias("kinds")).where("kinds > 1")
    usual = saved(usual)  # both sides of the join are then dealt out for it, so that a frequent token can be split
    some = prefix.join(usual.select("token", F.col("usual.component").alias("usual")), "token")
    seek = some.where("component != usual").select("token", F.explode(F.sequence(bin_of(F.col("low")), bin_of(F.col("high")))).alias("bin"), "id", "component", "n", "i").alias("x")
    sit = prefix.select("token", bin_of(F.col("n")).alias("bin"), "id", "component", "n", "i").alias("y")
    room = F.least(F.col("x.n") - F.col("x.i"), F.col("y.n") - F.col("y.i"))
    fits = (100 + share) * room >= share * (F.col("x.n") + F.col("y.n"))
    met = seek.join(sit, (F.col("x.token") == F.col("y.token")) & (F.col("x.bin") == F.col("y.bin")) & (F.col("x.component") != F.col("y.component")) & fits)
    return met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, words: int = 5, share: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, kept.

    Documents with ``100 * intersection >= share * union`` of their shingle sets are linked.
    """
    with arrow_rows(docs.sparkSession, BATCH):
        return _near_duplicates(docs, words, share, text, doc_id)


def _near_duplicates(docs: DataFrame, words: int, share: int, text: str, doc_id: str) -> DataFrame:
    sketch = saved(sketches(docs, words, text, doc_id))
    some = sketch.where("n_shingles > 0")
    classes = saved(some.groupBy("n_shingles", "set_key").agg(F.min("doc_id").alias("id"), F.count("*").alias("class_size")))
    owners = some.join(classes.select(F.col("id").alias("doc_id")), "doc_id", "left_semi")
    keys = owners.select(F.col("doc_id").alias("id"), F.explode("bands").alias("key")).distinct()
    shared = keys.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    members = saved(keys.join(shared, "key"))
    degree = members.groupBy("id").agg(F.sum("members").alias("degree"))
    hubs = members.select("key", "id").join(degree, "id").groupBy("key").agg(F.max(F.struct("degree", (-F.col("id")).alias("id"))).alias("hub")).select("key", (-F.col("hub.id")).alias("hub"))
    hubs = saved(hubs)  # both sides of the next join are then dealt out for it, so that a large group can be split
    ordered = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    pairs = saved(members.join(hubs, "key").where("id != hub").select(*ordered(F.col("id"), F.col("hub"))).distinct())

    wanted = saved(members.select("id").distinct())
    bodies = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("binary").alias("body"))
    sets = saved(maybe_among(bodies, "id", wanted).join(wanted, "id", "left_semi").groupBy("id").agg(F.min("body").alias("body")).mapInArrow(tidied(_sets(words)), "id long, registers binary, hashes binary"))
    links = saved(verified(pairs, sets, share, estimate=True))
    labels = components(links)

    # what is left: members of one group in different components
    placed = members.select("id", "key").join(labels, "id", "left").select("id", "key", F.coalesce("component", "id").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least != most").select("key")
    mixed = saved(mixed)
    open_ = placed.join(mixed, "key").select("id", "component").distinct()
    more = saved(verified(possible_pairs(open_, sets, share), sets, share, estimate=False))
    if not more.isEmpty():
        labels = components(links.unionByName(more))

    found = classes.join(labels, "id", "left").select("n_shingles", "set_key", F.coalesce("component", "id").alias("component_id"), "class_size")
    light = sketch.select("doc_id", "n_shingles", "set_key")
    out = attach(light.where("n_shingles > 0"), saved(found), ["n_shingles", "set_key"], "class_size").select("doc_id", "n_shingles", "component_id")
    alone = light.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
