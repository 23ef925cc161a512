"""Mixing sources to target weights: capped water-filling and seeded repetitions, all in SQL functions.

Targets: each source gets the share of the total that its weight asks for, but at most ``max_epochs``
times its own size; what is cut off goes to the sources below their cap in proportion to weight,
until none is above. That is the level L with sum(min(cap, weight * L)) = total, found exactly by
ordering the sources by cap / weight: those before the level are clamped.

Sampling: a source with target = size * (k + f) takes each document k times whole, and once more the
documents that come first by a seeded hash of their id until the rest f * size is used up; the document at
that edge is taken in part. So a source takes its target to the word, and reruns agree. Rows of one id
(null is an id) stand at one place; if they are the edge, each gives the same share of its words, cut to whole words.

The edge of a source is found by counting words in ever finer ranges of the hash. What meets in one task
is one row for each source, or the few thousand ranges of one source; documents are never ordered.

Null source: a source of its own, last in order. Null text: size 0, taken 0. Texts of any length are counted
whole. Ties: rows with equal id and text get equal results. An empty table gives an empty result. Further columns,
whatever their names, don't matter to ``mix`` and are handed on by ``repeated``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reconcilia.llm.common import WORD, columns_of, saved

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3


def size_of(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """From (source, size) rows: source, source_size, weight, target. One row for each source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((place - 1) % len(weights) + 1).cast("int")).cast("long"))
    per = per.withColumn("cap", F.col("source_size") * max_epochs)
    everything = Window.partitionBy()
    # weight descending breaks ties of cap / weight; cap and weight are whole numbers, so sums are exact
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    per = (
        per.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("capped_before", F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("weight_from", F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("left_over", F.col("total") - F.coalesce("capped_before", F.lit(0)))
        # clamped while the level that the rest would reach is at or above this source's cap
        .withColumn("clamped", F.col("cap") * F.col("weight_from") <= F.col("weight") * F.col("left_over"))
    )
    free = F.when(~F.col("clamped"), F.struct("left_over", "weight_from"))
    first = F.max_by(free, F.when(~F.col("clamped"), F.col("weight_from"))).over(everything)
    target = F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("first.left_over") / F.col("first.weight_from"))
    return per.withColumn("first", first).select("source", "source_size", "weight", target.alias("target"))


def place_of(doc_id: Column, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("null"))))


#: Characters of the hash by which the edge is looked for: ranges, ranges in a range, places.
LEVELS = (3, 6, 32)


def source_edges(sizes: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """One row for each source: what it takes whole, and the place up to which it takes once more.

    ``sizes``: source, size, place, as a written table. Result: source, source_size, target, whole, edge (null: all are
    taken once more), edge_left (words still to take there), edge_size (words that stand there).
    """
    targets = source_targets(sizes, weights, max_epochs)
    targets = targets.withColumn("whole", F.least(F.lit(max_epochs), F.floor(F.col("target") / F.greatest("source_size", F.lit(1)))).cast("long"))
    targets = saved(targets.withColumn("rest", F.round(F.col("target")).cast("long") - F.col("whole") * F.col("source_size")))
    near, known = targets.select(F.col("source").alias("_source"), F.lit("").alias("_range"), F.col("rest").alias("left")), 0
    for level in LEVELS:
        inside = sizes.join(near, F.col("source").eqNullSafe(F.col("_source")) & (F.substring("place", 1, known) == F.col("_range")))
        ranges = inside.groupBy("source", F.substring("place", 1, level).alias("range")).agg(F.sum("size").alias("words"), F.first("left").alias("left"))
        before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        edge = ranges.withColumn("before", before).where("before <= left AND left < before + words")
        near, known = saved(edge.select(F.col("source").alias("_source"), F.col("range").alias("_range"), (F.col("left") - F.col("before")).alias("left"), "words")), level
    edges = targets.join(near, F.col("source").eqNullSafe(F.col("_source")), "left")
    return saved(edges.select("source", "source_size", "target", "whole", F.col("_range").alias("edge"), F.col("left").alias("edge_left"), F.col("words").alias("edge_size")))


def part_of(size: Column, place: Column) -> Column:
    """Words that a document gives once more."""
    shared = F.when(F.col("edge_size") == size, F.col("edge_left")).otherwise(F.floor(F.col("edge_left") * size / F.greatest("edge_size", F.lit(1))))
    return F.when(F.col("edge").isNull() | (place < F.col("edge")), size).when(place == F.col("edge"), shared).otherwise(0).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 7) -> DataFrame:
    """doc_id, source, size, source_size, target, whole (repetitions), part (words of one more), taken."""
    sizes = saved(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), place_of(F.col("doc_id"), seed).alias("place")))
    edges = source_edges(sizes, weights, max_epochs)
    out = sizes.join(edges, sizes["source"].eqNullSafe(edges["source"])).drop(edges["source"])
    out = out.withColumn("part", part_of(F.col("size"), F.col("place")))
    return out.select("doc_id", "source", "size", "source_size", "target", "whole", "part", (F.col("whole") * F.col("size") + F.col("part")).alias("taken"))


def repeated(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = 7) -> DataFrame:
    """The mix itself: ``docs`` with each document repeated as ``mix`` says; n_chars, where there is one, follows the text.

    One row for each source says what to take, so texts are never dealt out for it. No text is cut: a document of which ``mix`` takes a
    part once more is taken whole if that part is half of it or more, and left out otherwise.
    """
    text = F.col("text").cast("string")
    sizes = saved(docs.select("source", size_of(text).alias("size"), place_of(F.col("doc_id"), seed).alias("place")))
    edges = source_edges(sizes, weights, max_epochs).withColumnRenamed("source", "of_source")
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    rows = docs.select(F.struct(*columns_of(docs, *others)).alias("row"), text.alias("text"), "source", size_of(text).alias("size"), place_of(F.col("doc_id"), seed).alias("place"))
    out = rows.join(edges, F.col("source").eqNullSafe(F.col("of_source"))).withColumn("part", part_of(F.col("size"), F.col("place")))
    copies = F.col("whole") + F.when((F.col("part") > 0) & (2 * F.col("part") >= F.col("size")), 1).otherwise(0)
    out = out.select("row", F.explode(F.array_repeat("text", copies.cast("int"))).alias("text"))
    own = {"text": F.col("text"), "n_chars": F.length("text").cast("long").alias("n_chars")}
    return out.select(*(own[c] if c in own else F.col("row").getField(c).alias(c) for c in docs.columns))


#: The same in DuckDB: water-filling by repeated clamping in place of the ordered form.
MIX_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5('7:' || coalesce(doc_id::VARCHAR, 'null')) AS place
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INTEGER]::BIGINT AS weight
  FROM d GROUP BY source),
fill(step, source, source_size, weight, fixed) AS (
  SELECT 0, source, source_size, weight, false FROM s
  UNION ALL
  SELECT step + 1, source, source_size, weight,
         fixed OR 3 * source_size * W <= weight * T
  FROM (SELECT *, sum(CASE WHEN fixed THEN 0 ELSE weight END) OVER () AS W,
               sum(CASE WHEN fixed THEN -2 * source_size ELSE source_size END) OVER () AS T FROM fill)
  WHERE step < 64),
t AS (
  SELECT source, source_size, (CASE WHEN fixed THEN 3 * source_size::DOUBLE ELSE (weight * T)::DOUBLE / W END) AS target
  FROM (SELECT *, sum(CASE WHEN fixed THEN 0 ELSE weight END) OVER ()::BIGINT AS W,
               sum(CASE WHEN fixed THEN -2 * source_size ELSE source_size END) OVER ()::BIGINT AS T FROM fill WHERE step = 64)),
e AS (SELECT *, least(3, floor(target / greatest(source_size, 1)))::BIGINT AS whole FROM t),
r AS (
  SELECT d.doc_id, d.size, e.source_size, e.target, e.whole, round(e.target)::BIGINT - e.whole * e.source_size AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS done
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, rest - done)))::BIGINT AS taken FROM r
"""
