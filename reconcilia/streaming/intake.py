"""Statements as they arrive: streams of words, pages and OCR tokens, in any order and any number of files.

A document is processed when all of it is there. What there will be says a fourth stream, ``files``: file_id, n_words,
n_pages, n_tokens. State is kept for each file (four counts and what was announced) and is dropped when the file is complete; the rows
themselves stay in their folders, and a batch reads those of the files that it completes.

Each batch of complete files goes through ``statements.process`` into the versioned sink. Its number is the batch's name there, so a batch
that comes again after a failure changes nothing, and its files keep their ids.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from reconcilia.operators import tables
from reconcilia.plans import statements
from reconcilia.schemas import OCR_TOKENS, PAGES, WORDS, schema
from reconcilia.sources.layouts import BUILT_IN, Layouts
from reconcilia.storage import saved, scratch

FILES = schema("file_id string, n_words long, n_pages long, n_tokens long")
STREAMS = {"words": WORDS, "pages": PAGES, "ocr_tokens": OCR_TOKENS}
COUNTS = ("words", "pages", "ocr_tokens", "want_words", "want_pages", "want_ocr_tokens")


def follow(spark: SparkSession, path: str, checkpoint: str, each: Callable[[DataFrame, int], None], form: str = "parquet", files_per_batch: int = 1000) -> StreamingQuery:
    """Runs ``each`` on every batch of new word files under ``path``, then stops; the checkpoint remembers what was read."""
    words = spark.readStream.format(form).schema(WORDS).option("maxFilesPerTrigger", files_per_batch).load(path)
    return words.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(spark: SparkSession, path: str, form: str = "parquet", files_per_batch: int = 1000) -> DataFrame:
    """file_id and how many words, pages and tokens of it came, and were announced: a stream of counts, never of texts."""

    def stream(name: str, kind) -> DataFrame:
        return spark.readStream.format(form).schema(kind).option("maxFilesPerTrigger", files_per_batch).load(f"{path}/{name}")

    none = {c: F.lit(0).cast("long").alias(c) for c in COUNTS}
    parts = [stream(n, kind).select("file_id", *(none | {n: F.lit(1).cast("long").alias(n)}).values()) for n, kind in STREAMS.items()]
    told = {f"want_{n}": F.col(c).alias(f"want_{n}") for n, c in zip(STREAMS, ("n_words", "n_pages", "n_tokens"), strict=True)}
    parts.append(stream("files", FILES).select("file_id", *(none | told).values()))
    return reduce(DataFrame.unionByName, parts)


def _complete(key: tuple[str], some: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The file's id once all that was announced has come; until then the sums."""
    now, told = list(state.get) if state.exists else [0] * 6 + [0], False
    for rows in some:
        now[:6] = [a + int(b) for a, b in zip(now[:6], rows[list(COUNTS)].sum(), strict=True)]
        told |= bool((rows[["want_words", "want_pages", "want_ocr_tokens"]].sum(axis=1) > 0).any())
    now[6] = int(now[6] or told)
    if now[6] and all(have >= want for have, want in zip(now[:3], now[3:6], strict=True)):
        if state.exists:
            state.remove()
        yield pd.DataFrame({"file_id": [key[0]]})
    else:
        state.update(tuple(now))


def completed(counts: DataFrame) -> DataFrame:
    """A stream of the ids of files that are complete, each once."""
    kept = ", ".join(f"{c} long" for c in (*COUNTS, "announced"))
    return counts.where("file_id IS NOT NULL").groupBy("file_id").applyInPandasWithState(_complete, "file_id string", kept, "append", "NoTimeout")


def process_files(spark: SparkSession, ids: DataFrame, path: str, sink: str, batch: str, known: Layouts = BUILT_IN, form: str = "parquet") -> int | None:
    """One batch of complete files from their folders into the sink; the version, or None if the batch is in one already."""
    store, keys = tables.Versions(spark, f"{sink}/tables"), tables.KeyDimension(spark, f"{sink}/keys")
    if batch in store.manifest()["batches"]:
        return None
    with scratch(spark):
        mine = saved(ids.select("file_id").distinct())
        part = {n: saved(spark.read.format(form).schema(kind).load(f"{path}/{n}").join(mine, "file_id", "left_semi")) for n, kind in STREAMS.items()}
        out = statements.process(part["words"], part["pages"], part["ocr_tokens"], known)
        parsed = out.identified.where(F.col("bank_key").isin(*known.known())).select("file_id", "bank_key")
        files = mine.join(parsed.withColumn("parsed", F.lit(True)), "file_id", "left").select("file_id", F.col("file_id").alias("input_ord"), F.coalesce("parsed", F.lit(False)).alias("parsed"), "bank_key")
        numbered = saved(keys.assign(files, batch).withColumn("file_name", F.col("file_id")))
        made = tables.normalised(numbered, out.account, out.products, out.summary, out.movements)
        return store.commit(made | {"validaciones": out.validations, "rechazos": out.rejects}, batch, append=True)


def follow_statements(spark: SparkSession, path: str, sink: str, checkpoint: str, known: Layouts = BUILT_IN, form: str = "parquet", files_per_batch: int = 1000) -> StreamingQuery:
    """Processes every file under ``path`` (folders words, pages, ocr_tokens, files) that is complete, batch by batch, then stops."""

    def each(batch: DataFrame, number: int) -> None:
        process_files(batch.sparkSession, batch, path, sink, f"batch {number}", known, form)

    ready = completed(arrivals(spark, path, form, files_per_batch))
    return ready.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
