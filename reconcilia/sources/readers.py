"""Words, pages and OCR tokens of statements, and what is derived from them on the way in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reconcilia.schemas import OCR_TOKENS, PAGES, WORDS

HEAD_PAGES = 5
FORMATS = ("parquet", "json", "orc", "csv")


def read(spark: SparkSession, kind: str, path: str, form: str = "parquet") -> DataFrame:
    """``kind``: words, pages or ocr_tokens. The schema is given, never inferred, so columns are pruned at the scan."""
    schema = {"words": WORDS, "pages": PAGES, "ocr_tokens": OCR_TOKENS}[kind]
    if form not in FORMATS:
        raise ValueError(f"no such format: {form}")
    return spark.read.format(form).schema(schema).load(path)


#: Coordinates of words, in reading order of their defaults.
COORDINATES = ("x0", "x1", "top", "bottom", "doctop")
KEYS = ("file_id", "seq", "page")


def quarantined(spark: SparkSession, path: str, form: str = "json", **options: str) -> tuple[DataFrame, DataFrame]:
    """Words of files that may hold anything, and the records that were refused: (words, rejects).

    Every value is read as a text and turned into its type afterwards, and a record that can't be read at all is kept whole, so
    nothing gets lost: a record is a word or a reject with a reason (a JSON array is as many records as it has elements). A word needs a file, a place in reading order and a page from 1
    on. Coordinates have defaults: what is no number is 0, a missing right or lower edge is that of the other side, and any other missing one 0;
    ``defaulted`` names those that got one. Rejects: file_id, reason (malformed, no_file, no_place, no_page), record (the source as JSON, or as it stands).
    Nothing is written: each of the two reads the files. CSV is read without pruning, as a record of the wrong length is only known from all of its columns.
    """
    kinds = {f.name: f.dataType.simpleString() for f in WORDS.fields}
    texts = T.StructType([T.StructField(n, T.StringType()) for n in (*kinds, "_corrupt")])
    lenient = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "columnPruning": "false"} | options
    raw = spark.read.format(form).schema(texts).options(**lenient).load(path)
    typed = {n: F.col(n).try_cast(kinds[n]) for n in KEYS}
    reason = F.when(F.col("_corrupt").isNotNull(), "malformed").when(F.coalesce(F.trim("file_id"), F.lit("")) == "", "no_file")
    reason = reason.when(typed["seq"].isNull(), "no_place").when(typed["page"].isNull() | (typed["page"] < 1), "no_page")
    judged = raw.withColumn("reason", reason)
    rejects = judged.where("reason IS NOT NULL").select("file_id", "reason", F.coalesce("_corrupt", F.to_json(F.struct(*kinds))).alias("record"))
    value = {c: F.nanvl(F.col(c).try_cast("double"), F.lit(None).cast("double")) for c in COORDINATES}
    zero = {c: F.coalesce(value[c], F.lit(0.0)) for c in COORDINATES}
    made = zero | {far: F.when(F.col(far).isNull(), zero[near]).otherwise(zero[far]) for far, near in (("x1", "x0"), ("bottom", "top"))}
    others = {n: F.col(n).try_cast(k) for n, k in kinds.items() if n not in COORDINATES}
    columns = [(made | others)[n].alias(n) for n in kinds]
    defaulted = F.array_compact(F.array(*(F.when(value[c].isNull(), c) for c in COORDINATES)))
    return judged.where("reason IS NULL").select(*columns, defaulted.alias("defaulted")), rejects


def sorted_text(keys: list[str], text: str, separator: str):
    """Texts of a group in the order of ``keys``, joined."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*keys, F.col(text).alias("_text")))), lambda x: x["_text"]), separator)


def head_text(pages: DataFrame, limit: int = HEAD_PAGES) -> DataFrame:
    """file_id, text: the non-empty texts of the first pages, by newline."""
    return pages.where((F.col("page") <= limit) & (F.col("text") != "")).groupBy("file_id").agg(sorted_text(["page"], "text", "\n").alias("text"))


def text_stage(pages: DataFrame, limit: int = HEAD_PAGES) -> DataFrame:
    """file_id, text, initial_empty_pages, has_text in one grouping."""
    filled = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", " ")) != ""
    head = F.when((F.col("page") <= limit) & (F.col("text") != ""), F.struct("page", "text"))
    return pages.groupBy("file_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(head)), lambda x: x["text"]), "\n").alias("text"),
        F.coalesce(F.min(F.when(filled, F.col("page"))) - 1, F.count("*")).cast("int").alias("initial_empty_pages"),
        F.bool_or(filled).alias("has_text"),
    )


def logical_pages(words: DataFrame, stage: DataFrame) -> DataFrame:
    """``words`` without the leading empty pages, pages numbered anew from 1."""
    skipped = stage.select("file_id", "initial_empty_pages")
    out = words.join(skipped, "file_id", "left").withColumn("initial_empty_pages", F.coalesce("initial_empty_pages", F.lit(0)))
    return out.where(F.col("page") > F.col("initial_empty_pages")).withColumn("page", F.col("page") - F.col("initial_empty_pages")).drop("initial_empty_pages")


def full_read(pages: DataFrame, words: DataFrame) -> DataFrame:
    """Words with their file's head text and its length, which is counted once a file."""
    return words.join(head_text(pages).select("file_id", F.col("text").alias("head_text"), F.length("text").alias("head_chars")), "file_id", "left")


def ocr_words(tokens: DataFrame) -> DataFrame:
    """Words of OCR tokens: blank ones dropped, pixels scaled to page points, doctop by the pages before."""
    order = Window.partitionBy("file_id").orderBy("page", "token_idx")
    filled, before = F.trim("text") != "", F.lag("page").over(order)
    # a page's first token adds the height of the page before; blank tokens count for heights, not for places
    ended = F.when(before != F.col("page"), F.lag("page_height").over(order))
    placed = tokens.withColumns({"_ended": ended, "_filled": F.coalesce(filled, F.lit(False)).cast("long")})
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumns({"offset": F.coalesce(F.sum("_ended").over(upto), F.lit(0.0)), "seq": F.sum("_filled").over(upto) - 1})
    scale = F.col("page_width") / F.col("image_width")
    words = placed.where(filled).withColumns({
        "text": F.trim("text"), "x0": F.col("left") * scale, "width": F.col("width") * scale, "y": F.col("top") * scale, "height": F.col("height") * scale,
        "confidence": F.coalesce(F.col("conf").try_cast("double"), F.lit(-1.0)), "upright": F.lit(True), "direction": F.lit("ltr"),
    })
    words = words.withColumns({"x1": F.col("x0") + F.col("width"), "top": F.col("y"), "bottom": F.col("y") + F.col("height")})
    return words.withColumn("doctop", F.col("offset") + F.col("top")).select("file_id", "seq", "page", "text", "x0", "x1", "top", "bottom", "doctop", "width", "height", "upright", "direction", "confidence")


def ocr_page_text(tokens: DataFrame, limit: int = HEAD_PAGES) -> DataFrame:
    """file_id, page, text of the first pages: a line for each (block, paragraph, line), words by spaces."""
    lines = tokens.where((F.trim("text") != "") & (F.col("page") <= limit)).withColumn("text", F.trim("text"))
    lines = lines.groupBy("file_id", "page", "block_num", "par_num", "line_num").agg(F.min("token_idx").alias("first"), sorted_text(["token_idx"], "text", " ").alias("line"))
    return lines.groupBy("file_id", "page").agg(sorted_text(["first"], "line", "\n").alias("text"))
