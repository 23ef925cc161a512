"""Whether a document's text or words can be used, and which way it is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reconcilia.functions.text import collapsed, nfkc
from reconcilia.storage import saved

# Glyphs that wrongly encoded fonts produce, and limits of the tests.
SUSPICIOUS = "ˆ˜¯ª˛˚˙¨´¸łøØıŒœŠšŽžƒ"
CID = r"(?i)\(cid:\d+\)"
WORDS = r"[A-Za-zÁÉÍÓÚÜÑáéíóúüñ]{2,}"
FIRST_WORDS = 500


def analysed(text: Column) -> Column:
    """Compatibility-composed and collapsed; nulls are empty."""
    return collapsed(F.coalesce(nfkc(text), F.lit("")))


def is_corrupt(t: Column) -> Column:
    """Tests on analysed text, in order: empty, CID tokens, odd glyphs, too few words and letters."""
    size = F.length(t)
    cids = F.regexp_count(t, F.lit(CID))
    odd = size - F.length(F.translate(t, SUSPICIOUS, ""))
    letters = F.length(F.regexp_replace(t, r"[^\p{L}\p{N}]", ""))
    printable = F.length(F.regexp_replace(t, r"[\p{C}\p{Z}]", "")) + F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit("")))
    return (
        F.when(size == 0, True)
        .when((cids == 1) & (size < 100), True)
        .when((cids > 0) & (cids * 8 / size >= 0.05), True)
        .when((odd > 0) & (letters == 0), True)
        .when(odd / size >= 0.08, True)
        .when((F.regexp_count(t, F.lit(WORDS)) < 2) & ((printable == 0) | (letters / size < 0.20)), True)
        .otherwise(False)
    )


def usable_text(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with usable."""
    return docs.withColumn("_t", analysed(F.col(text))).withColumn("usable", ~is_corrupt(F.col("_t"))).drop("_t")


def usable_words(words: DataFrame) -> DataFrame:
    """file_id, usable, from the first non-blank words of each file."""
    order = Window.partitionBy("file_id").orderBy("seq")
    first = words.where(F.trim("text") != "").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= FIRST_WORDS)
    texts = first.groupBy("file_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", F.trim("text").alias("w")))), lambda x: x["w"]), " ").alias("text"))
    return usable_text(texts).select("file_id", "usable")


def document_type(text_ok: Column, words_ok: Column) -> Column:
    return F.when(F.coalesce(text_ok, F.lit(False)) | F.coalesce(words_ok, F.lit(False)), "pdf_digital").otherwise("pdf_imagen")


def routed(stage: DataFrame, words: DataFrame) -> DataFrame:
    """file_id, initial_empty_pages, document_type, word_source.

    Text decides first. Where it fails but some page has text, the words decide; what is still an image
    is read by OCR, the rest from its words without the leading empty pages.
    """
    # written, as conditions on text_ok would otherwise be moved below it, with the whole analysis again in each
    first = saved(usable_text(stage).select("file_id", "initial_empty_pages", "has_text", F.col("usable").alias("text_ok")))
    doubtful = first.where("NOT text_ok AND has_text").select("file_id")
    if doubtful.isEmpty():  # no word is needed
        out = first.withColumn("words_ok", F.lit(None).cast("boolean"))
    else:
        out = first.join(usable_words(words.join(doubtful, "file_id", "left_semi")).withColumnRenamed("usable", "words_ok"), "file_id", "left")
    kind = document_type(F.col("text_ok"), F.col("words_ok"))
    return out.select("file_id", "initial_empty_pages", kind.alias("document_type"), F.when(kind == "pdf_digital", "words").otherwise("ocr").alias("word_source"))


def chosen_words(route: DataFrame, words: DataFrame, ocr: DataFrame) -> DataFrame:
    """Words of each file from the source that its route names."""
    columns = ["file_id", "seq", "page", "text", "x0", "x1", "top", "bottom", "doctop"]
    digital = words.join(route.where("word_source = 'words'").select("file_id", "initial_empty_pages"), "file_id")
    digital = digital.where(F.col("page") > F.col("initial_empty_pages")).withColumn("page", F.col("page") - F.col("initial_empty_pages"))
    image = ocr.join(route.where("word_source = 'ocr'").select("file_id"), "file_id", "left_semi")
    return digital.select(*columns).unionByName(image.select(*columns))
