"""The queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reconcilia.llm import chain_toxicity, edit_fst, exact_trie, hd_langid, head_tail, html_diff, hyperminhash, importance, line_dedup, mixing, telephony, unigram_pieces, url_cascade
from reconcilia.llm.common import table


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page. Null or empty html gives empty text."""
    return html_diff.main_text(table(spark, sf_dir, "pages"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, target and words taken of every document. Null text: size 0; null source: the last source."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document by 3-word shingles at 85 %. Null and empty texts are alone."""
    return hyperminhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, share=85)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every text, and proof that they decode to it. Null texts have none."""
    return unigram_pieces.encoded(table(spark, sf_dir, "documents"), columns=["doc_id"])


def op5_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weight of every document, and whether it is among those resampled. Null texts weigh 0."""
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every text as telephony audio, from the stored bytes. Null counts as empty."""
    return telephony.features(telephony.stored(table(spark, sf_dir, "documents")))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of equal texts of every document; the largest id stays. Null counts as empty."""
    return exact_trie.exact_dedup(table(spark, sf_dir, "documents"), keep="max")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of each toxicity category for every document. Null and empty texts are never flagged."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    categories = {
        "low_quality": F.col("quality") == 0,
        "toxic": F.col("toxic") == 1,
    }
    model = chain_toxicity.learn(docs, labels, categories)
    found = chain_toxicity.scored(docs, model, list(categories))
    return found.withColumn("flagged", F.col("toxic") >= 0.35)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from two thirds of the ids. Null texts and texts without a letter: und."""
    docs = table(spark, sf_dir, "documents")
    held_out = hd_langid.fold(F.col("doc_id")) == 1
    model = hd_langid.learn(docs.where(~held_out))
    return hd_langid.identify(docs.select("doc_id", "text", held_out.alias("held_out")), model).drop("text")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without duplicate lines, and how many of each kind went. Null texts have no lines."""
    cleaned = line_dedup.without_duplicate_lines(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "text", "n_lines", "n_same", "n_near", "n_short")


def op11_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document for a tenth drawn towards the benchmark's words. Null texts weigh 0."""
    return head_tail.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the vocabulary with its form and root. Null texts have no words."""
    found = edit_fst.variants(table(spark, sf_dir, "documents"))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


#: Host, beginning of the path, verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url; URLs that no rule fits are allowed. Null urls have an empty host and path."""
    return url_cascade.decided(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_main_text,
        op2_mix_sources,
        op3_near_dedup,
        op4_sentencepiece,
        op5_importance,
        op6_telephony,
        op7_exact_dedup,
        op8_toxicity,
        op9_language_id,
        op10_line_dedup,
        op11_target_resampling,
        op12_spelling_variants,
        op13_url_filter,
    )
}

EXACT_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(text) AS text_sha256
FROM d WINDOW w AS (PARTITION BY text)
"""

URL_SQL = """
WITH rules(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS u FROM pages),
p AS (SELECT page_id, coalesce(translate(regexp_extract(u, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(u, '^[^/?#]*([^?#]*)', 1), '') AS path FROM a),
n AS (SELECT *, row_number() OVER () AS i FROM p),
m AS (SELECT i, arg_max({'r': r.host || r.path, 'v': verdict}, length(r.host || r.path)) AS best FROM n JOIN rules r ON (n.host = r.host OR ends_with(n.host, '.' || r.host)) AND starts_with(n.path, r.path) GROUP BY 1)
SELECT page_id, host, path, best.r AS rule, coalesce(best.v, 'allow') AS verdict FROM n LEFT JOIN m USING (i)
"""

ORACLE_SQL: dict[str, str] = {"op10_line_dedup": line_dedup.LINE_SQL, "op2_mix_sources": mixing.MIX_SQL, "op7_exact_dedup": EXACT_SQL}
ORACLE_SQL |= {"op11_target_resampling": head_tail.RESAMPLE_SQL, "op12_spelling_variants": edit_fst.VARIANT_SQL, "op13_url_filter": URL_SQL}
