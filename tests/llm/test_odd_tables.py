"""Every operator and stage on tables with nulls in any column, repeated ids, empty tables and columns whose names clash."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from reconcilia.llm import chain_toxicity, edit_fst, exact_trie, hd_langid, head_tail, html_diff, hyperminhash, importance, line_dedup, mixing, telephony, unigram_pieces, url_cascade
from reconcilia.llm.common import saved

CLASHING = (
    "target score lang_pred n_lines n_same n_near n_short size key row place edge part whole taken id component component_id kept keep_id body words line first media resampled feature "
    "a.b _maybe _part _bit _map _key _doc _guess h1 h2 quality toxic y host path lines ranks n_shingles n_bytes piece_ids log_weight"
).split()
BASE = ["doc_id", "text", "lang", "source", "n_chars"]
LINE = "this line has nine words and then some more"
ROWS = [
    (1, f"{LINE}\n{LINE} here", "en", "a", 3), (2, f"{LINE}\nother", "en", None, 3), (2, "the same id with another text and several words", "en", "a", 3), (2, f"{LINE}\nother", None, "b", None),
    (None, None, None, None, None), (None, f"{LINE} there", "en", "a", 1), (3, "", "fr", "a", 0), (4, " \n\n ", "fr", "b", 0), (5, "12 !?", "fr", "b", 0), (6, "le chat est sur la table et la porte est ouverte", "fr", "b", 9),
    (7, "le chat est sur la table et la porte est ouverte", "fr", "b", 9), (8, " ".join(f"mot{i}" for i in range(4000)), "fr", "c", 9), (9, f"{LINE}\nother", "en", "a", 3),
]
LABELS = "doc_id long, quality int, toxic int"


def documents(spark, empty=False):
    df = spark.createDataFrame([] if empty else ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return df.select("*", *(F.lit("clash").alias(c) for c in CLASHING))


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, 0), (6, 1, None), (None, 1, 1), (9, None, 0), (9, 1, 0)], LABELS)


def toxicity(spark, df):
    categories = {"low": F.col("quality") == 0, "bad": F.col("toxic") == 1}
    return chain_toxicity.scored(df, chain_toxicity.learn(df, labels(spark), categories), list(categories))


#: Operators that give one row for each row of the table.
SAME_ROWS = {
    "mix": lambda s, d: mixing.mix(d), "near": lambda s, d: hyperminhash.near_duplicates(d, 5, 80), "pieces": lambda s, d: unigram_pieces.encoded(d, columns=["doc_id"]), "importance": lambda s, d: importance.resample(d, labels(s)),
    "telephony": lambda s, d: telephony.features(telephony.stored(d)), "exact": lambda s, d: exact_trie.exact_dedup(d), "toxicity": toxicity, "language": lambda s, d: hd_langid.identify(d, hd_langid.learn(d)), "lines": lambda s, d: line_dedup.without_duplicate_lines(d),
    "target": lambda s, d: head_tail.resample(d, d.limit(2)), "urls": lambda s, d: url_cascade.decided(d, s.createDataFrame([("h", "/", "block")], "host string, path string, verdict string"), url="text", keep=("doc_id",)),
}


@pytest.mark.parametrize("empty", [False, True])
@pytest.mark.parametrize("name", SAME_ROWS)
def test_operator(spark, name, empty):
    df = documents(spark, empty)
    got = SAME_ROWS[name](spark, df)
    rows = got.collect()
    ids = lambda rows: sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in rows)
    assert len(set(got.columns)) == len(got.columns) and ids(rows) == ([] if empty else ids(df.select("doc_id").collect()))


@pytest.mark.parametrize("empty", [False, True])
def test_pages(spark, empty):
    rows = [(1, "http://h/a", "<p>x</p>"), (1, "http://h/a", "<p>x</p>"), (None, None, None), (2, "::", ""), (3, "http://h/b", "<p>y " + "z " * 50_000)]
    df = spark.createDataFrame([] if empty else rows, "page_id long, url string, html string").select("*", *(F.lit("clash").alias(c) for c in CLASHING))
    got = html_diff.main_text(df).collect()
    assert sorted(r["n_chars"] for r in got) == ([] if empty else [0, 0, 1, 1, 100_001])


@pytest.mark.parametrize("empty", [False, True])
def test_words(spark, empty):
    """One row for each word, whatever the table's other columns."""
    got = edit_fst.variants(documents(spark, empty)).collect()
    assert bool(got) != empty and len({r["word"] for r in got}) == len(got) and all(r["root"] for r in got)


@pytest.mark.parametrize("empty", [False, True])
@pytest.mark.parametrize(("name", "stage"), pipeline.STAGES)
def test_stage(spark, name, stage, empty):
    df = documents(spark, empty)
    got = saved(stage(spark, df, "/nowhere"))
    if name != "encode_pieces":
        assert got.columns == df.columns
        assert got.where(" OR ".join(f"`{c}` IS NULL OR `{c}` <> 'clash'" for c in CLASHING)).isEmpty()
    assert got.isEmpty() == empty
    ids = {r["doc_id"] for r in got.select("doc_id").collect()}
    assert empty or ids == {"language_id": {None, 1, 2, 6, 7, 8, 9}, "line_dedup": {None, 2, 3, 4, 5, 6, 8}, "near_dedup": {None, 1, 3, 4, 5, 6, 8, 2}}.get(name, ids)


def test_repetition_agrees(spark):
    """As many words as ``mix`` says but for the documents at an edge, which come whole or not at all, for repeated and null ids too."""
    rows = [(i % 7 if i % 5 else None, "w " * (1 + i % 9), s) for i, s in enumerate(["a"] * 40 + ["b"] * 9 + [None] * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    words = lambda df, size: {(r["doc_id"], r["source"]): r["n"] for r in df.groupBy("doc_id", "source").agg(F.sum(size).alias("n")).where("n > 0").collect()}
    mixed, given = mixing.mix(df), mixing.repeated(df)
    part = F.when(2 * F.col("part") >= F.col("size"), F.col("size")).otherwise(0)
    assert words(mixed, F.col("whole") * F.col("size") + part) == words(given, mixing.size_of(F.col("text")))
    assert {r["text"] for r in given.select("text").collect()} <= {t for _, t, _ in rows}
    per = mixed.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.count("*").alias("n"), F.max(F.col("taken") - 3 * F.col("size")).alias("over")).collect()
    assert all(abs(r["t"] - r["g"]) <= r["n"] and r["over"] <= 0 for r in per)
