"""The pipeline's stages: on the smallest tables, and against plain versions on a small one."""

import random
from collections import Counter

from plain import brute_lines, bundle, components_of, fold, language, mixed

import corpus_pipeline as pipeline
from reconcilia.llm import mixing, unigram_pieces
from reconcilia.llm.common import saved, table


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in pipeline.STAGES:
        before, docs = docs, saved(stage(spark, docs, sf))
        counts.append(docs.count())
        if name != "encode_pieces":
            assert docs.columns == columns
        if name == "mix_sources":
            assert docs.join(before, "doc_id", "left_anti").count() == 0
            assert docs.groupBy("doc_id").count().where(f"count > {mixing.MAX_EPOCHS + 1}").isEmpty()
    assert docs.where("NOT round_trip").isEmpty()
    assert counts[1] > 0.95 * counts[0] and counts[3] <= counts[2] <= counts[1]


def corpus():
    """Documents with exact and near copies, shared and near lines, texts without letters, and one very long text."""
    rng = random.Random(21)
    words = {"en": "the of and to in that with this house river stone from were had".split(), "fr": "le la de que les une dans pour sur été maison pierre avec".split()}
    rows = []
    for i in range(36):
        lang = ("en", "fr")[i % 2]
        lines = [" ".join(rng.choices(words[lang], k=rng.randrange(3, 16))) for _ in range(rng.randrange(1, 5))]
        rows.append((i, "\n".join(lines), lang))
    for i in range(36, 48):
        k = rng.randrange(36)
        w = rows[k][1].split()
        for _ in range(i % 3):
            w[rng.randrange(len(w))] = "new"
        rows.append((i, "\n".join(" ".join(w[n : n + 5]) for n in range(0, len(w), 5)), rows[k][2]))  # in other lines, which are all new
    rows += [(48, None, "en"), (49, "", None), (50, "12 !?", "fr"), (51, " ".join(rng.choices(words["en"], k=5000)), "en"), (52, "All rights reserved.\nAll rights reserved.", "en"), (53, "All rights reserved.", "en")]
    return [(i, t, g, [None, "a", "b"][i * i % 3], len(t or "")) for i, t, g in rows]


def test_plain_pipeline(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(pipeline.STAGES)
    step = lambda name, df: saved(stages[name](spark, df, "/nowhere"))
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}

    one = step("language_id", df)
    prototypes = {g: sum(bundle(t) for i, t, own, *_ in rows if own == g and t is not None and fold(i) != 1) for g in ("en", "fr")}
    kept = [r for r in rows if language(r[1], prototypes)[1] > 0]
    assert texts(one) == {r[0]: r[1] for r in kept} and 48 not in texts(one)

    two = step("line_dedup", one)
    gone = brute_lines([r[:2] for r in kept], 8)
    left = {i: [x for k, x in enumerate(t.split("\n")) if (i, k) not in gone] for i, t, *_ in kept}
    want = {i: "\n".join(x) for i, x in left.items() if x}
    assert texts(two) == want and all(r["n_chars"] == len(r["text"]) for r in two.collect())

    three = step("near_dedup", two)
    ids = sorted(want)
    alone = {ids[k] for k, root in enumerate(components_of([want[i] for i in ids], 5, 80)) if root == k}
    assert set(texts(three)) == alone and len(alone) < len(ids)

    four = step("mix_sources", three)
    source = {r[0]: r[3] for r in rows}
    plan = mixed([(i, source[i], want[i]) for i in alone])
    assert Counter((r["doc_id"], r["text"]) for r in four.collect()) == Counter((i, t) for i, some in plan.items() for t in some)

    five = step("encode_pieces", four)
    own = unigram_pieces.vocabulary(unigram_pieces.VOCABULARY)
    assert Counter((r["doc_id"], own.decode(r_ids(r))) for r in five.collect()) == Counter((r["doc_id"], r["text"]) for r in four.collect())


def r_ids(row):
    import numpy as np

    return np.asarray(row["piece_ids"], np.int32)
