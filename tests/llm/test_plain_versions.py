"""Weights, chains, cosines and audio against plain versions, value by value."""

import math
import random
import struct
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from plain import bundle, language
from pyspark.sql import functions as F

from reconcilia.llm import chain_toxicity, hd_langid, html_diff, hyperminhash, importance, telephony

WORDS = "river stone cloud grass mountain bird win cash now click here tree".split()


def test_importance_weights(spark):
    rng = random.Random(8)
    texts = {i: " ".join(rng.choices(WORDS[:8] if i % 3 else WORDS[4:], k=rng.randrange(0, 30))) for i in range(60)} | {60: None, 61: "River RIVER river"}
    good = {i for i in range(40) if i % 3}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i in good)) for i in range(40)], "doc_id long, quality int")
    grams = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        grams[i] = Counter([(x,) for x in w] + list(zip(w, w[1:], strict=False)))
    raw, target = sum(grams.values(), Counter()), sum((grams[i] for i in good), Counter())
    scale, s = sum(target.values()) / sum(raw.values()), importance.SMOOTHING
    ratio = {g: math.log((target[g] + s) / (n * scale + s)) for g, n in raw.items()}
    got = {r["doc_id"]: r for r in importance.resample(df, labels).collect()}
    for i, c in grams.items():
        assert got[i]["n_grams"] == sum(c.values()) and abs(got[i]["log_weight"] - sum(n * ratio[g] for g, n in c.items())) < 1e-9


def test_language_cosines(spark):
    rows = [(0, "The cat, the DOG 12 and", "en"), (1, "le chat et la ñ été", "fr"), (2, "the and of", "en"), (3, "la la le", "fr"), (4, "Ωmega the", "en"), (5, "?", "fr")]
    languages = {g: sum(bundle(t) for _, t, own in rows if own == g) for g in ("en", "fr")}
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for r in hd_langid.identify(df, hd_langid.learn(df)).collect():
        name, score = language(rows[r["doc_id"]][1], languages)
        assert r["lang_pred"] == name and abs(r["score"] - score) < 1e-5


def test_toxicity_chain(spark):
    rng = random.Random(9)
    texts = {i: " ".join(rng.choices(WORDS, k=12) + (["idiot!!"] if i % 4 == 0 else [])) for i in range(90)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 > 0), int(i % 4 == 0)) for i in range(70)], "doc_id long, quality int, toxic int")
    categories = {"low": F.col("quality") == 0, "bad": F.col("toxic") == 1}
    model = chain_toxicity.learn(df, labels, categories)
    weights = {(int(c), int(f)): w for c, f, w in model.itertuples(index=False)}
    features = {i: [f for w in set(chain_toxicity.TOKEN.findall(t.lower())) for f in chain_toxicity.word_features(w)] for i, t in texts.items()}
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    for r in chain_toxicity.scored(df, model, list(categories)).collect():
        chances = []
        for c, name in enumerate(categories):
            x = weights[c, -1] + sum(weights.get((c, f), 0) for f in features[r["doc_id"]]) + sum(weights.get((c, -2 - k), 0) * p for k, p in enumerate(chances))
            chances.append(sigmoid(x))
            assert abs(r[name] - chances[-1]) < 1e-9
    # the first category's weights are where the penalised loss has no slope
    slope, own = Counter(), [f for c, f in weights if c == 0 and f >= 0]
    for i in range(70):
        error = sigmoid(weights[0, -1] + sum(weights.get((0, f), 0) for f in features[i])) - (i % 5 == 0)
        slope.update({f: n * error for f, n in Counter(features[i]).items()})
    assert all(abs(slope[f] + weights[0, f]) < 0.02 for f in own)


def test_out_of_fold():
    """A later category learns from probabilities of models that have not seen the row, so an earlier label that is noise gets little weight."""
    rng = random.Random(10)
    noise = np.array([[rng.randrange(2)] * 2 for _ in range(200)])
    found, _ = chain_toxicity.fit_chain(np.array([rng.randrange(chain_toxicity.FOLDS) for _ in noise]), [np.array([i + 1]) for i in range(200)], noise, 500)
    assert abs({(c, f): w for c, f, w in found}.get((1, -2), 0)) < 1


def test_noise_stays_noise():
    """Labels that are pure noise, with far more features than are chosen: held-out probabilities tell nothing."""
    rng = np.random.default_rng(4)
    n = 1200
    ids, y, fold = [rng.integers(0, 20_000, 150) for _ in range(n)], rng.integers(0, 2, (n, 1)), rng.integers(0, chain_toxicity.FOLDS, n)
    _, held_out = chain_toxicity.fit_chain(fold, ids, y, 1500)
    order, yes = np.argsort(np.argsort(held_out[:, 0])), y[:, 0] == 1
    auc = (order[yes].sum() - yes.sum() * (yes.sum() - 1) / 2) / (yes.sum() * (~yes).sum())
    assert 0.45 <= auc <= 0.55


def test_fold_probabilities():
    """Each fold's probabilities against a model that is fitted from the other folds' rows alone."""
    rng = np.random.default_rng(5)
    n, features = 240, 12
    ids = [rng.choice(40, 9) for _ in range(n)]
    y = np.array([[int(3 in i) ^ int(rng.random() < 0.1), int(3 in i or 7 in i)] for i in ids])
    fold = rng.integers(0, 3, n)
    _, held_out = chain_toxicity.fit_chain(fold, ids, y, features)
    earlier = np.zeros((n, 0))
    for c in range(2):
        want = np.empty(n)
        for k in range(3):
            train = [i for i in range(n) if fold[i] != k]
            count = {f: [sum(f in ids[i] for i in train if y[i, c] == v) + 0.5 for v in (1, 0)] for f in range(40)}
            total = [sum(y[i, c] == v for i in train) for v in (1, 0)]
            odds = {f: math.log(a / (total[0] + 1 - a)) - math.log(b / (total[1] + 1 - b)) for f, (a, b) in count.items()}
            strength = {f: abs(odds[f]) / math.sqrt(1 / a + 1 / b) if a + b >= 5 else 0 for f, (a, b) in count.items()}
            best = sorted(sorted(count, key=lambda f: (-strength[f], f))[:features])
            x = np.column_stack([[[list(i).count(f) for f in best] for i in ids], earlier])
            want[fold == k] = chain_toxicity.chances(x, chain_toxicity.logistic(x[train].astype(float), y[train, c]))[fold == k]
        assert np.allclose(held_out[:, c], want)
        earlier = np.column_stack([earlier, want])


def test_long_words_are_not_remembered():
    """Texts without spaces leave nothing in a worker: 3000 words of 100 kB in each cache stay under 2 MB."""
    tracemalloc.start()
    scores = chain_toxicity.WordScores({})
    for i in range(3000):
        word = f"{i}" + "x" * 100_000
        hyperminhash.HASHES[word.encode()]
        scores[word]
    kept, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert kept < 2e6 and not scores and not any(len(w) > hyperminhash.LONGEST for w in hyperminhash.HASHES)
    hyperminhash.HASHES.update((b"%d" % i, i) for i in range(10))
    list(hyperminhash.tidied(lambda batches: batches)(iter([])))
    assert not hyperminhash.HASHES


def mulaw(code):
    code = ~code & 0xFF
    size = (((code & 0x0F) << 3) + 0x84) << ((code & 0x70) >> 4)
    return 0x84 - size if code & 0x80 else size - 0x84


def alaw(code):
    code ^= 0x55
    size, segment = (code & 0x0F) << 4, (code & 0x70) >> 4
    size = size + 8 if segment == 0 else (size + 0x108) << (segment - 1)
    return size if code & 0x80 else -size


@pytest.mark.parametrize("text", ["", "a", "x" * 64, "ünï" * 50, "\x00\x7f" * 100])
def test_audio(spark, text):
    body = text.encode()
    payload = body + bytes(64 if not body else -len(body) % 64)
    row = telephony.stored(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert telephony.wave_samples(row["media"]) == payload
    pcm = [mulaw(c) for c in payload]
    want = [v for k, x in enumerate(pcm) for v in (x, (x + (pcm[k + 1] if k + 1 < len(pcm) else x)) >> 1)]
    assert telephony.wave_samples(row["resampled"], telephony.PCM_FORMAT) == struct.pack(f"<{len(want)}h", *want)
    assert struct.unpack_from("<I", row["resampled"], 24)[0] == 16000
    words = dict(w.split("=") for w in telephony.feature_rows([row["media"]], [row["resampled"]])[0][-1].split())
    for name, level in (("mu", mulaw), ("a", alaw)):
        levels = [level(c) for c in payload]
        assert words[name] == f"{sum(v * v for v in levels) // len(levels)}:{max(map(abs, levels))}"


def longest(a, b):
    """Places of a longest common subsequence, by the plain table; it is unique in the pages below."""
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            t[i][j] = t[i + 1][j + 1] + 1 if a[i] == b[j] else max(t[i + 1][j], t[i][j + 1])
    i = j = 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            yield i, j
            i, j = i + 1, j + 1
        elif t[i + 1][j] >= t[i][j + 1]:
            i += 1
        else:
            j += 1


def test_site(spark):
    """A site of pages without content elements: what neighbours share goes, copies are no evidence, and hosts don't mix."""
    rng, pages = random.Random(12), {}
    for host, top in (("a.example", ["Home", "About us", "Contact"]), ("b.example", ["Start", "Our shop"])):
        for i in range(9):
            own = [f"{host} {i} " + " ".join(rng.choices(WORDS, k=8)) for _ in range(rng.randrange(1, 4))]
            pages[host, f"/p{i}"] = top + own + [f"All rights of {host}"]
    pages["a.example", "/p3x"] = list(pages["a.example", "/p3"])
    rows = [(k, f"http://{h}{p}", "".join(f"<div>{x}</div>" for x in lines)) for k, ((h, p), lines) in enumerate(pages.items())]
    gone = {k: set() for k in pages}
    for host in ("a.example", "b.example"):
        order, other = sorted(k for k in pages if k[0] == host), None
        for before, now in zip(order, order[1:], strict=False):
            if pages[before] == pages[now]:
                before = other
            else:
                other = before
            for i, j in longest(pages[before], pages[now]):
                gone[before].add(i)
                gone[now].add(j)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(1)
    got = {r["page_id"]: r for r in html_diff.main_text(df.coalesce(1)).collect()}
    for k, (key, lines) in enumerate(pages.items()):
        assert got[k]["text"] == "\n".join(x for i, x in enumerate(lines) if i not in gone[key]), key
        assert got[k]["n_shared"] == len(gone[key]) > 0 and got[k]["n_other"] == 0


def test_elements():
    """Which lines of a page are its article, by elements and names."""
    cases = {
        "<article class='post sponsored'><p>a</article>": ["a"], "<article class=post><p>a<article class='comment post'>b</article></article>": ["a"], "<main><p>lead</p><article>a</article></main>": ["a"],
        "<div class='has-sidebar'><p>a</div><div class=sidebar>b</div>": ["a"], "<p>a<br>b  c\n d<p>e<script>x</script>f": ["a b c d", "ef"], "<div hidden>x</div>&lt;b&gt; &#233;": ["<b> é"], "<!-- a --><p>b<!-- c": ["b"],
    }
    for page, want in cases.items():
        lines, ranks = html_diff.page_lines(page)
        top = max(0, *ranks)
        assert [x for x, r in zip(lines, ranks, strict=True) if r == top] == want, page
