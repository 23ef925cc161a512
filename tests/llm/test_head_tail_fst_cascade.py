"""Target resampling, spelling variants and URL rules against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from reconcilia.llm import edit_fst, head_tail, url_cascade
from reconcilia.llm.common import saved

TEXTS = ["The CAT sat on the mat été", None, "", "?? --", "cat " * 50, "a b\tc\n7 É é", "x" * 100_000, "the cat sat on " * 30, "the mat " * 12, "ünï 😀 the"]


def features(text, longest):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def drawn(docs, target, longest, least, buckets=10_000, percent=10):
    """(n_features, weight, score, rank) of each (doc_id, text)."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    own = [(i, *features(t, longest)) for i, t in docs]
    s = Counter(bucket(f) for _, _, fs in own for f in fs)
    t = Counter(bucket(f) for text in target for f in features(text, longest)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (big_s + buckets) / ((s[b] + 1.0) * (big_t + buckets))))
    rows = []
    for i, n, fs in own:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in fs)
        rows.append((i, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    place = {r: k + 1 for k, r in enumerate(able[: len(able) * percent // 100])}
    return sorted(((r[0], r[2], r[3], r[4], place.get(r)) for r in rows), key=str)


@pytest.mark.parametrize(("longest", "least", "percent"), [(1, 2, 50), (2, 1, 100), (3, 2, 70)])
def test_resampling(spark, monkeypatch, longest, least, percent):
    """Small slices and heads, so that runs cross cuts and both head and tail are used."""
    monkeypatch.setattr(head_tail, "SLICE", 7)
    monkeypatch.setattr(head_tail, "HEAD", 12)
    docs, target = [(i if i != 4 else None, t) for i, t in enumerate(TEXTS)], ["the cat", "mat mat été", None]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("weight", F.lit("clash"))
    got = head_tail.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), percent=percent, least_words=least, longest=longest)
    assert sorted((tuple(r) for r in got.collect()), key=str) == drawn(docs, target, longest, least, percent=percent)


def test_head_is_frequent_words(spark):
    """A third of all words is one word; the head holds it and no rare or long one, and values don't depend on it."""
    df = spark.createDataFrame([(f"common w{i} " + "y" * 80 + " common",) for i in range(300)], "text string")
    assert head_tail._frequent(head_tail._tallied(head_tail._bodies(df, "text"))) == [b"common"]
    bodies = [t.encode() for t in TEXTS if t]
    with_head, without = head_tail.Features([b"the", b"cat"], [(b"the", b"cat")], 2, 997), head_tail.Features([], [], 2, 997)
    for b in bodies:
        assert np.array_equal(np.concatenate([x for _, x in with_head.of(b)] or [[]]), np.concatenate([x for _, x in without.of(b)] or [[]]))


def test_ranks_are_global(spark):
    rows = [(i % 50, i) for i in range(4000)]
    got = head_tail.ranked(spark.createDataFrame(rows, "a long, b long").repartition(7), [F.desc("a"), F.asc("b")], "rank").collect()
    assert [(r["a"], r["b"]) for r in sorted(got, key=lambda r: r["rank"])] == sorted(rows, key=lambda r: (-r[0], r[1])) and sorted(r["rank"] for r in got) == list(range(1, 4001))


def near(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    short, long = sorted((x, y), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def grouped(docs, noise, letters, least, factor=2):
    """(word, n, n_near, form, form_n, root) of the vocabulary, by looking at all pairs."""
    n = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= letters and k >= least}
    others = {w: [x for x in n if near(w, x)] for w in n}
    best = {w: min(xs, key=lambda x: (-n[x], x)) for w, xs in others.items() if xs}
    form = {w: b for w, b in best.items() if n[b] >= factor * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, n[w], len(others[w]), form.get(w), n[form[w]] if w in form else None, root(w)) for w in n)


def words_of(seed, size):
    rng = random.Random(seed)
    stems = ["".join(rng.choices("abcé", k=rng.randrange(1, 7))) for _ in range(size)]
    return [(i if i % 9 else None, " ".join(rng.choices(stems, k=60)) + " Aé12bc aaaa AAAAA") for i in range(40)] + [(3, None), (4, ""), (5, "..")]


@pytest.mark.parametrize(("partition", "noise", "letters", "least"), [(3, 5, 1, 1), (20, 3, 2, 2), (10_000, 97, 1, 1), (1, 2, 3, 3)])
def test_variants(spark, partition, noise, letters, least):
    """From everything in one partition to states split at every branch."""
    docs = words_of(partition, 120)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("word", F.lit("clash"))
    got = edit_fst.variants(df, partition=partition, noise=noise, letters=letters, least=least)
    assert sorted((r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in got.collect()) == grouped(docs, noise, letters, least)


def test_long_words(spark):
    """Words of 3000 letters that share all but one, and words that are beginnings of others."""
    words = ["ab" * 1500, "ab" * 1499 + "b", "ab" * 1500 + "a"] + ["c" * k for k in range(5, 25)]
    df = saved(spark.createDataFrame([(w, i + 1) for i, w in enumerate(words)], "word string, n long"))
    for partition in (1, 1000):
        got = {r["word"]: r["n_near"] for r in edit_fst.near_words(df, partition).collect()}
        assert got == {w: sum(near(w, x) for x in words) for w in words}


def test_acceptor_is_minimal():
    words = sorted(a + b for a in ("be", "de", "re", "un") for b in ("aring", "earing", "wearing"))
    machine = edit_fst.Acceptor(words)
    assert sorted(machine.common(machine.root, machine.root)) == words
    rests = {(w[:k], tuple(sorted(x[k:] for x in words if x.startswith(w[:k])))) for w in words for k in range(len(w) + 1)}
    assert len(machine.arcs) == len({r for _, r in rests})
    assert sorted(map(sorted, machine.pairs())) == sorted([x, y] for i, x in enumerate(words) for y in words[i + 1 :] if near(x, y))


def test_roots_follow_chains(spark):
    """A chain of 40 forms ends in one root for all."""
    df = saved(spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(40)], "word string, form string"))
    assert {(r["word"], r["root"]) for r in edit_fst.roots(df).collect()} == {(f"w{i}", "w40") for i in range(40)}


URLS = [
    "http://A.Example.org/en/1?x", "https://example.org/en/12", "https://xexample.org/en/1", "http://org/", "http://org", "http://b.com/fr/", "http://b.com/FR/", "http://b.com/de/x#y", "http://com/de/", "ftp://n.net/a", None, "", "no scheme", "http://", "http://?x", "a://b://c/", "http://.com/fr/a",
    "http://" + "a." * 400 + "example.org/es/" + "p" * 20_000, "http://é.org/ñ", "http://user@h.org:80/x y?z", "http://x\n.org/en/1", "http://example.org/en/1/deep", "http://www.example.org/en/9",
]
RULES = [("org", "/", "allow"), ("Example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("example.org", "/en/1/deep", "allow"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("com", "/de/", "allow"), ("n.net", "a", "block"), (None, "/", "block"), ("net", None, "block"), ("com", "/x", None), ("é.org", "/ñ", "block")]


def judged(url, rules, otherwise):
    host = path = ""
    if url and "://" in url:
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in rules if h and p and p[0] == "/" and v for h in [h.lower()] if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, _, _, rule, verdict = max(fits, default=(0, 0, 0, None, otherwise))
    return host, path, rule, verdict


@pytest.mark.parametrize("limit", [url_cascade.LIMIT, 0])
def test_url_rules(spark, monkeypatch, limit):
    """By the cascades, and beyond their limit by a join."""
    monkeypatch.setattr(url_cascade, "LIMIT", limit)
    df = spark.createDataFrame([(i % 20, u) for i, u in enumerate(URLS + URLS[:2])], "page_id long, url string").withColumn("rule", F.lit("clash"))
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = url_cascade.decided(df, rules, "block")
    want = [(i % 20, *judged(u, RULES, "block")) for i, u in enumerate(URLS + URLS[:2])]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
    assert url_cascade.decided(df.limit(0), rules).isEmpty() and {r["verdict"] for r in url_cascade.decided(df, rules.limit(0)).collect()} == {"allow"}


def test_cascade_is_exact(spark):
    """Several levels, as the first one lets many keys pass; every key of the universe is told right."""
    universe = saved(spark.range(60_000).selectExpr("concat('k', id) AS key"))
    listed = universe.where("substr(key, -2) IN ('07', '11')")
    cascade = url_cascade.cascade_of(listed, universe)
    rows = universe.select("key", *url_cascade.hashed(F.col("key"))).toPandas()
    assert len(cascade.levels) > 3 and sum(len(x[2]) for x in cascade.levels) < 60_000
    assert np.array_equal(cascade.lists(rows["h1"].to_numpy(), rows["h2"].to_numpy()), rows["key"].str[-2:].isin(["07", "11"]).to_numpy())
