"""The training-data operators against plain versions on small tables with nulls, empties, ties and clashing columns."""

import base64
import hashlib
import random
import time
import tracemalloc
import zlib

import duckdb
import numpy as np
import pytest
from plain import best_score, brute_lines, components_of, shingles
from pyspark.sql import functions as F

from reconcilia.llm import chain_toxicity, exact_trie, hd_langid, html_diff, hyperminhash, importance, line_dedup, mixing, queries, telephony, unigram_pieces

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, key string"
LONG = " ".join(f"word{i}" for i in range(3000))
TEXTS = [
    None, "", " \n ", "one", "one two", "the cat sat on the mat and looked at the dog again", "the cat sat on the mat and looked at the dog again", "the cat sat on the mat and looked at a dog again",
    "first line of nine words here is right now\nsecond line of nine words here is right now", "first line of nine words here is right now\nother", LONG, LONG + " tail", "ünïcode ▁ marker\x00 😀", "x" * 5000,
]


def docs(spark, texts=TEXTS):
    rows = [(i, t, "en" if i % 2 else "fr", [None, "a", "b"][i % 3], len(t or ""), "clash", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def test_exact(spark):
    df = docs(spark)
    got = {r["doc_id"]: r for r in exact_trie.exact_dedup(df).collect()}
    groups = {}
    for i, t in enumerate(TEXTS):
        groups.setdefault(t or "", []).append(i)
    for t, ids in groups.items():
        for i in ids:
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"], got[i]["text_sha256"]) == (max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest())
    assert exact_trie.exact_dedup(df.limit(0)).count() == 0


@pytest.mark.parametrize(("prefix", "size", "limit"), [(b"", 12, 4000), (b"p" * 80, 12, 4000), (b"", 300, 20000), (b"ab" * 100, 0, 1000)])
def test_trie_spills(prefix, size, limit):
    rng = random.Random(1)
    texts = [prefix[: rng.choice([len(prefix), len(prefix), rng.randrange(len(prefix) + 1)])] + bytes(rng.choices(b"ab", k=rng.randrange(0, size + 1))) for _ in range(3000)]
    want = {}
    for i, t in enumerate(texts):
        want[t] = (min(i, want.get(t, (i, 0))[0]), want.get(t, (0, 0))[1] + 1)
    trie, most = exact_trie.Patricia(min, limit), 0
    for i, t in enumerate(texts):
        trie.add(t, i)
        most = max(most, trie.size)
    assert trie.spilled and most <= limit + max(map(len, texts)) + 2 * exact_trie.NODE_BYTES
    found = list(trie.items())
    assert len(found) == len(want) and {t: (o, n) for t, o, n in found} == want


def test_trie_memory():
    """Short texts, of which nodes are most of the cost, and long ones with a common start: a task stays near its limit."""
    for texts in ([b"%012d" % (7919 * i) for i in range(60_000)], [b"x" * 80 + b"%0300d" % (7919 * i) for i in range(20_000)]):
        tracemalloc.start()
        trie = exact_trie.Patricia(min, 4 << 20)
        for i, t in enumerate(texts):
            trie.add(t, i)
        n = sum(1 for _ in trie.items())
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert n == len(texts) and peak < 3 * (4 << 20)


def test_mixing(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 50)), "en", s, 0, "", "") for i, s in enumerate(["big"] * 400 + ["mid"] * 100 + ["tiny"] * 5 + [None] * 60)]
    df = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(df).collect()
    per = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        s = per.setdefault(r["source"], [0, 0, r["target"], r["source_size"]])
        s[0] += r["taken"]
        s[1] += r["size"]
    total = sum(s[1] for s in per.values())
    assert abs(sum(s[2] for s in per.values()) - total) < 1e-6 * total
    for taken, size, target, source_size in per.values():
        assert size == source_size and target <= 3 * size + 1e-9 and abs(taken - target) <= 1
    mixed = mixing.repeated(df)
    assert mixed.columns == df.columns
    edges = {r["source"]: r for r in got if 0 < r["part"] < r["size"]}  # the only document of a source that isn't given as often as it is taken: it comes whole or not at all
    for source, words in mixed.groupBy("source").agg(F.sum(mixing.size_of(F.col("text")))).collect():
        edge = edges.get(source)
        assert words == per[source][0] + (0 if edge is None else (edge["size"] if 2 * edge["part"] >= edge["size"] else 0) - edge["part"])
    assert mixing.mix(df.limit(0)).count() == 0


@pytest.mark.parametrize(("k", "share"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, k, share):
    rng = random.Random(k)
    texts = list(TEXTS)
    for _ in range(12):
        base = rng.choices("alpha beta gamma delta eps zeta eta theta iota kappa".split(), k=rng.randrange(20, 90))
        for edits in (0, 0, 1, 2, 4):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(len(w))] = rng.choice("new words in here".split())
            texts.append(" ".join(w))
    got = hyperminhash.near_duplicates(docs(spark, texts), k, share).orderBy("doc_id").collect()
    assert [r["component_id"] for r in got] == components_of(texts, k, share)
    assert [r["n_shingles"] for r in got] == [len(shingles(t, k)) for t in texts]


def test_lines(spark):
    base = "a line with some ten words in it for sure"
    texts = [f"{base}\nshort", f"{base}\n{base} more", base.replace("some", "other"), base.replace("some ten", "other nine").replace("sure", "all"), None, "", "x\n\ny"]
    got = {r["doc_id"]: r for r in line_dedup.without_duplicate_lines(docs(spark, texts)).collect()}
    assert [got[i]["text"] for i in range(7)] == [texts[0], "", "", texts[3], None, "", "x\n\ny"]
    assert (got[1]["n_same"], got[1]["n_near"], got[2]["n_near"], got[4]["n_lines"]) == (1, 1, 1, 0)
    assert line_dedup.without_duplicate_lines(docs(spark).limit(0)).count() == 0


def test_short_lines(spark):
    texts = ["Wh the.\nWh the.\n\nx", "\nx\nWh the!\n ", "Wh the.", " \n\n"]
    got = {r["doc_id"]: r for r in line_dedup.without_duplicate_lines(docs(spark, texts)).collect()}
    assert [got[i]["text"] for i in range(4)] == ["Wh the.\n\nx", "\nWh the!\n ", "", "\n"]
    assert [(got[i]["n_same"], got[i]["n_near"]) for i in range(4)] == [(1, 0), (1, 0), (1, 0), (1, 0)]


def test_lines_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = {r[0]: r[1:] for r in con.execute(f"SELECT doc_id, text, n_lines, n_same, n_near, n_short FROM ({line_dedup.LINE_SQL})").fetchall()}
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op10_line_dedup(spark, sf).collect()}
    assert got == want and any(r[2] and r[4] for r in got.values())


@pytest.mark.parametrize("least", [3, 8])
def test_lines_brute(spark, least):
    rng, words = random.Random(least), "ab cd ef gh ij kl".split()
    rows = [(None, "x y z\n\nab cd ef"), (None, None)]
    for i in range(60):
        made = []
        for _ in range(rng.randrange(1, 6)):
            n = rng.choice([1, 2, 3, 4, 7, 8, 9, 10, 15, 16, 17, 18, 33])
            w = [words[k * k % 5] for k in range(n)]
            for _ in range(rng.randrange(4)):
                k = rng.randrange(len(w) or 1)
                w[k : k + rng.choice([0, 1, 1])] = rng.choices(words, k=rng.choice([0, 1, 1]))
            made.append(" ".join(w))
        rows += [(i % 50, "\n".join(made))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(-1 if r["doc_id"] is None else r["doc_id"], r["place"]) for r in line_dedup.duplicate_lines(df, least).collect()}
    assert got == brute_lines(rows, least)


def test_language(spark):
    rng = random.Random(3)
    words = {"en": "the of and to in that with this", "fr": "le la de que les une dans être"}
    rows = [(i, " ".join(rng.choices(words[g].split(), k=30)), g) for i in range(80) for g in [("en", "fr")[i % 2]]] + [(80, None, "en"), (81, "123 !?", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = hd_langid.learn(df.where(hd_langid.fold(F.col("doc_id")) != 1))
    got = {r["doc_id"]: r for r in hd_langid.identify(df, model).collect()}
    assert all(got[i]["lang_pred"] == rows[i][2] and 0 <= got[i]["score"] <= 1 for i in range(80))
    assert got[80]["lang_pred"] == got[81]["lang_pred"] == "und"
    assert {r["lang_pred"] for r in hd_langid.identify(df, hd_langid.learn(df.limit(0))).collect()} == {"und"}


def test_telephony(spark):
    got = {r["doc_id"]: r for r in telephony.features(telephony.stored(docs(spark))).collect()}
    for i, t in enumerate(TEXTS):
        body = (t or "").encode()
        payload = body + bytes(64 - len(body) if not body else -len(body) % 64)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(body), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert got[5]["feature"] == got[6]["feature"]
    block = np.frombuffer(bytes(range(64)), np.uint8).reshape(1, -1)
    sample, index, out = 256, 2, [256]
    for byte in bytes(range(64))[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(telephony.steps()[index])
            diff = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            sample = max(-32768, min(32767, sample - diff if code & 8 else sample + diff))
            index = max(0, min(88, index + [-1, -1, -1, -1, 2, 4, 6, 8][code & 7]))
            out.append(sample)
    assert telephony.adpcm_pcm(block)[:, 0].tolist() == out
    assert (telephony.mulaw_table()[0xFF], telephony.mulaw_table()[0x00], telephony.alaw_table()[0xD5]) == (0, -32124, 8)


def test_pieces(spark):
    own = unigram_pieces.vocabulary(unigram_pieces.VOCABULARY)
    texts = [t for t in TEXTS if t is not None] + ["Hello  world, naïve façade 12345"]
    for t, ids in zip(texts, own.encode(texts), strict=True):
        assert own.decode(ids) == t
    for segment in unigram_pieces.cut("Hello  world, naive facade 12345"):
        ids = own.solve([segment])[0]
        assert abs(sum(own.scores[i] for i in ids) - best_score(own, segment)) < 1e-9
    rng = random.Random(8)
    for _ in range(100):  # the walk through long segments takes the way of the steps over many
        segment = unigram_pieces.MARKER + "".join(rng.choices("abcdetioning.中Ż🙂" + unigram_pieces.STAND_IN, k=rng.randrange(1, 90)))
        assert own.walk(segment).tolist() == own.solve([segment])[0].tolist()
    got = {r["doc_id"]: r for r in unigram_pieces.encoded(docs(spark)).collect()}
    assert got[0]["piece_ids"] is None and got[1]["piece_ids"] == [] and all(got[i]["round_trip"] for i in range(1, len(TEXTS)))


def test_pieces_without_spaces(spark):
    """Texts without spaces come back whole, and take no more than a few times as long as others."""
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(2, 9))) for _ in range(20_000)]
    texts = [" ".join(words), "".join(words), base64.b64encode(rng.randbytes(60_000)).decode(), "".join(chr(rng.randrange(0x4E00, 0x9FA6)) for _ in range(40_000)), unigram_pieces.MARKER * 3000, " " * 3000]
    own, per_character = unigram_pieces.vocabulary(unigram_pieces.VOCABULARY), []
    for t in texts[:4]:
        own.known.clear()
        start = time.process_time()
        own.encode([t])
        per_character.append((time.process_time() - start) / len(t))
    assert max(per_character) < 10 * per_character[0]  # 50 times, if each character were a numpy step of its own
    assert all(r["round_trip"] for r in unigram_pieces.encoded(docs(spark, texts)).collect())


def test_importance(spark):
    rng = random.Random(5)
    good, bad = "river stone cloud grass mountain".split(), "win cash now click here".split()
    texts = [" ".join(rng.choices(good if i % 4 else bad, k=40)) for i in range(200)] + [None, ""]
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(100)], "doc_id long, quality int")
    got = {r["doc_id"]: r for r in importance.resample(docs(spark, texts), labels).collect()}
    assert sum(r["kept"] for r in got.values()) == round(202 * 0.75)
    assert np.mean([got[i]["kept"] == (i % 4 > 0) for i in range(200)]) > 0.95
    ranked = sorted((r["key"] for r in got.values()), reverse=True)
    assert min(r["key"] for r in got.values() if r["kept"]) == ranked[round(202 * 0.75) - 1]


def test_toxicity(spark):
    rng = random.Random(6)
    plain, rude = "river stone cloud grass mountain bird tree sun".split(), "idiot moron".split()
    texts = [" ".join(rng.choices(plain, k=20) + (rng.choices(rude, k=2) if i % 3 == 0 else [])) for i in range(240)] + [None, ""]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(120)], "doc_id long, quality int, toxic int")
    categories = {"low": F.col("quality") == 0, "toxic": F.col("toxic") == 1}
    model = chain_toxicity.learn(docs(spark, texts), labels, categories)
    got = {r["doc_id"]: r for r in chain_toxicity.scored(docs(spark, texts), model, list(categories)).collect()}
    assert all((got[i]["toxic"] >= 0.5) == (i % 3 == 0) for i in range(240)) and got[240]["toxic"] < 0.5


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><div id="sidebar">side</div><div class="cookie-notice">We use</div><nav><ul><li>Home</ul></nav><article><h1>Title &amp; more</h1><p>One <b>bold</b>&nbsp;
 word<p>Two</p><script>var a="</p>"</script><section class="comments">nice</section></article><footer>&copy; x</footer></body>"""


def test_pages(spark):
    bare = "<div>Menu</div><div>{}</div><div>Contact us</div>"
    rows = [(0, "http://a.example/x/1", PAGE), (1, "http://a.example/x/2", None), (2, "http://b.example/1", bare.format("alpha text")), (3, "http://b.example/2", bare.format("beta text")), (4, None, "just text"), (5, "http://b.example/3", "")]
    got = {r["page_id"]: r for r in html_diff.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0]["text"] == "Title & more\nOne bold word\nTwo" and got[0]["n_chars"] == len(got[0]["text"])
    assert [got[i]["text"] for i in (1, 2, 3, 4, 5)] == ["", "alpha text", "beta text", "just text", ""]
    a, b = [rng % 4 for rng in (1, 2, 3, 5, 6, 7, 9)], [2, 3, 1, 1, 2, 0, 1]
    pairs = html_diff.common_subsequence(a, b)
    table = np.zeros((8, 8), int)
    for i in range(7):
        for j in range(7):
            table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
    assert len(pairs) == table[7, 7] and all(a[i] == b[j] for i, j in pairs)


def test_lines_that_repeat():
    """A longest common subsequence whatever repeats, also of many equal lines, and pages with very many open elements."""
    rng = random.Random(10)
    for _ in range(300):
        a, b = ([rng.randrange(k) for _ in range(rng.randrange(40))] for k in rng.choices((2, 3, 9, 30), k=1) * 2)
        pairs = html_diff.common_subsequence(a, b)
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, v in enumerate(a):
            for j, w in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if v == w else max(table[i, j + 1], table[i + 1, j])
        assert len(pairs) == table[-1, -1] and all(a[i] == b[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))
    start = time.process_time()
    assert len(html_diff.common_subsequence([2] + [1] * 40_000 + [3], [3] + [1] * 39_000 + [4])) == 39_000
    assert html_diff.page_lines("<div>" * 20_000 + "a</p>" * 20_000)[0] == ["a"] * 20_000
    assert html_diff.page_lines("<li>" + "<div>" * 20_000 + "a</li>" * 20_000)[0] == ["a"] * 20_000
    assert time.process_time() - start < 15  # minutes, if equal lines were paired one by one and open elements scanned
