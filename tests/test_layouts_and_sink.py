"""Layout rows, numeric defaults, numbering over pages, typed reading, and tables that change together."""

import json
import random
import shutil
import unicodedata
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from reconcilia import views
from reconcilia.functions import text
from reconcilia.operators import lines, movements, quality, tables, trimming
from reconcilia.plans import statements
from reconcilia.sources import layouts, readers
from reconcilia.schemas import WORDS
from reconcilia.storage import saved, scratch

WORD = "file_id string, seq long, page int, text string, x0 double, x1 double, top double, bottom double, doctop double"


def places(df):
    return [r["line_no"] % lines.LINES for r in df.orderBy("seq").collect()]


def test_missing_coordinates(spark):
    """A word without a top stands at 0, on a line of its own; one in the middle glues nothing together. A missing edge is the other one."""
    tops = [None, 10.0, 11.0, float("nan"), 300.0, 301.0]
    df = spark.createDataFrame([("f", i, 1, "a", float(i), i + 1.0, t, None if t is None else t + 1, t) for i, t in enumerate(tops)], WORD)
    assert places(lines.anchored_lines(df)) == [1, 2, 2, 1, 3, 3] and places(lines.fixed_mean_lines(df)) == [1, 2, 2, 1, 3, 3] and places(lines.fixed_mean_lines(df, by_doctop=True)) == [1, 2, 2, 1, 3, 3]
    assert trimming.without_banorte_footer(df).count() == 6
    odd = spark.createDataFrame([("4.5", None, "x", "9"), (None, "3", "7", None)], "x0 string, x1 string, top string, bottom string")
    got = odd.select(lines.center_x(), lines.center_y(), lines.height()).collect()
    assert [tuple(r) for r in got] == [(4.5, 4.5, 9.0), (1.5, 7.0, 0.0)]


def test_lines_take_one_exchange(spark, sf):
    """Words are dealt out by page once; the doctop rule, the mean rule and the column texts need no other exchange of words."""
    pages = lines.page_rows(views.words(spark, sf))
    both = lines.line_rows(pages, lambda w: w["doctop"], lines.middle, F.lit(3.5), F.lit(True)).unionByName(lines.line_rows(pages, lines.middle, lines.middle, F.lit(3.5), F.lit(True)))
    one = lines.line_rows(pages, lines.middle, lines.middle, F.lit(3.5), F.lit(True))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and both.count() == 2 * one.count()


def test_numbers_over_pages(spark):
    """One file holds a third of all lines, on more pages than a chunk has; blocks and ordinals go on over pages and chunks."""
    rng = random.Random(3)
    rows = [(f, p, p * lines.LINES + i, rng.random() < 0.3) for f, pages in (("hot", 2500), *((f"f{k}", 50) for k in range(100))) for p in range(1, pages + 1) for i in range(1, 3)]
    df = saved(spark.createDataFrame(rows, "file_id string, page int, line_no long, start boolean"))
    want, count = [], {}
    for f, _, n, start in sorted(rows, key=lambda r: (r[0], r[2])):
        count[f] = count.get(f, 0) + start
        if count[f]:
            want.append((f, n, count[f]))
    got = movements.blocks(df, F.col("start"))
    assert sorted((r["file_id"], r["line_no"], r["block_id"]) for r in got.collect()) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "windowspecdefinition(file_id" in plan and all("line_no" not in w.split("specifiedwindowframe")[0] or "page" in w.split("line_no")[0] for w in plan.split("windowspecdefinition(")[1:])


def test_bank_from_a_folder(spark, sf, tmp_path):
    """A bank that the package doesn't know, from files that Spark reads; the known banks stay as they are."""
    shutil.copytree(Path(layouts.__file__).parent / "data" / "santander", tmp_path / "bank")
    known = layouts.BUILT_IN.plus(layouts.read(spark, f"file://{tmp_path}/bank"))
    assert known.rows == layouts.BUILT_IN.plus(layouts.packaged("santander")).rows and known.known() == ["bbva", "banamex", "banorte", "santander"]
    words, pages = views.fourth_statements(spark, sf)
    some = saved(words.where("file_id IN ('1', '2', '4')"))
    out = statements.process(some, pages.where("file_id IN ('1', '2', '4')"), known=known)
    assert {r["bank_key"] for r in out.identified.collect()} == {"santander"} and out.rejects.isEmpty()
    assert {r["file_id"] for r in out.account.where("numero_cuenta IS NOT NULL").collect()} == {r["file_id"] for r in out.movements.collect()} != set()
    assert {r["reason"] for r in statements.process(some, pages).rejects.collect()} == {"bank_not_supported"}


def test_quarantine(spark, tmp_path):
    records = [
        {"file_id": "f", "seq": 1, "page": 1, "text": "a", "x0": "1.5", "top": None, "bottom": "abc"}, {"file_id": "f", "seq": "2", "page": "1", "text": None, "x0": 1, "x1": 2, "top": 3, "bottom": 4, "doctop": 5, "confidence": "0.5", "upright": True},
        {"file_id": "", "seq": 1, "page": 1}, {"seq": 1, "page": 1}, {"file_id": "f", "page": 1}, {"file_id": "f", "seq": 3, "page": "one"}, {"file_id": "f", "seq": 3, "page": 0},
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join([*map(json.dumps, records), '{"file_id": "f", "seq"', "x[]"]) + "\n")
    words, rejects = readers.quarantined(spark, f"file://{tmp_path}/in")
    got = {r["seq"]: r for r in words.collect()}
    assert (got[1]["x0"], got[1]["x1"], got[1]["top"], got[1]["bottom"], got[1]["doctop"], got[1]["defaulted"]) == (1.5, 1.5, 0.0, 0.0, 0.0, ["x1", "top", "bottom", "doctop"])
    assert (got[2]["x1"], got[2]["doctop"], got[2]["confidence"], got[2]["upright"], got[2]["defaulted"]) == (2.0, 5.0, 0.5, True, []) and len(got) == 2
    assert sorted(r["reason"] for r in rejects.collect()) == ["malformed", "malformed", "no_file", "no_file", "no_page", "no_page", "no_place"]
    assert {r["record"] for r in rejects.where("reason = 'malformed'").collect()} == {'{"file_id": "f", "seq"', "x[]"}


def test_tables_change_together(spark, tmp_path):
    """A writer that stops between tables changes nothing that a reader sees, nor does a batch that comes again; the slower of two writers fails."""
    store = tables.Versions(spark, f"file://{tmp_path}/sink")
    made = lambda v: {n: spark.createDataFrame([(v, "x")], "`No. de A` int, b string") for n in ("one", "two", "a name of far more than thirty-one characters")}
    seen = lambda: {n: (df.columns, [r[0] for r in df.orderBy("b").collect()]) for n, df in store.tables().items()}
    assert store.tables() == {} and store.commit(made(1), "b1") == 1
    before = seen()
    assert before == {n: (["No. de A", "b"], [1]) for n in made(1)}
    broken = made(2) | {"two": made(2)["two"].withColumn("b", F.raise_error(F.lit("stop")).cast("string"))}
    with pytest.raises(Exception, match="stop"):
        store.commit(broken, "b2")
    assert seen() == before and store.commit(made(3), "b1") is None and seen() == before
    other = tables.Versions(spark, f"file://{tmp_path}/sink")
    numbers, other.numbers = other.numbers(), lambda: numbers
    assert store.commit(made(4), "b2", append=True) == 2 and seen()["one"][1] == [1, 4]
    with pytest.raises(RuntimeError, match="another writer"):
        other.commit(made(5), "b3")
    assert store.tables(1)["one"].count() == 1 and store.commit(made(6)) == 3 and seen()["one"][1] == [6]
    assert store.vacuum(keep=1) > 0 and store.numbers() == [3] and seen()["one"][1] == [6]


def test_marks_and_composition(spark):
    """Every letter of the basic plane loses its marks as by canonical decomposition; compatibility composition is Python's, in texts of any kind."""
    letters = [c for c in map(chr, range(0xC0, 0x3000)) if c.isalpha() and not 0x1100 <= ord(c) < 0x1200 and len(c.upper()) == 1]
    df = spark.createDataFrame([(c,) for c in letters], "c string")
    wrong = [(r["c"], r["x"]) for r in df.select("c", text.canonical(F.concat(F.lit("x"), "c")).alias("x")).collect() if r["x"] != "X" + "".join(y for y in unicodedata.normalize("NFD", r["c"].upper()) if unicodedata.category(y) != "Mn")]
    assert len(wrong) < 12, wrong  # letters that only one of the two runtimes has an upper case for
    rng = random.Random(6)
    texts = ["".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x300, 0xD7FF), rng.randrange(0xF900, 0x1FFFF)])) for _ in range(12)) for _ in range(3000)] + ["plain text, ñ é", None, "", "é", "ﬁ ½ ａ"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.nfkc(F.col("t")).alias("x")).collect()
    assert all(r["x"] == (None if r["t"] is None else unicodedata.normalize("NFKC", r["t"])) for r in got)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_words_dealt_by_file_meet_without_an_exchange(spark, sf):
    """Documents are dealt out by file while whole: lines, OCR words, their pages' texts and the first words of a file need no other exchange."""
    words, tokens = views.words(spark, sf, by_file=True), views.ocr_tokens(spark, sf)
    for df in (lines.anchored_lines(words), lines.page_rows(words), readers.ocr_words(tokens), readers.ocr_page_text(tokens), quality.usable_words(words)):
        assert exchanges(df) == 1
    assert exchanges(readers.ocr_words(tokens.repartition(3))) == 2


def test_quarantine_writes_nothing(spark, tmp_path):
    """Words and rejects are read from the files; a record cut short is a reject also where few columns are read, in JSON and in CSV."""
    (tmp_path / "j").write_text('{"file_id": "f", "seq": 1, "page": 1, "text": "a", "x0": 1}\n{"file_id": "f", "seq": \n')
    names = "file_id,file_name,seq,page,text,x0,x1,top,bottom,doctop,width,height,upright,direction,confidence,_corrupt"
    (tmp_path / "c").write_text("f,,1,1,a,1,2,3,4,5,,,,,\nf,,2\n")
    assert names.startswith(",".join(f.name for f in WORDS.fields))
    with scratch(spark) as made:
        for form in ("json", "csv"):
            words, rejects = readers.quarantined(spark, f"file://{tmp_path}/{form[0]}", form)
            assert words.select("file_id").count() == 1 and [r["reason"] for r in rejects.select("reason").collect()] == ["malformed"]
        assert made == []


def test_ocr_places_over_pages(spark):
    """Blank tokens have no place; a page's height counts for the pages behind it once, also where it holds blank tokens only."""
    rows = [("f", p, 1, 1, 1, i, t, 300, 0, 60, 10, "-", 2550, 612.0, h) for i, (p, t, h) in enumerate([(1, "a", 700.0), (1, " ", 700.0), (2, "  ", 50.5), (3, "b", 800.0), (3, "c", 800.0)])]
    kinds = "file_id string, page int, block_num int, par_num int, line_num int, token_idx int, text string, left int, top int, width int, height int, conf string, image_width int, page_width double, page_height double"
    got = readers.ocr_words(spark.createDataFrame(rows, kinds)).orderBy("seq").collect()
    assert [(r["seq"], r["text"], r["doctop"]) for r in got] == [(0, "a", 0.0), (1, "b", 750.5), (2, "c", 750.5)]


def test_stable_characters():
    """What is left out of the look at the list of unstable characters is not on it."""
    assert all(unicodedata.is_normalized("NFKC", chr(c)) and unicodedata.combining(chr(c)) == 0 for c in (*range(0xA0), *range(0xC0, 0x100)))
    assert text.UNSTABLE.startswith(f"[^{text.STABLE}]&&")


def test_routes_are_analysed_once(spark, sf):
    """The analysis of texts is written before conditions on it are asked."""
    plan = quality.routed(readers.text_stage(views.odd_pages(spark, sf)), views.words(spark, sf))._jdf.queryExecution().optimizedPlan().toString()
    assert [line for line in plan.splitlines() if "Relation" in line and "text_ok" in line] and "initial_empty_pages, has_text" not in plan


def test_words_are_sorted_by_their_own_order(spark, sf):
    """Arrays of words are sorted without a comparing function, which is called in interpreted code at each comparison."""
    rows = lines.line_rows(lines.page_rows(views.words(spark, sf)), lines.middle, lines.middle, F.lit(3.5), F.lit(True))
    assert "array_sort(" not in rows._jdf.queryExecution().optimizedPlan().toString()
