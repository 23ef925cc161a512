"""Lines and their texts for batches of page rows: what is done once, and odd pages."""

import pyarrow as pa
from pyspark.sql import functions as F

from reconcilia import views
from reconcilia.functions import concepts, text
from reconcilia.operators import lines, movements
from reconcilia.sources import layouts


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_patterns_meet_a_text_once(spark):
    """Also inside a branch, where nullif would make its argument twice and what that is made of four times."""
    df = spark.createDataFrame([("a1", True), ("a", True), ("a1", False), (None, True)], "c string, ok boolean")
    out = df.select(F.when(F.col("ok"), concepts.clean(text.found(F.col("c"), r"(\d)"))).alias("x"))
    assert plan_of(out).count("regexp_extract") == 1
    assert [r["x"] for r in out.collect()] == ["1", None, None, None]


def test_odd_spaces_and_dashes(spark):
    odd = ["a\u00a0b", " a \t b\n", "a\u00a0", "–a—", "a b", " ", None, "\u2007 x", "a\u00a0 b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i int, t string")
    got = [r["x"] for r in df.select("i", text.word_text(F.col("t")).alias("x")).orderBy("i").collect()]
    assert got == ["a b", "a b", "a", "-a-", "a b", "", "", "x", "a b"]


def test_statements_are_printed_once(spark, sf):
    """Words and OCR tokens read the printed table and not orders again."""
    printed = spark.createDataFrame([("1", 1, 1, "x", 1.0, 2.0, 3.0, 4.0, 5.0), ("5", 1, 1, "y", 1.0, 2.0, 3.0, 4.0, 5.0)], "file_id string, seq long, page int, text string, x0 double, x1 double, top double, bottom double, doctop double")
    words, _, tokens = views.every_statement(spark, sf, printed)
    assert "orders" not in plan_of(words) and {r["text"] for r in words.collect()} == {"x"}
    assert {r["text"] for r in tokens.where("token_idx >= 0 AND file_id = '5'").collect()} == {"y"}


def test_lines_are_cut_once(spark):
    """Own column bounds come with the lines' places: no second cut, and columns without interpreted loops over words."""
    known = layouts.BUILT_IN.only(["banamex"])
    words = spark.createDataFrame([("a", "banamex", 1, 1, "x", 1.0, 2.0, 3.0, 4.0, 5.0)], "file_id string, bank_key string, seq long, page int, text string, x0 double, x1 double, top double, bottom double, doctop double")
    placed = movements.placed_pages(movements.trimmed_pages(words, known), words, known)
    plan = plan_of(movements.column_texts(placed, known))
    assert plan.count("word_places(") == plan.count("titled_bounds(") == 1 and "lambda w" not in plan.split("MapInArrow")[0]


def page(*words):
    """(line, x0, x1, text, marks) by x0."""
    return sorted(words, key=lambda w: w[1])


def batch(pages, bounds, slack=0.0, first_line=False):
    part = lambda i: [[w[i] for w in p] for p in pages]
    n = len(pages)
    return pa.RecordBatch.from_pydict({
        "file_id": ["a"] * n, "bank_key": ["b"] * n, "page": pa.array(range(1, n + 1), pa.int32()), "place": pa.array(part(0), pa.list_(pa.int32())), "bounds": pa.array([bounds] * n, pa.list_(pa.float64())),
        "slack": pa.array([slack] * n, pa.float64()), "first_line": [first_line] * n,
        "words": pa.array([[{"x0": w[1], "x1": w[2], "text": w[3], "marks": w[4]} for w in p] for p in pages], pa.list_(pa.struct([("x0", pa.float64()), ("x1", pa.float64()), ("text", pa.string()), ("marks", pa.int32())]))),
    })


def test_texts_of_odd_pages():
    """Pages without words, empty words, roles without bounds, and which of several amounts and dates counts."""
    roles = layouts.ROLES
    own = {"fecha_operacion": (0, 10), "concepto": (10, 50), "cargo": (60, 80)}
    bounds = [x for r in roles for x in own.get(r, (None, None))]
    two = page((2, 0.0, 9.0, "d", 32), (2, 11.0, 20.0, "c", 0), (2, 21.0, 30.0, "", 0), (2, 45.0, 55.0, "e", 0), (2, 50.0, 65.0, "7", 64), (2, 66.0, 79.0, "8", 64), (2, 70.0, 80.0, "no", 0), (1, 5.0, 6.0, "", 0), (1, 7.0, 8.0, "t", 3 * movements.TITLE), (1, 8.0, 9.0, "t", 3 * movements.TITLE))
    assert [b.num_rows for b in movements.cut_lines([batch([[]], bounds)])] == [0]
    one, other = next(iter(movements.cut_lines([batch([[], two], bounds)]))).to_pylist()
    assert (one["page"], one["line_no"], other["line_no"]) == (2, 2 * lines.LINES + 1, 2 * lines.LINES + 2) and (one["line"], one["titles"], one["overs"], one["first_over"], one["dated"]) == ("t t", 1, 0, None, None)
    assert (other["line"], other["dated"], other["fecha_operacion_text"], other["concepto_text"], other["fecha_liquidacion_text"]) == ("d c e 7 8 no", "d", "d", "c e", "")
    assert (other["overs"], other["first_over"], other["rest_over"], other["cargo"], other["abono"]) == (2, "c", "e", "8", None)
    whole = next(iter(movements.cut_lines([batch([two], bounds, first_line=True)]))).to_pylist()[1]
    assert (whole["cargo"], whole["abono"]) == ("8 no", "")


def test_bounds_from_titles():
    """The last line with four names counts, the first of equal names in it; what has no name keeps the layout's own."""
    head = lambda i: (i + 1) * movements.HEAD
    full = [(1, 10.0 + 100 * i, 20.0 + 100 * i, head(i)) for i in range(5)] + [(1, 450.0, 460.0, head(4))]
    later = [(2, 12.0 + 100 * i, 22.0 + 100 * i, head(i)) for i in range(4)]
    few = [(3, 1.0, 2.0, head(i)) for i in range(3)]
    args = lambda *pages: [pa.array([[w[i] for w in p] for p in pages], t) for i, t in ((0, pa.list_(pa.int32())), (1, pa.list_(pa.float64())), (2, pa.list_(pa.float64())), (3, pa.list_(pa.int32())))]
    base = [float(i) for i in range(2 * len(layouts.ROLES))]
    made = movements.titled_bounds.func(*args(full, full + later + few, few, [], full), pa.array([True] * 4 + [False]), pa.array([base] * 5, pa.list_(pa.float64()))).to_pylist()
    at = lambda p, role: tuple(p[2 * layouts.ROLES.index(role) :][:2])
    assert (at(made[0], "concepto"), at(made[0], "cargo"), at(made[0], "abono"), at(made[0], "saldo_operacion")) == ((25.0, 205.0), (6.0, 265.0), (265.0, 365.0), (365.0, 11.0))
    assert at(made[1], "concepto") == (27.0, 207.0) and at(made[1], "cargo") == (6.0, 7.0)  # the later line has no SALDO
    assert made[2] == made[3] == made[4] == base
