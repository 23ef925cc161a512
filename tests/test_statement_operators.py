"""Small word tables through lines, sources and checks."""

import numpy as np
from pyspark.sql import functions as F

from reconcilia import storage, views
from reconcilia.functions import money
from reconcilia.operators import lines, reconcile, tables, trimming
from reconcilia.plans import statements
from reconcilia.sources import readers
from reconcilia.streaming import intake


def words(spark, rows):
    """(page, text, x0, top) rows of one file, words 8 high and 10 wide."""
    made = [("f", i, p, t, float(x), float(x) + 10, float(y), float(y) + 8, (p - 1) * 792.0 + y) for i, (p, t, x, y) in enumerate(rows)]
    return spark.createDataFrame(made, "file_id string, seq long, page int, text string, x0 double, x1 double, top double, bottom double, doctop double")


def places(df):
    return [r["line_no"] % lines.LINES for r in df.orderBy("seq").collect()]


def test_line_rules(spark):
    tops = [10.0, 12.5, 13.4, 20.0]
    assert places(lines.anchored_lines(words(spark, [(1, "a", i, y) for i, y in enumerate(tops)]))) == [1, 1, 2, 3]
    assert places(lines.fixed_mean_lines(words(spark, [(1, "a", i, y) for i, y in enumerate([6.0, 9.0, 11.1])]))) == [1, 1, 2]
    assert places(lines.fixed_mean_lines(words(spark, [(1, "a", i, y) for i, y in enumerate([6.0, 9.0, 10.9])]))) == [1, 1, 1]


def test_line_starts_word_by_word():
    """The fold by stretches equals the plain one, for pages in order and out of order."""
    rng = np.random.default_rng(4)
    for k in range(60):
        page = rng.random(80) < 0.1
        page[0] = True
        y = np.round(np.cumsum(rng.choice([0, 0, 0.5, 1.5, 3, 9], 80)) + (rng.normal(0, 2, 80) if k % 2 else 0), 1)
        tolerance = np.full(80, [3.0, 3.5, 4.05][k % 3])
        for running_mean in (False, True):
            want, line = [], []
            for i in range(80):
                level = sum(line) / len(line) if line and running_mean else line[0] if line else 0
                if page[i] or abs(y[i] - level) > tolerance[i]:
                    line = []
                want.append(not line)
                line.append(y[i])
            assert lines.line_starts(page, y, tolerance, running_mean).tolist() == want


def test_skipped_lines(spark):
    """A continuing line passes over the next of its page, which then passes over none."""
    flags = "c c c x d c x | c x c c x".split()
    rows, page = [], 1
    for i, f in enumerate(flags):
        page += f == "|"
        if f != "|":
            rows.append(("f", page, i, f == "d", f == "c"))
    df = spark.createDataFrame(rows, "file_id string, page int, line_no long, is_date boolean, is_continuation boolean")
    got = [r["skipped"] for r in trimming.passed_over(df).orderBy("line_no").collect()]
    want, skip, on = [], False, 0
    for _, p, _, date, again in rows:
        skipped = skip and p == on
        want.append(skipped)
        skip, on = not skipped and not date and again, p
    assert got == want and any(got)


def test_rates_keep_their_decimals(spark):
    assert spark.range(1).select(money.rate(F.lit("1, 2.375"))).first()[0] == 12.375


def test_text_stage(spark):
    pages = spark.createDataFrame([("f", i + 1, t) for i, t in enumerate(["", " ", "A", "", "B"])] + [("g", 1, "")], "file_id string, page int, text string")
    got = {r["file_id"]: (r["initial_empty_pages"], r["has_text"]) for r in readers.text_stage(pages).collect()}
    assert got == {"f": (2, True), "g": (1, False)}


def test_ocr_scale(spark):
    row = ("f", 1, 1, 1, 1, 0, "x", 300, 0, 60, 10, "-", 2550, 612.0, 792.0)
    tokens = spark.createDataFrame([row], "file_id string, page int, block_num int, par_num int, line_num int, token_idx int, text string, left int, top int, width int, height int, conf string, image_width int, page_width double, page_height double")
    got = readers.ocr_words(tokens).first()
    assert (round(got["x0"], 6), round(got["x1"], 6), got["confidence"]) == (72.0, 86.4, -1.0)


def test_end_marker(spark):
    df = words(spark, [(3, "antes", 10, 390), (3, "TOTAL", 20, 400), (3, "DE", 50, 400), (3, "MOVIMIENTOS", 70, 400), (4, "x", 10, 10)])
    assert [r["text"] for r in trimming.cut_at(df, trimming.end_marker(df)).collect()] == ["antes"]


def test_checks(spark):
    moves = spark.createDataFrame([(1, 1, None, 100.0, 0.0, 0.0), (1, 2, None, 50.0, 80.0, 0.0), (2, 1, None, 150.0, 80.0, 0.0)], "statement_id long, numero_movimiento int, cargo double, abono double, saldo_operacion double, saldo_liquidacion double")
    money = [c for c in moves.columns if c not in ("statement_id", "numero_movimiento")]
    moves = moves.select("statement_id", "numero_movimiento", *(F.col(c).cast("decimal(18,2)").alias(c) for c in money))
    sums = spark.createDataFrame([(1, 100.0, 150.01, 30.0, 80.0), (2, 100.0, None, 30.0, 80.0)], "statement_id long, saldo_anterior double, depositos_abonos double, retiros_cargos double, saldo_final double")
    sums = sums.select("statement_id", *(F.col(c).cast("decimal(18,2)").alias(c) for c in sums.columns[1:]))
    got = {(r["statement_id"], r["orden"]): (r["diferencia"], r["correcto"]) for r in reconcile.validations(moves, sums).collect()}
    assert float(got[1, 1][0]) == -0.01 and got[1, 1][1]
    assert float(got[1, 3][0]) == 0 and got[1, 3][1]
    assert got[2, 1] == (None, None) and got[2, 4] == (None, None)


def test_header_union_and_sink(spark, tmp_path):
    a = spark.createDataFrame([(1, 2)], "a int, b int")
    b = spark.createDataFrame([(3, 4)], "b int, c int")
    union = tables.header_union([a, b])
    assert union.columns == ["a", "b", "c"]
    paths = tables.write({"Datos de la Cuenta": union}, str(tmp_path))
    assert spark.read.parquet(paths[0]).count() == 2


def test_process_reads_every_kind(spark, sf):
    """One statement as it is, behind 2 and 6 blank pages, as an image with OCR tokens, and as an image without."""
    printed = views.statement_words(spark, sf, "bbva")
    one = printed.select("file_id").first()[0]
    rows = printed.where(F.col("file_id") == one).collect()
    columns = "seq long, page int, text string, x0 double, x1 double, top double, bottom double, doctop double"
    digital = [(f"blank{k}", r["seq"], r["page"] + k, *r[3:8], r["doctop"] + 792 * k) for k in (0, 2, 6) for r in rows]
    last = max(r["page"] for r in rows)
    head = "CLABE 012" + one.zfill(15)
    pages = [(f"blank{k}", p, head if p == k + 1 else "" if p <= k else "movimientos del mes") for k in (0, 2, 6) for p in range(1, last + k + 1)]
    pages += [(f, p, "") for f in ("scan", "nothing") for p in range(1, last + 1)]
    tokens = [("scan", r["page"], 1, 1, r["seq"], r["seq"], r["text"], *(round(100 * v) for v in (r["x0"], r["top"], r["x1"] - r["x0"], 8)), "90", 61200, 612.0, 792.0) for r in rows]
    tokens += [("scan", 1, 0, 1, -1, i - 9, t, 100 * (10 + 30 * i), 200, 2000, 800, "90", 61200, 612.0, 792.0) for i, t in enumerate(["CLABE", head[6:]])]
    out = statements.process(
        spark.createDataFrame(digital, f"file_id string, {columns}"), spark.createDataFrame(pages, "file_id string, page int, text string"), 
        spark.createDataFrame(tokens, "file_id string, page int, block_num int, par_num int, line_num long, token_idx long, text string, left int, top int, width int, height int, conf string, image_width int, page_width double, page_height double"),
    )
    kinds = {r["file_id"]: (r["document_type"], r["bank_key"]) for r in out.identified.collect()}
    assert kinds == {f"blank{k}": ("pdf_digital", "bbva") for k in (0, 2, 6)} | {"scan": ("pdf_imagen", "bbva"), "nothing": ("pdf_imagen", None)}
    assert [tuple(r) for r in out.rejects.collect()] == [("nothing", "bank_not_identified")]
    for table in (out.account, out.summary):
        got = {r["file_id"]: {k: v for k, v in r.asDict().items() if k != "file_id"} for r in table.collect()}
        assert set(got) == {"blank0", "blank2", "blank6", "scan"} and any(got["blank0"].values())
        assert got["blank2"] == got["blank6"] == got["scan"] == got["blank0"]


def test_scratch(spark):
    """Tables of a scratch go at its end, but for those taken out."""
    with storage.scratch(spark) as made:
        kept = storage.written(spark.range(3))
        gone = storage.saved(spark.range(4))
        made.remove(kept)
    assert spark.read.parquet(kept).count() == 3
    try:
        gone.count()
        raise AssertionError("still there")
    except Exception as e:
        assert "still there" not in str(e)


def test_stream(spark, sf, tmp_path):
    """Files of words as they come, each batch through the lines of its documents."""
    words = views.words(spark, sf).limit(500).selectExpr("file_id", "CAST(NULL AS STRING) AS file_name", "seq", "page", "text", "x0", "x1", "top", "bottom", "doctop")
    words.write.parquet(str(tmp_path / "in"))
    query = intake.follow(spark, str(tmp_path / "in"), str(tmp_path / "ck"), lambda batch, _: lines.anchored_lines(batch).write.mode("append").parquet(str(tmp_path / "out")))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).where("line_no > 0").count() == 500
