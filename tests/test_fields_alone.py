"""What fields need of statements, and that nothing else is done for them."""

from pyspark.sql import functions as F

from reconcilia import views
from reconcilia.operators import banorte_summary, fields, movements
from reconcilia.plans import statements
from reconcilia.sources import layouts


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_printed_words_are_not_sorted(spark, sf):
    """seq is unique in a file and grows in reading order, with no window over words, so that a filter on pages comes before them."""
    for words in (*(views.statement_words(spark, sf, b) for b in ("bbva", "banamex", "banorte")), views.fourth_statements(spark, sf)[0]):
        assert "windowspecdefinition(file_id" not in plan_of(words)
        assert words.groupBy("file_id", "seq").count().where("count > 1").isEmpty()
        some = words.where("file_id IN ('1', '2', '4', '7')").collect()
        pages = {}
        for r in some:
            pages.setdefault((r["file_id"], r["page"]), []).append((r["seq"], int(r["top"] * 10), int(r["x0"])))
        assert all([x[1:] for x in sorted(p)] == sorted(x[1:] for x in p) for p in pages.values())


def test_fields_need_no_movements(spark, sf, monkeypatch):
    """Account, products and summary come without a line being cut, and from the pages with fields alone."""
    def fail(*_):
        raise AssertionError("movements were made")

    monkeypatch.setattr(movements, "movements", fail)
    words, pages = views.fourth_statements(spark, sf)
    known = layouts.BUILT_IN.plus(layouts.packaged("santander"))
    out = statements.process(words.where("file_id IN ('1', '2')"), pages.where("file_id IN ('1', '2')"), known=known)
    assert out.account.where("numero_cuenta IS NOT NULL").count() == out.summary.count() == out.products.count() == 2
    assert {r["page"] for r in out._front.select("page").distinct().collect()} == {1}


def test_box_on_a_later_page(spark):
    """A layout may have a field on any page."""
    own = layouts.packaged("santander")
    box = next(r for r in own.rows["boxes"] if r["section"] == "datos" and r["field"] == "numero_cuenta")
    known = layouts.Layouts(own.rows | {"boxes": [r | {"page": 5} if r is box else r for r in own.rows["boxes"]]})
    assert known.last_pages() == {"santander": 5}
    x, y = (box["xmin"] + box["xmax"]) / 2, (box["ymin"] + box["ymax"]) / 2
    words = spark.createDataFrame([("a", "santander", 1, p, t, x - 1, x + 1, y - 1, y + 1) for p, t in ((1, "111"), (5, "555"))], "file_id string, bank_key string, seq long, page int, text string, x0 double, x1 double, top double, bottom double")
    found = fields.sections(words, words.select("file_id", "bank_key").distinct(), known)
    assert [r["numero_cuenta"] for r in fields.section(found, "datos").collect()] == ["555"]


def test_labelled_summary_cuts_lines_once(spark, sf):
    """The words are exchanged once and lines cut once, whatever is read from them."""
    words = views.statement_words(spark, sf, "banorte").where(F.col("file_id").isin("2", "5"))
    plan = plan_of(banorte_summary.banorte_summary(words, spark.createDataFrame([("2",), ("5",)], "file_id string")))
    assert plan.count("ArrowEvalPython") == 1
