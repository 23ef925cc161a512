"""Hand-made values of the scalar functions, in one job each."""

from decimal import Decimal

from pyspark.sql import functions as F

from reconcilia.functions import clabe, concepts, dates, money, text


def one(spark, **columns):
    return spark.range(1).select(*(v.alias(k) for k, v in columns.items())).first().asDict()


def test_text(spark):
    got = one(spark, a=text.canonical(F.lit("  México \n  Ñandú ")), b=text.digits(F.lit("012 180-01576395513 3")), c=text.word_text(F.lit("a b–c")), d=text.clabe_or_null(F.lit("12")), e=text.rfc_labelled(F.lit("RFC: abc 1")))
    assert got == {"a": "MEXICO NANDU", "b": "012180015763955133", "c": "a b-c", "d": None, "e": "ABC1"}


def test_labels_are_no_tax_ids(spark):
    """A label of three or four letters with six or nine digits behind it is no tax id; one printed after it is found."""
    texts = ["REF 123456 AUT 99", "REF 123456789 AUT 99", "CAJA 123456789", "REF 123456 AUT 99\nRFC ABC 010101 XY1", "COMPRA REFA010101XY1"]
    got = one(spark, **{f"a{i}": concepts.banamex_fields(F.lit(t))["rfc"] for i, t in enumerate(texts)})
    assert list(got.values()) == [None, None, None, "ABC010101XY1", "REFA010101XY1"]


def test_money(spark):
    got = one(
        spark, a=money.plain(F.lit("1,234.50")), b=money.plain(F.lit("abc")), c=money.in_parentheses(F.lit("($1,200.00)")), d=money.in_parentheses(F.lit("$350.00-"), True), e=money.optional(F.lit("N/A")),
        f=money.is_amount(F.lit("1234.00"), money.BANAMEX), g=money.is_amount(F.lit("1,234.00"), money.BANAMEX), h=money.is_amount(F.lit("15"), money.BANAMEX), i=money.whole(F.lit("31.9")), j=money.percent(F.lit("2.5%")),
    )
    assert got == {"a": Decimal("1234.50"), "b": Decimal("0.00"), "c": Decimal("-1200.00"), "d": Decimal("-350.00"), "e": None, "f": False, "g": True, "h": True, "i": 31, "j": 2.5}


def test_dates(spark):
    got = one(
        spark, a=dates.date_prefix(F.lit("12-ENE-2026PAGO")), b=dates.without_date_prefix(F.lit("12-ENE-26PAGO")), c=dates.is_day_month(F.lit("05 ENE")), d=dates.is_day_month(F.lit("05/ENE/2026")), e=dates.is_day_month(F.lit("5 X")),
        f=dates.slashed_date(F.lit("al 01/Enero/2026 x")),
    )
    assert got == {"a": "12-ENE-2026", "b": "PAGO", "c": True, "d": True, "e": False, "f": "01/Enero/2026"}


def test_clabe(spark):
    got = one(spark, a=clabe.clabe(F.lit("NO. CUENTA CLABE 012 180 01576395513 3")), b=clabe.clabe(F.lit("CLABE SALDO ANTERIOR SALDO AL CORTE 072180012345678901")), c=clabe.clabe(F.lit("sin")))
    assert got == {"a": "012180015763955133", "b": "072180012345678901", "c": None}


def test_concepts(spark):
    spei = concepts.bbva_fields(F.lit("SPEI RECIBIDO\nPAGO RENTA\n00 012180015763955133\nX\nJUAN P"))
    third = concepts.bbva_fields(F.lit("PAGO CUENTA DE TERCERO\nBNET 0123456789 RENTA"))
    got = one(spark, a=spei["beneficiario"], b=spei["clabe_beneficiario"], c=spei["concepto_original"], d=third["cuenta_beneficiario"], e=third["beneficiario"], f=third["concepto_original"])
    assert got == {"a": "JUAN P", "b": "012180015763955133", "c": "PAGO RENTA", "d": "0123456789", "e": "0123456789", "f": "RENTA"}
    time = lambda t: concepts.banorte_fields(F.lit(t))["hora_operacion"]
    rfc = lambda t: concepts.banorte_fields(F.lit(t))["rfc"]
    got = one(spark, a=time("SPEI RECIBIDO HR LIQ: 134502"), b=time("SPEI RECIBIDO HR LIQ: 254502"), c=rfc("ORDEN DE PAGO SPEI RFC: ND, IVA"), d=rfc("ORDEN DE PAGO SPEI RFC: ND IVA"))
    assert got == {"a": "13:45:02", "b": None, "c": None, "d": "NDIVA"}


def test_one_line_made_once(spark):
    """Searches in a concept give the same from a column that holds its one line."""
    c = "SPEI RECIBIDO\nDEL CLIENTE CLIENTE 7 DE LA CLABE 072180000000000012\nCON RFC ABC010101XY1 CONCEPTO: RENTA\nREFERENCIA: 12 CVE RAST: 1\nHR LIQ: 10:11"
    df = spark.createDataFrame([(c,)], "c string").withColumn("t", concepts.flat(F.col("c")))
    a, b = (df.select(*(v.alias(k) for k, v in f.items())).first() for f in (concepts.banorte_fields(F.col("c")), concepts.banorte_fields(F.col("c"), F.col("t"))))
    assert a == b and a["beneficiario"] == "CLIENTE 7"
