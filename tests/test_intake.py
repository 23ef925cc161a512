"""Statements that arrive in parts: two batches and a replay give what one batch gives."""

from pyspark.sql import functions as F

from reconcilia import views
from reconcilia.operators import tables
from reconcilia.plans import statements
from reconcilia.storage import saved
from reconcilia.streaming import intake


def test_files_in_parts(spark, sf, tmp_path):
    words, pages, tokens = views.every_statement(spark, sf)
    some = F.col("file_id").cast("long") <= 40
    words, pages, tokens = (saved(df.where(some)) for df in (words, pages, tokens))
    rest = lambda df, name: df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in intake.STREAMS[name].fields if f.name not in df.columns}).select(*intake.STREAMS[name].fieldNames())
    source = {"words": rest(words, "words"), "pages": rest(pages, "pages"), "ocr_tokens": rest(tokens, "ocr_tokens")}
    count = lambda df, name: df.groupBy("file_id").agg(F.count("*").alias(name))
    files = count(pages, "n_pages").join(count(words, "n_words"), "file_id", "left").join(count(tokens, "n_tokens"), "file_id", "left").na.fill(0).select(*intake.FILES.fieldNames())
    early, root = F.col("file_id").cast("long") % 2 == 0, f"file://{tmp_path}"
    run = lambda: intake.follow_statements(spark, f"{root}/in", f"{root}/out", f"{root}/ck").awaitTermination(300)
    # first: all words, but pages, tokens and announcements of even files only
    source["words"].write.parquet(f"{root}/in/words")
    for name, df in (("pages", source["pages"]), ("ocr_tokens", source["ocr_tokens"]), ("files", files)):
        df.where(early).write.parquet(f"{root}/in/{name}")
    run()
    store = tables.Versions(spark, f"{root}/out/tables")
    ids = lambda: {r[0]: r[1] for r in store.tables()["Datos de la Cuenta"].select("Nombre del Archivo", "id_estado").collect()}
    first = ids()
    assert first and all(int(f) % 2 == 0 for f in first)
    for name, df in (("pages", source["pages"]), ("ocr_tokens", source["ocr_tokens"]), ("files", files)):
        df.where(~early).write.mode("append").parquet(f"{root}/in/{name}")
    run()
    both = ids()
    assert {f: both[f] for f in first} == first and {r[0] for r in files.select("file_id").collect()} == set(both) and sorted(both.values()) == list(range(1, len(both) + 1))
    version = store.numbers()
    assert intake.process_files(spark, files.where(~early).select("file_id"), f"{root}/in", f"{root}/out", store.manifest()["batches"][-1]) is None and store.numbers() == version
    want = statements.process(words, pages, tokens).validations
    columns = ["statement_id", "orden", "esperado", "obtenido", "diferencia", "correcto"]
    rows = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert rows(store.tables()["validaciones"]) == rows(want) != []
