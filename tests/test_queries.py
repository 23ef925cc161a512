"""A sample of the registered queries against their DuckDB oracles at the smallest scale."""

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [
    "reconcile_statements", "integrity_score", "bank_identification", "bank_catalogue", "scan_words", "text_stage", "document_quality", "document_routing", "chosen_words", "lines_by_anchor", "lines_by_mean", "lines_by_doctop", "line_tolerance",
    "boxes_bbva_datos", "layout_shift", "concepts_banorte", "money_functions", "movements_bbva", "movements_banamex", "movements_banorte", "account_banorte", "summary_bbva", "summary_banamex", "summary_banorte", "page_columns",
    "typed_words", "rejected_words", "text_functions", "fourth_bank_movements", "fourth_bank_fields", "keys_over_batches", "table_accounts", "table_summaries", "table_movements", "sink_tables",
    "trim_after_total", "trim_repeated_headers", "trim_last_section", "trim_marker_line", "products_bbva", "statement_keys", "process_statements",
]


def rows(df):
    def plain(v):
        return None if pd.isna(v) else f"{float(v):.6f}" if not isinstance(v, str | bool | np.bool_) and hasattr(v, "__float__") else str(v)

    return sorted(tuple(str(plain(v)) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    assert rows(entry.queries()[name](spark, sf).toPandas()) == rows(con.execute(entry.oracle_sql()[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
