"""Driver contract, streaming == batch, and a DuckDB cross-check of the cheap
queries at sf0.001."""
import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF001

CHEAP = ["W1_pct_change", "W3_rolling_mean", "W12_change_vs_lag", "A14_roc_auc", "A16_probability_histogram",
         "F4_candidate_symbols", "F9_extractive_summary", "J2_single_aggregate", "O3_highlights", "P13_signal_band",
         "S5_registry_scan", "X4_resolve_companies", "X5_company_report"]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "target_direction" in df.columns


def test_oracle_keys_subset_of_queries():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q) and len(q) >= 140


@pytest.mark.parametrize("name", CHEAP)
def test_duckdb_oracle_sf0001(spark, name):
    tables = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    sdf = E.queries()[name](spark, SF001)
    rel = con.sql(E.oracle_sql()[name])
    a = sorted(tuple(repr(r[c]) for c in sorted(sdf.columns)) for r in sdf.collect())
    cols = rel.columns
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    b = sorted(tuple(repr(row[i]) for i in order) for row in rel.fetchall())
    assert sorted(sdf.columns) == sorted(cols)
    assert len(a) == len(b)
    assert a == b


def test_streaming_equals_batch(spark):
    q = E.queries()
    stream = q["X11_company_news_stream"](spark, SF001)
    batch = q["X11_company_news"](spark, SF001)
    assert sorted(map(tuple, stream.select("ticker", "url", "sentiment_score").collect())) == \
        sorted(map(tuple, batch.select("ticker", "url", "sentiment_score").collect()))
