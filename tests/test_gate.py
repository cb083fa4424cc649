"""The registry itself: names, oracles and a few queries against DuckDB at the smallest scale."""

import os

import pytest

DIR = "/root/testdata/sf0.001"
FAST = ["b01_tokens", "c01_c04_normalise", "c06_c15_url_functions", "k05_duplicate_pages", "k06_capture_diff", "g14_n02_failed_requests", "h16_h17_run_states", "c23_parse_amount", "c30_c32_admission", "c33_ipv6", "c44_link_outcome", "c45_severity", "c61_schema_fields"]


def test_registry_is_consistent():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


@pytest.mark.skipif(not os.path.isdir(DIR), reason="test tables not present")
@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, name):
    import duckdb

    import __spark_entry__ as entry
    from gate.check import TABLES, table

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = entry.queries()[name](spark, DIR)
    cur = con.execute(entry.oracle_sql()[name])
    assert table(df.columns, [tuple(r) for r in df.collect()]) == table([c[0] for c in cur.description], cur.fetchall())
