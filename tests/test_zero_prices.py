"""Queries over returns against their SQL where some prices are zero."""

import duckdb
import pytest
from test_oracles import DATA, ORACLES, QUERIES, key, plain

NAMES = ["cumulative_returns", "hedge_summary", "hedge_summary_weighted", "hedge_yearly", "yearly_returns", "portfolio_runs", "position_metrics", "welch_test", "winsorized_returns"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    # ten times as many users' days as at sf0.001, a price of zero now and then, also twice running
    out = tmp_path_factory.mktemp("zero")
    duckdb.sql(f"""COPY (SELECT event_id + 100000 * i AS event_id, user_id + 1000 * i AS user_id, event_type, CASE WHEN (event_id + i) % 23 < 2 THEN 0 ELSE value END AS value, ts, props
        FROM '{DATA}/events.parquet', range(10) r(i)) TO '{out}/events.parquet'""")
    return str(out)


def both(spark, folder, name):
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    relation = con.sql(ORACLES[name])
    at = [relation.columns.index(c) for c in columns]
    return (sorted((tuple(plain(x) for x in row) for row in rows), key=key) for rows in (([r[c] for c in columns] for r in df.collect()), ([r[i] for i in at] for r in relation.fetchall())))


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_as_sql_after_zero_prices(spark, folder, name):
    got, want = both(spark, folder, name)
    assert want and got == want
