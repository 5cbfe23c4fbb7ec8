"""prep_placeholder against its SQL where a part's ratio of price and size is a placeholder's number."""

import duckdb
from test_oracles import ORACLES, QUERIES, key


def test_a_ratio_of_999_stays(spark, tmp_path):
    # of the first three parts the ratio is 999, of the others the price or size
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT * FROM (VALUES (1, 1998.0, 2), (2, 999.0, 1), (4, 9999.0, 1), (8, 999.0, 3), (13, 905.5, 999), (11, 901.0, 7), (7, 902.0, 5), (3, 903.0, 6)) t(p_partkey, p_retailprice, p_size)) TO '{tmp_path}/part.parquet'""")
    con.execute(f"CREATE VIEW part AS SELECT p_partkey, p_retailprice::DOUBLE AS p_retailprice, p_size::INT AS p_size FROM '{tmp_path}/part.parquet'")
    con.execute(f"COPY part TO '{tmp_path}/typed.parquet'")
    (tmp_path / "typed.parquet").rename(tmp_path / "part.parquet")
    relation = con.sql(ORACLES["prep_placeholder"])
    got = QUERIES["prep_placeholder"](spark, str(tmp_path)).select(*relation.columns).collect()
    assert sorted(map(tuple, got), key=key) == sorted(relation.fetchall(), key=key)
    assert [r["c"] for r in sorted(got)[:3]] == [999.0, 999.0, 0.0]
