"""Queries over orders and lineitem: a customer is a company, a year of orders its fiscal year."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fundamentals as fun
from .registry import Registry, table

REGISTRY = Registry()

# entries: an order is an entry of its customer; its year is annual, its quarter quarterly
_ENTRIES = """entries AS (SELECT o_custkey AS ticker, o_orderkey AS pos, year(o_orderdate)::INT AS year, 'Q' || quarter(o_orderdate) AS quarter, o_totalprice AS revenue, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice * 0.1 END AS income FROM orders)"""


def _entries(spark: SparkSession, sf_dir: str, period: str) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("ticker"), F.col("o_orderkey").alias("pos"), F.year(day).cast("string").alias("calendarYear"),
        (F.lit("FY") if period == "FY" else F.concat(F.lit("Q"), F.quarter(day).cast("string"))).alias("period"),
        F.col("o_totalprice").alias("revenue"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") * 0.1).alias("income"),
    )


def _fy(spark: SparkSession, sf_dir: str, prefix: str, kpis: list[str]) -> DataFrame:
    return fun.statement_rows(_entries(spark, sf_dir, "FY"), kpis, prefix)


@REGISTRY.add(f"WITH {_ENTRIES} SELECT ticker, year, min_by(revenue, pos) AS is_revenue, (SELECT income FROM entries i WHERE i.pos = min(e.pos)) AS is_income FROM entries e WHERE year BETWEEN 1990 AND 2025 GROUP BY ticker, year")
def fy_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fy(spark, sf_dir, "is", ["revenue", "income"])


@REGISTRY.add(
    f"""WITH {_ENTRIES}, f AS (SELECT ticker, year, min_by(revenue, pos) AS is_revenue FROM entries WHERE year BETWEEN 1990 AND 2025 GROUP BY ticker, year),
    l AS (SELECT l_suppkey AS ticker, year(l_shipdate)::INT AS year, min(l_extendedprice) AS bs_extended FROM lineitem GROUP BY ALL), n AS (SELECT c_custkey AS ticker, 1996 AS year, c_acctbal AS km_balance FROM customer)
    SELECT ticker, year, is_revenue, bs_extended, km_balance FROM f FULL JOIN l USING (ticker, year) FULL JOIN n USING (ticker, year)"""
)
def fy_features_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("ticker"), F.year(F.col("l_shipdate").cast("date")).alias("year")).agg(F.min("l_extendedprice").alias("bs_extended"))
    balance = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ticker"), F.lit(1996).alias("year"), F.col("c_acctbal").alias("km_balance"))
    return fun.outer_merge([_fy(spark, sf_dir, "is", ["revenue"]), ship, balance], ["ticker", "year"])


@REGISTRY.add(
    f"""WITH {_ENTRIES}, q AS (SELECT ticker, year, quarter, min_by(revenue, pos) AS v FROM entries GROUP BY ALL)
    SELECT ticker, year, max(v) FILTER (quarter = 'Q1') AS is_revenue_Q1, max(v) FILTER (quarter = 'Q2') AS is_revenue_Q2, max(v) FILTER (quarter = 'Q3') AS is_revenue_Q3, max(v) FILTER (quarter = 'Q4') AS is_revenue_Q4 FROM q GROUP BY ticker, year"""
)
def quarterly_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fun.quarters_wide(fun.statement_rows(_entries(spark, sf_dir, "Q"), ["revenue"], "is", "Q"), ["is_revenue"])


@REGISTRY.add(f"WITH {_ENTRIES} SELECT ticker, year, min(pos) AS pos, min_by(revenue, pos) AS revenue FROM entries GROUP BY ticker, year")
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _entries(spark, sf_dir, "FY").withColumn("year", F.col("calendarYear").cast("int"))
    return fun.first_by(rows, ["ticker", "year"], ["pos"]).select("ticker", "year", "pos", "revenue")


@REGISTRY.add(
    """SELECT p_partkey, CASE WHEN p_size + p_retailprice = 0 THEN NULL ELSE p_size / (p_size + p_retailprice) END AS market_leverage, p_size / nullif(p_retailprice, 0) AS gp_to_assets, p_size / nullif(p_size - 10, 0)::DOUBLE AS net_income_to_equity,
    p_size / nullif(p_retailprice, 0) AS net_income_to_assets, p_retailprice / nullif(p_size - 5, 0)::DOUBLE AS share_turnover FROM part"""
)
def financial_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, price = F.col("p_size").cast("double"), F.col("p_retailprice")
    rows = table(spark, sf_dir, "part").select("p_partkey", size.alias("bs_abs_totalDebt"), price.alias("km_marketCap"), size.alias("is_abs_grossProfit"), price.alias("bs_abs_totalAssets"), (size - 10).alias("bs_abs_totalEquity"), size.alias("is_abs_netIncome"), price.alias("mean_volume"), (size - 5).alias("is_abs_weightedAverageShsOut"))
    return fun.ratios(rows).select("p_partkey", "market_leverage", "gp_to_assets", "net_income_to_equity", "net_income_to_assets", "share_turnover")


@REGISTRY.add("SELECT p_partkey AS ticker, p_size AS year, p_retailprice AS km_marketCap, p_retailprice * 2 AS volatility FROM part")
def small_feature_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ticker"), F.col("p_size").alias("year"), F.col("p_retailprice").alias("km_marketCap"), (F.col("p_retailprice") * 2).alias("volatility"), F.lit(1.0).alias("km_peRatio"))
    return fun.feature_set(rows, small=True)


@REGISTRY.add("SELECT p_partkey AS ticker, p_size AS year, p_retailprice AS is_abs_kept, p_retailprice + 1 AS own_figure FROM part")
def large_feature_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features but absolute and repeated ones, without those of quarters."""
    price = F.col("p_retailprice")
    gone = {"bs_abs_gone": price, "km_peRatio": price * 2, "km_peRatio_Q2": price * 3, "own_figure_Q1": price * 4, "own_figure_Q4": price * 5}
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ticker"), F.col("p_size").alias("year"), price.alias("is_abs_kept"), (price + 1).alias("own_figure"), *(c.alias(n) for n, c in gone.items()))
    return fun.feature_set(rows, absolute=("bs_abs_gone",), quarters=False)


@REGISTRY.add("SELECT o_custkey AS ticker, o_orderdate::DATE AS date, arg_min(o_totalprice, o_orderkey) AS price, arg_min(o_orderkey % 97, o_orderkey)::DOUBLE AS volume FROM orders WHERE o_orderkey % 13 <> 0 GROUP BY ALL")
def daily_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first entry of a customer and day; days that can't be read go."""
    key, day = F.col("o_orderkey"), F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    return fun.daily_prices(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("ticker"), key.alias("pos"), F.when(key % 13 == 0, "no day").otherwise(day).alias("date"), F.col("o_totalprice").alias("adjClose"), (key % 97).alias("volume")))


_FILED = """raw AS (SELECT l_suppkey AS ticker, l_orderkey * 10 + l_linenumber AS pos, l_quantity, o_orderdate::DATE AS period_of_report, l_shipdate::DATE AS filing_date, year(o_orderdate)::INT AS year FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
filed AS (SELECT ticker, period_of_report, filing_date, year FROM (SELECT *, row_number() OVER (PARTITION BY ticker, year ORDER BY pos, l_quantity, filing_date, period_of_report) AS r FROM raw) WHERE r = 1)"""


def _filed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    day = lambda c: F.date_format(F.col(c).cast("timestamp"), "yyyy-MM-dd HH:mm")
    entries = rows.select(F.col("l_suppkey").alias("ticker"), F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("a"), F.col("l_quantity").alias("b"), day("l_shipdate").alias("c"), day("o_orderdate").alias("d")).alias("pos"), day("o_orderdate").alias("date"), day("l_shipdate").alias("fillingDate"), F.year(F.col("o_orderdate").cast("date")).cast("string").alias("calendarYear"))
    return fun.filing_dates(entries)


@REGISTRY.add(f"WITH {_FILED} SELECT ticker, period_of_report, filing_date, year FROM filed")
def filing_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filed(spark, sf_dir)


_SANE = "filing_date - period_of_report > 0 AND filing_date - period_of_report <= 60 AND abs(year - year(period_of_report)) <= 1 AND filing_date <= DATE '2000-01-01'"


@REGISTRY.add(f"WITH {_FILED} SELECT ticker, year, 'valid' AS verdict FROM filed WHERE {_SANE} UNION ALL SELECT ticker, year, 'invalid' FROM filed WHERE NOT ({_SANE})")
def filing_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, bad = fun.sane_filings(_filed(spark, sf_dir), F.lit("2000-01-01").cast("date"), 60)
    return good.select("ticker", "year", F.lit("valid").alias("verdict")).unionByName(bad.select("ticker", "year", F.lit("invalid").alias("verdict")))


@REGISTRY.add(f"WITH {_FILED} SELECT ticker, year, coalesce(lag(period_of_report) OVER w, (period_of_report - INTERVAL 1 YEAR)::DATE) AS previous_period, coalesce(lag(filing_date) OVER w, (filing_date - INTERVAL 1 YEAR)::DATE) AS previous_filing FROM filed WINDOW w AS (PARTITION BY ticker ORDER BY period_of_report, filing_date)")
def filing_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fun.filing_windows(_filed(spark, sf_dir)).select("ticker", "year", "previous_period", "previous_filing")


_TARGETS = f"""{_ENTRIES}, t AS (SELECT ticker, year, min_by(revenue, pos) AS target FROM entries GROUP BY ticker, year),
a AS (SELECT ticker, year, target - CASE WHEN count(*) OVER w >= 3 THEN avg(target) OVER w END AS target FROM t WINDOW w AS (PARTITION BY ticker ORDER BY year ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING)), adj AS (SELECT * FROM a WHERE target IS NOT NULL)"""


def _adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fun.above_recent_mean(fun.target_rows(_entries(spark, sf_dir, "FY"), "revenue"))


@REGISTRY.add(f"WITH {_TARGETS} SELECT ticker, year, round(target, 6) AS target FROM adj")
def target_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _adjusted(spark, sf_dir).withColumn("target", F.round("target", 6))


@REGISTRY.add(f"WITH {_ENTRIES}, q AS (SELECT ticker, year, min_by(income, pos) AS target FROM entries WHERE quarter = 'Q2' AND income IS NOT NULL GROUP BY ticker, year) SELECT ticker, year, round(target, 6) AS target FROM q WHERE year >= 1995 AND year <= 1997 AND abs(target) < 20000")
def target_of_a_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = fun.bounded_targets(fun.target_rows(_entries(spark, sf_dir, "Q"), "income", "Q2"), (1995, 1997), 20_000)
    return got.withColumn("target", F.round("target", 6))


@REGISTRY.add(f"WITH {_TARGETS} SELECT ticker, year - 1 AS year, (target > 0)::INT AS target FROM adj WHERE year BETWEEN 1998 AND 2000 AND abs(target) < 200000 AND abs(target) >= 1000")
def target_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fun.shifted_years(fun.binary_target(fun.bounded_targets(_adjusted(spark, sf_dir), (1998, 2000), 200_000, 1_000)))


@REGISTRY.add("SELECT c_custkey AS ticker, pos, date, adjClose FROM (SELECT c_custkey, 0 AS pos, '2024-01-02' AS date, c_acctbal AS adjClose FROM customer UNION ALL SELECT c_custkey, 1, '2024-01-03', c_acctbal + 1 FROM customer)")
def nested_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = lambda d, v: F.struct(F.lit(d).alias("date"), v.alias("adjClose"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ticker"), F.create_map(F.lit("historical"), F.array(entry("2024-01-02", F.col("c_acctbal")), entry("2024-01-03", F.col("c_acctbal") + 1))).alias("financials"))
    return fun.nested_entries(rows, "historical")
