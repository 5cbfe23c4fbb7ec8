"""Long and short portfolios from predictions, their returns, and how sure those are."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import poisson_cuts, welch
from .joins import within_interval

LONG, SHORT, NONE = 1, 0, -1


def attach_predictions(rows: DataFrame, predictions: DataFrame, keys: tuple[str, ...] = ("ticker", "year")) -> DataFrame:
    """rows with prob, y_pred and y_true of the prediction with the same keys.

    Rows without a prediction, and those of null keys, are left out; a key that is predicted more than once repeats its rows.
    """
    return rows.join(predictions.select(*keys, "prob", "y_pred", "y_true"), list(keys))


def holding_periods(rows: DataFrame, filings: DataFrame, shift: int = 0, wait: int = 3, months: int = 12) -> DataFrame:
    """rows with start_date and end_date: from `wait` months after the period of the filing that was known, for `months`.

    A row of year y is known from the filing of year y - 1 + shift; month ends are kept within the month.
    Rows without such a filing are left out; several filings of a year repeat the row.
    """
    known = filings.select("ticker", (F.col("year") + 1 - shift).alias("year"), "period_of_report")
    start = F.add_months("period_of_report", wait)
    return rows.join(known, ["ticker", "year"]).withColumn("start_date", start).withColumn("end_date", F.add_months(F.col("start_date"), months))


def ratio(x: Column, y: Column, by_zero: bool = False) -> Column:
    """x / y as doubles; where y is zero null, or by_zero what floating-point numbers have: infinite, and NaN for 0 / 0."""
    plain = F.try_divide(x, y)
    return F.when(y == 0, x * F.pow(y, F.lit(-1.0))).otherwise(plain) if by_zero else plain


def daily_returns(prices: DataFrame, by_zero: bool = False) -> DataFrame:
    """prices with daily_return: from the ticker's last known price before, null for none; after a price of zero null, or by_zero infinite or NaN."""
    order = Window.partitionBy("ticker").orderBy("date")
    filled = prices.withColumn("__p", F.last("price", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return filled.withColumn("__b", F.lag("__p").over(order)).withColumn("daily_return", ratio(F.col("__p"), F.col("__b"), by_zero) - 1).drop("__p", "__b")


def market_returns(index: DataFrame, by_zero: bool = False) -> DataFrame:
    """(date, market_return) of an index (date, price): one row a day, so one window. Null after a null price; after one of zero null, or by_zero infinite or NaN; an empty index gives no rows."""
    order = Window.orderBy("date")
    return index.withColumn("__b", F.lag("price").over(order)).select("date", (ratio(F.col("price"), F.col("__b"), by_zero) - 1).alias("market_return"))


def market_caps(metrics: DataFrame) -> DataFrame:
    """(ticker, year, market_cap): the first by pos of a ticker and year of (ticker, pos, calendarYear, marketCap)."""
    rows = metrics.withColumn("year", F.expr("try_cast(calendarYear as int)"))
    first = rows.withColumn("__r", F.row_number().over(Window.partitionBy("ticker", "year").orderBy("pos"))).where("__r = 1")
    return first.select("ticker", "year", F.col("marketCap").cast("double").alias("market_cap"))


def cumulative_returns(held: DataFrame, daily: DataFrame, market: DataFrame, least_days: int = 210) -> DataFrame:
    """held rows with trading_days and compounded stock_return, market_return and excess_return from start to before the end.

    Days count that the market has too; rows with fewer than least_days go. A day of a null return counts, and changes nothing.
    """
    days = within_interval(held, daily.select("ticker", "date", "daily_return"), F.col("start_date"), F.date_sub("end_date", 1), "date", ["ticker"])
    both = days.join(market, "date")
    grown = both.groupBy(*held.columns).agg(F.count("*").alias("trading_days"), (F.product(1 + F.col("daily_return")) - 1).alias("stock_return"), (F.product(1 + F.col("market_return")) - 1).alias("market_return"))
    return grown.where(F.col("trading_days") >= least_days).withColumn("excess_return", F.col("stock_return") - F.col("market_return"))


def with_positions(rows: DataFrame, long_from: float = 0.5, short_to: float = 0.5, prob: str = "prob") -> DataFrame:
    """position 1 from long_from, 0 up to short_to, which wins where both hold, else -1, as for a null score."""
    return rows.withColumn("position", F.when(F.col(prob) <= short_to, SHORT).when(F.col(prob) >= long_from, LONG).otherwise(NONE))


def yearly_means(rows: DataFrame) -> DataFrame:
    """(year, market_mean, stock_mean, weighted_mean), the last by market cap where that is positive; null returns don't count, a null year is a year."""
    cap = F.when(F.col("market_cap") > 0, F.col("market_cap"))
    return rows.groupBy("year").agg(F.avg("market_return").alias("market_mean"), F.avg("stock_return").alias("stock_mean"), F.try_divide(F.sum(F.col("stock_return") * cap), F.sum(F.when(F.col("stock_return").isNotNull(), cap))).alias("weighted_mean"))


def _taken(rows: DataFrame, group: str, weighted: bool) -> DataFrame:
    kept = rows.where(F.col(group).isin(LONG, SHORT) & F.col("excess_return").isNotNull())
    return kept.where("market_cap > 0") if weighted else kept


def _mean(side: int, group: str, weighted: bool) -> Column:
    x, w = F.when(F.col(group) == side, F.col("excess_return")), F.when(F.col(group) == side, F.col("market_cap"))
    return F.try_divide(F.sum(x * w), F.sum(w)) if weighted else F.avg(x)


def hedge_summary(rows: DataFrame, group: str = "position", weighted: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """One row, or one for each value of `by`: sizes and mean excess returns of both sides, their difference, and Welch's t and df, which are never weighted."""
    kept = _taken(rows, group, weighted)
    side = lambda s: F.when(F.col(group) == s, F.col("excess_return"))
    sums = kept.groupBy(*by).agg(
        F.count(side(LONG)).alias("n_long"), F.count(side(SHORT)).alias("n_short"), _mean(LONG, group, weighted).alias("long_mean"), _mean(SHORT, group, weighted).alias("short_mean"),
        F.avg(side(LONG)).alias("__ml"), F.avg(side(SHORT)).alias("__ms"), F.var_samp(side(LONG)).alias("__vl"), F.var_samp(side(SHORT)).alias("__vs"),
    )
    t, df = welch(*(F.col(c) for c in ("__ml", "__vl", "n_long", "__ms", "__vs", "n_short")))
    return sums.withColumns({"hedge_return": F.col("long_mean") - F.col("short_mean"), "t": t, "df": df}).drop("__ml", "__ms", "__vl", "__vs")


def hedge_by_year(rows: DataFrame, group: str = "position", weighted: bool = False) -> DataFrame:
    """(year, hedge_return) of the years that have both sides; rows of a null return are left out."""
    kept = _taken(rows, group, weighted).groupBy("year").agg(F.count_distinct(group).alias("__n"), (_mean(LONG, group, weighted) - _mean(SHORT, group, weighted)).alias("hedge_return"))
    return kept.where("__n = 2").drop("__n")


def strategies(rows: DataFrame, long_from: float, short_to: float, prob: str = "prob", target: str = "target") -> DataFrame:
    """rows three times with a strategy and its position: by thresholds, by 0.5, and with perfect foresight."""
    options = {"threshold": (long_from, short_to, prob), "prediction": (0.5, 0.5 - 1e-12, prob), "foresight": (0.5, 0.5 - 1e-12, target)}
    parts = [with_positions(rows, lo, sh, of).withColumn("strategy", F.lit(name)) for name, (lo, sh, of) in options.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def portfolio_runs(predictions: DataFrame, base: DataFrame, long_from: float, short_to: float, weighted: bool = False) -> DataFrame:
    """hedge_summary of each model, feature set, shift and strategy.

    predictions: (model, features, shift, ticker, year, prob, target); base: the returns (shift, ticker, year, excess_return, market_cap), which
    are computed once a shift and joined to the predictions of all models and feature sets at once. Predictions without returns take no part.
    """
    held = predictions.join(base.select("shift", "ticker", "year", "excess_return", "market_cap"), ["shift", "ticker", "year"])
    return hedge_summary(strategies(held, long_from, short_to), weighted=weighted, by=("model", "features", "shift", "strategy"))


def bootstrap_hedge(rows: DataFrame, rounds: int = 1000, seed: int = 42, group: str = "position", weighted: bool = False, by_year: bool = False) -> DataFrame:
    """One row: mean, 95 % interval and two-sided p of the hedge return when rows, or years, are drawn again with replacement.

    Each row takes part in each round as often as a Poisson variable of mean 1 says, from a hash of row, round and seed; so
    rounds are independent of how rows are dealt out, and sums are all that travels.
    """
    key = F.col("year") if by_year else F.struct("ticker", "year")
    cap = F.col("market_cap") if weighted else F.lit(1.0)
    kept = _taken(rows, group, weighted).select(key.alias("__k"), group, (cap * F.col("excess_return")).alias("__x"), cap.cast("double").alias("__c"))
    # what is drawn together is added up before: years are few, and rounds then multiply these alone
    kept = kept.groupBy("__k", group).agg(F.sum("__x").alias("__x"), F.sum("__c").alias("__c"))
    drawn = kept.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds))))
    u = F.pmod(F.xxhash64("__k", "round", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    times = sum((F.when(u >= c, 1).otherwise(0) for c in poisson_cuts()), F.lit(0)).cast("double")
    side = lambda s: F.try_divide(F.sum(F.when(F.col(group) == s, times * F.col("__x"))), F.sum(F.when(F.col(group) == s, times * F.col("__c"))))
    each = drawn.groupBy("round").agg((side(LONG) - side(SHORT)).alias("h")).where("h is not null")
    ends = F.percentile("h", F.array(F.lit(0.025), F.lit(0.975)))
    share = lambda test: F.avg(test.cast("double"))
    return each.agg(F.avg("h").alias("mean"), ends[0].alias("low"), ends[1].alias("high"), F.least(F.lit(1.0), 2 * F.least(share(F.col("h") <= 0), share(F.col("h") >= 0))).alias("p"))


def permutation_hedge(rows: DataFrame, rounds: int = 1000, seed: int = 42, group: str = "position", weighted: bool = False) -> DataFrame:
    """One row: the hedge return and the shares of random sides of the same sizes that do as well, two- and one-sided.

    In each round the rows with the lowest hashes of row, round and seed, as many as are long, make the long side. Which hash is the last of
    them is known up to a small share: rows clearly below it are added up where they are, and only those around it, about the root of the
    number of rows in each round, are ranked. So what is shuffled hardly grows with rows times rounds. Rows of one ticker and year are to be unique;
    without rows of both sides the values are null.
    """
    kept = _taken(rows, group, weighted).select("ticker", "year", group, "excess_return", (F.col("market_cap") if weighted else F.lit(1.0)).cast("double").alias("__c"))
    kept = kept.withColumn("__x", F.col("excess_return") * F.col("__c"))
    real = kept.agg(F.count("*").alias("n"), F.count_if(F.col(group) == LONG).alias("long"), F.sum("__x").alias("x"), F.sum("__c").alias("c"), F.sum(F.when(F.col(group) == LONG, F.col("__x"))).alias("lx"), F.sum(F.when(F.col(group) == LONG, F.col("__c"))).alias("lc")).first()
    empty = kept.sparkSession.createDataFrame([(None, None, None)], "hedge_return double, p_two_sided double, p_one_sided double")
    if not real["n"] or not 0 < real["long"] < real["n"]:
        return empty
    x, c, n, longs = real["x"], real["c"], real["n"], real["long"]
    hedge = real["lx"] / real["lc"] - (x - real["lx"]) / (c - real["lc"])
    share = longs / n
    spread = 8 * math.sqrt(share * (1 - share) / n) + 2 / n
    drawn = kept.select("ticker", "year", "__x", "__c", F.explode(F.sequence(F.lit(1), F.lit(rounds))).alias("round")).withColumn("__h", F.xxhash64("ticker", "year", "round", F.lit(seed)))
    u = F.col("__h").cast("double") / F.lit(2.0**64) + F.lit(0.5)
    for _ in range(8):
        low, high = share - spread, share + spread
        sure = drawn.where(u < low).groupBy("round").agg(F.count("*").alias("k"), F.sum("__x").alias("sx"), F.sum("__c").alias("sc"))
        near = drawn.where((u >= low) & (u < high))
        order = Window.partitionBy("round").orderBy("__h", "ticker", "year")
        ranked = near.withColumn("__n", F.row_number().over(order)).join(F.broadcast(sure), "round", "left")  # a row for each round
        more = ranked.groupBy("round").agg(
            F.count("*").alias("m"), F.first("k").alias("k"), F.first("sx").alias("sx"), F.first("sc").alias("sc"),
            *(F.sum(F.when(F.col("__n") + F.coalesce("k", F.lit(0)) <= longs, F.col(v))).alias(f"m{v}") for v in ("__x", "__c")),
        )
        zero = lambda v: F.coalesce(v, F.lit(0.0))
        lx, lc = zero("sx") + zero("m__x"), zero("sc") + zero("m__c")
        fits = (F.coalesce("k", F.lit(0)) <= longs) & (F.coalesce("k", F.lit(0)) + F.col("m") >= longs)
        h = F.try_divide(lx, lc) - F.try_divide(F.lit(x) - lx, F.lit(c) - lc)
        same = F.lit(abs(hedge) * (1 - 1e-12))  # rounding is no difference
        out = more.select(fits.alias("fits"), h.alias("h")).agg(F.count_if("fits").alias("rounds"), F.avg((F.abs("h") >= same).cast("double")).alias("p_two_sided"), F.avg((F.col("h") >= (same if hedge >= 0 else F.lit(hedge * (1 + 1e-12)))).cast("double")).alias("p_one_sided")).first()
        if out["rounds"] == rounds:
            return kept.sparkSession.createDataFrame([(hedge, out["p_two_sided"], out["p_one_sided"])], empty.schema)
        spread *= 4  # it takes a hash that is far from even
    raise RuntimeError("hashes are far from even")
