"""Company figures: statements to wide features, filing dates, prices around filings, macro figures, targets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import asof, asof_small
from .ranks import quantiles

QUARTERS = ("Q1", "Q2", "Q3", "Q4")

# The features of the small set, by their names in the wide table.
SMALL_SET = (
    "ratios_priceEarningsRatio", "ratios_priceToSalesRatio", "km_dividendYield", "ratios_priceBookValueRatio", "is_growthRevenue", "is_growthEPS", "gp_to_assets",
    "net_income_to_equity", "net_income_to_assets", "medium_term_price_momentum", "km_marketCap", "short_term_price_reversal", "volatility", "market_leverage", "share_turnover",
)
# Columns that another one repeats.
REPEATED = (
    "km_operatingCashFlowPerShare", "km_freeCashFlowPerShare", "km_cashPerShare", "km_peRatio", "km_priceToSalesRatio", "km_pbRatio", "km_ptbRatio", "km_currentRatio", "km_interestCoverage",
    "km_dividendYield", "km_payoutRatio", "fg_revenueGrowth", "fg_grossProfitGrowth", "fg_operatingIncomeGrowth", "fg_netIncomeGrowth", "fg_epsgrowth", "fg_epsdilutedGrowth",
    "fg_weightedAverageSharesGrowth", "fg_weightedAverageSharesDilutedGrowth", "fg_operatingCashFlowGrowth", "fg_freeCashFlowGrowth", "fg_receivablesGrowth", "fg_inventoryGrowth", "fg_assetGrowth",
    "fg_debtGrowth", "fg_rdexpenseGrowth", "fg_sgaexpensesGrowth",
)


def finite(c: Column) -> Column:
    """Null for NaN and infinity: the one form of a missing number."""
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def first_by(rows: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each of the keys in an explicit order."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def statement_rows(entries: DataFrame, kpis: list[str], prefix: str, period: str = "FY", years: tuple[int, int] = (1990, 2025)) -> DataFrame:
    """(ticker, year[, period], prefix_kpi ...) of (ticker, pos, calendarYear, period, kpis), the first of each by pos.

    period FY takes annual rows, Q those of quarters. Years that aren't numbers, or lie outside of the range, go.
    """
    keys = ["ticker", "year"] + (["period"] if period == "Q" else [])
    fit = F.col("period") == "FY" if period == "FY" else F.col("period").startswith("Q")
    rows = entries.where(fit).withColumn("year", F.expr("try_cast(calendarYear as int)")).where(F.col("year").between(*years))
    return first_by(rows, keys, ["pos"]).select(*keys, *(finite(F.col(k).cast("double")).alias(f"{prefix}_{k}") for k in kpis))


def nested_entries(companies: DataFrame, table: str, of: str = "financials") -> DataFrame:
    """(ticker, pos, the entry's fields) of companies (ticker, financials map of table to array of entry structs)."""
    rows = companies.select("ticker", F.posexplode(F.element_at(F.col(of), F.lit(table))).alias("pos", "e"))
    return rows.select("ticker", "pos", "e.*")


def outer_merge(tables: list[DataFrame], on: list[str]) -> DataFrame:
    """Full outer joins in turn, with the keys of whichever side has them."""
    return reduce(lambda a, b: a.join(b, on, "full_outer"), tables)


def quarters_wide(rows: DataFrame, kpis: list[str]) -> DataFrame:
    """(ticker, year, <kpi>_Q1 .. <kpi>_Q4) of rows (ticker, year, period, kpis): conditional aggregates, no job to find the values."""
    return rows.groupBy("ticker", "year").agg(*(F.first(F.when(F.col("period") == q, F.col(k)), ignorenulls=True).alias(f"{k}_{q}") for k in kpis for q in QUARTERS))


def ratios(rows: DataFrame, assets_fix: bool = True) -> DataFrame:
    """With market_leverage, gp_to_assets, net_income_to_equity, net_income_to_assets, share_turnover; null over zero.

    assets_fix: gross profit is taken by total assets; without, by equity.
    """
    c, by = F.col, F.try_divide
    return rows.withColumns({
        "market_leverage": by(c("bs_abs_totalDebt"), c("bs_abs_totalDebt") + c("km_marketCap")),
        "gp_to_assets": by(c("is_abs_grossProfit"), c("bs_abs_totalAssets" if assets_fix else "bs_abs_totalEquity")),
        "net_income_to_equity": by(c("is_abs_netIncome"), c("bs_abs_totalEquity")),
        "net_income_to_assets": by(c("is_abs_netIncome"), c("bs_abs_totalAssets")),
        "share_turnover": by(c("mean_volume"), c("is_abs_weightedAverageShsOut")),
    })


def feature_set(rows: DataFrame, small: bool = False, absolute: tuple[str, ...] = (), quarters: bool = True, keys: tuple[str, ...] = ("ticker", "year")) -> DataFrame:
    """The small set of features, or all but absolute and repeated columns; without the quarters' ones if so asked."""
    if small:
        return rows.select(*keys, *(c for c in SMALL_SET if c in rows.columns))
    gone = set(absolute) | {f"{b}{q}" for b in REPEATED for q in ("", *(f"_{x}" for x in QUARTERS))}
    kept = [c for c in rows.columns if c not in gone and (quarters or not c.endswith(tuple(f"_{q}" for q in QUARTERS)))]
    return rows.select(*kept)


def filing_dates(entries: DataFrame, one_per_year: bool = True) -> DataFrame:
    """(ticker, period_of_report, filing_date, year) of (ticker, pos, date, fillingDate, calendarYear), the first of a ticker and year."""
    day = lambda c: F.to_date(F.try_to_timestamp(F.substring(F.col(c), 1, 10), F.lit("yyyy-MM-dd")))
    rows = entries.select("ticker", "pos", day("date").alias("period_of_report"), day("fillingDate").alias("filing_date"), F.expr("try_cast(calendarYear as int)").alias("year"))
    return (first_by(rows, ["ticker", "year"], ["pos"]) if one_per_year else rows).drop("pos")


def sane_filings(filings: DataFrame, today: Column, most_days: int = 180) -> tuple[DataFrame, DataFrame]:
    """Filings that are possible and those that aren't: 1 to most_days after the period, of its year or the next to it, not in the future."""
    delay = F.datediff("filing_date", "period_of_report")
    good = F.coalesce((delay > 0) & (delay <= most_days) & (F.abs(F.col("year") - F.year("period_of_report")) <= 1) & (F.col("filing_date") <= today), F.lit(False))
    marked = filings.withColumn("__ok", good)
    return marked.where("__ok").drop("__ok"), marked.where("not __ok").drop("__ok")


def winsorize(prices: DataFrame, of: str = "change", low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Rows of positive price and volume with the column clipped to exact quantiles."""
    kept = prices.where("price > 0 and volume > 0")
    q = quantiles(kept, [of], (low, high)).select(F.col(of).alias("__q"))
    return kept.crossJoin(F.broadcast(q)).withColumn(of, F.greatest(F.least(F.col(of), F.col("__q")[1]), F.col("__q")[0])).drop("__q")  # one row


def daily_prices(entries: DataFrame) -> DataFrame:
    """(ticker, date, price, volume) of (ticker, pos, date, adjClose, volume), the first of a ticker and day by pos."""
    day = F.to_date(F.try_to_timestamp(F.substring(F.col("date").cast("string"), 1, 10), F.lit("yyyy-MM-dd")))
    rows = entries.select("ticker", "pos", day.alias("date"), finite(F.col("adjClose").cast("double")).alias("price"), finite(F.col("volume").cast("double")).alias("volume"))
    return first_by(rows.where("date is not null"), ["ticker", "date"], ["pos"]).drop("pos")


def event_windows(prices: DataFrame, filings: DataFrame, pre: int, post: int) -> DataFrame:
    """Price rows from pre before to post after each filing day, counted in the ticker's trading days; filings on other days have none.

    prices: (ticker, date, price, volume); filings: (ticker, filing_date, year). Windows end where the history does.
    """
    numbered = prices.withColumn("__n", F.row_number().over(Window.partitionBy("ticker").orderBy("date")))
    at = filings.join(numbered.select("ticker", F.col("date").alias("filing_date"), F.col("__n").alias("__at")), ["ticker", "filing_date"])
    # each event names its days, so that the join has only equal keys
    days = at.withColumn("__n", F.explode(F.sequence(F.greatest(F.col("__at") - pre, F.lit(1)), F.col("__at") + post)) if post >= -pre else F.lit(None).cast("int"))
    return days.join(numbered, ["ticker", "__n"]).withColumn("offset", F.col("__n") - F.col("__at")).drop("__n", "__at")


def stock_features(prices: DataFrame, filings: DataFrame, reversal: int = 21, year: int = 252) -> DataFrame:
    """(ticker, year, short_term_price_reversal, medium_term_price_momentum, volatility, mean_volume) around filing days.

    One pass over the longest window: the reversal is the return of the last days, the momentum that of the
    rest of the year, volatility its variance by its mean, and volume the mean of all.
    """
    rows = event_windows(prices, filings, year, 0)
    late, early = F.col("offset") >= -reversal, F.col("offset") <= -reversal
    change = lambda when: F.try_divide(F.max_by("price", F.when(when, F.col("date"))) - F.min_by("price", F.when(when, F.col("date"))), F.min_by("price", F.when(when, F.col("date"))))
    mid = F.when(early, F.col("price"))
    return rows.groupBy("ticker", "year").agg(
        change(late).alias("short_term_price_reversal"), change(early).alias("medium_term_price_momentum"),
        F.try_divide(F.var_samp(mid), F.avg(mid)).alias("volatility"), F.avg("volume").alias("mean_volume"),
    ).where("short_term_price_reversal is not null and medium_term_price_momentum is not null and volatility is not null")


def macro_wide(macro: DataFrame, indicators: list[str]) -> DataFrame:
    """(date, an indicator in each column), gaps filled from before; macro: (indicator, date, value). A few rows a day: one window."""
    wide = macro.groupBy("date").pivot("indicator", indicators).agg(F.first("value", ignorenulls=True))
    before = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return wide.select("date", *(F.last(i, ignorenulls=True).over(before).alias(i) for i in indicators))


def filing_windows(filings: DataFrame) -> DataFrame:
    """With the period and filing before of the same ticker, a year back where there is none."""
    order = Window.partitionBy("ticker").orderBy("period_of_report", "filing_date")
    back = lambda c: F.coalesce(F.lag(c).over(order), F.add_months(c, -12))
    return filings.withColumns({"previous_period": back("period_of_report"), "previous_filing": back("filing_date")})


def macro_last(filings: DataFrame, macro: DataFrame, indicators: list[str], at: str = "period_of_report") -> DataFrame:
    """filings with <indicator>_last: the value of the last macro date up to theirs."""
    named = macro.select("date", *(F.col(i).alias(f"{i}_last") for i in indicators))
    return asof_small(filings, named, at, "date", [f"{i}_last" for i in indicators])


def macro_mean(filings: DataFrame, macro: DataFrame, indicators: list[str], start: str = "previous_period", end: str = "period_of_report") -> DataFrame:
    """(ticker, year, <indicator>_mean) over the macro dates from start to end, null for empty windows.

    Means of intervals are differences of running sums, looked up at both ends: no date is joined to many filings.
    """
    order = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    # a row for each day that has macro figures, which are few
    sums = macro.select("date", *(x for i in indicators for x in (F.sum(F.coalesce(i, F.lit(0.0))).over(order).alias(f"{i}__s"), F.count(i).over(order).alias(f"{i}__n"))))
    names = [f"{i}__{k}" for i in indicators for k in "sn"]
    ends = asof_small(filings, sums, end, "date", names)
    before = sums.select(F.col("date"), *(F.col(n).alias(f"{n}0") for n in names))
    both = asof_small(ends.withColumn("__b", F.date_sub(start, 1)), before, "__b", "date", [f"{n}0" for n in names]).drop("__b")
    diff = lambda n: F.coalesce(F.col(n), F.lit(0)) - F.coalesce(F.col(f"{n}0"), F.lit(0))
    return both.withColumns({f"{i}_mean": F.try_divide(diff(f"{i}__s"), diff(f"{i}__n")) for i in indicators}).drop(*names, *(f"{n}0" for n in names))


def growth(rows: DataFrame, columns: list[str], by: str = "ticker", order: str = "year", factor: float = 100.0) -> DataFrame:
    """With <column>_change: from the last known value before, in percent; null for none or zero."""
    over = Window.partitionBy(by).orderBy(order)
    filled = lambda c: F.last(c, ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, 0))
    known = rows.withColumns({f"__{c}": filled(c) for c in columns})
    change = lambda c: F.try_divide(F.col(f"__{c}"), F.lag(f"__{c}").over(over)) - 1
    return known.withColumns({f"{c}_change": change(c) * factor for c in columns}).drop(*(f"__{c}" for c in columns))


def target_rows(entries: DataFrame, kpi: str, period: str = "FY") -> DataFrame:
    """(ticker, year, target) of the first entry of a ticker and year with that period and a number."""
    rows = entries.where(F.col("period") == period).withColumn("year", F.expr("try_cast(calendarYear as int)")).withColumn("target", finite(F.col(kpi).cast("double")))
    return first_by(rows.where("year is not null and target is not null"), ["ticker", "year"], ["pos"]).select("ticker", "year", "target")


def above_recent_mean(targets: DataFrame, window: int = 4) -> DataFrame:
    """target less the mean of the ticker's rows before, at most window and at least window - 1 of them; rows with fewer go."""
    before = Window.partitionBy("ticker").orderBy("year").rowsBetween(-window, -1)
    base = F.when(F.count("target").over(before) >= window - 1, F.avg("target").over(before))
    return targets.withColumn("__b", base).where("__b is not null").withColumn("target", F.col("target") - F.col("__b")).drop("__b")


def bounded_targets(targets: DataFrame, years: tuple[int, int] | None = None, below: float | None = None, least: float | None = None) -> DataFrame:
    """Targets of the years, of less absolute value than `below` and no less than `least`."""
    out = targets.where(F.col("year").between(*years)) if years else targets
    out = out.where(F.abs("target") < below) if below is not None else out
    return out.where(F.abs("target") >= least) if least is not None else out


def binary_target(targets: DataFrame) -> DataFrame:
    return targets.withColumn("target", F.when(F.col("target") > 0, 1).when(F.col("target").isNotNull(), 0))


def shifted_years(targets: DataFrame, by: int = -1) -> DataFrame:
    return targets.withColumn("year", F.col("year") + by)


def asof_filings(filings: DataFrame, events: DataFrame, at: str, value: str, by: str = "ticker") -> DataFrame:
    """filings with the last value of the same ticker up to their date."""
    return asof(filings, events, at, "date", [value], [by])
