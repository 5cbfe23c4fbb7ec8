"""Datasets for models: assembly, split, missing values, outliers, scaling, oversampling."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .fundamentals import finite
from .ranks import quantiles, ranked
from .vectors import nearest

# Numbers that stand for missing ones, and columns that are no features.
PLACEHOLDERS = (-1.0, -999.0, 999.0, -9999.0, 9999.0)
NO_FEATURES = (
    "fiscal_year", "fiscal_year_growth", "year_x", "year_y", "fiscal_year_x", "fiscal_year_y", "fiscal_year_growth_x", "fiscal_year_growth_y", "doc_id", "year_of_report", "index", "pred_year", "key_date",
)


def target_base(targets: DataFrame, text: DataFrame, shift: int = 1) -> DataFrame:
    """Targets with pred_year = year - shift, of the ticker and pred_year of which there is a text."""
    keys = text.select("ticker", F.col("year_of_report").alias("pred_year")).distinct()
    return targets.withColumn("pred_year", F.col("year") - shift).join(keys, ["ticker", "pred_year"], "left_semi")


def datasets(base: DataFrame, financials: DataFrame, text: DataFrame, model_text: DataFrame | None = None) -> dict[str, DataFrame]:
    """F0 text alone, F1 financials, F2 with the document's sentiment, F3 with its topics', and F4 with those a model gave.

    Financials of pred_year are required, texts are not.
    """
    fin = base.join(financials.withColumnRenamed("year", "pred_year"), ["ticker", "pred_year"])
    topics = [c for c in text.columns if c.startswith("mean_sentiment")]
    of = text.withColumnRenamed("year_of_report", "pred_year")
    join = lambda left, right, cols: left.join(right.select("ticker", "pred_year", *cols), ["ticker", "pred_year"], "left")
    out = {"F0": join(base, of, topics), "F1": fin, "F2": join(fin, of, ["mean_sentiment"]), "F3": join(fin, of, topics)}
    if model_text is not None:
        other = model_text.withColumnRenamed("year_of_report", "pred_year")
        out["F4"] = join(fin, other, [c for c in model_text.columns if c.startswith("mean_sentiment")])
    return out


def numeric_columns(rows: DataFrame, leave: tuple[str, ...] = NO_FEATURES) -> list[str]:
    return [f.name for f in rows.schema.fields if isinstance(f.dataType, NumericType) and f.name not in leave]


def without_infinities(rows: DataFrame) -> DataFrame:
    """NaN and infinite numbers as null."""
    return rows.withColumns({c: finite(F.col(c)) for c, kind in rows.dtypes if kind in ("double", "float")})


def placeholders_to_null(rows: DataFrame, columns: list[str], values: tuple[float, ...] = PLACEHOLDERS) -> DataFrame:
    return rows.withColumns({c: F.when(~F.col(c).isin(*values), F.col(c)) for c in columns})


def iqr_bounds(rows: DataFrame, columns: list[str], whisker: float = 1.5) -> DataFrame:
    """One row with an array (low, high) for each column: quartiles less and plus the whisker's share of their range."""
    quarts = quantiles(rows, columns, (0.25, 0.75))
    return quarts.select(*(F.array(F.col(c)[0] - whisker * (F.col(c)[1] - F.col(c)[0]), F.col(c)[1] + whisker * (F.col(c)[1] - F.col(c)[0])).alias(c) for c in columns))


def outliers_to_null(rows: DataFrame, columns: list[str], fitted_on: DataFrame | None = None, whisker: float = 1.5) -> DataFrame:
    """Values outside of the bounds as null; bounds are those of fitted_on, by default of the rows themselves."""
    bounds = iqr_bounds(rows if fitted_on is None else fitted_on, columns, whisker)
    both = rows.crossJoin(F.broadcast(bounds.select(*(F.col(c).alias(f"__{c}") for c in columns))))  # one row
    return both.withColumns({c: F.when(F.col(c).between(F.col(f"__{c}")[0], F.col(f"__{c}")[1]), F.col(c)) for c in columns}).drop(*(f"__{c}" for c in columns))


def scale(rows: DataFrame, columns: list[str], fitted_on: DataFrame | None = None) -> DataFrame:
    """Columns less their mean, by their population deviation; a constant column is only centred."""
    fit = (rows if fitted_on is None else fitted_on).agg(*(x for c in columns for x in (F.avg(c).alias(f"__m_{c}"), F.stddev_pop(c).alias(f"__s_{c}"))))
    both = rows.crossJoin(F.broadcast(fit))  # one row
    return both.withColumns({c: (F.col(c) - F.col(f"__m_{c}")) / F.when(F.col(f"__s_{c}") > 0, F.col(f"__s_{c}")).otherwise(1.0) for c in columns}).drop(*(f"__{k}_{c}" for c in columns for k in "ms"))


def split_by_year(rows: DataFrame, first_test_year: int, year: str = "year") -> tuple[DataFrame, DataFrame]:
    return rows.where(F.col(year) < first_test_year), rows.where(F.col(year) >= first_test_year)


def _problem(c: str, values: tuple[float, ...]) -> Column:
    return F.when(F.col(c).isNull() | F.col(c).isin(*values), 1.0).otherwise(0.0)


def drop_problem_rows(rows: DataFrame, columns: list[str], threshold: float = 0.6, values: tuple[float, ...] = (0.0, -1.0)) -> DataFrame:
    """Rows of which less than that share of the columns, sentiment aside, is null or one of the values."""
    counted = [c for c in columns if "_sentiment" not in c]
    if not counted:
        return rows
    share = sum((_problem(c, values) for c in counted[1:]), _problem(counted[0], values)) / len(counted)
    return rows.where(share < threshold)


def problem_shares(rows: DataFrame, columns: list[str], values: tuple[float, ...] = (0.0, -1.0)) -> DataFrame:
    """(column, share) of rows in which a column is null or one of the values: one pass."""
    sums = rows.agg(*(F.avg(_problem(c, values)).alias(c) for c in columns))
    return sums.unpivot([], columns, "column", "share")


def drop_problem_columns(train: DataFrame, others: list[DataFrame], columns: list[str], threshold: float = 0.5) -> list[DataFrame]:
    """train and others without the columns that are a problem in at least that share of train."""
    gone = [r["column"] for r in problem_shares(train, columns).where(F.col("share") >= threshold).collect()]  # at most a row for each column
    return [df.drop(*gone) for df in (train, *others)]


def class_report(rows: DataFrame, label: str, columns: list[str]) -> DataFrame:
    """(label, n, nulls, zeros) of each class."""
    total = lambda test: sum((test(c) for c in columns[1:]), test(columns[0]))
    nulls = total(lambda c: F.when(F.col(c).isNull(), 1).otherwise(0))
    zeros = total(lambda c: F.when(F.col(c) == 0, 1).otherwise(0))
    return rows.groupBy(label).agg(F.count("*").alias("n"), F.sum(nulls).alias("nulls"), F.sum(zeros).alias("zeros"))


def oversample(rows: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """Every row, and those of smaller classes again until all classes are as large; which repeat more goes by a checksum of the key."""
    most = rows.groupBy(label).count().agg(F.max("count").alias("__m"))
    times = F.floor(F.col("__m") / F.col("__n")) + F.when(F.col("__r") < F.col("__m") % F.col("__n"), 1).otherwise(0)
    sized = ranked(rows, [label], key, seed).crossJoin(F.broadcast(most)).withColumn("__t", times.cast("int"))  # one row
    return sized.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("__t") - 1))).select(*(F.col(f"`{c}`") for c in rows.columns), "copy")


def smote(rows: DataFrame, label: str, minority: int, columns: list[str], key: str, need: int | None = None, k: int = 5, seed: int = 42) -> DataFrame:
    """`need` new rows of the smaller class, each between a row and one of its k nearest neighbours in that class.

    need: by default as many as make the class as large as all others together. Neighbours are exact at any size. Each row has as many new ones as
    any other but for the rest, which goes by ranks of the key; neighbour and point between go by hashes.
    Keys are to be unique and not null; rows with a null in one of the columns take no part; a class of one row has no new ones.
    """
    sizes = {r[0]: r[1] for r in rows.groupBy(F.col(label) == minority).count().collect()}  # at most three rows
    own = rows.where(F.col(label) == minority).select(F.col(key).cast("long").alias("id"), F.array(*(F.col(f"`{c}`").cast("double") for c in columns)).alias("v"))
    own = own.where(~F.exists("v", lambda x: x.isNull()))
    n = own.count()
    need = sizes.get(False, 0) - sizes.get(True, 0) if need is None else need
    if n < 2 or need <= 0:
        return rows.sparkSession.createDataFrame([], f"{key} long, {label} int, " + ", ".join(f"{c} double" for c in columns))
    near = nearest(own, own, min(k, n - 1), "euclidean", others=True).groupBy("q").agg(F.array_sort(F.collect_list(F.struct("rank", "neighbour"))).alias("near"))
    turns = ranked(own, [], "id", seed).withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(need // n)))).where((F.col("turn") < need // n) | (F.col("__r") < need % n))
    hashed = lambda tag: F.xxhash64("id", "turn", F.lit(seed), F.lit(tag))
    chosen = turns.join(near, turns["id"] == near["q"]).withColumn("other", F.get("near", F.pmod(hashed("row"), F.size("near")).cast("int"))["neighbour"])
    u = F.pmod(hashed("point"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    other = own.select(F.col("id").alias("other"), F.col("v").alias("w"))
    made = chosen.join(other, "other").select("id", F.zip_with("v", "w", lambda a, b: a + u * (b - a)).alias("v"))
    return made.select(F.col("id").alias(key), F.lit(minority).alias(label), *(F.col("v")[i].alias(c) for i, c in enumerate(columns)))


@dataclass
class Preparation:
    """The steps before a model, fitted on the training years."""

    label: str = "target"
    key: str = "id"
    year: str = "year"
    first_test_year: int = 2020
    row_threshold: float = 0.6
    column_threshold: float = 0.5
    outliers: bool = True
    outliers_by_train: bool = True
    fill_zero: bool = True
    scaled: bool = True
    oversampled: bool = False
    columns: list[str] = field(default_factory=list)

    def run(self, rows: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
        """(train, test, columns): rows, split, placeholders, outliers, columns, zeros, oversampling, scaling, in this order."""
        columns = self.columns or [c for c in numeric_columns(rows) if c not in (self.label, self.key, self.year)]
        kept = drop_problem_rows(without_infinities(rows), columns, self.row_threshold)
        train, test = split_by_year(kept, self.first_test_year, self.year)
        train, test = (placeholders_to_null(df, columns) for df in (train, test))
        if self.outliers:
            bounds = train if self.outliers_by_train else None
            train, test = outliers_to_null(train, columns), outliers_to_null(test, columns, bounds)
        train, test = drop_problem_columns(train, [test], columns, self.column_threshold)
        columns = [c for c in columns if c in train.columns]
        if self.fill_zero:
            train, test = train.fillna(0, columns), test.fillna(0, columns)
        if self.oversampled:
            train = oversample(train, self.label, self.key).drop("copy")
        if self.scaled:
            test, train = scale(test, columns, train), scale(train, columns)
        return train, test, columns


def tree_preparation(**options) -> Preparation:
    """The steps for trees: missing values stay and nothing is scaled."""
    return Preparation(**({"fill_zero": False, "scaled": False} | options))


def value_lists(rows: DataFrame, keys: list[str], value: str, order: str, noise_as: int | None = 14) -> DataFrame:
    """(keys, values): each key's values in order; -1 recoded."""
    v = F.when(F.col(value) == -1, F.lit(noise_as)).otherwise(F.col(value)) if noise_as is not None else F.col(value)
    return rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), v.alias("v")))), lambda s: s["v"]).alias("values"))


def one_hot(value: Column, classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: F.when(i == value, 1).otherwise(0))


def padded(values: Column, length: int, fill: int = 0) -> Column:
    """An array cut, or filled at its end, to a length."""
    return F.slice(F.concat(values, F.array_repeat(F.lit(fill), length)), 1, length)


def stratified_split(docs: DataFrame, label: str, key: str, share: float = 0.8, seed: int = 42) -> DataFrame:
    """docs with split train or test: of each label that share of the documents, by a checksum of the key.

    A label of one document has it in train; null labels are a class; repeated rows are dealt each.
    """
    place = F.when(F.col("__n") > 1, F.col("__r") / (F.col("__n") - 1)).otherwise(0.0)
    return ranked(docs, [label], key, seed).withColumn("split", F.when(place < share, "train").otherwise("test")).drop("__r", "__n")
