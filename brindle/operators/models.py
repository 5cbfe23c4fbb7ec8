"""Classifiers on prepared rows, by Spark's own library."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_class_weight(rows: DataFrame, label: str, weight: str = "weight") -> DataFrame:
    """Rows weighted so that both classes count alike."""
    sizes = rows.groupBy(label).agg(F.count("*").alias("__n"))
    total = rows.agg(F.count("*").alias("__all"))
    return rows.join(F.broadcast(sizes.crossJoin(total)), label).withColumn(weight, F.col("__all") / (2.0 * F.col("__n"))).drop("__n", "__all")  # a row for each class


def _vectors(train: DataFrame, test: DataFrame, columns: list[str], impute: bool) -> tuple[DataFrame, DataFrame]:
    train, test = (df.withColumns({c: F.col(c).cast("double") for c in columns}) for df in (train, test))
    names = columns
    if impute:
        some = [c for c, n in train.agg(*(F.count(c).alias(c) for c in columns)).first().asDict().items() if n]  # one row
        filler = Imputer(inputCols=some, outputCols=[f"__i_{c}" for c in some], strategy="median").fit(train)
        missing = {f"__n_{c}": F.when(F.col(c).isNull(), 1.0).otherwise(0.0) for c in some}
        train, test = (filler.transform(df).withColumns(missing) for df in (train, test))
        names = [f"__i_{c}" for c in some] + list(missing)
    assembler = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep")
    return assembler.transform(train), assembler.transform(test)


def classify(kind: str, train: DataFrame, test: DataFrame, columns: list[str], label: str = "target", balanced: bool = True, seed: int = 42, folds: int = 0, **options) -> DataFrame:
    """test with prob and y_pred of a model of kind lr, rf or gbt fitted on train.

    lr: L2 with C = 1, that is, a penalty of 1 / rows. rf and gbt fill missing values by medians and mark them.
    folds: of a cross-validation of options given as lists.
    """
    rows = with_class_weight(train, label) if balanced else train.withColumn("weight", F.lit(1.0))
    rows = rows.withColumn(label, F.col(label).cast("double"))
    fit_on, apply_to = _vectors(rows, test, columns, impute=kind != "lr")
    common = {"featuresCol": "features", "labelCol": label, "weightCol": "weight", "probabilityCol": "__p", "rawPredictionCol": "__raw", "predictionCol": "__pred"}
    fixed = {k: v for k, v in options.items() if not isinstance(v, list)}
    if kind == "lr":
        model = LogisticRegression(**common, **({"regParam": 1.0 / max(1, train.count()), "elasticNetParam": 0.0, "standardization": False} | fixed))
    elif kind == "rf":
        model = RandomForestClassifier(**common, **({"maxDepth": 3, "numTrees": 100, "subsamplingRate": 0.5, "seed": seed} | fixed))
    elif kind == "gbt":
        own = {k: v for k, v in common.items() if k not in ("probabilityCol", "rawPredictionCol")}
        model = GBTClassifier(**own, **({"maxDepth": 2, "maxIter": 50, "stepSize": 0.1, "subsamplingRate": 0.8, "seed": seed} | fixed))
    else:
        raise ValueError(f"no model of kind {kind}")
    if folds:
        grid = ParamGridBuilder()
        for k, v in options.items():
            if isinstance(v, list):
                grid = grid.addGrid(getattr(model, k), v)
        model = CrossValidator(estimator=model, estimatorParamMaps=grid.build(), evaluator=BinaryClassificationEvaluator(labelCol=label, rawPredictionCol=model.getRawPredictionCol()), numFolds=folds, seed=seed)
    fitted = model.fit(fit_on).transform(apply_to)
    out = fitted.withColumn("prob", vector_to_array("__p" if "__p" in fitted.columns else "probability")[1])
    return out.withColumn("y_pred", F.when(F.col("prob") >= 0.5, 1).otherwise(0)).select(*(F.col(f"`{c}`") for c in test.columns), "prob", "y_pred")


def importances(train: DataFrame, columns: list[str], label: str = "target", seed: int = 42, trees: int = 100, depth: int = 3) -> DataFrame:
    """(column, importance) of a forest fitted on train, adding up to 1: a filled value and its mark of missing count as one column."""
    rows = with_class_weight(train, label).withColumn(label, F.col(label).cast("double"))
    fit_on, _ = _vectors(rows, rows.limit(0), columns, impute=True)
    model = RandomForestClassifier(featuresCol="features", labelCol=label, weightCol="weight", maxDepth=depth, numTrees=trees, subsamplingRate=0.5, seed=seed).fit(fit_on)
    names = [a["name"] for kind in fit_on.schema["features"].metadata["ml_attr"]["attrs"].values() for a in sorted(kind, key=lambda a: a["idx"])]
    found = dict.fromkeys(columns, 0.0)
    for name, value in zip(names, model.featureImportances.toArray(), strict=True):
        found[name[4:]] += float(value)
    return train.sparkSession.createDataFrame(sorted(found.items()), "column string, importance double")


def certain(rows: DataFrame, low: float = 0.4, high: float = 0.6, prob: str = "prob") -> DataFrame:
    """Rows whose probability is below or above the doubtful range."""
    return rows.where((F.col(prob) < low) | (F.col(prob) > high))
