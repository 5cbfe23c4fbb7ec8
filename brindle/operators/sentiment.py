"""Sentiment of documents and their topics from classified sentences.

Classes are 0 negative, 1 neutral, 2 positive. All nine measures come from one aggregation for each of
document and topic; shares of topics use the sum of the three classes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-5
METHODS = ("basic", "azimi", "huang", "zhang", "gupta_a", "gupta_b", "gupta_c", "renault", "vamossy")
TOPICS = tuple(range(12)) + (-1,)


def measures(cls: Column, prob: Column, eps: float = EPS, topic_level: bool = False) -> dict[str, Column]:
    """The aggregates of each method over the sentences of a group."""
    pos, neg, n = F.count_if(cls == 2).cast("double"), F.count_if(cls == 0).cast("double"), F.count_if(cls.isin(0, 1, 2)).cast("double")
    total = n + F.lit(eps) if topic_level else n
    signed = F.when(cls == 2, prob).when(cls == 0, -prob).otherwise(F.lit(0.0))
    share = lambda x: F.try_divide(x, total)
    return {
        "basic": F.avg(cls.cast("double")),
        "azimi": share(pos) / (share(neg) + F.lit(eps)),
        "huang": share(pos) - share(neg),
        "zhang": pos / (pos + neg + F.lit(eps)),
        "gupta_a": pos - neg,
        "gupta_b": pos / (n + F.lit(eps)),
        "gupta_c": (pos - neg) / (n + F.lit(eps)),
        "renault": F.avg(signed),
        "vamossy": F.sum(signed) / (1 + F.sum(prob) + F.lit(eps)),
    }


def document_sentiment(found: DataFrame, neutral: bool = True, methods: tuple[str, ...] = METHODS) -> DataFrame:
    """(doc_id, a column for each method) of (doc_id, topic, sentiment_class, sentiment_prob). neutral: whether those sentences count."""
    rows = found if neutral else found.where("sentiment_class <> 1")
    all_of = measures(F.col("sentiment_class"), F.col("sentiment_prob"))
    return rows.groupBy("doc_id").agg(*(all_of[m].alias(m) for m in methods))


def topic_sentiment(found: DataFrame, neutral: bool = True, methods: tuple[str, ...] = METHODS) -> DataFrame:
    """(doc_id, topic, a column for each method)."""
    rows = found if neutral else found.where("sentiment_class <> 1")
    all_of = measures(F.col("sentiment_class"), F.col("sentiment_prob"), topic_level=True)
    return rows.groupBy("doc_id", "topic").agg(*(all_of[m].alias(m) for m in methods))


def sentiment_features(found: DataFrame, method: str, neutral: bool = True, topics: tuple[int, ...] = TOPICS) -> DataFrame:
    """doc_id, mean_sentiment and mean_sentiment_topic_<id> of one method; null for topics that a document lacks."""
    whole = document_sentiment(found, neutral, (method,)).withColumnRenamed(method, "mean_sentiment")
    wide = topic_sentiment(found, neutral, (method,)).groupBy("doc_id").pivot("topic", list(topics)).agg(F.first(method))
    return whole.join(wide.select("doc_id", *(F.col(f"`{t}`").alias(f"mean_sentiment_topic_{t}") for t in topics)), "doc_id")


def topic_scores(features: DataFrame) -> DataFrame:
    """(doc_id, topic, score) from the mean_sentiment_topic_ columns, without nulls."""
    names = [c for c in features.columns if c.startswith("mean_sentiment_topic_")]
    long = features.unpivot("doc_id", names, "name", "score").where("score is not null")
    return long.select("doc_id", F.regexp_extract("name", r"mean_sentiment_topic_(-?\d+)", 1).cast("int").alias("topic"), "score")


def feature_vector(features: DataFrame, columns: list[str]) -> DataFrame:
    """(doc_id, features): an array with zeros for nulls."""
    return features.select("doc_id", F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns)).alias("features"))


def with_additions(companies: DataFrame, additions: DataFrame) -> DataFrame:
    """(cik, ticker, pos) of companies with (cik, ticker) added by hand, which count as later than all others of a cik."""
    last = companies.agg(F.coalesce(F.max("pos"), F.lit(0)).cast("long").alias("__m"))
    added = additions.crossJoin(F.broadcast(last)).select("cik", "ticker", (F.col("__m") + 1).alias("pos"))  # one row
    return companies.select("cik", "ticker", F.col("pos").cast("long").alias("pos")).unionByName(added)


def with_company(features: DataFrame, filings: DataFrame, companies: DataFrame, one_per_year: bool = True, keep_date: bool = True) -> DataFrame:
    """features with ticker, filing_date and year_of_report of the filing.

    filings: (doc_id, cik, filing_date as yyyyMMdd, year_of_report, pos); the first by pos of a document counts, without a
    year it goes. companies: (cik, ticker, pos); the last of a cik counts. one_per_year: the first document of a ticker and year.
    """
    first = filings.withColumn("__r", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))).where("__r = 1")
    year = F.expr("try_cast(year_of_report as int)")
    dated = first.withColumn("year_of_report", year).where("year_of_report is not null").withColumn("filing_date", F.to_date(F.try_to_timestamp("filing_date", F.lit("yyyyMMdd"))))
    last = companies.withColumn("__r", F.row_number().over(Window.partitionBy("cik").orderBy(F.desc("pos")))).where("__r = 1").select("cik", "ticker")
    joined = features.join(dated.select("doc_id", "cik", "filing_date", "year_of_report"), "doc_id").join(last, "cik", "left")
    if one_per_year:
        joined = joined.withColumn("__r", F.row_number().over(Window.partitionBy("ticker", "year_of_report").orderBy("doc_id"))).where("__r = 1").drop("__r")
    return joined if keep_date else joined.drop("filing_date")


def text_stats(found: DataFrame, doc: str = "doc_id", text: str = "sentence", topic: str = "topic", topics: tuple[int, ...] | None = None) -> DataFrame:
    """(doc, num_sentences, num_words, avg_sentence_length, std_sentence_length, topic_ratio_<id>); the deviation is the population's."""
    from ..functions.text import word_count

    counted = found.withColumn("__w", word_count(F.col(text)))
    ratio = lambda t: F.when(F.count_if(F.col(topic) == t) > 0, F.count_if(F.col(topic) == t) / F.count("*"))
    return counted.groupBy(doc).agg(
        F.count("*").alias("num_sentences"), F.sum("__w").alias("num_words"), (F.sum("__w") / F.count("*")).alias("avg_sentence_length"), F.stddev_pop("__w").alias("std_sentence_length"),
        *(ratio(t).alias(f"topic_ratio_{t}") for t in topics or ()),
    )


def class_ratios(found: DataFrame, keys: tuple[str, ...] = ("doc_id",), sentiment: str = "sentiment_class", forward: str = "fls_class", classes: tuple[int, ...] = (0, 1, 2), forward_classes: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """Shares of sentiment classes, of forward-looking classes, and of both together, for each of the keys."""
    part = lambda test: F.count_if(test) / F.count("*")
    of = {f"sentiment_{c}": F.col(sentiment) == c for c in classes} | {f"fls_{c}": F.col(forward) == c for c in forward_classes}
    of |= {f"sentiment_{a}_fls_{b}": (F.col(sentiment) == a) & (F.col(forward) == b) for a in classes for b in forward_classes}
    return found.groupBy(*keys).agg(*(part(test).alias(f"ratio_{k}") for k, test in of.items()))
