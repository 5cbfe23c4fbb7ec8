"""How good topics are as words: class TF-IDF and keyword matrices, in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from .sentences import NOISE


def term_counts(docs: DataFrame, topic_col: str = "topic", text_col: str = "text", pattern: str = "[^a-z]+", shortest: int = 2) -> DataFrame:
    """(topic, token, n) over the texts of each topic but noise, without putting the texts together.

    Null topics, null and empty texts have no rows; repeated rows count each; an empty table gives no rows.
    """
    kept = docs.where(F.col(topic_col).isNotNull() & (F.col(topic_col).cast("string") != str(NOISE)))
    words = kept.select(F.col(topic_col).alias("topic"), F.explode(F.split(F.lower(text_col), pattern)).alias("token"))
    return words.where(F.length("token") >= shortest).groupBy("topic", "token").agg(F.count("*").alias("n"))


def ngram_counts(docs: DataFrame, topic_col: str = "topic", text_col: str = "text", lengths: tuple[int, int] = (1, 1), least: float = 0.0, most: float = 1.0, vocabulary: int | None = None, pattern: str = "[^a-z]+", shortest: int = 2) -> DataFrame:
    """(topic, token, n) like term_counts, of runs of `lengths` words, joined by a space, from the shortest to the longest.

    least, most: the shares of documents, noise and null topics left out, that a token has to be in. vocabulary: of the tokens left, so many of the highest
    counts over all topics, of equal ones the first in the alphabet. Words shorter than `shortest` are passed over before runs are made. Null
    and empty texts are documents without tokens; repeated rows count each.
    """
    low, high = lengths
    if not 1 <= low <= high:
        raise ValueError("lengths are from 1, the shorter first")
    kept = docs.where(F.col(topic_col).isNotNull() & (F.col(topic_col).cast("string") != str(NOISE)))
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), pattern), lambda w: F.length(w) >= shortest)
    # words are looked up by their place: a slice for each run would copy all of a text's words each time
    run = lambda w, n: F.transform(F.slice(w, 1, F.greatest(F.size(w) - (n - 1), F.lit(0))), lambda x, i: F.concat_ws(" ", x, *(F.get(w, i + j) for j in range(1, n))))
    # in order, so that a token's first place in the document is told without a shuffle; the outer lambdas bind the words and the tokens, once
    runs = F.transform(F.array(words), lambda w: F.sort_array(F.concat(*(run(w, n) for n in range(low, high + 1)))))
    marked = F.transform(runs, lambda s: F.transform(s, lambda x, i: F.struct(x.alias("token"), F.when((i > 0) & (F.get(s, i - 1) == x), 0).otherwise(1).alias("new"))))[0]
    # outer, as for an inner one Spark would make all arrays once more, to filter empty ones
    each = kept.select(F.col(topic_col).alias("topic"), F.explode_outer(marked).alias("t")).where("t is not null").select("topic", "t.*")
    # used twice, of different columns, so that Spark would count twice
    counted = cut(each.groupBy("topic", "token").agg(F.count("*").alias("n"), F.sum("new").alias("df")))
    whole = counted.groupBy("token").agg(F.sum("n").alias("all"), F.sum("df").alias("df"))
    total = F.broadcast(kept.agg(F.count("*").alias("docs")))  # one row
    good = whole.crossJoin(total).where((F.col("df") >= F.lit(least) * F.col("docs")) & (F.col("df") <= F.lit(most) * F.col("docs")))
    if vocabulary is not None:
        good = good.orderBy(F.desc("all"), "token").limit(vocabulary)
    return counted.join(good.select("token"), "token", "left_semi").select("topic", "token", "n")


def class_tfidf(counts: DataFrame, seeds: tuple[str, ...] = (), seed_multiplier: float = 1.0, bm25: bool = True, reduce_frequent: bool = True) -> DataFrame:
    """(topic, token, n, score): share of the topic's tokens, its root if frequent ones are to be reduced, times idf.

    A token that a seed word is part of has its score multiplied. Tokens of which the idf isn't defined go.
    counts has a row for each topic and token; an empty one gives no rows.
    """
    sizes = counts.groupBy("topic").agg(F.sum("n").alias("total"))
    mean = sizes.agg(F.floor(F.avg("total")).cast("double").alias("a"))
    df = counts.groupBy("token").agg(F.sum("n").cast("double").alias("df"))
    joined = counts.join(df, "token").join(F.broadcast(sizes), "topic").crossJoin(F.broadcast(mean))  # as many rows as topics; one row
    share = F.col("n") / F.col("total")
    odds = (F.col("a") - F.col("df") + 0.5) / (F.col("df") + 0.5) if bm25 else F.col("a") / F.col("df")
    boost = F.when(F.exists(F.array(*map(F.lit, seeds)), lambda s: F.contains(F.col("token"), s)), F.lit(seed_multiplier)).otherwise(1.0) if seeds else F.lit(1.0)
    return joined.where(1 + odds > 0).select("topic", "token", "n", ((F.sqrt(share) if reduce_frequent else share) * F.log(1 + odds) * boost).alias("score"))


def top_tokens(scored: DataFrame, n: int = 5) -> DataFrame:
    """The n best tokens of each topic with their rank; of equal scores the first in the alphabet."""
    order = Window.partitionBy("topic").orderBy(F.desc("score"), "token")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def keyword_matrix(counts: DataFrame, keywords: tuple[str, ...]) -> DataFrame:
    """(topic, token, n, scaled): counts of the keywords that occur, and those scaled from 0 to 1 over the topics.

    A keyword that all topics have equally often is scaled to 0. Where no keyword occurs there are no rows.
    """
    kept = counts.where(F.col("token").isin(*keywords))
    grid = counts.select("topic").distinct().crossJoin(F.broadcast(kept.select("token").distinct()))  # no more rows than keywords
    filled = grid.join(kept, ["topic", "token"], "left").select("topic", "token", F.coalesce("n", F.lit(0)).alias("n"))
    over = Window.partitionBy("token")
    scaled = F.coalesce(F.try_divide((F.col("n") - F.min("n").over(over)).cast("double"), (F.max("n").over(over) - F.min("n").over(over)).cast("double")), F.lit(0.0))
    return filled.withColumn("scaled", scaled)


def keyword_pivot(matrix: DataFrame, keywords: tuple[str, ...], value: str = "n") -> DataFrame:
    """A row for each topic with a column for each keyword, null for one that occurs nowhere; an empty matrix gives no rows."""
    return matrix.groupBy("topic").pivot("token", list(keywords)).agg(F.first(value))
