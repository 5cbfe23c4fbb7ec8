"""Sentence boundaries learnt from the text itself: abbreviations, words that open sentences, words that go together.

No list of abbreviations is needed. A word that nearly always has a full stop after it, for its length, is an abbreviation; a word that
comes after ends of sentences much more often than elsewhere opens sentences; a word that follows a certain abbreviation more often
than chance has it belongs to it. Each is a log-likelihood ratio of counts, and all counts are aggregates over the words of all documents.
What is learnt is three tables, which may be stored and used for other documents.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: White space between words, and what a sentence ends with.
SPACE = r"[ \t\n\x0B\f\r]+"
END = r"([.!?][\"')\]]*)([ \t\n\x0B\f\r]+)(?=[^\p{Ll} \t\n\x0B\f\r])"
#: Types that are numbers count as one.
NUMBER = "#"
#: The least score of an abbreviation, of a word that opens sentences, of two words that go together.
ABBREVIATION, OPENER, TOGETHER = 0.3, 30.0, 7.88
#: Rows of a learnt table that are sent to all executors; larger tables are joined by a shuffle.
SENT_ROWS = 200_000


class Learnt(NamedTuple):
    """abbreviations (type, n_stop, n_bare, score); openers (type, opens, lower, inside): whether a word opens sentences, is seen in lower case, and capitalised inside of sentences; together (type, next, score)."""

    abbreviations: DataFrame
    openers: DataFrame
    together: DataFrame


def core(word: Column) -> Column:
    """A word without the signs around it, but with full stops after it."""
    return F.regexp_replace(word, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}.]+$", "")


def type_of(word: Column) -> Column:
    """The lower-cased core of a word without full stops after it; numbers are one type. Empty where there are no letters and digits."""
    bare = F.regexp_replace(core(word), r"\.+$", "")
    return F.when(bare.rlike(r"^[0-9][0-9.,/\-]*$"), F.lit(NUMBER)).otherwise(F.lower(bare))


def stopped(word: Column) -> Column:
    """Whether one full stop ends the word's core."""
    return core(word).rlike(r"[^.]\.$")


def ends(word: Column) -> Column:
    """Whether a sentence could end with the word: by a stop or another sign, and marks that close."""
    return word.rlike(r"[.!?][\"')\]]*$")


def initial(kind: Column) -> Column:
    """Whether a type is a single letter, as of a name."""
    return kind.rlike(r"^\p{L}$")


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(ahead, word, n): how often each word comes after each that a sentence could end with; ahead is null after other words and empty at a text's start.

    One pass over the texts; only this table, of distinct words, is looked at further. Null and empty texts have no words.
    """
    words = F.filter(F.split(F.col(f"`{text_col}`"), SPACE), lambda w: w != F.lit(""))
    last = lambda w: F.substring(w, -1, 1).isin(*".!?\"')]")
    before = lambda i: F.get(F.col("__w"), i - 1)
    pairs = F.transform(F.col("__w"), lambda w, i: F.struct(F.when(i == 0, F.lit("")).when(last(before(i)), before(i)).alias("ahead"), w.alias("word")))
    # outer, as for an inner one Spark would make all arrays once more, to filter empty ones
    seen = docs.select(words.alias("__w")).select(F.explode_outer(pairs).alias("p")).where("p is not null")
    # a condition on the count as well stays behind it: else the core is told of each word's place, not once of each pair
    return seen.groupBy("p.ahead", "p.word").agg(F.count("*").alias("n")).where(F.when(F.col("n") > 0, core(F.col("word"))) != "")


def _log_likelihood(both: Column, a: Column, b: Column, n: Column) -> Column:
    """Dunning's ratio of two events in n places, seen a and b times and together `both` times; 0 where a share is 0 or 1 for certain."""
    part = lambda k, m, p: F.when((p > 0) & (p < 1), k * F.log(p) + (m - k) * F.log(1 - p)).otherwise(F.lit(0.0))
    p, p1, p2 = F.try_divide(b, n), F.try_divide(both, a), F.try_divide(b - both, n - a)
    return -2 * (part(both, a, p) + part(b - both, n - a, p) - part(both, a, p1) - part(b - both, n - a, p2))


def abbreviations(counts: DataFrame, least: float = ABBREVIATION) -> DataFrame:
    """(type, n_stop, n_bare, score) of the types that are abbreviations, from word_counts.

    score: how much likelier it is that nearly each of the word's places has a stop than that stops fall as on all words, less for long
    words and those that are seen without a stop, more for stops inside.
    """
    word = F.col("word")
    kinds = counts.groupBy("word").agg(F.sum("n").alias("n")).select(type_of(word).alias("type"), stopped(word).alias("stop"), "n")
    counted = kinds.groupBy("type").agg(F.sum(F.when(F.col("stop"), F.col("n")).otherwise(0)).alias("n_stop"), F.sum(F.when(F.col("stop"), 0).otherwise(F.col("n"))).alias("n_bare"))
    total = counted.agg(F.sum("n_stop").alias("stops"), F.sum(F.col("n_stop") + F.col("n_bare")).alias("n"))
    share = F.col("stops") / F.col("n")
    letters = F.length(F.regexp_replace("type", r"\.", "")).cast("double")
    near, far = F.col("n_stop") * F.log(F.lit(0.99)) + F.col("n_bare") * F.log(F.lit(0.01)), F.col("n_stop") * F.log(share) + F.col("n_bare") * F.log(1 - share)
    score = 2 * (near - far) * F.exp(-letters) * (F.length("type") - letters + 1) * F.pow(letters, -F.col("n_bare"))
    fit = (F.col("n_stop") > 0) & F.col("type").rlike(r"\p{L}") & (F.col("stops") < F.col("n"))
    # one row of totals
    return counted.crossJoin(F.broadcast(total)).where(fit).select("type", "n_stop", "n_bare", score.alias("score")).where(F.col("score") >= least)


def _sized(table: DataFrame) -> DataFrame:
    """The table, to be sent whole if it has no more than SENT_ROWS."""
    return F.broadcast(table) if table.limit(SENT_ROWS + 1).count() <= SENT_ROWS else table


def learn(docs: DataFrame, text_col: str = "text") -> Learnt:
    """What the texts of docs teach about boundaries.

    Null and empty texts teach nothing; repeated rows count as often as they are there; without words the tables are empty. The texts are read
    once; counts and abbreviations are written to the folder of checkpoints.
    """
    counts = cut(word_counts(docs, text_col))
    known = cut(abbreviations(counts))
    listed = _sized(known.select(F.col("type").alias("__a")))
    first = core(F.col("word"))
    ahead = F.col("ahead")
    pairs = counts.where("ahead is null or ahead <> ''").select(
        type_of(ahead).alias("type"), F.coalesce(ends(ahead), F.lit(False)).alias("ends"), F.coalesce(stopped(ahead), F.lit(False)).alias("stop"), type_of(F.col("word")).alias("next"), first.rlike(r"^\p{Lu}").alias("upper"), first.rlike(r"^\p{Ll}").alias("lower"), "n"
    )
    joined = pairs.join(listed, F.col("type") == F.col("__a"), "left")
    short = F.col("ends") & F.col("stop") & (F.col("__a").isNotNull() | F.coalesce(initial(F.col("type")), F.lit(False)))
    kinds = joined.withColumn("short", short).withColumn("over", F.col("ends") & ~F.col("short") & (F.coalesce("type", F.lit("")) != NUMBER))
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    after = kinds.groupBy("next").agg(F.sum("n").alias("n"), count(F.col("over")).alias("n_over"), count(F.col("lower")).alias("n_lower"), count(F.col("upper") & ~F.col("ends")).alias("n_inside"))
    total = F.broadcast(after.agg(F.sum("n").alias("all"), F.sum("n_over").alias("overs")))  # one row of totals
    ratio = _log_likelihood(F.col("n_over"), F.col("overs"), F.col("n"), F.col("all"))
    opens = (F.try_divide("n_over", "overs") > F.try_divide("n", "all")) & (F.col("overs") < F.col("all")) & (ratio >= OPENER) & (F.col("next") != NUMBER)
    openers = after.crossJoin(total).select(F.col("next").alias("type"), F.coalesce(opens, F.lit(False)).alias("opens"), (F.col("n_lower") > 0).alias("lower"), (F.col("n_inside") > 0).alias("inside"))
    both = kinds.where("short").groupBy("type", "next").agg(F.sum("n").alias("n_both"))
    sides = both.join(after.select("next", "n"), "next").join(both.groupBy("type").agg(F.sum("n_both").alias("n_type")), "type").crossJoin(total)
    ratio = _log_likelihood(F.col("n_both"), F.col("n_type"), F.col("n"), F.col("all"))
    more = (F.try_divide("n_both", "n_type") > F.try_divide("n", "all")) & (F.col("n_both") > 1) & (F.col("n_type") < F.col("all"))
    together = sides.where(more).select("type", "next", ratio.alias("score")).where(F.col("score") >= TOGETHER)
    return Learnt(known, cut(openers), cut(together))


def split_learnt(docs: DataFrame, learnt: Learnt, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the text, a row for each sentence, with its pos in the document and the sentence.

    A text may be cut after . ! or ? that white space and no small letter follow. There is no cut after an abbreviation or initial unless the next
    word opens sentences, or is seen in lower case and never capitalised inside of sentences; none where the two go together.

    Null and empty texts have no sentences. Rows are documents of their own, whatever their ids: repeated rows and null ids have
    their own sentences. A text's pieces meet in one task, which the number of sentences of a document bounds.
    """
    rest = [c for c in docs.columns if c != text_col]
    marked = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias("__rest"), F.monotonically_increasing_id().alias("__row"), F.split(F.regexp_replace(F.col(f"`{text_col}`"), END, "$1$2\u0000"), "\u0000").alias("__p"))
    # outer, as for an inner one Spark would cut all texts once more, to filter empty ones
    pieces = marked.select("__rest", "__row", F.posexplode_outer(F.transform("__p", lambda p, i: F.struct(p.alias("piece"), F.get(F.col("__p"), i + 1).alias("after")))).alias("__at", "__x")).where("__x is not null").select("__rest", "__row", "__at", "__x.*")
    # from the end, so that only the last word is looked at
    last, first = F.reverse(F.regexp_extract(F.reverse("piece"), r"^[ \t\n\x0B\f\r]*([^ \t\n\x0B\f\r]+)", 1)), F.regexp_extract("after", r"^([^ \t\n\x0B\f\r]+)", 1)
    told = pieces.select("__rest", "__row", "__at", "piece", type_of(last).alias("__t"), stopped(last).alias("__stop"), type_of(first).alias("__n"), core(first).rlike(r"^\p{Lu}").alias("__upper"))
    short = _sized(learnt.abbreviations.select(F.col("type").alias("__t"), F.lit(True).alias("__short")))
    seen = _sized(learnt.openers.where("opens or lower").select(F.col("type").alias("__n"), "opens", "lower", "inside"))
    pairs = _sized(learnt.together.select(F.col("type").alias("__t"), F.col("next").alias("__n"), F.lit(True).alias("__both")))
    known = told.join(short, "__t", "left").join(seen, "__n", "left").join(pairs, ["__t", "__n"], "left")
    doubt = F.col("__stop") & (F.coalesce("__short", F.lit(False)) | initial(F.col("__t")))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    cut_after = ~doubt | (F.col("__upper") & ~yes("__both") & (yes("opens") | (yes("lower") & ~yes("inside"))))
    order = Window.partitionBy("__row").orderBy("__at")
    # the number of cuts before a piece is the number of its sentence
    counted = known.withColumn("__s", F.sum(cut_after.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    parts = counted.groupBy("__row", F.coalesce("__s", F.lit(0)).alias("__s")).agg(F.first("__rest").alias("__rest"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__at", "piece"))), lambda x: x["piece"]), "").alias("__text"))
    whole = parts.withColumn("sentence", F.regexp_replace("__text", f"^{SPACE}|{SPACE}$", "")).where("sentence <> ''")
    return whole.withColumn("pos", (F.row_number().over(Window.partitionBy("__row").orderBy("__s")) - 1).cast("int")).select(*(F.col(f"__rest.`{c}`").alias(c) for c in rest), "pos", "sentence")
