"""Documents: headers, the section between two items, and outliers in length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import header, word_count


def with_header(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the header's fields as columns, null where a null or empty text doesn't say; columns of these names are replaced."""
    return docs.withColumns(header(F.col(text_col)))


def first_of_accession(filings: DataFrame, key: str = "accession_number", order: tuple[str, ...] = ("archive", "entry")) -> DataFrame:
    """The first filing of each accession number, all of equally first ones; those without one all stay. An empty table gives no rows."""
    first = filings.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*order)).alias("__first"))
    same = filings.join(first, key, "left")
    return same.where(F.col("__first").isNull() | F.col("__first").eqNullSafe(F.struct(*order))).select(*(F.col(f"`{c}`") for c in filings.columns))


def allowed(filings: DataFrame, ciks: DataFrame, key: str = "cik") -> DataFrame:
    """The filings whose company is on the list, repeated ones each; a null company is on none, and an empty list has none."""
    return filings.join(ciks.select(key).distinct(), key, "left_semi")


def _section_bounds(two: Column, three: Column, seven: Column, eight: Column) -> Column:
    """struct(start, end) from the offsets of the marks, null if none fits."""
    first_after = lambda of, x: F.array_min(F.filter(of, lambda y: y > x))

    def bounds(p: Column) -> Column:
        start = first_after(seven, p)
        stop = first_after(three, start)
        last = F.array_max(F.filter(eight, lambda y: (y > start) & (y < stop)))
        return F.when(last.isNotNull(), F.struct(start.alias("start"), last.alias("end")))

    found = F.filter(F.transform(F.reverse(two), bounds), lambda b: b.isNotNull())
    return F.get(found, F.lit(0))


def _offsets(text: Column, pattern: str) -> Column:
    """The offsets, from 0, of all matches of a pattern, by the lengths of what lies between them."""
    hits = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    sizes = F.transform(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), lambda h: F.length(h))
    placed = F.aggregate(
        F.zip_with(F.slice(hits, F.lit(1), F.size(sizes)), sizes, lambda p, h: F.struct(p.alias("p"), h.alias("h"))),
        F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("at")),
        lambda acc, x: F.struct((acc["n"] + x["p"] + x["h"]).alias("n"), F.concat(acc["at"], F.array(acc["n"] + x["p"])).alias("at")),
    )
    return placed["at"]


def section(docs: DataFrame, text_col: str = "text", out: str = "section", strict: bool = True) -> DataFrame:
    """docs with the text from an `item 7` to an `item 8` within Part II, null where a document has none.

    Part II's mentions are tried from the last to the first: the first item 7 after it, the first Part III after that, which
    must follow, the last item 8 between. Letters match in either case. strict: any white space stands in a mark and `part ii` doesn't count
    where `part iii` stands; else a mark has the one space and both count.

    Null and empty texts have no section; texts of any length are read whole, and offsets are the text's own.
    """
    strictly = {"__two": r"part\s+ii\b", "__three": r"part\s+iii\b", "__seven": r"items?\s+7[.:\s]", "__eight": r"item\s+8[.:\s]"}
    loosely = {"__two": r"part iii?\b", "__three": r"part iii\b", "__seven": r"items?\s7[.:\s]", "__eight": r"item 8[.:\s]"}
    marks = strictly if strict else loosely
    # the offsets are columns of their own, so that no lambda computes them again
    placed = docs.withColumns({k: _offsets(F.col(text_col), f"(?iU){p}") for k, p in marks.items()})
    bounds = placed.withColumn("__b", _section_bounds(*(F.col(k) for k in marks)))
    return bounds.withColumn(out, F.expr(f"substring({text_col}, __b.start + 1, __b.end - __b.start)")).drop("__b", *marks)


def with_words(docs: DataFrame, text_col: str = "text", least: int = 0) -> DataFrame:
    """Documents with text and at least so many words, with their n_words."""
    return docs.where(F.col(text_col).isNotNull()).withColumn("n_words", word_count(F.col(text_col))).where(F.col("n_words") >= least)


def within_zscore(docs: DataFrame, threshold: float = 2.0, of: str = "n_words") -> DataFrame:
    """Rows whose absolute z-score, with the sample's deviation, is at most the threshold; with zscore."""
    stats = docs.agg(F.avg(of).alias("__m"), F.stddev_samp(of).alias("__s"))
    scored = docs.crossJoin(F.broadcast(stats))  # one row
    return scored.withColumn("zscore", F.abs(F.try_divide(F.col(of) - F.col("__m"), F.col("__s")))).where(F.col("zscore") <= threshold).drop("__m", "__s")


def within_quantile(docs: DataFrame, quantile: float = 0.99, of: str = "n_words") -> DataFrame:
    """Rows up to the exact, interpolated quantile."""
    if not 0 <= quantile <= 1:
        raise ValueError("a quantile lies between 0 and 1")
    limit = docs.agg(F.percentile(of, F.lit(quantile)).alias("__q"))
    return docs.crossJoin(F.broadcast(limit)).where(F.col(of) <= F.col("__q")).drop("__q")  # one row


def length_summary(docs: DataFrame, of: str = "n_words") -> DataFrame:
    """The figures of a box plot of lengths, in one row."""
    q = F.percentile(of, F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0)))).alias("q")
    return docs.agg(F.count("*").alias("n"), q).select("n", *(F.col("q")[i].alias(k) for i, k in enumerate(("low", "q1", "median", "q3", "high"))))


def histogram(docs: DataFrame, of: str, width: float) -> DataFrame:
    """Counts by buckets of a width: what a histogram plot shows."""
    return docs.where(F.col(of).isNotNull()).groupBy(F.floor(F.col(of) / F.lit(width)).cast("long").alias("bucket")).agg(F.count("*").alias("n"))
