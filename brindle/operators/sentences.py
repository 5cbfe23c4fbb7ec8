"""Sentences of documents: splitting, cleaning, length filter, numbering, topic texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import GENERAL_RULES, replace_rules, sentences, strip_punctuation, word_count

# The topics by id, from 0, and the words that speak for each; -1 is noise.
TOPIC_NAMES = (
    "sales", "cost and expense", "profit and loss", "operations", "liquidity and solvency", "investment", "financing and debt",
    "litigation and intellectual property", "hr", "regulation and tax", "accounting", "environmental, social, governance (ESG)",
)
TOPIC_KEYWORDS = (
    ("sale", "revenue", "consumer", "demand", "competition", "pricing"),
    ("cost", "expense", "goodwill", "impairment", "depreciat"),
    ("profit", "margin", "income", "earning", "loss", "ebit", "operatingresult", "financialresult", "yearendresult"),
    ("operation", "production", "business", "produce", "supply", "supplier", "process", "manufacture", "manufacturing", "logistic", "transport", "marketing", "advertise", "advertising", "projectmanag", "inventorymanag", "safetymanag", "qualitycontrol"),
    ("liquidity", "solvency", "solvent", "goingconcern", "cash", "workingcapital", "bankbalance"),
    ("expenditure", "m&a", "invest", "asset", "disposal", "divest"),
    ("financing", "finance", "debt", "equity", "dividend", "repurchase", "securities", "borrow", "credit", "stockperformance"),
    ("litigation", "lawsuit", "legal", "dispute", "complaint", "arbitration", "patent", "intellectualproperty"),
    ("employee", "retention", "hiring", "hire", "union", "consultant", "staff", "recruit", "labor", "incentiv", "training", "salary", "wage", "job", "humancapital", "talentmanag", "successionmanag", "hrmanag", "nextgenerationmanag", "talentdevelop", "feedbackcultur", "workremote", "remotework", "worklife", "worklifebalance", "leadership", "careerdevelop", "employment", "employing", "ehsperformance", "genderaffirm"),
    ("regulation", "tax", "government", "legislation", "federal", "regulator", "regulate"),
    ("account", "audit", "adjustment", "filing", "internalcontrol", "controlframework", "controlstruct", "controlrisk"),
    ("plastic", "recycl", "waste", "carbon", "emission", "renewable", "environment", "sustain", "ecologic", "waterrisk", "waterfootprint", "diversity", "inclusion", "ethics", "ethical", "esgperformance"),
)
NOISE = -1


def topic_name(topic: Column) -> Column:
    """The name of a topic id, noise for -1 and null for others."""
    names = F.array(*map(F.lit, TOPIC_NAMES))
    return F.when(topic == NOISE, F.lit("noise")).when(topic.between(0, len(TOPIC_NAMES) - 1), F.get(names, topic.cast("int")))


def split_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the text, a row for each sentence, with its pos in the document and the sentence."""
    rest = [c for c in docs.columns if c != text_col]
    return docs.select(*rest, F.posexplode(sentences(F.col(text_col))).alias("pos", "sentence"))


def clean_sentences(found: DataFrame, more: int = 5, fewer: int = 50, rules: tuple[tuple[str, str], ...] = GENERAL_RULES, count_before_punctuation: bool = False) -> DataFrame:
    """Sentences after the rules and without punctuation, of more than `more` and fewer than `fewer` words.

    count_before_punctuation: the words are counted before punctuation goes.
    """
    replaced = found.withColumn("__r", replace_rules(F.col("sentence"), rules))
    cleaned = replaced.withColumn("sentence", strip_punctuation(F.col("__r")))
    n = word_count(F.col("__r" if count_before_punctuation else "sentence"))
    return cleaned.withColumn("n_words", n).where((F.col("n_words") > more) & (F.col("n_words") < fewer)).drop("__r")


def number_sentences(found: DataFrame, id_col: str = "doc_id", pos_col: str = "pos") -> DataFrame:
    """With sentence_id from 0 in each document; pos stays, and still tells how far apart two were."""
    return found.withColumn("sentence_id", F.row_number().over(Window.partitionBy(id_col).orderBy(pos_col)) - 1)


def topic_texts(found: DataFrame, keys: tuple[str, ...] = ("doc_id", "topic"), order: str = "sentence_id", text: str = "sentence") -> DataFrame:
    """One text for each of the keys: its sentences in order, joined by `; `, with the topic's name."""
    parts = F.array_sort(F.collect_list(F.struct(order, text)))
    return found.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x[text]), "; ").alias("text")).withColumn("topic_name", topic_name(F.col("topic")))


def keyword_topics(found: DataFrame, text: str = "sentence", keywords: tuple[tuple[str, ...], ...] = TOPIC_KEYWORDS, blacklist: tuple[str, ...] = (), exclusions: dict[int, tuple[str, ...]] | None = None) -> DataFrame:
    """With topics, the ids of those of which a keyword is in the text, in either case.

    blacklist: parts of words that are no keywords whatever they hold: they are taken out before keywords are looked for. exclusions: words by
    topic that rule the topic out. Both lists are the caller's, as a table of their own may hold them. Null texts have null topics.
    """
    holds = lambda of, words: reduce(lambda x, y: x | y, (F.contains(of, F.lit(w.lower())) for w in words), F.lit(False))
    out = exclusions or {}
    gone = "|".join(f"\\Q{w.lower()}\\E" for w in sorted(blacklist, key=lambda w: (-len(w), w)))
    without = lambda t: F.when(holds(t, blacklist), F.regexp_replace(t, gone, "")).otherwise(t) if blacklist else t

    def hits(lower: Column, seen: Column) -> Column:
        return F.array(*(F.when(holds(seen, words) & (~holds(lower, out[i]) if out.get(i) else F.lit(True)), F.lit(i)) for i, words in enumerate(keywords)))

    # the lambdas bind the lower-cased text and what is seen of it, once; else each topic makes them anew
    told = F.transform(F.array(F.lower(F.col(text))), lambda t: F.transform(F.array(without(t)), lambda seen: hits(t, seen))[0])[0]
    return found.withColumn("topics", F.when(F.col(text).isNotNull(), F.filter(told, lambda x: x.isNotNull())))
