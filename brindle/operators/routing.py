"""Sentences whose topic is doubtful: picking them, asking a language model about them, taking its answers."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sentences import NOISE, TOPIC_NAMES

ANSWER = "topic string, explanation string, probability int"
FAILED = ("Parsing Error", "Parsing Error", 0)
#: What each topic is about, in the order of TOPIC_NAMES: the model is told with the instruction.
SCOPES = (
    "what customers buy, prices, demand and competitors", "what production, staff and assets cost, and their loss of value", "results, margins, earnings and losses", "making, moving, storing and marketing of goods, and suppliers", "cash, working capital and whether debts can be paid when due",
    "money put into assets, firms and their sale", "money raised by debt or shares, and paid to owners", "lawsuits, disputes, patents and other rights", "people at work, their hiring, pay, training and leaders", "laws, regulators, government and taxes", "accounting methods, audits, filings and internal control",
    "environment, society, diversity and how the firm is governed",
)
INSTRUCTION = "Name the topic of the sentence. Choose from: {topics}. Answer as JSON with topic, explanation and probability (0 to 100)."


def ambiguous(silhouette: Column, entropy: Column, silhouette_below: float = 0.5, entropy_above: float = 0.5) -> Column:
    """Whether a sentence is to be checked: neither well inside of its topic nor sure of it."""
    return (silhouette < silhouette_below) & (entropy > entropy_above)


def metadata_text(company: Column) -> Column:
    return F.concat(F.lit("Company: "), F.regexp_replace(company, r"\r+$", ""), F.lit("\n"))


def with_context(found: DataFrame, doc: str = "doc_id", order: str = "sentence_id", text: str = "sentence", gap: int = 2) -> DataFrame:
    """With the sentence before and after in the document, null where it is further than the gap, and both as context text."""
    near = Window.partitionBy(doc).orderBy(order)
    before = F.when(F.col(order) - F.lag(order).over(near) <= gap, F.lag(text).over(near))
    after = F.when(F.lead(order).over(near) - F.col(order) <= gap, F.lead(text).over(near))
    both = found.withColumn("previous", before).withColumn("next", after)
    said = lambda name, c: F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.concat(F.lit(f"{name} Sentence: "), F.col(c)))
    return both.withColumn("context", F.concat_ws("\n", said("Previous", "previous"), said("Next", "next")))


def examples_text(neighbours: DataFrame, id_col: str = "vec_id", text: str = "text", topic: str = "topic", reason: str | None = None) -> DataFrame:
    """(id, examples): a block for each neighbour in order of its rank, with a blank line between."""
    lines = F.concat_ws("\n", F.concat(F.lit("Example "), F.col("rank").cast("string"), F.lit(":")), F.concat(F.lit("Sentence: "), F.col(text)), F.concat(F.lit("Topic: "), F.col(topic).cast("string")), *([F.concat(F.lit("Reasoning: "), F.col(reason))] if reason else []))
    ordered = F.array_sort(F.collect_list(F.struct("rank", lines.alias("line"))))
    return neighbours.groupBy(id_col).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n\n").alias("examples"))


def instruction_text(names: tuple[str, ...] = TOPIC_NAMES, scopes: tuple[str, ...] | None = SCOPES) -> str:
    """The instruction, followed by a line for each topic that tells its scope."""
    lines = [f"{n}: {s}" for n, s in zip(names, scopes, strict=True)] if scopes else []
    return "\n".join([INSTRUCTION.format(topics=", ".join(names)), *lines])


def prompt(sentence: Column, metadata: Column | None = None, context: Column | None = None, examples: Column | None = None, instruction: bool = True) -> Column:
    """The parts that are there and not empty, with blank lines between; the sentence last."""
    full = lambda c: F.when(c.isNotNull() & (F.trim(c) != ""), F.trim(c, F.lit("\n ")))
    parts = [F.lit(instruction_text())] if instruction else []
    parts += [full(c) for c in (examples, metadata, context) if c is not None]
    return F.concat_ws("\n\n", *parts, F.concat(F.lit("Sentence: "), sentence))


def ask(prompts: DataFrame, load: Callable[[], Callable[[str], str]], prompt_col: str = "prompt", tasks: int | None = None, at_once: int = 16, per_second: float | None = None) -> DataFrame:
    """prompts with the model's raw answer; a call that fails, or has a null prompt, has a null answer.

    tasks: partitions that ask, by default those of prompts; at_once: calls at the same time in each; per_second: calls that each begins in a second at most.
    Answers stay with their prompts whatever order they come in. A task that runs again asks again.
    """
    if at_once < 1 or (per_second is not None and per_second <= 0):
        raise ValueError("at least one call at a time, and some in a second")
    rows = prompts.repartition(tasks) if tasks else prompts

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model, turn, begins = load(), threading.Lock(), [time.monotonic()]

        def one(text: str | None) -> str | None:
            if text is None:
                return None
            if per_second:
                with turn:
                    begins[0] = max(begins[0], time.monotonic())
                    wait = begins[0] - time.monotonic()
                    begins[0] += 1 / per_second
                time.sleep(max(0.0, wait))
            try:
                return model(text)
            except Exception:  # noqa: BLE001  a failed call is an answer that can't be read
                return None

        with ThreadPoolExecutor(at_once) as pool:
            for batch in batches:
                yield pd.Series(list(pool.map(one, batch)), dtype=object)

    return rows.withColumn("answer", F.pandas_udf(run, "string")(F.col(prompt_col)))


def read_answers(answers: DataFrame, answer_col: str = "answer") -> DataFrame:
    """With topic, explanation and probability from JSON; what can't be read, or lies outside of 0 to 100, is FAILED."""
    read = answers.withColumn("__a", F.from_json(F.col(answer_col), ANSWER))
    good = F.col("__a.topic").isNotNull() & F.col("__a.explanation").isNotNull() & F.col("__a.probability").between(0, 100)
    return read.select("*", *(F.when(good, F.col(f"__a.{k}")).otherwise(F.lit(f)).alias(k) for k, f in zip(("topic", "explanation", "probability"), FAILED, strict=True))).drop("__a")


def latest(answers: DataFrame, key: str = "sentence_index", order: tuple[str, ...] = ("written", "file", "position")) -> DataFrame:
    """The last answer of each key: those of a repeated run replace earlier ones. Columns of the order that answers don't have are passed over."""
    last = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order if c in answers.columns))
    return answers.withColumn("__r", F.row_number().over(last)).where("__r = 1").drop("__r")


def topic_id(name: Column) -> Column:
    """The id of a topic's name, NOISE for other names."""
    names = F.array(*map(F.lit, TOPIC_NAMES))
    at = F.array_position(names, name)
    return F.when(at > 0, (at - 1).cast("int")).otherwise(F.lit(NOISE))


def override(nearest: DataFrame, answers: DataFrame, key: str = "sentence_index", sure: int = 85) -> DataFrame:
    """nearest (key, topic) with the answered topic in place; NOISE if it is unknown or not sure. final_topic, source."""
    said = answers.select(F.col(key), F.when(F.col("probability") >= sure, topic_id(F.col("topic"))).otherwise(F.lit(NOISE)).alias("__t"))
    joined = nearest.join(said, key, "left")
    return joined.withColumn("final_topic", F.coalesce("__t", F.col("topic").cast("int"))).withColumn("source", F.when(F.col("__t").isNull(), "nearest").otherwise("model")).drop("__t")


def coverage(final: DataFrame) -> DataFrame:
    """One row: sentences, those routed, those that end as noise, and their shares."""
    n, routed, noise = F.count("*"), F.count_if(F.col("source") == "model"), F.count_if(F.col("final_topic") == NOISE)
    share = lambda x: F.try_divide(x.cast("double"), n.cast("double"))
    return final.agg(n.alias("n"), routed.alias("routed"), noise.alias("noise"), share(routed).alias("routed_share"), (1 - share(noise)).alias("coverage"))
