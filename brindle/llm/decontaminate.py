"""Benchmark decontamination by pigeonhole edit matching.

Text is compared in lower case with every run of other than letters and digits as one space.
A test item that may lie in a document with up to e edits is split into e + 1 pieces; e edits
spoil at most e of them, so one is found as it is. An Aho-Corasick automaton of all pieces
reads each document once, and around the hits a bit-parallel distance (Myers) decides.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import ahocorasick
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OTHER = re.compile(r"[\W_]+")
#: Characters of test items that one automaton may hold, and so one broadcast; more are taken in turns.
ITEM_CHARS = 8_000_000


def normal(text: str | None) -> str:
    """Lower case; letters and digits with single spaces between runs of them, and around all."""
    words = _OTHER.sub(" ", (text or "").lower()).strip()
    return f" {words} " if words else ""


def budget(length: int, rate: float) -> int:
    """Edits allowed in an item of that many characters."""
    return int(length * rate)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """The item in errors + 1 nearly equal pieces, with their offsets."""
    edges = [len(item) * k // (errors + 1) for k in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:], strict=False) if a < b]


def best_match(pattern: str, text: str) -> tuple[int, int]:
    """The least edit distance of the pattern to a substring of the text, and the first end that has it."""
    m = len(pattern)
    if not m:
        return 0, 0
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, last = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = m, 0
    get = peq.get
    for j, c in enumerate(text, 1):
        eq = get(c, 0)
        zero = (((eq & up) + up) ^ up) | eq | down
        more, less = down | ~(zero | up) & full, up & zero
        if more & last:
            score += 1
        elif less & last:
            score -= 1
        more = more << 1 & full
        up, down = (less << 1 & full) | ~(zero | more) & full, more & zero
        if score < best:
            best, end = score, j
    return best, end


class Matcher:
    """Finds test items in documents, each with its own number of edits; those of fewer than `least` characters, with the spaces around, are left out."""

    def __init__(self, items: list[tuple[int, str]], rate: float, least: int = 0):
        self.items, self.errors = [], []
        held: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            if len(text) < least:
                continue
            # the spaces around count as characters: an item begins and ends with whole words where it has no edits
            errors = budget(len(text) - 2, rate)
            for at, piece in pieces(text, errors):
                held.setdefault(piece, []).append((len(self.items), at))
            self.items.append((item_id, text))
            self.errors.append(errors)
        self.automaton = ahocorasick.Automaton()
        for piece, places in held.items():
            self.automaton.add_word(piece, (len(piece), places))
        if held:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, distance, budget, end) of the best match of each item that the text holds."""
        if not text or not self.items:
            return []
        spots: dict[int, set[int]] = {}
        for end, (size, places) in self.automaton.iter(text):
            for k, at in places:
                spots.setdefault(k, set()).add(end + 1 - size - at)
        out = []
        for k, starts in spots.items():
            item_id, item = self.items[k]
            errors, found = self.errors[k], None
            if not errors:  # the item is its one piece, and each hit a match
                out.append((item_id, 0, 0, min(starts) + len(item)))
                continue
            low = high = None
            for s in [*sorted(starts), None]:
                if s is not None and low is not None and s - high <= errors:
                    high = s
                    continue
                if low is not None:
                    # every match that a piece here belongs to lies in this window
                    a = max(0, low - errors)
                    distance, end = best_match(item, text[a : high + len(item) + errors])
                    if distance <= errors and (found is None or distance < found[1]):
                        found = (item_id, distance, errors, a + end)
                    if found and not found[1]:
                        break
                low = high = s
            if found:
                out.append(found)
        return out


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", rate: float = 0.06, least: int = 0) -> DataFrame:
    """(doc_id, item_id, distance, budget, end): the items that each document holds with few edits.

    A document holds an item when a substring of it, both in normal form, is within
    int(rate * length of the item) edits of the item. Each pair is one row, with the least
    distance and where in the normal form that first ends.

    An item too short for an edit is found as it is, as whole words: under 17 characters with a rate of 0.06. Null, empty and wordless documents and items match
    nothing, nor do items under `least` characters in normal form, with the spaces around, by which a caller may leave out items like `yes`. Texts are read whole at any length. Equal items
    are matched each on their own, and of equally near places the first counts; repeated documents are reported each. Empty tables give no
    rows, and other columns are ignored, of whatever names.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("t")).where("t is not null and t <> ''")
    held = items.agg(F.sum(F.length("t")), F.max(F.length("t"))).first()
    turns = -(-(held[0] or 0) // ITEM_CHARS)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, item_id long, distance int, budget int, end long"
    found = spark.createDataFrame([], schema)
    for turn in range(turns):
        own = items.where(F.pmod(F.xxhash64("item_id", "t"), F.lit(turns)) == turn).orderBy("item_id", "t").collect()
        sent = spark.sparkContext.broadcast([(r["item_id"], n) for r in own if (n := normal(r["t"]))])

        def scan(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            matcher = Matcher(sent.value, rate, least)
            for batch in batches:
                out = [(doc, *hit) for doc, text in zip(batch["doc_id"], batch["text"], strict=True) for hit in matcher.find(normal(text))]
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "distance", "budget", "end"]).astype({"doc_id": "Int64", "item_id": "Int64", "distance": "int32", "budget": "int32", "end": "int64"})

        hits = rows.mapInPandas(scan, schema)
        found = hits if turns == 1 else found.unionByName(hits)
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.06, least: int = 0, **columns: str) -> DataFrame:
    """The rows of docs that hold no test item, with their columns; in one pass, without a join.

    Defined as in contaminated(): rows of null or empty text stay, and so do those of a null id that hold no item; repeated rows stay or go
    together. Empty tables give no rows, or all; other columns are kept, of whatever names.
    """
    spark = docs.sparkSession
    item_id, item_text = columns.get("item_id_col", "item_id"), columns.get("item_text_col", "text")
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("t")).where("t is not null and t <> ''")
    turns = -(-(items.agg(F.sum(F.length("t"))).first()[0] or 0) // ITEM_CHARS)
    kept = docs
    for turn in range(turns):
        own = items.where(F.pmod(F.xxhash64("item_id", "t"), F.lit(turns)) == turn).orderBy("item_id", "t").collect()
        sent = spark.sparkContext.broadcast([(r["item_id"], n) for r in own if (n := normal(r["t"]))])

        kept = kept.where(F.pandas_udf(_free_of(sent, rate, least), "boolean")(F.col(text_col).cast("string")))
    return kept


def _free_of(sent: Broadcast, rate: float, least: int) -> Callable:
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(sent.value, rate, least)
        for texts in batches:
            yield pd.Series([not matcher.find(normal(t)) for t in texts], dtype=bool)

    return clean
