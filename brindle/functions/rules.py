"""Long ordered tables of rewriting rules: an automaton tells which rules can match, only those run, in their order.

Any match of most patterns holds one of a few literal strings, which the parsed pattern tells. All rules' literals go into one
automaton (Aho-Corasick), and one pass of it over a text tells the rules that may match. A rule that rewrites something may make
literals of later rules, but only around what it rewrote: there the automaton looks again. The result is that of applying all rules
one after the other, at the cost of the few that match and of those without a literal.
"""

from __future__ import annotations

import heapq
import re
import re._constants as op
import re._parser as parser
from collections.abc import Iterator
from functools import cached_property

import ahocorasick
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import each_text

#: Rules of a table that is read and sent to all tasks.
MOST_RULES = 100_000
_SPACE = re.compile(r"\s+")


def literals(pattern: str) -> frozenset[str] | None:
    """Strings of which any match of the pattern holds at least one; None where there are none to tell."""
    parsed = parser.parse(pattern)
    return None if parsed.state.flags & re.IGNORECASE else _needed(parsed)


def _needed(items: parser.SubPattern) -> frozenset[str] | None:
    options: list[frozenset[str]] = []
    run = ""
    for code, value in [*items, (None, None)]:
        if code is op.LITERAL:
            run += chr(value)
            continue
        if code in (op.AT, op.ASSERT, op.ASSERT_NOT):  # no characters of the match
            continue
        if run:
            options.append(frozenset([run]))
            run = ""
        inner: frozenset[str] | None = None
        if code is op.BRANCH:
            each = [_needed(branch) for branch in value[1]]
            inner = frozenset().union(*each) if all(each) else None
        elif code is op.SUBPATTERN:
            inner = None if value[1] & re.IGNORECASE else _needed(value[3])
        elif code is op.ATOMIC_GROUP:
            inner = _needed(value)
        elif code in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT) and value[0] > 0:
            inner = _needed(value[2])
        if inner:
            options.append(inner)
    # long literals are rare, and few of them rarer
    return max(options, key=lambda o: (min(map(len, o)), -len(o)), default=None)


class RuleTable:
    """Rules (pattern, replacement) in their order, in Python's dialect."""

    def __init__(self, rules: tuple[tuple[str, str], ...]):
        self.rules = tuple(rules)

    def __getstate__(self) -> dict:
        return {"rules": self.rules}  # compiled anew in each worker

    @cached_property
    def _compiled(self) -> tuple[list[re.Pattern], list[int], ahocorasick.Automaton, int]:
        found: dict[str, list[int]] = {}
        always, longest = [], 1
        for i, (pattern, _) in enumerate(self.rules):
            needed = literals(pattern)
            if needed is None:
                always.append(i)
            for text in needed or ():
                found.setdefault(text, []).append(i)
                longest = max(longest, len(text))
        automaton = ahocorasick.Automaton()
        for text, own in found.items():
            automaton.add_word(text, tuple(own))
        if found:
            automaton.make_automaton()
        return [re.compile(p) for p, _ in self.rules], always, automaton, longest

    def apply(self, text: str) -> str:
        """The text after all rules."""
        patterns, always, automaton, longest = self._compiled
        look = automaton.iter if len(automaton) else lambda _: ()
        queued = {i for _, own in look(text) for i in own} | set(always)
        ahead = sorted(queued)
        while ahead:
            i = heapq.heappop(ahead)
            new, places = self._rewritten(patterns[i], self.rules[i][1], text)
            if places:
                text = new
                for part in _windows(text, places, longest):
                    for _, own in look(part):
                        for j in own:
                            if j > i and j not in queued:
                                queued.add(j)
                                heapq.heappush(ahead, j)
        return text

    @staticmethod
    def _rewritten(pattern: re.Pattern, new: str, text: str) -> tuple[str, list[tuple[int, int]]]:
        """The text after one rule, and where in it something is new."""
        out, places, at, size = [], [], 0, 0
        for m in pattern.finditer(text):
            put = m.expand(new) if "\\" in new else new
            if put == m.group():
                continue
            out += [text[at : m.start()], put]
            size += m.start() - at
            places.append((size, size + len(put)))
            size, at = size + len(put), m.end()
        return "".join([*out, text[at:]]), places


def _windows(text: str, places: list[tuple[int, int]], longest: int) -> Iterator[str]:
    """The parts of the text in which a literal may be that touches one of the places."""
    begin, end = None, 0
    for a, b in places:
        a, b = max(0, a - longest), b + longest
        if begin is None:
            begin, end = a, b
        elif a <= end:
            end = max(end, b)
        else:
            yield text[begin:end]
            begin, end = a, b
    if begin is not None:
        yield text[begin:end]


def rewrite(text: Column, rules: tuple[tuple[str, str], ...], lower: bool = True) -> Column:
    """text, lower-cased, after all rules in their order, white space squeezed and trimmed; null for null, an empty text stays empty.

    Any number of rules: a text costs what the rules that can match in it cost.
    """
    table = RuleTable(rules)

    return each_text(lambda t: _SPACE.sub(" ", table.apply(t.lower() if lower else t)).strip())(text)


def read_rules(table: DataFrame) -> tuple[tuple[str, str], ...]:
    """The rules of a table (place, pattern, replacement) in the order of place, then pattern; null patterns are none, null replacements are empty.

    At most MOST_RULES.
    """
    rows = table.where("pattern is not null").orderBy("place", "pattern", "replacement").limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    return tuple((r["pattern"], r["replacement"] or "") for r in rows)


def with_rules(general: tuple[tuple[str, str], ...], domain: tuple[tuple[str, str], ...], contractions: tuple[tuple[str, str], ...] = ()) -> tuple[tuple[str, str], ...]:
    """One table: general rules first, which settle white space, then a domain's phrases, then contractions."""
    return (*general, *domain, *contractions)


def compounds(phrases: DataFrame, at: int = 0) -> DataFrame:
    """Rules (place, pattern, replacement) that write each of the phrases (phrase, place) as one word."""
    quoted = F.regexp_replace("phrase", r"([^\p{L}\p{N} ])", r"\\$1")
    return phrases.select((F.col("place") + at).alias("place"), quoted.alias("pattern"), F.regexp_replace("phrase", " ", "").alias("replacement"))
