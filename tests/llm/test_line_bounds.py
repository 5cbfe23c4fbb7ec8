"""What op6_line_dedup may compare: families of long near copies make few pairs, and none that is alike is lost."""

import random
from collections import Counter

from pyspark.sql import functions as F

from brindle.llm import line_dedup


def jaccard(a, b):
    p, q = ({t[i : i + 8] for i in range(len(t) - 7)} for t in (a, b))
    return len(p & q) / len(p | q)


def family(rng, lines, edits, size=600):
    base = "".join(rng.choices("abcdefghijklmnop ", k=size))
    out = []
    for k in range(lines):
        t = list(base)
        for _ in range(rng.choice(edits)):
            t[rng.randrange(size)] = chr(0x4E00 + k)
        out.append("".join(t))
    return out


def alike_of(lines):
    return {(i, j) for i in range(len(lines)) for j in range(i) if jaccard(lines[i], lines[j]) >= 0.8}


def test_bitmaps_of_long_lines_rule_out_unlike_ones(spark):
    """However many runs two lines share: those that only one has show."""
    lines = family(random.Random(21), 40, [4, 9])
    df = spark.createDataFrame(list(enumerate(lines)), "h1 long, line string")
    pairs = spark.createDataFrame([(i, j) for i in range(len(lines)) for j in range(i)], "src long, dst long")
    kept = {tuple(r) for r in line_dedup.may_be_alike(pairs, line_dedup.bitmaps(df), 80).collect()}
    alike = alike_of(lines)
    near = {(i, j) for i in range(len(lines)) for j in range(i) if jaccard(lines[i], lines[j]) >= 0.72}
    assert alike and alike <= kept <= near and len(near) < len(pairs.collect()) / 2


def test_repeated_runs_do_not_show(spark):
    """A line, and the same one with a part of it many times: their sets are the same but for a few runs."""
    t = "".join(random.Random(22).choices("abcdefgh", k=300))
    df = spark.createDataFrame([(0, t), (1, t + t[:250] * 2), (2, t + t[:100] * 5)], "h1 long, line string")
    pairs = spark.createDataFrame([(1, 0), (2, 0), (2, 1)], "src long, dst long")
    assert line_dedup.may_be_alike(pairs, line_dedup.bitmaps(df), 80).count() == 3


def test_lines_of_a_larger_group_with_many_own_runs_make_no_pairs(spark):
    """Two lines with more runs of their own than the similarity lets two lines have: such pairs aren't made, and all that are alike are."""
    lines = family(random.Random(23), 120, [2, 9], 400)
    texts = spark.createDataFrame(list(enumerate(lines)), "h1 long, line string")
    rest = texts.select("h1", F.col("h1").alias("comp"))
    pairs = {tuple(r) for r in line_dedup.rest_pairs(rest, texts, 80).collect()}
    sets = [{t[i : i + 8] for i in range(len(t) - 7)} for t in lines]
    often = Counter(run for s in sets for run in s)
    own = [sum(often[run] == 1 for run in s) for s in sets]
    alike = alike_of(lines)
    assert alike and alike <= pairs
    assert [(i, j) for i, j in pairs if 9 * (own[i] + own[j]) > len(sets[i]) + len(sets[j])] == []


def test_firsts_with_null_negative_and_great_ids(spark):
    rows = [(None, "x\none line of its own\nshared line"), (-(1 << 63), "shared line\ny line"), ((1 << 63) - 1, "z line 1\nz line 1\ny line"), ((1 << 63) - 1, "z line 1"), (-5, "w line 2"), (7, "w line 2\nw line 2")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["line_no"]): (r["first_doc"], r["first_line"], r["kept"]) for r in line_dedup.line_components(df).collect() if r["doc_id"] != (1 << 63) - 1}
    low, great = -(1 << 63), (1 << 63) - 1
    assert got[None, 2] == (None, 2, True) and got[low, 0] == (None, 2, False) and got[low, 1] == (low, 1, True)
    assert got[-5, 0] == (-5, 0, True) and got[7, 0] == got[7, 1] == (-5, 0, False)
    top = sorted((r["line_no"], r["first_doc"], r["first_line"], r["kept"]) for r in line_dedup.line_components(df).collect() if r["doc_id"] == great)
    assert top == [(0, great, 0, True), (0, great, 0, True), (1, great, 0, False), (2, low, 1, False)]
