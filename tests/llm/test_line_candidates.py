"""Which alike lines op6_line_dedup may miss: none by their place in a group, none by their letters."""

import random

import pytest

from brindle.llm import line_dedup


def firsts(spark, lines):
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    return {r["doc_id"]: r["first_doc"] for r in line_dedup.line_components(df).collect()}


def test_pairs_behind_an_unlike_first_of_group(spark):
    """Lines of one long common part share keys, and the first of a group is seldom the like one."""
    rng = random.Random(11)
    own = lambda k: "".join(rng.choices("klmnopqrst", k=k))
    common = " ".join(own(6) for _ in range(24))
    lines = []
    for _ in range(150):
        end = own(90)
        lines += [f"{common} {end}", f"{common} {end[:-2]}"]
    got = firsts(spark, lines)
    assert sum(got[i] == got[i + 1] for i in range(0, len(lines), 2)) >= 148
    assert len(set(got.values())) >= 150


def test_recall_within_a_family_of_variants(spark):
    """Variants of one long line, most of them unlike each other: pairs that are alike by brute force share a component."""
    rng = random.Random(16)
    base = [("".join(rng.choices("abcdefghijklmnop", k=6))) for _ in range(60)]
    lines = []
    for _ in range(300):
        words = list(base)
        for _ in range(rng.randint(1, 6)):
            words[rng.randrange(60)] = "".join(rng.choices("qrstuvwxyz", k=6))
        lines.append(" ".join(words))
    sets = [{t[i : i + 8] for i in range(len(t) - 7)} for t in lines]
    alike = [(i, j) for i, p in enumerate(sets) for j, q in enumerate(sets[:i]) if 10 * len(p & q) >= 8 * len(p | q)]
    got = firsts(spark, lines)
    assert len(alike) > 300 and sum(got[i] == got[j] for i, j in alike) >= 0.97 * len(alike)


@pytest.mark.parametrize("hot", [(1 << 20, 1 << 14), (8, 4)], ids=["whole", "divided"])
def test_a_group_costs_as_many_pairs_as_it_has_lines(spark, hot, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT", hot[0])
    monkeypatch.setattr(line_dedup, "HOT_LEAST", hot[1])
    rng = random.Random(17)
    signed = spark.createDataFrame([(h, *(5 if k < 6 else rng.getrandbits(60) if k < 8 else h // 2 for k in range(9))) for h in range(400)], "h1 long, " + ", ".join(f"m{k} long" for k in range(9)))
    got = [tuple(r) for r in line_dedup.neighbours(signed).collect()]
    assert len(got) == len(set(got)) <= 400 * line_dedup.NEXT * line_dedup.SIDE * line_dedup.DIRECTIONS and all(a > b for a, b in got)
    assert hot[0] == 8 or {(2 * i + 1, 2 * i) for i in range(200)} <= set(got)


def test_bands_share_one_minimum_at_most():
    bands = line_dedup.bands()
    assert len(bands) == line_dedup.SIDE * line_dedup.DIRECTIONS == len(set(map(tuple, bands)))
    assert all(len(b) == line_dedup.SIDE for b in bands) and {m for b in bands for m in b} == set(range(line_dedup.SIDE**2))
    assert all(len(set(a) & set(b)) <= 1 for i, a in enumerate(bands) for b in bands[:i])


def jaccard(a, b):
    p, q = ({t[i : i + 8] for i in range(len(t) - 7)} for t in (a, b))
    return len(p & q) / len(p | q)


def test_no_similar_pair_is_ruled_out_by_bitmaps(spark):
    rng = random.Random(14)
    lines = []
    for size in (8, 9, 12, 40, 300, 3000):
        t = "".join(rng.choices("abcdefgh ", k=size))
        lines += [t, t + t[:3], t * 3] + ["".join(c if rng.random() > 4 / size / k else "#" for c in t) for k in (1, 2, 4) for _ in range(3)]
    lines = sorted(set(lines))
    df = spark.createDataFrame(list(enumerate(lines)), "h1 long, line string")
    pairs = spark.createDataFrame([(i, j) for i in range(len(lines)) for j in range(i)], "src long, dst long")
    kept = {tuple(r) for r in line_dedup.may_be_alike(pairs, line_dedup.bitmaps(df), 80).collect()}
    alike = {(i, j) for i in range(len(lines)) for j in range(i) if jaccard(lines[i], lines[j]) >= 0.8}
    assert alike and alike <= kept and len(kept) < len(lines) * (len(lines) - 1) / 4
    assert {tuple(r) for r in line_dedup.linked(pairs, df, 80).collect()} == alike


LETTERS = {"latin": "abcdefghijklmnopqrstuvwxyz   ", "russian": "абвгдежзийклмнопрстуфхцчшщ   ", "chinese": "".join(map(chr, range(0x4E00, 0x5200))), "digits": "0123456789", "url": "abcdef/.-?=&%0123", "tabs": "abc123\t\t"}


@pytest.mark.parametrize("letters", LETTERS.values(), ids=LETTERS)
def test_recall_against_brute_force(spark, letters):
    """Of lines with one to three edits, those of a Jaccard similarity of 0.8 or more share a component."""
    rng = random.Random(15)
    lines, alike = [], []
    for _ in range(150):
        size = rng.choice([9, 10, 14, 30, 60, 150, 260, 400])
        t = "x" + "".join(rng.choices(letters, k=size - 2)) + "y"
        edited = list(t)
        for _ in range(1 + (size > 100) * rng.randint(0, 2)):
            edited[rng.randrange(1, len(t) - 1)] = rng.choice(letters.strip())
        e = "".join(edited) if size > 80 else t + rng.choice(letters.strip())
        if jaccard(t, e) >= 0.8:
            alike.append(len(lines))
        lines += [t, e]
    got = firsts(spark, lines)
    assert len(alike) > 60 and sum(got[i] == got[i + 1] for i in alike) >= 0.95 * len(alike)


def test_short_lines_of_equal_sets(spark):
    got = firsts(spark, ["aaaaaaaaa", "aaaaaaaaaa", "b" * 8, "b" * 300, "abcdefg", "abcdefg", "abcdefgh"])
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4, 6: 6}


def test_lines_of_any_letters_have_keys(spark):
    rng = random.Random(13)
    letters = {"russian": "абвгдежзийклмнопрстуфхцчшщ", "greek": "αβγδεζηθικλμνξοπρστυφχψω", "chinese": "".join(map(chr, range(0x4E00, 0x5200))), "digits": "0123456789", "code": "xyzXYZ019+/=", "emoji": "😀😁😂🤣😃😄😅😆"}
    lines = []
    for of in letters.values():
        for size in (60, 160, 400):
            t = "".join(rng.choices(of, k=size))
            lines += [t, t[: size - 1] + "#"]
    t = "абвгд " * 30 + "".join(rng.choices(letters["russian"], k=160))
    lines += [t, t + "#", "\t".join(map(str, range(1000, 1050))), "\t".join(map(str, range(1000, 1050))) + "#"]
    # an edit of the first letter only, and lines that repeat one run
    t = "".join(rng.choices(letters["code"], k=40))
    lines += [t, "#" + t[1:], "ab" * 30, "ab" * 300]
    got = firsts(spark, lines)
    assert [i for i in range(0, len(lines), 2) if got[i] != got[i + 1]] == []
    assert len(set(got.values())) == len(lines) // 2


@pytest.mark.parametrize(("each", "hot"), [(128, (1 << 20, 1 << 14)), (8, (1 << 20, 1 << 14)), (128, (8, 4))], ids=["by pairs", "joined", "divided"])
def test_no_alike_line_of_a_group_is_missed(spark, each, hot, monkeypatch):
    """Twins on a prefix that all lines share: whichever lines have a key in common and are alike are of one component."""
    monkeypatch.setattr(line_dedup, "EACH", each)
    monkeypatch.setattr(line_dedup, "HOT", hot[0])
    monkeypatch.setattr(line_dedup, "HOT_LEAST", hot[1])
    rng = random.Random(18)
    own = lambda k: "".join(rng.choices("abcdefghijklmnop ", k=k))
    prefix, lines = own(340), []
    for _ in range(200):
        end = own(57)
        lines += [f"{prefix}|{end}|x", f"{prefix[:50]}#{prefix[51:]}|{end[:30]}#{end[31:]}|x"]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    keys = {}
    for r in line_dedup._banded(line_dedup.signatures(line_dedup.numbered_lines(df))).collect():
        keys.setdefault(r["key"], set()).add(r["h1"])
    number = {r["h1"]: r["doc_id"] for r in line_dedup.numbered_lines(df).collect()}
    near = {(a, b) for of in keys.values() for a in map(number.get, of) for b in map(number.get, of) if a < b}
    alike = [(a, b) for a, b in near if jaccard(lines[a], lines[b]) >= 0.8]
    got = firsts(spark, lines)
    assert len(alike) > 190 and len(near) > 20 * len(lines)
    assert [(a, b) for a, b in alike if got[a] != got[b]] == []
    assert len(set(got.values())) > 150
