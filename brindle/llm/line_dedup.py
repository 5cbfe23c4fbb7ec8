"""Fuzzy lines by MinHash, in DataFrame operations only.

A line, trimmed, is the set of its runs of eight characters, whatever these are. Its signature has the least hash of all
runs in each of nine orders. The nine are the points of an affine plane of order three, and the three points on a line of that
plane make a band's key: bands share no two points, so nine minima give as many well spread keys. Lines that share
a key are a group. In the order of further minima those of a group that are most alike stand together, and each line is
a candidate with the NEXT before it: this costs as many pairs as a group has lines, not their square. Candidates
whose bitmaps show too many runs that only one of them has go; the Jaccard similarity of whole sets decides on all others,
and the linked lines' components keep their first line.

Groups in which NEXT doesn't reach all are compared to the end, but for pairs that are of one component by then: those of up to EACH lines pair by
pair, the lines of larger ones by an exact join. There two that are alike share one of
the least common runs of each, as many as the similarity lets one line have without the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, cut

WIDTH = 8
#: Side of the plane of minima, and how many of its directions are used: each gives SIDE keys.
SIDE, DIRECTIONS = 3, 3
#: 64-bit words in a line's bitmap.
WORDS = 16
#: Rows of line hashes that may be sent to all executors.
MOST_WANTED = 500_000
#: How many lines ahead a line is paired with in a key's group, before groups of up to EACH lines are compared pair by pair, and larger ones by a join.
NEXT, EACH = 4, 128
#: Runs that are hashed in one row.
STEP = 4
PAIR, MEMBER, REST = 0, 1, 2
#: In a place's number, how many a doc_id has for its lines; and what stands for a null doc_id, less than any other.
LINES, NO_DOC = 1 << 31, str(-(1 << 63) - 1)
#: A key of so many lines is divided. The second number told such a key by a part of the lines; keys are counted now.
HOT, HOT_LEAST = 1 << 20, 1 << 14


def bands() -> list[list[int]]:
    """The minima that make each band's key: the points, numbered, on the plane's lines of each direction used."""
    along = lambda d, c: [x * SIDE + y for x in range(SIDE) for y in range(SIDE) if (x if d == SIDE else y - d * x) % SIDE == c]
    return [along(d, c) for d in [SIDE, *range(SIDE)][:DIRECTIONS] for c in range(SIDE)]


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """With columns that are computed once a row: a generator keeps them from being computed again in each term that uses them."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def _starts(line: Column) -> Column:
    """Where runs begin in a line coded with four bytes a character, in which a run is cut out in constant time."""
    return F.sequence(F.lit(1), (F.length(line) - WIDTH) * 4 + 1, F.lit(4))


def _hash(coded: Column | str, start: Column) -> Column:
    return F.xxhash64(F.substring(coded, start, F.lit(4 * WIDTH)))


def shingles(line: Column) -> Column:
    """The runs of WIDTH characters, repeated ones too, as 64-bit hashes; a shorter line is its own one.

    The outer lambda binds the coded line, once.
    """
    runs = lambda coded: F.transform(_starts(line), lambda i: _hash(coded, i))
    return F.when(F.length(line) < WIDTH, F.array(F.xxhash64(line))).otherwise(F.transform(F.array(F.encode(line, "UTF-32")), runs)[0])


def _runs(lines: DataFrame, step: int = 1) -> DataFrame:
    """(h1, last, run0, run1, ...): rows of step runs each of each line of WIDTH characters or more, the last run repeated in the last row; last is where it starts.

    Such rows and an aggregation by line are compiled whole, and never leave their task.
    """
    last = (F.length("line") - WIDTH) * 4 + 1
    coded = lines.where(F.length("line") >= WIDTH).select("h1", F.encode("line", "UTF-32").alias("coded"), last.alias("last"), F.sequence(F.lit(1), last, F.lit(4 * step)).alias("starts"))
    start = lambda k: F.least(F.col("i") + 4 * k, "last") if k else F.col("i")
    return coded.select("h1", "coded", "last", F.explode_outer("starts").alias("i")).select("h1", "last", *(_hash("coded", start(k)).alias(f"run{k}") for k in range(step)))


def signatures(lines: DataFrame) -> DataFrame:
    """(h1, m0, m1, ...) of each different line: its runs' least hash in each order, which is that of the hashes with some bits turned over."""
    turned = [F.lit((b * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64) - (1 << 63)) for b in range(SIDE * SIDE)]
    return _runs(lines, STEP).groupBy("h1").agg(*(F.min(F.least(*(F.col(f"run{j}").bitwiseXOR(t) for j in range(STEP)))).alias(f"m{k}") for k, t in enumerate(turned)))


def _key(b: int, of: list[int]) -> Column:
    return F.xxhash64(F.lit(b), *(f"m{k}" for k in of))


def _banded(signed: DataFrame) -> DataFrame:
    """(key, turn, h1) for each line and band: turn has 16 bits each of four of the minima that the key doesn't have."""
    parts = []
    for b, of in enumerate(bands()):
        rest = [k for k in range(SIDE * SIDE) if k not in of]
        bits = [F.call_function("shiftleft", F.col(f"m{k}").bitwiseAND(0xFFFF), F.lit(48 - 16 * i)) for i, k in enumerate((rest[b % len(rest) :] + rest)[:4])]
        turn = bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3])
        parts.append(F.struct(_key(b, of).alias("key"), turn.alias("turn")))
    return signed.select("h1", F.explode(F.array(*parts)).alias("k")).select("k.key", "k.turn", "h1")


def _ordered(signed: DataFrame) -> DataFrame:
    """(role, src, dst), each once: PAIR with two of a key's lines, one of the NEXT and the other; MEMBER with a line and its key, of up to EACH lines but more than
    NEXT reaches; REST with a line, twice, of a larger one.

    Most keys have one line, and most others two: these are told by a count and the least and greatest line, and only the lines of larger keys are put in order.
    A key of very many lines is divided by one more minimum, so that no task has it alone; theirs are REST.
    """
    keys = signed.select("h1", F.explode(F.array(*(_key(b, of) for b, of in enumerate(bands())))).alias("key"))
    sizes = cut(keys.groupBy("key").agg(F.count("*").alias("size"), F.min("h1").alias("least"), F.max("h1").alias("most")).where("size > 1"))
    twos = sizes.where("size = 2").select(F.lit(PAIR).alias("role"), F.col("most").alias("src"), F.col("least").alias("dst"))
    larger = sizes.where("size > 2").select("key", "size")
    rows = _banded(signed).join(_sent(larger), "key").withColumn("hot", F.col("size") >= HOT)
    rows = rows.select(F.when(F.col("hot"), F.xxhash64("key", F.shiftrightunsigned("turn", 48))).otherwise(F.col("key")).alias("key"), "turn", "h1", "size", "hot")
    order = Window.partitionBy("key").orderBy("turn", "h1")
    of = lambda role, o: F.struct(F.lit(role).alias("role"), o.alias("o"))
    more = F.when((F.col("size") > EACH) | F.col("hot"), of(REST, F.col("h1"))).when(F.col("size") > NEXT + 1, of(MEMBER, F.col("key")))
    ahead = rows.select("h1", F.array(*(of(PAIR, F.lag("h1", k).over(order)) for k in range(1, NEXT + 1)), more).alias("ahead"))
    found = ahead.select("h1", F.explode("ahead").alias("x")).where("x.o is not null").select("h1", "x.role", "x.o")
    pair = F.col("role") == PAIR
    found = found.select("role", F.when(pair, F.greatest("h1", "o")).otherwise(F.col("h1")).alias("src"), F.when(pair, F.least("h1", "o")).otherwise(F.col("o")).alias("dst"))
    return found.union(twos).distinct()


def neighbours(signed: DataFrame) -> DataFrame:
    """(src, dst): pairs of each key's lines, each with the NEXT ones in the order of further minima."""
    return _ordered(signed).where(F.col("role") == PAIR).select("src", "dst")


def bitmaps(lines: DataFrame) -> DataFrame:
    """(h1, n, bits) of each different line: its number of different runs, and a bitmap in which the hash of each of these turns over a bit.

    Runs that two lines share turn over the same bits, and so hide none of the others, however many they are and however long the lines.
    """
    runs = _once(lines, runs=F.array_distinct(shingles(F.col("line")))).select("h1", F.explode_outer("runs").alias("run"))
    placed = runs.select("h1", F.pmod("run", F.lit(WORDS)).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned("run", 58).cast("int")).alias("bit"))
    words = (F.bit_xor(F.when(F.col("word") == k, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"w{k}") for k in range(WORDS))
    return placed.groupBy("h1").agg(F.count("*").alias("n"), *words).select("h1", "n", F.array(*(f"w{k}" for k in range(WORDS))).alias("bits"))


def may_be_alike(pairs: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """(src, dst): the pairs, but for those whose bitmaps rule the similarity out: a bit that differs is that of a run that only one line has.

    Of sets whose sizes add up to n, those of the similarity have no more than n * (100 - percent) / (100 + percent) of such runs.
    """
    side = lambda end, n, bits: maps.select(F.col("h1").alias(end), F.col("n").alias(n), F.col("bits").alias(bits))
    both = pairs.join(side("src", "na", "p"), "src").join(side("dst", "nb", "q"), "dst")
    unlike = sum((F.bit_count(F.col("p")[k].bitwiseXOR(F.col("q")[k])) for k in range(1, WORDS)), F.bit_count(F.col("p")[0].bitwiseXOR(F.col("q")[0])))
    near = F.least("na", "nb") * F.lit(100).cast("long") >= F.greatest("na", "nb") * percent
    return both.where(near & ((F.col("na") + F.col("nb")) * F.lit(100 - percent).cast("long") >= unlike * (100 + percent))).select("src", "dst")


def linked(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets are of the similarity."""
    side = lambda end, line: texts.select(F.col("h1").alias(end), F.col("line").alias(line))
    both = pairs.join(side("src", "a"), "src").join(side("dst", "b"), "dst")
    runs = _once(both, p=shingles(F.col("a")), q=shingles(F.col("b"))).select("src", "dst", "p", "q")
    # intersection and union leave repeated runs out; no union has more than all runs that the intersection leaves
    shared = _once(runs, c=F.size(F.array_intersect("p", "q")) * F.lit(100).cast("long"))
    most = (F.size("p") + F.size("q") - F.expr("c div 100")) * F.lit(percent)
    return shared.where(F.when(F.col("c") >= most, F.lit(True)).otherwise(F.col("c") >= F.size(F.array_union("p", "q")) * F.lit(percent))).select("src", "dst")


def member_pairs(members: DataFrame) -> DataFrame:
    """(src, dst): all pairs of a key's lines, of members (h1, key, comp), but for those of one component; of several keys several times."""
    other = members.select("key", F.col("h1").alias("dst"), F.col("comp").alias("of"))
    return members.join(other, "key").where((F.col("comp") != F.col("of")) & (F.col("h1") > F.col("dst"))).select(F.col("h1").alias("src"), "dst")


def rest_pairs(rest: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(src, dst): all pairs of rest (h1, comp) that may be of the similarity, but for those of one component; some several times.

    A run that only one component has can't be shared by such a pair, and a line has to share percent of its own runs with
    another: where fewer are shared by any, it has no partner. Else the first of its shared runs, the least common before others, as many as may be
    missing and one more, hold one that is among those of each partner; of the smaller of two, still fewer may be missing. Runs that only one's
    component has are of that line alone: a pair with more of them than the similarity lets two lines have is none.
    """
    own = _once(rest.join(texts, "h1"), runs=F.array_distinct(shingles(F.col("line"))))
    runs = cut(own.select("h1", "comp", F.size("runs").alias("size"), F.explode("runs").alias("run")))
    often = runs.groupBy("run").agg(F.count("*").alias("often"), F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("run", "often")
    order = Window.partitionBy("h1").orderBy("often", "run")
    numbers = {"n": F.count("*").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "place": F.row_number().over(order)}
    places = lambda of, parts: F.col("place") <= F.col("n") - F.expr(f"(size * {of}L + {parts - 1}) div {parts}") + 1
    first = runs.join(often, "run").withColumns(numbers).where(places(percent, 100))
    first = cut(first.select("run", "h1", "comp", "size", (F.col("size") - F.col("n")).alias("lone"), places(2 * percent, 100 + percent).alias("smaller")))
    other = first.where("smaller").select("run", F.col("h1").alias("dst"), F.col("comp").alias("of"), F.col("size").alias("than"), F.col("lone").alias("alone"))
    sizes = (F.col("than") * F.lit(100).cast("long") >= F.col("size") * percent) & ((F.col("than") < F.col("size")) | ((F.col("than") == F.col("size")) & (F.col("h1") > F.col("dst"))))
    few = (F.col("lone") + F.col("alone")) * (100 + percent) <= (F.col("size") + F.col("than")) * F.lit(100 - percent).cast("long")
    return first.drop("smaller").join(other, "run").where(sizes & few & (F.col("comp") != F.col("of"))).select(F.greatest("h1", "dst").alias("src"), F.least("h1", "dst").alias("dst"))


def _of_comp(comps: DataFrame, lines: DataFrame) -> DataFrame:
    """lines with comp, a line's component in comps (h1, comp): itself where it has none."""
    return lines.join(comps, "h1", "left").withColumn("comp", F.coalesce("comp", "h1"))


def _apart(comps: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (src, dst, ...) that aren't of one component, with src_comp and dst_comp."""
    for end in ("src", "dst"):
        pairs = pairs.join(_of_comp(comps, pairs.select(F.col(end).alias("h1")).distinct()).select(F.col("h1").alias(end), F.col("comp").alias(f"{end}_comp")), end)
    return pairs.where("src_comp <> dst_comp")


def _joined(comps: DataFrame, links: DataFrame) -> DataFrame:
    """comps, those joined that links (src, dst) are between."""
    links = cut(links)
    if links.isEmpty():
        return comps
    between = _apart(comps, links).select(F.col("src_comp").alias("src"), F.col("dst_comp").alias("dst"))
    whole = cut(components(between).select(F.col("node").alias("comp"), F.col("comp").alias("whole")))
    alone = whole.select(F.col("comp").alias("h1"), "comp").join(comps, "h1", "left_anti")
    return cut(comps.unionByName(alone).join(whole, "comp", "left").select("h1", F.coalesce("whole", "comp").alias("comp")))


def _sent(few: DataFrame) -> DataFrame:
    """few, rows of line hashes that are a side of a join: where there aren't many, all executors get them."""
    return F.broadcast(few) if few.count() <= MOST_WANTED else few


def _place() -> Column:
    """doc_id and line_no as one number in their order, null ids first, as a least number needs no sorting of rows."""
    doc = F.coalesce(F.col("doc_id").cast("decimal(20,0)"), F.lit(NO_DOC).cast("decimal(20,0)"))
    return (doc * F.lit(LINES).cast("decimal(11,0)") + F.col("line_no").cast("decimal(10,0)")).cast("decimal(38,0)")


def _doc(place: Column) -> Column:
    """The doc_id of a place."""
    doc = F.floor((place - F.pmod(place, F.lit(LINES))) / F.lit(LINES))
    return F.when(doc > F.lit(NO_DOC).cast("decimal(20,0)"), doc.cast("long"))


def numbered_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, line, h1, h2) of each line, trimmed, with a 128-bit hash."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return rows.withColumn("line", F.trim("line")).withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(17), F.col("line"))})


def line_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """One row per line: (doc_id, line_no, first_doc, first_line, kept).

    Lines are those between newlines. first_doc and first_line tell the first line, by doc_id
    and line_no, of the component that a line is in, and kept whether it is that one.

    Blank lines, and the one of a null or empty text, are kept and alone. Lines of any length count whole. A
    line under WIDTH characters links with equal ones only. Equal rows have equal lines, all but one of which aren't
    kept unless their ids are equal too; null ids come first. An empty table gives no rows;
    other columns are ignored.
    """
    lines = numbered_lines(docs, id_col, text_col)
    blank = F.col("h1") == F.xxhash64(F.lit(""))
    places = cut(lines.select("doc_id", "line_no", "h1", "h2"))

    signed = cut(signatures(lines))
    ordered = cut(_ordered(signed))
    pairs, members, rest = (ordered.where(F.col("role") == role).drop("role") for role in (PAIR, MEMBER, REST))
    # a hot key's line may have no pair
    ends = cut(ordered.select(F.col("src").alias("h1")).union(pairs.select(F.col("dst").alias("h1"))).distinct())
    texts = cut(lines.select("h1", "line").join(_sent(ends), "h1").dropDuplicates(["h1"]))
    maps = cut(bitmaps(texts))

    alike = cut(may_be_alike(pairs, maps, percent))
    comps = cut(components(linked(alike, texts, percent)).select(F.col("node").alias("h1"), "comp"))
    further = member_pairs(_of_comp(comps, members.select(F.col("src").alias("h1"), F.col("dst").alias("key"))))
    if not rest.isEmpty():
        further = further.union(rest_pairs(cut(_of_comp(comps, rest.select(F.col("src").alias("h1")))), texts, percent))
    further = cut(may_be_alike(further.distinct(), maps, percent).join(alike, ["src", "dst"], "left_anti"))
    comps = _joined(comps, linked(further, texts, percent))

    classes = places.where(~blank).groupBy("h1", "h2").agg(F.min(_place()).alias("first"), F.count("*").alias("n"))
    known = cut(classes.join(_sent(comps), "h1", "left").where("n > 1 or comp is not null"))
    firsts = known.where("comp is not null").groupBy("comp").agg(F.min("first").alias("head"))
    heads = known.join(firsts, "comp", "left").select("h1", "h2", F.coalesce("head", "first").alias("head"))
    heads = heads.select("h1", "h2", _doc(F.col("head")).alias("head_doc"), F.pmod("head", F.lit(LINES)).cast("int").alias("head_line"))
    out = places.join(heads, ["h1", "h2"], "left")
    alone = F.col("head_line").isNull()
    mine = alone | (F.col("head_doc").eqNullSafe(F.col("doc_id")) & (F.col("head_line") == F.col("line_no")))
    return out.select("doc_id", "line_no", F.when(alone, F.col("doc_id")).otherwise(F.col("head_doc")).alias("first_doc"), F.coalesce("head_line", "line_no").alias("first_line"), mine.alias("kept"))
