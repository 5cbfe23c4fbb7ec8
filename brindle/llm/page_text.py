"""Main text of web pages: a suffix array over each host's pages finds what repeats.

Each page becomes a list of blocks with what its markup says of them. The pages of a host, in
groups of some hundreds dealt by a hash, are concatenated as one stream of tokens with a
separator after each page; its suffix array, sorted to the depth of the shortest repeat that
counts, has the suffixes with a common start side by side. A start that occurs on many
distinct pages covers its tokens as boilerplate. Blocks lose what is covered and keep
their unique runs; on how many pages a run has to be depends on what markup says of the block: blocks inside of
the article's own element lose only what nearly all pages of the host have.

A host of several groups is counted whole: pages of equal blocks count in one group, so the groups' counts add up. Each group tells the runs
that are on a share of its pages, half the least that matters; runs that may reach that on the host are then counted in the groups that didn't tell them, found
in their suffix arrays as pages of their own, and all groups get those that reach it.
"""

from __future__ import annotations

import html
import pickle
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .url_rules import url_parts

#: Rows of large hosts that may be sent to all executors; with more of them the join is a shuffle.
MOST_LARGE_HOSTS = 100_000
#: Tokens of the shortest repeat that counts.
DEPTH = 8
#: On how many of a host's different pages a run has to be, and on what share: outside of what markup names, in named main parts, in the article's own element.
SOME, MANY, NEARLY_ALL = (2, 0.05), (4, 0.3), (20, 0.7)
#: A group tells the runs that are on one of so many of its pages: half of the least share above.
TOLD = 40

# Elements of HTML by how they are read, and words in class, id and role that tell what a block is.
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "noembed", "noframes", "xmp", "svg", "math", "canvas", "object", "audio", "video", "select", "head"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer",
    "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "search", "section", "summary",
    "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
NESTING = {"article", "aside", "blockquote", "body", "button", "center", "dialog", "details", "div", "dl", "fieldset", "figure", "footer", "form", "header", "label", "li", "main", "menu", "nav", "ol", "p", "search", "section", "span", "table", "td", "th", "tr", "ul", "h1", "h2", "h3", "h4", "h5", "h6"}
DROPPED = {"nav", "footer", "aside", "form", "button", "dialog", "menu", "search", "label"}
DROP_WORDS = {
    "ad", "ads", "adsense", "advert", "adverts", "advertisement", "advertising", "alert", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary", "consent",
    "contentinfo", "cookie", "cookies", "copyright", "disclaimer", "disqus", "footer", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation",
    "newsletter", "notice", "notices", "pager", "pagination", "popup", "promo", "promoted", "promotion", "recommended", "related", "replies", "reply", "respond", "responses", "search", "share",
    "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "subscription", "teaser", "toolbar", "topbar", "widget", "widgets",
}
HEADER_WORDS = {"header", "head", "pageheader", "siteheader"}
KEEP_WORDS = {"article", "entry", "post", "story"}
MAIN_WORDS = {"article", "articlebody", "content", "entry", "main", "post", "story", "text"}

#: Words that may stand beside one of DROP_WORDS in a name and leave its meaning: `cookie-notice-box`, not `social-sciences`.
BESIDE_WORDS = {
    "a", "area", "article", "bar", "block", "bottom", "box", "btn", "button", "buttons", "container", "entry", "form", "global", "header", "heading", "holder", "inner", "item", "items", "left", "link", "links",
    "list", "main", "mobile", "module", "off", "on", "outer", "page", "panel", "post", "posts", "primary", "reader", "readers", "right", "row", "secondary", "section", "shell", "site", "slot", "story", "the", "this", "title", "to", "top", "unit", "user", "wrap", "wrapper", "x",
}

_OPENS = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|(/?)([A-Za-z][^\s/>]*))")
_REST = re.compile(r"((?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+)>")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_CLOSE = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

OPEN, MAIN, ARTICLE, OUT = 0, 1, 2, 3


def _words(value: str) -> set[str]:
    return {w.lower() for part in value.split() for w in _WORD.findall(part)} | {part.lower() for part in value.split()}


def _drops(found: dict[str, str]) -> bool:
    """Whether an attribute names a part that isn't the article's: by a whole name in it, all of whose words say so or may stand beside one that does."""

    def names(words: set[str]) -> bool:
        return bool(words & DROP_WORDS) and words <= DROP_WORDS | BESIDE_WORDS

    for k in ("class", "id", "role", "itemprop", "data-role"):
        for name in found.get(k, "").split():
            if name.lower() in DROP_WORDS or names({w.lower() for w in _WORD.findall(name) if not w.isdigit()}):
                return True
    return names({w.lower() for w in _WORD.findall(found.get("aria-label", ""))})


def _role(tag: str, attrs: str, inside: int) -> int:
    """What an element makes of the blocks in it, given what surrounds it."""
    if inside == OUT or tag in DROPPED:
        return OUT
    found = {}
    if "=" in attrs or "hidden" in attrs:
        for m in _ATTR.finditer(attrs):
            found.setdefault(m[1].lower(), html.unescape((m[2] or "").strip("\"'")))
    if tag == "header" and inside < ARTICLE and "article" not in found.get("class", ""):
        return OUT
    if not found:
        return ARTICLE if tag == "article" else max(inside, MAIN) if tag == "main" else inside
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(found.get("style", "")):
        return OUT
    if tag in ("body", "html"):
        return inside
    named = _words(" ".join(found.get(k, "") for k in ("class", "id", "role", "itemprop", "data-role")))
    drops = _drops(found)
    if drops and not (inside < ARTICLE and tag in ("article", "main")):
        return OUT
    if drops and named & {"ad", "ads", "advert", "comment", "comments", "reply", "related", "teaser", "promo", "sponsored"}:
        return OUT
    if named & HEADER_WORDS and not named & KEEP_WORDS and inside < ARTICLE:
        return OUT
    if tag == "article" or "articlebody" in named:
        return ARTICLE
    if tag == "main" or named & MAIN_WORDS:
        return max(inside, MAIN)
    return inside


def _tags(page: str, go_on: list[int]) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, slash, name, rest) of each tag, and of comments and the like with an empty name, in time linear in the page.

    Who reads them may set in go_on where the next is looked for. A tag that never ends goes with all that follows. Where its quotes don't add up, that tag and all after it end at the next >.
    """
    quotes = True
    while m := _OPENS.search(page, go_on[0]):
        if m[2] is None:
            close = {"<!--": "-->", "<![CDATA[": "]]>"}.get(m[0], ">")
            end = page.find(close, m.end())
            go_on[0] = len(page) if end < 0 else end + len(close)
            yield m.start(), go_on[0], "", "", page[m.start() : go_on[0]] if m[0] == "<![CDATA[" else ""
            continue
        rest = _REST.match(page, m.end()) if quotes else None
        if rest is None:
            end = page.find(">", m.end())
            if end < 0:
                yield m.start(), len(page), "", "", ""
                return
            quotes = False
            go_on[0] = end + 1
            yield m.start(), go_on[0], m[1], m[2].lower(), page[m.end() : end]
        else:
            go_on[0] = rest.end()
            yield m.start(), go_on[0], m[1], m[2].lower(), rest[1]


def blocks(page: str) -> list[tuple[int, str]]:
    """(role, text) of the blocks of a page with visible text, in page order; unclosed elements end with their parent."""
    out: list[tuple[int, str]] = []
    text: list[str] = []
    stack: list[tuple[str, int]] = []
    open_: Counter[str] = Counter()
    role, at, endless, go_on = OPEN, 0, set(), [0]

    def end_block() -> None:
        if text:
            whole = " ".join(html.unescape("".join(text)).split())
            if whole:
                out.append((role, whole))
            text.clear()

    def pop() -> int:
        name, before = stack.pop()
        open_[name] -= 1
        return before

    for start, end, slash, tag, rest in _tags(page, go_on):
        if start > at:
            text.append(page[at:start])
        at = end
        if not tag:
            if rest:
                text.append(html.escape(rest[9:].removesuffix("]]>")))
            continue
        if not slash and tag in RAW and not rest.endswith("/"):
            if tag == "head":
                # its parts have no text but the title's; a body without a start tag ends it too
                continue
            close = None if tag in endless else _CLOSE[tag].search(page, at)
            if close is None:
                endless.add(tag)
            at = go_on[0] = close.end() if close else len(page) if tag in ("script", "style", "textarea", "title") else at
            continue
        if tag in BLOCK:
            end_block()
        if tag not in NESTING:
            continue
        if slash:
            while open_[tag]:
                name = stack[-1][0]
                role = pop()
                if name == tag:
                    break
        elif not rest.endswith("/") or tag in ("p", "div"):
            if tag in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "td", "th") and stack and stack[-1][0] == tag:
                role = pop()
            stack.append((tag, role))
            open_[tag] += 1
            new = _role(tag, rest, role)
            if new != role and tag not in BLOCK:
                end_block()
            role = new
    text.append(page[at:])
    end_block()
    return out


def ranked(coded: np.ndarray, sizes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rank, distinct, starts) of a stream of pages of coded tokens, with a separator after each.

    Ranks are equal where the next depth tokens are, distinct tells by rank on how many different pages these stand, and starts where each page does.
    """
    n = int(sizes.sum()) + len(sizes)
    page = np.repeat(np.arange(len(sizes)), sizes + 1)
    starts = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1]
    rank = np.empty(n, np.int64)
    gap = np.zeros(n, bool)
    gap[starts + sizes] = True
    rank[~gap] = coded
    rank[gap] = coded.max(initial=0) + 1 + np.arange(len(sizes))  # separators differ, so no repeat crosses one
    length = 1
    order = np.argsort(rank, kind="stable") if depth == 1 else None
    while n and length < depth:  # prefix doubling; the last step overlaps, so that ranks tell exactly depth tokens
        step = min(length, depth - length)
        ahead = np.full(n, -1, np.int64)
        if step < n:
            ahead[: n - step] = rank[step:]
        key = rank * (n + rank.max() + 2) + ahead + 1
        length += step
        order = np.argsort(key, kind="stable" if length == depth else None)
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(sorted_key[1:] != sorted_key[:-1])))
    if not n:
        return rank, np.zeros(0, np.int64), starts
    # in the suffix array, equal starts are neighbours, and the stable order keeps pages together
    r, p = rank[order], page[order]
    new = np.concatenate(([True], (r[1:] != r[:-1]) | (p[1:] != p[:-1])))
    return rank, np.bincount(r[new], minlength=int(r.max()) + 1), starts


def _sizes(pages: list[list[str]]) -> np.ndarray:
    return np.array([len(p) for p in pages], np.int64)


def _coded(pages: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each token of the pages, and the different tokens by number."""
    words = [w for p in pages for w in p]
    return pd.factorize(np.array(words, dtype=object)) if words else (np.zeros(0, np.int64), np.zeros(0, object))


def _of_pages(by_token: np.ndarray, starts: np.ndarray, sizes: np.ndarray, depth: int) -> list[np.ndarray]:
    """What belongs to each page, with 0 for the tokens whose run the page ends before."""
    out = [by_token[a : a + s].copy() for a, s in zip(starts, sizes, strict=True)]
    for counts in out:
        counts[max(0, len(counts) - depth + 1) :] = 0
    return out


def repeats(pages: list[list[str]], depth: int) -> list[np.ndarray]:
    """On how many different pages the run of depth tokens from each token on occurs; 0 where a page ends before."""
    sizes = _sizes(pages)
    rank, distinct, starts = ranked(_coded(pages)[0], sizes, depth)
    return _of_pages(distinct[rank], starts, sizes, depth)


def _hashes(words: np.ndarray) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))


def frequent(pages: list[list[str]], depth: int, one_of: int) -> tuple[list[bytes], np.ndarray]:
    """The runs of depth tokens that are on one of one_of pages at least, as their tokens' hashes, and on how many pages each is."""
    sizes = _sizes(pages)
    coded, words = _coded(pages)
    rank, distinct, starts = ranked(coded, sizes, depth)
    whole = np.concatenate([np.arange(a, a + s - depth + 1) for a, s in zip(starts, sizes, strict=True)] or [np.zeros(0, np.int64)])
    often = whole[distinct[rank[whole]] * one_of >= len(pages)]
    found, first = np.unique(rank[often], return_index=True)
    # a token's place among tokens is its place in the stream less the separators before it
    at = often[first]
    at = at - (np.searchsorted(starts, at, side="right") - 1)
    hashes = _hashes(words)[coded] if len(at) else np.zeros(0, np.uint64)
    return [hashes[i : i + depth].tobytes() for i in at], distinct[found]


def looked_up(pages: list[list[str]], depth: int, runs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(known, of, distinct, rank, starts): which of runs, all different, have tokens of the pages only, and the suffix array of the pages and of these as pages of their own, with the ranks of the latter.

    Of the pages in distinct, one is such a run itself.
    """
    sizes = _sizes(pages)
    coded, words = _coded(pages)
    hashes = _hashes(words)
    order = np.argsort(hashes)
    wanted = np.frombuffer(b"".join(runs), np.uint64).reshape(-1, depth)
    at = np.minimum(np.searchsorted(hashes, wanted, sorter=order), len(hashes) - 1) if len(hashes) else np.zeros(wanted.shape, np.int64)
    known = np.flatnonzero((hashes[order[at]] == wanted).all(axis=1)) if len(hashes) else np.zeros(0, np.int64)
    both = np.concatenate((coded, order[at[known]].ravel() if len(known) else np.zeros(0, np.int64)))
    rank, distinct, starts = ranked(both, np.concatenate((sizes, np.full(len(known), depth, np.int64))), depth)
    return known, rank[starts[len(pages) :]], distinct, rank, starts[: len(pages)]


def on_pages(pages: list[list[str]], depth: int, runs: list[bytes]) -> np.ndarray:
    """On how many pages each of runs, all different, is."""
    known, of, distinct, _, _ = looked_up(pages, depth, runs)
    out = np.zeros(len(runs), np.int64)
    out[known] = distinct[of] - 1
    return out


def told(pages: list[list[str]], depth: int, runs: list[bytes], totals: np.ndarray) -> list[np.ndarray]:
    """What totals tells of the run of depth tokens from each token on; 0 where runs hasn't it."""
    known, of, distinct, rank, starts = looked_up(pages, depth, runs)
    by_rank = np.zeros(len(distinct), np.int64)
    by_rank[of] = totals[known]
    return _of_pages(by_rank[rank], starts, _sizes(pages), depth)


def covered(counts: list[np.ndarray], depth: int, enough: float) -> list[np.ndarray]:
    """Which tokens of each page lie in a run of depth tokens that is on enough pages."""
    out = []
    for own in counts:
        hit = np.zeros(len(own) + depth + 1, np.int64)
        at = np.flatnonzero(own >= enough)
        hit[at] += 1
        hit[at + depth] -= 1
        out.append(np.cumsum(hit)[: len(own)] > 0)
    return out


def whole_runs(cover: np.ndarray, depth: int) -> np.ndarray:
    """The covered runs of a block that are as long as a repeat has to be, or all of the block.

    A shorter run only ends or begins a repeat that lies in the next block: it is a common word or two.
    """
    edge = np.flatnonzero(np.diff(np.concatenate(([0], cover.astype(np.int8), [0]))))
    out = np.zeros(len(cover), bool)
    for a, b in zip(edge[::2], edge[1::2], strict=True):
        if b - a >= min(depth, len(cover)):
            out[a:b] = True
    return out


def _words_of(kinds: Iterable[Iterable[tuple[int, str]]]) -> list[list[str]]:
    return [[w for _, text in page for w in text.split(" ")] for page in kinds]


def choose(pages: list[list[tuple[int, str]]], depth: int = DEPTH, host: tuple[int, list[bytes], np.ndarray] | None = None) -> list[str]:
    """The main text of each of a host's pages, from their blocks; pages of equal blocks count as one.

    Where markup is silent a run goes that two pages, and a twentieth, have. Where nothing is left then, as of the copies of
    an article, only what four pages and three tenths have goes, as in parts that are named the main ones. Within an article's own element a run
    goes that 20 pages and seven tenths have.

    Of a host that has other pages too, host tells how many different ones it has, the runs that a twentieth of them have, and on how many each is.
    """
    kinds: dict[tuple, int] = {}
    kind = [kinds.setdefault(tuple(p), len(kinds)) for p in pages]
    tokens = _words_of(kinds)
    n, counts = (len(kinds), repeats(tokens, depth)) if host is None else (host[0], told(tokens, depth, *host[1:]))
    some, many, nearly_all = (covered(counts, depth, max(least, share * n)) for least, share in (SOME, MANY, NEARLY_ALL))
    out = []
    for k, page in enumerate(kinds):
        best = max((role for role, _ in page if role != OUT), default=OPEN)

        def left(silent: np.ndarray, k: int = k, page: tuple = page, best: int = best) -> str:
            kept, at = [], 0
            for role, text in page:
                begin, at = at, at + text.count(" ") + 1
                if role == OUT or role < best:
                    continue
                cover = (nearly_all[k] if role == ARTICLE else many[k] if role == MAIN else silent)[begin:at]
                if cover.any():
                    cover = whole_runs(cover, depth)
                if not cover.any():
                    kept.append(text)
                elif not cover.all():
                    kept.append(" ".join(w for w, c in zip(tokens[k][begin:at], cover, strict=True) if not c))
            return " ".join(kept)

        # a page that is nothing but what all have is text all the same
        out.append(left(some[k]) or left(many[k]) or " ".join(text for role, text in page if role != OUT and role >= best))
    return [out[k] for k in kind]


def _pack(page: list[tuple[int, str]]) -> bytes:
    """Blocks as lines; their texts have no white space but single spaces."""
    return "\n".join(f"{role}{text}" for role, text in page).encode("utf-8", "surrogatepass")


def _unpack(packed: bytes) -> list[tuple[int, str]]:
    return [(int(line[0]), line[1:]) for line in packed.decode("utf-8", "surrogatepass").split("\n")] if packed else []


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", group: int = 512) -> DataFrame:
    """One row per row of pages: (page_id, url, text, n_chars).

    text: the blocks of the article in page order, joined by a space, their character
    references decoded and white space made single spaces. n_chars: its code points.

    What a host's pages have in common is counted over all of them, whatever groups of group pages on average they are dealt into.

    A null or empty page, and one without an article, has an empty text; a page of any length is read whole, in linear time however
    broken its markup. Pages with a null or odd url are the host "". Repeated rows are returned each and count as one
    page. An empty table gives no rows; other columns are ignored.
    """
    host, _ = url_parts(F.col("url"))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html")).withColumn("host", host)
    # only hosts of more than one group need to be told how many; where those are few they go to all executors
    large = cut(rows.groupBy("host").count().where(F.col("count") > group).select("host", F.ceil(F.col("count") / F.lit(group)).cast("int").alias("g")))
    n_large = large.count()
    rows = rows.join(F.broadcast(large) if n_large <= MOST_LARGE_HOSTS else large, "host", "left").select("host", F.coalesce("g", F.lit(1)).alias("g"), "page_id", "url", "html")

    def parser(counting: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A batch's pages of a group as one value. For counting only the first of a task's pages of the same blocks.

            That is dealt by its blocks, so that such pages of all tasks meet; the others are dealt anyhow, as they may be very many.
            """
            squeeze, task, seen = zstandard.ZstdCompressor(level=3), TaskContext.get().partitionId(), Counter()
            for batch in batches:
                groups = defaultdict(list)
                for host, g, page_id, url, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    packed = _pack(blocks(page or ""))
                    own = blake2b(packed, digest_size=16).digest()
                    copies = seen[host, own]
                    seen[host, own] += 1
                    turn = blake2b(b"%d %d" % (task, copies), key=own).digest() if copies else own
                    key = (host, int.from_bytes(turn[:8], "little") % g, g)
                    if not counting:
                        groups[key].append((page_id, url, not copies, packed))
                    elif not copies:
                        groups[key].append(packed)
                columns = [*zip(*groups, strict=True)] or [(), (), ()]
                whole = [squeeze.compress(pickle.dumps(of)) for of in groups.values()]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32()), pa.array(whole, pa.binary())], ["host", "grp", "g", "packed"])

        return parse

    def unpacked(part: pd.DataFrame) -> list:
        spread = zstandard.ZstdDecompressor()
        return [x for p in part["packed"] for x in pickle.loads(spread.decompress(p))]

    def different(packed: Iterable[bytes]) -> list[list[str]]:
        """The tokens of each different page."""
        return _words_of(map(_unpack, dict.fromkeys(packed)))

    def texts(part: pd.DataFrame, host: tuple | None = None) -> pd.DataFrame:
        ids, urls, _, packed = zip(*unpacked(part), strict=True)
        out = choose([*map(_unpack, packed)], host=host)
        return pd.DataFrame({"page_id": pd.array(ids, "Int64"), "url": pd.Series(urls, dtype=object), "text": out, "n_chars": [len(t) for t in out]})

    groups_of, result = "host string, grp int, g int, packed binary", "page_id long, url string, text string, n_chars long"
    dealt = rows.mapInArrow(parser(False), groups_of).groupBy("host", "grp")
    if not n_large:
        return dealt.applyInPandas(lambda part: texts(part), result)

    def tell(part: pd.DataFrame) -> pd.DataFrame:
        """A row for the group, with its number of pages, and one for each of its frequent runs."""
        own = different(unpacked(part))
        runs, counts = frequent(own, DEPTH, TOLD)
        return pd.DataFrame({"host": [part["host"].iat[0]] * (1 + len(runs)), "grp": part["grp"].iat[0], "run": [None, *runs], "n": [0, *counts], "of": len(own)})

    def count(part: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        if not len(wanted):
            return pd.DataFrame({"host": [], "run": [], "n": []}, dtype=object)
        own = different(packed for _, _, first, packed in unpacked(part) if first)
        runs = wanted["run"].tolist()
        return pd.DataFrame({"host": [part["host"].iat[0]] * len(runs), "run": runs, "n": on_pages(own, DEPTH, runs)})

    def apply(part: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(part):
            return pd.DataFrame({"page_id": [], "url": [], "text": [], "n_chars": []}, dtype=object)
        if part["g"].iat[0] == 1:
            return texts(part)
        return texts(part, (known["all"].iat[0] if len(known) else 0, known["run"].tolist(), known["n"].to_numpy(np.int64)))

    said = cut(rows.where("g > 1").mapInArrow(parser(True), groups_of).groupBy("host", "grp").applyInPandas(tell, "host string, grp int, run binary, n long, of long"))
    groups = said.where("run is null").select("host", "grp", "of")
    hosts = groups.groupBy("host").agg(F.sum("of").alias("all"))
    least, share = SOME
    enough = F.greatest(F.lit(float(least)), F.lit(share) * F.col("all"))
    # a run is on fewer than one of TOLD pages of each group that doesn't tell it
    sums = said.where("run is not null").groupBy("host", "run").agg(F.sum("n").alias("n"), F.sum("of").alias("of"), F.collect_set("grp").alias("by")).join(hosts, "host")
    may = cut(sums.where(F.col("n") * TOLD + F.col("all") - F.col("of") >= enough * TOLD))
    wanted = may.where("of < all").select("host", "run", "by").join(groups, "host").where(~F.array_contains("by", F.col("grp"))).select("host", "grp", "run")
    counted = dealt.cogroup(wanted.groupBy("host", "grp")).applyInPandas(count, "host string, run binary, n long")
    summed = may.select("host", "run", "n").unionByName(counted).groupBy("host", "run").agg(F.sum("n").alias("n"))
    common = summed.join(hosts, "host").where(F.col("n") >= enough).select("host", "run", "n", "all")
    # a group may have none but further copies, and hasn't told anything then
    each = large.select("host", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("grp"))
    return dealt.cogroup(common.join(each, "host").groupBy("host", "grp")).applyInPandas(apply, result)
