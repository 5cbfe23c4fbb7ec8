"""Classifier, extraction, filters, decontamination, secrets."""

import random
import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from brindle.llm import decontaminate, page_text, quality, secret_scan, url_rules

DATA = "/root/testdata/sf0.01"


def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score_quality(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    out = got[got.held_out]
    rank, y = out.score.rank().to_numpy(), out.quality.to_numpy()
    auc = (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    assert len(got) == labels.count() and auc > 0.98 and (out.predicted == out.quality).mean() > 0.97
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()


def test_held_out_labels_change_nothing(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.fit_quality(docs, x) for x in (labels, flipped))
    assert a == b and a.rules


def test_score_is_the_models(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = ((x[:, 0] > 0) & (x[:, 1] < 0.5)).astype(int)
    model = quality.fit_rules(x, y, ["a", "b", "c"])
    got = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b", "c"])).select(model.column()).toPandas().to_numpy()[:, 0]
    want = model.intercept + sum(w * np.all([x[:, "abc".index(n)] > t if above else x[:, "abc".index(n)] <= t for n, above, t in tests], axis=0) for w, tests in model.rules)
    assert np.allclose(got, 1 / (1 + np.exp(-want))) and ((got >= 0.5) == y).mean() > 0.97
    assert len(model.rules) < 60


def plain_statistics(text):
    """The 16 statistics by Python's own string functions."""
    t = text or ""
    words = re.split("[ \\t-\\r]+", t.strip(" \t\n\x0b\f\r")) if t.strip(" \t\n\x0b\f\r") else [""]
    lines, n = t.split("\n"), len(t)
    kind = lambda *of: sum(unicodedata.category(c) in of for c in t)
    letter = lambda c: unicodedata.category(c)[0] in "LN"
    runs, i = 0, 0
    while i + 1 < n:
        double = t[i] == t[i + 1] and not letter(t[i]) and t[i] not in " \t\n\x0b\f\r"
        runs, i = runs + double, i + 1 + double
    chars = lambda of: sum(c in of for c in t)
    per = lambda a, b: a / b if b else 0.0
    return {
        "chars": np.log1p(n), "words": np.log1p(len(words)), "word_length": n / len(words), "line_length": np.log1p(n / len(lines)), "distinct_words": len(set(words)) / len(words), "distinct_lines": len(set(lines)) / len(lines),
        "upper": per(kind("Lu"), n), "digits": per(kind("Nd"), n), "symbols": per(chars("#$%&*@^~_=+<>{}[]\\/"), n), "bars": per(chars("|"), n), "stops": chars(".:;") / len(words), "bangs": chars("!?") / len(words), "commas": chars(",") / len(words),
        "runs": runs / len(words), "long_words": sum(len(w) // 20 > 0 for w in re.split("[ \\t-\\r]+", t)) / len(words), "other": per(sum(unicodedata.category(c)[0] not in "LNPS" and c not in " \t\n\x0b\f\r" for c in t), n),
    }


def test_query_of_quality_is_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit_quality(docs, labels)
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in quality.score_quality(docs, labels).collect()}
    for r in docs.collect():
        of = plain_statistics(r["text"])
        want = model.intercept + sum(w for w, tests in model.rules if all(of[n] > t if above else of[n] <= t for n, above, t in tests))
        assert abs(got[r["doc_id"]][0] - 1 / (1 + np.exp(-want))) < 1e-9 and got[r["doc_id"]][1] == (got[r["doc_id"]][0] >= 0.5)
    texts = [None, "", " ", "\n\n", "!!! ¡¡¡ a||b", "Ünï \t x" * 30, "x" * 45, "\u200b\u00ad ok"]
    stats = quality.statistics(F.col("t"))
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", *(c.alias(n) for n, c in stats.items())).collect():
        want = plain_statistics(r["t"])
        assert {n: round(r[n], 9) for n in stats} == {n: round(float(v), 9) for n, v in want.items()}, r["t"]


def test_quality_edges(spark):
    schema = "doc_id long, text string, score string, label int"
    docs = spark.createDataFrame([(1, None, "x", 0), (1, None, "x", 0), (2, "", "x", 1), (None, "word " * 50_000, "x", 1), (3, "\0 ÿ", "x", None)], schema)
    labels = spark.createDataFrame([(1, None), (2, 7), (3, 1)], "doc_id long, quality int")
    got = quality.score_quality(docs, labels).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert not quality.score_quality(docs.limit(0), labels).collect()
    assert {round(r["score"], 9) for r in quality.score_quality(docs, labels.limit(0)).collect()} == {0.5}


def test_best_match_is_the_least_distance():
    rng = random.Random(1)

    def least(p, t):
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            new = [i]
            for j, d in enumerate(t, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
            row = new
        return min(row)

    for _ in range(300):
        p, t = ("".join(rng.choices("abc ", k=rng.randint(a, b))) for a, b in ((1, 70), (0, 90)))
        assert decontaminate.best_match(p, t)[0] == least(p, t)


def test_decontamination(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(500)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(6, 50)))) for i in range(30)] + [(98, None), (99, "?!")]
    docs, want = [], set()
    for d in range(150):
        t = rng.choices(words, k=rng.randint(0, 200))
        if d % 3 == 0:
            i, item = items[rng.randrange(30)]
            allowed = decontaminate.budget(len(decontaminate.normal(item)) - 2, 0.06)
            chars = list(item)
            edits = rng.randint(0, allowed + 3)
            for k in rng.sample(range(len(chars)), min(len(chars), edits)):
                if chars[k] != " ":
                    chars[k] = "z"
            t[len(t) // 2 : len(t) // 2] = ["".join(chars).upper().replace(" ", rng.choice([" ", ",\n", " - "]))]
        docs.append((d, " ".join(t)))
    docs += [(200, None), (201, ""), (202, "...")]

    def least(p, t):
        row = np.zeros(len(t) + 1, int)
        for i, c in enumerate(p, 1):
            new = np.minimum(row[1:] + 1, row[:-1] + np.array([c != d for d in t]))
            new = np.concatenate(([i], new))
            for j in range(1, len(new)):
                new[j] = min(new[j], new[j - 1] + 1)
            row = new
        return row.min()

    matcher = decontaminate.Matcher([(i, n) for i, t in items if (n := decontaminate.normal(t))], 0.06)
    for d, t in docs:
        found = {(h[0], h[1]) for h in matcher.find(decontaminate.normal(t))}
        if d % 3 == 0 and d < 60:
            text = decontaminate.normal(t)
            brute = {(i, int(e)) for (i, item), allowed in zip(matcher.items, matcher.errors, strict=True) if (e := least(item, text)) <= allowed}
            assert found == brute
        want |= {(d, i) for i, _ in found}
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminated(df, bench)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want and len(want) > 25
    kept = decontaminate.decontaminate(df, bench)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert not decontaminate.contaminated(df.limit(0), bench).collect() and not decontaminate.contaminated(df, bench.limit(0)).collect()
    assert decontaminate.decontaminate(df, bench.limit(0)).count() == len(docs)


def test_short_items_match_as_whole_words(spark):
    bench = spark.createDataFrame([(1, "Yes"), (2, "B."), (3, "the quick brown fox jumps"), (4, "so lazy a dog here."), (5, "Paris is nice"), (6, "..."), (7, "esa")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Yes, plan B. is: so lazy a dog here"), (2, "well, The quick-brown fox jumps"), (3, "I say: PARIS, is nice!"), (4, "yesa paris is nicer, Paris is")], "doc_id long, text string")
    found = lambda **o: sorted((r["doc_id"], r["item_id"], r["distance"], r["end"]) for r in decontaminate.contaminated(docs, bench, **o).collect())
    assert [r[:3] for r in found()] == [(1, 1, 0), (1, 2, 0), (1, 4, 0), (2, 3, 0), (3, 5, 0)]
    assert [r[3] for r in found()] == [len(" yes "), len(" yes plan b "), len(" yes plan b is so lazy a dog here "), len(" well the quick brown fox jumps "), len(" i say paris is nice ")]
    assert [r[:2] for r in found(least=18)] == [(1, 4), (2, 3)]
    assert sorted(r["doc_id"] for r in decontaminate.decontaminate(docs, bench).collect()) == [4]
    assert sorted(r["doc_id"] for r in decontaminate.decontaminate(docs, bench, least=18).collect()) == [3, 4]


def test_benchmark_passages_of_the_table(spark):
    docs, bench = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark"))
    items = [(r["item_id"], decontaminate.normal(r["text"])) for r in bench.collect()]
    want = {(r["doc_id"], i) for r in docs.collect() for i, n in items if n in decontaminate.normal(r["text"])}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()}
    assert want and want <= got


PAGES = {
    "<html><head><title>t</title><style>p{}</style></head><body><header>Site</header><div id=menu><a>Home</a></div><main><div class='post'><h1>T &amp; x</h1><p>One<b>two</b> three&nbsp;\n four"
    "<aside>side</aside><form>q<input></form><div class='cookie-notice'>We use cookies</div><p>Five<section id=comments><p>nice!</section></div></main><footer>f</footer>": "T & x Onetwo three four Five",
    "<p>a<p>b <script>if(a<b){'</p>'}</script>c": "a b c",
    "": "",
    None: "",
    "plain &lt;b&gt; &#233; text": "plain <b> é text",
    "<article class='article'><header><h1>Title</h1></header><p>x<!-- c -->y<br>z</article><article class='comment'><p>c</article>": "Title xy z",
    "<div class='content'>abc<div class=ad>zzz</div>def</div>tail": "abc def",
    "<article>a</article><div class='ad'>q": "a",
    "<nav>only menus</nav><footer>and feet</footer>": "",
    "<article>unclosed <p>text <a b='": "unclosed text",
}


def test_pages(spark):
    df = spark.createDataFrame([(i, f"http://h{i}.org/a", h, "x") for i, h in enumerate(PAGES)], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in page_text.extract_text(df).collect()}
    assert [got[i]["text"] for i in range(len(PAGES))] == list(PAGES.values())
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert not page_text.extract_text(df.limit(0)).collect()


def test_repeats_of_a_host_go(spark):
    rng = random.Random(3)
    foot = "about us contact imprint privacy terms of use all rights reserved by the makers"
    own = [" ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=40)) for _ in range(40)]
    df = spark.createDataFrame([(i, "http://one.org/p", f"<div>{foot}</div><div>{t}</div><div>{foot}</div>") for i, t in enumerate(own)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in page_text.extract_text(df, group=16).collect()}
    assert all(got[i] == t for i, t in enumerate(own))
    copies = df.withColumn("html", F.lit(f"<article><p>{foot}</article>"))
    assert {r["text"] for r in page_text.extract_text(copies).collect()} == {foot}


def plain_cover(pages, depth, enough):
    runs = {}
    for p, t in enumerate(pages):
        for i in range(len(t) - depth + 1):
            runs.setdefault(tuple(t[i : i + depth]), set()).add(p)
    return [[any(len(runs[tuple(t[i : i + depth])]) >= enough for i in range(max(0, k - depth + 1), min(k, len(t) - depth) + 1)) for k in range(len(t))] for t in pages]


def test_covered_is_brute_force():
    rng = random.Random(4)
    for _ in range(60):
        pages = [rng.choices("ab", k=rng.randint(0, 14)) if rng.random() < 0.5 else rng.choices("abcd", k=rng.randint(0, 14)) for _ in range(rng.randint(1, 6))]
        depth, least = rng.randint(1, 6), rng.randint(2, 3)
        got = page_text.covered(page_text.repeats(pages, depth), depth, least)
        assert [g.tolist() for g in got] == plain_cover(pages, depth, least)


def plain_text(pages):
    """The texts of a host's pages by nested loops over their blocks."""
    kinds = list(dict.fromkeys(map(tuple, pages)))
    flat = [[w for _, t in p for w in t.split(" ")] for p in kinds]
    by = {x: plain_cover(flat, 8, x) for x in {max(a, b * len(kinds)) for a, b in ((2, 0.05), (4, 0.3), (20, 0.7))}}
    texts = {}
    for k, page in enumerate(kinds):
        best = max((r for r, _ in page if r != page_text.OUT), default=0)
        for outside in ((2, 0.05), (4, 0.3), None):
            kept, at = [], 0
            for role, text in page:
                ws, own = text.split(" "), None
                if outside:
                    least, share = (20, 0.7) if role == page_text.ARTICLE else (4, 0.3) if role == page_text.MAIN else outside
                    own = by[max(least, share * len(kinds))][k][at : at + len(ws)]
                at += len(ws)
                if role == page_text.OUT or role < best:
                    continue
                runs = re.findall("1+|0+", "".join("01"[c] for c in own)) if own else ["0" * len(ws)]
                i = 0
                for run in runs:
                    if run[0] == "0" or len(run) < min(8, len(ws)):
                        kept += ws[i : i + len(run)]
                    i += len(run)
            if kept:
                break
        texts[page] = " ".join(kept)
    return [texts[tuple(p)] for p in pages]


def test_query_is_brute_force(spark):
    """Pages of the table without their article's own element, and some made ones with menus in plain blocks."""
    rng = random.Random(18)
    menu = " ".join(f"menu{i}" for i in range(14))
    said = " ".join(f"said{i}" for i in range(30))
    rows = [(r["page_id"], r["url"], r["html"].replace("<article>", "<div>").replace("</article>", "</div>")) for r in spark.read.parquet(f"{DATA}/pages.parquet").limit(300).collect()]
    for i in range(60):
        own = " ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(0, 60)))
        body = f"<div>{menu}</div><p>{own}</p>" + (f"<p>{said}" if i % 7 == 0 else "") + f"<div>{menu[::-1]} {i % 5}</div>"
        rows += [(10_000 + i, f"http://made{i % 2}.org/{i}", f"<main>{body}</main>" if i % 3 == 0 else body)] * (1 + (i % 11 == 0))
    got = sorted((r["page_id"], r["text"]) for r in page_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    hosts = {}
    for i, url, h in rows:
        hosts.setdefault(re.match(r"(?:[^:]*://([^/?#]*))?", url or "")[1], []).append((i, page_text.blocks(h or "")))
    want = sorted((i, t) for own in hosts.values() for (i, _), t in zip(own, plain_text([b for _, b in own]), strict=True))
    assert got == want


def test_groups_of_a_host_count_as_one(spark):
    """Runs around the shares that matter, on the host's pages but not on each group's; copies of pages lie in other tasks."""
    rng = random.Random(20)
    menus = [(" ".join(f"m{k}x{i}" for i in range(12)), share) for k, share in enumerate((0.9, 0.72, 0.35, 0.28, 0.08, 0.055, 0.045, 0.02))]
    rows = []
    for i in range(240):
        body = "".join(f"<div>{m}</div>" for m, share in menus if rng.random() < share) + f"<p>{' '.join(rng.choices('abcdefghijklm', k=rng.randint(0, 20)))}</p>"
        rows += [(i, f"http://made{i % 12 == 0:d}.org/{i}", (f"<article>{body}</article>", f"<main>{body}</main>", body)[i % 3])] * (1 + i % 40 if i % 8 == 0 else 1)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    hosts = {}
    for i, url, h in rows:
        hosts.setdefault(url.split("/")[2], []).append((i, page_text.blocks(h)))
    want = sorted((i, t) for own in hosts.values() for (i, _), t in zip(own, plain_text([b for _, b in own]), strict=True))
    assert sorted((r["page_id"], r["text"]) for r in page_text.extract_text(df, group=24).collect()) == want


def test_copies_of_an_article_lose_the_menus(spark):
    rng = random.Random(19)
    menu = " ".join(f"menu{i}" for i in range(12))
    own = [" ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=40)) for _ in range(30)]
    pages = [(i, "http://one.org/p", f"<div>{menu}</div><div>{t}</div>") for i, t in enumerate(own)]
    pages += [(100 + i, "http://one.org/q", p[2]) for i, p in enumerate(pages[:10])] + [(200, "http://one.org/r", pages[0][2] + f"<p>{own[1]}")]
    got = {r["page_id"]: r["text"] for r in page_text.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(got[i] == t for i, t in enumerate(own)) and all(got[100 + i] == own[i] for i in range(10)) and got[200] == f"{own[0]} {own[1]}"


def test_rows_repeated_beyond_a_group(spark):
    rows = [(1, "http://a.org/x", "<div>one and the same page of a few words</div>")] * 50 + [(None, None, None)] * 40 + [(2, "http://a.org/y", "<div>two</div>")]
    got = page_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string"), group=8).collect()
    assert sorted((r["page_id"] or 0, r["text"]) for r in got) == sorted([(1, "one and the same page of a few words")] * 50 + [(0, "")] * 40 + [(2, "two")])


def test_broken_markup_takes_linear_time():
    import time

    cases = {
        "quotes": "<p>" + '<a href="x ' * 200_000, "odd": "<p>" + "<a b=\"'> " * 200_000, "noscript": "<p>x" + "<noscript>" * 200_000, "deep": "<div>" * 200_000 + "</span>" * 200_000, "less": "<" * 2_000_000, "comments": "<!--" * 400_000,
        "tags": "<a " * 500_000, "cdata": "<![CDATA[" * 200_000, "close": "</div" * 300_000, "mixed": ("<p title='" + '<b c="') * 100_000,
    }
    for name, page in cases.items():
        began = time.process_time()
        page_text.blocks(page)
        assert time.process_time() - began < 8, name


def test_names_count_whole(spark):
    pages = {
        '<div id="social-sciences"><p>kept one</div>': "kept one", '<div class="reader-content"><p>kept two</div>': "kept two", '<article><section aria-label="Share price analysis">kept three</section></article>': "kept three",
        '<div class="cookie-notice-box">no</div><p>yes': "yes", '<p>yes<div class="postComments">no</div>': "yes", '<article>a<div class="share-buttons">no</div>b</article>': "a b", "<p>x<script>if (a<b) c=\"<a '</script>y</p>": "xy",
        "<article>a<script>var s = '<div class=\"q'</script><p>b</article>": "a b",
    }
    for page, want in pages.items():
        assert page_text.choose([page_text.blocks(page)])[0] == want, page


def test_article_of_the_tables_pages(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in page_text.extract_text(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        import html

        assert got[r["page_id"]] == " ".join(html.unescape(re.sub(r"<[^>]*>?", " ", inner)).split())


def judged(url):
    at = (url or "").find("://")
    rest = url[at + 3 :] if url and at >= 0 else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for verdict, name in (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")):
        h, p = name.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(name) > len(best[1])):
            best = (verdict, name)
    return host, path, best[1] if best else None, best[0] if best else None


URLS = [
    None, "", "x", "http://", "HTTP://A.Example.NET/en/1", "http://example.net/en", "http://example.net/en/", "http://xexample.net/en/", "http://net/", "http://net", "http://a.net?x=/", "http://a.net/?x", "http://b.org/fr/",
    "http://b.org/fra/", "http://example.com/de/x#y", "http://EXAMPLE.com/DE/x", "http://example.com/de", "ftp://u@example.com:80/de/", "a://b://net/", "http://casino-win.example.com/", "http://x.org/login?a", "http://x.org/" + "a" * 50_000, "http://é.net/en/",
    "http://x.org/blogin", "http://example.net/en/casino", "http://spam-farm.example.org/fr/1",
]


def test_urls(spark):
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in url_rules.judge_urls(df).collect()}
    for i, u in enumerate(URLS):
        host, path, rule, verdict = judged(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule), u
        assert got[i]["verdict"] == verdict if rule else got[i]["verdict"] in ("allow", "block")
    by = {URLS[i]: (r["verdict"], r["pattern"]) for i, r in got.items()}
    assert by["http://casino-win.example.com/"] == ("block", "any:casino") and by["http://x.org/login?a"][0] == "block" and by["http://x.org/blogin"][0] == "allow"
    assert by["http://example.net/en/casino"] == ("allow", None)
    assert not url_rules.judge_urls(df.limit(0)).collect()
    assert {r["verdict"] for r in url_rules.judge_urls(df, site_rules=(), page_rules=()).collect()} == {"allow"}


def test_every_rule_is_fetched_where_it_fits(spark):
    """The index may only save work: with it and without, the same rules fit."""
    rng = random.Random(6)
    hosts = ["a.net", "example.net", "b.example.com", "c.org", "ads.x.com", "cheap-pills.com"]
    urls = [f"http://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'fr', 'cart', 'x'])}/{rng.choice(['', 'login', 'casino', '1-viagra.html'])}" for _ in range(200)]
    got = url_rules.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()
    for r in got:
        key = r["host"] + r["path"]
        fits = [x for x in url_rules.PAGE_RULES if re.search(x.pattern, key)]
        if r["rule"] is None:
            assert r["pattern"] == (fits[0].name if fits else None)


def test_forest_on_held_out_findings(spark):
    found = secret_scan.fixture_findings(spark)
    train, test = (found.where(F.crc32("value") % 4 != 0), found.where(F.crc32("value") % 4 == 0))
    model = secret_scan.fit_forest(train)
    of = secret_scan.features(F.col("value"), F.col("before"), F.col("word"), F.col("path"))
    from pyspark.ml.feature import VectorAssembler

    seen = VectorAssembler(inputCols=list(secret_scan.NAMES), outputCol="features").transform(test.select("label", *(of[n].alias(n) for n in secret_scan.NAMES)))
    assert model.transform(seen).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0] > 0.95


def test_secrets(spark):
    token = "11acdfb36bb72224148e6160f674b4be45601bff"
    rows = [(1, f'of token = "{token}" erble', "src1", 0.5), (2, f"see commit {token} of yesterday", "docs/example.md", None), (3, None, None, None), (4, "", "", None), (5, "password: hunter2hunter2", ".env", None), (6, "word " * 40_000, "", None), (7, f"x\ntoken = \"{token}\"\n", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, score double")
    got = {(r["doc_id"], r["value"]): r for r in secret_scan.scan_secrets(df).collect()}
    assert got[(1, token)]["secret"] and got[(7, token)]["secret"] and not got[(2, token)]["secret"]
    assert (5, "hunter2hunter2") in got and not {3, 4, 6} & {d for d, _ in got}
    assert not secret_scan.scan_secrets(df.limit(0)).collect()
    plan = secret_scan.scan_secrets(df)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_secrets_of_the_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = {(r["doc_id"], v) for r in docs.collect() for v in re.findall(r'token = "([0-9a-f]{40})"', r["text"])}
    got = {(r["doc_id"], r["value"]) for r in secret_scan.scan_secrets(docs).where("secret").collect()}
    assert want and want <= got and len(got) <= 1.2 * len(want)


