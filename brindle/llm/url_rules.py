"""URL filter: pattern rules fetched by their rarest literal token.

Every rule is a regular expression over host and path, with the literal tokens that any URL it
matches must hold as whole tokens. Each rule is filed under the one of them that is rarest in
the URLs at hand, those without one under the empty token that every URL has. The index is a table of a row for each
rule, sent to all executors: a URL's tokens fetch rules by a hash join, only those run their expression, and what
fits comes back to the URLs by host and path.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The index goes to all executors; beyond this many rules it is too large for that.
MAX_RULES = 200_000


@dataclass(frozen=True)
class Rule:
    """name, verdict, regular expression over host + path, tokens that a match must hold."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    #: Site rules go by the longest name; the others count only where no site rule fits.
    site: bool = False


def _quoted(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9_/\-])", r"\\\1", text)


def site_rule(verdict: str, name: str) -> Rule:
    """A rule like `example.net/en/` for a host with its subdomains and the paths that start so."""
    host, slash, path = name.partition("/")
    if not host or not slash:
        raise ValueError(f"{name!r} isn't a host and a path")
    whole = re.findall(r"[a-z0-9]+", host.lower())
    # the path's last token may go on in a URL, unless something else ends it in the rule
    whole += re.findall(r"[a-z0-9]+(?=[^a-z0-9])", f"/{path}".lower())
    return Rule(name, verdict, rf"^(?:[^/]*\.)?{_quoted(host.lower())}/{_quoted(path)}", tuple(whole), True)


def token_rule(verdict: str, token: str, where: str = "any") -> Rule:
    """A rule for a whole token of the host, the path, or either."""
    lead, tail = {"any": (r"(?:^|.*[^a-z0-9])", r"(?:[^a-z0-9]|$)"), "host": (r"^(?:[^/]*[^a-z0-9/])?", r"(?:[^a-z0-9]|$)"), "path": (r"^[^/]*/(?:.*[^a-z0-9])?", r"(?:[^a-z0-9]|$)")}[where]
    return Rule(f"{where}:{token}", verdict, f"(?is){lead}{token}{tail}", (token.lower(),))


def shape_rule(verdict: str, name: str, pattern: str, *tokens: str) -> Rule:
    """A rule for the shape of host + path; tokens are those that all its matches hold whole."""
    return Rule(name, verdict, pattern, tokens)


SITE_RULES = (
    site_rule("block", "net/"),
    site_rule("allow", "example.net/en/"),
    site_rule("block", "example.com/de/"),
    site_rule("allow", "org/fr/"),
)
#: Pages without an article to read, and trades that a corpus is better without.
PAGE_RULES = tuple(
    [token_rule("block", t, "path") for t in ("login", "signin", "signup", "logout", "cart", "checkout", "captcha", "unsubscribe", "cgi")]
    + [token_rule("block", t, "host") for t in ("adserver", "ads", "adult", "bets", "doubleclick", "pills", "spam", "track", "tracker")]
    + [token_rule("block", t) for t in ("casino", "porn", "viagra", "warez", "xxx")]
    # lists, searches and machine views of pages that are elsewhere as pages
    + [shape_rule("block", f"list:{t}", rf"(?i)^[^/]*/(?:.*/)?{t}/[^/]+(?:/page/[0-9]+)?/?$", t) for t in ("tag", "tags", "topic", "topics", "label", "labels", "author", "authors", "archive", "archives")]
    + [shape_rule("block", f"view:{t}", rf"(?i)^[^/]*/(?:.*/)?{t}/?$", t) for t in ("feed", "rss", "atom", "print", "amp", "sitemap", "search", "trackback", "register", "account", "basket", "wishlist", "contact", "imprint", "privacy", "terms")]
    + [shape_rule("block", f"file:{t}", rf"(?i)^[^/]+/.*[.]{t}$", t) for t in ("jpg", "jpeg", "png", "gif", "webp", "svg", "ico", "css", "js", "json", "xml", "zip", "gz", "rar", "exe", "msi", "dmg", "apk", "mp3", "mp4", "avi", "mov", "woff")]
    + [
        shape_rule("block", "pages:number", r"(?i)^[^/]*/(?:.*/)?page/[0-9]+/?$", "page"),
        shape_rule("block", "calendar:day", r"(?i)/(?:.*/)?calendar/[0-9]{4}[-/][0-9]{1,2}", "calendar"),
        shape_rule("block", "session:java", r"(?i);jsessionid=", "jsessionid"),
        shape_rule("block", "session:php", r"(?i)/phpsessid[=/_-][0-9a-z]{8,}", "phpsessid"),
        shape_rule("block", "wordpress:admin", r"(?i)/wp-admin(?:/|$)", "wp", "admin"),
        shape_rule("block", "wordpress:login", r"(?i)/wp-login[.]php$", "wp", "login", "php"),
        shape_rule("block", "wordpress:files", r"(?i)/wp-(?:content|includes)/", "wp"),
        shape_rule("block", "wiki:edit", r"(?i)/special:[a-z]+", "special"),
        shape_rule("block", "forum:reply", r"(?i)/(?:posting|newreply)[.]php$", "php"),
        # hosts by their shape alone
        shape_rule("block", "host:number", r"^[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}(?::[0-9]+)?(?:/|$)"),
        shape_rule("block", "host:hyphens", r"^[^/.]+-[^/.]+-[^/.]+-[^/.]+-[^/.-]+[.]"),
        shape_rule("block", "host:advert", r"^(?:ad|ads|adserv|banner|banners|click|clicks|pixel|track)[0-9]+[.]"),
    ]
)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a URL; both empty for null or without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _tokens(key: Column) -> Column:
    """The distinct runs of ASCII letters and digits, lower-cased, and the empty token."""
    return F.array_distinct(F.concat(F.array(F.lit("")), F.split(F.regexp_replace(F.translate(key, _UPPER, _LOWER), "[^a-z0-9]+", " "), " ")))


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", site_rules: tuple[Rule, ...] = SITE_RULES, page_rules: tuple[Rule, ...] = PAGE_RULES, default: str = "allow") -> DataFrame:
    """One row per row of pages: (page_id, host, path, rule, verdict, pattern).

    rule: the longest site rule that fits, else null; verdict: that rule's, else that of the first page
    rule that fits, named in pattern, else the default.

    Null, empty and malformed URLs have an empty host and path, fit no rule that asks for a token
    and get the default; long URLs are read whole; repeated rows are returned each; an empty
    table gives no rows; other columns are ignored. Of equally long site rules the first listed wins.
    """
    rules = [*site_rules, *page_rules]
    if len(rules) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    spark = pages.sparkSession
    host, path = url_parts(F.col("__url"))
    parts = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("__url")).select("page_id", host.alias("host"), path.alias("path"))
    tokens = parts.select("host", "path", F.explode(_tokens(F.concat("host", "path"))).alias("token"))

    table = spark.createDataFrame([(i, r.name, r.verdict, r.pattern, r.site, len(r.name) if r.site else 0) for i, r in enumerate(rules)], "i long, name string, verdict string, pattern string, site boolean, rank long")
    asked = spark.createDataFrame([(i, t) for i, r in enumerate(rules) for t in r.tokens or ("",)], "i long, token string")
    held = tokens.join(F.broadcast(asked.select("token").distinct()), "token").groupBy("token").count()
    filed = asked.join(held, "token", "left").groupBy("i").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "token"))["token"].alias("token"))
    index = table.join(filed, "i")  # a row for each of at most MAX_RULES rules

    fits = tokens.join(F.broadcast(index), "token").where(F.rlike(F.concat("host", "path"), F.col("pattern")))
    best = lambda of: F.max(F.when(of, F.struct("rank", (-F.col("i")).alias("turn"), "name", "verdict")))
    found = fits.groupBy("host", "path").agg(best(F.col("site")).alias("site"), best(~F.col("site")).alias("page"))
    return parts.join(found, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("site.name").alias("rule"), F.coalesce("site.verdict", "page.verdict", F.lit(default)).alias("verdict"), F.when(F.col("site").isNull(), F.col("page.name")).alias("pattern")
    )
