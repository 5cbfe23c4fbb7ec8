"""Secret scan with a random forest that removes false positives, in DataFrame operations only.

Words that may be credentials are found by their characters or by the word before. The forest
judges each by its length, changes between kinds of character, share covered by dictionary words, path
and neighbouring words. It is fitted on labelled findings; fixture_findings makes some from
formats alone, where none have been collected.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words that speak for a credential, for another kind of code, for an example; common parts of names.
CREDENTIAL = "api_?key|apikey|access_?key|auth|bearer|credential|passphrase|passwd|password|private_?key|pwd|secret|token"
OTHER_CODE = "checksum|commit|digest|etag|fingerprint|guid|hash|isbn|md5|rev|revision|serial|sha|sha1|sha256|uuid|version|build"
PLACEHOLDER = "changeme|demo|dummy|example|fake|foo|placeholder|redacted|replace|sample|test|todo|xxx|your"
DICTIONARY = (
    "access account address admin alpha and application archive array author backup base beta block bucket build byte cache call change check class click client cloud code color column "
    "commit config connect content control count create data date default delete demo device document domain download element email error event example export file filter first "
    "folder font for form format from function global graph green group handler hash head header height home host image import index info input insert inter item java join json key label last "
    "layout length level library line link list load local log login main manager map master member memory menu message method model module name net network new node number object "
    "option order output package page param parent pass password path plugin point port position post print process product profile project property proxy public query queue "
    "read record release remote replace report request reset resource response result return root router row sample save scale schema script search secret section select send "
    "server service session set size socket sort source space stack start state static status step stop storage store stream string style submit support sync system table tag target "
    "task temp template test text the thread time title token tool total trace tree trigger type update upload url user utils value vector version view web widget width window with word work write"
).split()

#: A word is looked at when it has a run of this kind with a letter and a digit in it, or follows a credential's name.
RUN = r"[A-Za-z0-9+/=_\-]{16,}"
#: A run with a letter and a digit in it.
MIXED = rf"(?=[A-Za-z+/=_\-]*[0-9])(?=[0-9+/=_\-]*[A-Za-z]){RUN}"
#: The same without names and = ahead: that sign is a value's own only at its end.
PART = r"[A-Za-z0-9+/_\-]{16,}(?:={1,2}(?![A-Za-z0-9+/=_\-]))?"
NAMES = ("length", "digits", "uppers", "lowers", "others", "changes", "distinct", "hex", "dictionary", "vowels", "prefix", "slashes", "path_example", "path_code", "credential", "other_code", "placeholder", "assigned", "quoted")


def features(value: Column, before: Column, word: Column, path: Column) -> dict[str, Column]:
    """What the forest looks at: value is the run in word, before the words ahead, path where the text is from."""
    size = F.greatest(F.length(value), F.lit(1)).cast("double")
    count = lambda of, pattern: F.coalesce(F.regexp_count(of, F.lit(pattern)), F.lit(0)).cast("double")
    says = lambda of, pattern: F.coalesce(of.rlike(pattern), F.lit(False)).cast("double")
    context = F.concat_ws(" ", before, F.regexp_extract(word, r"^([^=:]*)[=:]", 1))
    near = F.concat_ws(" ", context, value)
    known = "|".join(sorted((w for w in DICTIONARY if len(w) > 2), key=lambda w: (-len(w), w)))
    return {
        "length": size,
        "digits": count(value, "[0-9]") / size,
        "uppers": count(value, "[A-Z]") / size,
        "lowers": count(value, "[a-z]") / size,
        "others": count(value, "[^A-Za-z0-9]") / size,
        "changes": count(value, "(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])") / size,
        "distinct": F.size(F.array_distinct(F.split(value, ""))).cast("double") / size,
        "hex": says(value, "^[0-9a-fA-F]+$"),
        "dictionary": (size - F.length(F.regexp_replace(F.lower(value), known, "")).cast("double")) / size,
        "vowels": count(value, "[aeiouAEIOU]") / size,
        "prefix": says(value, "^(?:AKIA|ASIA|AIza|gh[pousr]_|glpat-|sk-|sk_|pk_|rk_|xox[abp]-|eyJ|npm_|SG)"),
        "slashes": count(word, "[/.]"),
        "path_example": says(path, r"(?i)test|example|sample|doc|mock|fixture|spec"),
        "path_code": says(path, r"(?i)\.env|config|settings|deploy|\.ya?ml|\.json|\.py|\.js|\.sh|secret"),
        "credential": says(context, rf"(?i)(?:^|[^a-z])(?:{CREDENTIAL})(?:[^a-z]|$)"),
        "other_code": says(context, rf"(?i)(?:^|[^a-z])(?:{OTHER_CODE})(?:[^a-z]|$)"),
        "placeholder": says(near, rf"(?i){PLACEHOLDER}"),
        "assigned": says(F.concat_ws(" ", before, word), r"(?:[=:]|=>)\s*[\"'`]?[A-Za-z0-9+/=_\-]{8,}[\"'`,;.]*$"),
        "quoted": says(word, "[\"'`]"),
    }


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """(doc_id, word_no, word, value, before, path) of each run, or value given to a name, that may be a credential.

    word is the value's own part of the word between white space, where that has several.
    """
    named = rf"(?i)(?:{CREDENTIAL})[\"']?\s*(?:[=:]|=>|\s)\s*\S"
    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"), F.coalesce(path, F.lit("")).alias("path"))
    rows = rows.where(F.col("t").rlike(MIXED) | F.col("t").rlike(named))
    words = rows.withColumn("w", F.split("t", r"\s+")).drop("t")
    word = lambda i: F.element_at("w", i + 1)
    follows = lambda i: (i > 0) & (F.length(word(i)) >= 8) & F.concat_ws(" ", F.slice("w", F.greatest(i - 1, F.lit(1)), F.when(i > 1, 2).otherwise(1))).rlike(rf"(?i)(?:{CREDENTIAL})[\"']?(?:\s*(?:[=:]|=>))+$")
    inline = lambda w: w.rlike(rf"(?i)(?:{CREDENTIAL})[\"']?(?:[=:]|=>)[\"']?[^\s\"']{{8,}}")
    places = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: word(i).rlike(MIXED) | inline(word(i)) | follows(i))
    found = words.withColumn("word_no", F.explode(places)).select(
        "doc_id", "word_no", word(F.col("word_no")).alias("word"),
        F.when(F.col("word_no") > 0, F.concat_ws(" ", F.slice("w", F.greatest(F.col("word_no") - 3, F.lit(0)) + 1, F.least(F.col("word_no"), F.lit(4)).cast("int")))).otherwise("").alias("before"), "path",
    )
    mixed = lambda x: x.rlike("[0-9]") & x.rlike("[A-Za-z]")
    runs = F.filter(F.regexp_extract_all("word", F.lit(PART), F.lit(0)), mixed)
    # what is given to credentials' names within the word, and the word's end, where these have no run
    given = F.regexp_extract_all("word", F.lit(rf"(?i)(?:{CREDENTIAL})[\"']?(?:[=:]|=>)[\"']?([^\s\"'`=:,;&]{{8,}})"), F.lit(1))
    last = F.regexp_extract("word", r"([^\s\"'`=:]+)[\"'`,;.]*$", 1)
    values = F.concat(runs, F.filter(given, lambda x: ~F.exists(runs, lambda r: F.contains(r, x) | F.contains(x, r))))
    whole = F.filter(F.regexp_extract_all("word", F.lit(RUN), F.lit(0)), lambda x: mixed(x) & ~F.exists(values, lambda r: F.contains(x, r) | F.contains(r, x)))
    values = F.array_distinct(F.concat(values, whole))
    values = F.when(F.size(values) > 0, values).otherwise(F.array(F.when(F.regexp_extract("word", RUN, 0) != "", F.regexp_extract("word", RUN, 0)).otherwise(last)))
    each = found.withColumn("value", F.explode(values)).where(F.length("value") >= 8)
    # a value's own part of the word: from the end of the pair before to its end, with a closing quote
    start = F.instr(F.col("word"), F.col("value"))
    ahead = F.substring(F.col("word"), F.lit(1), start - 1)
    own = F.regexp_extract(ahead, r"([^,;&{}\[\]()?]*)$", 1)
    closing = F.regexp_extract(F.substring(F.col("word"), start + F.length("value"), F.length("word")), r"^([\"'`]?)", 1)
    alone = F.size(F.regexp_extract_all("word", F.lit(RUN), F.lit(0))) + F.size(F.regexp_extract_all("word", F.lit(r"[^=:][=:][^=:]"), F.lit(0))) <= 2
    return each.withColumn("word", F.when(alone, F.col("word")).otherwise(F.concat(own, F.col("value"), closing)))


def fixture_findings(spark: SparkSession, rows: int = 6000) -> DataFrame:
    """(value, before, word, path, label): findings with label 1 for credentials, from a fixed hash.

    Credentials are random codes of usual alphabets, mostly assigned to a credential's name; the
    rest are digests, UUIDs, names of things, encoded words, placeholders and addresses, some of them assigned as well.
    """
    h = lambda k: F.xxhash64("id", F.lit(k))
    pick = lambda k, *of: F.element_at(F.array(*(x if isinstance(x, Column) else F.lit(x) for x in of)), (F.pmod(h(k), F.lit(len(of))) + 1).cast("int"))
    hexes = lambda k: F.sha2(h(k).cast("string"), 256)
    code = lambda k: F.regexp_replace(F.base64(F.unhex(hexes(k))), "[+/=]", "")
    names = F.array(*map(F.lit, DICTIONARY))
    term = lambda k: F.element_at(names, (F.pmod(h(k), F.lit(len(DICTIONARY))) + 1).cast("int"))
    letters = lambda k, n: F.translate(F.substring(hexes(k), 1, n), "0123456789abcdef", "ghijklmnopqrstuv")
    some = lambda text, k: F.substring(text, F.lit(1), F.lit(20) + F.pmod(h(k), F.lit(24)).cast("int"))
    secret = pick(
        1, F.substring(hexes(2), 1, 32), F.substring(hexes(2), 1, 40), F.substring(hexes(2), 1, 40), hexes(2), F.upper(F.substring(hexes(2), 1, 32)), some(code(2), 13), some(code(2), 13), code(2),
        F.concat(F.lit("ghp_"), F.substring(code(2), 1, 36)), F.concat(F.lit("AKIA"), F.upper(F.substring(code(2), 1, 16))), F.concat(F.lit("sk_live_"), F.substring(code(2), 1, 24)),
        # the like of unknown makers
        F.concat(letters(14, 3), pick(15, "_", "-"), some(code(2), 13)), F.concat(letters(14, 2), F.lit("_"), letters(16, 4), F.lit("_"), some(code(2), 13)), F.upper(F.concat(letters(14, 4), F.substring(code(2), 1, 16))), F.upper(some(code(2), 13)),
    )
    uuid = F.concat_ws("-", F.substring(hexes(3), 1, 8), F.substring(hexes(3), 9, 4), F.substring(hexes(3), 13, 4), F.substring(hexes(3), 17, 4), F.substring(hexes(3), 21, 12))
    named = F.concat_ws("_", term(4), term(5), term(6), F.pmod(h(7), F.lit(100)).cast("string"))
    other = pick(
        1, F.substring(hexes(2), 1, 40), hexes(2), uuid, uuid, named, F.concat(F.initcap(term(4)), F.initcap(term(5)), F.initcap(term(6)), F.pmod(h(7), F.lit(10)).cast("string")), F.base64(F.concat_ws(" ", term(4), term(5), term(6)).cast("binary")),
        F.concat(F.lit("your_"), term(4), F.lit("_key_here_123")), F.concat(F.lit("EXAMPLE"), F.upper(F.substring(code(2), 1, 14))), F.concat(F.lit("xxxxxxxxxxxxxxxx"), F.pmod(h(7), F.lit(100)).cast("string")),
        F.concat(F.lit("/"), term(4), F.lit("/"), term(5), F.lit("/"), named), F.concat(term(4), F.lit("-"), term(5), F.lit("-2024-"), F.pmod(h(7), F.lit(99)).cast("string"), F.lit("-"), term(6)),
    )
    of_hash = F.pmod(h(1), F.lit(12)) < 2
    base = spark.range(0, rows, 1, 2).withColumn("label", (F.col("id") % 2).cast("int"))
    value = F.when(F.col("label") == 1, secret).otherwise(other)
    lead = F.concat_ws(" ", term(8), term(9), F.when(
        F.col("label") == 1, pick(10, "token =", "api_key =", "secret:", "password =", "auth token =", "access_key:", "token =", "bearer", "with key")
    ).when(of_hash, pick(10, "commit", "sha256", "checksum:", "revision", "digest =", "hash =", "md5:")).otherwise(pick(10, "see", "id =", "build", "name =", "file", "version", "token =", "uuid =", "link:")))
    quoted = F.pmod(h(11), F.lit(2)) == 0
    return base.select(
        value.alias("value"), lead.alias("before"), F.when(quoted, F.concat(F.lit('"'), value, F.lit('"'))).otherwise(value).alias("word"),
        F.when(F.col("label") == 1, pick(12, "src0", "config/app.yml", ".env", "deploy.sh", "src7", "")).otherwise(pick(12, "src0", "docs/example.md", "tests/fixture.json", "src7", "lib/main.py", "")).alias("path"), "label",
    )


def fit_forest(findings: DataFrame, trees: int = 24, depth: int = 7, seed: int = 5) -> RandomForestClassificationModel:
    """A random forest for label 1 from (value, before, word, path, label); other labels are left out."""
    of = features(F.col("value"), F.col("before"), F.col("word"), F.coalesce(F.col("path"), F.lit("")))
    rows = findings.where(F.col("label").isin(0, 1) & F.col("value").isNotNull()).select(F.col("label").cast("double").alias("label"), *(of[n].alias(n) for n in NAMES))
    assembled = VectorAssembler(inputCols=list(NAMES), outputCol="features", handleInvalid="keep").transform(rows)
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=48, seed=seed, minInstancesPerNode=3).fit(assembled.select("label", "features"))


def scan_secrets(docs: DataFrame, findings: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", threshold: float = 0.5) -> DataFrame:
    """One row per candidate: (doc_id, word_no, value, score, secret).

    word_no counts the text's words between white space from 0; a word with several runs has a row for each different one. score is
    the forest's probability that the value is a credential, secret whether that reaches the threshold: rows without are the removed false positives.

    Null and empty texts have no candidates; texts are read whole at any length. A null path is an empty
    one. Repeated rows are reported each; an empty table gives no rows; other columns are ignored.
    """
    model = fit_forest(fixture_findings(docs.sparkSession) if findings is None else findings)
    found = candidates(docs, id_col, text_col, path_col)
    of = features(F.col("value"), F.col("before"), F.col("word"), F.col("path"))
    seen = found.select("doc_id", "word_no", "value", *(of[n].alias(n) for n in NAMES))
    judged = model.transform(VectorAssembler(inputCols=list(NAMES), outputCol="features", handleInvalid="keep").transform(seen))
    score = vector_to_array("probability")[1]
    return judged.select("doc_id", "word_no", "value", score.alias("score")).withColumn("secret", F.col("score") >= threshold)
