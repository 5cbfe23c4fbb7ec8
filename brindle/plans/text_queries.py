"""Queries over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import first_match, header, replace_rules, replace_rules_in_batches, strip_punctuation, word_count
from ..functions.rules import compounds, read_rules, rewrite
from ..functions.text import GENERAL_RULES
from ..operators import boundaries, filings, sentences, topics
from .registry import Registry, table

REGISTRY = Registry()

_WORDS = "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))"
_COUNTED = f"counted AS (SELECT *, {_WORDS} AS n_words FROM documents WHERE text IS NOT NULL)"
_BY_LANG = "SELECT lang, count(*) AS n, avg(n_words) AS mean_words, stddev_samp(n_words) AS sd_words FROM kept GROUP BY lang"


def _by_lang(docs: DataFrame) -> DataFrame:
    return docs.groupBy("lang").agg(F.count("*").alias("n"), F.avg("n_words").alias("mean_words"), F.stddev_samp("n_words").alias("sd_words"))


@REGISTRY.add(f"WITH {_COUNTED}, big AS (SELECT * FROM counted WHERE n_words >= 250), kept AS (SELECT * FROM big WHERE n_words <= (SELECT quantile_cont(n_words, 0.99) FROM big)) {_BY_LANG}")
def doc_outlier_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_lang(filings.within_quantile(filings.with_words(table(spark, sf_dir, "documents"), least=250), 0.99))


@REGISTRY.add(f"WITH {_COUNTED}, big AS (SELECT * FROM counted WHERE n_words >= 250), kept AS (SELECT * FROM big WHERE abs(n_words - (SELECT avg(n_words) FROM big)) / (SELECT stddev_samp(n_words) FROM big) <= 2.0) {_BY_LANG}")
def doc_outlier_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_lang(filings.within_zscore(filings.with_words(table(spark, sf_dir, "documents"), least=250), 2.0))


@REGISTRY.add(f"WITH {_COUNTED} SELECT count(*) AS n, min(n_words)::DOUBLE AS low, quantile_cont(n_words, 0.25) AS q1, median(n_words) AS median, quantile_cont(n_words, 0.75) AS q3, max(n_words)::DOUBLE AS high FROM counted")
def doc_length_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filings.length_summary(filings.with_words(table(spark, sf_dir, "documents")))


@REGISTRY.add(f"WITH {_COUNTED} SELECT (n_words // 100)::BIGINT AS bucket, count(*) AS n FROM counted GROUP BY 1")
def doc_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filings.histogram(filings.with_words(table(spark, sf_dir, "documents")), "n_words", 100)


@REGISTRY.add(r"SELECT doc_id, trim(regexp_replace(text, '[^\p{L}\p{M}\p{N}_\s]', '', 'g'), ' ') AS cleaned FROM documents")
def doc_clean_punct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", strip_punctuation(F.col("text")).alias("cleaned"))


@REGISTRY.add(
    r"""WITH cut AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?]["'')\]]*)\s+([^\p{Ll}\s])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS s FROM documents),
    listed AS (SELECT doc_id, list_filter(list_transform(s, lambda x: trim(x, ' ')), lambda x: x <> '') AS s FROM cut),
    each AS (SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS pos FROM listed),
    cleaned AS (SELECT doc_id, pos, trim(regexp_replace(trim(regexp_replace(lower(sentence), '\s+', ' ', 'g'), ' '), '[^\p{L}\p{M}\p{N}_\s]', '', 'g'), ' ') AS sentence FROM each),
    counted AS (SELECT *, len(list_filter(regexp_split_to_array(sentence, '\s+'), lambda w: w <> '')) AS n_words FROM cleaned)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos)::INT - 1 AS sentence_id, pos::INT AS pos, sentence, n_words::INT AS n_words FROM counted WHERE n_words > 5 AND n_words < 50"""
)
def doc_sentence_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentences.split_sentences(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return sentences.number_sentences(sentences.clean_sentences(found, rules=())).select("doc_id", "sentence_id", "pos", "sentence", "n_words")


@REGISTRY.add(
    r"""WITH cut AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?]["'')\]]*)\s+([^\p{Ll}\s])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS s FROM documents),
    listed AS (SELECT doc_id, list_filter(list_transform(s, lambda x: trim(x, ' ')), lambda x: x <> '') AS s FROM cut),
    each AS (SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS pos FROM listed),
    replaced AS (SELECT doc_id, pos, trim(regexp_replace(lower(sentence), '\s+', ' ', 'g'), ' ') AS r FROM each)
    SELECT doc_id, pos::INT AS pos, trim(regexp_replace(r, '[^\p{L}\p{M}\p{N}_\s]', '', 'g'), ' ') AS sentence FROM replaced WHERE len(list_filter(regexp_split_to_array(r, '\s+'), lambda w: w <> '')) BETWEEN 6 AND 49"""
)
def doc_sentences_counted_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words are counted before punctuation goes."""
    found = sentences.split_sentences(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return sentences.clean_sentences(found, rules=(), count_before_punctuation=True).select("doc_id", "pos", "sentence")


_WS = r"[ \t\n\x0B\f\r]"


def _core(x: str) -> str:
    return rf"regexp_replace({x}, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}.]+$', '', 'g')"


def _type(x: str) -> str:
    bare = rf"regexp_replace({_core(x)}, '\.+$', '')"
    return rf"CASE WHEN regexp_matches({bare}, '^[0-9][0-9.,/\-]*$') THEN '#' ELSE lower({bare}) END"


def _stopped(x: str) -> str:
    return rf"regexp_matches({_core(x)}, '[^.]\.$')"


def _ratio(both: str, a: str, b: str, n: str) -> str:
    part = lambda k, m, p: f"CASE WHEN {p} > 0 AND {p} < 1 THEN {k} * ln({p}) + ({m} - {k}) * ln(1 - {p}) ELSE 0 END"
    p, p1, p2, rest = f"({b} / {n})", f"({both} / {a})", f"(({b} - {both}) / nullif({n} - {a}, 0))", f"({b} - {both})"
    return f"-2 * ({part(both, a, p)} + {part(rest, f'({n} - {a})', p)} - {part(both, a, p1)} - {part(rest, f'({n} - {a})', p2)})"


_LEARNT = rf"""split AS (SELECT list_filter(regexp_split_to_array(text, '{_WS}+'), lambda x: x <> '') AS w FROM documents),
    spots AS (SELECT w, unnest(range(1, len(w) + 1)) AS i FROM split),
    each AS (SELECT w[i] AS word, CASE WHEN i = 1 THEN '' WHEN right(w[i - 1], 1) IN ('.', '!', '?', '"', chr(39), ')', ']') THEN w[i - 1] END AS ahead FROM spots),
    counts AS (SELECT ahead, word, count(*) AS n FROM each WHERE {_core("word")} <> '' GROUP BY ALL),
    kinds AS (SELECT {_type("word")} AS type, coalesce(sum(n) FILTER ({_stopped("word")}), 0)::BIGINT AS n_stop, coalesce(sum(n) FILTER (NOT {_stopped("word")}), 0)::BIGINT AS n_bare FROM counts GROUP BY 1),
    total AS (SELECT sum(n_stop) AS stops, sum(n_stop + n_bare) AS n FROM kinds),
    scored AS (SELECT type, n_stop, n_bare, len(replace(type, '.', '')) AS k, stops / n AS share FROM kinds, total WHERE n_stop > 0 AND regexp_matches(type, '\p{{L}}')),
    abbreviations AS (SELECT type, n_stop, n_bare, 2 * (n_stop * ln(0.99) + n_bare * ln(0.01) - n_stop * ln(share) - n_bare * ln(1 - share)) * exp(-k) * (len(type) - k + 1) * pow(k, -n_bare) AS score
      FROM scored WHERE score >= {boundaries.ABBREVIATION}),
    pairs AS (SELECT {_type("ahead")} AS type, coalesce(regexp_matches(ahead, '[.!?]["'')\]]*$'), false) AS ends, coalesce({_stopped("ahead")}, false) AS stop, {_type("word")} AS next,
      regexp_matches({_core("word")}, '^\p{{Lu}}') AS upper, regexp_matches({_core("word")}, '^\p{{Ll}}') AS lower, n FROM counts WHERE ahead IS NULL OR ahead <> ''),
    told AS (SELECT *, ends AND stop AND (type IN (SELECT type FROM abbreviations) OR regexp_matches(type, '^\p{{L}}$')) IS TRUE AS short FROM pairs),
    after AS (SELECT next, sum(n) AS n, coalesce(sum(n) FILTER (ends AND NOT short AND type IS DISTINCT FROM '#'), 0) AS n_over, coalesce(sum(n) FILTER (lower), 0) AS n_lower, coalesce(sum(n) FILTER (upper AND NOT ends), 0) AS n_inside FROM told GROUP BY next),
    sums AS (SELECT sum(n) AS everything, sum(n_over) AS overs FROM after),
    openers AS (SELECT next AS type, (n_over / nullif(overs, 0) > n / everything AND overs < everything AND {_ratio("n_over", "overs", "n", "everything")} >= {boundaries.OPENER} AND next <> '#') IS TRUE AS opens, n_lower > 0 AS lower, n_inside > 0 AS inside FROM after, sums),
    both_seen AS (SELECT type, next, sum(n) AS n_both FROM told WHERE short GROUP BY ALL),
    sides AS (SELECT *, (SELECT sum(x.n_both) FROM both_seen x WHERE x.type = b.type) AS n_type FROM both_seen b JOIN after USING (next), sums),
    together AS (SELECT type, next FROM sides WHERE n_both / n_type > n / everything AND n_both > 1 AND n_type < everything AND {_ratio("n_both", "n_type", "n", "everything")} >= {boundaries.TOGETHER})"""


@REGISTRY.add(f"WITH {_LEARNT} SELECT type, n_stop, n_bare, round(score, 6) AS score FROM abbreviations")
def sentence_abbreviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the documents themselves show to be abbreviations."""
    return boundaries.learn(table(spark, sf_dir, "documents")).abbreviations.withColumn("score", F.round("score", 6))


@REGISTRY.add(
    rf"""WITH {_LEARNT},
    cut AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?]["'')\]]*)({_WS}+)([^\p{{Ll}} \t\n\x0B\f\r])', '\1\2' || chr(1) || '\3', 'g'), chr(1)) AS p FROM documents WHERE text IS NOT NULL),
    pieces AS (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM cut),
    edges AS (SELECT doc_id, i, p[i] AS piece, regexp_extract(p[i], '([^ \t\n\x0B\f\r]+){_WS}*$', 1) AS last, regexp_extract(p[i + 1], '^([^ \t\n\x0B\f\r]+)', 1) AS first FROM pieces),
    asked AS (SELECT doc_id, i, piece, {_type("last")} AS t, {_stopped("last")} AS stop, {_type("first")} AS f, coalesce(regexp_matches({_core("first")}, '^\p{{Lu}}'), false) AS upper FROM edges),
    judged AS (SELECT doc_id, i, piece, NOT (stop AND (t IN (SELECT type FROM abbreviations) OR regexp_matches(t, '^\p{{L}}$')))
      OR (upper AND (t, f) NOT IN (SELECT (type, next) FROM together) AND coalesce((SELECT o.opens OR (o.lower AND NOT o.inside) FROM openers o WHERE o.type = f), false)) AS cuts FROM asked),
    numbered AS (SELECT *, coalesce(sum(cuts::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM judged),
    whole AS (SELECT doc_id, s, regexp_replace(string_agg(piece, '' ORDER BY i), '^{_WS}+|{_WS}+$', '', 'g') AS sentence FROM numbered GROUP BY doc_id, s)
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1)::INT AS pos, sentence FROM whole WHERE sentence <> ''"""
)
def doc_sentences_learnt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of all documents, cut by what the documents teach about abbreviations and words that open sentences."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return boundaries.split_learnt(docs, boundaries.learn(docs)).select("doc_id", "pos", "sentence")


@REGISTRY.add()
def doc_clean_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", replace_rules(F.col("text")).alias("cleaned"))


@REGISTRY.add()
def doc_clean_full_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", replace_rules_in_batches(F.col("text"), GENERAL_RULES).alias("cleaned"))


_PHRASES = 330


@REGISTRY.add(
    f"""WITH words AS (SELECT list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: len(w) >= 2) AS w FROM documents),
    pairs AS (SELECT w[i] || ' ' || w[i + 1] AS phrase FROM (SELECT w, unnest(range(1, len(w))) AS i FROM words)),
    top AS (SELECT phrase, count(*) AS n FROM pairs GROUP BY phrase ORDER BY n DESC, phrase LIMIT {_PHRASES}),
    rules AS (SELECT list(phrase ORDER BY n DESC, phrase) AS r FROM top)
    SELECT doc_id, trim(regexp_replace(list_reduce(list_prepend(lower(text), r), lambda t, p: replace(t, p, replace(p, ' ', ''))), '\\s+', ' ', 'g'), ' ') AS cleaned FROM documents, rules"""
)
def doc_clean_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of 330 rules, which write the commonest phrases as one word each, one after the other."""
    docs = table(spark, sf_dir, "documents")
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.length(w) >= 2)
    pairs = F.transform(F.col("w"), lambda w, i: F.concat_ws(" ", w, F.get(F.col("w"), i + 1)))
    phrases = docs.select(words.alias("w")).select(F.explode(pairs).alias("phrase")).where("phrase like '% %'").groupBy("phrase").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "phrase").limit(_PHRASES)
    rules = read_rules(compounds(phrases.select("phrase", (-F.col("n")).alias("place"))))
    return docs.select("doc_id", rewrite(F.col("text"), rules).alias("cleaned"))


@REGISTRY.add(
    """SELECT page_id, nullif(regexp_extract(html, '<title>([^<]*)', 1), '') AS title, nullif(regexp_extract(html, '<html lang="([a-z]+)"', 1), '') AS lang,
    nullif(regexp_extract(url, '^https?://([^/?#]+)', 1), '') AS host FROM pages"""
)
def header_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    html, url = F.col("html"), F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", first_match(html, "<title>([^<]+)").alias("title"), first_match(html, '<html lang="([a-z]+)"').alias("lang"), first_match(url, "^https?://([^/?#]+)").alias("host"))


@REGISTRY.add(
    """SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS period_of_report, o_orderkey::VARCHAR AS accession_number, o_custkey::VARCHAR AS cik,
    o_orderpriority AS company_name, strftime(o_orderdate, '%Y') AS year_of_report FROM orders"""
)
def filing_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyyMMdd")
    text = F.concat(F.lit("CONFORMED PERIOD OF REPORT:\t"), day, F.lit("\nACCESSION NUMBER:  "), F.col("o_orderkey").cast("string"), F.lit("\nCENTRAL INDEX KEY:\t"), F.col("o_custkey").cast("string"), F.lit("\nCOMPANY CONFORMED NAME: "), F.col("o_orderpriority"), F.lit("\r\n"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))
    got = rows.withColumns(header(F.col("text")))
    return got.select("o_orderkey", "period_of_report", "accession_number", "cik", "company_name", "year_of_report")


#: Marks put before and after the texts, by doc_id: sections are found, or not, for different reasons.
FRAMES = (
    ("Contents Part II Item 7. x Item 8. Part III y PART  II Item 7. ", " Item 8. figures PART III see Item 8. end"),
    ("Part II see Part III below. Items 7 and 7A. ", " item 8: y Part III"),
    ("Part II Item 7: ", " Item 8. without a third part"),
    ("Part III of last year. PART II ITEM 7. Part III ", " Item 8. PART III"),
    ("Part II Item 7. ", " Item 8. a Item 8. Part III, as in Part II, Item 7 tells"),
    ("Item 7. ", " Item 8. Part III"),
    ("", ""),
)


def _frames_sql() -> str:
    rows = ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(FRAMES))
    offsets = lambda p: f"""list_transform(range(1, len(regexp_extract_all(t, '{p}')) + 1), lambda k: CAST(coalesce(list_sum(list_transform(regexp_split_to_array(t, '{p}')[1:k], lambda x: length(x))), 0)
        + coalesce(list_sum(list_transform(regexp_extract_all(t, '{p}')[1:k - 1], lambda x: length(x))), 0) AS BIGINT))"""  # noqa: E731
    return f"""WITH framed AS (SELECT doc_id, a || text || b AS t FROM documents JOIN (VALUES {rows}) f(i, a, b) ON doc_id % {len(FRAMES)} = i),
    marks AS (SELECT doc_id, t, {offsets('(?i)part[[:space:]]+ii[[:>:]]'.replace('[[:>:]]', chr(92) + 'b'))} AS two, {offsets('(?i)part[[:space:]]+iii' + chr(92) + 'b')} AS three,
      {offsets('(?i)items?[[:space:]]+7[.:[:space:]]')} AS seven, {offsets('(?i)item[[:space:]]+8[.:[:space:]]')} AS eight FROM framed),
    tried AS (SELECT doc_id, p, list_min(list_filter(seven, lambda y: y > p)) AS s, three, eight FROM (SELECT *, unnest(two) AS p FROM marks)),
    ended AS (SELECT doc_id, p, s, list_max(list_filter(eight, lambda y: y > s AND y < list_min(list_filter(three, lambda z: z > s)))) AS e FROM tried),
    best AS (SELECT doc_id, arg_max(s, p) AS s, arg_max(e, p) AS e FROM ended WHERE e IS NOT NULL GROUP BY doc_id)
    SELECT framed.doc_id, substr(t, s + 1, e - s) AS section FROM framed LEFT JOIN best USING (doc_id)"""


@REGISTRY.add(_frames_sql())
def section_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    frame = lambda end: F.element_at(F.array(*(F.lit(f[end]) for f in FRAMES)), (F.col("doc_id") % len(FRAMES) + 1).cast("int"))
    framed = table(spark, sf_dir, "documents").select("doc_id", F.concat(frame(0), "text", frame(1)).alias("text"))
    return filings.section(framed).select("doc_id", "section")


@REGISTRY.add(
    """SELECT min(doc_id) AS doc_id, source FROM documents WHERE n_chars IS NOT NULL GROUP BY source, n_chars"""
)
def accession_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("n_chars is not null").withColumn("accession_number", F.concat_ws("/", "source", F.col("n_chars").cast("string")))
    return filings.first_of_accession(docs, order=("doc_id",)).select("doc_id", "source")


@REGISTRY.add("SELECT doc_id, lang FROM documents WHERE source IN (SELECT 'src' || n_nationkey FROM nation WHERE n_regionkey = 1)")
def allowed_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("source"))
    return filings.allowed(table(spark, sf_dir, "documents"), listed, "source").select("doc_id", "lang")


@REGISTRY.add(
    """SELECT conv_id AS doc_id, (turn % 3)::INT - 1 AS topic, string_agg(text, '; ' ORDER BY turn) AS text,
    CASE turn % 3 WHEN 0 THEN 'noise' WHEN 1 THEN 'sales' ELSE 'cost and expense' END AS topic_name FROM conversations GROUP BY conv_id, turn % 3"""
)
def topic_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") % 3 - 1).cast("int").alias("topic"), F.col("turn").alias("sentence_id"), F.col("text").alias("sentence"))
    return sentences.topic_texts(rows)


@REGISTRY.add(
    f"""WITH words(topic, word) AS (VALUES {", ".join(f"({i}, '{w}')" for i, words in enumerate(sentences.TOPIC_KEYWORDS) for w in words)}),
    hits AS (SELECT DISTINCT doc_id, topic FROM documents JOIN words ON contains(replace(replace(lower(text), 'disclosure', ''), 'processor', ''), word) WHERE NOT (topic = 3 AND contains(lower(text), 'fertil')))
    SELECT doc_id, coalesce((SELECT list(topic ORDER BY topic) FROM hits WHERE hits.doc_id = documents.doc_id), []) AS topics FROM documents"""
)
def keyword_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentences.keyword_topics(table(spark, sf_dir, "documents"), "text", blacklist=("disclosure", "processor"), exclusions={3: ("fertil",)})
    return found.select("doc_id", "topics")


_TOKENS = """tokens AS (SELECT lang AS topic, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda w: len(w) >= 2)) AS token FROM documents),
tf AS (SELECT topic, token, count(*) AS n FROM tokens GROUP BY ALL)"""


def _term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.term_counts(table(spark, sf_dir, "documents"), "lang", "text")


@REGISTRY.add(
    f"""WITH {_TOKENS}, df AS (SELECT token, sum(n) AS df FROM tf GROUP BY token), size AS (SELECT topic, sum(n) AS total FROM tf GROUP BY topic),
    a AS (SELECT floor(avg(total)) AS a FROM size),
    scored AS (SELECT topic, token, sqrt(n / total::DOUBLE) * ln(1 + (a - df + 0.5) / (df + 0.5)) * CASE WHEN token LIKE '%tion%' THEN 2.0 ELSE 1.0 END AS score
      FROM tf JOIN df USING (token) JOIN size USING (topic), a WHERE 1 + (a - df + 0.5) / (df + 0.5) > 0),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(score, 9) DESC, token)::INT AS rank FROM scored)
    SELECT topic, rank, token, round(score, 9) AS score FROM ranked WHERE rank <= 5"""
)
def ctfidf_top_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = topics.class_tfidf(_term_counts(spark, sf_dir), seeds=("tion",), seed_multiplier=2.0).withColumn("score", F.round("score", 9))
    return topics.top_tokens(scored, 5).select("topic", "rank", "token", "score")


@REGISTRY.add(
    f"""WITH {_TOKENS}, grid AS (SELECT t.topic, k.token FROM (SELECT DISTINCT topic FROM tf) t, (SELECT DISTINCT token FROM tf WHERE token IN ('the', 'of', 'and', 'de', 'der', 'que')) k),
    filled AS (SELECT topic, token, coalesce(n, 0) AS n FROM grid LEFT JOIN tf USING (topic, token)),
    scaled AS (SELECT topic, token, n, coalesce((n - min(n) OVER w)::DOUBLE / nullif(max(n) OVER w - min(n) OVER w, 0), 0) AS scaled FROM filled WINDOW w AS (PARTITION BY token))
    SELECT topic, token, n::BIGINT AS n, scaled FROM scaled"""
)
def keyword_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.keyword_matrix(_term_counts(spark, sf_dir), ("the", "of", "and", "de", "der", "que", "absent"))


@REGISTRY.add(
    """WITH w AS (SELECT doc_id, lang AS topic, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z]+'), lambda x: len(x) >= 2) AS w FROM documents),
    runs AS (SELECT doc_id, topic, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS token FROM w),
    each AS (SELECT doc_id, topic, token, count(*) AS n FROM runs GROUP BY ALL),
    whole AS (SELECT token, sum(n) AS n, count(*) AS df FROM each GROUP BY token),
    good AS (SELECT token FROM whole WHERE df >= 0.02 * (SELECT count(*) FROM w) AND df <= 0.6 * (SELECT count(*) FROM w) ORDER BY n DESC, token LIMIT 300)
    SELECT topic, token, sum(n)::BIGINT AS n FROM each WHERE token IN (SELECT token FROM good) GROUP BY topic, token"""
)
def ngram_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and pairs of words in 2 to 60 % of all documents, the 300 commonest."""
    return topics.ngram_counts(table(spark, sf_dir, "documents"), "lang", "text", (1, 2), 0.02, 0.6, 300)
