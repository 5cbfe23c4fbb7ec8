"""The registered queries of the training-data operators: thin, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.registry import CRC
from .decontaminate import contaminated
from .embedding_dedup import embedding_components
from .license_scan import PHRASES, TEMPLATES, compiled, scan_licenses
from .line_dedup import line_components
from .mixing import mix
from .ngram_join import ngram_components
from .page_text import extract_text
from .quality import score_quality
from .resampling import resample
from .secret_scan import scan_secrets
from .token_store import read_shards, write_shards
from .url_rules import PAGE_RULES, judge_urls
from .whitening import whiten

QUERIES: dict = {}
ORACLES: dict = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"))


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(_table(spark, sf_dir, "embeddings"), threshold=0.93)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_components(_table(spark, sf_dir, "documents"))


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_table(spark, sf_dir, "documents"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(_table(spark, sf_dir, "documents"), width=4, percent=85)


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "mix_source", "mix_weight", "mix_block", "mix_slot", "mix_offset")


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_shards(write_shards(_table(spark, sf_dir, "documents"), tokenizer_file(), end_id=2))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(_table(spark, sf_dir, "embeddings"), components=16)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), buckets=10_000, percent=5, least_words=20, seed=42)


for _query in (op1_benchmark_decontamination, op2_quality_classifier, op3_html_extraction, op4_url_filters, op5_embedding_near_dedup, op6_line_dedup, op7_secret_scans, op8_ngram_jaccard_join, op9_source_mixing, op10_token_output, op11_license_scan, op12_embedding_whitening, op13_importance_resampling):
    QUERIES[_query.__name__] = _query


def _page_rules_sql() -> str:
    rows = ", ".join(f"({i}, '{r.name}', '{r.verdict}', '{r.pattern}')" for i, r in enumerate(PAGE_RULES))
    return f"(VALUES {rows}) AS p(turn, name, verdict, pattern)"


ORACLES["op4_url_filters"] = f"""
WITH parts AS (
  SELECT page_id,
    CASE WHEN strpos(url, '://') > 0 THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages
), site(rule, h, p, verdict) AS (VALUES
  ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
  ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')
), sited AS (
  SELECT *, (SELECT s.rule FROM site s WHERE (parts.host = s.h OR ends_with(parts.host, '.' || s.h)) AND starts_with(parts.path, s.p)
    ORDER BY length(s.rule) DESC LIMIT 1) AS rule
  FROM parts
), judged AS (
  SELECT *, CASE WHEN rule IS NULL THEN (SELECT p.name FROM {_page_rules_sql()} WHERE regexp_matches(sited.host || sited.path, p.pattern)
    ORDER BY p.turn LIMIT 1) END AS pattern
  FROM sited
)
SELECT page_id, host, path, rule,
  coalesce((SELECT s.verdict FROM site s WHERE s.rule = judged.rule),
           (SELECT p.verdict FROM {_page_rules_sql()} WHERE p.name = judged.pattern), 'allow') AS verdict,
  pattern
FROM judged
"""

ORACLES["op5_embedding_near_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach(x, y) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
)
SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.x = v.vec_id) AS n_links,
  (SELECT min(r.y) FROM reach r WHERE r.x = v.vec_id) AS component_id,
  (SELECT min(r.y) FROM reach r WHERE r.x = v.vec_id) = v.vec_id AS kept
FROM v
"""

ORACLES["op8_ngram_jaccard_join"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(list_slice(ws, i, i + 3), ' '))) END AS s
  FROM w
), sized AS (SELECT doc_id, len(s) AS n, s FROM sets), tokens AS (SELECT doc_id, n, unnest(s) AS t FROM sized),
shared AS (SELECT * FROM tokens WHERE t IN (SELECT t FROM tokens GROUP BY t HAVING count(*) > 1)),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM shared a JOIN shared b ON a.t = b.t AND a.doc_id <> b.doc_id
  WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach(x, y) AS (SELECT doc_id, doc_id FROM sized UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT s.doc_id, s.n AS n_shingles, min(r.y) AS component_id FROM sized s JOIN reach r ON r.x = s.doc_id GROUP BY s.doc_id, s.n
"""


def _license_sql() -> str:
    rows = ", ".join(f"({t.number}, '{t.label}', {t.span}, {t.need}, {t.words})" for t in compiled(TEMPLATES, 90))
    places = [
        "list_filter(range(0, len(w)), lambda i: " + " AND ".join(f"w[i + {k + 1}] = '{word}'" for k, word in enumerate(phrase.split(" "))) + ")" for phrase, _ in PHRASES
    ]
    found = ", ".join(f"CASE WHEN len({p}) > 0 THEN '{label}' END" for p, (_, label) in zip(places, PHRASES, strict=True))
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS place, doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents
), t(number, label, span, need, words) AS (VALUES {rows}),
b AS (SELECT place, t.*, w, unnest(range(0, greatest(1, len(w) - span), span)) AS block FROM d, t),
held AS (SELECT place, label, len(list_intersect(words, w[block + 1:block + 2 * span])) AS own, need, len(words) AS n FROM b),
method AS (SELECT place, list(DISTINCT label) AS l, max(own / n) AS share FROM held WHERE own >= need GROUP BY place),
base AS (SELECT place, doc_id, len(w) AS n_words, list_concat({", ".join(places)}) AS p, list_filter([{found}], lambda x: x IS NOT NULL) AS l FROM d)
SELECT doc_id, n_words, len(p) AS n_base, list_min(p) AS first_word, list_max(p) AS last_word, array_to_string(list_sort(base.l), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(base.l, coalesce(method.l, [])))), ',') AS labels, CASE WHEN len(p) > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0) END AS score
FROM base LEFT JOIN method USING (place)
"""


ORACLES["op11_license_scan"] = _license_sql()


def _resampling_sql() -> str:
    words = lambda of: f"""list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM {of}"""  # noqa: E731
    grams = "unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f"
    digit = lambda h, i: f"(strpos('0123456789ABCDEF', upper(substr({h}, {i}, 1))) - 1)::BIGINT"
    return f"""
WITH RECURSIVE {CRC},
d AS (SELECT row_number() OVER () AS place, doc_id, {words("documents")}), b AS (SELECT {words("benchmark")}),
df AS (SELECT place, {grams} FROM d), bf AS (SELECT {grams} FROM b),
hexed AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM df UNION SELECT f FROM bf)),
coded AS (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(h), 2), lambda i: {digit("h", "i")} * 16 + {digit("h", "i + 1")})),
  lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM hexed, tab),
s AS (SELECT bucket, count(*) AS s FROM df JOIN coded USING (f) GROUP BY bucket), t AS (SELECT bucket, count(*) AS t FROM bf JOIN coded USING (f) GROUP BY bucket),
gains AS (SELECT r.range AS bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM df) + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bf) + 10000))))::BIGINT AS gain
  FROM range(10000) r LEFT JOIN s ON s.bucket = r.range LEFT JOIN t ON t.bucket = r.range),
weights AS (SELECT place, count(*) AS n, sum(gain)::BIGINT AS weight FROM df JOIN coded USING (f) JOIN gains USING (bucket) GROUP BY place),
hashed AS (SELECT place, doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, sha256('42:' || doc_id) AS h FROM d LEFT JOIN weights USING (place)),
scored AS (SELECT *, weight + floor(-1000 * ln(-ln((list_reduce(list_transform(range(1, 9), lambda i: {digit("h", "i")}), lambda a, x: a * 16 + x) + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM hashed),
fit AS (SELECT place, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 5 * (SELECT count(*) FROM fit) // 100 THEN rank END AS rank FROM scored LEFT JOIN fit USING (place)
"""


ORACLES["op13_importance_resampling"] = _resampling_sql()
