"""Queries over embeddings and conversations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import routing, vector_index, vectors
from ..session import shared_dir
from .registry import CRC, Registry, crc, table

REGISTRY = Registry()

_CENTROIDS = """parts AS (SELECT label AS topic, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
means AS (SELECT topic, i, avg(x) AS x FROM parts GROUP BY topic, i),
centroids AS (SELECT topic, list(x ORDER BY i) AS centroid FROM means GROUP BY topic)"""
_DISTANCES = f"""{_CENTROIDS}, far AS (SELECT vec_id, label, topic, 1 - list_cosine_similarity(embedding::DOUBLE[], centroid) AS distance FROM embeddings, centroids),
ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, topic)::INT AS rank FROM far)"""
_ENTROPY = f"""{_DISTANCES}, soft AS (SELECT *, exp(-10 * distance) / sum(exp(-10 * distance)) OVER (PARTITION BY vec_id) AS p FROM ranked),
assigned AS (SELECT vec_id, min_by(topic, rank) AS topic, min(distance) AS distance, -sum(p * ln(p + 1e-8)) AS entropy FROM soft GROUP BY vec_id)"""


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


@REGISTRY.add(f"WITH {_CENTROIDS} SELECT topic, list_transform(centroid, lambda x: round(x, 9)) AS centroid FROM centroids")
def topic_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.centroids(_vectors(spark, sf_dir)).select("topic", F.transform("centroid", lambda x: F.round(x, 9)).alias("centroid"))


@REGISTRY.add(f"WITH {_DISTANCES} SELECT vec_id, topic, round(distance, 9) AS distance, rank FROM ranked")
def topic_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return vectors.topic_distances(v, vectors.centroids(v)).withColumn("distance", F.round("distance", 9))


@REGISTRY.add(f"WITH {_ENTROPY} SELECT vec_id, topic, round(distance, 9) AS distance, round(entropy, 9) AS entropy FROM assigned")
def topic_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return vectors.assign_topics(v, vectors.centroids(v)).withColumns({c: F.round(c, 9) for c in ("distance", "entropy")})


@REGISTRY.add(f"WITH {_ENTROPY} SELECT topic, count(*) AS n, round(avg(distance), 9) AS mean_distance, round(avg(entropy), 9) AS mean_entropy FROM assigned GROUP BY topic")
def topic_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    got = vectors.assign_topics(v, vectors.centroids(v))
    return got.groupBy("topic").agg(F.count("*").alias("n"), F.round(F.avg("distance"), 9).alias("mean_distance"), F.round(F.avg("entropy"), 9).alias("mean_entropy"))


@REGISTRY.add(f"WITH {_CENTROIDS} SELECT a.topic AS topic_a, b.topic AS topic_b, round(list_cosine_similarity(a.centroid, b.centroid), 9) AS cosine FROM centroids a JOIN centroids b ON a.topic < b.topic")
def intertopic_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.intertopic_cosine(vectors.centroids(_vectors(spark, sf_dir))).withColumn("cosine", F.round("cosine", 9))


@REGISTRY.add(f"WITH {_CENTROIDS} SELECT topic, count(*) AS n, round(avg(list_cosine_similarity(embedding::DOUBLE[], centroid)), 9) AS cosine FROM embeddings JOIN centroids ON label = topic GROUP BY topic")
def intratopic_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return vectors.intratopic_cosine(v, vectors.centroids(v)).withColumn("cosine", F.round("cosine", 9))


_KNN = """far AS (SELECT q.vec_id, n.vec_id AS neighbour, n.label, 1 - list_cosine_similarity(q.embedding::DOUBLE[], n.embedding::DOUBLE[]) AS distance
  FROM embeddings q JOIN embeddings n ON q.vec_id % 50 = 0 AND n.vec_id <> q.vec_id),
near AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(distance, 12), neighbour)::INT AS rank FROM far)"""


@REGISTRY.add(f"WITH {_KNN} SELECT vec_id, rank, neighbour, label, round(distance, 9) AS distance FROM near WHERE rank <= 2")
def knn_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of ids divisible by 50 ask for the nearest of all other rows."""
    v = _vectors(spark, sf_dir)
    return vectors.nearest_labelled(v.where("vec_id % 50 = 0"), v, 2, others=True).withColumn("distance", F.round("distance", 9))


@REGISTRY.add(
    f"""WITH {_KNN} SELECT vec_id, string_agg('Example ' || rank || ':' || chr(10) || 'Sentence: vector ' || neighbour || chr(10) || 'Topic: ' || label, chr(10) || chr(10) ORDER BY rank) AS examples
    FROM near WHERE rank <= 2 GROUP BY vec_id"""
)
def knn_example_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    near = vectors.nearest_labelled(v.where("vec_id % 50 = 0"), v, 2, others=True)
    return routing.examples_text(near.withColumn("text", F.concat(F.lit("vector "), F.col("neighbour").cast("string"))), topic="label")


_FOLDS = 5


@REGISTRY.add(
    f"""WITH RECURSIVE {CRC},
    crc AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, {crc('vec_id')} AS h FROM embeddings, tab),
    dealt AS (SELECT *, ((row_number() OVER (PARTITION BY label ORDER BY h, vec_id) - 1) % {_FOLDS})::INT AS fold FROM crc),
    far AS (SELECT a.vec_id, a.label, a.fold, b.label AS other, avg(list_distance(a.e, b.e)) FILTER (b.vec_id <> a.vec_id) AS d, count(*) FILTER (b.vec_id <> a.vec_id) AS n
      FROM dealt a JOIN dealt b ON a.fold = b.fold GROUP BY ALL),
    sides AS (SELECT vec_id, label, fold, max(d) FILTER (other = label AND n > 0) AS inner_d, min(d) FILTER (other <> label) AS outer_d FROM far GROUP BY vec_id, label, fold)
    SELECT vec_id, label, fold, round(coalesce((outer_d - inner_d) / greatest(outer_d, inner_d), 0), 7) AS silhouette FROM sides"""
)
def silhouette_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.silhouettes(_vectors(spark, sf_dir), _FOLDS).withColumn("silhouette", F.round("silhouette", 7))


@REGISTRY.add(
    """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL),
    far AS (SELECT a.vec_id, a.label, b.label AS other, avg(1 - list_cosine_similarity(a.e, b.e)) FILTER (b.vec_id <> a.vec_id) AS d, count(*) FILTER (b.vec_id <> a.vec_id) AS n FROM v a, v b GROUP BY ALL),
    sides AS (SELECT vec_id, label, max(d) FILTER (other = label AND n > 0) AS inner_d, min(d) FILTER (other <> label) AS outer_d FROM far GROUP BY vec_id, label)
    SELECT vec_id, label, round(coalesce((outer_d - inner_d) / greatest(outer_d, inner_d), 0), 7) AS silhouette FROM sides"""
)
def silhouette_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over the whole table at once: no folds are needed."""
    return vectors.cosine_silhouettes(_vectors(spark, sf_dir)).select("vec_id", "label", F.round("silhouette", 7).alias("silhouette"))


@REGISTRY.add()
def knn_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of ids divisible by 50 ask a stored index of all rows for their ten nearest others."""
    v = _vectors(spark, sf_dir)
    folder = f"{shared_dir(spark).rstrip('/')}/index-{uuid.uuid4().hex}"
    vector_index.build(v, folder)
    asked = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return vector_index.search(spark, asked, folder, 10, others=True).select(F.col("q").alias("vec_id"), "rank", "neighbour", "distance")


@REGISTRY.add(
    f"""WITH {_ENTROPY}, own AS (SELECT e.vec_id, e.label, 1 - r.distance AS s FROM embeddings e JOIN ranked r ON r.vec_id = e.vec_id AND r.topic = e.label)
    SELECT a.vec_id, a.topic, round(a.entropy, 9) AS entropy, round(o.s, 9) AS score FROM assigned a JOIN own o USING (vec_id) WHERE o.s < 0.5 AND a.entropy > 0.5"""
)
def ambiguous_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    of = vectors.centroids(v)
    own = vectors.topic_distances(v.withColumnRenamed("label", "own"), of).join(v.select("vec_id", F.col("label").alias("topic")), ["vec_id", "topic"]).select("vec_id", (1 - F.col("distance")).alias("score"))
    got = vectors.assign_topics(v, of).join(own, "vec_id").where(routing.ambiguous(F.col("score"), F.col("entropy")))
    return got.select("vec_id", "topic", F.round("entropy", 9).alias("entropy"), F.round("score", 9).alias("score"))


_OVERRIDE = """answers AS (SELECT vec_id AS sentence_index, CASE vec_id % 4 WHEN 0 THEN 'operations' WHEN 1 THEN 'hr' ELSE 'weather' END AS topic, (80 + vec_id % 20)::INT AS probability FROM embeddings WHERE vec_id % 3 = 0),
final AS (SELECT e.vec_id AS sentence_index, e.label AS topic, CASE WHEN a.sentence_index IS NULL THEN e.label WHEN a.probability < 85 THEN -1 WHEN a.topic = 'operations' THEN 3 WHEN a.topic = 'hr' THEN 8 ELSE -1 END AS final_topic,
  CASE WHEN a.sentence_index IS NULL THEN 'nearest' ELSE 'model' END AS source FROM embeddings e LEFT JOIN answers a ON a.sentence_index = e.vec_id)"""


def _overridden(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    said = F.when(F.col("vec_id") % 4 == 0, "operations").when(F.col("vec_id") % 4 == 1, "hr").otherwise("weather")
    answers = v.where("vec_id % 3 = 0").select(F.col("vec_id").alias("sentence_index"), said.alias("topic"), (80 + F.col("vec_id") % 20).cast("int").alias("probability"))
    return routing.override(v.select(F.col("vec_id").alias("sentence_index"), F.col("label").alias("topic")), answers)


@REGISTRY.add(f"WITH {_OVERRIDE} SELECT sentence_index, topic, final_topic, source FROM final")
def label_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overridden(spark, sf_dir).select("sentence_index", "topic", "final_topic", "source")


@REGISTRY.add(
    f"""WITH {_OVERRIDE}, c AS (SELECT count(*) AS n, count(*) FILTER (source = 'model') AS routed, count(*) FILTER (final_topic = -1) AS noise FROM final)
    SELECT n, routed, noise, routed / n::DOUBLE AS routed_share, 1 - noise / n::DOUBLE AS coverage FROM c"""
)
def topic_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.coverage(_overridden(spark, sf_dir))


_CONTEXT = """near AS (SELECT conv_id, turn, text, CASE WHEN turn - lag(turn) OVER w <= 2 THEN lag(text) OVER w END AS previous, CASE WHEN lead(turn) OVER w - turn <= 2 THEN lead(text) OVER w END AS next
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
said AS (SELECT *, concat_ws(chr(10), CASE WHEN previous <> '' THEN 'Previous Sentence: ' || previous END, CASE WHEN next <> '' THEN 'Next Sentence: ' || next END) AS context FROM near)"""


def _context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.with_context(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@REGISTRY.add(f"WITH {_CONTEXT} SELECT conv_id, turn, previous, next, context FROM said")
def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _context(spark, sf_dir).select("conv_id", "turn", "previous", "next", "context")


@REGISTRY.add(
    f"""WITH {_CONTEXT} SELECT conv_id, turn, concat_ws(chr(10) || chr(10), 'Company: ' || c.role, CASE WHEN trim(context) <> '' THEN trim(context, chr(10) || ' ') END, 'Sentence: ' || said.text) AS prompt
    FROM said JOIN conversations c USING (conv_id, turn)"""
)
def prompt_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _context(spark, sf_dir)
    return rows.select("conv_id", "turn", routing.prompt(F.col("text"), routing.metadata_text(F.col("role")), F.col("context"), instruction=False).alias("prompt"))


@REGISTRY.add(
    """SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN 'Parsing Error' ELSE 'hr' END AS topic, CASE WHEN turn % 3 = 2 THEN 'Parsing Error' ELSE 'by length' END AS explanation,
    CASE WHEN turn % 3 = 2 THEN 0 ELSE (length(text) % 101) END::INT AS probability FROM conversations"""
)
def rag_model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in for a language model, so that the call, its failures and the reading of answers run."""

    def load():
        import json

        def model(text: str) -> str:
            turn, said = text.split("|", 1)
            if int(turn) % 3 == 2:
                raise RuntimeError("no answer")
            return json.dumps({"topic": "hr", "explanation": "by length", "probability": len(said) % 101})

        return model

    rows = table(spark, sf_dir, "conversations").withColumn("prompt", F.concat_ws("|", F.col("turn").cast("string"), "text"))
    return routing.read_answers(routing.ask(rows, load)).select("conv_id", "turn", "topic", "explanation", "probability")


@REGISTRY.add(
    """WITH n AS (SELECT conv_id, turn, length(text) AS n FROM conversations), s AS (SELECT *, [n % 7, n % 5, n % 3]::DOUBLE[] AS s FROM n)
    SELECT conv_id, turn, (list_position(s, list_max(s)) - 1)::INT AS fls_class, ['specific', 'general', 'none'][list_position(s, list_max(s))] AS fls_label, round(exp(list_max(s)) / list_sum(list_transform(s, lambda x: exp(x))), 9) AS fls_prob FROM s"""
)
def modality_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in for a classifier of statements about the future, so that batches, classes and probabilities run."""

    def load():
        import numpy as np

        return lambda texts: np.array([[len(t) % 7, len(t) % 5, len(t) % 3] for t in texts], dtype=float)

    got = vectors.classified(table(spark, sf_dir, "conversations"), load, "text", ("specific", "general", "none"), "fls_")
    return got.select("conv_id", "turn", "fls_class", "fls_label", F.round("fls_prob", 9).alias("fls_prob"))


@REGISTRY.add(
    """WITH s AS (SELECT vec_id, list_slice(embedding, 1, 3)::DOUBLE[] AS s FROM embeddings)
    SELECT vec_id, (list_position(s, list_max(s)) - 1)::INT AS class, round(exp(list_max(s)) / list_sum(list_transform(s, lambda x: exp(x))), 9) AS prob FROM s"""
)
def best_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _vectors(spark, sf_dir).select("vec_id", F.slice(F.col("embedding").cast("array<double>"), 1, 3).alias("s"))
    got = scored.withColumn("b", vectors.best_class(F.col("s")))
    return got.select("vec_id", F.col("b.class").alias("class"), F.round("b.prob", 9).alias("prob"))
