"""Approximate neighbours by inverted lists, a small classifier, and table functions for SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import scrub, vectors
from millrace.functions import text as X
from millrace.operators import annindex, minhash
from millrace.session import scratch

def inverted_lists(points: DataFrame, queries: DataFrame, k: int = 10, lists: int = 32, probes: int = 12) -> DataFrame:
    """Approximate cosine neighbours through an index in the shared folder: (query, id, distance, rank).

    Vectors that are null, not finite or zero take no part; all have one length. See ``annindex``.
    """
    spark = points.sparkSession
    if points.where(vectors.finite(F.col("vec")) & F.exists("vec", lambda x: x != 0)).limit(1).count() == 0:
        kinds = f"query {queries.schema['id'].dataType.simpleString()}, id {points.schema['id'].dataType.simpleString()}, distance double, rank int"
        return spark.createDataFrame([], kinds)
    return annindex.build(points, scratch(spark, "lists"), lists).search(queries, k, probes)


def train_classifier(rows: DataFrame, hidden: int = 8, classes: int = 2, seed: int = 7, rounds: int = 100):
    """A perceptron with one hidden layer on (features array, label); returns a function that adds ``prediction``."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector

    vec = lambda df: df.withColumn("_f", array_to_vector(F.col("features").cast("array<double>")))
    size = len(rows.select("features").first().features)
    model = MultilayerPerceptronClassifier(
        layers=[size, hidden, classes], seed=seed, maxIter=rounds, featuresCol="_f", labelCol="label", predictionCol="prediction"
    ).fit(vec(rows))
    return lambda df: model.transform(vec(df)).drop("_f", "rawPrediction", "probability")


def accuracy(predicted: DataFrame) -> DataFrame:
    return predicted.agg(F.count("*").alias("n"), F.round(F.avg((F.col("label") == F.col("prediction")).cast("int")), 6).alias("accuracy"))


#: The tools of the catalogue: name, description, parameters.
TOOLS = (
    ("scrub_pii", "Redact personal data and secrets in a text.", {"text": "str"}),
    ("quality_score", "Score and verdict of a text.", {"text": "str"}),
    ("corpus_stats", "Characters, words, distinct words, lines and fingerprint of a text.", {"text": "str"}),
    ("dedupe_corpus", "Clusters of near duplicates in a table.", {"table": "str", "threshold": "float"}),
)


def register(spark: SparkSession) -> list[str]:
    """Make functions available to SQL: scrub_pii(text), word_count(text). More: :func:`register_stats`, :func:`dedupe_view`, :func:`quality_view`."""

    def kept(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: scrub.scrub_one(t)[0])

    spark.udf.register("scrub_pii", F.pandas_udf(kept, T.StringType()))
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION word_count(t STRING) RETURNS INT RETURN regexp_count(t, '[^ \\\\t\\\\n\\\\r]+')")
    return ["scrub_pii", "word_count"]


def register_stats(spark: SparkSession) -> list[str]:
    """Make corpus_stats(text) available to SQL."""
    words = "regexp_extract_all(lower(t), '([a-z0-9_]+)')"
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION corpus_stats(t STRING) RETURNS STRUCT<chars: INT, words: INT, unique_words: INT, md5: STRING> "
        f"RETURN named_struct('chars', length(t), 'words', size({words}), 'unique_words', size(array_distinct({words})), 'md5', md5(t))"
    )
    return ["corpus_stats"]


def dedupe_view(spark: SparkSession, table: str, view: str, threshold: float = 0.8, key: str = "doc_id", text: str = "text") -> None:
    """The table function of deduplication: a temporary view (key, cluster_id, representative) over a table or view."""
    minhash.cluster(minhash.signatures(spark.table(table), "b", text, key), threshold).createOrReplaceTempView(view)


def quality_view(spark: SparkSession, table: str, view: str, key: str = "doc_id", text: str = "text") -> None:
    """A temporary view (key, score, verdict, reasons) of the quality gate over a table or view."""
    spark.table(table).select(key, X.quality_b(F.col(text)).alias("q")).select(key, "q.*").createOrReplaceTempView(view)


def distill(replies: DataFrame) -> DataFrame:
    """replies (story, grade) that pass the story gate and whose last verdict is PASS."""
    from millrace.functions.requests import story_gate

    return replies.where(story_gate(F.col("story")) & X.last_verdict(F.col("grade")))
