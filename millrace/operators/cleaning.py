"""Cleaning a corpus: normalise, scrub, language and quality gates, exact and near duplicates, funnel.

The stateless stages are one projection per row; a document's verdict is the
first stage that drops it. Duplicates are found by hash with partial
aggregation; texts themselves are not shuffled for that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import scrub as S
from millrace.functions import text as X
from millrace.operators import minhash
from millrace.tables import spread

STAGES = ("normalize", "language", "quality", "exact-dedup", "near-dedup")


def gated(docs: DataFrame, min_language: float = 0.45, lang: str = "en", min_quality: float = 0.6, compose: bool = True, scrubbed: bool = True) -> DataFrame:
    """``docs`` (doc_id, text) with clean text, pii counts, scores, and the first stateless stage that drops the row.

    Null and empty texts drop at ``normalize``. Later stages see the normalised,
    scrubbed text. Other columns are left out, so none can clash. The language
    gate knows English only; another ``lang`` is refused.
    """
    if lang != "en":
        raise ValueError(f"the language gate knows no {lang}")
    clean = spread(docs.select("doc_id", "text")).withColumn("clean", X.normalize(F.col("text"), compose))
    if scrubbed:
        clean = clean.withColumn("s", S.scrub(F.col("clean"))).withColumn("clean", F.col("s.text")).withColumn("pii", F.col("s.counts")).drop("s")
    c = F.col("clean")
    return (
        clean.withColumn("language_score", X.language_score(c))
        .withColumn("quality", X.quality_a(c, min_score=min_quality))
        .withColumn(
            "stage",
            F.when(c.isNull() | (c == ""), "normalize")
            .when(F.col("language_score") < min_language, "language")
            .when(~F.col("quality.passed"), "quality"),
        )
    )


def exact_duplicates(df: DataFrame, text: str = "clean", key: str = "doc_id") -> DataFrame:
    """(key, fingerprint, first_key, copies): the least key of each text stays, found by md5 without shuffling texts."""
    marked = df.select(key, F.md5(F.col(text)).alias("fingerprint")).where("fingerprint is not null")
    first = marked.groupBy("fingerprint").agg(F.min(key).alias("first_key"), F.count("*").alias("copies"))
    return marked.join(first, "fingerprint").select(key, "fingerprint", "first_key", "copies")


def verdicts(docs: DataFrame, near: float | None = 0.8, family: str = "a", keep_text: bool = False, **gates) -> DataFrame:
    """One row per document: doc_id, kept, stage (null if kept), language_score, quality score, reasons, pii.

    With ``keep_text`` also the clean text. Texts go through the stages in one
    pass; what is kept of it for the duplicate stages are fingerprints and
    signatures, and texts only where they are asked for.
    """
    rows = gated(docs, **gates)
    alive = F.when(F.col("stage").isNull(), F.col("clean"))
    rows = rows.withColumn("fingerprint", F.md5(alive))
    if near is not None:
        rows = rows.withColumn("signature", minhash.signature(alive, family))
    rows = rows.drop("text") if keep_text else rows.drop("text", "clean")
    rows = rows.persist()
    first = rows.where("fingerprint is not null").groupBy("fingerprint").agg(F.min("doc_id").alias("first_key"))
    out = rows.join(first, "fingerprint", "left").withColumn("copy", F.col("doc_id") > F.col("first_key"))
    if near is not None:
        one = rows.where("signature is not null").join(first.select(F.col("first_key").alias("doc_id")), "doc_id", "left_semi")
        groups = minhash.cluster(one.select(F.col("doc_id").alias("key"), "signature"), near)
        out = out.join(groups.where("not representative").select(F.col("key").alias("doc_id"), F.lit(True).alias("close")), "doc_id", "left")
    else:
        out = out.withColumn("close", F.lit(None).cast("boolean"))
    out = out.withColumn("stage", F.coalesce("stage", F.when(F.col("copy"), "exact-dedup"), F.when(F.col("close"), "near-dedup")))
    more = [c for c in ("clean", "pii") if c in rows.columns]
    return out.select(
        "doc_id", F.col("stage").isNull().alias("kept"), "stage", F.round("language_score", 6).alias("language_score"),
        F.col("quality.score").alias("quality_score"), F.col("quality.reasons").alias("reasons"), *more,
    )


def example_drops(found: DataFrame, k: int = 8) -> DataFrame:
    """The first ``k`` dropped documents: by gates in order of id, then near and then exact duplicates."""
    turn = F.when(F.col("stage") == "near-dedup", 1).when(F.col("stage") == "exact-dedup", 2).otherwise(0)
    return found.where("not kept").orderBy(turn, "doc_id").limit(k).select("doc_id", "stage", "reasons")


def funnel(found: DataFrame) -> DataFrame:
    """Survivors after each stage: (ord, stage, n), in one pass over the verdicts."""
    rank = F.coalesce(*[F.when(F.col("stage") == s, F.lit(i)) for i, s in enumerate(STAGES)], F.lit(len(STAGES)))
    names = ("input", "after-normalize", "after-language", "after-quality", "after-exact-dedup", "after-near-dedup")
    sums = [F.coalesce(F.sum((rank >= i).cast("long")), F.lit(0)).alias(f"n{i}") for i in range(len(names))]
    stack = ", ".join(f"{i}, '{name}', n{i}" for i, name in enumerate(names))
    return found.agg(*sums).selectExpr(f"stack({len(names)}, {stack}) as (ord, stage, n)")


def drops(found: DataFrame) -> DataFrame:
    """Dropped documents per stage."""
    return found.where("not kept").groupBy("stage").agg(F.count("*").alias("n"))


def reasons(found: DataFrame) -> DataFrame:
    """How often each quality reason was given."""
    return found.select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def pii_totals(found: DataFrame) -> DataFrame:
    """Redactions per kind over all documents."""
    kinds = ("email", "secret", "digit_id", "phone")
    sums = found.agg(*[F.coalesce(F.sum(f"pii.{k}"), F.lit(0)).alias(k) for k in kinds])
    return sums.selectExpr("stack(4, " + ", ".join(f"'{k}', {k}" for k in kinds) + ") as (kind, n)")


def top_words(docs: DataFrame, k: int = 3, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The ``k`` most frequent words of each document; ties go to the first seen. Pre-aggregated per document and word."""
    words = docs.select(key, F.posexplode(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_]+)"))).alias("pos", "word"))
    n = words.groupBy(key, "word").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    w = Window.partitionBy(key).orderBy(F.desc("n"), "first")
    return n.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(key, "rank", "word", "n")


def corpus_stats(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """chars, bytes, words, unique words, lines, md5, and bytes per word of each text; null texts are left out."""
    c = F.col(text)
    words = F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9_]+)"))
    ends = F.regexp_count(c, F.lit("\r\n|[\n\r]"))
    return docs.where(c.isNotNull()).select(
        key,
        F.length(c).alias("chars"),
        F.size(words).alias("words"),
        F.size(F.array_distinct(words)).alias("unique_words"),
        (ends + F.when((c == "") | c.rlike("[\n\r]\\z"), 0).otherwise(1)).alias("lines"),
        F.md5(c).alias("md5"),
        F.octet_length(c).cast("long").alias("bytes"),
        F.round(F.coalesce(F.try_divide(F.octet_length(c), F.size(words)), F.lit(0.0)), 2).alias("bytes_per_word"),
    )
