"""Readers and writers of text collections, question sets and reports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT_SUFFIXES = (".txt", ".md")
MARKDOWN_SUFFIXES = (".md", ".markdown", ".txt")
GOLDEN = "id string, question string, gold_doc string, must_contain string, type string"
MUST = "array<array<string>>"


@F.pandas_udf(T.StringType())
def _decode(data: pd.Series) -> pd.Series:
    """UTF-8 with bad bytes dropped."""
    return data.map(lambda b: None if b is None else bytes(b).decode("utf-8", errors="ignore"))


def read_texts(spark: SparkSession, path: str, suffixes: tuple[str, ...] | None = TEXT_SUFFIXES) -> DataFrame:
    """Every file below ``path`` with one of the suffixes (any case): id (file name), source (path), text.

    Without suffixes every file is taken, as one that is named explicitly is.
    Bad bytes are dropped; a file name may occur in several folders. Files are
    split over tasks by the binary source, none is read on the driver; ``source``
    gives the order of a sorted scan.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if suffixes is not None:
        ends = F.lit(False)
        for s in suffixes:
            ends = ends | F.lower("path").endswith(s)
        files = files.where(ends)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("id"), F.col("path").alias("source"), _decode("content").alias("text"))


def read_corpus(spark: SparkSession, path: str, most_chars: int | None = None) -> DataFrame:
    """Whole texts of files, each cut after ``most_chars`` characters if that is given."""
    whole = read_texts(spark, path, None)
    return whole if most_chars is None else whole.withColumn("text", F.left("text", F.lit(most_chars)))


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """Uploaded files: name, path, kind (markdown, text or other), text (null for other kinds, which are not decoded)."""
    kind = F.when(F.lower("source").rlike(r"\.(md|markdown)$"), "markdown").when(F.lower("source").endswith(".txt"), "text").otherwise("other")
    got = read_texts(spark, path, None).select(F.col("id").alias("name"), F.col("source").alias("path"), kind.alias("kind"), "text")
    return got.withColumn("text", F.when(F.col("kind") != "other", F.col("text")))


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of questions; ``must_contain`` may mix strings and lists of strings, a string being a list of one."""
    raw = spark.read.schema(GOLDEN).json(path).where("id is not null or question is not null")
    items = F.from_json("must_contain", "array<string>")
    each = F.transform(items, lambda x: F.coalesce(F.when(x.startswith("["), F.from_json(x, T.ArrayType(T.StringType()))), F.array(x)))
    return raw.withColumn("must_contain", each)


def read_json_docs(spark: SparkSession, path: str, schema: str = "id string, text string, score double") -> DataFrame:
    """One JSON array of documents per file."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def read_ndjson(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a column ``_bad`` that keeps what doesn't parse; blank lines are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    with_bad = T._parse_datatype_string(schema + ", _bad string")
    parsed = F.from_json("value", with_bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return lines.select(parsed.alias("e")).select("e.*")


def parse_events(buffer: str) -> tuple[list[dict], str]:
    """Complete lines of a buffer as events and the unfinished rest; blank and broken lines are skipped."""
    import json

    *done, rest = buffer.split("\n")
    out = []
    for line in done:
        try:
            event = json.loads(line)
        except ValueError:
            continue
        if isinstance(event, dict):
            out.append(event)
    return out, rest


def assemble(events: DataFrame) -> DataFrame:
    """events (stream, seq, type, text) to one row per stream: the deltas joined in order, and whether it is final."""
    return events.groupBy("stream").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("type") == "delta", F.struct("seq", "text")))), lambda x: x["text"]), "").alias("answer"),
        F.bool_or(F.col("type") == "final").alias("final"),
    )


def write_clean(verdicts: DataFrame, path: str) -> None:
    """Kept texts as text files, one document per record with an empty line after it; written by all tasks."""
    verdicts.where("kept").select(F.concat("clean", F.lit("\n")).alias("value")).write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Full rebuild of a table, partitioned by low-cardinality columns."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*by) if by else w).parquet(path)


def latest(changes: DataFrame, key: str, at: str) -> DataFrame:
    """The latest row of each key: what an upsert leaves."""
    w = Window.partitionBy(key).orderBy(F.desc(at))
    return changes.withColumn("_turn", F.row_number().over(w)).where("_turn = 1").drop("_turn")


#: Version of stored evaluation sets.
EVAL_SET_VERSION = 1


def write_eval_set(cases: DataFrame, path: str, name: str = "set") -> None:
    """Cases as JSON lines with the set's name, version and time of creation."""
    cases.select("*", F.lit(name).alias("set_name"), F.lit(EVAL_SET_VERSION).alias("version"), F.current_timestamp().alias("created_at")).write.mode("overwrite").json(path)


def read_eval_set(spark: SparkSession, path: str) -> DataFrame:
    """Cases with an optional source; sets of another version are refused."""
    got = spark.read.schema("case_id string, question string, expected string, type string, source string, set_name string, version int, created_at timestamp").json(path)
    if got.where(F.col("version").isNotNull() & (F.col("version") != EVAL_SET_VERSION)).limit(1).count():
        raise ValueError("the evaluation set has another version")
    return got


def write_alphabet(docs: DataFrame, path: str, text: str = "text") -> None:
    """The sorted distinct characters of all texts with their ids."""
    chars = docs.select(F.explode(F.array_distinct(F.split(F.col(text), ""))).alias("char")).where("char <> ''").distinct()
    chars.groupBy().agg(F.array_sort(F.collect_set("char")).alias("chars")).select(F.posexplode("chars").alias("id", "char")).write.mode("overwrite").json(path)  # at most all characters there are


def read_alphabet(spark: SparkSession, path: str) -> str:
    return "".join(r.char for r in spark.read.schema("id int, char string").json(path).orderBy("id").collect())


def write_special(special: dict[str, int], spark: SparkSession, path: str) -> None:
    """Special tokens beside a merges table."""
    spark.createDataFrame(sorted(special.items(), key=lambda x: x[1]), "token string, id int").write.mode("overwrite").json(path)


def read_special(spark: SparkSession, path: str) -> dict[str, int]:
    return {r.token: r.id for r in spark.read.schema("token string, id int").json(path).collect()}


def write_merges(merges: DataFrame, path: str) -> None:
    """A merges table in rank order, as JSON lines."""
    merges.orderBy("rank").write.mode("overwrite").json(path)


def read_merges(spark: SparkSession, path: str) -> DataFrame:
    """A merges table; negative ranks and repeated pairs are refused."""
    m = spark.read.schema("rank int, left int, right int").json(path)
    bad = m.groupBy("left", "right").agg(F.count("*").alias("n"), F.min("rank").alias("low")).where("n > 1 or low < 0").limit(1).count()
    if bad:
        raise ValueError("the merges table has repeated pairs or negative ranks")
    return m


def report(funnel_rows: list, drop_rows: list, pii_rows: list, examples: list = ()) -> str:
    """A Markdown report of a cleaning run from the rows of its small result tables; ``examples`` are some drops."""
    lines = ["# Corpus report", "", "| stage | documents | of previous |", "|-|-|-|"]
    last = None
    for r in sorted(funnel_rows, key=lambda r: r.ord):
        share = "" if not last else f"{r.n / last:.0%}"
        lines.append(f"| {r.stage} | {r.n} | {share} |")
        last = r.n
    lines += ["", "## Drops", *(f"- {r.stage}: {r.n}" for r in sorted(drop_rows, key=lambda r: (-r.n, r.stage)))]
    lines += ["", "## Redactions", *(f"- {r.kind}: {r.n}" for r in sorted(pii_rows, key=lambda r: r.kind) if r.n)]
    if examples:
        lines += ["", "## Examples", *(f"- {r.doc_id} ({r.stage}): {', '.join(r.reasons or [])}" for r in examples)]
    return "\n".join(lines) + "\n"


def eval_report(summary_rows: list, failures: list = ()) -> str:
    """A Markdown report of an evaluation from its summary rows (type ``*`` is all) and the questions that failed."""
    lines = ["# Retrieval report", "", "| type | n | recall@5 | hit@3 | MRR | answers |", "|-|-|-|-|-|-|"]
    for r in sorted(summary_rows, key=lambda r: (r.type != "*", r.type)):
        answers = "" if r.accuracy is None else f"{r.accuracy:.1%}"
        lines.append(f"| {r.type} | {r.n} | {r.recall_5:.1%} | {r.precision_3:.1%} | {r.mrr:.3f} | {answers} |")
    if failures:
        lines += ["", "## Not found", *(f"- {r.query}" for r in failures)]
    return "\n".join(lines) + "\n"


def write_stories(stories: DataFrame, path: str, text: str = "story") -> None:
    """Stories as text files, an empty line after each; written by all tasks."""
    stories.select(F.concat(F.trim(text), F.lit("\n")).alias("value")).write.mode("overwrite").text(path)


def textbook(parts: DataFrame, plan: DataFrame) -> DataFrame:
    """parts (domain, ord, text) in the order of a plan (domain, rank): rows (rank, ord, text), ready for an ordered write; domains without a text are left out."""
    return parts.where("text is not null").join(plan.select("domain", "rank"), "domain").select("rank", "ord", "text").orderBy("rank", "ord")


#: The tables of the search application, as they are declared.
DDL = {
    "docs": "path STRING NOT NULL, title STRING, hash STRING, ingested_at DOUBLE",
    "chunks": "id BIGINT NOT NULL, doc STRING NOT NULL, heading STRING, ord INT, text STRING, n_tokens INT",
    "vectors": "chunk_id BIGINT NOT NULL, kind STRING, dim INT, vec BINARY",
    "users": "id BIGINT NOT NULL, email STRING, pw STRING, plan STRING, created_at DOUBLE",
    "sessions": "token STRING NOT NULL, user_id BIGINT, created_at DOUBLE",
    "api_keys": "prefix STRING NOT NULL, key_hash STRING, user_id BIGINT, plan STRING, revoked INT, created_at DOUBLE",
    "usage": "user_id BIGINT, prefix STRING, route STRING, month STRING, ts DOUBLE",
    "traces": "id BIGINT NOT NULL, ts DOUBLE, route STRING, latency_ms DOUBLE, retrieval_json STRING, tokens BIGINT, cost DOUBLE, status STRING",
}


def create_tables(spark: SparkSession, database: str = "default", names: tuple[str, ...] = tuple(DDL)) -> list[str]:
    """Declare the tables as parquet tables of the catalog if they are not there; ``usage`` is partitioned by month."""
    for n in names:
        by = " PARTITIONED BY (month)" if n == "usage" else ""
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{n} ({DDL[n]}) USING parquet{by}")
    return list(names)
