"""Queries of the relational inventory: joins, set operations, windows and top-k over the tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import accounts as A
from millrace.plans.registry import Registry
from millrace.sources.files import latest
from millrace.tables import load

R = Registry()


@R.query(
    "chunks_with_docs",
    """SELECT c.id, d.path, d.title FROM (SELECT DISTINCT id, doc FROM chunks) c
    JOIN (SELECT DISTINCT path, title, hash FROM docs WHERE deleted_at IS NULL) d ON d.path = c.doc""",
)
def chunks_with_docs(spark, where):
    """Inner equi join with the filter pushed to the scan."""
    d = load(spark, where, "docs").where("deleted_at is null").select("path", "title", "hash").distinct()
    c = load(spark, where, "chunks").select("id", "doc").distinct()
    return c.join(d, c.doc == d.path).select("id", "path", "title")


@R.query(
    "docs_latest",
    "SELECT path, hash FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ingested_at DESC NULLS LAST, hash DESC) AS n FROM docs) WHERE n = 1",
)
def docs_latest(spark, where):
    """What an upsert by path leaves."""
    d = load(spark, where, "docs").withColumn("o", F.struct("ingested_at", "hash"))
    return latest(d, "path", "o").select("path", "hash")


@R.query(
    "docs_without_chunks",
    "SELECT DISTINCT path FROM docs WHERE NOT EXISTS (SELECT 1 FROM chunks WHERE chunks.doc = docs.path)",
)
def docs_without_chunks(spark, where):
    """Left anti join."""
    d, c = load(spark, where, "docs"), load(spark, where, "chunks")
    return d.select("path").distinct().join(c.select(F.col("doc").alias("path")), "path", "left_anti")


@R.query(
    "usage_left_join",
    """SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""",
)
def usage_left_join(spark, where):
    o = load(spark, where, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    c = load(spark, where, "customer").select("c_custkey")
    return c.join(o, c.c_custkey == o.o_custkey, "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"))


@R.query(
    "longest_prefix",
    """WITH p AS (SELECT DISTINCT substr(path, 1, n) AS prefix FROM docs, (VALUES (1), (4), (9), (12)) t(n) WHERE len(path) >= n)
    SELECT d.path, arg_max(p.prefix, len(p.prefix)) AS prefix FROM (SELECT DISTINCT path FROM docs) d JOIN p ON starts_with(d.path, p.prefix) GROUP BY 1""",
)
def longest_prefix(spark, where):
    """Each path with the longest prefix it begins with, of a table of prefixes."""
    d = load(spark, where, "docs").select("path").where("path is not null").distinct()
    n = F.explode(F.array(*map(F.lit, (1, 4, 9, 12))))
    p = d.withColumn("n", n).where(F.length("path") >= F.col("n")).select(F.left("path", F.col("n")).alias("prefix")).distinct()
    return A.longest_prefix(d, "path", p)


@R.query(
    "key_by_digest",
    """WITH p AS (SELECT substr(path, 1, 8) AS prefix, max(sha256(path)) AS digest FROM docs GROUP BY 1)
    SELECT DISTINCT path, prefix FROM docs JOIN p ON substr(path, 1, 8) = prefix AND sha256(path) = digest""",
)
def key_by_digest(spark, where):
    """Tokens found by their prefix and checked by their digest."""
    d = load(spark, where, "docs").select("path").where("path is not null").distinct()
    p = d.groupBy(F.left("path", F.lit(8)).alias("prefix")).agg(F.max(F.sha2("path", 256)).alias("digest"))
    return A.longest_prefix(d, "path", p, F.sha2("path", 256))


@R.query(
    "key_differences",
    """SELECT * FROM (SELECT 'only_chunks' AS side, count(*) AS n FROM (SELECT doc FROM chunks WHERE doc IS NOT NULL EXCEPT SELECT path FROM docs)
    UNION ALL SELECT 'only_docs', count(*) FROM (SELECT path FROM docs EXCEPT SELECT doc FROM chunks)
    UNION ALL SELECT 'both', count(*) FROM (SELECT path FROM docs INTERSECT SELECT doc FROM chunks))""",
)
def key_differences(spark, where):
    """Set difference and intersection of keys, in one aggregation over tagged keys."""
    c = load(spark, where, "chunks").where("doc is not null").select(F.col("doc").alias("key"), F.lit(1).alias("side"))
    d = load(spark, where, "docs").where("path is not null").select(F.col("path").alias("key"), F.lit(2).alias("side"))
    s = c.unionByName(d).groupBy("key").agg(F.bit_or("side").alias("s"))
    name = F.element_at(F.array(F.lit("only_chunks"), F.lit("only_docs"), F.lit("both")), F.col("s").cast("int"))
    names = spark.createDataFrame([("only_chunks",), ("only_docs",), ("both",)], "side string")
    return names.join(s.groupBy(name.alias("side")).agg(F.count("*").alias("n")), "side", "left").select("side", F.coalesce("n", F.lit(0)).alias("n"))


@R.query(
    "chunk_sequence",
    """SELECT id, doc, lag(id) OVER w AS prev_id, row_number() OVER w AS pos, sum(len(text)) OVER w AS running
    FROM (SELECT DISTINCT id, doc, ord, text FROM chunks WHERE doc IS NOT NULL) WINDOW w AS (PARTITION BY doc ORDER BY ord NULLS FIRST, id)""",
)
def chunk_sequence(spark, where):
    """Lag, position and running length along a file."""
    c = load(spark, where, "chunks").where("doc is not null").dropDuplicates(["id"])
    w = Window.partitionBy("doc").orderBy(F.asc_nulls_first("ord"), "id")
    return c.select("id", "doc", F.lag("id").over(w).alias("prev_id"), F.row_number().over(w).alias("pos"), F.sum(F.length("text")).over(w).alias("running"))


@R.query(
    "pricing_summary",
    """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
    round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
    FROM lineitem GROUP BY ALL""",
)
def pricing_summary(spark, where):
    l = load(spark, where, "lineitem")  # noqa: E741
    return l.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"),
    )


@R.query(
    "nation_revenue",
    """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""",
)
def nation_revenue(spark, where):
    """Four-way join, aggregated by key before the small tables are joined."""
    l = load(spark, where, "lineitem").groupBy("l_orderkey").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("r"))  # noqa: E741
    o, c, n = (load(spark, where, t) for t in ("orders", "customer", "nation"))
    by = l.join(o, l.l_orderkey == o.o_orderkey).groupBy("o_custkey").agg(F.sum("r").alias("r"))
    return by.join(c, by.o_custkey == c.c_custkey).groupBy("c_nationkey").agg(F.sum("r").alias("r")).join(n, F.col("c_nationkey") == n.n_nationkey).select("n_name", F.round("r", 2).alias("revenue"))


@R.query(
    "grouping_levels",
    """SELECT lang, source, count(*) AS n, grouping_id(lang, source) AS level FROM (SELECT lower(lang) AS lang, source FROM documents) GROUP BY GROUPING SETS ((lang, source), (lang), ())""",
)
def grouping_levels(spark, where):
    d = load(spark, where, "documents").select(F.lower("lang").alias("lang"), "source")
    return d.rollup("lang", "source").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level")).select("lang", "source", "n", "level")
