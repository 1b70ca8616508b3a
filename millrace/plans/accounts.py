"""Queries on accounts, sessions, keys and histories; orders and events stand in for their logs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import accounts as A
from millrace.operators import progress as P
from millrace.plans.registry import Registry
from millrace.tables import load

R = Registry()


def _users(spark, where):
    return load(spark, where, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.col("c_name"), F.lit("@Example.org")).alias("email"), F.col("c_mktsegment").alias("plan"))


@R.query(
    "session_users",
    """SELECT e.event_id AS token, c.c_custkey AS user_id, c.c_mktsegment AS plan FROM events e JOIN customer c ON c.c_custkey = e.user_id
    WHERE e.ts + INTERVAL 30 DAY > TIMESTAMP '2024-01-20 00:00:00'""",
)
def session_users(spark, where):
    """Sessions that have not expired, with their users."""
    s = load(spark, where, "events").select(F.col("event_id").alias("token"), "user_id", (F.col("ts") + F.expr("INTERVAL 30 DAYS")).alias("expires"))
    return A.session_users(s, _users(spark, where), F.to_timestamp(F.lit("2024-01-20 00:00:00"))).select("token", "user_id", "plan")


def _keys(spark, where):
    o = load(spark, where, "orders")
    return o.select(
        F.concat(F.lit("k"), F.col("o_orderkey")).alias("prefix"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("key_hash"), F.col("o_custkey").alias("user_id"),
        F.col("o_orderpriority").alias("plan"), (F.col("o_orderstatus") == "P").cast("int").alias("revoked"), F.col("o_orderdate").alias("created_at"),
    )


@R.query(
    "key_owners",
    """SELECT 'k' || o_orderkey AS prefix, c_custkey AS user_id, c_name || '@Example.org' AS email FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus <> 'P'""",
)
def key_owners(spark, where):
    """Keys that are not revoked, with their owners."""
    return A.key_owners(_keys(spark, where).drop("plan"), _users(spark, where)).select("prefix", "user_id", "email")


@R.query("user_by_email", "SELECT c_custkey AS id, c_mktsegment AS plan FROM customer WHERE lower(c_name || '@Example.org') = 'customer#000000042@example.org'")
def user_by_email(spark, where):
    return A.by_email(_users(spark, where), F.lit("customer#000000042@EXAMPLE.org")).select("id", "plan")


@R.query(
    "keys_of_user",
    """SELECT 'k' || o_orderkey AS prefix, o_orderpriority AS plan, CAST(o_orderstatus = 'P' AS INT) AS revoked, o_orderdate AS created_at FROM orders WHERE o_custkey = 40 ORDER BY o_orderdate DESC""",
)
def keys_of_user(spark, where):
    return A.listed_keys(_keys(spark, where), 40)


@R.query(
    "anonymous_usage",
    """SELECT CASE WHEN event_id % 2 = 0 THEN 'anon:ip' ELSE 'web:' END || event_id % 10 AS prefix, count(*) AS used FROM events
    WHERE event_type = 'view' AND event_id % 2 = 0 AND strftime(ts, '%Y-%m') = '2024-01' GROUP BY 1""",
)
def anonymous_usage(spark, where):
    e = load(spark, where, "events")
    u = e.select(
        F.when(F.col("event_type") != "view", F.col("user_id")).alias("user_id"), F.date_format("ts", "yyyy-MM").alias("month"),
        F.concat(F.when(F.col("event_id") % 2 == 0, "anon:ip").otherwise("web:"), F.col("event_id") % 10).alias("prefix"),
    )
    return A.anonymous_usage(u, "2024-01")


@R.query(
    "current_accounts",
    """WITH c AS (SELECT *, CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'update' END AS op FROM events),
    s AS (SELECT *, max(CASE WHEN op IN ('insert', 'delete') THEN event_id END) OVER (PARTITION BY user_id) AS start FROM c),
    l AS (SELECT * FROM s WHERE start IS NULL OR event_id >= start)
    SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(CASE WHEN value > 20 THEN value END, event_id) AS value FROM l GROUP BY 1
    HAVING bool_or(op = 'insert') AND NOT bool_or(op = 'delete')""",
)
def current_accounts(spark, where):
    """The state that a log of inserts, updates and deletes leaves."""
    e = load(spark, where, "events")
    op = F.when(F.col("event_type") == "signup", "insert").when(F.col("event_type") == "error", "delete").otherwise("update")
    c = e.select("user_id", op.alias("op"), "event_id", "event_type", F.when(F.col("value") > 20, F.col("value")).alias("value"))
    return A.current(c, "user_id", ["event_id"])


@R.query("vector_kinds", "SELECT chunk_id, dim FROM (SELECT DISTINCT chunk_id, dim, kind FROM vectors WHERE kind = 'tfidf') ORDER BY chunk_id")
def vector_kinds(spark, where):
    """The rows of one kind of vectors, in order."""
    v = load(spark, where, "vectors")
    return v.where("kind = 'tfidf'").select("chunk_id", "dim", "kind").distinct().select("chunk_id", "dim").orderBy("chunk_id")


@R.query(
    "serving_providers",
    """WITH p AS (SELECT n_name AS provider, n_regionkey AS priority, [event_type, 'all'] AS models FROM nation, (SELECT DISTINCT event_type FROM events) WHERE len(event_type) % 3 = n_nationkey % 3),
    o AS (SELECT DISTINCT provider, priority, unnest(models) AS model FROM p)
    SELECT r.event_id AS request, r.event_type AS model, o.provider, row_number() OVER (PARTITION BY r.event_id ORDER BY o.priority, o.provider) AS turn
    FROM events r JOIN o ON o.model = r.event_type""",
)
def serving_providers(spark, where):
    """Requests with the providers that serve their model, in order."""
    e, n = load(spark, where, "events"), load(spark, where, "nation")
    kinds = e.select("event_type").distinct().withColumn("third", F.length("event_type") % 3)
    p = n.withColumn("third", (F.col("n_nationkey") % 3).cast("int")).join(kinds, "third").select(
        F.col("n_name").alias("provider"), F.col("n_regionkey").alias("priority"), F.array("event_type", F.lit("all")).alias("models")
    )
    return A.serving(e.select(F.col("event_id").alias("request"), F.col("event_type").alias("model")), p)


@R.query(
    "document_faults",
    """SELECT doc_id, array_to_string(list_filter([CASE WHEN coalesce(source, '') = '' THEN 'empty id' END, CASE WHEN lang IS NULL THEN 'score not finite' END,
      CASE WHEN lang IS NOT NULL AND 300 - len(text) < 0 THEN 'score below 0' END], lambda x: x IS NOT NULL), ',') AS faults FROM documents""",
)
def document_faults(spark, where):
    """Faults of documents that are to be packed."""
    d = load(spark, where, "documents")
    score = F.when(F.col("lang").isNotNull(), (300 - F.length("text")).cast("double"))
    score = F.when(F.col("lang").isNotNull(), F.coalesce(score, F.lit(0.0)))
    return d.select("doc_id", F.array_join(A.document_faults(F.col("source"), score), ",").alias("faults"))


@R.query(
    "roster_faults",
    """WITH r AS (SELECT CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE n_name END AS name, CASE WHEN n_nationkey % 4 = 0 THEN 'ftp://x' ELSE 'https://x' END AS url, n_nationkey % 3 AS m FROM nation),
    k AS (SELECT *, count(*) OVER (PARTITION BY name) AS n FROM r)
    SELECT DISTINCT name, unnest(list_filter([CASE WHEN name = '' THEN 'empty name' END, CASE WHEN n > 1 THEN 'duplicate name' END,
      CASE WHEN url LIKE 'ftp%' THEN 'no http address' END, CASE WHEN m = 0 THEN 'no models' END], lambda x: x IS NOT NULL)) AS fault FROM k""",
)
def roster_faults(spark, where):
    n = load(spark, where, "nation")
    r = n.select(
        F.when(F.col("n_nationkey") % 5 == 0, "").otherwise(F.col("n_name")).alias("name"), F.when(F.col("n_nationkey") % 4 == 0, "ftp://x").otherwise("https://x").alias("base_url"),
        F.lit("KEY").alias("api_key_env"), F.when(F.col("n_nationkey") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("m"))).alias("models"),
    )
    return A.roster_faults(r)


# -- Histories


def _history(spark, where):
    """Scores of event types (domains) by month (iteration)."""
    e = load(spark, where, "events").withColumn("n", (F.dayofmonth("ts") % 7).cast("int"))
    return e.groupBy("n", F.col("event_type").alias("domain")).agg(F.round(F.avg("value"), 4).alias("score"))


@R.query(
    "score_trend",
    """WITH h AS (SELECT day(ts) % 7 AS n, event_type AS domain, round(avg(value), 4) AS score FROM events GROUP BY ALL)
    SELECT domain, array_to_string(list(score ORDER BY n), ',') AS scores FROM h GROUP BY 1""",
)
def score_trend(spark, where):
    """Scores of every domain by iteration, in order."""
    t = P.trend(_history(spark, where))
    return t.select("domain", F.array_join(F.transform("scores", lambda x: x.cast("string")), ",").alias("scores"))


@R.query(
    "best_so_far",
    """SELECT user_id, event_id, min(value) OVER w AS best, value < coalesce(min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1e300) AS improved
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)""",
)
def best_so_far(spark, where):
    """Running minimum of a loss, and where it improved."""
    e = load(spark, where, "events")
    return P.best_so_far(e.select("user_id", "event_id", "value"), "user_id", "event_id", "value").select("user_id", "event_id", "best", "improved")


@R.query("mean_losses", "SELECT event_type AS split, day(ts) AS step, count(*) AS n, round(avg(value), 6) AS loss FROM events GROUP BY ALL")
def mean_losses(spark, where):
    e = load(spark, where, "events").select(F.col("event_type").alias("split"), F.dayofmonth("ts").alias("step"), F.col("value").alias("loss"))
    return P.mean_loss(e)


@R.query("textbook", "WITH p AS (SELECT section, row_number() OVER (ORDER BY section) AS rank FROM (SELECT DISTINCT section FROM documents WHERE section IS NOT NULL)) SELECT rank, doc_id AS ord, md5(text) AS md5 FROM documents JOIN p USING (section) WHERE text IS NOT NULL")
def textbook(spark, where):
    """Texts of every domain in the order of a plan."""
    from millrace.sources.files import textbook as ordered

    d = load(spark, where, "documents")
    plan = d.select(F.col("section").alias("domain")).where("domain is not null").distinct().withColumn("rank", F.row_number().over(Window.orderBy("domain")))
    return ordered(d.select(F.col("section").alias("domain"), F.col("doc_id").alias("ord"), "text"), plan).select("rank", "ord", F.md5("text").alias("md5"))
