"""Joins and filters over accounts, sessions, keys and providers, their change tables, and checks of configuration.

Tables, not a service: what a web application would look up row by row is one
join or one filter here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.tables import bounded

#: Prefixes at most that are sent to every task.
MAX_PREFIXES = 10_000


def session_users(sessions: DataFrame, users: DataFrame, now: Column | None = None) -> DataFrame:
    """Sessions (token, user_id, and expires if ``now`` is given) with the columns of their users (id, ...); expired ones are left out."""
    live = sessions if now is None else sessions.where(F.col("expires") > now)
    return live.join(users.withColumnRenamed("id", "user_id"), "user_id")


def key_owners(keys: DataFrame, users: DataFrame) -> DataFrame:
    """Keys (prefix, key_hash, user_id, revoked) that are not revoked, with their users."""
    return keys.where(F.col("revoked") == 0).drop("revoked").join(users.withColumnRenamed("id", "user_id"), "user_id")


def by_email(users: DataFrame, email: Column) -> DataFrame:
    """Users with an address, in any letter case."""
    return users.where(F.lower("email") == F.lower(email))


def listed_keys(keys: DataFrame, user_id) -> DataFrame:
    """The keys of one user, the latest first: prefix, plan, revoked, created_at."""
    return keys.where(F.col("user_id") == user_id).select("prefix", "plan", "revoked", "created_at").orderBy(F.desc("created_at"), "prefix")


def anonymous_usage(usage: DataFrame, month: str, prefix: str = "anon:ip") -> DataFrame:
    """Uses without a user, of one month, whose prefix begins so: (prefix, used)."""
    mine = usage.where(F.col("user_id").isNull() & F.startswith("prefix", F.lit(prefix)) & (F.col("month") == month))
    return mine.groupBy("prefix").agg(F.count("*").alias("used"))


def current(changes: DataFrame, key: str, order: list[str], op: str = "op") -> DataFrame:
    """The state that a change table leaves: of each key the values last set, keys deleted last left out.

    ``op`` is insert, update or delete. An update sets the columns that are not
    null and leaves the others; what lies before a key's last insert or delete
    counts no more. One aggregation, no key is collected.
    """
    spot = F.struct(*order)
    start = F.max(F.when(F.col(op).isin("insert", "delete"), spot)).over(Window.partitionBy(key))
    live = changes.withColumn("_spot", spot).withColumn("_start", start).where(F.col("_start").isNull() | (F.col("_spot") >= F.col("_start")))
    values = [c for c in changes.columns if c not in (key, op, *order)]
    sets = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_spot"))).alias(c) for c in values]
    return live.groupBy(key).agg(F.bool_or(F.col(op) == "delete").alias("_gone"), F.bool_or(F.col(op) == "insert").alias("_there"), *sets).where("_there and not _gone").drop("_gone", "_there")


def longest_prefix(rows: DataFrame, text: str, prefixes: DataFrame, digest: Column | None = None) -> DataFrame:
    """Rows with the longest of the ``prefixes`` (prefix, and digest if one is given) that their text begins with; others are left out.

    With ``digest`` only a prefix counts whose own digest equals it. A join on
    the prefix, one for every length there is: no comparison of all with all.
    """
    lengths = [r[0] for r in bounded(prefixes.select(F.length("prefix").alias("n")).distinct(), MAX_PREFIXES, "lengths of prefixes")]
    cols = rows.columns
    each = rows.withColumn("_id", F.struct(*cols)).withColumn("_n", F.explode(F.array(*map(F.lit, sorted(lengths))))) if lengths else rows.limit(0).withColumn("_id", F.struct(*cols)).withColumn("_n", F.lit(0))
    tried = each.where(F.length(text) >= F.col("_n")).withColumn("prefix", F.left(F.col(text), F.col("_n")))
    known = prefixes.select("prefix", *(["digest"] if digest is not None else [])).distinct()
    hit = tried.withColumn("_d", digest).join(known, ["prefix"]).where("digest = _d") if digest is not None else tried.join(known, ["prefix"])
    best = hit.groupBy("_id").agg(F.max_by("prefix", "_n").alias("prefix"))
    return best.select("_id.*", "prefix")


def serving(requests: DataFrame, providers: DataFrame) -> DataFrame:
    """Requests (request, model) with the providers (provider, priority, models array) that serve their model, in order: (request, model, provider, turn)."""
    offers = providers.select("provider", "priority", F.explode("models").alias("model")).distinct()
    w = Window.partitionBy("request").orderBy("priority", "provider")
    return requests.join(offers, "model").select("request", "model", "provider", F.row_number().over(w).alias("turn"))


# -- Validation


def document_faults(id_: Column, score: Column) -> Column:
    """Faults of a document to be packed: no id, a score that is not finite or below 0."""
    bad = {"empty id": F.coalesce(id_, F.lit("")) == "", "score not finite": score.isNull() | F.isnan(score) | (F.abs(score) == float("inf")), "score below 0": score < 0}
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in bad.items()]))


def budget_fault(chars: int, header: int) -> str | None:
    """Fault of a character budget, or None."""
    return "budget must be positive" if chars <= 0 else "header below 0" if header < 0 else "header exceeds the budget" if header > chars else None


def valid(rows: DataFrame, faults: Column) -> DataFrame:
    """``rows``, failing at run time with the faults of the first row that has any."""
    return rows.where(F.when(F.size(faults) > 0, F.raise_error(F.array_join(faults, ", "))).otherwise(F.lit(True)).cast("boolean"))


def roster_faults(roster: DataFrame) -> DataFrame:
    """Faults of providers (name, base_url, api_key_env, models array): one row each (name, fault)."""
    n = F.count("*").over(Window.partitionBy("name"))
    bad = {
        "empty name": F.coalesce("name", F.lit("")) == "",
        "duplicate name": n > 1,
        "no http address": ~F.coalesce(F.col("base_url").rlike("^https?://"), F.lit(False)),
        "no key variable": F.coalesce("api_key_env", F.lit("")) == "",
        "no models": F.coalesce(F.size("models"), F.lit(0)) < 1,
    }
    faults = F.array_compact(F.array(*[F.when(cond, F.lit(x)) for x, cond in bad.items()]))
    return roster.withColumn("faults", faults).select("name", F.explode("faults").alias("fault")).distinct()


def key_faults(keys: DataFrame) -> DataFrame:
    """Faults of gateway keys (key_id, sha256, budget): (key_id, fault)."""
    bad = {
        "no digest of 64 hexadecimal digits": ~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)),
        "duplicate digest": F.count("*").over(Window.partitionBy("sha256")) > 1,
        "budget below 0": F.col("budget") < 0,
    }
    faults = F.array_compact(F.array(*[F.when(cond, F.lit(x)) for x, cond in bad.items()]))
    return keys.withColumn("faults", faults).select("key_id", F.explode("faults").alias("fault")).distinct()
