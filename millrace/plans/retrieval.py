"""Queries on retrieval, nearest neighbours, routing and quantisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import annindex as A
from millrace.operators import manyqueries as M
from millrace.operators import nearest as N
from millrace.operators import retrieval as Q
from millrace.plans.registry import Registry
from millrace.session import scratch, stamp
from millrace.tables import load

R = Registry()

# Searches take as queries every row whose id is divisible by 20, against all rows; evaluations take all questions.


def _asked(spark, where):
    return _golden(spark, where).where(F.regexp_extract("id", r"(\d+)", 1).try_cast("long") % 20 == 0)


def _golden(spark, where):
    return load(spark, where, "golden").dropDuplicates(["id"])


def _chunks(spark, where):
    return load(spark, where, "chunks").dropDuplicates(["id"]).select("id", "doc", "text")


_STEM = """CASE WHEN regexp_matches(t, '(sses|xes|ches|shes|zes)$') THEN t[:-3] WHEN ends_with(t, 'ies') AND len(t) > 4 THEN t[:-4] || 'y'
  WHEN ends_with(t, 'ing') AND len(t) >= 6 THEN t[:-4] WHEN ends_with(t, 'ed') AND len(t) >= 5 THEN t[:-3]
  WHEN ends_with(t, 's') AND len(t) >= 4 AND NOT regexp_matches(t, '(ss|us|is)$') THEN t[:-2] ELSE t END"""
_INDEX = f"""WITH c AS (SELECT DISTINCT id AS doc, doc AS grp, text FROM chunks),
q0 AS (SELECT DISTINCT id, question, gold_doc, type, must_contain FROM golden WHERE TRY_CAST(regexp_extract(id, '(\\d+)', 1) AS BIGINT) % 20 = 0),
ct AS (SELECT doc, len(toks) AS dl, toks FROM (SELECT doc, regexp_extract_all(lower(text), '[a-z0-9$%][a-z0-9._%]*') AS toks FROM c WHERE text IS NOT NULL)),
tot AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM ct),
tk AS (SELECT doc, dl, {_STEM} AS term FROM (SELECT doc, dl, unnest(toks) AS t FROM ct)),
tf AS (SELECT doc, dl, term, count(*) AS tf FROM tk GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
qt AS (SELECT query, term, count(*) AS times FROM (SELECT query, {_STEM} AS term FROM
  (SELECT id AS query, unnest(regexp_extract_all(lower(question), '[a-z0-9$%][a-z0-9._%]*')) AS t FROM q0)) GROUP BY ALL),
bs AS (SELECT query, doc, round(sum(times * ln((n - df + 0.5) / df + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(avgdl, 1)))), 9) AS score
  FROM tf JOIN df USING (term) JOIN qt USING (term), tot GROUP BY ALL),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM bs WHERE score > 0) WHERE rank <= 20),
w0 AS (SELECT doc, term, (1 + ln(tf)) * (ln((n + 1) / (df + 1)) + 1) AS raw FROM tf JOIN df USING (term), tot),
w AS (SELECT doc, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc)) AS weight FROM w0),
x0 AS (SELECT query, term, (1 + ln(times)) * (ln((n + 1) / (df + 1)) + 1) AS raw FROM qt JOIN df USING (term), tot),
x AS (SELECT query, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY query)) AS qw FROM x0),
ts AS (SELECT query, doc, round(sum(weight * qw), 9) AS score FROM w JOIN x USING (term) GROUP BY ALL),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM ts) WHERE rank <= 20),
f AS (SELECT coalesce(b.query, t.query) AS query, coalesce(b.doc, t.doc) AS doc, b.rank - 1 AS rank_1, t.rank - 1 AS rank_2,
  coalesce(1.0 / (60 + b.rank), 0) + coalesce(1.0 / (60 + t.rank), 0) AS score FROM b FULL JOIN t ON b.query = t.query AND b.doc = t.doc),
h0 AS (SELECT *, row_number() OVER (PARTITION BY query, grp ORDER BY score DESC, rank_1 NULLS LAST, rank_2 NULLS LAST, doc) AS turn FROM f JOIN c USING (doc)),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, rank_1 NULLS LAST, rank_2 NULLS LAST, doc) AS rank
  FROM h0 WHERE turn <= 2) WHERE rank <= 6),
ans AS (SELECT query, string_agg(coalesce(c.text, ''), chr(10) ORDER BY rank) AS answer FROM h JOIN c USING (doc) WHERE rank <= 5 GROUP BY 1),
e AS (SELECT q0.id AS query, coalesce(q0.type, 'unknown') AS type, r.first_rank, coalesce(CAST(first_rank <= 5 AS INT), 0) AS recall_5,
  coalesce(CAST(first_rank <= 3 AS INT), 0) AS precision_3, coalesce(1.0 / first_rank, 0) AS rr,
  CASE WHEN must_contain IS NOT NULL THEN CAST(len(list_filter(must_contain, lambda alts: len(list_filter(alts, lambda a: contains(lower(coalesce(answer, '')), lower(a)))) > 0)) = len(must_contain) AS INT) END AS answer_hit
  FROM q0 LEFT JOIN ans ON ans.query = q0.id LEFT JOIN (SELECT h.query, min(h.rank) AS first_rank FROM h JOIN q0 ON q0.id = h.query AND q0.gold_doc = h.grp GROUP BY 1) r ON r.query = q0.id)
"""


_ALL = _INDEX.replace(" WHERE TRY_CAST(regexp_extract(id, '(\\d+)', 1) AS BIGINT) % 20 = 0", "")

#: Stored indexes of this process by application, folder and state of the chunks table.
_STORED: dict[tuple, str] = {}
#: Stored collections for evaluations, likewise.
_COUNTED: dict[tuple, M.Collection] = {}


def _index(spark, where):
    """The stored index of the chunks, built when it is first needed and again when the table has changed."""
    key = (spark.sparkContext.applicationId, where, stamp(spark, f"{where}/chunks.parquet"))
    if key not in _STORED:
        at = scratch(spark, "index")
        Q.store(Q.index(_chunks(spark, where), "id"), at)
        _STORED[key] = at
    return Q.open_index(spark, _STORED[key])


@R.query(
    "index_stats",
    _INDEX + """SELECT n AS n_docs, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM tf) AS n_postings, (SELECT CAST(sum(tf) AS BIGINT) FROM tf) AS n_tokens,
    (SELECT count(*) FROM df) AS n_terms FROM tot""",
)
def index_stats(spark, where):
    """The stored index: documents, mean length, terms, postings."""
    return Q.stats(_index(spark, where))


def _lists(spark, where):
    asked = _asked(spark, where)
    ix, terms = _index(spark, where), Q.query_terms(asked, "id", "question")
    return _chunks(spark, where), asked, Q.bm25(ix, terms), Q.tfidf(ix, terms)


@R.query("bm25_topk", _INDEX + "SELECT query, doc, score, rank FROM b")
def bm25_topk(spark, where):
    return _lists(spark, where)[2].select("query", "doc", "score", "rank")


@R.query("tfidf_topk", _INDEX + "SELECT query, doc, score, rank FROM t")
def tfidf_topk(spark, where):
    return _lists(spark, where)[3].select("query", "doc", "score", "rank")


def _hits(spark, where):
    chunks, _, a, b = _lists(spark, where)
    groups = chunks.select(F.col("id").alias("doc"), F.col("doc").alias("grp"))
    return Q.hits(Q.fuse(a, b), groups)


@R.query("hybrid_hits", _INDEX + "SELECT query, doc, grp, rank FROM h")
def hybrid_hits(spark, where):
    """Fused lexical and sparse lists, at most two chunks per file."""
    return _hits(spark, where).select("query", "doc", "grp", "rank")


def _collection(spark, where):
    key = (spark.sparkContext.applicationId, where, stamp(spark, f"{where}/chunks.parquet"))
    if key not in _COUNTED:
        _COUNTED[key] = M.collection(_chunks(spark, where), "id", "doc")
    return _COUNTED[key]


def _evaluated(spark, where):
    asked, held = _golden(spark, where), _collection(spark, where)
    terms = Q.query_terms(asked, "id", "question")
    bags = M.alike(terms).persist()  # a row a question
    first = terms.join(bags.where("query = bag").select("query"), "query", "left_semi")
    lists = M.search(held, first, [Q.bm25_measure(), Q.tfidf_measure()]).persist()  # at most forty rows a bag, read twice
    fused = Q.fuse(lists.where("measure = 0"), lists.where("measure = 1"))
    found = Q.hits(fused, held.docs.select("doc", "grp")).select("query", "doc", "grp", "rank").persist()  # six rows a bag
    texts = M.only(load(spark, where, "chunks").select("id", "text"), "id", found.where("rank <= 5").select("doc").distinct())
    answered = Q.answers(found, texts.dropDuplicates(["id"]).withColumnRenamed("id", "doc"))
    golden = asked.select(F.col("id").alias("query"), F.col("gold_doc").alias("gold"), "type", "must_contain").join(bags, "query", "left")
    return Q.evaluate(found, golden, answered, "bag")


@R.query("retrieval_eval", _ALL + "SELECT query, first_rank, recall_5, precision_3, round(rr, 6) AS rr, answer_hit FROM e")
def retrieval_eval(spark, where):
    return _evaluated(spark, where).select("query", "first_rank", "recall_5", "precision_3", F.round("rr", 6).alias("rr"), "answer_hit")


@R.query(
    "retrieval_summary",
    _ALL + """SELECT coalesce(type, '*') AS type, count(*) AS n, round(avg(recall_5), 6) AS recall_5, round(avg(precision_3), 6) AS precision_3,
    round(avg(rr), 6) AS mrr, round(avg(answer_hit), 6) AS accuracy,
    round(avg(recall_5), 6) >= 0.8 AND coalesce(round(avg(answer_hit), 6) >= 0.75, true) AS gate FROM e GROUP BY GROUPING SETS ((type), ())""",
)
def retrieval_summary(spark, where):
    return Q.summary(_evaluated(spark, where))


def _points(spark, where):
    return load(spark, where, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


def _knn(metric):
    def run(spark, where):
        p = _points(spark, where)
        return N.exact(p, p.where("id % 20 = 0"), 10, metric).select("query", "id", "distance", "rank")

    return run


_DIST = {
    "cosine": "1 - list_cosine_similarity(a.v, b.v)",
    "l2": "pow(list_distance(a.v, b.v), 2)",
    "ip": "-list_inner_product(a.v, b.v)",
}
_PTS = "WITH p AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"


def _knn_sql(metric: str) -> str:
    return f"""{_PTS}, d AS (SELECT a.id AS query, b.id AS id, round({_DIST[metric]}, 9) AS distance FROM p a, p b WHERE a.id % 20 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, id) AS rank FROM d)"""


for _m in _DIST:
    R.query(f"knn_{_m}", _knn_sql(_m) + " SELECT query, id, distance, rank FROM r WHERE rank <= 10")(_knn(_m))


def _stored_lists(spark, where, points, lists=32):
    return A.build(points.select("id", "vec"), scratch(spark, "lists"), lists)


@R.query("knn_lists_recall", "SELECT CAST(count(*) AS BIGINT) AS queries, CAST(1.0 AS DOUBLE) AS recall FROM embeddings WHERE vec_id % 20 = 0")
def knn_lists_recall(spark, where):
    """Recall of the stored index against the exact neighbours when every list is probed: it must be whole."""
    p = _points(spark, where)
    q = p.where("id % 20 = 0")
    return N.recall(_stored_lists(spark, where, p).search(q, 10, 32), N.exact(p, q, 10))


@R.query("knn_effort")
def knn_effort(spark, where):
    """Recall of the stored index by the number of lists probed."""
    p = _points(spark, where)
    q = p.where("id % 20 = 0")
    return A.effort_table(_stored_lists(spark, where, p), q, N.exact(p, q, 10), 10, (2, 4, 8, 16, 24))


@R.query(
    "knn_after_removal",
    "WITH p AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), d AS (SELECT a.id AS query, b.id AS id, "
    "round(1 - list_cosine_similarity(a.v, b.v), 9) AS distance FROM p a, p b WHERE a.id % 20 = 0 AND (b.id % 7 <> 0 OR b.id % 14 = 0)), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, id) AS rank FROM d) SELECT query, id, distance, rank FROM r WHERE rank <= 5",
)
def knn_after_removal(spark, where):
    """A stored index that lost ids, got some of them again, was compacted and opened anew."""
    p = _points(spark, where).select("id", "vec")
    ix = _stored_lists(spark, where, p, 16)
    ix.remove(p.where("id % 7 = 0"))
    ix.add(p.where("id % 14 = 0"))
    return ix.compact(scratch(spark, "lists")).search(p.where("id % 20 = 0"), 5, 16).select("query", "id", "distance", "rank")


@R.query(
    "knn_label_purity",
    _knn_sql("cosine") + """ SELECT q.label, count(*) AS n, round(avg(CAST(q.label = x.label AS INT)), 6) AS purity
    FROM r JOIN p q ON q.id = r.query JOIN p x ON x.id = r.id WHERE r.rank <= 10 AND r.query <> r.id GROUP BY 1""",
)
def knn_label_purity(spark, where):
    p = _points(spark, where)
    near = N.exact(p, p.where("id % 20 = 0"), 10).where("query <> id")
    own = p.select(F.col("id").alias("query"), "label")
    both = near.join(own, "query").join(p.select("id", F.col("label").alias("other")), "id")
    return both.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg((F.col("label") == F.col("other")).cast("int")), 6).alias("purity"))


def _routed(spark, where):
    p = _points(spark, where)
    near = N.exact(p, p.where("id % 20 = 0"), 5)
    # Every record was tried with three models; which ones passed follows from its label and id.
    outcomes = p.select("id", F.explode(F.array(F.lit("cheap"), F.lit("mid"), F.lit("premium"))).alias("model"), "label").select(
        "id", "model", F.when(F.col("model") == "premium", True).when(F.col("model") == "mid", F.col("label") % 4 != 3).otherwise(F.col("label") % 2 == 0).alias("passed")
    )
    tiers = spark.createDataFrame([("cheap", 0.001, 0), ("mid", 0.01, 1), ("premium", 0.1, 2)], "model string, cost double, ord int")
    return N.route(near, outcomes, tiers)


_ROUTE = _knn_sql("cosine") + """, t(model, cost, ord) AS (VALUES ('cheap', 0.001, 0), ('mid', 0.01, 1), ('premium', 0.1, 2)),
o AS (SELECT id, model, CASE model WHEN 'premium' THEN true WHEN 'mid' THEN label % 4 <> 3 ELSE label % 2 = 0 END AS passed FROM p, t),
g AS (SELECT r.query, o.model, avg(CAST(o.passed AS INT)) AS rate FROM r JOIN o ON o.id = r.id WHERE r.rank <= 5 GROUP BY ALL),
k AS (SELECT g.query, g.model, g.rate, t.cost, row_number() OVER (PARTITION BY query ORDER BY t.cost, t.ord) AS rn FROM g JOIN t USING (model) WHERE g.rate >= 0.9),
z AS (SELECT query, model, round(rate, 6) AS pass_rate, CAST(cost AS DOUBLE) AS cost, CAST(0.1 - cost AS DOUBLE) AS saved, 'floor met' AS reason FROM k WHERE rn = 1)
"""


@R.query("quality_route", _ROUTE + "SELECT * FROM z")
def quality_route(spark, where):
    """Cheapest model that reaches the floor near each query."""
    return _routed(spark, where)


@R.query("route_ledger", _ROUTE + "SELECT model, count(*) AS calls, round(sum(saved), 6) AS saved FROM z GROUP BY 1")
def route_ledger(spark, where):
    return N.ledger(_routed(spark, where))


def _cells(spark, where):
    e = load(spark, where, "embeddings")
    return e.select(F.col("label").alias("tensor"), F.col("vec_id").alias("row"), F.posexplode(F.col("embedding").cast("array<double>")).alias("col", "value"))


_CELLS = """WITH c AS (SELECT label AS tensor, vec_id AS row, unnest(range(len(embedding))) AS col, unnest(CAST(embedding AS DOUBLE[])) AS value FROM embeddings),
s AS (SELECT *, max(abs(value)) OVER ({w}) AS most FROM c),
k AS (SELECT *, CASE WHEN most > 0 THEN most / 127 ELSE 1 END AS scale FROM s),
z AS (SELECT *, greatest(-127, least(127, sign(value / scale) * floor(abs(value / scale) + 0.5))) * scale AS back FROM k)
"""
_WINDOWS = {"per-tensor": "PARTITION BY tensor", "per-row": "PARTITION BY tensor, row", "per-channel": "PARTITION BY tensor, col"}
_ERROR = """SELECT tensor, round(max(abs(value - back)), 6) AS max_abs_error, round(avg(abs(value - back)), 6) AS mean_abs_error,
round(10 * log10(sum(value * value) / sum((value - back) * (value - back))), 4) AS snr_db FROM z GROUP BY 1"""
_AGREE = """, a AS (SELECT tensor, row, arg_min(col, {{'k': -value, 'c': col}}) AS x, arg_min(col, {{'k': -back, 'c': col}}) AS y FROM z GROUP BY ALL)
SELECT tensor, round(avg(CAST(x = y AS INT)), 6) AS agreement FROM a GROUP BY 1"""

for _mode, _w in _WINDOWS.items():
    _name = _mode.replace("-", "_")
    R.query(f"quantize_error_{_name}", _CELLS.format(w=_w) + _ERROR)(
        lambda spark, where, m=_mode: N.quantize_error(N.quantize(_cells(spark, where), m))
    )
    R.query(f"quantize_agreement_{_name}", _CELLS.format(w=_w) + _AGREE.replace("{{", "{").replace("}}", "}"))(
        lambda spark, where, m=_mode: N.argmax_agreement(N.quantize(_cells(spark, where), m))
    )


@R.query(
    "feedback_outcomes",
    """WITH o AS (SELECT vec_id AS id, 'mid' AS model, label % 4 <> 3 AS passed FROM embeddings), n AS (SELECT vec_id AS id, 'mid' AS model, true AS passed FROM embeddings WHERE vec_id % 3 = 0)
    SELECT coalesce(o.id, n.id) AS id, coalesce(o.model, n.model) AS model, coalesce(n.passed, o.passed) AS passed FROM o FULL JOIN n ON o.id = n.id AND o.model = n.model""",
)
def feedback_outcomes(spark, where):
    """Outcomes with later ones appended to the records that routing looks at."""
    p = _points(spark, where)
    old = p.select("id", F.lit("mid").alias("model"), (F.col("label") % 4 != 3).alias("passed"))
    return N.with_feedback(old, p.where("id % 3 = 0").select("id", F.lit("mid").alias("model"), F.lit(True).alias("passed")))


@R.query("quantize_savings", "SELECT CAST(4 * sum(len(embedding)) AS BIGINT) AS was, CAST(sum(len(embedding)) + 4 * count(DISTINCT label) AS BIGINT) AS bytes, "
         "round(4 * sum(len(embedding)) / (sum(len(embedding)) + 4 * count(DISTINCT label)), 4) AS ratio FROM embeddings")
def quantize_savings(spark, where):
    """Bytes and ratio with one scale a tensor."""
    c = _cells(spark, where)
    return N.saved_bytes(N.sizes(c, "per-tensor"), c)


@R.query("quantize_calibrate")
def quantize_calibrate(spark, where):
    """The smallest mode per tensor whose agreement holds."""
    return N.calibrate(_cells(spark, where))
