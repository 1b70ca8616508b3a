"""Lexical, sparse and fused retrieval for whole batches of queries, and its evaluation.

Statistics are tables: postings (term, doc, tf, length, norm) and document
frequencies, stored by term if they serve more than one batch. A batch of queries
is one join on terms, so documents that share no term with a query are never
scored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.session import shuffle_partitions
from millrace.tables import bounded, spread

K1, B = 1.5, 0.75
CANDIDATES, RRF_K, TOP_K, PER_DOC = 20, 60, 6, 2


#: Version of stored indexes, and the number of folders that postings are dealt to by term.
FORMAT, BUCKETS = "millrace-postings/1", 64


@dataclass
class Index:
    """Statistics of a collection: postings (term, doc, tf, dl, norm), terms (term, df), totals with one row (n, avgdl)."""

    postings: DataFrame
    terms: DataFrame
    totals: DataFrame
    held: DataFrame | None = None


def _idf(n: Column, df: Column) -> Column:
    return F.log((n + 1) / (df + 1)) + 1


def index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> Index:
    """The index of a collection; texts without tokens count as documents of length 0.

    Null texts are left out. Terms are counted per document before anything is
    shuffled by term. ``norm`` is the length of the document's sparse vector of
    weights (1 + ln tf) (ln((n + 1) / (df + 1)) + 1). For more than one batch of
    queries store it, see :func:`store`.
    """
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("doc"), text)
    totals = rows.agg(F.count("*").alias("n"), F.avg(F.regexp_count(F.lower(text), F.lit(X.TOKEN))).alias("avgdl")).persist()  # one row
    each = spread(rows).select("doc", X.tokens(F.col(text)).alias("toks")).select("doc", F.size("toks").alias("dl"), F.explode("toks").alias("term"))
    # Texts are read and cut once; postings without their norm are kept until the index is stored.
    tf = each.groupBy("doc", "term", "dl").agg(F.count("*").alias("tf")).persist(StorageLevel.DISK_ONLY)
    terms = tf.groupBy("term").agg(F.count("*").alias("df"))
    raw = (1 + F.log("tf")) * _idf(F.col("n"), F.col("df"))
    w = tf.join(terms, "term").join(F.broadcast(totals)).withColumn("raw", raw)  # totals: one row
    norms = w.groupBy("doc").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return Index(tf.join(norms, "doc").select("term", "doc", "tf", "dl", "norm"), terms, totals, tf)


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def store(ix: Index, path: str) -> None:
    """Write an index to a folder, a full rebuild; postings are dealt to folders by term, so a query reads a part of them."""
    # As many files a folder as the cluster has shuffle partitions for it, so no folder is one task's work.
    n = shuffle_partitions(ix.postings.sparkSession)
    parts = F.pmod(F.xxhash64("doc"), F.lit(max(1, -(-n // BUCKETS))))
    rows = ix.postings.withColumn("bucket", _bucket(F.col("term"))).repartition(n, "bucket", parts).sortWithinPartitions("bucket", "term")
    rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    ix.terms.write.mode("overwrite").parquet(f"{path}/terms")
    ix.totals.withColumn("format", F.lit(FORMAT)).write.mode("overwrite").parquet(f"{path}/totals")
    if ix.held is not None:
        ix.held.unpersist()


def open_index(spark: SparkSession, path: str) -> Index:
    """A stored index; another format is refused."""
    totals = spark.read.parquet(f"{path}/totals")
    if [r.format for r in totals.select("format").collect()] != [FORMAT]:
        raise ValueError("this is no index of this format")
    return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/terms"), totals.drop("format"))


def stats(ix: Index) -> DataFrame:
    """Documents, mean length, distinct terms and postings of an index, in one row."""
    p = ix.postings.agg(F.count("*").alias("n_postings"), F.coalesce(F.sum("tf"), F.lit(0)).alias("n_tokens"))
    t = ix.terms.agg(F.count("*").alias("n_terms"))
    return ix.totals.select(F.col("n").alias("n_docs"), F.round("avgdl", 6).alias("avgdl")).join(F.broadcast(p)).join(F.broadcast(t))  # one row each


def query_terms(queries: DataFrame, key: str = "query_id", text: str = "query") -> DataFrame:
    """(query, term, times): a term asked for twice counts twice."""
    return (
        queries.select(F.col(key).alias("query"), F.explode(X.tokens(F.col(text))).alias("term"))
        .groupBy("query", "term")
        .agg(F.count("*").alias("times"))
    )


def ranked(scores: DataFrame, k: int, by: str = "query", item: str = "doc") -> DataFrame:
    """The ``k`` best items of each query with their rank from 1; ties go to the lower item."""
    w = Window.partitionBy(by).orderBy(F.desc("score"), item)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


class Weights:
    """The weights of a block of queries by term: which queries ask for a term, and how much they give for it."""

    def __init__(self, rows: list[tuple], n: int):
        """``rows``: (query, term, weight), ``n`` documents in the collection."""
        self.queries = sorted({r[0] for r in rows})
        place = {q: i for i, q in enumerate(self.queries)}
        self.terms = sorted({r[1] for r in rows})
        of = {t: i for i, t in enumerate(self.terms)}
        order = sorted((of[t], place[q], w) for q, t, w in rows)
        self.first = np.searchsorted([o[0] for o in order], np.arange(len(self.terms) + 1))
        self.query, self.weight = np.array([o[1] for o in order], np.int64), np.array([o[2] for o in order])
        self.n = n

    def best(self, term: np.ndarray, doc: np.ndarray, value: np.ndarray, k: int, digits: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the postings of some whole documents: (query place, document, score), all that may be among the ``k`` best of a query."""
        ids, at = np.unique(doc, return_inverse=True)
        n = self.first[term + 1] - self.first[term]
        entry = np.repeat(self.first[term] - np.cumsum(n) + n, n) + np.arange(n.sum())
        size = (len(self.queries), len(ids))
        scores = np.bincount(self.query[entry] * size[1] + np.repeat(at, n), self.weight[entry] * np.repeat(value, n), size[0] * size[1]).reshape(size)
        if digits is not None:
            scores = np.round(scores, digits)
        least = np.partition(scores, size[1] - k, axis=1)[:, size[1] - k][:, None] if size[1] > k else 0.0
        q, d = np.nonzero((scores > 0) & (scores >= least))
        return q, ids[d], scores[q, d]


#: Queries and query terms of one pass over the postings (they are sent to every task), and scores that a task holds at once.
PER_PASS, MAX_TERMS, SCORES = 5_000, 1_000_000, 4_000_000


def _top(ix: Index, asked: DataFrame, k: int, digits: int | None, weigh: Callable, value: Callable) -> DataFrame:
    """The ``k`` best documents of every query by sums of query weight times posting value.

    Queries go block by block. Postings of the asked terms only are shuffled, to
    the tasks of their documents; a task sums up whole documents in matrices and
    hands on ``k`` rows a query. ``weigh(query's rows, n)`` gives the weights of
    one query's (term, times, df), ``value(tf, dl, norm, df, n, avgdl)`` those of postings.
    """
    spark = asked.sparkSession
    t = ix.totals.first()
    n, avgdl = t.n or 0, float(t.avgdl or 0.0)
    kinds = {f.name: f.dataType.simpleString() for f in [*asked.schema.fields, *ix.postings.schema.fields]}
    schema = f"query {kinds['query']}, doc {kinds['doc']}, score double"
    count = asked.select("query").distinct().count()
    blocks, out = max(1, -(-count // PER_PASS)), None
    for b in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b) if blocks > 1 else asked
        rows = bounded(mine.select("query", "term", "times"), MAX_TERMS, "terms of one block of queries")
        only = spark.createDataFrame([(x,) for x in sorted({r.term for r in rows})], "term string")
        df = {r.term: r.df for r in ix.terms.join(F.broadcast(only), "term").collect()}
        by: dict = {}
        for r in rows:
            if r.term in df:
                by.setdefault(r.query, []).append((r.term, r.times, df[r.term]))
        w = Weights([(q, term, x) for q, some in by.items() for (term, *_), x in zip(some, weigh(some, n))], n)
        places = spark.createDataFrame([(x, i, df[x]) for i, x in enumerate(w.terms)], "term string, t int, df long")
        shipped = spark.sparkContext.broadcast(w)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            w, held, best = shipped.value, [], []

            def settle(table: pa.Table) -> None:
                cols = {c: table.column(c).to_numpy() for c in table.column_names}
                new = np.flatnonzero(np.r_[True, cols["doc"][1:] != cols["doc"][:-1]])
                step = max(1, SCORES // max(1, len(w.queries)))
                for a in range(0, len(new), step):
                    cut = slice(new[a], new[a + step] if a + step < len(new) else len(cols["doc"]))
                    x = {c: v[cut] for c, v in cols.items()}
                    best.append(w.best(x["t"], x["doc"], value(x["tf"], x["dl"], x["norm"], x["df"], n, avgdl), k, digits))

            for batch in batches:  # rows come by document; the last one of a batch may go on
                if not batch.num_rows:
                    continue
                docs = batch.column("doc").to_numpy(zero_copy_only=False)
                last = int(np.flatnonzero(docs != docs[-1])[-1]) + 1 if (docs != docs[-1]).any() else 0
                if last:
                    settle(pa.Table.from_batches([*held, batch.slice(0, last)]))
                    held = [batch.slice(last)]
                elif held and held[-1].column("doc")[-1].as_py() != docs[0]:
                    settle(pa.Table.from_batches(held))
                    held = [batch]
                else:
                    held.append(batch)
            if held:
                settle(pa.Table.from_batches(held))
            if best:
                q, d, s = (np.concatenate(c) for c in zip(*best))
                order = np.lexsort((np.unique(d, return_inverse=True)[1], -s, q))
                q, d, s = q[order], d[order], s[order]
                keep = np.arange(len(q)) - np.searchsorted(q, q) < k
                names = pa.array(w.queries).take(pa.array(q[keep]))
                yield pa.RecordBatch.from_arrays([names.cast(_arrow(kinds["query"])), pa.array(d[keep]).cast(_arrow(kinds["doc"])), pa.array(s[keep])], names=["query", "doc", "score"])

        postings = ix.postings
        if "bucket" in postings.columns:
            at = places.select(_bucket(F.col("term")).alias("b")).distinct().collect()
            postings = postings.where(F.col("bucket").isin(*[r.b for r in at])) if at else postings.limit(0)
        near = postings.join(F.broadcast(places), "term").select("t", "doc", "tf", "dl", "norm", "df")
        one = near.repartition("doc").sortWithinPartitions("doc").mapInArrow(run, schema)
        out = one if out is None else out.unionByName(one)
    return ranked(out, k)


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def bm25_measure(k1: float = K1, b: float = B) -> tuple[Callable, Callable]:
    """``weigh`` and ``value`` of :func:`_top` for :func:`bm25`."""

    def weigh(rows: list[tuple], n: int) -> list[float]:
        return [times * math.log((n - df + 0.5) / df + 1.0) for _, times, df in rows]

    def value(tf, dl, norm, df, n, avgdl):
        return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / max(avgdl, 1.0)))

    return weigh, value


def bm25(ix: Index, asked: DataFrame, k: int = CANDIDATES, k1: float = K1, b: float = B, digits: int | None = 9) -> DataFrame:
    """(query, doc, score, rank) with the inverse frequency ln((n - df + 0.5) / df + 1).

    Scores are rounded to ``digits`` before ranking, so that sums taken in another
    order rank alike. Queries without a known term give no row.
    """
    return _top(ix, asked, k, digits, *bm25_measure(k1, b))


def tfidf_measure() -> tuple[Callable, Callable]:
    """``weigh`` and ``value`` of :func:`_top` for :func:`tfidf`."""

    def weigh(rows: list[tuple], n: int) -> list[float]:
        raw = [(1 + math.log(times)) * (math.log((n + 1) / (df + 1)) + 1) for _, times, df in rows]
        length = math.sqrt(sum(x * x for x in raw)) or 1.0
        return [x / length for x in raw]

    def value(tf, dl, norm, df, n, avgdl):
        return (1 + np.log(tf)) * (np.log((n + 1) / (df + 1)) + 1) / norm

    return weigh, value


def tfidf(ix: Index, asked: DataFrame, k: int = CANDIDATES, digits: int | None = 9) -> DataFrame:
    """Cosine of sparse vectors fitted on the collection; unknown query terms count for nothing."""
    return _top(ix, asked, k, digits, *tfidf_measure())


def fuse(first: DataFrame, second: DataFrame, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists: (query, doc, score, rank_1, rank_2), ranks from 0, null if absent."""
    a = first.select("query", "doc", (F.col("rank") - 1).alias("rank_1"))
    b = second.select("query", "doc", (F.col("rank") - 1).alias("rank_2"))

    def part(c: str) -> Column:
        return F.coalesce(1.0 / (rrf_k + F.col(c) + 1), F.lit(0.0))

    return a.join(b, ["query", "doc"], "full_outer").withColumn("score", part("rank_1") + part("rank_2"))


def hits(fused: DataFrame, groups: DataFrame, k: int = TOP_K, per_group: int = PER_DOC) -> DataFrame:
    """The ``k`` best of each query with at most ``per_group`` of one group (doc, grp): (query, doc, grp, rank)."""
    order = [F.desc("score"), F.asc_nulls_last("rank_1"), F.asc_nulls_last("rank_2"), F.asc("doc")]
    own = Window.partitionBy("query", "grp").orderBy(*order)
    kept = fused.join(groups, "doc").withColumn("turn", F.row_number().over(own)).where(F.col("turn") <= per_group)
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)


def answers(found: DataFrame, texts: DataFrame, k: int = 5) -> DataFrame:
    """The extractive answer to every question: the texts (doc, text) of its first ``k`` hits, in order: (query, answer)."""
    near = found.where(F.col("rank") <= k).join(texts, "doc")  # at most k texts a question
    return near.groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: F.coalesce(x["text"], F.lit(""))), "\n").alias("answer"))


def evaluate(found: DataFrame, golden: DataFrame, answered: DataFrame | None = None, by: str = "query") -> DataFrame:
    """Per question: rank of the first hit of its gold group, hit in the first 5 and 3, reciprocal rank, and whether the answer holds what it must.

    golden: (query, gold, type, must_contain). Questions without a hit have rank
    null and count 0. ``answer_hit`` is null without answers and for questions
    that ask nothing of them; a question without an answer fails. Questions may
    share hits and answers: then ``by`` is the column of golden that names these.
    """
    first = (
        found.select(F.col("query").alias(by), "grp", "rank").join(golden.select(*dict.fromkeys(["query", by, "gold"])), by).where("grp = gold").groupBy("query").agg(F.min("rank").alias("first_rank"))
    )
    r = F.col("first_rank")
    out = golden.join(first, "query", "left")
    hit = F.lit(None).cast("int")
    if answered is not None:
        out = out.join(answered.withColumnRenamed("query", by), by, "left")
        hit = F.when(F.col("must_contain").isNotNull(), X.check_answer(F.coalesce("answer", F.lit("")), F.col("must_contain")).cast("int"))
    return out.select(
        "query",
        "type",
        "first_rank",
        F.coalesce((r <= 5).cast("int"), F.lit(0)).alias("recall_5"),
        F.coalesce((r <= 3).cast("int"), F.lit(0)).alias("precision_3"),
        F.coalesce(1.0 / r, F.lit(0.0)).alias("rr"),
        hit.alias("answer_hit"),
    )


def summary(evaluated: DataFrame, gate: float = 0.8, answer_gate: float = 0.75) -> DataFrame:
    """Means by type and over all (type ``*``), with the gates on recall and answers, in one grouping-sets pass.

    No questions give no row. Without answers the recall alone decides.
    """
    return (
        evaluated.withColumn("type", F.coalesce("type", F.lit("unknown")))
        .rollup("type")
        .agg(
            F.count("*").alias("n"),
            F.round(F.avg("recall_5"), 6).alias("recall_5"),
            F.round(F.avg("precision_3"), 6).alias("precision_3"),
            F.round(F.avg("rr"), 6).alias("mrr"),
            F.round(F.avg("answer_hit"), 6).alias("accuracy"),
        )
        .withColumn("type", F.coalesce("type", F.lit("*")))
        .withColumn("gate", (F.col("recall_5") >= gate) & F.coalesce(F.col("accuracy") >= answer_gate, F.lit(True)))
    )
