import json

from pyspark.sql import functions as F

from millrace.functions import requests as Q
from millrace.operators import learning as L
from millrace.operators import nearest as N
from millrace.sources import synthetic as Y


def test_body_faults():
    ok = {"model": "m", "messages": [{"role": "user", "content": ""}], "temperature": 2, "max_tokens": 1}
    assert Q.body_fault(json.dumps(ok)) is None
    for change, fault in (({"model": " "}, "model"), ({"stream": True}, "stream"), ({"messages": []}, "messages"), ({"messages": [{"role": "", "content": "x"}]}, "messages[0]"), ({"max_tokens": True}, "max_tokens"), ({"temperature": 2.1}, "temperature")):
        assert Q.body_fault(json.dumps(ok | change)) == fault
    assert Q.body_fault("[]") == Q.body_fault(None) == Q.body_fault("{") == "body"


def test_requests(spark):
    d = spark.createDataFrame([("q", 5, 5, False, "hello wor~d")], "t string, used int, quota int, anon boolean, s string")
    alphabet = "abcdefghijklmnopqrstuvwxyz "
    r = d.select(
        Q.admission(F.col("t"), F.col("used"), F.col("quota"), F.col("anon")).alias("a"), Q.cost_usd(F.lit(10), F.lit(1000)).alias("c"), Q.backoff(F.lit(2)).alias("b"),
        Q.chars_of(Q.char_ids(F.col("s"), alphabet), alphabet).alias("s"), Q.token_estimate(F.col("s")).alias("n"),
        Q.progress(F.lit("train"), F.lit("step  40 loss 1.2")).alias("p"), Q.snippet(F.lit("a\n b"), 4).alias("x"),
        Q.context(F.array(F.struct(F.lit("d").alias("doc"), F.lit("h").alias("heading"), F.lit("t").alias("text")))).alias("k"),
    ).first()
    assert (r.a, round(r.c, 5), r.b, r.s, r.n, r.p.done, r.x, r.k) == (402, 0.00602, 1.0, "hello wor d", 2, 40, "a b", "[1] (d · h)\nt")
    s = spark.createDataFrame([("body", 100)], "b string, at long").withColumn("sig", Q.signed(b"k")("b", "at"))
    assert s.select(Q.verified(F.col("sig"), F.lit(Q.sign(b"body", b"k", 100)), F.col("at"), F.lit(200)).alias("v")).first().v == "ok"
    assert s.select(Q.verified(F.col("sig"), F.lit("x"), F.col("at"), F.lit(200)).alias("v")).first().v == "signature_mismatch"
    story = "Once there was a quiet drum that nobody played. " * 12
    g = spark.createDataFrame([(story, "VERDICT: PASS"), (story, "VERDICT: FAIL"), ("Sure! " + story, "VERDICT: PASS"), ("short", "VERDICT: PASS")], "story string, grade string")
    assert L.distill(g).count() == 1


def test_inverted_lists_reach_their_recall(spark):
    points, queries = Y.planted(spark, 1000, 16, 20)
    truth = N.exact(points, queries, 10)
    assert N.recall(L.inverted_lists(points, queries, 10, 16, 8), truth).first().recall >= 0.9
    assert L.inverted_lists(points, queries, 1).join(truth.where("rank = 1").select("query", F.col("id").alias("t")), "query").where("id = t").count() >= 19
    assert L.inverted_lists(points.limit(0), queries, 1).count() == 0


def test_classifier(spark):
    z = Y.lcg(5, 400)
    rows = [([z[2 * i] + 2 * (i % 2), z[2 * i + 1] - 2 * (i % 2)], float(i % 2)) for i in range(200)]
    d = spark.createDataFrame(rows, "features array<double>, label double")
    assert L.accuracy(L.train_classifier(d)(d)).first().accuracy >= 0.9


def test_sql_functions(spark):
    assert L.register(spark) == ["scrub_pii", "word_count"]
    r = spark.sql("SELECT scrub_pii('mail a@b.org') AS s, word_count('a b\tc') AS n").first()
    assert (r.s, r.n) == ("mail [REDACTED]", 3)
