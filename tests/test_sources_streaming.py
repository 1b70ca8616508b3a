import json

from pyspark.sql import functions as F

from millrace.operators import state as ST
from millrace.sources import files as S
from millrace.streaming import twins as W


def test_texts_and_json(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "a.TXT").write_bytes(b"caf\xc3\xa9 \xff ok")
    (tmp_path / "in" / "sub" / "b.md").write_text("# x")
    (tmp_path / "in" / "c.pdf").write_text("no")
    got = {r.id: r.text for r in S.read_texts(spark, str(tmp_path / "in")).collect()}
    assert got == {"a.TXT": "café  ok", "b.md": "# x"}
    gold = [{"id": "q", "question": "w", "must_contain": ["x", ["y", "z"]]}, {"id": "r", "question": "v"}]
    (tmp_path / "g.jsonl").write_text("\n\n".join(map(json.dumps, gold)))
    assert {r.id: r.must_contain for r in S.read_golden(spark, str(tmp_path / "g.jsonl")).collect()} == {"q": [["x"], ["y", "z"]], "r": None}
    (tmp_path / "d.json").write_text(json.dumps([{"id": "a", "text": "t", "score": 1.5}]))
    assert S.read_json_docs(spark, str(tmp_path / "d.json")).first().score == 1.5


def test_ndjson(spark, tmp_path):
    (tmp_path / "e").write_text('{"type": "meta"}\nbad\n\n{"type": "delta"}\n')
    rows = S.read_ndjson(spark, str(tmp_path / "e"), "type string").collect()
    assert [r.type for r in rows] == ["meta", None, "delta"] and rows[1]._bad == "bad"
    assert S.parse_events('{"a": 1}\n\nbad\n{"b": 2}\n{"c"') == ([{"a": 1}, {"b": 2}], '{"c"')
    d = spark.createDataFrame([("s", 2, "delta", "b"), ("s", 1, "delta", "a"), ("s", 3, "final", None)], "stream string, seq int, type string, text string")
    assert tuple(S.assemble(d).first()) == ("s", "ab", True)


def test_latest_and_merges(spark, tmp_path):
    d = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new")], "k string, at int, v string")
    assert [r.v for r in S.latest(d, "k", "at").collect()] == ["new"]
    m = spark.createDataFrame([(0, 97, 98)], "rank int, left int, right int")
    S.write_merges(m, str(tmp_path / "m"))
    assert S.read_merges(spark, str(tmp_path / "m")).collect() == m.collect()


def test_stream_equals_batch(spark, tmp_path):
    rows = [("ab"[i % 2], i, i * 700_000, i % 3 == 0) for i in range(40)]
    e = spark.createDataFrame(rows, "key string, n long, at long, failed boolean")
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    for name, twin, batch in (
        ("bucket", W.token_bucket(stream, "key", ["at", "n"], ["n"], 2, 0.5), ST.token_bucket(e, "key", ["at", "n"], 2, 0.5).select("n", "allowed", "tokens")),
        ("breaker", W.breaker(stream, "key", ["at", "n"], ["n"], 2, 3.0), ST.breaker(e.withColumnRenamed("state", "x") if "state" in e.columns else e, "key", ["at", "n"], 2, 3.0).select("n", "called", "state", "failures")),
        ("replay", W.replay(stream, "key", ["at", "n"], ["n"], 5.0), ST.replay(e, "key", ["at", "n"], 5.0).select("n", "passed")),
    ):
        q = twin.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, batch.collect()))


def test_windows_with_watermark(spark, tmp_path):
    d = spark.range(10).select(F.timestamp_seconds(F.col("id") * 1000).alias("ts"), F.lit("k").alias("key"))
    d.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    q = W.usage(s, "ts", "key").writeStream.format("memory").queryName("used").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sum(r.used for r in spark.table("used").collect()) == 10
