from datetime import datetime as D

from pyspark.sql import functions as F

from millrace.operators import references as R

DOCS = "path string, ingested_at timestamp, deleted_at timestamp, ref_id string"
REFS = "id long, doc string, ingested_at timestamp, period string"


def run(spark, docs, refs):
    d = R.parents_by_key(spark.createDataFrame(docs, DOCS), "path", "ingested_at", "deleted_at")
    r = R.references("t", spark.createDataFrame(refs, REFS), F.col("id"), "doc", "ingested_at")
    return sorted((x.ref_id, x.period, x.state) for x in R.find_orphans(r, d).collect())


T1, T2, T3 = D(2024, 1, 1), D(2024, 2, 1), D(2024, 3, 1)
DOC_ROWS = [
    ("a", T1, None, "x"),
    ("b", T1, T2, "x"),
    ("c", T3, None, "x"),
    ("c", T3, None, "x"),  # repeated
    ("d", T1, T2, "x"),
    ("d", T3, None, "x"),  # deleted, then registered again
    (None, T1, None, "x"),
    ("e", None, None, "x"),  # live since always
]


def test_states(spark):
    refs = [(1, "a", T2, "p"), (2, "b", T2, "p"), (3, "c", T2, "p"), (4, "zz", T2, "p"), (5, None, T2, "p"), (6, "d", T2, "p"), (7, "e", T1, "p")]
    refs += [(4, "zz", T2, "p"), (8, "c", None, "p"), (9, "A", T2, "p")]
    assert run(spark, DOC_ROWS, refs) == [
        ("2", "2024-02", "deleted"), ("3", "2024-02", "late"), ("4", "2024-02", "missing"), ("6", "2024-02", "late"), ("9", "2024-02", "missing"),
    ]


def test_empty_tables(spark):
    assert run(spark, DOC_ROWS, []) == []
    assert run(spark, [], [(1, "a", T2, "p")]) == [("1", "2024-02", "missing")]


def test_many_ranges_and_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(R, "KEYS_PER_RANGE", 20)
    monkeypatch.setattr(R, "REFS_PER_TASK", 100)
    docs = [(f"k{i:03d}", T1, None if i % 3 else T2, "x") for i in range(300)]
    refs = [(i, "k007", T2, "p") for i in range(500)] + [(1000 + i, f"k{i:03d}", T2, "p") for i in range(350)]
    refs += [(5000 + i, "k009", T2, "p") for i in range(300)]
    want = sorted(
        [(str(1000 + i), "2024-02", "deleted" if i < 300 else "missing") for i in range(350) if i >= 300 or i % 3 == 0]
        + [(str(5000 + i), "2024-02", "deleted") for i in range(300)]
    )
    assert run(spark, docs, refs) == want


def test_report_counts_each_reference_once(spark):
    d = R.parents_by_key(spark.createDataFrame(DOC_ROWS, DOCS), "path", "ingested_at", "deleted_at")
    r = R.references("t", spark.createDataFrame([(4, "zz", T2, "p")] * 3, REFS), F.col("id"), "doc", "ingested_at")
    assert [tuple(x) for x in R.orphan_report(R.find_orphans(r, d)).collect()] == [("t", "2024-02", "missing", 1)]
