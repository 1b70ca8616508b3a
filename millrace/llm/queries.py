"""The pN_ queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.llm import knn, leakage, mixing, mojibake, neardup, packing, pii, splitting
from millrace.plans.registry import Registry
from millrace.tables import bounded, load

R = Registry()

#: Rows of size_limits at most.
MAX_LIMITS = 1000


def _limits(spark, where, purpose: str) -> list:
    rows = bounded(load(spark, where, "size_limits").where(F.col("purpose") == purpose), MAX_LIMITS, "size_limits")
    return sorted(rows, key=lambda r: r.limit_name)


def _packed(spark, where):
    limits = [(r.limit_name, r.max_tokens) for r in _limits(spark, where, "pack")]
    return packing.pack_chunks(load(spark, where, "chunks"), limits)


@R.query("p2_windows")
def p2_windows(spark, where):
    """Chunk-to-window assignments for every pack capacity."""
    return _packed(spark, where)


_WORDS = r"""w AS (SELECT id, max(len(regexp_extract_all(text, '[^ \t\n\r]+'))) AS n FROM chunks GROUP BY 1)"""


@R.query(
    "p2_whole",
    f"""WITH {_WORDS} SELECT limit_name, id AS chunk_id, n AS n_words, CAST(ceil(n / max_tokens) AS BIGINT) AS parts, 0 AS faults
    FROM w, size_limits WHERE purpose = 'pack' AND n > 0""",
)
def p2_whole(spark, where):
    """What a packing must keep: every word of every chunk once, chunks cut only above the capacity, no window above it or with a wrong fill."""
    w = _packed(spark, where)
    fill = Window.partitionBy("limit_name", "window_id")
    begins = F.lag(F.col("first_word") + F.col("n_words"), 1, 0).over(Window.partitionBy("limit_name", "chunk_id").orderBy("first_word"))
    bad = (F.sum("n_words").over(fill) > F.col("capacity")) | (F.sum("n_words").over(fill) != F.col("window_words")) | (begins != F.col("first_word"))
    return w.withColumn("bad", bad.cast("int")).groupBy("limit_name", "chunk_id").agg(
        F.sum("n_words").alias("n_words"), F.count("*").alias("parts"), F.sum("bad").cast("int").alias("faults")
    )


@R.query("p2_fill")
def p2_fill(spark, where):
    """Windows and fill reached for every pack capacity."""
    return packing.fill_report(_packed(spark, where))


def _split(spark, where):
    (limit,) = _limits(spark, where, "split")
    return splitting.split_oversized(load(spark, where, "chunks"), limit.max_tokens, limit.overlap_tokens)


@R.query("p5_pieces")
def p5_pieces(spark, where):
    """Pieces of all oversized chunks."""
    return _split(spark, where)


@R.query(
    "p5_whole",
    f"""WITH {_WORDS}, l AS (SELECT max_tokens AS m FROM size_limits WHERE purpose = 'split')
    SELECT id, n AS new_words, md5(text) AS md5, 0 AS faults FROM w JOIN (SELECT DISTINCT id, text FROM chunks) USING (id), l WHERE n > m""",
)
def p5_whole(spark, where):
    """What a split must keep: every word once, the text itself, and pieces within the limit with the stated words and overlap."""
    (limit,) = _limits(spark, where, "split")
    w = Window.partitionBy("id").orderBy("piece")
    words = F.regexp_extract_all("text", F.lit(f"({splitting.WORD_JVM})"))
    rows = _split(spark, where).withColumn("w", words).withColumn("before", F.lag("w").over(w)).withColumn("until", F.lag("end_char").over(w))
    shared = F.coalesce(F.slice("before", -F.col("overlap_words"), F.col("overlap_words")) == F.slice("w", F.lit(1), F.col("overlap_words")), F.lit(False))
    later = F.col("piece") > 0
    bad = (F.size("w") != F.col("n_words")) | (F.col("n_words") > limit.max_tokens) | (later & ((F.col("overlap_words") != limit.overlap_tokens) | ~shared))
    # Without its overlap a piece begins where the one before it ends.
    new = F.when(later, F.substring("text", F.col("until") - F.col("start_char") + 1, F.length("text"))).otherwise(F.col("text"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", new.alias("t")))), lambda x: x["t"]), "")  # one chunk's pieces
    return (
        rows.withColumn("bad", bad.cast("int"))
        .groupBy("id")
        .agg(F.sum(F.col("n_words") - F.col("overlap_words")).alias("new_words"), joined.alias("joined"), F.min("start_char").alias("lead"), F.sum("bad").cast("int").alias("faults"))
        .select("id", "new_words", F.md5("joined").alias("md5"), (F.col("faults") + F.when(F.col("lead") != 0, 1).otherwise(0)).alias("faults"))
    )


@R.query(
    "p5_found",
    r"""SELECT DISTINCT id FROM chunks
    WHERE len(regexp_extract_all(text, '[^ \t\n\r]+')) > (SELECT max_tokens FROM size_limits WHERE purpose = 'split')""",
)
def p5_found(spark, where):
    """Oversized chunks, from the pieces they were cut into: each has exactly one first piece."""
    return _split(spark, where).where("piece = 0").select("id")


@R.query("p8_mix")
def p8_mix(spark, where):
    """The chosen documents with their repeats."""
    return mixing.mix(load(spark, where, "documents"), load(spark, where, "mix_targets"))[0]


@R.query("p8_shares")
def p8_shares(spark, where):
    """Shares reached by every target."""
    return mixing.mix(load(spark, where, "documents"), load(spark, where, "mix_targets"))[1]


@R.query(
    "p8_bounds",
    """WITH t AS (SELECT source, max(target_share) AS s, min(max_repeats) AS r FROM mix_targets WHERE source IS NOT NULL GROUP BY 1)
    SELECT t.source, r AS max_repeats, (SELECT count(*) FROM documents d WHERE d.source = t.source) AS n_rows, true AS within, true AS near FROM t""",
)
def p8_bounds(spark, where):
    """What a mix must keep: no document above its repeats, only documents of the source, and tokens within one document of the goal."""
    d, t = load(spark, where, "documents"), load(spark, where, "mix_targets")
    chosen, shares = mixing.mix(d, t)
    rows = d.groupBy("source").agg(F.count("*").alias("n_rows"))
    own = chosen.join(d.select("doc_id", F.col("source").alias("of")), "doc_id").groupBy("source").agg(
        F.max("repeats").alias("most"), F.max("n_tokens").alias("longest"), F.bool_and(F.col("of") == F.col("source")).alias("mine")
    )
    out = shares.drop("most_repeats").join(own, "source", "left").join(rows, "source", "left")
    gives = F.least(F.col("goal_tokens"), F.col("n_tokens") * F.col("max_repeats"))
    return out.select(
        "source", "max_repeats", F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        ((F.coalesce("most", F.lit(0)) <= F.col("max_repeats")) & F.coalesce("mine", F.lit(True))).alias("within"),
        (F.abs(F.col("chosen_tokens") - gives) <= F.coalesce("longest", F.lit(0))).alias("near"),
    )


#: The key of the pseudonyms in the queries; a production run passes a secret one.
DEMO_KEY = b"millrace-demo-key"


@R.query("p4_found")
def p4_found(spark, where):
    """Items of personal information with their places and kinds."""
    return pii.find_items(load(spark, where, "doc"), load(spark, where, "people_names")).select("id", "kind", "start_pos")


@R.query("p4_masked")
def p4_masked(spark, where):
    """Every text with typed placeholders and format-preserving pseudonyms."""
    return pii.mask_docs(load(spark, where, "doc"), load(spark, where, "people_names"), DEMO_KEY)


@R.query(
    "p7_found",
    """WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL),
    i AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM eval_items WHERE text IS NOT NULL),
    ds AS (SELECT doc_id, array_to_string(w[k : k + 11], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d)),
    si AS (SELECT item_id, array_to_string(w[k : k + 11], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i))
    SELECT DISTINCT doc_id, item_id FROM ds JOIN si USING (s)""",
)
def p7_found(spark, where):
    """Documents and the items that leaked into them."""
    return leakage.find_leaks(load(spark, where, "documents"), load(spark, where, "eval_items")).select("doc_id", "item_id")


@R.query("p7_near")
def p7_near(spark, where):
    """Leaks with up to two edits in a passage of twelve words."""
    return leakage.find_leaks(load(spark, where, "documents"), load(spark, where, "eval_items"), edits=2, exact=False)


@R.query(
    "p7_contained",
    "SELECT count(DISTINCT doc_id) * 0 AS lost FROM documents",
)
def p7_contained(spark, where):
    """Exact leaks that the search with edits misses: there must be none."""
    return p7_found(spark, where).join(p7_near(spark, where).select("doc_id", "item_id"), ["doc_id", "item_id"], "left_anti").agg(F.count("*").alias("lost"))


@R.query("p9_found")
def p9_found(spark, where):
    """Documents with a stretch garbled by a wrong decoding."""
    return mojibake.find_garbled(load(spark, where, "documents")).select("doc_id")


@R.query("p9_restored")
def p9_restored(spark, where):
    """Those documents with their text restored as far as possible."""
    return mojibake.find_garbled(load(spark, where, "documents"))


_SETS = """WITH RECURSIVE d AS (SELECT DISTINCT id, source, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM doc WHERE text IS NOT NULL AND id IS NOT NULL),
s AS (SELECT id, unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')))) AS s FROM d WHERE len(w) >= 5),
n AS (SELECT id, count(*) AS n FROM s GROUP BY 1),
b AS (SELECT x.id AS a, y.id AS b, count(*) AS common FROM s x JOIN s y ON x.s = y.s AND x.id < y.id GROUP BY 1, 2),
p AS (SELECT a, b FROM b JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE common >= 0.7 * (x.n + y.n - common))"""
_GROUPS = (
    _SETS
    + """, e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), c AS (SELECT a AS id, a AS root FROM e UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.id),
g AS (SELECT id, min(root) AS group_id FROM c GROUP BY 1)"""
)


@R.query("p3_found", _SETS + " SELECT a AS id_a, b AS id_b FROM p")
def p3_found(spark, where):
    """Pairs of intake texts with similarity of at least 0.7."""
    return neardup.similar_pairs(load(spark, where, "doc"))


@R.query("p3_groups")
def p3_groups(spark, where):
    """Documents with their group of largely equal texts."""
    return neardup.groups(load(spark, where, "doc"))


@R.query("p3_members", _GROUPS + " SELECT id, source, group_id FROM g JOIN (SELECT DISTINCT id, source FROM doc) USING (id)")
def p3_members(spark, where):
    """Every document of a group and the group's least id."""
    return neardup.groups(load(spark, where, "doc")).select("id", "source", "group_id")


@R.query(
    "p3_report",
    _GROUPS
    + """ SELECT group_id, count(*) AS n_docs, count(DISTINCT coalesce(source, '')) AS n_sources, list_sort(list_distinct(list(coalesce(source, '')))) AS sources
    FROM g JOIN (SELECT DISTINCT id, source FROM doc) USING (id) GROUP BY 1""",
)
def p3_report(spark, where):
    """Size of every group and the sources it spans."""
    return neardup.group_report(neardup.groups(load(spark, where, "doc")))


@R.query(
    "p6_found",
    """WITH u AS (SELECT DISTINCT chunk_id AS id, kind, CAST(vec AS DOUBLE[]) AS v FROM vectors
      WHERE vec IS NOT NULL AND len(vec) = dim AND len(list_filter(vec, lambda x: isnan(x) OR x IS NULL)) = 0
        AND len(list_filter(vec, lambda x: x <> 0)) > 0),
    s AS (SELECT a.id AS a, b.id AS b, a.kind, list_cosine_similarity(a.v, b.v) AS c
      FROM u a JOIN u b ON a.kind = b.kind AND len(a.v) = len(b.v) AND a.id <> b.id),
    r AS (SELECT a, b, c, row_number() OVER (PARTITION BY kind, a ORDER BY c DESC, b) AS rk FROM s WHERE c >= 0.9)
    SELECT DISTINCT least(a, b) AS chunk_a, greatest(a, b) AS chunk_b FROM r WHERE rk <= 5""",
)
def p6_found(spark, where):
    """Close pairs of vectors of one kind."""
    return knn.close_pairs(load(spark, where, "vectors"))


@R.query("p6_knn")
def p6_knn(spark, where):
    """The ten most similar vectors of every vector whose chunk id is divisible by 20, searched more widely."""
    rows = load(spark, where, "vectors")
    return knn.nearest(rows, 10, queries=F.col("chunk_id") % 20 == 0, extra_cells=10, trees=8, extra_leaves=48)
