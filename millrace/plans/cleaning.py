"""Queries on corpus cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import scrub as S
from millrace.functions import text as X
from millrace.operators import cleaning as C
from millrace.operators import minhash
from millrace.plans.registry import Registry
from millrace.tables import load

R = Registry()

_STOP = ", ".join("'" + w + "'" for w in X.STOPWORDS)
_WS = r"\s\x0b\x{85}\pZ\x1c-\x1f"
_NORMAL = rf"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
  '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'), '\r\n?', chr(10), 'g'), '[ \t\x{{a0}}]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'),
  '^[{_WS}]+|[{_WS}]+$', '', 'g')"""


def _scores(source: str) -> str:
    """SQL of language and quality measures over a relation with doc_id and t."""
    return rf"""m AS (
  SELECT doc_id, t, len(t) AS chars, len(regexp_extract_all(t, '[^{_WS}]+')) AS words,
    len(regexp_extract_all(lower(t), '[a-z'']+')) AS lw,
    len(list_filter(regexp_extract_all(lower(t), '[a-z'']+'), lambda w: w IN ({_STOP}))) AS stops,
    len(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS ascii_letters,
    len(regexp_extract_all(t, '[^\pL\pN{_WS}]')) AS symbols,
    len(regexp_extract_all(t, '\pL')) AS letters, len(regexp_extract_all(t, '\p{{Lu}}')) AS upper_,
    len(regexp_extract_all(t, 'https?://[^\s]+')) AS urls,
    len(regexp_replace(t, '[{_WS}]', '', 'g')) AS inked,
    regexp_matches(t, '(?i)lorem ipsum') AS lorem,
    map_values(list_aggregate(list_transform(list_filter(string_split(t, chr(10)), lambda x: len(x) >= 25),
      lambda x: regexp_replace(x, '^[{_WS}]+|[{_WS}]+$', '', 'g')), 'histogram')) AS reps
  FROM {source} WHERE t IS NOT NULL),
q AS (
  SELECT *, CASE WHEN lw > 0 THEN 0.5 * least(CAST(stops AS DOUBLE) / lw / 0.35, 1) + 0.5 * least(CAST(ascii_letters AS DOUBLE) / chars / 0.75, 1) ELSE 0 END AS lang,
    CASE WHEN chars < 200 THEN 'too-short' WHEN words < 25 THEN 'too-few-words' WHEN CAST(symbols AS DOUBLE) / chars > 0.15 THEN 'symbol-soup'
         WHEN coalesce(list_max(reps), 0) >= 3 THEN 'repeated-lines' END AS hard,
    list_filter([CASE WHEN coalesce(len(list_filter(reps, lambda x: x > 1)), 0) >= 2 THEN 'repeated-lines-twice' END,
      CASE WHEN lorem THEN 'lorem-ipsum' END,
      CASE WHEN CAST(letters AS DOUBLE) / chars > 0.3 AND CAST(upper_ AS DOUBLE) / greatest(letters, 1) > 0.4 THEN 'shouting' END,
      CASE WHEN CAST(inked AS DOUBLE) / words > 9 THEN 'mean-word-length' END,
      CASE WHEN urls > greatest(words / 100, 3) THEN 'link-farm' END], lambda x: x IS NOT NULL) AS soft
  FROM m),
p AS (
  SELECT *, CASE WHEN hard IS NOT NULL THEN 0 ELSE greatest(0, round(1 - list_sum(list_transform(soft || ['none'],
      lambda r: CASE r WHEN 'repeated-lines-twice' THEN 0.4 WHEN 'lorem-ipsum' THEN 0.5 WHEN 'none' THEN 0 ELSE 0.3 END)), 6)) END AS score,
    CASE WHEN hard IS NOT NULL THEN [hard] ELSE soft END AS reasons
  FROM q)"""


@R.query("language_scores", f"WITH s AS (SELECT doc_id, text AS t FROM documents), {_scores('s')} SELECT doc_id, round(lang, 6) AS score FROM p")
def language_scores(spark, where):
    d = load(spark, where, "documents").where("text is not null")
    return d.select("doc_id", F.round(X.language_score(F.col("text")), 6).alias("score"))


@R.query(
    "quality_gate_a",
    f"WITH s AS (SELECT doc_id, text AS t FROM documents), {_scores('s')} "
    "SELECT doc_id, round(CAST(score AS DOUBLE), 6) AS score, array_to_string(reasons, ',') AS reasons FROM p",
)
def quality_gate_a(spark, where):
    d = load(spark, where, "documents").where("text is not null").withColumn("q", X.quality_a(F.col("text")))
    return d.select("doc_id", F.col("q.score").alias("score"), F.array_join("q.reasons", ",").alias("reasons"))


@R.query(
    "quality_reasons",
    f"WITH s AS (SELECT doc_id, text AS t FROM documents), {_scores('s')}, r AS (SELECT unnest(reasons) AS reason FROM p) "
    "SELECT reason, count(*) AS n FROM r GROUP BY 1",
)
def quality_reasons(spark, where):
    d = load(spark, where, "documents").where("text is not null")
    return C.reasons(d.select(X.quality_a(F.col("text"))["reasons"].alias("reasons")))


@R.query(
    "quality_gate_b",
    rf"""WITH m AS (SELECT doc_id, text AS t, len(text) AS chars, len(regexp_extract_all(text, '[\pL\pN_]+')) AS words,
      len(regexp_extract_all(text, '[^\pL\pN{_WS}]')) AS symbols, len(regexp_extract_all(text, '\pL')) AS letters,
      len(regexp_extract_all(text, '\p{{Lu}}')) AS up, len(regexp_replace(text, '[^\pL\pN_]', '', 'g')) AS wordy,
      len(regexp_extract_all(text, 'https?://[^\s]+')) AS urls, regexp_matches(text, '(?i)lorem\s+ipsum') AS lorem,
      list_max(map_values(list_aggregate(list_filter(list_transform(
        string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]'),
        lambda x: regexp_replace(x, '^[{_WS}]+|[{_WS}]+$', '', 'g')), lambda x: x <> ''), 'histogram'))) AS most
    FROM documents WHERE text IS NOT NULL),
    r AS (SELECT *, list_filter([CASE WHEN chars < 200 THEN 'too-short' END, CASE WHEN words < 25 THEN 'too-few-words' END,
      CASE WHEN chars = 0 OR CAST(symbols AS DOUBLE) / chars > 0.15 THEN 'symbol-ratio' END,
      CASE WHEN coalesce(most, 0) >= 3 THEN 'repeated-lines' END], lambda x: x IS NOT NULL) AS hard,
      list_filter([CASE WHEN letters > 0 AND CAST(up AS DOUBLE) / greatest(letters, 1) > 0.5 THEN 'shouting-caps' END,
      CASE WHEN CAST(wordy AS DOUBLE) / nullif(words, 0) > 9 THEN 'mean-word-length' END, CASE WHEN lorem THEN 'lorem-ipsum' END,
      CASE WHEN urls > 4 THEN 'link-farm' END], lambda x: x IS NOT NULL) AS soft FROM m)
    SELECT doc_id, CASE WHEN len(hard) > 0 THEN 0.0 ELSE CAST(round(1 - 0.15 * len(soft), 2) AS DOUBLE) END AS score,
      CASE WHEN len(hard) > 0 THEN 'FAIL' WHEN round(1 - 0.15 * len(soft), 2) >= 0.85 THEN 'PASS' ELSE 'WARN' END AS verdict,
      array_to_string(CASE WHEN len(hard) > 0 THEN hard ELSE soft END, ',') AS reasons FROM r""",
)
def quality_gate_b(spark, where):
    d = load(spark, where, "documents").where("text is not null").withColumn("q", X.quality_b(F.col("text")))
    return d.select("doc_id", F.col("q.score").alias("score"), F.col("q.verdict").alias("verdict"), F.array_join("q.reasons", ",").alias("reasons"))


_VERDICTS = f"""WITH s AS (SELECT doc_id, {_NORMAL} AS t FROM documents), {_scores('s')},
g AS (SELECT s.doc_id, s.t, CASE WHEN s.t IS NULL OR s.t = '' THEN 'normalize' WHEN p.lang < 0.45 THEN 'language'
        WHEN p.hard IS NOT NULL OR p.score < 0.6 THEN 'quality' END AS stage FROM s LEFT JOIN p USING (doc_id)),
v AS (SELECT doc_id, coalesce(stage, CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY md5(t), stage IS NULL) THEN 'exact-dedup' END) AS stage
      FROM g)"""


def _verdicts(spark, where):
    return C.verdicts(load(spark, where, "documents"), near=None, compose=False, scrubbed=False)


@R.query("corpus_verdicts", _VERDICTS + " SELECT doc_id, stage IS NULL AS kept, stage FROM v")
def corpus_verdicts(spark, where):
    """Verdicts of the stages that SQL can express."""
    return _verdicts(spark, where).select("doc_id", "kept", "stage")


@R.query(
    "corpus_funnel",
    _VERDICTS + """, r AS (SELECT CASE stage WHEN 'normalize' THEN 0 WHEN 'language' THEN 1 WHEN 'quality' THEN 2 WHEN 'exact-dedup' THEN 3 ELSE 5 END AS k FROM v)
    SELECT i AS ord, ['input', 'after-normalize', 'after-language', 'after-quality', 'after-exact-dedup'][i + 1] AS stage,
      (SELECT count(*) FROM r WHERE k >= i) AS n FROM range(5) t(i)""",
)
def corpus_funnel(spark, where):
    """Survivors after each stage, without the stages that SQL can't express."""
    return C.funnel(_verdicts(spark, where)).where("stage <> 'after-near-dedup'")


@R.query("corpus_drops", _VERDICTS + " SELECT stage, count(*) AS n FROM v WHERE stage IS NOT NULL GROUP BY 1")
def corpus_drops(spark, where):
    return C.drops(_verdicts(spark, where))


def _full(spark, where):
    return C.verdicts(load(spark, where, "documents"))


@R.query("corpus_clean_full")
def corpus_clean_full(spark, where):
    """All stages: composition, redaction, gates, exact and near duplicates."""
    v = _full(spark, where)
    return v.select("doc_id", "kept", "stage", "language_score", "quality_score", F.array_join("reasons", ",").alias("reasons"))


@R.query("corpus_funnel_full")
def corpus_funnel_full(spark, where):
    """Survivors after every stage of the whole pipeline."""
    return C.funnel(_full(spark, where))


@R.query("corpus_drops_full")
def corpus_drops_full(spark, where):
    return C.drops(_full(spark, where))


@R.query("corpus_example_drops", _VERDICTS + """ SELECT doc_id, stage FROM v WHERE stage IS NOT NULL ORDER BY CASE stage WHEN 'exact-dedup' THEN 2 ELSE 0 END, doc_id LIMIT 8""")
def corpus_example_drops(spark, where):
    """The first eight drops of a report."""
    return C.example_drops(_verdicts(spark, where)).select("doc_id", "stage")


@R.query("corpus_pii_totals")
def corpus_pii_totals(spark, where):
    """Redactions per kind by the sequential rules over normalised texts."""
    return C.pii_totals(C.gated(load(spark, where, "documents")))


@R.query(
    "pii_email_counts",
    f"""SELECT doc_id, len(regexp_extract_all(text, '{S.EMAIL}')) AS n_email,
    len(regexp_extract_all(regexp_replace(text, '{S.EMAIL}', '[REDACTED]', 'g'), '(?:sk-or-v1-[A-Za-z0-9_-]{{20,}}|sk-ant-[A-Za-z0-9_-]{{20,}}|sk-[A-Za-z0-9_]{{20,}}|nvapi-[A-Za-z0-9_-]{{20,}}|ghp_[A-Za-z0-9]{{30,}}|gho_[A-Za-z0-9]{{30,}}|xox[bap]-[A-Za-z0-9_-]{{10,}})')) AS n_secret
    FROM documents WHERE text IS NOT NULL""",
)
def pii_email_counts(spark, where):
    d = load(spark, where, "documents").where("text is not null")
    rest = F.regexp_replace("text", S.EMAIL, S.MARK)
    return d.select("doc_id", X.count(F.col("text"), S.EMAIL).alias("n_email"), X.count(rest, S.VENDOR_KEY).alias("n_secret"))


@R.query("pii_single_pass")
def pii_single_pass(spark, where):
    """Counts of the single-pass rule set over the intake texts."""
    d = load(spark, where, "doc").dropDuplicates(["id"]).withColumn("s", S.scrub_single_pass(F.col("text")))
    return d.select("id", *[F.col(f"s.{k}").alias(k) for k in ("email", "phone", "digit_run", "api_key", "jwt")])


@R.query(
    "exact_duplicates",
    """SELECT doc_id, md5(text) AS fingerprint, min(doc_id) OVER w AS first_key, count(*) OVER w AS copies
    FROM documents WHERE text IS NOT NULL WINDOW w AS (PARTITION BY md5(text))""",
)
def exact_duplicates(spark, where):
    return C.exact_duplicates(load(spark, where, "documents"), "text")


@R.query(
    "corpus_stats",
    r"""SELECT doc_id, len(text) AS chars, len(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS words,
    len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+'))) AS unique_words,
    len(regexp_extract_all(text, '\r\n|[\n\r]')) + CASE WHEN text = '' OR regexp_matches(text, '[\n\r]\z') THEN 0 ELSE 1 END AS lines,
    md5(text) AS md5, CAST(strlen(text) AS BIGINT) AS bytes,
    CASE WHEN len(regexp_extract_all(lower(text), '[a-z0-9_]+')) > 0 THEN round(strlen(text) / len(regexp_extract_all(lower(text), '[a-z0-9_]+')), 2) ELSE 0 END AS bytes_per_word
    FROM documents WHERE text IS NOT NULL""",
)
def corpus_stats(spark, where):
    return C.corpus_stats(load(spark, where, "documents"))


@R.query(
    "top_words",
    """WITH w AS (SELECT doc_id, unnest(l) AS word, unnest(range(len(l))) AS pos FROM
      (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS l FROM documents)),
    n AS (SELECT doc_id, word, count(*) AS n, min(pos) AS first FROM w GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rank FROM n)
    SELECT doc_id, rank, word, n FROM r WHERE rank <= 3""",
)
def top_words(spark, where):
    return C.top_words(load(spark, where, "documents"))


@R.query("near_dup_clusters_a")
def near_dup_clusters_a(spark, where):
    d = load(spark, where, "documents")
    return minhash.cluster(minhash.signatures(d, "a"), 0.8)


@R.query("near_dup_clusters_b")
def near_dup_clusters_b(spark, where):
    d = load(spark, where, "documents")
    return minhash.cluster(minhash.signatures(d, "b"), 0.8)


@R.query(
    "normalized_lengths",
    f"SELECT doc_id, len({_NORMAL}) AS n FROM documents WHERE text IS NOT NULL",
)
def normalized_lengths(spark, where):
    d = load(spark, where, "documents").where("text is not null")
    return d.select("doc_id", F.length(X.normalize(F.col("text"), compose=False)).alias("n"))
