"""Queries on safety screening, packing under budgets, question sets, tokens, probes and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import requests as Q
from millrace.functions import text as X
from millrace.operators import budgetpack as B
from millrace.operators import safety as S
from millrace.operators import textops as O
from millrace.plans.registry import Registry
from millrace.tables import load

R = Registry()


def _docs(spark, where):
    return load(spark, where, "documents").where("text is not null")


# -- Safety


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_SPACES = r"[\s\x0b\x{85}\pZ\x1c-\x1f]"
_PLAIN = f"translate(text, {_sql_text(S.LOOKALIKES)}, {_sql_text(S.LATIN)})"
_HITS = {
    name: " + ".join(f"len(regexp_extract_all(plain, {_sql_text('(?i)' + p.replace(chr(92) + 's', _SPACES))}))" for p in patterns)
    for name, _, _, patterns in S.RULES
} | {
    "unicode-confusables": f"len(list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{M}}]+'), lambda w: regexp_matches(w, '[{S.LOOKALIKES}]') AND regexp_matches(w, '[A-Za-z]')))",
    "unicode-invisible": r"CAST(regexp_matches(text, '\p{Cf}') AS INT)",
    "delimiter-breaking": "CASE WHEN len(regexp_extract_all(plain, '`{3,}|[-=*_#]{3,}')) >= 2 THEN len(regexp_extract_all(plain, '`{3,}|[-=*_#]{3,}')) ELSE 0 END",
    "encoded-payload": """len(list_filter(regexp_extract_all(plain, '[A-Za-z0-9+/]{40,}={0,2}|[A-Za-z0-9_-]{40,}={0,2}'), lambda x: CASE WHEN len(rtrim(x, '=')) % 4 = 1 THEN false ELSE
      5 * len(list_filter(regexp_extract_all(hex(from_base64(rpad(translate(rtrim(x, '='), '-_', '+/'), CAST(ceil(len(rtrim(x, '=')) / 4.0) * 4 AS INT), '='))), '..'), lambda h: h < '20' OR h > '7E'))
        <= 3 * len(rtrim(x, '=')) // 4 END))""",
}
_WEIGHTS = {n: w for n, _, w, _ in S.RULES} | S.OTHER_WEIGHTS
_SCAN = f"""WITH c AS (SELECT DISTINCT id, coalesce(text, '') AS text FROM chunks), p AS (SELECT *, {_PLAIN} AS plain FROM c),
h AS (SELECT id, {", ".join(f'{x} AS "{n}"' for n, x in _HITS.items())} FROM p),
s AS (SELECT *, round(least(1.0, {" + ".join(f'{w} * 2 * (1 - pow(0.5, "{n}"))' for n, w in _WEIGHTS.items())}), 6) AS score FROM h)
"""


@R.query(
    "injection_scan",
    _SCAN + f"""SELECT id, score, CASE WHEN score >= 0.7 THEN 'blocked' WHEN score >= 0.35 THEN 'suspicious' ELSE 'clean' END AS verdict,
    CAST({" + ".join(f'"{n}"' for n in _HITS)} AS INT) AS n_matches FROM s""",
)
def injection_scan(spark, where):
    """Score and verdict of every chunk under the injection rules."""
    c = load(spark, where, "chunks").dropDuplicates(["id"])
    return S.scan(c.select("id", "text")).select("id", "score", "verdict", "n_matches")


@R.query(
    "injection_families",
    _SCAN + "SELECT family, CAST(sum(n) AS BIGINT) AS n FROM (" + " UNION ALL ".join(f"""SELECT '{f}' AS family, sum("{n}") AS n FROM s""" for n, f in S.FAMILIES.items()) + ") GROUP BY 1 HAVING sum(n) > 0",
)
def injection_families(spark, where):
    return S.families(S.scan(load(spark, where, "chunks").dropDuplicates(["id"]).select("id", "text")))


@R.query("embeddable_chunks", _SCAN + "SELECT id FROM s WHERE score < 0.35")
def embeddable_chunks(spark, where):
    """Chunks whose scan is clean."""
    return S.safe_to_embed(S.scan(load(spark, where, "chunks").dropDuplicates(["id"]).select("id", "text"))).select("id")


@R.query("sanitized_chunks")
def sanitized_chunks(spark, where):
    c = load(spark, where, "chunks").dropDuplicates(["id"]).where("text is not null")
    return c.select("id", S.sanitized(F.col("text")).alias("s")).select("id", "s.text", F.array_join("s.actions", ",").alias("actions"))


def _filtered_sql(c: str) -> str:
    for n, p in S.OUTPUT_RULES:
        c = f"regexp_replace({c}, {_sql_text(p.replace(chr(92) + 's', _SPACES))}, '[FILTERED:{n}]', 'g')"
    return c


@R.query(
    "filtered_output",
    rf"""WITH f AS (SELECT doc_id, {_filtered_sql('text')} AS t FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, CAST(len(regexp_extract_all(t, '\[FILTERED:[a-z-]+\]')) AS INT) AS hits, md5(t) AS md5 FROM f""",
)
def filtered_output(spark, where):
    return _docs(spark, where).select("doc_id", S.filtered(F.col("text")).alias("f")).select("doc_id", "f.hits", F.md5("f.text").alias("md5"))


_REQ = ",\n".join(f"({i}, '{n}', {w}, '{p}')" for i, (n, w, p) in enumerate(S.REQUEST_RULES))


@R.query(
    "request_scan",
    f"""WITH rules(ord, name, w, p) AS (VALUES {_REQ}),
    h AS (SELECT doc_id, sum(w) AS score, string_agg(name || '@' || (strpos(text, regexp_extract(text, '(?i)' || p)) - 1), ',' ORDER BY ord) AS rules
      FROM documents, rules WHERE text IS NOT NULL AND regexp_matches(text, '(?i)' || p) GROUP BY 1)
    SELECT doc_id, round(CAST(coalesce(score, 0) AS DOUBLE), 4) AS score,
      CASE WHEN coalesce(score, 0) >= 0.7 THEN 'blocked' WHEN coalesce(score, 0) >= 0.35 THEN 'suspicious' ELSE 'clean' END AS verdict, coalesce(rules, '') AS rules
    FROM documents LEFT JOIN h USING (doc_id) WHERE text IS NOT NULL""",
)
def request_scan(spark, where):
    return _docs(spark, where).select("doc_id", S.request_scan(F.col("text")).alias("s")).select("doc_id", "s.score", "s.verdict", F.array_join("s.rules", ",").alias("rules"))


@R.query(
    "delimiter_runs",
    r"""WITH n AS (SELECT doc_id, len(regexp_extract_all(text, '`{3,}|[-=*_#]{3,}')) AS n, len(regexp_extract_all(text, '\p{Cf}')) AS hidden
      FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, CASE WHEN n >= 2 THEN n ELSE 0 END AS runs, hidden FROM n""",
)
def delimiter_runs(spark, where):
    c = F.col("text")
    return _docs(spark, where).select("doc_id", S.delimiter_runs(c).alias("runs"), S.hidden_characters(c).alias("hidden"))


@R.query(
    "mixed_script_words",
    f"""SELECT doc_id, len(list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{M}}]+'),
      lambda w: regexp_matches(w, '[{S.LOOKALIKES}]') AND regexp_matches(w, '[A-Za-z]'))) AS n FROM documents WHERE text IS NOT NULL""",
)
def mixed_script_words(spark, where):
    return _docs(spark, where).select("doc_id", S.mixed_script_words(F.col("text")).alias("n"))


# -- Packing under a budget

_USABLE = 6000


def _packable(spark, where):
    d = load(spark, where, "documents").select(
        F.coalesce("source", F.lit("-")).alias("grp"), F.col("doc_id").alias("id"), "text", (F.coalesce(F.length("text"), F.lit(0)) % 97).cast("double").alias("score")
    )
    return B.framed(d, 40)


_ITEMS = """WITH RECURSIVE i AS (SELECT coalesce(source, '-') AS grp, doc_id AS id, coalesce(len(text), 0) AS chars, coalesce(len(text), 0) + 40 AS cost,
  CAST(coalesce(len(text), 0) % 97 AS DOUBLE) AS score FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY {order}, id) AS rn FROM i),
p AS (SELECT grp, id, rn, cost, score, CASE WHEN cost <= 6000 THEN cost ELSE 0 END AS used, cost <= 6000 AS took FROM o WHERE rn = 1
  UNION ALL
  SELECT o.grp, o.id, o.rn, o.cost, o.score, CASE WHEN p.used + o.cost <= 6000 THEN p.used + o.cost ELSE p.used END, p.used + o.cost <= 6000
  FROM p JOIN o ON o.grp = p.grp AND o.rn = p.rn + 1)
"""


@R.query("pack_greedy", _ITEMS.format(order="-score") + "SELECT grp, id, took AS chosen FROM p")
def pack_greedy(spark, where):
    return B.greedy(_packable(spark, where), _USABLE).select("grp", "id", F.col("reason").isNull().alias("chosen"))


@R.query("pack_density", _ITEMS.format(order="-score / greatest(chars, 1)") + "SELECT grp, id, took AS chosen FROM p")
def pack_density(spark, where):
    return B.density(_packable(spark, where), _USABLE).select("grp", "id", F.col("reason").isNull().alias("chosen"))


@R.query(
    "pack_utilization",
    _ITEMS.format(order="-score")
    + "SELECT grp, count(*) AS n, CAST(sum(cost) AS BIGINT) AS used, round(sum(score), 6) AS total, round(least(sum(cost) / 6000, 1), 4) AS utilization FROM p WHERE took GROUP BY 1",
)
def pack_utilization(spark, where):
    return B.utilization(B.greedy(_packable(spark, where), _USABLE).where("reason is null"), _USABLE)


_DP = """WITH RECURSIVE i AS (SELECT coalesce(source, '-') AS grp, doc_id AS id, coalesce(len(text), 0) + 40 AS cost, CAST(coalesce(len(text), 0) % 97 AS DOUBLE) AS score FROM documents),
t AS (SELECT *, row_number() OVER (PARTITION BY grp, cost ORDER BY score DESC, id) AS turn FROM i WHERE cost <= 6000 AND score > 0),
o AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY id) AS rn FROM t WHERE turn * cost <= 6000),
p AS (SELECT DISTINCT grp, CAST(0 AS BIGINT) AS rn, list_transform(range(6001), lambda x: CAST(0 AS DOUBLE)) AS best FROM o
  UNION ALL
  SELECT p.grp, o.rn, list_transform(range(6001), lambda c: CASE WHEN c >= o.cost AND p.best[c - o.cost + 1] + o.score > p.best[c + 1] THEN p.best[c - o.cost + 1] + o.score ELSE p.best[c + 1] END)
  FROM p JOIN o ON o.grp = p.grp AND o.rn = p.rn + 1)
SELECT grp, round(max(list_max(best)), 6) AS total FROM p GROUP BY 1"""


@R.query("pack_exact", _DP)
def pack_exact(spark, where):
    """The best total per source."""
    return B.utilization(B.exact(_packable(spark, where), _USABLE), _USABLE).select("grp", "total")


# -- Chunks, question sets, tokens


@R.query("markdown_chunks")
def markdown_chunks(spark, where):
    d = _docs(spark, where).select(F.concat(F.lit("doc-"), F.col("doc_id")).alias("doc"), F.col("text").alias("md"))
    return O.chunk_markdown(d)


_W, _SP = r"\pL\pN_", r"\s\x0b\x{85}\pZ\x1c-\x1f"
_DEF = rf"(?i)^(?:the[{_SP}]+)?([A-Za-z][{_W}{_SP}-]{{2,60}}?)[{_SP}]+(is|are|was|were)[{_SP}]+([a-z0-9][^\n]{{8,200}}?)[.{_SP}]*$"
_CNT = rf"^[^\n]*?([A-Za-z][{_W}{_SP}-]{{2,50}}?)[{_SP}]+(?:has|have|had|contains?|includes?|supports?)[{_SP}]+(\p{{Nd}}[\p{{Nd}},]*)([{_SP}]+[{_W}]+)?"
_LEAD = rf"^(\p{{Nd}}[\p{{Nd}},]*)[{_SP}]+([{_W}]+)"


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^[{_SP}]+|[{_SP}]+$', '', 'g')"


_QA = rf"""WITH s0 AS (SELECT doc_id, string_split_regex(regexp_replace(text, '([.!?])[{_SP}]+', '\1' || chr(0), 'g'), chr(0)) AS l FROM documents WHERE text IS NOT NULL),
s1 AS (SELECT doc_id, list_filter(list_transform(l, lambda x: {_strip_sql('x')}), lambda x: len(x) > 30 AND len(x) < 400) AS l FROM s0),
s AS (SELECT doc_id, unnest(l) AS s, unnest(range(len(l))) AS pos FROM s1),
x AS (SELECT *, {_strip_sql(f"regexp_extract(s, '{_DEF}', 1)")} AS sub, regexp_extract(s, '{_DEF}', 2) AS verb, {_strip_sql(f"regexp_extract(s, '{_DEF}', 3)")} AS rest,
  regexp_matches(s, '{_DEF}') AS def, regexp_matches(s, '{_CNT}') AS cnt, {_strip_sql(f"regexp_extract(s, '{_CNT}', 1)")} AS who, regexp_extract(s, '{_CNT}', 2) AS num,
  {_strip_sql(f"regexp_extract(s, '{_CNT}', 3)")} AS what,
  list_filter(regexp_extract_all(s, '[{_W}]+'), lambda w: regexp_matches(w, '^[A-Z][a-z]{{2,}}$') AND lower(w) NOT IN ('the','she','he','they','it','a','an','one','his','her'))[1] AS name,
  len(regexp_extract_all(s, '[^{_SP}]+')) AS words FROM s),
y AS (SELECT *, regexp_extract(rest, '{_LEAD}', 1) AS lead, regexp_extract(rest, '{_LEAD}', 2) AS unit, sub || ' ' || verb || ' ' || rest AS whole FROM x),
p AS (SELECT doc_id, pos, s AS source,
  CASE WHEN def THEN CASE WHEN lead <> '' THEN 'numeric' ELSE 'definition' END WHEN cnt THEN 'numeric' WHEN name IS NOT NULL AND words >= 8 THEN 'cloze' END AS kind,
  CASE WHEN def THEN CASE WHEN lead <> '' THEN 'How many ' || unit || ' does ' || lower(sub[1]) || sub[2:] || ' have?' ELSE 'What ' || verb || ' ' || sub || '?' END
    WHEN cnt THEN CASE WHEN what <> '' THEN 'How many ' || what || ' does ' || who || ' have?' ELSE 'What number is associated with ' || who || '?' END
    ELSE 'Fill in the blank: ' || substr(s, 1, strpos(s, name) - 1) || '_____' || substr(s, strpos(s, name) + len(name)) END AS question,
  CASE WHEN def THEN CASE WHEN lead <> '' THEN lead ELSE upper(whole[1]) || regexp_replace(whole[2:], '\.+$', '') || '.' END WHEN cnt THEN num ELSE name END AS answer FROM y),
g AS (SELECT * FROM p WHERE kind IS NOT NULL AND len(question) >= 15 AND len(answer) > 0 AND len(regexp_extract_all(answer, '[^{_SP}]+')) BETWEEN 1 AND 60 AND NOT contains(lower(question), lower(answer))),
f AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY doc_id, lower(question) ORDER BY pos) = 1)
"""


@R.query("qa_pairs", _QA + "SELECT doc_id, pos, kind, question, answer, source FROM f")
def qa_pairs(spark, where):
    return O.qa_pairs(load(spark, where, "documents"))


@R.query(
    "qa_eval_set",
    _QA + """, u AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY lower(question) ORDER BY doc_id, pos) = 1),
    n AS (SELECT *, row_number() OVER (ORDER BY doc_id, pos) - 1 AS k FROM u)
    SELECT 'docs-' || CASE WHEN k < 1000 THEN lpad(CAST(k AS VARCHAR), 3, '0') ELSE CAST(k AS VARCHAR) END AS case_id, question, answer AS expected, kind AS type, source FROM n""",
)
def qa_eval_set(spark, where):
    return O.eval_set(O.qa_pairs(load(spark, where, "documents")), "docs")


@R.query(
    "bpe_best_pair",
    r"""WITH b AS (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS l FROM documents WHERE text IS NOT NULL),
    p AS (SELECT doc_id, unnest(l[:-2]) AS a, unnest(l[2:]) AS z, unnest(range(len(l) - 1)) AS pos FROM b WHERE len(l) > 1),
    n AS (SELECT a, z, count(*) AS n, min({'d': doc_id, 'p': pos}) AS first FROM p GROUP BY ALL)
    SELECT CAST(('0x' || a) AS INT) AS "left", CAST(('0x' || z) AS INT) AS "right", n FROM n WHERE n > 1 ORDER BY n DESC, first LIMIT 1""",
)
def bpe_best_pair(spark, where):
    """The most frequent pair of bytes, ties to the first seen."""
    d = _docs(spark, where).select("doc_id", O.byte_ids(F.col("text")).alias("ids"))
    return O.best_pair(O.id_pair_counts(d)).select("left", "right", "n")


@R.query(
    "bpe_pair_counts",
    """WITH c AS (SELECT string_split(lower(text), '') AS l FROM documents WHERE len(text) > 1),
    p AS (SELECT unnest(l[:-2]) AS "left", unnest(l[2:]) AS "right" FROM c)
    SELECT "left", "right", count(*) AS n FROM p GROUP BY ALL""",
)
def bpe_pair_counts(spark, where):
    return O.pair_counts(load(spark, where, "documents"))


@R.query(
    "bpe_roundtrip",
    """SELECT doc_id, CAST(strlen(text) - len(regexp_extract_all(text, 'th')) - len(regexp_extract_all(text, 'the')) - len(regexp_extract_all(text, ' the'))
      - len(regexp_extract_all(text, 'in')) AS INT) AS n_ids, true AS same FROM documents WHERE text IS NOT NULL""",
)
def bpe_roundtrip(spark, where):
    """Ids per text under a given table of merges, and whether they decode to the text again."""
    merges = spark.createDataFrame([(0, 116, 104), (1, 256, 101), (2, 32, 257), (3, 105, 110)], "rank int, left int, right int")
    d = O.bpe_encode(_docs(spark, where).select("doc_id", "text"), merges)
    return O.bpe_decode(d, merges).select("doc_id", F.size("ids").alias("n_ids"), (F.col("decoded") == F.col("text")).alias("same"))


@R.query(
    "shingle_counts",
    """WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, CASE WHEN len(w) >= 5 THEN len(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))))
      WHEN len(w) > 0 THEN 1 ELSE 0 END AS n FROM w""",
)
def shingle_counts(spark, where):
    return _docs(spark, where).select("doc_id", F.size(X.shingles(F.col("text"))).alias("n"))


@R.query(
    "stemmed_terms",
    """WITH t AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9$%][a-z0-9._%]*')) AS t FROM documents),
    s AS (SELECT CASE WHEN regexp_matches(t, '(sses|xes|ches|shes|zes)$') THEN t[:-3] WHEN ends_with(t, 'ies') AND len(t) > 4 THEN t[:-4] || 'y'
      WHEN ends_with(t, 'ing') AND len(t) >= 6 THEN t[:-4] WHEN ends_with(t, 'ed') AND len(t) >= 5 THEN t[:-3]
      WHEN ends_with(t, 's') AND len(t) >= 4 AND NOT regexp_matches(t, '(ss|us|is)$') THEN t[:-2] ELSE t END AS term FROM t)
    SELECT term, count(*) AS n FROM s GROUP BY 1""",
)
def stemmed_terms(spark, where):
    return _docs(spark, where).select(F.explode(X.tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@R.query(
    "sentence_lengths",
    r"""WITH s AS (SELECT doc_id, unnest(string_split_regex(regexp_replace(text, '([.!?])[\s\x0b\x{85}\pZ\x1c-\x1f]+', '\1' || chr(0), 'g'), chr(0))) AS s FROM documents WHERE text IS NOT NULL),
    t AS (SELECT doc_id, regexp_replace(s, '^[\s\x0b\x{85}\pZ\x1c-\x1f]+|[\s\x0b\x{85}\pZ\x1c-\x1f]+$', '', 'g') AS s FROM s)
    SELECT doc_id, count(*) AS n, sum(len(s)) AS chars FROM t WHERE len(s) > 30 AND len(s) < 400 GROUP BY 1""",
)
def sentence_lengths(spark, where):
    s = _docs(spark, where).select("doc_id", F.explode(X.sentences(F.col("text"))).alias("s"))
    return s.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("s")).alias("chars"))


# -- Probes, prompts, answers

_WORDS = ("account", "payout", "index", "vector", "account rules", "drawdown")


@R.query(
    "keyword_coverage",
    """WITH d AS (SELECT coalesce(section, '-') AS domain, text FROM documents),
    r AS (SELECT domain, round(len(list_filter(['account', 'payout', 'index', 'vector', 'account rules', 'drawdown'], lambda k: contains(lower(coalesce(text, '')), k))) / 6.0, 4) AS rate FROM d),
    s AS (SELECT domain, round(avg(rate), 4) AS score FROM r GROUP BY 1)
    SELECT domain, score, row_number() OVER (ORDER BY score, domain) AS rank FROM s""",
)
def keyword_coverage(spark, where):
    return _scores(spark, where)


def _scores(spark, where):
    probes = load(spark, where, "documents").select(
        F.coalesce("section", F.lit("-")).alias("domain"), F.coalesce("text", F.lit("")).alias("reply"), F.array(*map(F.lit, _WORDS)).alias("keywords")
    )
    return O.domain_scores(probes)


@R.query(
    "study_plan",
    """WITH d AS (SELECT coalesce(section, '-') AS domain, text, doc_id FROM documents),
    r AS (SELECT domain, round(len(list_filter(['account', 'payout', 'index', 'vector', 'account rules', 'drawdown'], lambda k: contains(lower(coalesce(text, '')), k))) / 6.0, 4) AS rate FROM d),
    s AS (SELECT domain, round(avg(rate), 4) AS score FROM r GROUP BY 1),
    k AS (SELECT domain, row_number() OVER (ORDER BY score, domain) AS rank FROM s),
    t AS (SELECT domain, doc_id AS text_id, row_number() OVER (PARTITION BY domain ORDER BY doc_id) AS turn FROM d)
    SELECT domain, rank, turn, text_id FROM t JOIN k USING (domain) WHERE turn <= CASE WHEN rank <= 2 THEN 4 ELSE 2 END""",
)
def study_plan(spark, where):
    texts = load(spark, where, "documents").select(F.coalesce("section", F.lit("-")).alias("domain"), F.col("doc_id").alias("ord"), F.col("doc_id").alias("text_id"))
    return O.study_plan(_scores(spark, where), texts)


@R.query(
    "answer_checks",
    """WITH g AS (SELECT DISTINCT id, gold_doc, must_contain FROM golden WHERE must_contain IS NOT NULL AND gold_doc IS NOT NULL),
    c AS (SELECT DISTINCT id AS chunk, doc, text FROM chunks WHERE text IS NOT NULL)
    SELECT g.id, count(*) AS n_chunks, count(*) FILTER (len(list_filter(must_contain, lambda alts: len(list_filter(alts, lambda a: contains(lower(text), lower(a)))) > 0)) = len(must_contain)) AS n_right
    FROM g JOIN c ON c.doc = g.gold_doc GROUP BY 1""",
)
def answer_checks(spark, where):
    """How many chunks of the gold file hold all that an answer must contain."""
    g = load(spark, where, "golden").dropDuplicates(["id"]).where("must_contain is not null and gold_doc is not null")
    c = load(spark, where, "chunks").dropDuplicates(["id"]).where("text is not null").select("doc", "text")
    both = g.join(c, g.gold_doc == c.doc)
    return both.groupBy("id").agg(F.count("*").alias("n_chunks"), F.count_if(X.check_answer(F.col("text"), F.col("must_contain"))).alias("n_right"))


@R.query(
    "fault_verdicts",
    """WITH e AS (SELECT item_id, answer, answer AS expected, k,
      CASE k WHEN 0 THEN 'The result is ' || answer || '.' WHEN 1 THEN 'The result is ' || translate(answer, '0123456789', '5678901234') || '.'
        WHEN 2 THEN 'Sorry, the tool failed.' ELSE '' END AS reply FROM eval_items, range(4) t(k)),
    v AS (SELECT k, CASE WHEN reply = '' THEN 'crashed'
      WHEN len(list_filter(regexp_extract_all(expected, '[0-9]+'), lambda d: NOT contains(lower(reply), d))) = 0
        AND len(list_filter(string_split(lower(expected), ' '), lambda w: len(w) > 2 AND NOT contains(lower(reply), w))) = 0 THEN 'correct_with_faults'
      WHEN contains(lower(reply), 'sorry') OR contains(lower(reply), 'failed') THEN 'degraded' ELSE 'silent_failure' END AS verdict FROM e)
    SELECT k, verdict, count(*) AS n FROM v GROUP BY ALL""",
)
def fault_verdicts(spark, where):
    """Verdicts over held-out answers, healthy and corrupted."""
    e = load(spark, where, "eval_items").select("answer", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("k"))
    say = lambda c: F.concat(F.lit("The result is "), c, F.lit("."))
    reply = (
        F.when(F.col("k") == 0, say(F.col("answer")))
        .when(F.col("k") == 1, say(O.corrupt("wrong", F.col("answer"))))
        .when(F.col("k") == 2, "Sorry, the tool failed.")
        .otherwise("")
    )
    return e.select("k", O.recovery(F.col("answer"), reply).alias("verdict")).groupBy("k", "verdict").agg(F.count("*").alias("n"))


@R.query(
    "prompt_suite",
    """WITH c AS (SELECT suite AS prompt, 'Item ' || item_id || ' of ' || suite || ': ' || answer AS reply, answer FROM eval_items),
    k AS (SELECT prompt, contains(lower(reply), lower(answer)) AND len(reply) <= 26 AND NOT contains(lower(reply), '7') AS ok FROM c)
    SELECT prompt, count(*) FILTER (ok) AS passed, count(*) FILTER (NOT ok) AS failed FROM k GROUP BY 1""",
)
def prompt_suite(spark, where):
    """Templates rendered from slots, checked by assertions."""
    values = F.create_map(F.lit("id"), F.col("item_id").cast("string"), F.lit("suite"), F.col("suite"), F.lit("answer"), F.col("answer"))
    a = lambda kind, arg: F.struct(F.lit(kind).alias("kind"), arg.alias("arg"))
    cases = load(spark, where, "eval_items").select(
        F.col("suite").alias("prompt"), O.render(F.lit("Item {id} of {suite}: {answer}"), values).alias("reply"),
        F.array(a("contains", F.col("answer")), a("max_length", F.lit("26")), a("not_contains", F.lit("7"))).alias("assertions"),
    )
    return O.suite(cases)


# -- Costs, fingerprints, gates


@R.query(
    "token_costs",
    """SELECT coalesce(source, '-') AS source, CAST(sum(floor(len(coalesce(text, '')) / 4)) AS BIGINT) AS tokens,
    round(sum(floor(len(coalesce(text, '')) / 4)) / 1000 * 0.002 + count(*) * 100 / 1000 * 0.006, 6) AS usd FROM documents GROUP BY 1""",
)
def token_costs(spark, where):
    d = load(spark, where, "documents").withColumn("t", Q.token_estimate(F.col("text")))
    g = d.groupBy(F.coalesce("source", F.lit("-")).alias("source")).agg(F.sum("t").alias("tokens"), F.count("*").alias("n"))
    return g.select("source", "tokens", F.round(Q.cost_usd(F.col("tokens"), F.col("n") * 100), 6).alias("usd"))


@R.query(
    "dedup_miss",
    "SELECT k / 10.0 AS similarity, round(pow(1 - pow(k / 10.0, 4), 16), 9) AS miss FROM range(11) t(k)",
)
def dedup_miss(spark, where):
    """How likely a min-hash index misses a pair, by its similarity."""
    return spark.range(11).select((F.col("id") / 10.0).alias("similarity")).withColumn("miss", F.round(Q.lsh_miss(F.col("similarity")), 9))


@R.query("doc_fingerprints", "SELECT doc_id, sha256(text)[:16] AS fp FROM documents WHERE text IS NOT NULL")
def doc_fingerprints(spark, where):
    return _docs(spark, where).select("doc_id", Q.fingerprint(F.col("text")).alias("fp"))


@R.query(
    "story_gate",
    r"""SELECT doc_id, len(regexp_extract_all(text, '[^\s\x0b\x{85}\pZ\x1c-\x1f]+')) BETWEEN 80 AND 400
      AND NOT regexp_matches(regexp_replace(text, '^[\s\x0b\x{85}\pZ\x1c-\x1f]+', ''), '(?i)^(#|\d+\.|here(''|’)s|sure|certainly)') AS kept
    FROM documents WHERE text IS NOT NULL""",
)
def story_gate(spark, where):
    return _docs(spark, where).select("doc_id", Q.story_gate(F.col("text")).alias("kept"))
