import pytest
from pyspark.sql import functions as F

from millrace.functions import scrub as S
from millrace.functions import text as X

STORY = (
    "The old lighthouse keeper walked along the shore every morning and he would look for the boats that came in with the tide. "
    "It was a good life, and most of the people in the village said that they could not think of any other way to live by the sea."
)


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "text string").select(f(F.col("text")).alias("x")).first().x


def test_normalize(spark):
    raw = "ﬁne  \t text\r\nnext\r\n\r\n\r\n\r\nlast\x07 "
    got = one(spark, raw, X.normalize)
    assert got == "fine text\nnext\n\nlast"
    assert one(spark, got, X.normalize) == got
    assert one(spark, None, X.normalize) is None and one(spark, "", X.normalize) == ""


def test_language(spark):
    assert one(spark, STORY, X.language_score) > 0.8
    assert one(spark, "ძიების ინდექსი", X.language_score) == 0
    assert one(spark, "", X.language_score) == 0


@pytest.mark.parametrize(
    ("text", "reasons", "passed"),
    [
        (STORY, [], True),
        ("short", ["too-short"], False),
        ("a" * 300, ["too-few-words"], False),
        ("!!! $$$ ### " * 60, ["symbol-soup"], False),
        ("\n".join(["this line is long enough to count here"] * 12), ["repeated-lines"], False),
        ((STORY + " lorem ipsum").upper(), ["lorem-ipsum", "shouting"], False),
    ],
)
def test_quality_a(spark, text, reasons, passed):
    got = one(spark, text, X.quality_a)
    assert (list(got.reasons), got.passed) == (reasons, passed)


def test_quality_b_names_all_hard_reasons(spark):
    got = one(spark, "?!", X.quality_b)
    assert got.verdict == "FAIL" and list(got.reasons) == ["too-short", "too-few-words", "symbol-ratio"]
    assert one(spark, STORY, X.quality_b).verdict == "PASS"


def test_scrub_sequential(spark):
    text = "Mail a.b@c.org, call +1 (555) 010-7258 77, card 4111111111111111, key sk-abcdefghijklmnopqrstuvwx, on 2026-09-20, 42."
    got = one(spark, text, S.scrub)
    assert got.counts.asDict() == {"email": 1, "secret": 1, "digit_id": 1, "phone": 1}
    assert "2026-09-20" in got.text and got.text.endswith("42.")


def test_scrub_single_pass():
    text = "x@y.org 2026-09-20 555 010 7258 12 4111111111111111 sk-abcdefghijklmnop1234 abcdef.ghijkl.mnopqr"
    got, n = S.scrub_one(text)
    assert n == {"email": 1, "phone": 1, "api_key": 1, "jwt": 1} or n.get("email") == 1
    assert "2026-09-20" in got
    assert S.scrub_one(None) == (None, {}) and S.scrub_one("") == ("", {})


@pytest.mark.parametrize(
    ("word", "stem"),
    [("boxes", "box"), ("policies", "policy"), ("trading", "trad"), ("ring", "ring"), ("closed", "clos"), ("payouts", "payout"), ("class", "class"), ("status", "status"), ("ties", "tie")],
)
def test_stem(spark, word, stem):
    assert one(spark, word, X.stem) == stem


def test_shingles_and_sentences(spark):
    assert one(spark, "a b c", X.shingles) == ["a b c"] and one(spark, "--", X.shingles) == []
    assert one(spark, "a b c d e f a b c d e", X.shingles)[0] == "a b c d e"
    assert len(one(spark, "a b c d e f a b c d e", X.shingles)) == 6
    assert one(spark, "Too short. " + STORY, X.sentences) == [s.strip() for s in STORY.split(". ")][:0] + [STORY.split(". ")[0] + ".", STORY.split(". ")[1]]


def test_keywords_and_answers(spark):
    df = spark.createDataFrame([("Alpha beta", ["ALPHA", "gamma"], [["x", "BETA"], ["alpha"]])], "t string, k array<string>, m array<array<string>>")
    r = df.select(X.keyword_rate(F.col("t"), F.col("k")), X.check_answer(F.col("t"), F.col("m")), X.keyword_rate(F.col("t"), F.array().cast("array<string>"))).first()
    assert tuple(r) == (0.5, True, 0.0)


def test_last_verdict(spark):
    assert one(spark, "verdict: fail then VERDICT: PASS", X.last_verdict) and not one(spark, "none", X.last_verdict)
