import random

import pytest

from millrace.llm import leakage as L
from millrace.llm import mixing as M
from millrace.llm import mojibake as G


def brute(doc, item, n=12):
    a, b = L.words(doc), L.words(item)
    runs = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)}
    return any(tuple(a[i : i + n]) in runs for i in range(len(a) - n + 1))


def test_leaks_against_brute_force(spark):
    rng = random.Random(2)
    vocab = [f"{c}{i}" for i in range(40) for c in "abc"] + ["a", "i"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(5, 60)))) for i in range(30)] + [(98, None), (99, "")]
    docs = []
    for d in range(60):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 80))]
        src = L.words(items[rng.randrange(30)][1])
        k, n = rng.randrange(max(1, len(src) - 8)), rng.randint(8, 20)
        at = rng.randint(0, len(w))
        docs.append((d, " ".join(w[:at]) + "; " + ", ".join(src[k : k + n]).upper() + " " + " ".join(w[at:])))
    docs += [(100, None), (101, ""), (102, "x " * 5000), (103, docs[0][1] + " ... " + docs[1][1])]
    schema = "doc_id long, text string, item_id string, words int"
    df = spark.createDataFrame([(*r, "x", 1) for r in docs + docs[:3]], schema)
    it = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, answer string")
    want = {(d, i) for d, t in docs for i, x in items if brute(t, x)}
    got = {(r.doc_id, r.item_id): r.words for r in L.find_leaks(df, it).collect()}
    assert set(got) == want and want and min(got.values()) >= 12
    assert L.find_leaks(df.limit(0), it).collect() == [] and L.find_leaks(df, it.limit(0)).collect() == []


def test_near_leaks(spark):
    item = "the clerk of the northern harbour counts seventeen crates of copper before the evening ferry leaves"
    near = item.replace("seventeen", "seventen")
    df = spark.createDataFrame([(1, "so " + near + " now"), (2, "nothing of that kind is written in this other text at all, not one passage")], "doc_id long, text string")
    it = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert [(r.doc_id, r.edits) for r in L.find_leaks(df, it, edits=2, exact=False).collect()] == [(1, 1)]


def test_every_passage_is_verified_on_its_own(spark):
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(500)]
    pick = lambda n: [rng.choice(vocab) for _ in range(n)]
    typo = lambda w: w[:1] + "z" + w[2:]
    held = pick(100)
    scattered = [typo(w) if k in (7, 22, 37, 52, 67) else w for k, w in enumerate(held)]
    dense = [typo(w) if k % 3 == 0 else w for k, w in enumerate(held)]
    exact_later = pick(5) + dense[:50] + pick(30) + held[60:72] + pick(9)
    first_letter = ["z" + held[20][1:], *held[21:31], held[31][:-1]]
    texts = [scattered, dense, exact_later, pick(3) + first_letter + pick(3), held[:11] + pick(9), pick(40)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    it = spark.createDataFrame([(7, " ".join(held))], "item_id long, text string")
    near = {r.doc_id: r for r in L.find_leaks(df, it, edits=2, exact=False).collect()}
    exact = {r.doc_id for r in L.find_leaks(df, it).collect()}
    assert exact == {0, 2} and exact <= set(near)
    assert {k for k in (0, 1, 2, 3, 5) if k in near} == {0, 2, 3} and near[0].edits == 0 and near[3].edits == 2


def test_run_behind_a_gap_of_other_words():
    long = [f"{c}longerwordofmany{c}" for c in "abcdefgh"]
    short = [f"{c}{d}" for c in "pq" for d in "rstuvw"]
    item = " ".join([*long, "one two six ten", *short])
    doc = " ".join([*long, "incomprehensibl"[:15], *short])
    assert len(item) == len(doc) and brute(doc, item)
    got = L.leaks_of(doc, L.Index([(7, item)]))
    assert [(g[0], g[1], g[2]) for g in got] == [(7, 12, 9)]


def test_near_leaks_against_plain_alignment():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return min(row)

    rng = random.Random(6)
    vocab = ["".join(rng.choice("abcde") for _ in range(rng.randint(2, 6))) for _ in range(60)]
    item = [rng.choice(vocab) for _ in range(30)]
    index = L.Index([(7, " ".join(item))], 12, 2)
    hits = 0
    for _ in range(120):
        k = rng.randrange(18)
        flat = " ".join(item[k : k + rng.randint(10, 16)])
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(flat))
            flat = flat[:at] + rng.choice(["", "x", "xx"]) + flat[at + rng.randint(0, 1) :]
        flat = " ".join(L.words("so it goes " + flat + " and ends here"))
        want = min(plain(" ".join(item[j : j + 12]), flat) for j in range(19))
        got = L.near_leaks_of(flat, index)
        assert bool(got) == (want <= 2), flat
        assert not got or want <= got[0][3] <= 2
        hits += bool(got)
    assert 20 < hits < 110


def test_banded_edits():
    assert L.banded_edits("kitten", "sitting", 3) == 3 and L.banded_edits("kitten", "sitting", 2) == 3 and L.banded_edits("", "ab", 2) == 2


def test_flight_keeps_its_totals():
    rng = random.Random(3)
    ids, tokens = list(range(400)), [rng.randint(1, 500) for _ in range(400)]
    probs = [rng.choice([0.3, 0.5, 0.0, 1.0]) for _ in ids]
    decided, left = M.flight(ids, tokens, probs)
    assert len(left) <= 2 and set(decided.values()) <= {0, 1}
    for weight in ([1] * 400, tokens):
        before = sum(p * weight[i] for i, p in zip(ids, probs))
        after = sum(v * weight[i] for i, v in decided.items()) + sum(p * weight[i] for i, _, p in left)
        assert abs(before - after) < 1e-6 * max(1, before)
    assert M.flight([], [], []) == ({}, [])


def test_plan():
    p = M.plan({"a": 1000, "b": 100}, [("a", 0.5, 1), ("b", 0.25, 2), ("c", 0.25, 3)])
    assert {k: round(v["gives"]) for k, v in p.items()} == {"a": 400, "b": 200, "c": 0}
    p = M.plan({"a": 1000, "b": 100}, [("a", 0.5, 1), ("b", 0.5, 2)], total=1000)
    assert {k: round(v["gives"]) for k, v in p.items()} == {"a": 500, "b": 200}


def test_mix(spark):
    rng = random.Random(4)
    rows = [(i, "abc"[i % 3] if i % 10 else None, " ".join(["token"] * rng.randint(1, 60)), 1, "x") for i in range(300)]
    rows += [(900, "a", None, 1, "x"), (901, "a", "", 1, "x"), (902, "zzz", "other words", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, part int, block string")
    targets = spark.createDataFrame([("a", 0.6, 2), ("b", 0.3, 1), ("c", 0.08, 3), ("none", 0.02, 1)], "source string, target_share double, max_repeats int")
    chosen, shares = M.mix(docs, targets)
    got = chosen.collect()
    assert len({r.doc_id for r in got}) == len(got)
    most = {"a": 2, "b": 1, "c": 3}
    assert all(1 <= r.repeats <= most[r.source] for r in got)
    s = {r.source: r for r in shares.collect()}
    assert abs(sum(r.share for r in s.values()) - 1) < 1e-9 and s["none"].chosen_tokens == 0 and s["none"].short_tokens > 0
    for k, t in (("a", 0.6), ("b", 0.3), ("c", 0.08)):
        assert abs(s[k].share - t / 0.98) < 0.02
    again = M.mix(docs.repartition(7), targets)[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got))
    assert M.mix(docs.limit(0), targets)[0].collect() == [] and M.mix(docs, targets.limit(0))[0].collect() == []


def test_tokens_of_long_runs():
    assert M.count_tokens(None) == M.count_tokens("") == 0
    assert M.count_tokens("a" * 100_000) > 1000
    assert M.count_tokens("hello world") == 2


CLEAN = [
    "La señal llegó tarde, así que el equipo cerró 42 posiciones según la política de riesgo.",
    "Les données reçues à l’étranger sont découpées en 90 morceaux de même durée.",
    "Für größere Konten gilt die Höchstgrenze von 60 Kontrakten, auch wenn der Markt ruhig bleibt.",
    "Команда сверила 28 записей и нашла лишние копии в архиве.",
    "Gracz zamknął 93 pozycji przed świtem, żeby nie płacić za noc.",
    "PÃO DE AÇÚCAR DA MANHÃ is a label; SÃO MARÉ and ÂNCORA too.",
    "Our partner in Århus writes Ålund and Ærlig.",
    "With √7 ≈ 43 and Ω ≠ ∂x the desk proves a bound. ├── chunks and │ └── vectors. Prices in ¥7, 54 ¢ and £94.",
    "Old keyboards print Ђ, ў and № as well as ° and ¬, and 风险 and 耐心. Гёте и Пётр. «CAFÉ»",
    "El l&iacute;mite diario se reinicia; Ma&ntilde;ana.",
    "plain ascii",
    None,
    "",
]
TRIPS = [(0, "utf-8", "cp1252"), (0, "utf-8", "latin-1"), (1, "utf-8", "cp1251"), (2, "utf-8", "mac_roman"), (1, "utf-8", "gb18030"), (2, "utf-8", "cp437"), (3, "cp1251", "latin-1"), (3, "koi8-r", "cp1251"), (4, "iso8859-2", "latin-1"), (3, "utf-8", "latin-1")]


@pytest.fixture(scope="module")
def stats():
    return G.Pairs(*G.Pairs.count(CLEAN * 30))


@pytest.mark.parametrize("text", CLEAN)
def test_clean_text_stays(stats, text):
    assert G.restore(text, stats) == (text, 0, 0, [])


@pytest.mark.parametrize(("k", "really", "read_as"), TRIPS)
def test_round_trip(stats, k, really, read_as):
    bad = CLEAN[k].encode(really).decode(read_as)
    got, n, _, _ = G.restore(bad, stats)
    assert n and got == CLEAN[k]


def test_double_lost_and_references(stats):
    twice = CLEAN[0].encode().decode("latin-1").encode().decode("latin-1")
    assert G.restore(twice, stats)[0] == CLEAN[0]
    lost = CLEAN[0].encode("latin-1").decode("utf-8", "replace")
    assert G.restore(lost, stats)[1] == 1 and G.restore(lost, stats)[2] > 3
    got = G.restore("Despu&Atilde;&copy;s de 59 errores", stats)
    assert got[1] and "Después" in got[0]


def test_runs_are_maximal():
    import numpy as np

    assert G.runs(np.array([-1, 2, -1, 2, -9, 1, -1.0])) == [(1, 4), (5, 6)] and G.runs(np.zeros(0)) == []


def test_operator(spark):
    rows = [(i, t) for i, t in enumerate(CLEAN * 8)] + [(500, CLEAN[0].encode().decode("cp1252", "replace")), (500, CLEAN[0].encode().decode("cp1252", "replace"))]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, charsets string, n_runs int")
    got = G.find_garbled(df).collect()
    assert [r.doc_id for r in got] == [500]
    assert G.find_garbled(df.limit(0)).collect() == []


def test_tokens_of_long_runs_are_those_of_the_tokenizer():
    """Long runs without white space are encoded whole: a split at any other place would give other counts."""
    enc = M._encoding(M.VOCABULARY)
    link = "https://example.org/" + "ab1c-de/f=" * 6_000
    for text in (link, "Some words before " + link + " and after.", "é" * 50_000, "x" * 100_000):
        assert M.count_tokens(text) == len(enc.encode_ordinary(text))
        assert enc.decode(enc.encode_ordinary(text)) == text


def test_items_in_blocks_are_searched_against_all_documents(spark, monkeypatch):
    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(30))) for i in range(40)]
    docs = [(d, " ".join(rng.choice(vocab) for _ in range(20)) + " " + " ".join(items[d % 40][1].split()[5:20])) for d in range(60)]
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = {(r.doc_id, r.item_id, r.words) for r in L.find_leaks(df, it).collect()}
    monkeypatch.setattr(L, "BLOCK_CHARS", 1000)
    monkeypatch.setattr(L, "AT_ONCE", 500)
    assert {(r.doc_id, r.item_id, r.words) for r in L.find_leaks(df, it).collect()} == whole and len(whole) >= 60


def test_runs_leave_ordinary_foreign_text_out():
    """Of common pairs none is in a run; of a garbled stretch all are."""
    common = ["Die Prüfung der Märkte läuft für größere Käufer täglich."] * 200 + ["Le marché fermé à été réévalué."] * 200
    rare = [" ".join(chr(0x430 + i) + chr(0x430 + j) for j in range(30)) for i in range(30)]  # a corpus has many pairs that are seen once
    stats = G.Pairs(*G.Pairs.count([*common, *rare, "Die PrÃ¼fung lÃ¤uft."]))
    inside = lambda t: G._marks(t, stats, G.GENEROSITY)
    marks = inside(common[0])
    assert marks is None or not any(m for m, c in zip(marks, common[0]) if c > "\x7f")
    text = "Die PrÃ¼fung lÃ¤uft."
    assert all(m for m, c in zip(inside(text), text) if c > "\x7f")
    assert G.restore(text, stats)[0] == "Die Prüfung läuft." and G.restore(common[0], stats)[1] == 0
