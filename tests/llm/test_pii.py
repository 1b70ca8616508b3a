from datetime import date

import pytest
from hypothesis import given
from hypothesis import strategies as st

from millrace.llm import pii as P

GIVEN, FAMILY = ("Zoëlle", "Galina-Mae", "Jorund"), ("O'Harrigan", "Quenby", "Maranello-Fey")


def found(text):
    return [(text[a:b], k) for a, b, k in P.find(text, GIVEN, FAMILY)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("write to a.b+c@web-mail.test.", [("a.b+c@web-mail.test", "email")]),
        ("a (at) corp (dot) norvik (dot) example, ok", [("a (at) corp (dot) norvik (dot) example", "email")]),
        ("x_y AT mailbox DOT example.", [("x_y AT mailbox DOT example", "email")]),
        ("q%40desk.invalid q＠desk.invalid", [("q%40desk.invalid", "email"), ("q＠desk.invalid", "email")]),
        ("pin embedkit@9.6.0 and follow @tidy_desk, 5 lots @ 938.42", []),
        ("call +49 (0)30 55501 53 or (555) 010.5921.", [("+49 (0)30 55501 53", "phone"), ("(555) 010.5921", "phone")]),
        ("tel:555-0147, 07700 900 645, 00995 555 31 71 12", [("555-0147", "phone"), ("07700 900 645", "phone"), ("00995 555 31 71 12", "phone")]),
        ("Order 20247052-9183, ticket #46118589, 12-14-2025, 10.27.0.16, 2025-07-11, build 2024.12.6378", []),
        ("Checksum 10592001385702666813 and login 50035238", []),
        ("card 9990-7986-6877-4187", [("9990-7986-6877-4187", "id_number")]),
        ("SSN=986-16-5333; tax number 77-2386884; ID: 02906324654", [("986-16-5333", "id_number"), ("77-2386884", "id_number"), ("02906324654", "id_number")]),
        ("IBAN ZZ02 NORV 9408 2202 71, Passport no. XA7954158", [("ZZ02 NORV 9408 2202 71", "id_number"), ("XA7954158", "id_number")]),
        ("at Flat 2, 42 Quarry Hill Lane or 561 W. Old Mill Close", [("Flat 2, 42 Quarry Hill Lane", "address"), ("561 W. Old Mill Close", "address")]),
        ("P.O. Box 237, ul. Polna Droga 60/19, Ofengasse 3", [("P.O. Box 237", "address"), ("ul. Polna Droga 60/19", "address"), ("Ofengasse 3", "address")]),
        ("51 BAD TRADES IN A ROW COST 97 CAME FROM THE ROOF TERRACE", []),
        ("Ms. Maranello-Fey, Jorund; GALINA-MAE QUENBY; z. o’harrigan; Jorund T. Quenby", [("Maranello-Fey, Jorund", "name"), ("GALINA-MAE QUENBY", "name"), ("z. o’harrigan", "name"), ("Jorund T. Quenby", "name")]),
        ("The Quenby desk and Jorund alone, jorund.quenby@x.org", [("jorund.quenby@x.org", "email")]),
    ],
)
def test_find(text, want):
    assert found(text) == want


@given(st.integers(1, 18), st.data())
def test_feistel_is_a_permutation(digits, data):
    x = data.draw(st.integers(0, 10**digits - 1))
    y = P.feistel(x, digits, b"key")
    assert 0 <= y < 10**digits and P.feistel(y, digits, b"key", back=True) == x


def test_feistel_covers_all_values():
    assert sorted(P.feistel(x, 3, b"k") for x in range(1000)) == list(range(1000))


def test_pseudonyms_keep_format_and_links():
    a = P.pseudonym("phone", "+1 (555) 010-7258", b"k")
    assert a == P.pseudonym("phone", "+1 (555) 010-7258", b"k") != P.pseudonym("phone", "+1 (555) 010-7258", b"other")
    assert [c if not c.isdigit() else "9" for c in a] == list("[PHONE +9 (999) 999-9999]")
    card = P.pseudonym("id_number", "4111 1111 1111 1111", b"k")
    assert P.luhn("".join(c for c in card if c.isdigit())) and card != "[ID_NUMBER 4111 1111 1111 1111]"
    iban = P.pseudonym("id_number", "GB82 WEST 1234 5698 7654 32", b"k")[11:-1].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert P.pseudonym("name", "Jorund  QUENBY", b"k") == P.pseudonym("name", "jorund quenby", b"k")


def test_dates_stay_in_their_range():
    first = date(2024, 1, 1)
    days = [date.fromordinal(first.toordinal() + i) for i in range(400)]
    new = [P.permute_date(d, b"k", first, 400) for d in days]
    assert sorted(new) == days and [P.permute_date(d, b"k", first, 400, back=True) for d in new] == days
    assert P.permute_date(date(2030, 1, 1), b"k", first, 400) == date(2030, 1, 1)


def test_operators(spark):
    names = spark.createDataFrame([(n, "given", 1) for n in GIVEN] + [(n, "family", 1) for n in FAMILY] + [(None, "given", 1), ("", "family", 1)], "name string, name_part string, id int")
    rows = [("a", None, "Mail Jorund Quenby at j@x.org"), ("a", None, "Mail Jorund Quenby at j@x.org"), ("b", "s", None), ("c", "s", ""), ("d", "s", "é\U0001f600 +1 555 010 2621")]
    docs = spark.createDataFrame([(*r, "k", 3) for r in rows], "id string, source string, text string, kind string, start_pos int")
    got = sorted((r.id, r.kind, r.start_pos) for r in P.find_items(docs, names).collect())
    assert got == [("a", "email", 23), ("a", "name", 6), ("d", "phone", 4)]
    masked = {r.id: (r.n_items, r.text) for r in P.mask_docs(docs, names, b"k").collect()}
    assert masked["b"] == (0, None) and masked["c"] == (0, "") and masked["a"][1].startswith("Mail [NAME ") and len(masked) == 4
    assert P.find_items(docs.limit(0), names).collect() == [] and P.find_items(docs, names.limit(0)).where("kind = 'name'").count() == 0


def test_long_text_without_items():
    assert P.find("word " * 200_000, GIVEN, FAMILY) == [] and P.find("A" * 300_000, GIVEN, FAMILY) == []


def test_dates_keep_their_notation():
    from datetime import date

    key = b"k"
    text = "Born 1984-03-07, seen 07/03/1984 and March 7, 1984, not 1984-13-45 or 10.27.0.16 or 2-1-3; in 7 MAR 1984."
    found = P.find_dates(text)
    assert [d[2] for d in found] == [date(1984, 3, 7)] * 4
    shown = P.mask(text, [], key, found)
    day = P.permute_date(date(1984, 3, 7), key, P.FIRST_DAY, P.DAYS)
    month = P._MONTHS[day.month - 1]
    assert f"[DATE {day:%Y-%m-%d}]" in shown and f"[DATE {day:%d/%m/%Y}]" in shown and f"[DATE {month.capitalize()} {day.day}, {day.year}]" in shown
    assert f"[DATE {day.day} {month[:3].upper()} {day.year}]" in shown and "1984-13-45" in shown
    assert P.permute_date(day, key, P.FIRST_DAY, P.DAYS, back=True) == date(1984, 3, 7)
    assert P.find_dates(None) == P.find_dates("") == []


def test_letters_and_tags():
    for word in ("ABCD", "ab", "x", "Zz12"):
        assert P.permute_letters(P.permute_letters(word, b"k"), b"k", back=True) == word
    assert len(P.pseudonym("name", "Ann Lee", b"k").split()[1].rstrip("]")) == 32
    a, b = P.pseudonym("id_number", "GB82WEST12345698765432", b"k"), P.pseudonym("id_number", "GB82 WEST 1234 5698 7654 32", b"k")
    assert "WEST" not in a and "WEST" not in b
