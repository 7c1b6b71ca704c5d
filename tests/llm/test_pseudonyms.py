import random
import re
from datetime import date

from codelattice.llm import pseudonyms as ps
from tests.llm.helpers import SF, clashing, docs, edge_docs

KEY = b"test"


def test_feistel_is_a_permutation():
    for size in (1, 2, 3, 10, 97, 1000, 4096):
        feistel = ps.Feistel(KEY)
        image = [feistel.permute(n, size, "x") for n in range(size)]
        assert sorted(image) == list(range(size))
        assert [feistel.permute(n, size, "x", back=True) for n in image] == list(range(size))
    assert [ps.Feistel(KEY).permute(n, 1000, "x") for n in range(50)] != [ps.Feistel(b"other").permute(n, 1000, "x") for n in range(50)]
    for size in (10**9, 10**15, 1 << 32, 26**30):
        a, b = ps.Feistel(KEY)._grid(size)
        assert size <= a * b < 1.2 * size


VALUES = {
    "email": ["und.34@mail7.example.com", "A_b+c.9@x-y.org"],
    "ip": ["233.254.104.120", "1.2.3.4"],
    "iban": ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"],
    "card": ["4111111111111111", "4111 1111 1111 1111", "3782-822463-10005"],
    "ssn": ["123-45-6789"],
    "date": ["2024-02-29", "1999/12/31", "12/31/1999", "31/12/1999", "1.2.2003", "01.02.2003", "3/4/2003", "10.1.2011", "9.10.2010"],
    "phone": ["+1 (017) 555-7713", "017-555-7713", "(017) 555 7713"],
}
STAYING = ["300.1.1.1", "4111111111111112", "DE88 3704 0044 0532 0130 00", "000-12-3456", "666-12-3456", "2023-02-29", "13/13/1999", "1850-01-01", "x4111111111111111", "1111111111111111111111", "@x", "v1.2.3"]


def test_formats_stay_and_values_go():
    known = ps.Pseudonyms(KEY)
    for kind, values in VALUES.items():
        for value in values:
            text, spans = known.replace(f"before {value}, after")
            assert [s[0] for s in spans] == [kind], value
            fresh = text[spans[0][1] : spans[0][2]]
            assert text == f"before {fresh}, after" and fresh != value and value not in text
            shape = lambda s: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub(r"\d", "9", s)))
            if kind == "ip":
                assert all(0 <= int(p) <= 255 for p in fresh.split("."))
            else:
                assert shape(fresh) == shape(value)
            again = known.replace(fresh)[1]
            assert [s[0] for s in again] == [kind], (value, fresh)  # valid like the value
            assert known.of(kind, fresh, back=True) == value


def test_what_fails_its_check_stays():
    known = ps.Pseudonyms(KEY)
    for value in STAYING:
        text = f"say {value} here"
        assert known.replace(text) == (text, []), value


def test_equal_values_are_linked_with_any_spacing():
    known, other = ps.Pseudonyms(KEY), ps.Pseudonyms(KEY)
    digits = lambda kind, v, p=known: re.sub(r"\D", "", p.of(kind, v))
    assert digits("card", "4111111111111111") == digits("card", "4111 1111 1111 1111", other)
    assert digits("phone", "+1 (017) 555-7713")[-10:] == digits("phone", "017-555-7713", other)
    random.seed(3)
    cards = {(s := f"{random.randrange(10**15):015d}") + ps.luhn_digit(s) for _ in range(2000)}
    assert len({known.of("card", c) for c in cards}) == len(cards)
    assert all(ps.luhn_digit(known.of("card", c)[:-1]) == known.of("card", c)[-1] for c in cards)
    days = {known.of("date", date.fromordinal(n).isoformat()) for n in range(date(1990, 1, 1).toordinal(), date(1996, 1, 1).toordinal())}
    assert len(days) == date(1996, 1, 1).toordinal() - date(1990, 1, 1).toordinal()


def test_spellings_of_a_date_stay_linked():
    known = ps.Pseudonyms(KEY)
    spelled = lambda d: {"ymd-": d.isoformat(), "ymd/": d.strftime("%Y/%m/%d"), "mdy/": d.strftime("%m/%d/%Y"), "dmy.": d.strftime("%d.%m.%Y"), "dmy": f"{d.day}.{d.month}.{d.year}"} | ({"dmy/": d.strftime("%d/%m/%Y")} if d.day > 12 else {})
    images = set()
    for n in range(date(1999, 11, 1).toordinal(), date(2001, 3, 1).toordinal()):
        ways = spelled(date.fromordinal(n))
        fresh = {known.of("date", ways["ymd-"])}
        image = date.fromisoformat(next(iter(fresh)))
        for name, value in ways.items():
            assert known.of("date", value) == spelled(image)[name]
        images.add(image)
    assert len(images) == date(2001, 3, 1).toordinal() - date(1999, 11, 1).toordinal()


def test_documents_come_back_exactly(spark):
    """Each pseudonym of the registered query undone: the text as it was, and no valid value left beside the found ones."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    frame = ps.pseudonymise(spark.read.parquet(f"{SF}/documents.parquet"), ps.EXAMPLE_KEY, passed=["doc_id", "text"])
    counted = {r.doc_id: r for r in ps.op5_pseudonyms(spark, SF).collect()}
    known, total = ps.Pseudonyms(ps.EXAMPLE_KEY), 0
    for r in frame.collect():
        text, at, parts = r.text, 0, []
        for kind, start, end in r.found:
            parts += [text[at:start], known.of(kind, text[start:end], back=True)]
            at = end
        assert "".join([*parts, text[at:]]) == texts[r.doc_id]
        assert counted[r.doc_id].text == text
        assert all(counted[r.doc_id][f"n_{k}"] == sum(s.kind == k for s in r.found) for k in ps.KINDS)
        total += len(r.found)
    assert total > 20


def test_documents_hold_none_of_their_values(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = {r.doc_id: r for r in ps.op5_pseudonyms(spark, SF).collect()}
    assert found.keys() == texts.keys()
    for i, text in texts.items():
        private = re.findall(r"[\w.]+@[\w.]+\w|\+1 \(\d{3}\) \d{3}-\d{4}|\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", text)
        private += [c for c in re.findall(r"\b\d{16}\b", text) if ps.luhn_digit(c[:-1]) == c[-1]]
        assert not [p for p in private if p in found[i].text]
        if not private and not any(c.isdigit() for c in text):
            assert found[i].text == text


def test_edges(spark):
    frame = clashing(edge_docs(spark), "found", "row")
    rows = ps.pseudonymise(frame, KEY).collect()
    assert len(rows) == 9 and all(r.row == "was here" for r in rows)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[2].text is None and by_id[3].text == "" and by_id[2].found == []
    assert ps.pseudonymise(docs(spark, ["a"]).limit(0), KEY).count() == 0


def test_values_before_and_after_other_groups():
    known = ps.Pseudonyms(KEY)
    card, iban = "4111 1111 1111 1111", "DE89 3704 0044 0532 0130 00"
    cases = [
        (f"{card} 12/26", [("card", card)]),
        ("4111111111111111 737", [("card", "4111111111111111")]),
        (f"12 35 {card} 12", [("card", card)]),
        ("4111-1111-1111-1111-12", [("card", "4111-1111-1111-1111")]),
        (f"{card} 3782-822463-10005", [("card", card), ("card", "3782-822463-10005")]),
        (f"{iban} EUR", [("iban", iban)]),
        (f"AB12 {card}", [("card", card)]),
        ("123-45-6789 12345", [("ssn", "123-45-6789")]),
        ("1984-03-02T10:00:00Z", [("date", "1984-03-02")]),
        ("1984-03-02T10:00:00+01:00, 1984-03-02", [("date", "1984-03-02"), ("date", "1984-03-02")]),
    ]
    for text, values in cases:
        want = text
        for kind, value in dict.fromkeys(values):
            want = want.replace(value, known.of(kind, value))
        got, spans = known.replace(text)
        assert got == want and [s[0] for s in spans] == [k for k, _ in values], text
    for text in ("1984-03-02Tuesday", "4111111111111112 737", "x4111111111111111 737"):
        assert known.replace(text) == (text, [])
