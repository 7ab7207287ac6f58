"""Personal data against plain Python."""

import random
import re

import pytest

from wardline.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
COLUMNS = "doc_id long, text string, _rid int, _text string, kind int, m string, `a.b` int, `end` int, p string"


def documents(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, 7, "t", 1, "m", 5, 3, "p") for i, t in zip(ids, texts)], COLUMNS)


def luhn(digits):
    twice = [2 * int(c) - 9 * (c > "4") if i % 2 else int(c) for i, c in enumerate(reversed(digits))]
    return sum(twice) % 10 == 0


def holds(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def base_spans(text):
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text or "") if holds(k, m[0])]


def found(spark, texts):
    return {r._key: r._spans for r in pii.find_spans(documents(spark, texts)).collect()}


PIECES = [
    "a@b.c", "_d", ".", "@", "+1 (988) 555-2485", "4041894974608795", "1.2.3.4", ".5.6.7.8", " ", "-", "é", "😀", "1", "23", "255",
    "256", "0255", "+", "DE89370400440532013000", "born", "12.03.1988", "\n", "%", "x", "order", "4111 1111-1111 1111",
]


def test_base_spans_of_random_texts(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(40))) for _ in range(1500)]
    texts += [None, "", "   ", "9" * 3000, "1 " * 2000, "a@" + "b." * 2000, "1." * 2000, "+1" + "." * 3000 + "2", "a.b" * 900]
    got = found(spark, texts)
    for i, text in enumerate(texts):
        assert [(s.kind, s.start, s.end) for s in got[i] if s.base] == base_spans(text), text
        assert all(s.value == text[s.start : s.end] for s in got[i])


def test_very_long_texts(spark):
    texts = ["9" * 300_000, "a" * 300_000, "1.2.3.4 born 12.03.1988 " * 4000]
    got = found(spark, texts)
    assert [len(got[i]) for i in range(3)] == [0, 0, 8000]


@pytest.mark.parametrize(
    "text, kind, points",
    [
        ("pay to DE89 3704 0044 0532 0130 00 today", "iban", 90),
        ("IBAN: GB82WEST12345698765432.", "iban", 100),
        ("pay to DE89 3704 0044 0532 0130 01 today", None, 0),
        ("XDE89370400440532013000", None, 0),
        ("SSN 219-09-9999", "ssn", 75),
        ("number 219-09-9999", None, 0),
        ("ssn 666-09-9999", None, 0),
        ("routing 021000021", "routing", 75),
        ("routing 021000022", None, 0),
        ("born on 12.03.1988", "birth", 60),
        ("on 12.03.1988", None, 0),
        ("reborn on 12.03.1988", None, 0),
        ("born " + "x" * 80 + " 12.03.1988", None, 0),
        ("tel 555-123-4567", "local", 65),
        ("order 555-123-4567, phone later", None, 0),
        ("at 2001:0db8:85a3:0000:0000:8a2e:0370:7334", "ipv6", 60),
        ("version 2001:0db8:85a3:0000:0000:8a2e:0370:7334", None, 0),
        ("phone +1 (988) 555-2485", "phone", 95),
        ("release 10.20.30.40", "ip", 30),
        ("write to example@example.org", "email", 70),
    ],
)
def test_points(spark, text, kind, points):
    got = [(s.kind, s.points) for s in found(spark, [text])[0]]
    assert got == ([(kind, points)] if kind else [])


def test_every_row_stays(spark):
    frame = documents(spark, ["a@b.c", "a@b.c", None, ""], [1, 1, None, None])
    rows = pii.digest(pii.find_spans(frame)).collect()
    assert sorted((r.doc_id or 0, r.n_email, r.spans) for r in rows) == [(0, 0, ""), (0, 0, ""), (1, 1, "email:0:5"), (1, 1, "email:0:5")]
    assert pii.find_spans(documents(spark, [])).collect() == []
