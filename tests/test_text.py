import random
import re
from collections import Counter

from pyspark.sql import functions as F

from wardline.functions import text

SAMPLES = [
    "", "   ", "angry/urgent", "2nd a-b c's ÉCOLE", "LABEL_7", "a😀b  c d", "ñandú's o'neil\tx\n",
    "See https://a.b/c?d=1 RT this Via that, viaduct art", "xhttps://foo rt", "İstanbul vıa", "a\x1cb\x85c",
    "Storm  Water Drain(SWD)", "über-straße", "rt", "ért via.", "(rt)via",
]


def _noise(n=60):
    rng = random.Random(7)
    alphabet = "abRTtviaVIA é_-😀\t\n/:.hps1"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def _apply(spark, column, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.x for r in df.select("i", column(F.col("t")).alias("x")).orderBy("i").collect()]


def _plain_normalize(value):
    value = re.sub(r"https?://\S+", "", value)
    value = re.sub(r"\b(?:rt|via)\b", "", value, flags=re.I)
    return " ".join(re.findall("[A-Za-z0-9]+", value)).lower()


def test_normalize_text(spark):
    texts = SAMPLES + _noise()
    once = _apply(spark, text.normalize_text, texts)
    assert once == [_plain_normalize(t) for t in texts]
    steady = [t for t in once if not re.search(r"\b(rt|via)\b", t)]
    assert _apply(spark, text.normalize_text, steady) == steady


def test_title_case(spark):
    texts = [t for t in SAMPLES if "İ" not in t] + _noise()
    assert _apply(spark, text.title_case, texts) == [t.title() for t in texts]


def test_collapse(spark):
    texts = SAMPLES + _noise()
    assert _apply(spark, text.collapse, texts) == [" ".join(t.split()) for t in texts]


def test_token_and_word_spans(spark):
    texts = SAMPLES + _noise()
    for column, pattern in ((text.token_spans, r"\S+"), (text.word_spans, r"\w+")):
        got = [[tuple(x) for x in row] for row in _apply(spark, column, texts)]
        assert got == [[(m.group(), m.start(), m.end()) for m in re.finditer(pattern, t)] for t in texts]


def test_term_counts_and_ngrams(spark):
    texts = ["to be or not to be to", "", "one", "aa aa aa bb"]
    counts = _apply(spark, lambda c: text.term_counts(text.words(c)), texts)
    assert [{x.term: x.n for x in row} for row in counts] == [
        dict(Counter(re.findall(r"\w\w+", t))) for t in texts
    ]
    pairs = _apply(spark, lambda c: text.ngrams(text.words(c), 2), texts)
    assert pairs[0] == ["to be", "be or", "or not", "not to", "to be", "be to"]
    assert pairs[1] == pairs[2] == []


def test_strip(spark):
    texts = SAMPLES + _noise() + ["\x1c\u3000 a b\u2029\t"]
    assert _apply(spark, text.strip, texts) == [t.strip() for t in texts]


def test_keyword_counts_do_not_overlap(spark):
    got = _apply(spark, lambda c: text.keyword_counts(c, ["aa"])[0], ["aaaaa", "AA b aa", ""])
    assert got == [t.lower().count("aa") for t in ["aaaaa", "AA b aa", ""]]


def test_preview_and_labels(spark):
    got = _apply(spark, text.preview, ["  " + "x" * 160 + " ", "y" * 161])
    assert got == ["x" * 160, "y" * 157 + "..."]
    labels = ["LABEL_6", "LABEL_7", "", None, "__", "road_works"]
    assert _apply(spark, text.civic_category, labels) == [
        "Street Lighting Fault", "Label 7", "General Complaint", "General Complaint",
        "General Complaint", "Road Works",
    ]
    assert _apply(spark, text.urgency_label, ["URGENT", "angry", "warning", "Concerned", "x"]) == [
        "Angry/Urgent", "Angry/Urgent", "Concerned", "Concerned", "Neutral",
    ]


def test_times(spark):
    values = ["2025-11-24T09:25:10.752516+00:00", "2025-11-24T09:25:10+05:30", "garbage", "", None]
    parsed = _apply(spark, lambda c: text.display_time(text.parse_time(c)), values)
    assert parsed == ["24 Nov 2025 • 09:25", "24 Nov 2025 • 03:55", "—", "—", "—"]


def test_alternatives_keep_their_order():
    terms = ["road", "main road", "roads", "!!!", "a]b)"]
    pattern = re.compile(text.alternatives(terms))
    assert pattern.findall("main roads !!!! a]b)") == ["main road", "!!!", "a]b)"]
    assert re.findall(text.alternatives([]), "a") == [] and re.match(text.alternatives(["", "a"]), "a")[0] == ""
