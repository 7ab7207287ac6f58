import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wardline.operators import features
from wardline.plans.catalog import hashing_encoder

TEXTS = [
    (1, "the tank is empty the tank"), (2, "The pump, the pump!"), (3, "x"), (4, None), (5, "empty pump"),
]


def _grams(text):
    tokens = re.findall(r"\w\w+", text.lower())
    return tokens + [f"{a} {b}" for a, b in zip(tokens, tokens[1:])]


def _brute(limit):
    counts = {k: Counter(_grams(t)) for k, t in TEXTS if t is not None}
    cf = sum(counts.values(), Counter())
    chosen = sorted(sorted(cf, key=lambda t: (-cf[t], t))[:limit])
    idf = {t: math.log((1 + len(counts)) / (1 + sum(t in c for c in counts.values()))) + 1 for t in chosen}
    values = {}
    for key, count in counts.items():
        row = {chosen.index(t): n * idf[t] for t, n in count.items() if t in idf}
        norm = math.sqrt(sum(v * v for v in row.values()))
        values.update({(key, i): v / norm for i, v in row.items()})
    return chosen, idf, values


@pytest.mark.parametrize("limit", [4, 1000])
def test_tfidf(spark, limit):
    df = spark.createDataFrame(TEXTS, "id int, text string")
    terms, idf, values = _brute(limit)
    vocabulary = features.fit_tfidf(df, "text", limit)
    rows = vocabulary.orderBy("idx").collect()
    assert [r.term for r in rows] == terms
    assert [r.idx for r in rows] == list(range(len(terms)))
    assert [r.idf for r in rows] == pytest.approx([idf[t] for t in terms])
    got = features.transform_tfidf(df, vocabulary, "id", "text").collect()
    assert {(r.id, r.idx): r.value for r in got} == pytest.approx(values)


def test_mean_pool(spark):
    rows = [("a", [1.0, 2.0], 1), ("a", [3.0, 4.0], 1), ("a", [100.0, 100.0], 0), ("b", [5.0, 6.0], 0)]
    df = spark.createDataFrame(rows, "k string, v array<double>, m int")
    got = {r.k: r.pooled for r in features.mean_pool(df, "k", "v", F.col("m")).collect()}
    assert got == {"a": [2.0, 3.0], "b": [0.0, 0.0]}
    assert features.mean_pool(df, "k", "v").filter("k = 'b'").first().pooled == [5.0, 6.0]


def test_encoder_sees_whole_texts(spark):
    rows = [(1, " ".join(f"w{i}" for i in range(50))), (2, "aa aa bb"), (3, "")]
    df = spark.createDataFrame(rows, "id int, text string")
    short = features.encode_texts(df, hashing_encoder, "id", "text", batch_size=3, max_words=7)
    got = {r.id: r.embedding for r in short.collect()}
    hashed = features.hash_block(df, "id", "text")
    expected = {(r.id, r.idx): r.value for r in hashed.collect()}
    assert {(k, i): v for k, e in got.items() for i, v in enumerate(e) if v} == pytest.approx(expected)
    assert sum(got[1]) == pytest.approx(1.0) and got[3] == [0.0] * 32


def test_blocks_side_by_side(spark):
    df = spark.createDataFrame([(1, "danger danger major")], "id int, text string")
    first = spark.createDataFrame([(1, 0, 0.5)], "id int, idx int, value double")
    got = features.concat_blocks([(first, 10), (features.keyword_block(df, "id", "text"), 5)], "id")
    assert sorted(map(tuple, got.collect())) == [(1, 0, 0.5), (1, 12, 2.0), (1, 13, 1.0)]
