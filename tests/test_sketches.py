import random

import pytest
from pyspark.sql import functions as F

from wardline.operators import dashboard, sketches


def _texts(spark, words, size=50):
    rows = [(" ".join(words[i : i + size]),) for i in range(0, len(words), size)]
    return spark.createDataFrame(rows, "complaint_text string").repartition(6)


def _rows(df):
    return [(r.term, r.n) for r in df.collect()]


@pytest.mark.parametrize("tracked", [64, 5000])
def test_heavy_terms_are_the_top_terms(spark, tracked, monkeypatch):
    rng = random.Random(1)
    words = [f"rare{rng.randrange(3000)}" for _ in range(20_000)] + [f"hot{i}" for i in range(20) for _ in range(1500 + i)]
    rng.shuffle(words)
    df = _texts(spark, words)
    want = _rows(dashboard.top_terms(df, limit=10))
    full = []
    monkeypatch.setattr(sketches, "top_terms", lambda *a, **k: full.append(1) or dashboard.top_terms(*a, **k))
    assert _rows(sketches.heavy_terms(df, limit=10, tracked=tracked)) == want
    # Few slots prove nothing here: all terms are counted. Many do, without counting all.
    assert bool(full) == (tracked == 64)


def test_ties_and_few_terms(spark):
    df = _texts(spark, ["bb", "aa", "cc"] * 30 + ["dd"])
    for limit in (2, 3, 4, 10):
        assert _rows(sketches.heavy_terms(df, limit=limit)) == _rows(dashboard.top_terms(df, limit=limit))
    nothing = spark.createDataFrame([(None,), ("",)], "complaint_text string")
    assert _rows(sketches.heavy_terms(nothing)) == []


def test_distinct_counts_merge(spark):
    rng = random.Random(2)
    rows = [(f"2025-01-{rng.randrange(1, 11):02}T10:00:00Z", f"v{rng.randrange(20_000)}", f"s{rng.randrange(9)}" if rng.random() < 0.9 else None) for _ in range(60_000)]
    df = spark.createDataFrame(rows, "created_at string, many string, few string")
    daily = sketches.daily_distinct(df, ["many", "few"])
    assert daily.count() == 10
    for days, of in ((None, rows), (F.col("day").between("2025-01-03", "2025-01-05"), [r for r in rows if "2025-01-03" <= r[0][:10] <= "2025-01-05"])):
        got = sketches.merged_distinct(daily, ["many", "few"], days).first()
        exact = len({r[1] for r in of})
        assert abs(got.many - exact) <= 4 * 0.0163 * exact
        assert got.few == len({r[2] for r in of} - {None})
    assert tuple(sketches.merged_distinct(daily.limit(0), ["many", "few"]).first()) == (0, 0)
