import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardline.functions import scores
from wardline.functions.text import normalize_text
from wardline.operators import enrich, heads, joins
from wardline.session import shared_dir

ROWS = [
    (1, "water water leak", "wet", "High"), (2, "street light dark", "light", "Low"),
    (3, "light out water", "light", None), (4, "no water", "wet", "High"), (5, None, "wet", "Low"),
]
HEADS = {"topic": ["wet", "light", "never"], "level": ["Low", "High"]}


def _brute(texts):
    """Naive Bayes by hand, one head after the other."""
    result = defaultdict(dict)
    for head, at in (("topic", 2), ("level", 3)):
        rows = [(re.findall(r"\w\w+", r[1].lower()), r[at]) for r in ROWS if r[1] is not None and r[at]]
        known = {w for tokens, _ in rows for w in tokens}
        for key, text in texts:
            logs = []
            for label in HEADS[head]:
                own = [tokens for tokens, x in rows if x == label]
                if not own:
                    logs.append(-math.inf)
                    continue
                counts = Counter(w for tokens in own for w in tokens)
                mass = sum(counts.values()) + len(known)
                words = [w for w in re.findall(r"\w\w+", text.lower()) if w in known]
                logs.append(math.log(len(own) / len(rows)) + sum(math.log((counts[w] + 1) / mass) for w in words))
            e = np.exp(np.array(logs) - max(logs))
            result[key][head] = list(e / e.sum())
    return result


@pytest.mark.parametrize("way", ["rows", "joined", "shuffled"])
def test_naive_bayes(spark, monkeypatch, way):
    df = spark.createDataFrame(ROWS, "id int, text string, topic string, level string")
    model = heads.train_naive_bayes(df, "text", HEADS, shared_dir(spark, "model"))
    if way == "shuffled":
        monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    texts = [(10, "Water leak water"), (11, "unknown words"), (12, "dark light"), (13, "")]
    frame = spark.createDataFrame(texts, "id int, text string")
    scored = heads.row_scorer(model, "text")(frame) if way == "rows" else heads.score_heads(frame, model, "id", "text")
    expected = _brute(texts)
    rows = scored.collect()
    assert sorted(r.id for r in rows) == [10, 11, 12, 13]
    for row in rows:
        for head in HEADS:
            got = row[f"{head}_scores"]
            assert [e.label for e in got] == HEADS[head]
            assert [e.score for e in got] == pytest.approx(expected[row.id][head], abs=1e-9)


def test_rows_with_equal_keys_and_missing_texts_keep_their_own_scores(spark):
    df = spark.createDataFrame(ROWS, "id int, text string, topic string, level string")
    model = heads.train_naive_bayes(df, "text", HEADS, shared_dir(spark, "model"))
    frame = spark.createDataFrame([(2**53 + 1, "Water leak"), (2**53 + 1, "dark light"), (None, None)], "id long, text string")
    rows = heads.row_scorer(model, "text")(frame.coalesce(1)).collect()
    assert [r.id for r in rows] == [2**53 + 1, 2**53 + 1, None]
    assert rows[0].topic_scores != rows[1].topic_scores and rows[2].topic_scores is None
    none = heads.row_scorer(model, "text")(frame.limit(0))
    assert none.collect() == []


def test_a_model_too_large_to_send_out_scores_alike(spark, monkeypatch):
    df = spark.createDataFrame(ROWS, "id int, text string, topic string, level string")
    model = heads.train_naive_bayes(df, "text", HEADS, shared_dir(spark, "model"))
    texts = [(1, "Water leak water"), (1, "dark light"), (None, None), (3, ""), (3, ""), (4, "unknown words")]
    frame = spark.createDataFrame(texts, "id int, text string").withColumn("_number", F.lit(7))
    small = heads.row_scorer(model, "text")(frame)
    monkeypatch.setattr(heads, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    large = heads.row_scorer(model, "text")(frame)
    assert large.dtypes == small.dtypes

    def listed(rows):
        place = lambda r: (r.id is None, r.id, r.text)
        return [(*place(r), r._number, [e and [(x.label, pytest.approx(x.score, abs=1e-12)) for x in e] for e in r[3:]]) for r in sorted(rows.collect(), key=place)]

    assert listed(large) == listed(small)
    assert heads.row_scorer(model, "text")(frame.limit(0)).collect() == []


def test_a_head_without_labels_gives_nothing(spark):
    df = spark.createDataFrame(ROWS, "id int, text string, topic string, level string").withColumn("level", F.lit(None).cast("string"))
    model = heads.train_naive_bayes(df, "text", HEADS, shared_dir(spark, "model"))
    frame = spark.createDataFrame([(1, "water")], "id int, text string")
    for row in (heads.row_scorer(model, "text")(frame).first(), heads.score_heads(frame, model, "id", "text").first()):
        assert row.level_scores is None and row.topic_scores is not None


def test_evaluate(spark):
    rows = [("a", "a")] * 3 + [("a", "b"), ("b", "b"), ("c", "a"), (None, "a")]
    df = spark.createDataFrame(rows, "t string, p string")
    got = heads.evaluate(df, F.lit("h"), F.col("t"), F.col("p")).first()
    f1 = {"a": 2 * 3 / (4 + 4), "b": 2 * 1 / (1 + 2), "c": 0.0}
    assert (got.head, got.n, got.accuracy) == ("h", 6, pytest.approx(4 / 6))
    assert got.weighted_f1 == pytest.approx((4 * f1["a"] + f1["b"]) / 6)


def test_hash_pick_is_stable(spark):
    df = spark.createDataFrame([("x",), ("y",), ("",)], "t string")
    pick = scores.hash_pick(F.col("t"), ["a", "b", "c"], "s")
    import hashlib

    for row in df.select("t", pick.alias("p")).collect():
        assert row.p == "abc"[int(hashlib.md5((row.t + "s").encode()).hexdigest()[:8], 16) % 3]


def test_failed_heads_fall_back(spark):
    def failing():
        return lambda texts: {"category": [[1.0]] * len(texts), "severity": None}

    df = spark.createDataFrame([(1, "Ward mapping noted"), (2, "gas leak")], "id int, complaint_text string")
    scorer = enrich.model_scorer(failing, {"category": ["Lakes"], "severity": ["Low"], "urgency": ["x"]})
    rows = {r.id: r for r in enrich.enrich_complaints(df, scorer, keep=["id"]).collect()}
    assert (rows[1].severity, rows[1].severity_confidence, rows[1].urgency) == ("Medium", 0.33, "Neutral")
    assert (rows[2].severity, rows[2].severity_confidence) == ("High", 0.5)
    assert rows[1].issue_type == "Lakes"
    assert rows[1].cleaned_text == "ward mapping noted"


def test_log_rows(spark):
    df = spark.createDataFrame([("a/b c", "URGENT", "low")], "raw_text string, urgency string, severity string")
    df = df.withColumn("cleaned", normalize_text(F.col("raw_text")))
    assert tuple(enrich.log_rows(df).first()) == ("", "", "Low", "Urgent", "", "a/b c")


def test_words_are_counted_in_one_shuffle(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([("wall road wall", "x", 1), ("road", None, 0)], "t string, a string, b int")
    plans, write = [], type(df).write

    def seen(frame):
        plans.append(frame._jdf.queryExecution().executedPlan().toString())
        return write.fget(frame)

    monkeypatch.setattr(type(df), "write", property(seen))
    model = heads.train_naive_bayes(df, "t", {"a": ["x", "y"], "b": ["0", "1"]}, str(tmp_path))
    assert plans[0].count("Exchange") == 1
    counts = {r.term: (r.a, r.b) for r in spark.read.parquet(str(tmp_path / "counts")).collect()}
    assert counts == {"": ([1, 0], [1, 1]), "wall": ([2, 0], [0, 2]), "road": ([1, 0], [1, 1])}
    assert model.weights.count() == 3
