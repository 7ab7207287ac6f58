import random
from collections import Counter, defaultdict

import pytest

from wardline.operators import span_quality

SCHEMA = "key int, label string, start int, end int"


def _matched(pairs):
    used_p, used_a, n = set(), set(), 0
    for _, p, a in sorted(pairs):
        if p not in used_p and a not in used_a:
            used_p.add(p)
            used_a.add(a)
            n += 1
    return n


def _twins(spans):
    seen, out = Counter(), []
    for s in spans:
        if None not in s:
            seen[s] += 1
            out.append((*s, seen[s]))
    return out


def _brute(predicted, annotated):
    p, a = _twins(predicted), _twins(annotated)
    counts = defaultdict(lambda: [0, 0, 0, 0])
    for k, rows in enumerate((p, a, set(p) & set(a))):
        for row in rows:
            counts[row[1]][k] += 1
    groups = defaultdict(list)
    for x in p:
        for y in a:
            if x[:2] == y[:2] and x[2] < x[3] and y[2] < y[3] and x[2] < y[3] and y[2] < x[3]:
                common = min(x[3], y[3]) - max(x[2], y[2])
                joint = max(x[3], y[3]) - min(x[2], y[2])
                groups[x[:2]].append((-(common / joint), x[2:], y[2:]))
    for (_, label), pairs in groups.items():
        counts[label][3] += _matched(pairs)
    out = {label: tuple(n) for label, n in counts.items()}
    if out:
        out["*"] = tuple(map(sum, zip(*out.values())))
    return out


def _scores(spark, predicted, annotated):
    done = span_quality.span_quality(spark.createDataFrame(predicted, SCHEMA), spark.createDataFrame(annotated, SCHEMA))
    return {r.label: r for r in done.collect()}


def test_random_spans(spark):
    rng = random.Random(3)

    def spans(n):
        out = []
        for _ in range(n):
            start = rng.randrange(150)
            out.append((rng.randrange(12), rng.choice("AB"), start, start + rng.choice([0, 1, 3, 8, 8, 70, 140])))
        return out + rng.choices(out, k=n // 5) + [(None, "A", 1, 2), (1, None, 1, 2), (1, "A", None, 2)]

    predicted, annotated = spans(200), spans(150)
    annotated += rng.sample(predicted, 40)
    got = _scores(spark, predicted, annotated)
    want = _brute(predicted, annotated)
    assert {k: (r.predicted, r.annotated, r.exact, r.overlap) for k, r in got.items()} == want
    for r in got.values():
        assert r.exact_precision == pytest.approx(r.exact / r.predicted)
        assert r.overlap_recall == pytest.approx(r.overlap / r.annotated)
        assert r.overlap_f1 == pytest.approx(2 * r.overlap / (r.predicted + r.annotated))


def test_the_closest_span_is_matched_first_and_each_once(spark):
    got = _scores(spark, [(1, "A", 0, 10), (1, "A", 8, 12)], [(1, "A", 8, 12), (1, "A", 9, 10)])["A"]
    assert (got.exact, got.overlap) == (1, 2)
    got = _scores(spark, [(1, "A", 0, 10), (1, "A", 0, 10)], [(1, "A", 0, 10)])["A"]
    assert (got.exact, got.overlap, got.exact_precision, got.exact_recall) == (1, 1, 0.5, 1.0)


def test_one_side_only(spark):
    got = _scores(spark, [], [(1, "A", 0, 3)])
    assert got["A"].exact_precision is None and got["A"].exact_recall == 0.0 and got["*"].annotated == 1
    assert set(_scores(spark, [], [])) <= {"*"}


def test_labels_under_one_name(spark, annotations):
    rows = span_quality.span_rows(annotations.selectExpr("monotonically_increasing_id() as id", "entities"), "id")
    places = span_quality.one_label(rows, ["LOC", "GPE", "LOCATION"], "PLACE")
    scores = span_quality.span_quality(places, places).collect()
    assert all(r.exact_f1 == r.overlap_f1 == 1.0 for r in scores)


def test_spans_are_shuffled_once(spark):
    spans = spark.createDataFrame([(1, "A", 0, 3)], SCHEMA)
    plan = span_quality.span_quality(spans, spans)._jdf.queryExecution().executedPlan().toString()
    # By text and label, then counts by label and the rollup of these.
    assert plan.count("Exchange") == 3 and "Join" not in plan and "Window" not in plan
