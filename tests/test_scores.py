import random

import pytest
from pyspark.sql import functions as F

from wardline.functions import scores

SCHEMA = "i int, p array<struct<label:string,score:double>>, t string, m double"


def _brute(items, target, minimum, guard):
    """Straight re-statement on plain numbers."""
    if not items:
        return [(target, 1.0)]
    value = dict(items)
    value.setdefault(target, 0.0)
    mass = sum(value.values())
    if guard and mass <= 0:
        value = {k: float(k == target) for k in value}
    elif value[target] < minimum:
        others = [k for k in value if k != target]
        left = mass - value[target]
        rest = 1 - min(1, minimum)
        for k in others:
            value[k] = value[k] * rest / left if left > 0 and rest > 0 else rest / max(len(others), 1)
        value[target] = min(1, minimum)
    mass = sum(value.values())
    order = [k for k, _ in items] + ([target] if target not in dict(items) else [])
    return [(k, value[k] / mass if mass > 0 else value[k]) for k in order]


GOLDEN = [
    ([], "High", 0.85, True, [("High", 1.0)]),
    ([("Low", 1 / 3), ("Medium", 1 / 3), ("High", 1 / 3)], "High", 0.75, True,
     [("Low", 0.125), ("Medium", 0.125), ("High", 0.75)]),
    ([("Neutral", 1 / 3), ("Concerned", 1 / 3), ("Angry/Urgent", 1 / 3)], "Angry/Urgent", 0.8, False,
     [("Neutral", 0.1), ("Concerned", 0.1), ("Angry/Urgent", 0.8)]),
    ([("Low", 0.05), ("Medium", 0.05), ("High", 0.9)], "High", 0.85, True,
     [("Low", 0.05), ("Medium", 0.05), ("High", 0.9)]),
    ([("LOW", 0.2), ("MEDIUM", 0.3), ("HIGH", 0.5)], "High", 0.85, True,
     [("LOW", 0.03), ("MEDIUM", 0.045), ("HIGH", 0.075), ("High", 0.85)]),
    ([("Low", 0.0), ("Medium", 0.0), ("High", 0.0)], "High", 0.85, True,
     [("Low", 0.0), ("Medium", 0.0), ("High", 1.0)]),
    ([("a", 0.0), ("b", 0.0), ("c", 0.0)], "c", 0.8, False, [("a", 0.1), ("b", 0.1), ("c", 0.8)]),
]


def _fuse(spark, cases, guard):
    rows = [(i, p, t, m) for i, (p, t, m) in enumerate(cases)]
    fused = scores.fuse_hint(F.col("p"), F.col("t"), F.col("m"), guard)
    out = spark.createDataFrame(rows, SCHEMA).select("i", fused.alias("x")).orderBy("i").collect()
    return [[(e.label, e.score) for e in r.x] for r in out]


def _close(got, expected):
    assert [k for k, _ in got] == [k for k, _ in expected]
    assert [v for _, v in got] == pytest.approx([v for _, v in expected], abs=1e-12)


def test_golden_fusions(spark):
    for guard in (True, False):
        cases = [g for g in GOLDEN if g[3] is guard]
        for got, case in zip(_fuse(spark, [g[:3] for g in cases], guard), cases):
            _close(got, case[4])


def test_fusion_properties(spark):
    rng = random.Random(3)
    cases = []
    for _ in range(200):
        labels = rng.choices("abcd", k=rng.randint(1, 5))
        cases.append(
            ([(x, rng.choice([0.0, rng.random()])) for x in labels], rng.choice("abcde"), rng.choice([0.5, 0.8, 1.0]))
        )
    for guard in (True, False):
        for got, (items, target, minimum) in zip(_fuse(spark, cases, guard), cases):
            _close(got, _brute(items, target, minimum, guard))
            if len(set(k for k, _ in items)) == len(items):
                assert sum(v for _, v in got) == pytest.approx(1.0)
                assert dict(got)[target] >= minimum - 1e-12


def _decide(spark, decision, items, **columns):
    df = spark.createDataFrame([(0, items, "", 0.0)], SCHEMA).select(
        "p", *[F.lit(v).cast("string").alias(k) for k, v in columns.items()]
    )
    return df.select(decision.alias("d")).first().d


def test_decisions(spark):
    p, hint = F.col("p"), F.col("h")
    even = [("Low", 1 / 3), ("Medium", 1 / 3), ("High", 1 / 3)]
    live = scores.severity_decision(p, hint)
    d = _decide(spark, live, even, h="High")
    assert (d.label, d.confidence) == ("High", pytest.approx(0.85))
    d = _decide(spark, live, [("Low", 0.02), ("Medium", 0.02), ("High", 0.96)], h="High")
    assert (d.label, d.confidence) == ("High", 0.96)
    d = _decide(spark, live, even, h=None)
    assert (d.label, d.confidence) == ("Low", pytest.approx(1 / 3))
    stub = scores.severity_decision(p, hint, "stub", F.col("l"))
    assert _decide(spark, stub, even, h=None, l="Medium").label == "Medium"
    assert _decide(spark, stub, even, h="Medium", l="Low").confidence == pytest.approx(0.6)
    urgency = scores.urgency_decision(p, hint)
    heads = [("NEUTRAL", 0.5), ("CONCERNED", 0.3), ("URGENT", 0.2)]
    d = _decide(spark, urgency, heads, h="Concerned")
    assert (d.label, d.confidence) == ("Concerned", pytest.approx(0.7))
    assert [e.label for e in d.scores] == ["Neutral", "Concerned", "Angry/Urgent"]
    d = _decide(spark, scores.urgency_decision(p, hint, "stub", F.col("l")), heads, h="Concerned", l="urgent")
    assert (d.label, d.confidence) == ("Angry/Urgent", 0.5)


def test_fallbacks(spark):
    p, hint = F.col("p"), F.col("h")
    severity, urgency = scores.severity_decision(p, hint), scores.urgency_decision(p, hint)
    assert _decide(spark, severity, None, h="Low").confidence == 0.5
    d = _decide(spark, severity, None, h=None)
    assert (d.label, d.confidence, [e.score for e in d.scores]) == ("Medium", 0.33, [0.33, 0.34, 0.33])
    d = _decide(spark, urgency, None, h="Angry/Urgent")
    assert (d.label, d.confidence) == ("Neutral", 0.33)


def test_lists(spark):
    rows = [(0, [("x", 0.2), ("y", 0.4), ("z", 0.4)], "", 0.0)]
    df = spark.createDataFrame(rows, SCHEMA)
    p = F.col("p")
    top = df.select(scores.top(p).alias("t"), scores.by_score(p).alias("s")).first()
    assert top.t.label == "y"
    assert [e.label for e in top.s] == ["y", "z", "x"]
    rows = [(0, [("LABEL_6", 0.1), ("a_b", 0.2), ("Street Lighting Fault", 0.1), ("", 0.4)], "", 0.0)]
    got = spark.createDataFrame(rows, SCHEMA).select(scores.category_probabilities(p, True).alias("c")).first().c
    assert [(e.label, round(e.score, 6)) for e in got] == [
        ("General Complaint", 0.5), ("Street Lighting Fault", 0.25), ("A B", 0.25),
    ]


def test_broken_scores_are_named_and_stop_no_other_row(spark):
    from wardline.operators.enrich import enrich_complaints, violations

    def scorer(df):
        none = F.lit(None).cast(scores.SCORES)
        return df.withColumns({f"{h}_scores": none for h in ("category", "severity", "urgency")})

    df = spark.createDataFrame([("no water",)], "complaint_text string")
    row = enrich_complaints(df, scorer).first()
    assert row.issue_type == "Water Supply Disruption"
    assert (row.severity, row.urgency) == ("Medium", "Neutral")
    assert row.violations == ["category:null_output", "severity:null_output", "urgency:null_output"]

    def mixed(df):
        def listed(h):
            bad = scores.score_list([("a", float("nan")), ("b", 0.5)])
            good = scores.score_list([("a", 0.5), ("b", 0.5)])
            empty = F.array().cast(scores.SCORES)
            return F.when(F.col("id") == 1, good).when(F.col("id") == 2, bad).when(F.col("id") == 3, empty)

        return df.withColumns({f"{h}_scores": listed(h) for h in ("category", "severity", "urgency")})

    rows = spark.createDataFrame([(i, "x") for i in (1, 2, 3)], "id int, complaint_text string")
    found = violations(enrich_complaints(rows, mixed, keep=["id"])).collect()
    assert {(r.id, r.violations[0]) for r in found} == {(2, "category:score_not_a_number"), (3, "category:empty_output")}
