from datetime import date

import pytest
from pyspark.sql import functions as F

from wardline.operators import dashboard
from wardline.sources.tables import LOG_SCHEMA


def _pairs(df):
    return [tuple(r) for r in df.collect()]


def test_golden_log(log):
    assert _pairs(dashboard.most_frequent(log, "issue_type")) == [("Road & Pothole Hazard", 4)]
    assert _pairs(dashboard.most_frequent(log, "location")) == [("Harbour Row", 5)]
    assert _pairs(dashboard.label_distribution(log, "severity")) == [("High", 9), ("Medium", 5), ("Low", 4)]
    assert _pairs(dashboard.label_distribution(log, "urgency")) == [
        ("Concerned", 8), ("Angry/Urgent", 5), ("Neutral", 5),
    ]
    assert _pairs(dashboard.daily_counts(log)) == [(date(2024, 3, 4), 7), (date(2024, 3, 5), 11)]
    assert _pairs(dashboard.daily_urgency(log)) == [
        (date(2024, 3, 4), "Angry/Urgent", 2), (date(2024, 3, 4), "Concerned", 2),
        (date(2024, 3, 4), "Neutral", 3), (date(2024, 3, 5), "Angry/Urgent", 3),
        (date(2024, 3, 5), "Concerned", 6), (date(2024, 3, 5), "Neutral", 2),
    ]
    matrix = {(r.severity, r.urgency): r.n for r in dashboard.severity_urgency(log).collect()}
    assert matrix == {
        ("High", "Angry/Urgent"): 5, ("High", "Concerned"): 3, ("High", "Neutral"): 1,
        ("Medium", "Concerned"): 4, ("Medium", "Neutral"): 1,
        ("Low", "Concerned"): 1, ("Low", "Neutral"): 3,
    }
    wide = {r.severity: r for r in dashboard.severity_urgency_pivot(log, ["Neutral"]).collect()}
    assert (wide["High"].neutral, wide["High"].other) == (1, 8)
    issues = dict(_pairs(dashboard.issue_distribution(log)))
    assert issues["Road & Pothole Hazard"] == 4 and issues["Town Council"] == 1
    assert sum(issues.values()) == 18


def test_summary(log):
    row = dashboard.log_summary(log, date(2024, 3, 5)).first()
    assert (row.total, row.issue_types, row.today_count, row.urgent_pct) == (18, 12, 11, 0.0)
    assert (row.top_issue, row.top_location) == ("Road & Pothole Hazard", "Harbour Row")
    assert row.last_update.isoformat() == "2024-03-05T23:59:01.250000"
    any_urgent = dashboard.log_summary(log, date(2024, 3, 5), dashboard.ANY_URGENT).first()
    assert any_urgent.urgent_pct == 27.8


def test_empty_log(spark):
    row = dashboard.log_summary(spark.createDataFrame([], LOG_SCHEMA), date(2025, 1, 1)).first()
    assert tuple(row) == (0, 0, 0, 0.0, "", "", None)


def test_ties_go_to_the_smaller_value(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), (None,), (None,)], "issue_type string")
    assert _pairs(dashboard.most_frequent(df, "issue_type")) == [("a", 1)]


def test_bad_times(spark):
    df = spark.createDataFrame([("x", "Neutral"), ("2025-01-02T00:00:00Z", None)], "created_at string, urgency string")
    assert _pairs(dashboard.daily_counts(df)) == [(date(2025, 1, 2), 1)]
    assert dashboard.daily_urgency(df).count() == 0
    with pytest.raises(Exception):
        dashboard.daily_counts(df, strict=True).collect()


def test_latest_and_range(log):
    newest = dashboard.latest(log, 3).collect()
    assert [r.created_at[:16] for r in newest] == ["2024-03-05T23:59", "2024-03-05T14:40", "2024-03-05T13:15"]
    assert dashboard.in_range(log, "2024-03-04T08:30", "2024-03-04T10:00").count() == 3
    recent = dashboard.recent_analyses(log).collect()
    assert len(recent) == 5 and all(len(r.preview) <= 160 for r in recent)


def test_rollup_is_the_union_of_the_charts(log):
    rows = {(r.chart, r.key1, r.key2): r.n for r in dashboard.dashboard_rollup(log).collect()}
    expected = {}
    for c, n in _pairs(dashboard.issue_distribution(log)):
        expected["issue", c, ""] = n
    for c, n in _pairs(dashboard.label_distribution(log, "severity")):
        expected["severity", c, ""] = n
    for r in dashboard.severity_urgency(log).collect():
        expected["severity_urgency", r.severity, r.urgency] = r.n
    for d, n in _pairs(dashboard.daily_counts(log)):
        expected["day", str(d), ""] = n
    for d, u, n in _pairs(dashboard.daily_urgency(log)):
        expected["day_urgency", str(d), u] = n
    for r in log.filter("location is not null").groupBy("location").agg(F.count("*").alias("n")).collect():
        expected["location", r.location, ""] = r.n
    assert rows == expected
