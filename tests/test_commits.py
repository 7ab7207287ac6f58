from datetime import date

import pytest
from pyspark.sql import functions as F

from wardline.operators import dashboard
from wardline.sources.commits import CommittedLog, Commits, Version, commit_stream
from wardline.streaming.cubes import LiveCube, live_cube

SCHEMA = "id long, created_at string, issue_type string, severity string, urgency string, location string"


def _rows(spark, ids, day="2025-03-01"):
    """Rows spread over the hours of a day."""
    rows = [
        (i, f"{day}T{i % 24:02}:{i % 60:02}:00Z", ["road", None, "LABEL_3"][i % 3], ["High", "Low", None][i % 3 - 1],
         ["Urgent", "Angry/Urgent", "Neutral", None][i % 4], ["A", "B", "", None][i * 7 % 4])
        for i in ids
    ]
    return spark.createDataFrame(rows, SCHEMA)


def _log(spark, path):
    return CommittedLog(spark, str(path), spark.createDataFrame([], SCHEMA).schema)


def _ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_a_batch_counts_once(spark, tmp_path):
    log = _log(spark, tmp_path)
    assert log.read().collect() == [] and log.compact() == []
    assert log.append(_rows(spark, range(5)), 0)
    assert not log.append(_rows(spark, range(5)), 0)
    assert not _log(spark, tmp_path).append(_rows(spark, range(99)), 0)
    assert log.append(_rows(spark, range(5, 8)), 0, source="other")
    assert log.append(_rows(spark, []), 1)
    assert _ids(log.read()) == list(range(8))
    # A writer that dies before it publishes leaves rows that nobody sees.
    _rows(spark, range(50, 60)).withColumn("created_date", F.lit("2025-03-01")).write.partitionBy("created_date").parquet(
        log.commits.folder("dead")
    )
    assert _ids(log.read()) == list(range(8))


def test_compaction_of_a_day_in_fifty_batches(spark, tmp_path):
    log = _log(spark, tmp_path)
    for n in range(50):
        log.append(_rows(spark, range(n * 24, n * 24 + 24)).coalesce(1), n)
    log.append(_rows(spark, [5000], day="2025-03-02").coalesce(1), 50)
    assert log.files() == {"2025-03-01": 50, "2025-03-02": 1}
    before = log.read()
    size = sum(p["bytes"] for p in log.commits.latest().pieces if p["day"] == "2025-03-01")
    target = size // 5
    assert log.compact(target) == ["2025-03-01"]
    assert log.files()["2025-03-01"] <= size / target + 1 and log.files()["2025-03-02"] == 1
    want = [*range(1200), 5000]
    assert _ids(before) == want and _ids(log.read()) == want  # a reader of the old version goes on
    assert log.compact(target) == []
    hour = dashboard.in_range(log.read(), "2025-03-01T10:00:00Z", "2025-03-01T11:00:00Z")
    assert hour.count() == 50 and hour.select(F.input_file_name()).distinct().count() == 1
    plan = hour._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(created_date" in plan and "GreaterThanOrEqual(created_ts" in plan
    log.commits.vacuum(keep=1)
    assert _ids(log.read()) == want and len(log.commits._numbers()) == 1


def test_the_slower_writer_publishes_again(spark, tmp_path):
    commits = Commits(spark, str(tmp_path))
    asked = []

    def change(base):
        asked.append(base.number)
        if len(asked) == 1:  # another writer comes first
            Commits(spark, str(tmp_path)).publish(lambda b: Version(0, {"a": 1}, []))
        return Version(0, {**base.fences, "b": 2}, base.pieces)

    assert commits.publish(change) == Version(2, {"a": 1, "b": 2}, []) == commits.latest()
    assert asked == [0, 1]


def test_compaction_beside_a_writer(spark, tmp_path):
    log = _log(spark, tmp_path)
    for n in range(3):
        log.append(_rows(spark, [n]).coalesce(1), n)
    late = _log(spark, tmp_path)
    old = log.commits.latest()
    assert log.compact() == ["2025-03-01"]
    late.append(_rows(spark, [3]), 3)
    assert _ids(log.read()) == [0, 1, 2, 3] and _ids(log.read(old)) == [0, 1, 2]


def _charts(df):
    return sorted(map(str, df.collect()))


def test_live_cube_equals_the_batch(spark, tmp_path):
    day = date(2025, 3, 1)
    batches = [_rows(spark, range(n * 30, n * 30 + 30), day=f"2025-03-0{n % 3 + 1}") for n in range(10)]
    bad = spark.createDataFrame([(999, "no time", "road", "High", "Urgent", "A")], SCHEMA)
    batches[3] = batches[3].union(bad)
    seen = -1
    for n in [0, 1, 2, 3, 3, 4, 5, 6, 7, 8, 9, 9]:
        assert LiveCube(spark, str(tmp_path), fanout=3).add(batches[n], n) == (n > seen)
        seen = n
    cube = LiveCube(spark, str(tmp_path)).read()
    assert all(str(tmp_path) in f for f in cube.inputFiles())  # counts only, no log
    whole = batches[0]
    for more in batches[1:]:
        whole = whole.union(more)
    assert _charts(dashboard.cube_rollup(cube)) == _charts(dashboard.dashboard_rollup(whole))
    assert _charts(dashboard.cube_hotspots(cube)) == _charts(dashboard.location_hotspots(whole))
    for labels in (dashboard.STRICT_URGENT, dashboard.ANY_URGENT):
        assert dashboard.cube_summary(cube, day, labels).collect() == dashboard.log_summary(whole, day, labels).collect()
    levels = [p["level"] for p in LiveCube(spark, str(tmp_path)).commits.latest().pieces]
    assert len(levels) <= 2 * 3 and max(levels) >= 1


def test_no_batches(spark, tmp_path):
    cube = LiveCube(spark, str(tmp_path)).read()
    assert dashboard.cube_rollup(cube).collect() == []
    empty = spark.createDataFrame([], SCHEMA)
    assert dashboard.cube_summary(cube, date(2025, 1, 1)).collect() == dashboard.log_summary(empty, date(2025, 1, 1)).collect()


@pytest.mark.parametrize("kind", ["log", "cube"])
def test_streams_restart(spark, tmp_path, kind):
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    for part in range(3):
        _rows(spark, range(part * 10, part * 10 + 10)).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        if kind == "log":
            commit_stream(stream, _log(spark, tmp_path / "out"), checkpoint).awaitTermination()
        else:
            live_cube(stream, LiveCube(spark, str(tmp_path / "out")), checkpoint).awaitTermination()
    if kind == "log":
        assert _ids(_log(spark, tmp_path / "out").read()) == list(range(30))
    else:
        assert LiveCube(spark, str(tmp_path / "out")).read().agg(F.sum("n")).first()[0] == 30


def test_bounds_with_offsets_on_a_stored_log(spark, tmp_path):
    log = _log(spark, tmp_path)
    rows = spark.createDataFrame([(1, "2025-11-24T10:00:00Z"), (2, "2025-11-25T03:00:00Z"), (3, "2025-11-25T04:30:00Z")], "id long, created_at string")
    log = CommittedLog(spark, str(tmp_path), rows.schema)
    log.append(rows, 0)
    for df in (rows, log.read()):
        assert _ids(dashboard.in_range(df, "2025-11-24", "2025-11-24T23:30:00-05:00")) == [1, 2]
        assert _ids(dashboard.in_range(df, "2025-11-24T22:00:00-05:00", "2025-11-26")) == [2, 3]
