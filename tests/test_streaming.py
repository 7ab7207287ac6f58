from datetime import datetime

from pyspark.sql import functions as F

from wardline.operators import dashboard, enrich
from wardline.sources import fixtures
from wardline.streaming import live

from conftest import SF

LOG = "created_at timestamp, urgency string"


def _arrive(spark, path, rows):
    frame = spark.createDataFrame([(datetime.fromisoformat(t), u) for t, u in rows], LOG)
    frame.coalesce(1).write.mode("append").parquet(path)


def test_enriched_stream_equals_batch(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    rows = fixtures.complaints(spark, SF).select("complaint_id", "complaint_text")
    rows.repartition(3).write.parquet(source)

    def run(df):
        return enrich.enrich_complaints(df, enrich.stub_scorer, profile="stub", keep=["complaint_id"])

    for _ in range(2):  # the second start finds nothing new
        stream = live.read_stream(spark, source, rows.schema, maxFilesPerTrigger=1)
        live.run_once(live.enrich_stream(stream, run), out, state).awaitTermination()
    got, expected = spark.read.parquet(out), run(rows)
    assert got.count() == rows.count()
    assert got.exceptAll(expected).count() == 0


def test_live_dashboard_takes_late_rows(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    batches = [
        [("2024-01-05T10:00:00", "Neutral"), ("2024-01-09T10:00:00", "Neutral")],
        [("2024-01-01T00:00:00", "Neutral"), ("2024-01-09T11:00:00", "Concerned")],
    ]
    for batch in batches:
        _arrive(spark, source, batch)
        stream = live.read_stream(spark, source, LOG)
        live.refresh_table(live.live_daily_urgency(stream), out, state).awaitTermination()
    got = {tuple(r) for r in live.read_refreshed(spark, out).collect()}
    expected = {tuple(r) for r in dashboard.daily_urgency(spark.read.parquet(source)).collect()}
    assert got == expected and len(got) == 4


def test_windows_drop_rows_beyond_the_watermark(spark, tmp_path):
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    batches = [
        [("2024-01-05T10:00:00", "Neutral"), ("2024-01-09T10:00:00", "Neutral")],
        # One row is older than the watermark of 2024-01-08 10:00, one is late but in time.
        [("2024-01-05T11:00:00", "Neutral"), ("2024-01-08T12:00:00", "Neutral")],
        [("2024-01-20T00:00:00", "Neutral")],
    ]
    for batch in batches:
        _arrive(spark, source, batch)
        stream = live.read_stream(spark, source, LOG)
        live.run_once(live.windowed_urgency(stream), out, state).awaitTermination()
    got = {
        (r.d, r.n)
        for r in spark.read.parquet(out).select(F.to_date("window_start").cast("string").alias("d"), "n").collect()
    }
    assert got == {("2024-01-05", 1), ("2024-01-08", 1), ("2024-01-09", 1)}


def test_a_new_checkpoint_goes_on_above_old_versions(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for turn, rows in enumerate(([("2024-01-05T10:00:00", "Neutral")] * 2, [("2024-01-06T10:00:00", "Neutral")])):
        _arrive(spark, source, rows)
        stream = live.read_stream(spark, source, LOG)
        live.refresh_table(live.live_daily_urgency(stream), out, str(tmp_path / f"state{turn}")).awaitTermination()
    assert sum(r.n for r in live.read_refreshed(spark, out).collect()) == 3
    for turn in range(3):
        _arrive(spark, source, [("2024-01-07T10:00:00", "Neutral")])
        live.refresh_table(live.live_daily_urgency(live.read_stream(spark, source, LOG)), out, str(tmp_path / "state1")).awaitTermination()
    assert sum(r.n for r in live.read_refreshed(spark, out).collect()) == 6
    assert len(list((tmp_path / "out").glob("version=*"))) == 2
