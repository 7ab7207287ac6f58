from pyspark.sql import functions as F

from wardline import vocab
from wardline.operators import dashboard
from wardline.operators.weak_labels import build_weak_labels
from wardline.sources import sinks, tables

from conftest import DATA


def test_read_log(spark, log):
    assert log.columns == vocab.LOG_COLUMNS
    assert log.count() == 18
    assert log.filter("location is null").count() == 7
    assert tables.read_log(spark, f"{DATA}/absent.csv").columns == vocab.LOG_COLUMNS
    assert tables.read_log(spark, f"{DATA}/absent.csv").count() == 0


def test_pad_log(spark):
    padded = tables.pad_log(spark.createDataFrame([("t", 1)], "complaint_text string, extra int"))
    assert padded.columns == [*vocab.LOG_COLUMNS, "extra"]
    assert tuple(padded.first()) == ("", "", "", "", "", "t", 1)


def test_union(spark, log):
    more = spark.createDataFrame([("Low", "t")], "severity string, complaint_text string")
    both = tables.union_log(log, more)
    assert both.count() == 19 and both.filter("issue_type is null").count() == 1


def test_annotations(annotations):
    rows = annotations.orderBy("text").collect()
    assert [tuple(e) for e in rows[0].entities] == [
        (" Kestrel Wharf Step", "LOCATION", 21, 40), ("railing", "PROBLEM", 7, 14),
    ]


def test_append_by_day(spark, log, tmp_path):
    path = str(tmp_path / "log")
    sinks.append_log(log, path)
    sinks.append_log(log.limit(3), path)
    back = spark.read.parquet(path)
    assert back.count() == 21
    assert {str(r.created_date) for r in back.select("created_date").distinct().collect()} == {"2024-03-04", "2024-03-05"}


def test_csv_round_trip(spark, log, tmp_path):
    path = str(tmp_path / "new" / "export")
    sinks.export_csv(log, path)
    sinks.export_csv(log, path)
    assert tables.read_log(spark, path).exceptAll(log).count() == 0
    sinks.append_csv(log.limit(2), path)
    assert tables.read_log(spark, path).count() == 20


def test_weak_labels(spark, tmp_path):
    rows = [
        ("Electrical", "Street-Light", "Ward  1", "not   working"), ("Lakes", None, "W", None),
        ("A", "Fogging", "W", "delay"), ("B", "x", "W", "Assigned"),
    ]
    path = str(tmp_path / "raw")
    schema = ", ".join(f"`{c}` string" for c in vocab.RAW_COLUMNS)
    sinks.export_csv(spark.createDataFrame(rows, schema), path)
    raw = tables.read_grievances(spark, path)
    assert raw.filter(F.col("Sub Category") == "").count() == 1
    got = {r.category: tuple(r) for r in build_weak_labels(raw).collect()}
    assert got["Electrical"] == ("Electrical - Street-Light in Ward 1. not working", "Electrical", "HIGH", "URGENT")
    assert got["Lakes"] == ("Lakes - in W.", "Lakes", "MEDIUM", "CONCERNED")
    assert got["A"][2:] == ("LOW", "CONCERNED")
    assert got["B"][2:] == ("MEDIUM", "NEUTRAL")
    without = build_weak_labels(raw.select("Category", "Ward Name")).filter("category = 'Lakes'").first()
    assert without.text == "Lakes - Unknown in W."


def test_enriched_log_round_trip(spark, tmp_path):
    rows = [("2025-11-24T23:30:00-05:00", ""), ("2025-11-25T10:00:00Z", "x"), ("no time", "")]
    log = spark.createDataFrame(rows * 50, "created_at string, location string").repartition(8)
    path = str(tmp_path / "log")
    sinks.append_log(log, path)
    back = tables.read_enriched_log(spark, path)
    assert back.filter("location is null").count() == 100
    day = dashboard.in_range(back, "2025-11-25", "2025-11-26")
    assert day.count() == 100
    assert "created_date#" in day._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    files = list((tmp_path / "log").rglob("*.parquet"))
    assert len(files) <= 3 * 2


def test_csv_is_split_unless_line_breaks_are_asked_for(spark, tmp_path):
    rows = [(f"cat {i}", "line one\nline two") for i in range(3000)]
    plain = spark.createDataFrame([(a, "text") for a, _ in rows], "Category string, `Staff Remarks` string").coalesce(1)
    sinks.export_csv(plain, str(tmp_path / "plain"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        split = tables.read_grievances(spark, str(tmp_path / "plain"), schema=plain.schema)
        assert split.rdd.getNumPartitions() > 1 and split.count() == 3000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    broken = spark.createDataFrame(rows, "Category string, `Staff Remarks` string")
    sinks.export_csv(broken, str(tmp_path / "broken"))
    assert tables.read_grievances(spark, str(tmp_path / "broken"), multi_line=True).exceptAll(broken).count() == 0
