import pytest
from pyspark.sql import functions as F

import __spark_entry__
from wardline.operators import dashboard, enrich, features
from wardline.plans.catalog import QUERIES
from wardline.sources import fixtures

from conftest import SF

PYTHON_QUERIES = {"encode_udf": "MapInPandas", "enrich_model": "MapInArrow", "enrich_complaints": "MapInArrow", "eval_metrics": "MapInArrow"}
PYTHON_QUERIES |= {"rule_table_category": "MapInArrow", "rule_table_levels": "MapInArrow", "rule_table_phrases": "MapInArrow"}
ACTIONS = {"stream_enrich", "stream_daily_urgency", "stream_windows", "stream_sliding_windows", "stream_cube", "softmax_eval"}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - ACTIONS))
def test_no_python_and_no_cross_join(spark, name):
    plan = _plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    python = [x for x in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "MapInArrow", "FlatMapGroups") if x in plan]
    assert python == ([PYTHON_QUERIES[name]] if name in PYTHON_QUERIES else [])


def test_stub_enrichment_is_narrow(spark, tmp_path):
    fixtures.complaints(spark, SF).repartition(8).write.parquet(str(tmp_path / "c"))
    df = spark.read.parquet(str(tmp_path / "c"))
    plan = _plan(enrich.enrich_complaints(df, enrich.stub_scorer, profile="stub", keep=["complaint_id"]))
    assert "Exchange" not in plan
    assert "ReadSchema: struct<complaint_id:bigint,complaint_text:string>" in plan


def test_range_filter_reaches_the_scan(spark, tmp_path):
    fixtures.complaint_log(spark, SF).write.parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    plan = _plan(dashboard.daily_counts(dashboard.in_range(log, "2024-01-10", "2024-01-20")))
    assert "PushedFilters: [IsNotNull(created_at), GreaterThanOrEqual(created_at" in plan
    assert "ReadSchema: struct<created_at:timestamp_ntz>" in plan


def test_rollup_scans_once_with_two_shuffles_of_counts(spark, tmp_path):
    fixtures.complaint_log(spark, SF).write.parquet(str(tmp_path / "log"))
    plan = _plan(dashboard.dashboard_rollup(spark.read.parquet(str(tmp_path / "log"))))
    assert plan.count("FileScan") == 1
    assert plan.count("Exchange") == 3
    assert "complaint_text" not in plan


def test_a_large_vocabulary_is_not_broadcast(spark, tmp_path):
    words = spark.range(2_000_000).select(F.format_string("word%08d", "id").alias("term"), F.col("id").cast("int").alias("idx"), F.lit(1.0).alias("idf"))
    words.write.parquet(str(tmp_path / "v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # else Spark may send the few texts instead
    try:
        plan = _plan(features.transform_tfidf(fixtures.table(spark, SF, "documents"), spark.read.parquet(str(tmp_path / "v")), "doc_id", "text"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def _stripped(plan):
    return [w for w in ("Exchange", "SortMergeJoin", "BroadcastHashJoin", "Window") for _ in range(plan.count(w))]


@pytest.mark.parametrize("name", ["encode_hash", "tfidf_transform", "enrich_stub", "token_tags", "nb_score"])
def test_plans_do_not_depend_on_the_number_of_splits(spark, tmp_path, name):
    plans = []
    for splits in (1, 16):
        folder = tmp_path / str(splits)
        for t in ("documents", "labels", "events"):
            spark.read.parquet(f"{SF}/{t}.parquet").repartition(splits).write.parquet(str(folder / f"{t}.parquet"))
        plans.append(_stripped(_plan(QUERIES[name](spark, str(folder)))))
    assert plans[0] == plans[1]


def test_the_flagship_scans_once_and_moves_no_text(spark):
    plan = _plan(QUERIES["enrich_complaints"](spark, SF))
    assert plan.count("FileScan") == 1 and "Exchange" not in plan


def test_contract(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() == 1000


def test_event_time_of_text_and_time(spark, log):
    assert log.select(dashboard.event_time(log)).schema[0].dataType.simpleString() == "timestamp"
    assert log.filter(F.col("created_at").isNull()).count() == 0
