import pytest
from pyspark.sql import functions as F

from wardline.functions import checks
from wardline.operators import quality

ENTRIES = "id int, e array<struct<label:string,score:string>>"
CASES = [
    (1, [("LABEL_0", "0.8"), ("LABEL_1", "0.2")], None),
    (2, None, "null_output"),
    (3, [], "empty_output"),
    (4, [(None, "0.5")], "missing_label"),
    (5, [("test", None)], "missing_score"),
    (6, [("test", "bad")], "score_not_numeric"),
    (7, [("a", "0.5"), ("b", "bad"), (None, "1")], "score_not_numeric"),
]


def _checked(spark, rows, least=0.0, expected=None):
    df = spark.createDataFrame(rows, ENTRIES)
    e = F.col("e")
    return quality.check(df, checks.scores_error(e, least), checks.scores_warnings(e, expected, least))


def test_score_lists(spark):
    checked = _checked(spark, [c[:2] for c in CASES])
    assert {r.id: r.error for r in checked.collect()} == {c[0]: c[2] for c in CASES}
    clean, violations = quality.split(checked)
    assert [r.id for r in clean.collect()] == [1]
    assert violations.count() == 6


def test_thresholds(spark):
    rows = [(1, [("LABEL_0", "0.9"), ("LABEL_1", "0.05"), ("LABEL_2", "0.05")])]
    df = spark.createDataFrame(rows, ENTRIES)
    kept = df.select(*[F.size(checks.kept_scores(F.col("e"), m)) for m in (0.1, 0.0)]).first()
    assert tuple(kept) == (1, 3)
    assert _checked(spark, rows, 0.95).first().error == "below_confidence"


def test_nested_list(spark):
    df = spark.createDataFrame([([[("LABEL_0", 0.9)]],)], "n array<array<struct<label:string,score:double>>>")
    assert df.select(F.size(checks.unwrap(F.col("n"))).alias("n")).first().n == 1


def test_warnings_and_report(spark):
    rows = [(1, [("a", "1.5")]), (2, [("z", "0.5")]), (3, None)]
    checked = _checked(spark, rows, expected=["a"])
    assert {r.id: r.warnings for r in checked.collect()} == {1: ["score_out_of_range"], 2: ["unexpected_label"], 3: []}
    assert {tuple(r) for r in quality.report(checked).collect()} == {
        ("error", "null_output", 1), ("warning", "score_out_of_range", 1), ("warning", "unexpected_label", 1),
    }


def test_fail_fast(spark):
    good, bad = CASES[0][:2], CASES[1][:2]
    assert quality.require(_checked(spark, [good]), "id").count() == 1
    with pytest.raises(Exception, match="null_output at 2"):
        quality.require(_checked(spark, [good, bad]), "id").collect()


def test_probabilities(spark):
    rows = [("High", [0.1, 0.2, 0.7]), ("High", [0.1, 0.2, 0.709]), ("Odd", [0.5, 0.6, -0.1]), (None, [0.1])]
    df = spark.createDataFrame(rows, "label string, p array<double>")
    got = df.select(
        checks.prediction_error(F.col("label")),
        checks.probability_warnings(F.col("p"), F.col("label"), ["Low", "High"]),
    ).collect()
    assert [tuple(r) for r in got] == [
        (None, []), (None, []), (None, ["unexpected_label", "probability_out_of_range"]), ("null_label", ["sum_not_one"]),
    ]


def test_row_counts_must_match(spark):
    labels = spark.createDataFrame([(1, "High")], "id int, label string")
    probabilities = spark.createDataFrame([(1, [0.1]), (2, [0.3])], "id int, p array<double>")
    got = {r.id: r.row_error for r in quality.match_rows(labels, probabilities, "id").collect()}
    assert got == {1: None, 2: "missing_label_row"}


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [([1.0, 2.0],), (None,), ([1.0, nan],), ([1.0, -inf],), ([1.0],)]
    df = spark.createDataFrame(rows, "v array<double>")
    got = [r.e for r in df.select(checks.vector_error(F.col("v"), 2).alias("e")).collect()]
    assert got == [None, "null_vector", "nan_value", "inf_value", "wrong_dimension"]
    assert df.filter(checks.vector_error(F.col("v")).isNull()).count() == 2
    assert df.select(checks.as_vector(F.col("v"), "float").alias("v")).schema["v"].dataType.simpleString() == "array<float>"


def _coded(spark, n=50):
    rows = [(i, [None, "a", "b", "odd"][i % 4], [["w"], [], ["w", "w"], ["x"]][i % 4]) for i in range(n)]
    return spark.createDataFrame(rows, "id int, error string, warnings array<string>")


def _counts(report):
    return {(r.level, r.code): r.n for r in report.collect()}


def test_report_observed_while_writing(spark, tmp_path):
    checked = _coded(spark)
    observed = _counts(quality.write_clean(checked, str(tmp_path / "a"), ["a", "b", "odd", "never"], ["w", "x"]))
    assert observed == _counts(quality.report(checked))
    clean = spark.read.parquet(str(tmp_path / "a"))
    assert sorted(r.id for r in clean.collect()) == list(range(0, 50, 4)) and clean.columns == ["id"]
    unknown = _counts(quality.write_clean(checked, str(tmp_path / "b"), ["a"]))
    assert unknown == {("error", "a"): 13, ("error", "other"): 24, ("warning", "other"): 13 + 24 + 12}
    empty = quality.write_clean(checked.limit(0), str(tmp_path / "c"), ["a"], most_errors=0.0)
    assert _counts(empty) == {}


def test_too_many_errors(spark, tmp_path):
    with pytest.raises(quality.TooManyErrors) as stopped:
        quality.write_clean(_coded(spark), str(tmp_path / "a"), ["a", "b", "odd"], most_errors=0.5)
    assert stopped.value.rows == 50 and stopped.value.counts["error", "b"] == 12


def test_report_of_a_stream(spark, tmp_path):
    _coded(spark).write.parquet(str(tmp_path / "in"))
    reports = {}

    def take(batch, number):
        reports[number] = _counts(quality.write_clean(batch, str(tmp_path / f"out-{number}"), ["a", "b", "odd"], ["w", "x"]))

    stream = spark.readStream.schema("id int, error string, warnings array<string>").parquet(str(tmp_path / "in"))
    stream.writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert reports == {0: _counts(quality.report(_coded(spark)))}
