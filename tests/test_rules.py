from pyspark.sql import functions as F

from wardline.functions import rules
from wardline.functions.text import normalize_text

SEVERITY = [
    "Medium", None, "Medium", "Low", "High", "Medium", None, "High", "Medium", "Low", "High", "Low", "High",
    None, "Low", "High", None, "Medium",
]
URGENT_HITS = [0, 0, 0, 0, 3, 0, 2, 1, 0, 0, 0, 0, 1, 0, 0, 3, 0, 0]
CONCERNED_HITS = [1, 0, 0, 0, 0, 1, 0, 2, 1, 0, 1, 1, 0, 3, 0, 0, 1, 1]
CATEGORY = {
    1: "Street Lighting Fault", 2: "Water Supply Disruption", 3: "Waste & Sanitation", 4: "General Complaint",
    5: "Electrical Hazard", 6: "Road & Pothole Hazard", 7: "Infrastructure Damage", 9: "Drainage / Flooding",
    11: "Public Safety Concern", 14: "Water Supply Disruption", 18: "Road & Pothole Hazard",
}


def _rows(log, *columns):
    from wardline.vocab import LOG_COLUMNS

    return log.select(*LOG_COLUMNS, *columns).orderBy("created_at").collect()


def test_golden_log(log):
    raw = F.col("complaint_text")
    urgent, concerned = rules.urgency_hits(normalize_text(raw))
    rows = _rows(
        log,
        rules.severity_hint(raw).alias("s"),
        rules.urgency_hint(normalize_text(raw)).alias("u"),
        urgent.alias("nu"),
        concerned.alias("nc"),
        rules.keyword_category(raw).alias("c"),
    )
    assert [r.s for r in rows] == SEVERITY
    assert [r.nu for r in rows] == URGENT_HITS
    assert [r.nc for r in rows] == CONCERNED_HITS
    for number, category in CATEGORY.items():
        assert rows[number - 1].c == category
    for row in rows:
        assert row.s in (None, row.severity)
        assert row.u in (None, row.urgency)


def _one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).cast("string").alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first().x


def test_word_edges(spark):
    c = F.col("t")
    cases = {"leaking pipe": None, "leak": "Medium", "dangerous": None, "": None, "Short \n circuit": "High",
             "éclean": None, "clean_up": None, "Electric pole failure": "High", "DEBRIS.": "Low"}
    for text, expected in cases.items():
        assert _one(spark, rules.severity_hint(c), t=text) == expected, text
    assert _one(spark, rules.urgency_hint(c), t="fix it!!!") == "Angry/Urgent"
    assert _one(spark, rules.keyword_category(c), t="plane") == "Road & Pothole Hazard"


def test_evidence_is_sorted(spark):
    c = F.col("t")
    why = rules.category_rationale(c, rules.keyword_category(c))
    assert _one(spark, why, t="Water tank, no supply") == "Matched keywords: supply, tank, water"
    assert _one(spark, why, t="hello") == "No strong domain keywords; preserving model output"


def test_fusion(spark):
    m, k, conf = F.col("m"), F.col("k"), F.col("c").cast("double")
    fused = rules.fused_category(m, k, conf)
    assert _one(spark, fused, m="A", k="B", c=0.67) == "B"
    assert _one(spark, fused, m="A", k="B", c=0.68) == "A"
    assert _one(spark, fused, m="A", k="General Complaint", c=0.1) == "A"


def test_recommendations(spark):
    recs = F.size(rules.recommendations(F.col("s"), F.col("u"), F.col("i")))
    assert _one(spark, recs, s="High", u="Angry/Urgent", i="Road & Pothole Hazard") == 3
    assert _one(spark, recs, s="Low", u="Neutral", i="Lakes") == 1
