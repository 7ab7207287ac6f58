"""Complaint-shaped tables derived from the given tables, one row per row of their source.

Nothing here is generated on the driver: each frame is a projection of a table and grows with it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline import vocab
from wardline.functions import rules, scores
from wardline.functions.text import let, normalize_text

SUBJECTS = [
    "The street light has not been working", "Street light not working",
    "Residents have had no water supply", "Garbage heap has not been cleared",
    "Large pothole on the main road needs repair", "Strong gas leak smell and risk of fire",
    "A wall has suddenly collapsed near the bridge", "Short circuit issue in the transformer",
    "Debris removal request", "Routine sweeping of the lane", "Drain is clogged and sewage overflow",
    "Ward mapping noted",
]
PLACES = ["Jayanagar", "Indiranagar", "Rajajinagar", "Vijayanagar", "Koramangala", ""]
TONES = [
    "please respond immediately!!!", "I am worried", "still not fixed for weeks", "",
    "sent via https://example.org/x?id=1",
]
CATEGORIES = [
    "Electrical", "Solid Waste (Garbage) Related", "Road Maintenance(Engg)", "Health Dept", "Water Crisis",
]
SUB_CATEGORIES = [
    "Street Light Not Working", "Garbage dump", "Pot-hole", "Fogging", "No supply", "Safety wall", "Mapping",
]
REMARKS = [
    "Forwarded to ward", None, "short-circuit  risk", "Noted", "needs quick fix", "delay in repair",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def phrase(phrases: list[str | None], number: Column) -> Column:
    return F.get(F.array(*[F.lit(p) for p in phrases]), F.pmod(number, F.lit(len(phrases))).cast("int"))


def complaints_from(events: DataFrame) -> DataFrame:
    """``complaint_id, created_at, model_label, model_confidence, location, complaint_text``."""
    event, user = F.col("event_id"), F.col("user_id")
    rows = events.select(
        event.alias("complaint_id"),
        F.col("ts").alias("created_at"),
        F.concat(F.lit("LABEL_"), (event % 31).cast("string")).alias("model_label"),
        ((40 + (event * 37) % 60) / F.lit(100.0)).alias("model_confidence"),
        phrase(SUBJECTS, event).alias("_subject"),
        phrase(PLACES, user).alias("_place"),
        phrase(TONES, event + user).alias("_tone"),
    )
    place, tone = F.col("_place"), F.col("_tone")
    body = F.concat(
        "_subject",
        F.when(place == "", "").otherwise(F.concat(F.lit(" in "), place)),
        F.when(tone == "", "").otherwise(F.concat(F.lit(", "), tone)),
    )
    return rows.select(
        "complaint_id",
        "created_at",
        "model_label",
        "model_confidence",
        F.nullif(place, F.lit("")).alias("location"),
        body.alias("complaint_text"),
    )


def complaints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complaints_from(table(spark, sf_dir, "events"))


def log_from(complaint_rows: DataFrame) -> DataFrame:
    """A complaint log labelled by the rules; the model label stands where it is confident."""
    text = F.col("complaint_text")
    sure = F.col("model_confidence") >= 0.68
    by_keyword = let(
        rules.keyword_category(text), lambda c: F.when(c != vocab.GENERAL, c)
    )
    return complaint_rows.select(
        "complaint_id",
        "created_at",
        F.when(sure, F.col("model_label")).otherwise(by_keyword).alias("issue_type"),
        rules.severity_hint(text).alias("severity"),
        rules.urgency_hint(normalize_text(text)).alias("urgency"),
        "location",
        "complaint_text",
    )


def complaint_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_from(complaints(spark, sf_dir))


def grievances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``grievance_id`` and the four columns of the raw table, one row per order."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    # Nations are few and Spark sees that from their file size.
    home = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    key, customer_key = F.col("o_orderkey"), F.col("o_custkey")
    placed = orders.join(home, F.col("c_custkey") == customer_key)
    return placed.select(
        key.alias("grievance_id"),
        phrase(CATEGORIES, key).alias("Category"),
        phrase(SUB_CATEGORIES, key).alias("Sub Category"),
        F.col("n_name").alias("Ward Name"),
        phrase(REMARKS, customer_key).alias("Staff Remarks"),
    )


def probability(key: Column, labels: list[str]) -> Column:
    """A score list per row: shares of pseudo-random whole numbers."""
    raw = [(1 + F.pmod(key * 7919 + k * 104729, F.lit(97))).cast("double") for k in range(len(labels))]
    mass = sum(raw[1:], raw[0])
    return scores.score_list([(name, r / mass) for name, r in zip(labels, raw)])


def document_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, scores`` with some empty lists and some without mass."""
    doc = F.col("doc_id")
    full = probability(doc, ["Low", "Medium", "High"])
    zeros = scores.score_list([("Low", 0.0), ("Medium", 0.0), ("High", 0.0)])
    empty = F.array().cast(scores.SCORES)
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(doc % 17 == 0, empty).when(doc % 13 == 0, zeros).otherwise(full).alias("scores"),
    )


def damaged_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, entries`` with one kind of damage for each last digit of the id, most without."""
    doc = F.col("doc_id")
    kind = doc % 10

    def item(x: Column, i: Column) -> Column:
        label = F.when((kind == 2) & (i == 1), F.lit(None)).otherwise(x["label"])
        score = (
            F.when((kind == 3) & (i == 2), F.lit(None))
            .when((kind == 4) & (i == 0), F.lit("1.5"))
            .when((kind == 6) & (i == 1), F.lit("bad"))
            .when(kind == 5, (x["score"] * 0.5).cast("string"))
            .otherwise(x["score"].cast("string"))
        )
        return F.struct(label.cast("string").alias("label"), score.cast("string").alias("score"))

    entries = F.transform(probability(doc, ["Low", "Medium", "High"]), item)
    empty = F.array().cast("array<struct<label:string,score:string>>")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.when(kind == 0, F.lit(None)).when(kind == 1, empty).otherwise(entries).alias("entries"),
    )


def raw_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complaints with entity lists that have gaps: missing lists, labels, texts and offsets."""
    rows = complaints(spark, sf_dir)
    key, text, place = F.col("complaint_id"), F.col("complaint_text"), F.col("location")
    damage = key % 5
    first = F.substring_index(text, " ", 1)
    at = F.instr(text, place) - 1
    labels = ["GPE", "loc", "LOCATION", "ORG"]

    def item(body: Column, label: Column, start: Column, end: Column) -> Column:
        return F.struct(
            body.cast("string").alias("text"),
            label.cast("string").alias("label"),
            start.cast("int").alias("start"),
            end.cast("int").alias("end"),
        )

    found = F.array_compact(
        F.array(
            F.when(place.isNotNull(), item(place, phrase(labels, key), at, at + F.length(place))),
            item(
                F.when(damage != 1, first),
                F.when(damage == 3, F.lit("")).when(damage != 0, F.lit("PROBLEM")),
                F.when(damage != 2, F.lit(0)),
                F.when(damage != 2, F.length(first)),
            ),
            item(F.left(text, F.lit(20)), F.lit("AREA"), F.lit(0), F.lit(20)),
        )
    )
    return rows.select("complaint_id", "complaint_text", F.when(key % 11 != 0, found).alias("entities"))
