"""Dashboard tables over the complaint log.

Every table is one aggregation that combines before its shuffle; a label that holds a third of the
log therefore reaches the reducers as one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline import vocab
from wardline.functions.text import civic_category, parse_time, preview, words

SEVERITY_ORDER = ["High", "Medium", "Low"]
URGENCY_ORDER = ["Urgent", "Angry/Urgent", "Concerned", "Neutral"]
STRICT_URGENT = ("urgent",)
ANY_URGENT = ("urgent", "angry/urgent")


def _count() -> Column:
    return F.count(F.lit(1)).alias("n")


def event_time(df: DataFrame, strict: bool = False) -> Column:
    """``created_at`` as a time, parsed where the log holds text without ``created_ts`` beside it."""
    column = F.col("created_ts" if "created_ts" in df.columns else "created_at")
    if "created_ts" in df.columns:
        return column
    return parse_time(column, strict) if df.schema["created_at"].dataType.simpleString() == "string" else column


def event_day(df: DataFrame, strict: bool = False) -> Column:
    return F.to_date(event_time(df, strict))


def is_urgent(labels: Sequence[str] = STRICT_URGENT) -> Column:
    return F.coalesce(F.lower("urgency").isin(list(labels)), F.lit(False))


def percent(part: Column, whole: Column) -> Column:
    """Share in percent with one decimal, half to even."""
    return F.when(whole > 0, F.bround(part / whole * 100.0, 1)).otherwise(0.0)


def sort_key(column: str, order: Sequence[str]) -> Column:
    """Position in ``order``; unknown labels come after the known ones."""
    position = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(column))
    return F.when(position > 0, position).otherwise(len(order) + 1).cast("int").alias(f"{column}_key")


def most_frequent(df: DataFrame, column: str) -> DataFrame:
    """The most frequent value, the smallest one on a tie; NULL does not count."""
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(_count())
        .orderBy(F.desc("n"), column)
        .limit(1)
    )


def urgent_share(df: DataFrame, labels: Sequence[str] = STRICT_URGENT) -> DataFrame:
    counted = df.agg(F.count_if(is_urgent(labels)).alias("urgent"), F.count(F.lit(1)).alias("total"))
    return counted.select("urgent", "total", percent(F.col("urgent"), F.col("total")).alias("urgent_pct"))


def log_summary(
    df: DataFrame, as_of: date, urgent_labels: Sequence[str] = STRICT_URGENT
) -> DataFrame:
    """One row: total, last update, rows since ``as_of``, distinct issues, top issue and location.

    Three grouping sets share one scan and one shuffle. The second step reads the group counts, so
    distinct count and most frequent values cost no pass of their own.
    """
    facts = df.select(
        F.col("issue_type").alias("issue"),
        "location",
        event_time(df).alias("ts"),
        is_urgent(urgent_labels).alias("urgent"),
    )
    start = F.lit(f"{as_of} 00:00:00").cast(facts.schema["ts"].dataType)
    sets = facts.groupingSets(
        [[], [F.col("issue")], [F.col("location")]], F.col("issue"), F.col("location")
    ).agg(
        F.grouping_id().alias("gid"),
        F.count(F.lit(1)).alias("n"),
        F.max("ts").alias("last_update"),
        F.count_if(F.col("ts") >= start).alias("today_count"),
        F.count_if(F.col("urgent")).alias("urgent"),
    )
    return _summary(sets)


def _summary(sets: DataFrame) -> DataFrame:
    whole, by_issue, by_location = (F.col("gid") == F.lit(g) for g in (3, 1, 2))

    def top(column: str, rows: Column) -> Column:
        ranked = F.struct((-F.col("n")).alias("k"), F.col(column).alias("v"))
        return F.coalesce(F.min(F.when(rows & F.col(column).isNotNull(), ranked))["v"], F.lit(""))

    def only(column: str) -> Column:
        return F.max(F.when(whole, F.col(column)))

    total = F.coalesce(only("n"), F.lit(0))
    return sets.agg(
        total.alias("total"),
        F.count_if(by_issue & F.col("issue").isNotNull()).alias("issue_types"),
        F.coalesce(only("today_count"), F.lit(0)).alias("today_count"),
        percent(F.coalesce(only("urgent"), F.lit(0)), total).alias("urgent_pct"),
        top("issue", by_issue).alias("top_issue"),
        top("location", by_location).alias("top_location"),
        only("last_update").alias("last_update"),
    )


def issue_distribution(df: DataFrame) -> DataFrame:
    """Rows per civic category; issues are counted before their labels are mapped."""
    raw = df.groupBy("issue_type").agg(_count())
    return (
        raw.groupBy(civic_category(F.col("issue_type")).alias("issue_category"))
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "issue_category")
    )


def label_distribution(df: DataFrame, column: str) -> DataFrame:
    return (
        df.filter(F.col(column).isNotNull())
        .groupBy(column)
        .agg(_count())
        .orderBy(F.desc("n"), column)
    )


def severity_urgency(df: DataFrame) -> DataFrame:
    known = df.filter(F.col("severity").isNotNull() & F.col("urgency").isNotNull())
    return (
        known.groupBy("severity", "urgency")
        .agg(_count())
        .select(
            "severity", "urgency", "n", sort_key("severity", SEVERITY_ORDER), sort_key("urgency", URGENCY_ORDER)
        )
        .orderBy("severity_key", "urgency_key", "severity", "urgency")
    )


def severity_urgency_pivot(df: DataFrame, urgencies: Sequence[str] = tuple(URGENCY_ORDER)) -> DataFrame:
    """Matrix form: one row per severity, one column per urgency, 0 where nothing was seen.

    Labels beyond ``urgencies`` count as ``other``, so that a row sums to its severity.
    """
    known = df.filter(F.col("severity").isNotNull() & F.col("urgency").isNotNull())
    return known.groupBy("severity").agg(
        *[F.count_if(F.col("urgency") == u).alias(u.lower().replace("/", "_")) for u in urgencies],
        F.count_if(~F.col("urgency").isin(list(urgencies))).alias("other"),
    )


def daily_counts(df: DataFrame, strict: bool = False) -> DataFrame:
    return (
        df.select(event_day(df, strict).alias("day"))
        .filter(F.col("day").isNotNull())
        .groupBy("day")
        .agg(_count())
        .orderBy("day")
    )


def daily_urgency(df: DataFrame) -> DataFrame:
    return (
        df.select(event_day(df).alias("day"), "urgency")
        .filter(F.col("day").isNotNull() & F.col("urgency").isNotNull())
        .groupBy("day", "urgency")
        .agg(_count())
        .orderBy("day", "urgency")
    )


def in_range(df: DataFrame, start: str, end: str) -> DataFrame:
    """Rows with ``start <= created_at < end`` in UTC.

    Times and bounds are compared as times, whatever offset their text has. A log in folders by day reads those
    of the range only; stored times prune files.
    """
    ts = event_time(df)
    kind = df.select(ts).schema[0].dataType
    # Bounds are times first: an offset in their text may move them to another day.
    bounds = [F.lit(x).cast("timestamp") for x in (start, end)]
    rows = df.filter((ts >= bounds[0].cast(kind)) & (ts < bounds[1].cast(kind)))
    if "created_date" in df.columns:
        days = [x.cast("date").cast("string") for x in bounds]
        rows = rows.filter(F.col("created_date").between(*days))
    return rows


def latest(
    df: DataFrame,
    limit: int = 20,
    order: Sequence[str] = ("created_at", "complaint_id"),
    columns: Sequence[str] = tuple(vocab.LOG_COLUMNS),
) -> DataFrame:
    """The newest rows, newest first; only those of ``columns`` the log has."""
    shown = [c for c in dict.fromkeys([*columns, *order]) if c in df.columns]
    return df.select(*shown).orderBy(*[F.desc(c) for c in order if c in df.columns]).limit(limit)


def recent_analyses(df: DataFrame, limit: int = 5, text: str = "complaint_text") -> DataFrame:
    newest = latest(df, limit, columns=["issue_type", "severity", "urgency", text])
    return newest.withColumn("preview", preview(F.col(text))).drop(text)


def top_terms(
    df: DataFrame,
    text: str = "complaint_text",
    limit: int = 200,
    stop_words: Sequence[str] = tuple(vocab.STOP_WORDS),
) -> DataFrame:
    """Most frequent words of all texts together."""
    return (
        df.select(F.explode(words(F.col(text))).alias("term"))
        .filter(~F.col("term").isin(list(stop_words)))
        .groupBy("term")
        .agg(_count())
        .orderBy(F.desc("n"), "term")
        .limit(limit)
    )


def location_hotspots(
    df: DataFrame, limit: int = 10, urgent_labels: Sequence[str] = ANY_URGENT
) -> DataFrame:
    located = df.filter(F.col("location").isNotNull())
    return _hotspots(
        located.groupBy("location").agg(_count(), F.count_if(is_urgent(urgent_labels)).alias("urgent")), limit
    )


def _hotspots(counted: DataFrame, limit: int) -> DataFrame:
    return (
        counted.orderBy(F.desc("n"), "location")
        .limit(limit)
        .select("location", "n", percent(F.col("urgent"), F.col("n")).alias("urgent_pct"))
    )


def recommendation_load(df: DataFrame, recommendations: Column) -> DataFrame:
    return (
        df.select(F.explode(recommendations).alias("recommendation"))
        .groupBy("recommendation")
        .agg(_count())
        .orderBy(F.desc("n"), "recommendation")
    )


CUBE_KEYS = ["issue_type", "severity", "urgency", "location", "day"]
CUBE_SCHEMA = "issue_type string, severity string, urgency string, location string, day date, n long, last_update timestamp"


def log_cube(df: DataFrame) -> DataFrame:
    """The log as counts per issue, severity, urgency, location and day: all that the charts need."""
    keys = [F.col(c) for c in CUBE_KEYS[:-1]]
    facts = df.select(*keys, event_day(df).alias("day"), event_time(df).cast("timestamp").alias("ts"))
    return facts.groupBy(CUBE_KEYS).agg(_count(), F.max("ts").alias("last_update"))


def merge_cubes(cubes: DataFrame) -> DataFrame:
    """One cube from the rows of several."""
    return cubes.groupBy(CUBE_KEYS).agg(F.sum("n").alias("n"), F.max("last_update").alias("last_update"))


def cube_summary(cube: DataFrame, as_of: date, urgent_labels: Sequence[str] = STRICT_URGENT) -> DataFrame:
    """``log_summary`` from a cube."""
    sets = cube.withColumn("urgent", is_urgent(urgent_labels)).groupingSets(
        [[], [F.col("issue_type")], [F.col("location")]], F.col("issue_type"), F.col("location")
    ).agg(
        F.grouping_id().alias("gid"),
        F.sum("n").alias("n"),
        F.max("last_update").alias("last_update"),
        F.coalesce(F.sum(F.when(F.col("day") >= F.lit(as_of), F.col("n"))), F.lit(0)).alias("today_count"),
        F.coalesce(F.sum(F.when(F.col("urgent"), F.col("n"))), F.lit(0)).alias("urgent"),
    )
    return _summary(sets.withColumnRenamed("issue_type", "issue"))


def cube_hotspots(cube: DataFrame, limit: int = 10, urgent_labels: Sequence[str] = ANY_URGENT) -> DataFrame:
    """``location_hotspots`` from a cube."""
    urgent = F.coalesce(F.sum(F.when(is_urgent(urgent_labels), F.col("n"))), F.lit(0))
    located = cube.filter(F.col("location").isNotNull())
    return _hotspots(located.groupBy("location").agg(F.sum("n").alias("n"), urgent.alias("urgent")), limit)


def cube_rollup(cube: DataFrame) -> DataFrame:
    """``dashboard_rollup`` from a cube."""
    shown = cube.select(
        F.coalesce("issue_type", F.lit("")).alias("issue"),
        "severity",
        "urgency",
        "location",
        F.col("day").cast("string").alias("day"),
        F.col("n").alias("c"),
    )
    return _charts(shown)


def dashboard_rollup(df: DataFrame) -> DataFrame:
    """All distributions from one scan: ``chart, key1, key2, n``.

    The log shrinks to counts per combination first and only those are expanded into the grouping
    sets, so the scan is not multiplied by the number of charts.
    """
    cube = (
        df.select(
            F.coalesce("issue_type", F.lit("")).alias("issue"),
            "severity",
            "urgency",
            "location",
            event_day(df).cast("string").alias("day"),
        )
        .groupBy("issue", "severity", "urgency", "location", "day")
        .agg(F.count(F.lit(1)).alias("c"))
    )
    return _charts(cube)


def _charts(cube: DataFrame) -> DataFrame:
    issue, severity, urgency, location, day = (
        F.col(c) for c in ("issue", "severity", "urgency", "location", "day")
    )
    sets = cube.groupingSets(
        [[issue], [severity], [severity, urgency], [day], [day, urgency], [location]],
        issue, severity, urgency, location, day,
    ).agg(F.grouping_id().alias("gid"), F.sum("c").alias("n"))
    # Bit set means the column is rolled up: issue 16, severity 8, urgency 4, location 2, day 1.
    charts = {
        15: ("issue", civic_category(issue), None),
        23: ("severity", severity, None),
        19: ("severity_urgency", severity, urgency),
        30: ("day", day, None),
        26: ("day_urgency", day, urgency),
        29: ("location", location, None),
    }

    def pick(part: int) -> Column:
        cases = [
            F.when(F.col("gid") == gid, row[part] if isinstance(row[part], Column) else F.lit(row[part] or ""))
            for gid, row in charts.items()
        ]
        return F.coalesce(*cases)

    rows = sets.select(
        pick(0).alias("chart"), pick(1).alias("key1"), pick(2).alias("key2"), "n"
    ).filter(F.col("key1").isNotNull() & F.col("key2").isNotNull())
    # Several issue labels may share a category.
    return rows.groupBy("chart", "key1", "key2").agg(F.sum("n").alias("n"))
