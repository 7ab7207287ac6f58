"""Readers for the log, raw grievances and annotations; schema padding and union."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline import vocab
from wardline.functions.spans import span

LOG_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in vocab.LOG_COLUMNS])


def pad_log(df: DataFrame) -> DataFrame:
    """Log columns first, blank where absent; further columns stay."""
    missing = {c: F.lit("") for c in vocab.LOG_COLUMNS if c not in df.columns}
    extra = [c for c in df.columns if c not in vocab.LOG_COLUMNS]
    return df.withColumns(missing).select(*vocab.LOG_COLUMNS, *extra)


def _csv(spark: SparkSession, path: str, multi_line: bool, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def read_log(spark: SparkSession, path: str, multi_line: bool = True, schema: T.StructType | None = None) -> DataFrame:
    """The complaint log as text columns; empty when there is none yet. Blank fields are NULL.

    Quoted texts may hold line breaks, so ``multi_line`` is on for this small interactive log; then a
    file is read by one task. Large exports without line breaks are split with ``multi_line=False``,
    and with ``schema`` nothing is read to learn the columns. Land them as Parquet once.
    """
    try:
        return pad_log(_csv(spark, path, multi_line, schema))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG_SCHEMA)


def read_grievances(spark: SparkSession, path: str, multi_line: bool = False, schema: T.StructType | None = None) -> DataFrame:
    """Raw grievances, blanks for missing fields; split over tasks unless ``multi_line`` is asked for."""
    return fill_blank(_csv(spark, path, multi_line, schema))


def read_enriched_log(spark: SparkSession, path: str) -> DataFrame:
    """The log that ``append_log`` writes: blank fields are NULL again, days prune folders."""
    df = spark.read.parquet(path)
    texts = {f.name: F.nullif(F.col(f.name), F.lit("")) for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    day = {"created_date": F.col("created_date").cast("string")}
    return df.withColumns({**texts, **day})


def fill_blank(df: DataFrame) -> DataFrame:
    """NULL text as blank."""
    return df.na.fill("")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """``text, entities`` from JSON lines with ``[start, end, label]`` triples.

    The span text is cut from the text, so misplaced offsets show.
    """
    raw = spark.read.schema("text string, entities array<array<string>>").json(path)

    def to_span(e):
        start, end = e[0].cast("int"), e[1].cast("int")
        return span(F.substring(F.col("text"), start + 1, end - start), e[2], start, end)

    return raw.select("text", F.transform("entities", to_span).alias("entities"))


def union_log(log: DataFrame, rows: DataFrame) -> DataFrame:
    """New rows under the log, by column name."""
    return log.unionByName(rows, allowMissingColumns=True)
