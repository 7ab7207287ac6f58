import pytest
from pyspark.sql import functions as F

from wardline.operators.joins import measured_bytes


def test_bytes_by_type(spark):
    df = spark.range(3).select(
        F.lit("abcd").alias("s"),
        F.array(F.lit(1.0), F.lit(2.0)).alias("fixed"),
        F.array(F.lit("ab"), F.lit(None), F.lit("c" * 100)).alias("texts"),
        F.struct(F.lit(1).alias("i"), F.lit("xy").alias("t")).alias("r"),
        F.create_map(F.lit("k"), F.lit("v" * 50)).alias("m"),
        F.current_date().alias("d"),
        F.lit(None).cast("array<struct<a:string,b:double>>").alias("none"),
    )
    row = (4 + 16) + (2 * 8 + 24) + (24 + 18 + 8 + 116) + (16 + 8 + 18) + (24 + 17 + 24 + 66) + 8 + 8
    assert measured_bytes(df) == 3 * row
    assert measured_bytes(df.limit(0)) == 0


def test_unknown_types_are_refused(spark):
    with pytest.raises(TypeError):
        measured_bytes(spark.sql("select parse_json('1') as v"))
