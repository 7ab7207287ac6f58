"""Lookup joins whose strategy follows the measured size of the lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A lookup table is broadcast only if its measured bytes stay below this.
BROADCAST_BYTES = 32_000_000


def _bytes(column: Column, kind: T.DataType) -> Column:
    """Bytes of a value, by its type; a type that is not known is refused rather than guessed."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        size = F.octet_length(column) + 16
    elif isinstance(kind, T.ArrayType):
        if _fixed(kind.elementType):
            size = F.size(column) * _fixed(kind.elementType) + 24
        else:
            size = F.aggregate(column, F.lit(24), lambda n, x: n + _bytes(x, kind.elementType).cast("int"))
    elif isinstance(kind, T.MapType):
        size = _bytes(F.map_keys(column), T.ArrayType(kind.keyType)) + _bytes(F.map_values(column), T.ArrayType(kind.valueType))
    elif isinstance(kind, T.StructType):
        size = sum([_bytes(column[f.name], f.dataType) for f in kind.fields], F.lit(16))
    elif _fixed(kind):
        return F.lit(_fixed(kind))
    else:
        raise TypeError(f"no size known for {kind.simpleString()}")
    return F.coalesce(size, F.lit(8))


def _fixed(kind: T.DataType) -> int:
    """Bytes of a type whose values are all of one size, 0 for others."""
    if isinstance(kind, T.DecimalType):
        return 24
    return 8 if isinstance(kind, (T.NumericType, T.BooleanType, T.DatetimeType, T.AnyTimeType, T.DayTimeIntervalType)) else 0


def measured_bytes(lookup: DataFrame) -> int:
    """Bytes of all rows, counted; for stored tables, as the table is read for it."""
    width = sum([_bytes(F.col(f"`{f.name}`"), f.dataType).cast("long") for f in lookup.schema.fields], F.lit(0))
    return lookup.agg(F.sum(width)).first()[0] or 0


def lookup_join(facts: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """Inner join of many ``facts`` with a stored ``lookup`` table that has one row per key.

    A lookup whose bytes are counted and small is broadcast and the facts stay where they are.
    Otherwise both sides are shuffled on the key; adaptive execution splits the facts of a frequent
    key over tasks and repeats only the lookup rows of that partition.
    """
    if measured_bytes(lookup) <= BROADCAST_BYTES:
        return facts.join(F.broadcast(lookup), key)
    return facts.join(lookup, key)
