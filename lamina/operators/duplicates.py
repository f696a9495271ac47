"""Equal rows and keys, found by digests first: whole rows are compared only where digests repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import cut
from . import references

#: Rows of up to so many bytes, by their types, are grouped as they are: a digest and its count would be no smaller.
NARROW = 64


def width(schema: T.StructType) -> int:
    """About how many bytes a row of the schema has; texts, binaries and nested values count as 32."""
    fixed = {T.ByteType: 1, T.BooleanType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4, T.LongType: 8, T.DoubleType: 8, T.TimestampType: 8, T.TimestampNTZType: 8, T.DecimalType: 16}
    return sum(fixed.get(type(f.dataType), 32) for f in schema)


def digests(df: DataFrame) -> list[Column]:
    """Two 64-bit digests of a row, equal for rows that grouping takes as equal.

    NULLs, which a hash passes over, are told by a mark for each column; zeros of either sign and all NaNs are made one. Columns of
    nested types are left out, so rows that differ there alone have equal digests, which costs a comparison and no row.
    """
    parts = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            continue
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.when(F.isnan(c), F.lit(float("nan")).cast(f.dataType)).otherwise(c + F.lit(0.0).cast(f.dataType))
        parts += [c, c.isNull()]
    return [F.xxhash64(*parts, F.lit(seed)).alias(f"_d{seed}") for seed in (1, 2)]


def repeats(df: DataFrame) -> DataFrame:
    """The distinct rows that are there more than once, and ``_n``, how often; NULLs are equal to each other.

    Of wide rows only 16 bytes travel first. Rows whose digest is there twice are then found where they lie, by a broadcast of
    those digests, by a Bloom filter if they are more, and grouped whole; unique rows stay where they are.
    """
    columns = [F.col(f"`{c}`") for c in df.columns]
    whole = lambda rows: rows.groupBy(*columns).agg(F.count("*").alias("_n")).where("_n > 1")
    if width(df.schema) <= NARROW:
        return whole(df)
    one, two = digests(df)
    twice = cut(df.select(one, two).groupBy("_d1", "_d2").agg(F.count("*").alias("_n")).where("_n > 1").select("_d1"))
    n = twice.count()
    if n > references.FILTER_KEYS:
        return whole(df)
    told = df.withColumn("_d1", one)
    if n <= references.BROADCAST_KEYS:
        return whole(told.join(F.broadcast(twice.distinct()), "_d1", "left_semi"))
    blocks = references.blocks_for(n)
    flags = cut(references.key_filter(twice, "_d1", blocks))
    return whole(references.maybe_in(told, "_d1", flags, blocks).where("_maybe"))
