"""Numbering and looking ahead within a group of any size: ranges of the order are worked on apart and joined at their borders."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import cut

#: Rows of a range, about.
RANGE = 100_000


def ranges(df: DataFrame, group: str, order: Sequence[str], rows: int = RANGE) -> DataFrame:
    """``df``, written, with ``_tie``, a hash of all columns, and ``_part``, the range of group, order and tie that a row is in."""
    keys = [F.col(group).asc_nulls_first(), *[F.col(c).asc_nulls_last() for c in order], F.col("_tie").asc()]
    tied = df.withColumn("_tie", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    return cut(tied.repartitionByRange(max(1, -(-df.count() // rows)), *keys).withColumn("_part", F.spark_partition_id()))


def along(df: DataFrame, group: str, order: Sequence[str], number: str | None = None, ahead: Mapping[str, str] | None = None, rows: int = RANGE) -> DataFrame:
    """Add ``number``, each row's place from 1 in its group by ``order`` (NULLs last), and for each ``column: out`` of ``ahead`` the next row's value.

    The same as windows over the group, of which one would be one task: rows are dealt into ranges of group and order, a range is numbered on
    its own and begins after the counts of those before it, and its last row looks at the first one of the group's next range.
    Among ties the order is that of a hash of all columns, so equal rows alone share a range of their own at worst. NULL groups are one group.
    """
    ahead = dict(ahead or {})
    kept = [F.col(f"`{c}`") for c in df.columns]
    ranged = ranges(df, group, order, rows)
    inside = Window.partitionBy(group, "_part").orderBy(*[F.col(c).asc_nulls_last() for c in order], "_tie")
    first = F.min_by(F.struct(*[F.col(c).alias(out) for c, out in ahead.items()], F.lit(1).alias("_any")), F.col("_at"))
    numbered = ranged.withColumn("_at", F.row_number().over(inside))
    borders = numbered.groupBy(group, "_part").agg(F.count("*").alias("_size"), first.alias("_first"))
    line = Window.partitionBy(group).orderBy("_part")
    borders = borders.select(F.col(group).alias("_group"), F.col("_part").alias("_of"), "_size", (F.sum("_size").over(line) - F.col("_size")).alias("_begin"), F.lead("_first").over(line).alias("_next"))
    on = reduce(lambda a, b: a & b, [F.col(group).eqNullSafe(F.col("_group")), F.col("_part") == F.col("_of")])
    joined = numbered
    for c, out in ahead.items():
        joined = joined.withColumn(f"_in_{out}", F.lead(c).over(inside))
    joined = joined.join(borders, on)
    added = [(F.col("_begin") + F.col("_at")).cast("bigint").alias(number)] if number else []
    added += [F.when(F.col("_at") < F.col("_size"), F.col(f"_in_{out}")).otherwise(F.col("_next")[out]).alias(out) for out in ahead.values()]
    return joined.select(*kept, *added)
