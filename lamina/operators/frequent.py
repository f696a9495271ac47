"""The most frequent keys of many: exact, with a bounded number of groups in the shuffles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import cut

#: Buckets that keys are hashed to, and for each wanted key the fullest ones that are looked into first.
BUCKETS, FIRST = 65_536, 4


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    parts = [x for k in keys for x in (F.col(f"`{k}`"), F.col(f"`{k}`").isNull())]
    return F.pmod(F.xxhash64(*parts), F.lit(buckets)).cast("int")


def top_counts(df: DataFrame, keys: Sequence[str], n: int, out: str = "n", buckets: int = BUCKETS, first: int = FIRST) -> DataFrame:
    """(keys, ``out``): the ``n`` keys with the most rows, ties in the order of the keys (NULLs last; NULL is a key like others).

    Rows are counted by bucket first: no key has more rows than its bucket. The keys of the fullest buckets are counted, and the
    ``n``-th of them sets a bar. Buckets below it hold no key that could reach the bar and are never looked into; the rest are
    counted as well, so the result is that of counting every key. Flat counts leave no bucket out: then all keys are counted.
    """
    named = df.select(*[F.col(f"`{k}`") for k in keys]).withColumn("_bucket", _bucket(keys, buckets))
    totals = cut(named.groupBy("_bucket").agg(F.count("*").alias("_total")))

    def counted(which: DataFrame) -> DataFrame:
        inside = named.join(F.broadcast(which.select("_bucket")), "_bucket", "left_semi")
        return inside.groupBy(*keys).agg(F.count("*").alias(out))

    order = [F.col(out).desc(), *[F.col(f"`{k}`").asc_nulls_last() for k in keys]]
    fullest = cut(totals.orderBy(F.desc("_total"), "_bucket").limit(first * n).select("_bucket"))
    known = cut(counted(fullest))
    best = known.orderBy(*order).limit(n).agg(F.count("*").alias("found"), F.min(out).alias("bar")).first()
    bar = best["bar"] if best["found"] == n else 0
    rest = cut(totals.where(F.col("_total") >= bar).join(F.broadcast(fullest), "_bucket", "left_anti"))
    if not rest.isEmpty():
        known = known.union(counted(rest))
    return known.orderBy(*order).limit(n)
