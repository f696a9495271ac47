"""Deal documents into shards that all carry the same source mixture.

Rows are shuffled by a seeded hash and ranked within each source; sorted by
fractional rank the sources interleave in proportion, and equal cuts of that
order are the shards. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import cut
from .frames import sized

SHARDS = 24
SEED = 17
#: Rows are ranked in order-preserving buckets of about so many.
BUCKET = 5_000
KEY = ("doc_id", "source", "size", "text_crc32")


def _number(text: Column) -> Column:
    """The first 52 bits of a digest of ``text``, as a number in [0, 1)."""
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(16**13)


def _sum_before(df: DataFrame, by: list[str], bucket: Column, order: list[Column], weight: str, out: str) -> DataFrame:
    """Sum of ``weight`` over the rows before each in ``order`` within ``by``; ``bucket`` is non-decreasing in the order.

    A bucket is summed on its own and begins after the sums of the buckets
    before it, so no task holds all rows of a group.
    """
    keyed = df.withColumn("_bucket", bucket)
    sums = keyed.groupBy(*by, "_bucket").agg(F.sum(weight).alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy(*by).orderBy("_bucket")) - F.col("_sum")
    begins = sums.select(*[F.col(c).alias(f"_b_{c}") for c in by], F.col("_bucket").alias("_b_bucket"), before.alias("_begin"))
    up_to = Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    on = F.col("_bucket") == F.col("_b_bucket")
    for c in by:
        on &= F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    summed = keyed.withColumn("_within", F.sum(weight).over(up_to) - F.col(weight)).join(begins, on)
    return summed.select(*df.columns, (F.col("_begin") + F.col("_within")).cast("long").alias(out))


def keyed(df: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, text_crc32, copies, draw): equal rows counted, with their number in [0, 1) of the seeded shuffle.

    Size and digest draw as well as the id, so rows without an id, or with the same one, are as far apart as others.
    """
    plain = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), (F.octet_length(plain) + 8).cast("long").alias("size"), F.crc32(plain.cast("binary")).alias("text_crc32"))
    drawn = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("size"), F.col("text_crc32"))
    return rows.groupBy(*KEY).agg(F.count("*").alias("copies")).withColumn("draw", _number(drawn))


def stratified_shards(df: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", shards: int = SHARDS, seed: int = SEED, bucket_rows: int = BUCKET) -> DataFrame:
    """``(doc_id, source, size, text_crc32, shard, slot)`` for every row of ``df``.

    Shard sizes in rows differ by one at most, and each source is spread over
    the shards in proportion: row ``rank`` of ``n`` stands at ``(rank - u) / n``, u in [0, 1) drawn for
    the source, so that sources of few rows are spread as well. ``size`` is the text's UTF-8 bytes plus 8, 8 for a
    null text, whose CRC is that of no bytes. Null sources form a source of
    their own. Ties of the shuffle are ordered by id (null last), size and CRC; rows equal in
    those are counted, ranked as one row with a weight, and spread out again. No rows give no rows.
    """
    keys = cut(keyed(df, text, doc_id, source, seed))
    total = keys.agg(F.sum("copies")).first()[0] or 0
    buckets = max(64, total // bucket_rows)

    def at(place: Column) -> Column:
        return F.least(F.floor(place * buckets), F.lit(buckets - 1)).cast("int")

    order = [F.col(c).asc_nulls_last() for c in ("draw", "doc_id", "size", "text_crc32")]
    ranked = _sum_before(keys, ["source"], at(F.col("draw")), order, "copies", "before")
    # copies come out in parts of a bucket's size, which a shuffle spreads if there are such
    parts = ranked.withColumn("part", F.explode(F.sequence(F.lit(0), F.expr(f"(copies - 1) div {bucket_rows}"))))
    if not keys.where(F.col("copies") > bucket_rows).isEmpty():
        parts = parts.repartition("doc_id", "text_crc32", "part")
    copy = F.explode(F.sequence(F.col("part") * bucket_rows, F.least((F.col("part") + 1) * bucket_rows, F.col("copies")) - 1))
    each = parts.withColumn("copy", copy).withColumn("rank", F.col("before") + F.col("copy") + 1)
    counts = cut(keys.groupBy(F.col("source").alias("c_source")).agg(F.sum("copies").alias("n")))
    offset = _number(F.concat(F.lit(f"{seed}/"), F.coalesce(F.concat(F.lit("s:"), F.col("c_source").cast("string")), F.lit("n"))))
    placed = each.join(sized(counts.withColumn("u", offset)), F.col("source").eqNullSafe(F.col("c_source")))
    placed = placed.select(*KEY, "draw", "rank", ((F.col("rank") - F.col("u")) / F.col("n")).alias("place"), F.lit(1).cast("long").alias("one"), F.lit(0).alias("all"))
    line = _sum_before(placed, ["all"], at(F.col("place")), [F.col("place"), F.col("source").asc_nulls_last(), *order, F.col("rank")], "one", "index")
    whole = max(total, 1)
    shard = F.expr(f"(index * {shards}) div {whole}")
    first = F.expr(f"(shard * {whole} + {shards - 1}) div {shards}")
    return line.withColumn("shard", shard.cast("int")).withColumn("slot", (F.col("index") - first).cast("long")).select("doc_id", "source", "size", "text_crc32", "shard", "slot")
