"""References to parents: what has none, by keys that travel instead of rows.

Rows stay where they are as long as the parents' keys, or a Bloom filter of them, fit a broadcast of a checked size; what
travels then are distinct keys. NULL keys are told apart before anything is joined, so no task gets them all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import cut

#: Parents up to so many keys are broadcast as they are.
BROADCAST_KEYS = 400_000
#: Beyond, up to so many keys, a Bloom filter of them is: at 12 bits a key 64 MB.
FILTER_KEYS = 44_000_000
#: Bits of a filter's block, as Spark's bitmap functions have it; bits for each key and places that a key sets.
BLOCK_BITS, KEY_BITS, PLACES = 32_768, 12, 6


def parent_keys(parent: DataFrame, pk: str) -> DataFrame:
    return parent.where(F.col(pk).isNotNull()).select(F.col(pk).alias("_pk")).distinct()


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _places(key: Column) -> list[Column]:
    """The bits of a key within its block."""
    a, b = F.pmod(F.xxhash64(key, F.lit(1)), F.lit(BLOCK_BITS)), F.pmod(F.xxhash64(key, F.lit(2)), F.lit(BLOCK_BITS))
    return [F.pmod(a + k * b + k * k, F.lit(BLOCK_BITS)) for k in range(PLACES)]


def blocks_for(n_keys: int) -> int:
    return max(1, -(-n_keys * KEY_BITS // BLOCK_BITS))


def key_filter(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """(_block, _flags): a Bloom filter of the keys as blocks of 32,768 bits, 4,096 bytes each. One aggregate; NULL keys set nothing."""
    col = F.col(key)
    bits = keys.where(col.isNotNull()).select(_block(col, blocks).alias("_block"), F.explode(F.array(*_places(col))).alias("_bit"))
    maps = bits.groupBy("_block").agg(F.bitmap_construct_agg("_bit").alias("_map"))
    byte = F.transform(F.sequence(F.lit(1), F.lit(BLOCK_BITS // 8)), lambda i: F.conv(F.hex(F.substring("_map", i, F.lit(1))), 16, 10).cast("int"))
    return maps.select("_block", F.transform(byte, lambda b: F.when(b > 127, b - 256).otherwise(b).cast("tinyint")).alias("_flags"))


def maybe_in(df: DataFrame, key: str, flags: DataFrame, blocks: int, name: str = "_maybe") -> DataFrame:
    """``df`` with ``name``: false if the key is NULL or surely not among the filter's keys. The filter is broadcast; its size is that of ``blocks``."""
    col = F.col(key)
    on = _block(col, blocks) == F.col("_block")
    held = reduce(lambda a, b: a & b, [F.getbit(F.element_at("_flags", F.shiftright(p, 3).cast("int") + 1), (p % 8).cast("int")) == 1 for p in _places(col)])
    return df.join(F.broadcast(flags), on, "left").select(*[F.col(f"`{c}`") for c in df.columns], (col.isNotNull() & F.coalesce(held, F.lit(False))).alias(name))


def orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str, only_nonnull: bool = False, broadcast_keys: int | None = None, filter_keys: int | None = None) -> DataFrame:
    """Child rows without a parent. A NULL key is an orphan unless ``only_nonnull``.

    By the number of parents, which one pass estimates: their keys are broadcast; or a Bloom filter of them is, rows that fail it are
    orphans on the spot, and of the others only the distinct keys are compared, whose few false hits come back as a small
    table; or, for more parents than a filter may hold, rows are joined by their key. The result is exact every time.
    """
    few, some = (given if given is not None else default for given, default in ((broadcast_keys, BROADCAST_KEYS), (filter_keys, FILTER_KEYS)))
    keys = parent_keys(parent, pk)
    n = parent.agg(F.approx_count_distinct(pk, 0.02)).first()[0]
    rows = child.where(F.col(fk).isNotNull()) if only_nonnull else child
    if n <= few:
        return rows.join(F.broadcast(keys), F.col(fk) == F.col("_pk"), "left_anti").select(*child.columns)
    known = rows.where(F.col(fk).isNotNull())
    if n > some:
        found = known.join(keys, F.col(fk) == F.col("_pk"), "left_anti").select(*child.columns)
        return found if only_nonnull else found.unionByName(rows.where(F.col(fk).isNull()))
    blocks = blocks_for(n)
    flags = cut(key_filter(keys, "_pk", blocks))
    passed = maybe_in(known.select(fk), fk, flags, blocks).where("_maybe").select(fk).distinct()
    false_hits = cut(passed.join(keys, F.col(fk) == F.col("_pk"), "left_anti").select(F.col(fk).alias("_false")))
    tested = maybe_in(rows, fk, flags, blocks)
    if false_hits.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        hit = tested.join(F.broadcast(false_hits), F.col(fk) == F.col("_false"), "left")
        return hit.where(~F.col("_maybe") | F.col("_false").isNotNull()).select(*child.columns)
    late = tested.where("_maybe").join(false_hits, F.col(fk) == F.col("_false"), "left_semi")
    return tested.where(~F.col("_maybe")).select(*child.columns).unionByName(late.select(*child.columns))


def reference_counts(child: DataFrame, parent: DataFrame, fk: str | Column, pk: str, blank: Column | None = None) -> DataFrame:
    """One row (n, n_missing, n_not_found) of the child's references.

    Rows are counted by key before they travel, so a shuffle has each key, NULL included, once for each task, however many rows it has.
    ``blank`` tells of a key, as column ``_fk``, that it counts as missing.
    """
    col = F.col(fk) if isinstance(fk, str) else fk
    gone = F.col("_fk").isNull() if blank is None else F.col("_fk").isNull() | F.coalesce(blank, F.lit(False))
    counted = child.select(col.alias("_fk")).groupBy("_fk").agg(F.count("*").alias("_n"))
    joined = counted.join(parent_keys(parent, pk), F.col("_fk") == F.col("_pk"), "left")
    of = lambda which: F.coalesce(F.sum(F.when(which, F.col("_n"))), F.lit(0)).cast("long")
    return joined.agg(of(F.lit(True)).alias("n"), of(gone).alias("n_missing"), of(~gone & F.col("_pk").isNull()).alias("n_not_found"))
