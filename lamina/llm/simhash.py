"""Near-duplicate documents by SimHash fingerprints.

A fingerprint is embedded as the bit counts of its segments. The Manhattan
distance of two embeddings never exceeds the Hamming distance of the
fingerprints, so a grid join over the lattice of counts finds every pair
within the limit, and an exact comparison keeps the true ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import cut, small_batches
from .components import components
from .frames import sized

SEGMENTS = 16
SEED = 42
#: A cell that more fingerprints than this meet in is compared by one-bit flips.
CROWDED = 2048


def fingerprint_of(text: bytes | None, width: int = 3, seed: int = SEED) -> int:
    """Fingerprint of one UTF-8 text; 0 without words. Words split at ASCII white space, A-Z lowered."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        grams = [b" ".join(words)]
    else:
        grams = list(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)))
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(grams), 1 << 16):
        part = grams[at : at + (1 << 16)]
        hashed = np.fromiter((digest(g, seed) for g in part), np.uint64, len(part))
        ones += np.unpackbits(hashed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(grams), bitorder="little").view(np.uint64)[0])


def fingerprint(text: Column) -> Column:
    """Signed 64-bit fingerprint column; null texts count as empty."""

    @F.arrow_udf("long")
    def simhash(texts: pa.Array) -> pa.Array:
        found = np.fromiter((fingerprint_of(x.as_py()) for x in texts), np.uint64, len(texts))
        return pa.array(found.view(np.int64))

    return simhash(text.cast("binary"))


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def embedding_key(fp: Column) -> Column:
    """Bit counts of the 16 four-bit segments, one hexadecimal digit each."""
    ones = 0x1111111111111111
    digits = [F.shiftrightunsigned(fp, k).bitwiseAND(F.lit(ones)) for k in range(4)]
    return digits[0] + digits[1] + digits[2] + digits[3]


def _lattice(fps: DataFrame) -> DataFrame:
    """Each fingerprint at its own cell (move 0) and at the cells one step away.

    Two cells within Manhattan distance 2 share a cell at most one step from either.
    """
    moves = F.explode(F.sequence(F.lit(0), F.lit(2 * SEGMENTS)))
    digit = F.expr("shiftrightunsigned(own, 4 * int((move - 1) div 2)) & 15")
    up = F.expr("move % 2 = 1")
    step = F.expr("shiftleft(1L, 4 * int((move - 1) div 2))")
    spread = fps.select("fp", embedding_key(F.col("fp")).alias("own")).select("fp", "own", moves.alias("move"))
    spread = spread.where((F.col("move") == 0) | (up & (digit < 4)) | (~up & (digit > 0)))
    key = F.when(F.col("move") == 0, F.col("own")).when(up, F.col("own") + step).otherwise(F.col("own") - step)
    return spread.select(key.alias("cell"), "fp", F.col("move").cast("byte").alias("move"))


def links(fps: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """Pairs ``(a, b)`` of distinct fingerprints (column ``fp``) at 1 or 2 differing bits.

    Pairs may repeat. In cells that more than ``crowded`` fingerprints meet in,
    fingerprints are compared by shared one-bit neighbours instead: those give
    each pair a common point with at most 65 members, and a chain over
    them, which connects the same fingerprints with bounded groups.
    """
    spread = _lattice(fps)
    # Spark sizes what follows an explode at a 33rd or less of its rows and would broadcast it: joins are marked
    cells = cut(spread.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1"))
    met = cut(spread.join(sized(cells), "cell"))
    few, many = met.where(f"n <= {crowded}").drop("n"), met.where(f"n > {crowded}")
    left = few.select("cell", F.col("fp").alias("a"), F.col("move").alias("ma"))
    right = few.select("cell", F.col("fp").alias("b"), F.col("move").alias("mb"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2
    once = (F.col("ma") == 0) | ((F.col("mb") != 0) & (F.col("ma") != F.col("mb")))
    pairs = left.join(right.hint("merge"), "cell").where((F.col("a") < F.col("b")) & once & close).select("a", "b")
    flips = F.explode(F.sequence(F.lit(-1), F.lit(63)))
    point = F.expr("case when bit < 0 then fp else fp ^ shiftleft(1L, bit) end")
    points = many.select("fp").distinct().select("fp", flips.alias("bit")).select("fp", point.alias("point"))
    first = points.groupBy("point").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    chained = points.join(first.hint("merge"), "point").where("fp <> a").select("a", F.col("fp").alias("b"))
    return pairs.union(chained)


def near_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``df``.

    ``component_id`` is the smallest id among the documents reachable over links
    of at most 2 differing bits, the document itself included. Equal
    fingerprints are one node, so a huge group of copies costs one row after
    pre-aggregation. Null or empty texts have fingerprint 0 and link like others;
    a null id keeps its row and takes the component's smallest id. Other
    columns of ``df`` are not read; an empty table gives no rows.
    """
    small_batches(df.sparkSession)
    printed = cut(df.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text)).alias("fp")))
    fps = cut(printed.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    roots = components(links(fps))
    linked = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = linked.join(smallest, "root").select("fp", "component_id")
    return printed.join(labels, "fp").select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")
