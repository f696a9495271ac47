"""Exact top-k search by inner product, pruned by segment statistics from coarse to fine.

A vector cut into segments is summed up by each segment's mean and deviation. For two vectors, segments of length l give
``sum l * ((mean - mean')**2 + (dev - dev')**2)`` as a lower bound of their squared distance, so half of both squared lengths
less that, ``sum l * (mean * mean' + dev * dev')``, is an upper bound of their inner product. Bounds of 1, 2, 4, 8
and 16 segments are tried in turn; only pairs that pass all of them are computed, in whole numbers.

Queries and rows meet in blocks: a task has one block of queries and a few blocks of rows. A first pass over one row in
``FIRST`` of every block gives each query the score it has to reach; it rises further while a task works.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import cut, small_batches

SEGMENTS = (1, 2, 4, 8, 16)
#: Vectors of a block of queries and of rows, and blocks of rows that a task has at least if there are as many.
QUERY_BLOCK, ROW_BLOCK, BLOCKS = 1024, 4096, 8
#: The first pass takes one row in so many.
FIRST = 16
#: Pairs whose statistics are gathered at a time, and the share of pairs from which a whole product is cheaper.
PAIRS, DENSE = 100_000, 0.15
#: Whole numbers beyond this are refused: scores could leave 64 bits.
LARGEST = 1 << 26
BLOCK = "no long, n int, ids binary, nulls binary, m binary"
FOUND = "block int, place int, query_id long, own long, vec_id long, score long"


def finite(vector: Column) -> Column:
    """Whether a vector is there and has neither null nor non-finite entries."""
    inf = F.lit(float("inf"))
    good = F.forall(vector, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < inf), F.lit(False)))
    return F.coalesce(good, F.lit(False))


def dense(rows: pa.Array, dim: int) -> np.ndarray:
    """A list column as an int64 matrix; shorter lists end in zeros."""
    lengths, values = np.asarray(rows.value_lengths()), np.asarray(rows.flatten(), dtype=np.int64)
    if len(lengths) and (lengths == dim).all():
        return values.reshape(len(lengths), dim)
    out = np.zeros((len(lengths), dim), dtype=np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def _pack(dim: int, most: int):
    """Rows (vec_id, v) into blocks of up to ``most``, numbered by partition and place."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, count, made = [], 0, TaskContext.get().partitionId() << 24

        def block(ids, nulls, m):
            row = {"no": [made], "n": [len(ids)], "ids": [ids.tobytes()], "nulls": [nulls.tobytes()], "m": [m.astype("<i4").tobytes()]}
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("no", pa.int64()), ("n", pa.int32()), ("ids", pa.binary()), ("nulls", pa.binary()), ("m", pa.binary())]))

        for batch in batches:
            ids, m = batch.column("vec_id"), dense(batch.column("v"), dim)
            if m.size and np.abs(m).max() > LARGEST:
                raise ValueError(f"a component is beyond {LARGEST}")
            held.append((np.asarray(ids.fill_null(0), dtype="<i8"), np.asarray(ids.is_null()), m))
            count += len(ids)
            while count >= most:
                whole = [np.concatenate(x) for x in zip(*held, strict=True)]
                yield block(*[x[:most] for x in whole])
                held, count, made = [tuple(x[most:] for x in whole)], count - most, made + 1
        if count:
            yield block(*[np.concatenate(x) for x in zip(*held, strict=True)])

    return pack


def _features(m: np.ndarray) -> list[np.ndarray]:
    """Scaled means and deviations at each resolution: products of two rows are the bounds of their score."""
    pad = -m.shape[1] % SEGMENTS[-1]
    m = np.pad(m.astype(float), ((0, 0), (0, pad))) if pad else m.astype(float)
    out = []
    for s in SEGMENTS:
        parts = m.reshape(len(m), s, -1)
        out.append(np.concatenate([parts.mean(2), parts.std(2)], axis=1) * np.sqrt(m.shape[1] / s))
    return out


def _scores(q: np.ndarray, c: np.ndarray, exact: bool) -> np.ndarray:
    """All inner products of two blocks; doubles are exact below 2**53."""
    return (q.astype(float) @ c.astype(float).T).astype(np.int64) if exact else q @ c.T


def survivors(q: np.ndarray, qf: list, c: np.ndarray, cf: list, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """(query, row, score) of all pairs whose score is at least ``least`` of the query, and the pairs left after each resolution."""
    lengths = np.sqrt((qf[-1] ** 2).sum(1)), np.sqrt((cf[-1] ** 2).sum(1))
    # scores are whole numbers: half of one and the rounding of the largest product never lose a pair
    limit = least - 0.5 - 1e-12 * lengths[0] * lengths[1].max(initial=0)
    near, pairs, left = None, None, []
    for a, b in zip(qf, cf, strict=True):
        if pairs is None:
            passed = a @ b.T >= limit[:, None]
            near = passed if near is None else near & passed
            if near.mean() < DENSE:
                pairs = np.nonzero(near)
        else:
            i, j = pairs
            good = np.concatenate([np.einsum("ij,ij->i", a[i[k : k + PAIRS]], b[j[k : k + PAIRS]]) >= limit[i[k : k + PAIRS]] for k in range(0, len(i), PAIRS)] or [np.zeros(0, bool)])
            pairs = i[good], j[good]
        left.append(int(near.sum()) if pairs is None else len(pairs[0]))
    exact = q.shape[1] * float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) < 2**53
    if pairs is None:
        pairs = np.nonzero(near)
        score = _scores(q, c, exact)[pairs]
    else:
        i, j = pairs
        score = np.concatenate([np.einsum("ij,ij->i", q[i[k : k + PAIRS]], c[j[k : k + PAIRS]]) for k in range(0, len(i), PAIRS)] or [np.zeros(0, np.int64)])
    good = score >= least[pairs[0]]
    return pairs[0][good], pairs[1][good], score[good], left


def _best(found: list[np.ndarray], most: int) -> list[np.ndarray]:
    """The first ``most`` of each query of (query, score, null id, id), by falling score, then id, nulls last."""
    order = np.lexsort((found[3], found[2], -found[1], found[0]))
    found = [x[order] for x in found]
    begins = np.searchsorted(found[0], found[0])
    keep = np.arange(len(order)) - begins < most
    return [x[keep] for x in found]


def _unpack(block, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(block.ids, "<i8"), np.frombuffer(block.nulls, bool), np.frombuffer(block.m, "<i4").reshape(block.n, dim).astype(np.int64)


def _search(dim: int, k: int):
    """The ``k`` best rows of a group's blocks for each query of its block, if they reach the query's ``least``."""

    def search(key, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)]
        if queries.empty or rows.empty:
            return pd.DataFrame({c.split()[0]: [] for c in FOUND.split(", ")})
        block = next(queries.itertuples())
        q_ids, _, q = _unpack(block, dim)
        qf = _features(q)
        least = np.full(len(q), -np.inf) if block.least is None else np.array(block.least, dtype=float)
        for row in rows.itertuples():
            ids, nulls, c = _unpack(row, dim)
            i, j, score, _ = survivors(q, qf, c, _features(c), least)
            found = _best([np.concatenate(x) for x in zip(found, (i, score, nulls[j], ids[j]), strict=True)], k)
            full = np.bincount(found[0], minlength=len(q)) == k
            last = np.searchsorted(found[0], np.arange(len(q)), side="right") - 1
            least[full] = np.maximum(least[full], found[1][last[full]])
        i, score, nulls, ids = found
        return pd.DataFrame({"block": np.full(len(i), key[0]), "place": i, "query_id": q_ids[i], "own": np.einsum("ij,ij->i", q, q)[i], "vec_id": pd.arrays.IntegerArray(ids, nulls), "score": score})

    return search


def top_k(df: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of the highest inner product for every row where ``is_query`` holds.

    Components become ``floor(scale * x)``, products of whole numbers are exact. Vectors that are null or hold null or
    non-finite components take no part; shorter vectors end in zeros, so an empty one scores 0. Ties go to the
    smaller id, null ids last. A row isn't its own candidate, but rows that repeat its id or vector are. A query needs
    an id. Fewer candidates than ``k`` are all returned; an empty table, or no query, gives no rows. Whole numbers beyond 2**26 are an error.
    """
    spark = df.sparkSession
    small_batches(spark)
    v = F.transform(F.col(f"`{vector}`"), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    rows = df.where(finite(F.col(f"`{vector}`"))).select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), v.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    n, n_queries, dim = rows.agg(F.count("*"), F.count_if("q"), F.max(F.size("v"))).first()
    dim = max(dim or 0, 1)
    asked = max(1, -(-n_queries // QUERY_BLOCK))
    queries = rows.where(F.col("q") & F.col("vec_id").isNotNull()).select("vec_id", "v").repartition(asked)
    number = F.row_number().over(Window.orderBy("no")) - 1  # one line for each block of queries, without the vectors
    packed = cut(queries.mapInArrow(_pack(dim, QUERY_BLOCK), BLOCK))
    queries = packed.join(packed.select("no", number.cast("int").alias("block")), "no").drop("no")
    blocks = cut(rows.select("vec_id", "v").mapInArrow(_pack(dim, ROW_BLOCK), BLOCK))
    n_blocks, n_asked = blocks.count(), max(1, packed.count())
    groups = min(max(1, n_blocks), max(-(-n_blocks // BLOCKS), -(-2 * spark.sparkContext.defaultParallelism // n_asked)))

    def meet(queries: DataFrame, share: int) -> DataFrame:
        mine = queries.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        part = blocks
        if share > 1:
            few = blocks.withColumn("n", F.expr(f"(n + {share - 1}) div {share}").cast("int"))
            part = few.withColumns({c: F.substring(c, F.lit(1), w * F.col("n")) for c, w in (("ids", 8), ("nulls", 1), ("m", 4 * dim))})
        theirs = part.withColumn("group", F.pmod(F.xxhash64("no"), F.lit(groups)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1))))
        sides = [x.repartition(groups * n_asked, "block", "group").groupBy("block", "group") for x in (mine, theirs)]
        return sides[0].cogroup(sides[1]).applyInPandas(_search(dim, k + 1), FOUND)

    by = Window.partitionBy("block", "place")
    ranked = F.row_number().over(by.orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last()))
    # what k + 1 rows of the first pass reach, one list for each block of queries
    first = meet(queries.withColumn("least", F.lit(None).cast("array<double>")), FIRST).withColumn("at", ranked).where(F.col("at") <= k + 1)
    reached = first.groupBy("block", "place").agg(F.when(F.count("*") > k, F.min("score")).alias("least"))
    lists = cut(reached.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("place", F.col("least").cast("double").alias("least")))).alias("known")))
    known = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.coalesce(F.try_element_at("known", i), F.lit(float("-inf"))))
    best = meet(queries.join(lists, "block", "left").withColumn("least", known).drop("known"), 1).withColumn("at", ranked).where(F.col("at") <= k + 1)
    # the query's own row, or one that can't be told from it, goes
    own = F.min(F.when((F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own")), F.col("at"))).over(by)
    rank = F.col("at") - F.when(F.col("at") > F.col("own_at"), 1).otherwise(0)
    placed = best.withColumn("own_at", own).where(F.col("own_at").isNull() | (F.col("at") != F.col("own_at"))).withColumn("rank", rank.cast("int"))
    return placed.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
