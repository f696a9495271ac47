"""Profiles that merge: sketches of a table's columns, kept for each run, so that a new run costs its own rows alone.

A profile row has exact counts and ends, and sketches of quantiles, of distinct values and of frequent ones. Rows of one
table and column merge into a profile of all their rows, whatever runs they come from; drift between runs is a query over the store.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Accuracy: KLL's k (rank errors of about 0.5%), the logarithm of HyperLogLog's registers (about 1.6%), and values tracked for frequent ones.
K, REGISTERS, TRACKED = 400, 12, 1_000
#: Quantiles that ranks are read off from.
GRID = 100
STORED = ("table_name", "run_id", "column_name", "n", "n_null", "low", "high", "quantiles", "distinct", "frequent")


def _numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def sketch_profile(df: DataFrame, table: str, run_id: str, cols: Sequence[str] | None = None) -> DataFrame:
    """A profile row for each column, in one aggregate over the rows. Numbers have ends and quantiles (NaN left out), other columns NULL there; nested columns are passed over."""
    kinds = {f.name: f.dataType for f in df.schema if not isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType, T.BinaryType))}
    chosen = [c for c in (cols if cols is not None else df.columns) if c in kinds]
    if not chosen:
        raise ValueError("no columns to profile")
    cells = []
    for c in chosen:
        col, text = F.col(f"`{c}`"), F.col(f"`{c}`").cast("string")
        number = F.nanvl(col.cast("double"), F.lit(None).cast("double")) if _numeric(kinds[c]) else F.lit(None).cast("double")
        cells.append(
            F.struct(
                F.count("*").alias("n"),
                F.count_if(col.isNull()).alias("n_null"),
                F.min(number).alias("low"),
                F.max(number).alias("high"),
                F.kll_sketch_agg_double(number, K).alias("quantiles"),
                F.hll_sketch_agg(text, REGISTERS).alias("distinct"),
                F.call_function("approx_top_k_accumulate", text, F.lit(TRACKED)).alias("frequent"),
            ).alias(c)
        )
    wide = df.agg(*cells)
    rows = [F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("p")) for c in chosen]
    long = wide.select(F.explode(F.array(*rows)).alias("r")).select("r.column_name", "r.p.*")
    return long.select(F.lit(table).alias("table_name"), F.lit(run_id).alias("run_id"), *STORED[2:])


def merge_profiles(profiles: DataFrame, by: Sequence[str] = ("table_name", "column_name")) -> DataFrame:
    """One profile row for each of ``by``: that of all the rows that went into the merged ones."""
    return profiles.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.sum("n_null").alias("n_null"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.kll_merge_agg_double("quantiles").alias("quantiles"),
        F.hll_union_agg("distinct").alias("distinct"),
        F.call_function("approx_top_k_combine", F.col("frequent"), F.lit(TRACKED)).alias("frequent"),
    )


def read_profile(profiles: DataFrame, probs: Sequence[float] = (0.25, 0.5, 0.75), top: int = 3) -> DataFrame:
    """Profiles in figures: the store's other columns, missing rate, about how many distinct values, quantiles at ``probs`` and the ``top`` values."""
    keys = [c for c in profiles.columns if c not in ("quantiles", "distinct", "frequent")]
    some = F.kll_sketch_get_n_double("quantiles") > 0
    return profiles.select(
        *keys,
        F.when(F.col("n") > 0, F.round(F.col("n_null") / F.col("n"), 6)).otherwise(0.0).alias("missing_rate"),
        F.hll_sketch_estimate("distinct").alias("n_distinct"),
        F.when(some, F.array(*[F.kll_sketch_get_quantile_double("quantiles", F.lit(float(p))) for p in probs])).alias("at"),
        F.call_function("approx_top_k_estimate", F.col("frequent"), F.lit(top)).alias("top"),
    )


def drift(profiles: DataFrame, before: str, after: str, probs: Sequence[float] = (0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """(table_name, column_name, n_before, n_after, missing_change, distinct_ratio, rank_shift) between two runs of the store.

    ``rank_shift`` is how far the quantiles of the run before have moved in rank in the run after, at most, 0 to 1, in steps of 1 / GRID; NULL for columns without numbers.
    """
    old, new = (merge_profiles(profiles.where(F.col("run_id") == r)) for r in (before, after))
    renamed = new.select("table_name", "column_name", *[F.col(c).alias(f"_{c}") for c in new.columns if c not in ("table_name", "column_name")])
    both = (F.kll_sketch_get_n_double("quantiles") > 0) & (F.kll_sketch_get_n_double("_quantiles") > 0)
    # ranks are read off a grid of quantiles
    grid = [k / GRID for k in range(1, GRID)]
    of = lambda name, at: F.kll_sketch_get_quantile_double(name, F.array(*[F.lit(float(p)) for p in at]))
    rank = lambda q: (F.size(F.filter("_grid", lambda v: v < q)) + F.size(F.filter("_grid", lambda v: v <= q)) + 1) / F.lit(2.0 * GRID)
    moved = [F.abs(rank(F.col("_at")[k]) - F.lit(float(p))) for k, p in enumerate(probs)]
    rate = lambda p: F.when(F.col(f"{p}n") > 0, F.col(f"{p}n_null") / F.col(f"{p}n")).otherwise(0.0)
    ratio = F.hll_sketch_estimate("_distinct") / F.nullif(F.hll_sketch_estimate("distinct"), F.lit(0))
    joined = old.join(renamed, ["table_name", "column_name"]).withColumns({"_at": F.when(both, of("quantiles", probs)), "_grid": F.when(both, of("_quantiles", grid))})
    return joined.select(
        "table_name",
        "column_name",
        F.col("n").alias("n_before"),
        F.col("_n").alias("n_after"),
        F.round(rate("_") - rate(""), 6).alias("missing_change"),
        ratio.alias("distinct_ratio"),
        F.when(both, reduce(F.greatest, moved)).alias("rank_shift"),
    )
