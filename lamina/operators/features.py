"""Feature marts: history, findings, coverage, filling, merging."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import blank_token, fill_constants, finite, normalize_tokens, null_inf, pct, safe_name
from ..scratch import cut
from .frequent import top_counts
from .profile import numeric_cols
from .ranks import exact_quantiles
from .visits import rows_at_group_max, split_last

#: A lookup list (categories, codes) brought to the driver has so many values at most.
MAX_VALUES = 1_000


def clean_inputs(df: DataFrame, id_col: str) -> DataFrame:
    """Missing tokens and non-finite numbers to NULL; rows without an id go."""
    return null_inf(normalize_tokens(df)).where(F.col(id_col).isNotNull())


def last_visit_target(visits: DataFrame) -> DataFrame:
    """Stay and category of the last visit that has a stay."""
    last = rows_at_group_max(visits.where(F.col("LOS").isNotNull()), "USUBJID", "SEQ")
    return last.select("USUBJID", F.col("SEQ").alias("LAST_SEQ"), F.round("LOS", 6).alias("LOS_LAST"), F.col("VISIT").alias("LAST_CAT"))


def history(visits: DataFrame) -> DataFrame:
    return split_last(visits.where(F.col("LOS").isNotNull()), "USUBJID", "SEQ")[1]


def history_features(visits: DataFrame) -> DataFrame:
    """Number, mean and maximum of the stays before the last."""
    return history(visits).groupBy("USUBJID").agg(F.count("*").alias("N_VISITS_PREV"), F.round(F.avg("LOS"), 6).alias("LOS_MEAN_PREV"), F.round(F.max("LOS"), 6).alias("LOS_MAX_PREV"))


def quantiles_by(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], exact: bool = True) -> DataFrame:
    """``q`` array of interpolated quantiles by group. Exact ones hold a group's distinct values; the sketch doesn't."""
    function = F.percentile if exact else F.percentile_approx
    return df.groupBy(*keys).agg(function(F.col(value).cast("double"), F.array(*[F.lit(float(p)) for p in probs])).alias("q"))


def history_iqr(visits: DataFrame) -> DataFrame:
    quartiles = quantiles_by(history(visits), ["USUBJID"], "LOS", [0.25, 0.75])
    return quartiles.select("USUBJID", F.round(F.col("q")[1] - F.col("q")[0], 6).alias("LOS_IQR_PREV"))


def distinct_values(df: DataFrame, col: str, limit: int = MAX_VALUES) -> list:
    """Sorted distinct values of a small category column; ValueError when there are more than ``limit``."""
    rows = df.select(col).where(F.col(col).isNotNull()).distinct().limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{col} has more than {limit} values, too many for columns: use the long form (history_long)")
    return sorted(r[0] for r in rows)


def history_long(visits: DataFrame) -> DataFrame:
    """(USUBJID, VISIT, N_VISITS_PREV, LOS_MEAN_PREV, LOS_MAX_PREV) of the stays before the last, for any number of categories; absent pairs have no row."""
    before = history(visits).where(F.col("VISIT").isNotNull())
    return before.groupBy("USUBJID", "VISIT").agg(F.count("*").alias("N_VISITS_PREV"), F.round(F.avg("LOS"), 6).alias("LOS_MEAN_PREV"), F.round(F.max("LOS"), 6).alias("LOS_MAX_PREV"))


def history_by_category(visits: DataFrame, categories: Sequence[str] | None = None) -> DataFrame:
    """Per category, number, mean and maximum of earlier stays, 0 where there are none, in one aggregate.

    Every subject with a stay has a row; the totals over all categories stay NULL without history, their count is 0.
    The window that finds the last stay and the aggregate share the subject's partitioning, so rows are shuffled once.
    Without ``categories`` the stays are written once: their values and their rows are read from there.
    """
    timed = visits.where(F.col("LOS").isNotNull()).select("USUBJID", "SEQ", "VISIT", "LOS")
    if categories is None:
        timed = cut(timed)
    cats = list(categories) if categories is not None else distinct_values(timed, "VISIT")
    before = timed.withColumn("_prev", F.when(F.col("SEQ") < F.max("SEQ").over(Window.partitionBy("USUBJID")), F.col("LOS")))
    quartiles = F.percentile("_prev", F.array(F.lit(0.25), F.lit(0.75)))
    cells = [
        F.count("_prev").alias("N_VISITS_PREV"),
        F.round(F.avg("_prev"), 6).alias("LOS_MEAN_PREV"),
        F.round(F.max("_prev"), 6).alias("LOS_MAX_PREV"),
        F.round(quartiles[1] - quartiles[0], 6).alias("LOS_IQR_PREV"),
    ]
    for c in cats:
        mine, name = F.when(F.col("VISIT") == c, F.col("_prev")), safe_name(c)
        cells += [F.count(mine).alias(f"N_VISITS_PREV_{name}"), F.round(F.avg(mine), 6).alias(f"LOS_MEAN_PREV_{name}"), F.round(F.max(mine), 6).alias(f"LOS_MAX_PREV_{name}")]
    out = before.groupBy("USUBJID").agg(*cells)
    return out.fillna(0, subset=[c for c in out.columns if c.startswith(("LOS_MEAN_PREV_", "LOS_MAX_PREV_"))])


def top_codes(findings: DataFrame, code: str = "LBTESTCD", label: str = "LBTEST", value: str = "LBSTRESN", n: int = 25, bounded: bool = False) -> DataFrame:
    """Codes with the most numeric records; ties go by code. ``bounded`` is for more codes than a shuffle should have groups."""
    numeric = findings.where(finite(F.col(value)).isNotNull() & F.col(code).isNotNull())
    if bounded:
        best = cut(top_counts(numeric, [code], n, "n_records"))
        labels = numeric.join(F.broadcast(best), code).groupBy(code, "n_records").agg(F.min(label).alias("label"))
        return labels.select(F.col(code).alias("code"), "label", "n_records")
    return numeric.groupBy(code).agg(F.count("*").alias("n_records"), F.min(label).alias("label")).orderBy(F.desc("n_records"), code).limit(n).select(F.col(code).alias("code"), "label", "n_records")


def pivot_stats(df: DataFrame, group: str, code: str, value: str, codes: Sequence[str]) -> DataFrame:
    """``LAB_code_MEAN`` columns, then ``LAB_code_count`` columns; counts of absent cells are NULL."""
    mine = {c: F.when(F.col(code) == c, F.col(value)) for c in codes}
    means = [F.round(F.avg(m), 6).alias(f"LAB_{safe_name(c)}_MEAN") for c, m in mine.items()]
    counts = [F.nullif(F.count(m), F.lit(0)).alias(f"LAB_{safe_name(c)}_count") for c, m in mine.items()]
    return df.groupBy(group).agg(*means, *counts)


def finding_cells(findings: DataFrame, code: str = "LBTESTCD", value: str = "LBSTRESN") -> DataFrame:
    """(USUBJID, code, mean, n) of the numeric records: the mart in long form, for any number of codes. Records without a subject are a group of their own."""
    numeric = findings.where(finite(F.col(value)).isNotNull() & F.col(code).isNotNull())
    return numeric.groupBy("USUBJID", F.col(code).alias("code")).agg(F.round(F.avg(value), 6).alias("mean"), F.count("*").alias("n"))


def pivot_cells(cells: DataFrame, codes: Sequence[str]) -> DataFrame:
    """The columns of :func:`pivot_stats` from the long form."""
    mine = {c: F.col("code") == c for c in codes}
    means = [F.max(F.when(m, F.col("mean"))).alias(f"LAB_{safe_name(c)}_MEAN") for c, m in mine.items()]
    counts = [F.max(F.when(m, F.col("n"))).alias(f"LAB_{safe_name(c)}_count") for c, m in mine.items()]
    return cells.groupBy("USUBJID").agg(*means, *counts)


def finding_features(findings: DataFrame, top: int = 25, code: str = "LBTESTCD", value: str = "LBSTRESN", codes: Sequence[str] | None = None) -> DataFrame:
    """Mean and count of the ``top`` most recorded codes per subject, wide.

    Findings are read once: their cells by subject and code are written, the top codes come from the cells' counts, and so do the columns.
    """
    if codes is not None:
        kept = findings.where(F.col(code).isin(*sorted(codes)) & finite(F.col(value)).isNotNull() & F.col("USUBJID").isNotNull())
        return pivot_stats(kept, "USUBJID", code, value, sorted(codes))
    cells = cut(finding_cells(findings, code, value))
    ranked = cells.groupBy("code").agg(F.sum("n").alias("n_records")).orderBy(F.desc("n_records"), "code").limit(top)
    chosen = sorted(r["code"] for r in ranked.collect())
    return pivot_cells(cells.where(F.col("code").isin(*chosen) & F.col("USUBJID").isNotNull()), chosen)


def feature_coverage(df: DataFrame, id_col: str = "USUBJID") -> DataFrame:
    """(feature, n_present, rate) by distinct ids, in one aggregate."""
    cols = [c for c in df.columns if c != id_col]
    counts = df.agg(F.countDistinct(id_col).alias("_ids"), *[F.count(c).alias(c) for c in cols])
    long = counts.unpivot(["_ids"], cols, "feature", "n_present")
    return long.select("feature", "n_present", F.when(F.col("_ids") > 0, F.round(F.col("n_present") / F.col("_ids"), 6)).otherwise(0.0).alias("rate"))


def coverage_drop(df: DataFrame, min_rate: float = 0.01, min_count: int = 20, id_col: str = "USUBJID") -> tuple[DataFrame, list[str]]:
    """Drop features that are both rare in rate and few in number; the table and the dropped names."""
    rows = feature_coverage(df, id_col).collect()
    gone = sorted(r["feature"] for r in rows if r["rate"] < min_rate and r["n_present"] < min_count)
    return df.drop(*gone), gone


def median_fill(df: DataFrame, id_col: str = "USUBJID") -> tuple[DataFrame, DataFrame]:
    """Counts to 0, means to the column's median, all-NULL means dropped; the table and a report of what was done."""
    counts = [c for c in df.columns if c.endswith("count")]
    means = [c for c in df.columns if c != id_col and c not in counts]
    if not means:
        medians = {}
    else:
        medians = {c: v and v[0] for c, v in exact_quantiles(df, means, [0.5]).items()}
    gone = [c for c in means if medians[c] is None]
    filled = df.drop(*gone).fillna({c: 0 for c in counts} | {c: round(medians[c], 6) for c in means if medians[c] is not None} or {id_col: ""})
    rows = [(c, "dropped" if c in gone else "median", None if c in gone else round(float(medians[c]), 6)) for c in means] + [(c, "zero", 0.0) for c in counts]
    return filled, df.sparkSession.createDataFrame(rows, "feature string, action string, fill_value double")


def subject_demo(subjects: DataFrame) -> DataFrame:
    """Age, sex and race, with UNKNOWN for missing texts."""
    texts = [blank_token(F.col(c)).alias(c) for c in ("SEX", "RACE")]
    return fill_constants(subjects.select("USUBJID", F.col("AGE").cast("double").alias("AGE"), *texts), {"SEX": "UNKNOWN", "RACE": "UNKNOWN"})


def star_merge(spine: DataFrame, parts: Sequence[DataFrame], key: str) -> DataFrame:
    """Left join of each part to the spine on its key."""
    out = spine
    for part in parts:
        out = out.join(part, key, "left")
    return out


def merged_features(target: DataFrame, demo: DataFrame, findings: DataFrame) -> DataFrame:
    return star_merge(target, [demo, findings], "USUBJID")


def missing_cells(df: DataFrame, id_col: str = "USUBJID") -> DataFrame:
    """(n_numeric_null, n_bad_token): NULL numbers, and texts that are NULL or a missing token."""
    numbers = [c for c in numeric_cols(df) if c != id_col]
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name != id_col]
    nulls = sum((F.count_if(F.col(c).isNull()) for c in numbers), F.lit(0))
    bad = sum((F.count_if(blank_token(F.col(c)).isNull()) for c in texts), F.lit(0))
    return df.agg(nulls.cast("bigint").alias("n_numeric_null"), bad.cast("bigint").alias("n_bad_token"))


def missingness(df: DataFrame, fill_zero: bool = False, id_col: str = "USUBJID") -> DataFrame:
    """Missing cells before and after the optional zero fill of numbers."""
    after = df.fillna(0, subset=[c for c in numeric_cols(df) if c != id_col]) if fill_zero else df
    before = missing_cells(df, id_col).select(F.lit("before").alias("phase"), "*")
    return before.unionByName(missing_cells(after, id_col).select(F.lit("after").alias("phase"), "*"))


def union_keys(frames: Sequence[DataFrame], key: str) -> DataFrame:
    out = frames[0].select(key)
    for f in frames[1:]:
        out = out.union(f.select(key))
    return out.distinct()


def key_union_check(parts: Sequence[DataFrame], merged: DataFrame, key: str) -> DataFrame:
    """(n_union, n_merged, coverage_pct) of distinct keys."""
    a = union_keys(parts, key).agg(F.countDistinct(key).alias("n_union"))
    b = merged.agg(F.countDistinct(key).alias("n_merged"))
    return a.crossJoin(b).withColumn("coverage_pct", pct(F.col("n_merged"), F.col("n_union")))


def mart_metrics(merged: DataFrame, target: str = "LOS_LAST", key: str = "USUBJID") -> DataFrame:
    n_cols = len(merged.columns)
    groups = merged.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col(target).isNull()).alias("m"))
    return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_rows"), F.lit(n_cols).cast("bigint").alias("n_cols"), F.count_if(F.col("n") > 1).alias("n_dup_subjects"), F.coalesce(F.sum("m"), F.lit(0)).cast("bigint").alias("n_missing_target"))


def phase_status(metrics: DataFrame, phases: Mapping[str, str]) -> DataFrame:
    """(phase, status, value) of each expected phase and its metric, and whether all are there."""
    expected = metrics.sparkSession.createDataFrame(list(phases.items()), "phase string, metric string")
    found = metrics.groupBy("metric").agg(F.max("value").alias("value"))
    rows = expected.join(F.broadcast(expected.select("metric").distinct()).join(found, "metric", "left"), "metric", "left")
    status = F.when(F.col("value").isNull(), "missing").otherwise("present")
    marked = rows.select("phase", status.alias("status"), "value")
    overall = marked.agg((F.count_if(F.col("status") == "missing") == 0).cast("int").alias("all_present"))
    return marked.crossJoin(overall)
