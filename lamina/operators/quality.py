"""Data-quality checks. Every check is a frame of result rows; a gate decides on them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import is_effectively_missing, iso_text, pct
from ..sources.tables import contract_check
from .frequent import top_counts
from .quarantine import dup_groups
from .references import reference_counts

RESULT = "layer string, check_name string, table_name string, severity string, n_bad bigint, status string, message string"
RESULT_COLUMNS = [part.split()[0] for part in RESULT.split(", ")]
HARD, SOFT = "HARD", "SOFT"


class GateError(RuntimeError):
    """A hard check failed under a strict gate."""


def result(counted: DataFrame, layer: str, check: str, table: str, severity: str, message: str | Column = "") -> DataFrame:
    """A one-row frame with ``n_bad`` as a result row: PASS at 0."""
    status = F.when(F.col("n_bad") == 0, "PASS").otherwise("FAIL")
    return counted.select(F.lit(layer).alias("layer"), F.lit(check).alias("check_name"), F.lit(table).alias("table_name"), F.lit(severity).alias("severity"), F.col("n_bad").cast("bigint").alias("n_bad"), status.alias("status"), (message if isinstance(message, Column) else F.lit(message)).alias("message"))


def fixed(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    return spark.createDataFrame(list(rows), RESULT)


def check_exists(spark: SparkSession, present: Mapping[str, DataFrame], names: Sequence[str], layer: str = "staging") -> DataFrame:
    """A row per name; tables that are there are counted, which the message says."""
    found = contract_check(spark, present, names)
    message = F.when(F.col("present") == 1, F.concat(F.col("n_rows"), F.lit(" rows"))).otherwise("table missing")
    return found.select(F.lit(layer).alias("layer"), F.lit("table_exists").alias("check_name"), "table_name", F.lit(HARD).alias("severity"), (1 - F.col("present")).cast("bigint").alias("n_bad"), "status", message.alias("message"))


def check_columns(df: DataFrame, table: str, cols: Sequence[str], layer: str = "staging") -> DataFrame:
    """Number of required columns that the table lacks; the message names them and the rows that lack them."""
    lacking = sorted(set(c.lower() for c in cols) - set(c.lower() for c in df.columns))
    counted = df.agg(F.count("*").alias("n"), F.lit(len(lacking)).alias("n_bad"))
    message = F.concat(F.lit(",".join(lacking) + " in "), F.col("n"), F.lit(" rows")) if lacking else F.lit("")
    return result(counted, layer, "required_columns", table, HARD, message)


def check_constant(df: DataFrame, table: str, col: str, value: object, layer: str = "staging") -> DataFrame:
    bad = df.agg(F.count_if(F.col(col).isNull() | (F.col(col) != F.lit(value))).alias("n_bad"))
    return result(bad, layer, "run_id_current", table, HARD)


def check_pk(df: DataFrame, table: str, cols: Sequence[str], layer: str = "staging", severity: str = HARD) -> DataFrame:
    """Two rows: NULL keys, and groups of equal keys; ERROR when a key column is absent."""
    if lacking := [c for c in cols if c not in df.columns]:
        return fixed(df.sparkSession, [(layer, "pk_present", table, severity, len(lacking), "ERROR", ",".join(lacking))])
    null = F.lit(False)
    for c in cols:
        null = null | F.col(c).isNull()
    nulls = df.agg(F.count_if(null).alias("n_bad"))
    repeats = dup_groups(df, [F.col(c) for c in cols], drop_null=True).withColumnRenamed("n_dup_groups", "n_bad")
    return result(nulls, layer, "pk_not_null", table, severity).unionByName(result(repeats, layer, "pk_unique", table, severity))


def ri_rate(child: DataFrame, parent: DataFrame, fk: str, pk: str, only_nonnull: bool = False) -> DataFrame:
    """(child_total, fk_missing, fk_not_found, n_bad, ok_rate); rate 1.0 with nothing to check.

    Rows are counted by key, then keys joined to the distinct parent keys. ``only_nonnull`` leaves NULL keys out of n_bad and of the rate.
    """
    found = reference_counts(child, parent, fk, pk)
    counts = found.select(F.col("n").alias("child_total"), F.col("n_missing").alias("fk_missing"), F.col("n_not_found").alias("fk_not_found"))
    bad = F.col("fk_not_found") + (F.lit(0) if only_nonnull else F.col("fk_missing"))
    base = F.col("child_total") - (F.col("fk_missing") if only_nonnull else F.lit(0))
    return counts.withColumn("n_bad", bad).withColumn("ok_rate", F.when(base > 0, F.round(1 - F.col("n_bad") / base, 6)).otherwise(F.lit(1.0)))


def check_ri(child: DataFrame, parent: DataFrame, table: str, fk: str, pk: str, severity: str = SOFT, only_nonnull: bool = False, layer: str = "staging") -> DataFrame:
    return result(ri_rate(child, parent, fk, pk, only_nonnull), layer, f"ri_{fk}", table, severity)


def check_order(df: DataFrame, table: str, start: str, end: str, layer: str = "staging") -> DataFrame:
    """Ends before starts, among rows where both can be read."""
    return result(df.agg(F.count_if(bad_order(start, end)).alias("n_bad")), layer, "time_order", table, SOFT)


def check_dups(df: DataFrame, table: str, keys: Sequence[Column], layer: str = "staging") -> DataFrame:
    return result(dup_groups(df, keys).withColumnRenamed("n_dup_groups", "n_bad"), layer, "content_duplicates", table, SOFT)


def check_rows(df: DataFrame, table: str, checks: Mapping[str, tuple[Column, str]], layer: str = "staging") -> DataFrame:
    """A result row per named (predicate of bad rows, severity), all counted in one aggregate over the table."""
    counts = df.agg(*[F.count_if(F.coalesce(bad, F.lit(False))).alias(name) for name, (bad, _) in checks.items()])
    long = counts.unpivot([], list(checks), "check_name", "n_bad")
    severity = F.when(F.col("check_name").isin([n for n, (_, s) in checks.items() if s == HARD]), HARD).otherwise(SOFT)
    status = F.when(F.col("n_bad") == 0, "PASS").otherwise("FAIL")
    return long.select(F.lit(layer).alias("layer"), "check_name", F.lit(table).alias("table_name"), severity.alias("severity"), "n_bad", status.alias("status"), F.lit("").alias("message"))


def bad_order(start: str, end: str) -> Column:
    """Ends before starts, where both can be read."""
    at = lambda c: F.col(c).cast("string").try_cast("timestamp")
    return at(end) < at(start)


def range_checks(adsl: DataFrame, layer: str = "analysis") -> DataFrame:
    """Length of stay and age rules of the subject-level table."""
    los, age = F.col("INDEX_LOS_DAYS"), F.col("AGE")
    rules = [("los_negative", los < 0, HARD), ("los_over_365", los > 365, SOFT), ("age_missing", age.isNull(), SOFT), ("age_outside_0_120", (age < 0) | (age > 120), HARD)]
    return check_rows(adsl, "adsl", {name: (bad, severity) for name, bad, severity in rules}, layer)


def check_unique(df: DataFrame, table: str, keys: Sequence[str], severity: str = HARD, layer: str = "analysis") -> DataFrame:
    """SKIP when a key column is absent."""
    if lacking := [c for c in keys if c not in df.columns]:
        return fixed(df.sparkSession, [(layer, "unique", table, severity, None, "SKIP", ",".join(lacking))])
    return result(dup_groups(df, [F.col(c) for c in keys]).withColumnRenamed("n_dup_groups", "n_bad"), layer, "unique", table, severity)


class DQResults:
    """Collects result rows; a check that fails, when it is made or when it runs, becomes an ERROR row."""

    def __init__(self, spark: SparkSession, run_id: str) -> None:
        self.spark, self.run_id, self.rows = spark, run_id, []

    def add(self, make, *args, table: str = "", **kwargs) -> None:
        try:
            # a check gives a few counted rows, which are fetched here so that its failure shows here
            self.rows += [tuple(r) for r in make(*args, **kwargs).select(*RESULT_COLUMNS).collect()]
        except Exception as e:  # noqa: BLE001  the row carries the failure
            self.rows.append(("", make.__name__, table, HARD, None, "ERROR", type(e).__name__))

    def frame(self) -> DataFrame:
        return fixed(self.spark, self.rows).withColumn("run_id", F.lit(self.run_id))

    def append_to(self, path: str) -> None:
        self.frame().withColumn("checked_at", F.current_timestamp()).write.mode("append").parquet(path)


def dq_summary(results: DataFrame) -> DataFrame:
    return results.groupBy("severity", "status").agg(F.count("*").alias("n_checks"), F.coalesce(F.sum("n_bad"), F.lit(0)).cast("bigint").alias("n_bad"))


def failures(results: DataFrame) -> DataFrame:
    return results.where(F.col("status").isin("FAIL", "ERROR"))


def order_report(results: DataFrame) -> DataFrame:
    """Hard before soft, worst status first."""
    severity = F.when(F.col("severity") == HARD, 0).otherwise(1)
    status = F.when(F.col("status") == "ERROR", 0).when(F.col("status") == "FAIL", 1).when(F.col("status") == "SKIP", 2).otherwise(3)
    return results.orderBy(severity, status, F.desc("n_bad"), "check_name", "table_name")


def gate_status(results: DataFrame) -> DataFrame:
    """(n_hard_fail, n_soft_fail, gate): STOP on any hard failure."""
    hard = F.count_if((F.col("severity") == HARD) & F.col("status").isin("FAIL", "ERROR"))
    soft = F.count_if((F.col("severity") == SOFT) & F.col("status").isin("FAIL", "ERROR"))
    return results.agg(hard.alias("n_hard_fail"), soft.alias("n_soft_fail")).withColumn("gate", F.when(F.col("n_hard_fail") > 0, "STOP").otherwise("GO"))


def gate(results: DataFrame, strict: bool = True) -> bool:
    """Whether to go on; raises GateError on a hard failure when strict. Soft failures never stop."""
    row = gate_status(results).first()
    if row["n_hard_fail"] and strict:
        raise GateError(f"{row['n_hard_fail']} hard checks failed")
    return not row["n_hard_fail"]


def coverage(df: DataFrame, domain: str, code: str, label: str) -> DataFrame:
    """Present share of code and label; 100.0 on no rows."""
    bad_code, bad_label = is_effectively_missing(F.col(code)), is_effectively_missing(F.col(label))
    counts = df.agg(F.count("*").alias("n"), F.count_if(bad_code).alias("n_missing_code"), F.count_if(bad_label).alias("n_missing_label"))
    share = lambda c: pct(F.col("n") - F.col(c), F.col("n"), 100.0)
    return counts.select(F.lit(domain).alias("domain"), "n", "n_missing_code", "n_missing_label", share("n_missing_code").alias("code_pct"), share("n_missing_label").alias("label_pct"))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def top_n(df: DataFrame, order: Sequence[Column], n: int = 200) -> DataFrame:
    return df.orderBy(*order).limit(n)


def group_count(df: DataFrame, exprs: Mapping[str, Column]) -> DataFrame:
    return df.groupBy(*[c.alias(k) for k, c in exprs.items()]).agg(F.count("*").alias("n"))


def top_unmapped(specs: Sequence[tuple[str, DataFrame, str, str]], k: int = 200, bounded: bool = False) -> DataFrame:
    """Most frequent (domain, code, label) whose code or label is missing, and which of them is. ``bounded`` is for more of them than a shuffle should have groups."""
    parts = []
    for domain, df, code, label in specs:
        no_code, no_label = is_effectively_missing(F.col(code)), is_effectively_missing(F.col(label))
        what = F.when(no_code & no_label, "CODE+LABEL").when(no_code, "CODE").otherwise("LABEL")
        parts.append(df.where(no_code | no_label).select(F.lit(domain).alias("domain"), iso_text(F.col(code)).alias("code"), iso_text(F.col(label)).alias("label"), what.alias("missing_what")))
    if bounded:
        return top_counts(union_all(parts), ["domain", "code", "label", "missing_what"], k)
    counted = group_count(union_all(parts), {c: F.col(c) for c in ("domain", "code", "label", "missing_what")})
    return top_n(counted, [F.desc("n"), F.col("domain"), F.col("code").asc_nulls_last(), F.col("label").asc_nulls_last()], k)


def timing(df: DataFrame, domain: str, start: str, end: str) -> DataFrame:
    """Rows, missing ends, and order among rows where both times can be read."""
    at = lambda c: F.col(c).cast("string").try_cast("timestamp")
    both = at(start).isNotNull() & at(end).isNotNull()
    counts = df.agg(F.count("*").alias("n"), F.count_if(F.col(end).isNull()).alias("n_missing_end"), F.count_if(both).alias("n_checked"), F.count_if(both & (at(end) >= at(start))).alias("n_ok"), F.count_if(both & (at(end) < at(start))).alias("n_bad"))
    return counts.select(F.lit(domain).alias("domain"), "n", "n_missing_end", "n_checked", "n_ok", "n_bad", pct(F.col("n_missing_end"), F.col("n")).alias("missing_end_pct"), pct(F.col("n_ok"), F.col("n_checked"), 100.0).alias("ok_pct"))


def ri_to_master(df: DataFrame, master: DataFrame, domain: str, key: str = "USUBJID") -> DataFrame:
    """Blank ids and ids not in the master table; ok share of all rows."""
    counts = reference_counts(df, master, key, key, F.trim("_fk") == "").withColumnRenamed("n_missing", "n_blank")
    ok = F.col("n") - F.col("n_blank") - F.col("n_not_found")
    return counts.select(F.lit(domain).alias("domain"), "n", "n_blank", "n_not_found", pct(ok, F.col("n"), 100.0).alias("ok_pct"))


def qc_summary(cover: DataFrame, times: DataFrame, master: DataFrame, dups: DataFrame) -> DataFrame:
    """One row: worst shares, and whether any check found something."""
    a = cover.agg(F.min("code_pct").alias("worst_code_pct"), F.min("label_pct").alias("worst_label_pct"))
    b = times.agg(F.min("ok_pct").alias("worst_timing_pct"), F.max((F.col("n_bad") > 0).cast("int")).alias("any_bad_timing"))
    c = master.agg(F.min("ok_pct").alias("worst_ri_pct"), F.max((F.col("n_blank") + F.col("n_not_found") > 0).cast("int")).alias("any_bad_ri"))
    d = dups.agg(F.max((F.col("n_dup_groups") > 0).cast("int")).alias("any_dups"))
    return a.crossJoin(b).crossJoin(c).crossJoin(d).withColumn("hard_failures", F.col("any_bad_ri"))


def completeness(df: DataFrame, dataset: str, cols: Sequence[str]) -> DataFrame:
    """(dataset, column_name, n_present, n_rows, present_pct) of key columns."""
    counts = df.agg(F.count("*").alias("_n"), *[F.count(c).alias(c) for c in cols])
    long = counts.unpivot(["_n"], list(cols), "column_name", "n_present")
    return long.select(F.lit(dataset).alias("dataset"), "column_name", "n_present", F.col("_n").alias("n_rows"), pct(F.col("n_present"), F.col("_n")).alias("present_pct"))


def reconcile(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(direction, n_keys, n_absent, bad_pct, severity) of the distinct keys of each side against the other."""
    ka, kb = a.select(key).where(F.col(key).isNotNull()).distinct(), b.select(key).where(F.col(key).isNotNull()).distinct()
    parts = []
    for name, left, right in (("a_in_b", ka, kb), ("b_in_a", kb, ka)):
        seen = left.join(right.withColumn("_hit", F.lit(1)), key, "left")
        counts = seen.agg(F.count("*").alias("n_keys"), F.count_if(F.col("_hit").isNull()).alias("n_absent"))
        parts.append(counts.select(F.lit(name).alias("direction"), "n_keys", "n_absent", pct(F.col("n_absent"), F.col("n_keys")).alias("bad_pct")))
    return union_all(parts).withColumn("severity", F.when(F.col("n_absent") > 0, F.when(F.col("direction") == "b_in_a", HARD).otherwise(SOFT)).otherwise("NONE"))
