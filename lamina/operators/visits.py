"""Visit order, next visit, length of stay, index visit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import los_days, los_minutes
from .spread import along


def _ordered(group: Sequence[str], order: Sequence[str]):
    """NULLs last, as the engine's SQL has it; ties need a last key that is unique."""
    return Window.partitionBy(*group).orderBy(*[F.col(c).asc_nulls_last() for c in order])


def number_visits(df: DataFrame, subject: str, start: str, tie: str, out: str = "VISITNUM", spread: bool = False) -> DataFrame:
    """``spread`` is for subjects with more rows than a task should hold."""
    if spread:
        return along(df, subject, [start, tie], out)
    return df.withColumn(out, F.row_number().over(_ordered([subject], [start, tie])).cast("bigint"))


def with_next_start(df: DataFrame, subject: str, start: str, tie: str, out: str = "NEXT_START", spread: bool = False) -> DataFrame:
    if spread:
        return along(df, subject, [start, tie], ahead={start: out})
    return df.withColumn(out, F.lead(start).over(_ordered([subject], [start, tie])))


def first_per(df: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of each group."""
    return df.withColumn("_rn", F.row_number().over(_ordered(group, order))).where("_rn = 1").drop("_rn")


def dedup(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first in a total order."""
    return first_per(df, keys, order)


def sequence(df: DataFrame, group: str, order: Sequence[str], cap: int | None = 20, out: str = "SEQ", spread: bool = False) -> DataFrame:
    """Number rows within the group, up to ``cap`` of each."""
    if spread:
        numbered = along(df, group, order, out)
        return numbered.where(F.col(out) <= cap) if cap else numbered
    if not cap:
        return df.withColumn(out, F.row_number().over(_ordered([group], order)).cast("bigint"))
    return df.withColumn(out, F.row_number().over(_ordered([group], order)).cast("bigint")).where(F.col(out) <= cap)


def split_last(df: DataFrame, group: str, seq: str) -> tuple[DataFrame, DataFrame]:
    """(last row of each group, rows before it), by the group's largest sequence number."""
    marked = df.withColumn("_max", F.max(seq).over(Window.partitionBy(group)))
    return marked.where(F.col(seq) == F.col("_max")).drop("_max"), marked.where(F.col(seq) < F.col("_max")).drop("_max")


def rows_at_group_max(df: DataFrame, group: str, seq: str) -> DataFrame:
    return split_last(df, group, seq)[0]


def visit_los(sv: DataFrame, spread: bool = False) -> DataFrame:
    """Days of stay of each visit; a missing end is taken from the next visit's start.

    END_IMPUTEDFL says that the end was missing, END_MISSING_UNRESOLVEDFL that no next visit could give one.
    One window per subject serves both the order and the look-ahead; ``spread`` works on ranges of visits instead, for subjects of any size.
    """
    start, end = F.col("SVSTDTC").try_cast("timestamp_ntz"), F.col("SVENDTC").try_cast("timestamp_ntz")
    timed = with_next_start(sv.withColumns({"START_TS": start, "END_TS": end}), "USUBJID", "START_TS", "VISITNUM", spread=spread)
    imputed = F.coalesce("END_TS", "NEXT_START")
    return timed.withColumn("END_IMP", imputed).select(
        "USUBJID",
        "VISITNUM",
        "VISIT",
        "START_TS",
        "END_TS",
        "END_IMP",
        F.col("END_TS").isNull().cast("int").alias("END_IMPUTEDFL"),
        (F.col("END_TS").isNull() & F.col("NEXT_START").isNull()).cast("int").alias("END_MISSING_UNRESOLVEDFL"),
        los_days(F.col("START_TS"), F.col("END_IMP")).alias("LOS_DAYS"),
    )


def index_visit(los: DataFrame) -> DataFrame:
    """First visit of each subject."""
    return first_per(los, ["USUBJID"], ["START_TS", "VISITNUM"])


def visits_long(sv: DataFrame, max_visits: int = 20) -> DataFrame:
    """(USUBJID, SEQ, VISIT, START_TS, END_TS, LOS) of each subject's first visits; LOS in minutes."""
    timed = sv.withColumns({"START_TS": F.col("SVSTDTC").try_cast("timestamp_ntz"), "END_TS": F.col("SVENDTC").try_cast("timestamp_ntz")})
    numbered = sequence(timed, "USUBJID", ["START_TS", "VISITNUM"], max_visits)
    return numbered.select("USUBJID", "SEQ", "VISITNUM", "VISIT", "START_TS", "END_TS", los_minutes(F.col("START_TS"), F.col("END_TS")).alias("LOS"))


def pivot_sequence(df: DataFrame, group: str, seq: str, cols: dict[str, str], n: int = 20) -> DataFrame:
    """Wide form: for each number 1..n and each ``column: stem`` a column ``stem_number``. One aggregate, values fixed in advance."""
    cells: list[Column] = []
    for k in range(1, n + 1):
        cells += [F.max(F.when(F.col(seq) == k, F.col(c))).alias(f"{stem}_{k}") for c, stem in cols.items()]
    return df.groupBy(group).agg(*cells)


def unpivot_sequence(df: DataFrame, group: str, stems: Sequence[str], n: int = 20) -> DataFrame:
    """Long form of :func:`pivot_sequence`: a row per subject and number that has any value."""
    rows = F.array(*[F.struct(F.lit(k).cast("bigint").alias("SEQ"), *[F.col(f"{s}_{k}").alias(s) for s in stems]) for k in range(1, n + 1)])
    long = df.select(group, F.explode(rows).alias("r")).select(group, "r.*")
    return long.dropna(how="all", subset=list(stems))


def visits_wide(sv: DataFrame, max_visits: int = 20) -> DataFrame:
    """VISITID_i, START_i, ENDE_i of the first visits."""
    return pivot_sequence(visits_long(sv, max_visits), "USUBJID", "SEQ", {"VISIT": "VISITID", "START_TS": "START", "END_TS": "ENDE"}, max_visits)


def visits_wide_los(sv: DataFrame, max_visits: int = 20) -> DataFrame:
    """As :func:`visits_wide`, with minutes of stay in VISITID_i."""
    long = visits_long(sv, max_visits).withColumn("LOS", F.round("LOS", 6))
    return pivot_sequence(long, "USUBJID", "SEQ", {"LOS": "VISITID", "START_TS": "START", "END_TS": "ENDE"}, max_visits)


def visits_wide_cat(sv: DataFrame, max_visits: int = 20) -> DataFrame:
    """Minutes of stay and category of the first visits."""
    long = visits_long(sv, max_visits).withColumn("LOS", F.round("LOS", 6))
    return pivot_sequence(long, "USUBJID", "SEQ", {"LOS": "LOS", "VISIT": "CAT"}, max_visits)
