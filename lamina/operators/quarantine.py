"""Rejected rows with a reason, and referential-integrity splits.

Both sides come from one flagged frame: a row is in exactly one of them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import day_diff, drop_cols, first_reason, project, resolve_col
from ..scratch import cut
from .duplicates import repeats
from .references import orphans  # noqa: F401  the third of the splits, found with references

REASON = "reject_reason"
#: Parts that rows with a NULL key are spread over in a join.
NULL_PARTS = 256
Rules = Sequence[tuple[str, Column]]


def flag(df: DataFrame, rules: Rules) -> DataFrame:
    """Add the name of the first rule that holds, NULL for clean rows."""
    return df.withColumn(REASON, first_reason(rules))


def quarantine(df: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """(clean, rejects); rejects keep all columns and the reason.

    A row is clean exactly if no rule holds, so the sides part the rows. On the
    clean side the rules are single conjuncts, of which null tests reach the scan.
    """
    clean = df
    for _, holds in rules:
        clean = clean.where(~F.coalesce(holds, F.lit(False)))
    return clean, flag(df, rules).where(F.col(REASON).isNotNull())


def missing(*cols: str) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & F.col(c).isNull()
    return out


def subject_rules() -> Rules:
    return [("missing_patient_id", missing("patient_id"))]


def visit_rules() -> Rules:
    return [
        ("missing_encounter_id", missing("encounter_id")),
        ("missing_patient_id", missing("patient_id")),
        ("bad_time_order_start_gt_stop", F.col("start_ts") > F.col("stop_ts")),
        ("negative_base_cost", F.col("base_cost") < 0),
        ("negative_total_cost", F.col("total_cost") < 0),
    ]


def event_rules(need_visit: bool = True) -> Rules:
    """With ``need_visit`` an event needs its visit; without, a code or a description."""
    second = ("missing_encounter_id", missing("encounter_id")) if need_visit else ("missing_code_and_description", missing("code", "description"))
    return [("missing_patient_id", missing("patient_id")), second, ("bad_time_order_start_gt_stop", F.col("start_ts") > F.col("stop_ts"))]


def finding_rules(date: str = "obs_ts") -> Rules:
    """A date that can't be read rejects the row, on the clean side as well."""
    unread = F.col(date).isNotNull() & F.col(date).cast("string").try_cast("timestamp").isNull()
    return [("missing_patient_id", missing("patient_id")), ("missing_code", missing("code")), ("bad_date_parse", unread)]


def curate_subject(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    clean, rejects = quarantine(df, subject_rules())
    names = ("patient_id", "birth_date", "death_date", "gender", "race", "ethnicity", "income")
    casts = {"birth_date": "date", "death_date": "date", "income": "double"}
    return project(clean, {c: F.col(c).cast(casts[c]) if c in casts else F.col(c) for c in names}), rejects


def curate_visit(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clean visits with calendar length of stay in days."""
    clean, rejects = quarantine(df, visit_rules())
    return clean.withColumn("los_days", day_diff(F.col("start_ts"), F.col("stop_ts"))), rejects


def curate_event(df: DataFrame, need_visit: bool = True) -> tuple[DataFrame, DataFrame]:
    return quarantine(df, event_rules(need_visit))


def curate_finding(df: DataFrame, date: str = "obs_ts") -> tuple[DataFrame, DataFrame]:
    clean, rejects = quarantine(df, finding_rules(date))
    return clean.withColumn(date, F.col(date).cast("string").try_cast("timestamp_ntz")), rejects


def curate_procedure(df: DataFrame, date_candidates: Sequence[str] = ("start", "start_ts", "date", "performeddate"), end_candidates: Sequence[str] = ("stop", "stop_ts", "end")) -> tuple[DataFrame, DataFrame]:
    """Events whose date columns are found by name; a start is needed, an end isn't."""
    start, end = resolve_col(df, date_candidates), resolve_col(df, end_candidates, required=False)
    stop = F.col(end) if end else F.lit(None).cast("timestamp_ntz")
    named = df.withColumns({"start_date": F.col(start), "stop_date": stop})
    rules = [
        ("missing_patient_id", missing("patient_id")),
        ("missing_code_and_description", missing("code", "description")),
        ("missing_date", missing("start_date")),
        ("bad_time_order_start_gt_stop", F.col("start_date") > F.col("stop_date")),
    ]
    return quarantine(named, rules)


def ri_flag(child: DataFrame, parents: Sequence[tuple[DataFrame, str, str, str]]) -> DataFrame:
    """Add the reason of the first parent ``(parent, fk, pk, reason)`` that a row lacks; parents are joined on distinct keys.

    Rows with a NULL key would all be shuffled to one task, so a second key that matches no parent spreads them.
    """
    out, rules = child, []
    for k, (parent, fk, pk, reason) in enumerate(parents):
        keys = parent.where(F.col(pk).isNotNull()).select(F.col(pk).alias(f"_pk{k}")).distinct().withColumns({f"_has{k}": F.lit(1), f"_real{k}": F.lit(0)})
        spread = F.when(F.col(fk).isNotNull(), 0).otherwise(1 + F.pmod(F.xxhash64(*child.columns), F.lit(NULL_PARTS))).cast("int")
        out = out.withColumn(f"_part{k}", spread).join(keys, (F.col(fk) == F.col(f"_pk{k}")) & (F.col(f"_part{k}") == F.col(f"_real{k}")), "left")
        rules.append((reason, F.col(f"_has{k}").isNull()))
    return out.withColumn(REASON, first_reason(rules)).select(*child.columns, REASON)


def orphans_multi(child: DataFrame, parents: Sequence[tuple[DataFrame, str, str, str]]) -> DataFrame:
    return ri_flag(child, parents).where(F.col(REASON).isNotNull())


def ri_split(child: DataFrame, parents: Sequence[tuple[DataFrame, str, str, str]], stored: bool = False) -> tuple[DataFrame, DataFrame]:
    """(clean, rejects) by one flag: exact for every row, whatever keys it repeats. ``stored`` writes the flagged rows once, for callers that read both sides."""
    flagged = cut(ri_flag(child, parents)) if stored else ri_flag(child, parents)
    return drop_cols(flagged.where(F.col(REASON).isNull()), [REASON]), flagged.where(F.col(REASON).isNotNull())


def dup_groups(df: DataFrame, keys: Sequence[Column], drop_null: bool = False) -> DataFrame:
    """(n_dup_groups): keys that more than one row has. NULL keys form a group unless ``drop_null``."""
    named = df.select(*[k.alias(f"_k{i}") for i, k in enumerate(keys)])
    cols = named.columns
    if drop_null:
        named = named.dropna(subset=cols)
    return repeats(named).agg(F.count("*").alias("n_dup_groups"))


def dup_report(specs: Mapping[str, tuple[DataFrame, Sequence[Column]]]) -> DataFrame:
    """(table_name, n_dup_groups) of several tables."""
    out = None
    for name, (df, keys) in specs.items():
        one = dup_groups(df, keys).select(F.lit(name).alias("table_name"), "n_dup_groups")
        out = one if out is None else out.unionByName(one)
    return out

