"""Mapping of role tables to standard domains and subject-level analysis tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import age_years, coalesce_text, fmt_ts, in_codes, iso_text, norm_text, not_in_codes, pct, safe_cast, subject_id, with_constants
from .visits import dedup, number_visits

STUDY = "SYN"
#: The vital-sign codes (blood pressure, heart rate, temperature, respiration, weight, height, BMI).
VITAL_CODES = ("8462-4", "8480-6", "8867-4", "8310-5", "9279-1", "29463-7", "8302-2", "39156-5")


def _domain(df: DataFrame, study: str, domain: str, *cols) -> DataFrame:
    constant = with_constants(df, __study=study, __domain=domain)
    return constant.select(F.col("__study").alias("STUDYID"), F.col("__domain").alias("DOMAIN"), subject_id(F.col("patient_id")).alias("USUBJID"), *cols)


def map_dm(subjects: DataFrame, study: str = STUDY) -> DataFrame:
    """Subjects: sex M, F or U, dates as text."""
    gender = norm_text(F.col("gender"))
    sex = F.when(gender == "M", "M").when(gender == "F", "F").otherwise("U")
    return _domain(subjects, study, "DM", sex.alias("SEX"), iso_text(F.col("birth_date")).alias("BRTHDTC"), iso_text(F.col("death_date")).alias("DTHDTC"), F.col("race").alias("RACE"), F.col("ethnicity").alias("ETHNIC"))


def map_sv(visits: DataFrame, study: str = STUDY, spread: bool = False) -> DataFrame:
    """Visits, numbered per subject by start and id.

    Numbers are dealt by the mapped subject id, so that later windows over it need no further shuffle; with ``spread`` in ranges, for subjects of any size.
    """
    named = visits.withColumn("USUBJID", subject_id(F.col("patient_id")))
    numbered = number_visits(named, "USUBJID", "start_ts", "encounter_id", spread=spread)
    return numbered.select(F.lit(study).alias("STUDYID"), F.lit("SV").alias("DOMAIN"), "USUBJID", "VISITNUM", F.col("encounter_class").alias("VISIT"), iso_text(F.col("start_ts")).alias("SVSTDTC"), iso_text(F.col("stop_ts")).alias("SVENDTC"))


def _map_event(events: DataFrame, study: str, domain: str, term: str, label) -> DataFrame:
    return _domain(events, study, domain, label.alias(term), iso_text(F.col("start_ts")).alias(f"{domain}STDTC"), iso_text(F.col("stop_ts")).alias(f"{domain}ENDTC"))


def map_mh(events: DataFrame, study: str = STUDY) -> DataFrame:
    """History events under their description."""
    return _map_event(events, study, "MH", "MHTERM", F.col("description"))


def map_cm(events: DataFrame, study: str = STUDY) -> DataFrame:
    """Treatments: description, else code."""
    return _map_event(events, study, "CM", "CMTRT", coalesce_text(F.col("description"), F.col("code")))


def map_pr(events: DataFrame, study: str = STUDY) -> DataFrame:
    """Procedures: description, else code."""
    return _map_event(events, study, "PR", "PRTRT", coalesce_text(F.col("description"), F.col("code")))


def _map_finding(findings: DataFrame, study: str, domain: str) -> DataFrame:
    return _domain(
        findings,
        study,
        domain,
        F.col("code").alias(f"{domain}TESTCD"),
        F.col("description").alias(f"{domain}TEST"),
        iso_text(F.col("obs_ts")).alias(f"{domain}DTC"),
        F.col("value").alias(f"{domain}ORRES"),
        F.col("units").alias(f"{domain}ORRESU"),
        safe_cast(F.col("value"), "double").alias(f"{domain}STRESN"),
        F.col("units").alias(f"{domain}STRESU"),
    )


def map_lb(findings: DataFrame, vital_codes: Sequence[str] = VITAL_CODES, study: str = STUDY) -> DataFrame:
    """Findings whose code isn't a vital sign; NULL codes are in neither domain."""
    return _map_finding(findings.where(not_in_codes(F.col("code"), vital_codes)), study, "LB")


def map_vs(findings: DataFrame, vital_codes: Sequence[str] = VITAL_CODES, study: str = STUDY) -> DataFrame:
    return _map_finding(findings.where(in_codes(F.col("code"), vital_codes)), study, "VS")


def domain_counts(domains: Mapping[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in domains.items():
        one = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("domain"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


def adbds_los(index: DataFrame, study: str = STUDY) -> DataFrame:
    """One row per subject: length of stay of the index visit."""
    return index.select(
        F.lit(study).alias("STUDYID"),
        "USUBJID",
        F.lit("LOS").alias("PARAMCD"),
        F.lit("Length of stay (days)").alias("PARAM"),
        F.col("LOS_DAYS").alias("AVAL"),
        F.col("START_TS").cast("date").alias("ADT"),
        F.col("START_TS").alias("ADTM"),
        fmt_ts(F.col("START_TS")).alias("STARTDTC"),
        fmt_ts(F.col("END_TS")).alias("ENDDTC"),
        fmt_ts(F.col("END_IMP")).alias("ENDDTC_IMP"),
        "END_IMPUTEDFL",
        "END_MISSING_UNRESOLVEDFL",
        "VISITNUM",
        "VISIT",
    )


def dedup_subject(dm: DataFrame) -> DataFrame:
    return dedup(dm, ["USUBJID"], ["BRTHDTC", "SEX", "RACE", "ETHNIC"])


def enrich(df: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    return df.join(right, key, how)


def adsl(dm: DataFrame, index: DataFrame) -> DataFrame:
    """Subject-level table: deduplicated subjects with their index visit; age in whole years at its start."""
    first = index.select("USUBJID", F.col("VISITNUM").alias("INDEX_VISITNUM"), F.col("VISIT").alias("INDEX_VISIT"), F.col("LOS_DAYS").alias("INDEX_LOS_DAYS"), F.col("END_IMPUTEDFL").alias("INDEX_END_IMPUTEDFL"), F.col("END_MISSING_UNRESOLVEDFL").alias("INDEX_END_MISSING_UNRESOLVEDFL"), "START_TS")
    joined = enrich(dedup_subject(dm), first, "USUBJID")
    age = age_years(F.col("BRTHDTC").try_cast("timestamp_ntz"), F.col("START_TS"))
    return joined.select("STUDYID", "USUBJID", F.col("USUBJID").alias("SUBJID"), "SEX", "BRTHDTC", "DTHDTC", "RACE", "ETHNIC", "INDEX_VISITNUM", "INDEX_VISIT", "INDEX_LOS_DAYS", "INDEX_END_IMPUTEDFL", "INDEX_END_MISSING_UNRESOLVEDFL", age.alias("AGE"))


def adam_metrics(subjects: DataFrame, los: DataFrame) -> DataFrame:
    """One row: sizes, repeated subjects, and shares of missing, imputed and unresolved stays."""
    repeated = lambda df: df.groupBy("USUBJID").count().agg(F.count_if(F.col("count") > 1))
    a = subjects.agg(F.count("*").alias("n_adsl"))
    b = los.agg(F.count("*").alias("n_adbds"), F.count_if(F.col("AVAL").isNull()).alias("m"), F.count_if(F.col("END_IMPUTEDFL") == 1).alias("i"), F.count_if(F.col("END_MISSING_UNRESOLVEDFL") == 1).alias("u"))
    joined = a.crossJoin(repeated(subjects).toDF("dup_adsl")).crossJoin(b).crossJoin(repeated(los).toDF("dup_adbds"))
    share = lambda c: pct(F.col(c), F.col("n_adbds"))
    return joined.select("n_adsl", "n_adbds", "dup_adsl", "dup_adbds", share("m").alias("los_missing_pct"), share("i").alias("end_imputed_pct"), share("u").alias("end_unresolved_pct"))
