"""The whole chain on clinical CSV tables: raw, staged, checked, curated, mapped, checked again, analysed, marts, model, archive.

Column names are found in any case. With an output folder every layer is written there
and read by the next, so nothing is computed twice; without one the steps are lazy. Only check
results and the category and code lists that name mart columns are collected.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import resolve_col, safe_cast
from ..operators import deid, domains, features, model, quality, quarantine, visits
from ..scratch import cut
from ..sources import fixity, registry
from ..sources import tables as S

#: The source contract, and the source columns and types of each role table.
CORE_TABLES = ("patients", "encounters", "conditions", "procedures", "medications", "observations")
COLUMNS: dict[str, dict[str, tuple[str, str]]] = {
    "patients": {
        "patient_id": ("Id", "string"),
        "birth_date": ("BirthDate", "date"),
        "death_date": ("DeathDate", "date"),
        "gender": ("Gender", "string"),
        "race": ("Race", "string"),
        "ethnicity": ("Ethnicity", "string"),
        "city": ("City", "string"),
        "state": ("State", "string"),
        "zip": ("Zip", "string"),
        "income": ("Income", "double"),
        "lifetime_expenses": ("Healthcare_Expenses", "double"),
        "lifetime_coverage": ("Healthcare_Coverage", "double"),
    },
    "encounters": {
        "encounter_id": ("Id", "string"),
        "patient_id": ("Patient", "string"),
        "organization_id": ("Organization", "string"),
        "provider_id": ("Provider", "string"),
        "payer_id": ("Payer", "string"),
        "start_ts": ("Start", "timestamp_ntz"),
        "stop_ts": ("Stop", "timestamp_ntz"),
        "encounter_class": ("EncounterClass", "string"),
        "encounter_code": ("Code", "string"),
        "encounter_desc": ("Description", "string"),
        "base_cost": ("Base_Encounter_Cost", "double"),
        "total_cost": ("Total_Claim_Cost", "double"),
        "payer_coverage": ("Payer_Coverage", "double"),
    },
    "observations": {"patient_id": ("Patient", "string"), "encounter_id": ("Encounter", "string"), "code": ("Code", "string"), "description": ("Description", "string"), "value": ("Value", "string"), "units": ("Units", "string"), "obs_ts": ("Date", "string")},
    "events": {"patient_id": ("Patient", "string"), "encounter_id": ("Encounter", "string"), "code": ("Code", "string"), "description": ("Description", "string")},
}
#: Where procedures keep their dates.
PROCEDURE_START = ("START", "DATE", "PERFORMEDDATE", "PERFORMED_DATE", "PERFORMED", "PROCEDUREDATE", "PROCEDURE_DATE")
PROCEDURE_END = ("STOP", "END", "ENDDATE", "END_DATE")
LINEAGE = ("_run_id", "_ingested_at")
#: Tables whose id must be there and unique.
KEYED = ("patients", "encounters")
#: Code, label, start and end columns of each domain, and the keys that shouldn't repeat in it.
DOMAINS = {
    "sdtm_sv": (None, "VISIT", "SVSTDTC", "SVENDTC", ("USUBJID", "VISITNUM")),
    "sdtm_mh": (None, "MHTERM", "MHSTDTC", "MHENDTC", ("USUBJID", "MHTERM", "MHSTDTC")),
    "sdtm_cm": (None, "CMTRT", "CMSTDTC", "CMENDTC", ("USUBJID", "CMTRT", "CMSTDTC")),
    "sdtm_pr": (None, "PRTRT", "PRSTDTC", "PRENDTC", ("USUBJID", "PRTRT", "PRSTDTC")),
    "sdtm_lb": ("LBTESTCD", "LBTEST", None, None, ("USUBJID", "LBTESTCD", "LBDTC")),
    "sdtm_vs": ("VSTESTCD", "VSTEST", None, None, ("USUBJID", "VSTESTCD", "VSDTC")),
}
#: Trees of the models that the chain compares.
TREES = 20


def read_sources(spark: SparkSession, folder: str, names: Sequence[str] = CORE_TABLES) -> dict[str, DataFrame]:
    """Header CSV files of the contract, all columns as text: types are cast later, where bad values can be told."""
    return {n: spark.read.option("header", True).csv(f"{folder}/{n}.csv") for n in names}


def stage(sources: Mapping[str, DataFrame], run_id: str) -> dict[str, DataFrame]:
    return {n: S.with_lineage(df, run_id) for n, df in sources.items()}


def to_roles(df: DataFrame, columns: Mapping[str, tuple[str, str]], dates: tuple[Sequence[str], Sequence[str]] | None = None) -> DataFrame:
    """Role columns by their source names, cast so that bad values are NULL; absent columns are NULL. ``dates``: candidates of start and stop."""
    picked = {}
    for role, (name, kind) in columns.items():
        found = resolve_col(df, [name], required=False)
        picked[role] = safe_cast(F.col(found), kind) if found else F.lit(None).cast(kind)
    if dates:
        for role, candidates, required in (("start_ts", dates[0], True), ("stop_ts", dates[1], False)):
            found = resolve_col(df, candidates, required=required)
            picked[role] = (F.col(found).cast("string").try_cast("date") if found else F.lit(None).cast("date"))
    return df.select(*[c.alias(k) for k, c in picked.items()], *[c for c in LINEAGE if c in df.columns])


def check_staged(spark: SparkSession, staged: Mapping[str, DataFrame], run_id: str, names: Sequence[str] = CORE_TABLES) -> DataFrame:
    """Contract, lineage, key, reference, order and duplicate checks of the staged tables."""
    found = quality.DQResults(spark, run_id)
    found.add(quality.check_exists, spark, staged, names)
    for name, df in staged.items():
        found.add(quality.check_columns, df, name, ["_run_id", "_ingested_at", "_source_file"], table=name)
        # what can be told row by row is one aggregate for each table
        rows = {"run_id_current": (F.col("_run_id").isNull() | (F.col("_run_id") != run_id), quality.HARD)}
        key = resolve_col(df, ["Id"], required=False)
        if name in KEYED and key:
            rows["pk_not_null"] = (F.col(key).isNull(), quality.HARD)
        start, stop = (resolve_col(df, c, required=False) for c in (PROCEDURE_START, PROCEDURE_END))
        if start and stop:
            rows["time_order"] = (quality.bad_order(start, stop), quality.SOFT)
        found.add(quality.check_rows, df, name, rows, table=name)
    for name in KEYED:
        found.add(quality.check_unique, staged[name], name, [resolve_col(staged[name], ["Id"])], quality.HARD, "staging", table=name)
    patient, visit = staged["patients"], staged["encounters"]
    for name in [n for n in staged if n != "patients"]:
        child = staged[name]
        severity = quality.HARD if name == "encounters" else quality.SOFT
        found.add(quality.check_ri, child, patient, name, resolve_col(child, ["Patient"]), resolve_col(patient, ["Id"]), severity, table=name)
        if name != "encounters":
            found.add(quality.check_ri, child, visit, name, resolve_col(child, ["Encounter"]), resolve_col(visit, ["Id"]), quality.SOFT, True, table=name)
    return found.frame()


def curate(staged: Mapping[str, DataFrame], stored: bool = False) -> dict[str, DataFrame]:
    """``cur_*`` and ``rej_*`` tables, and their ``_ri`` splits."""
    dates = (PROCEDURE_START, PROCEDURE_END)
    out: dict[str, DataFrame] = {}

    def put(name: str, pair: tuple[DataFrame, DataFrame]) -> None:
        out[f"cur_{name}"], out[f"rej_{name}"] = pair

    put("patients", quarantine.quarantine(to_roles(staged["patients"], COLUMNS["patients"]), quarantine.subject_rules()))
    put("encounters", quarantine.curate_visit(to_roles(staged["encounters"], COLUMNS["encounters"])))
    put("conditions", quarantine.curate_event(to_roles(staged["conditions"], COLUMNS["events"], dates)))
    put("medications", quarantine.curate_event(to_roles(staged["medications"], COLUMNS["events"], dates), need_visit=False))
    put("procedures", quarantine.curate_procedure(to_roles(staged["procedures"], COLUMNS["events"], dates)))
    put("observations", quarantine.curate_finding(to_roles(staged["observations"], COLUMNS["observations"])))
    patient = (out["cur_patients"], "patient_id", "patient_id", "missing_in_cur_patients")
    visit = (out["cur_encounters"], "encounter_id", "encounter_id", "missing_in_cur_encounters")
    for name in ("encounters", "conditions", "medications", "procedures", "observations"):
        parents = [patient, visit] if name == "conditions" else [patient]
        out[f"cur_{name}_ri"], out[f"rej_{name}_ri"] = quarantine.ri_split(out[f"cur_{name}"], parents, stored)
    return out


def standardise(curated: Mapping[str, DataFrame], vitals: Sequence[str] = domains.VITAL_CODES, study: str = domains.STUDY) -> dict[str, DataFrame]:
    findings = curated["cur_observations_ri"]
    return {
        "sdtm_dm": domains.map_dm(curated["cur_patients"], study),
        "sdtm_sv": domains.map_sv(curated["cur_encounters_ri"], study),
        "sdtm_mh": domains.map_mh(curated["cur_conditions_ri"], study),
        "sdtm_cm": domains.map_cm(curated["cur_medications_ri"], study),
        "sdtm_pr": domains.map_pr(curated["cur_procedures_ri"], study),
        "sdtm_lb": domains.map_lb(findings, vitals, study),
        "sdtm_vs": domains.map_vs(findings, vitals, study),
    }


def analyse(standard: Mapping[str, DataFrame], study: str = domains.STUDY) -> dict[str, DataFrame]:
    index = visits.index_visit(visits.visit_los(standard["sdtm_sv"]))
    return {"adam_adbds_los": domains.adbds_los(index, study), "adam_adsl": domains.adsl(standard["sdtm_dm"], index)}


def marts(standard: Mapping[str, DataFrame], analysis: Mapping[str, DataFrame], top: int = 25) -> dict[str, DataFrame]:
    """The wide, history, finding, subject and merged marts. Rare findings are dropped, gaps filled by the median."""
    sv = features.clean_inputs(standard["sdtm_sv"], "USUBJID")
    long = visits.visits_long(sv)
    labs = features.finding_features(features.clean_inputs(standard["sdtm_lb"], "USUBJID"), top)
    labs, _ = features.median_fill(features.coverage_drop(labs)[0])
    target = features.last_visit_target(long).join(features.history_by_category(long), "USUBJID", "left")
    demo = features.subject_demo(analysis["adam_adsl"])
    return {
        "mart_wide": visits.visits_wide(sv),
        "mart_wide_all_visits": visits.visits_wide_los(sv),
        "mart_wide_visits_cat": visits.visits_wide_cat(sv),
        "mart_history": target,
        "mart_lab_values": labs,
        "mart_adsl_demo": demo,
        "mart_merged": features.merged_features(target, demo, labs),
    }


def check_domains(standard: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Coverage, unmapped codes, timing, references to the subjects, repeated keys and a summary of the standard domains."""
    here = {n: standard[n] for n in DOMAINS}
    named = [(n, df, DOMAINS[n][0] or DOMAINS[n][1], DOMAINS[n][1]) for n, df in here.items()]
    cover = quality.union_all([quality.coverage(df, n, code, label) for n, df, code, label in named])
    times = quality.union_all([quality.timing(df, n, DOMAINS[n][2], DOMAINS[n][3]) for n, df in here.items() if DOMAINS[n][2]])
    master = quality.union_all([quality.ri_to_master(df, standard["sdtm_dm"], n) for n, df in here.items()])
    dups = quarantine.dup_report({n: (df, [F.col(c) for c in DOMAINS[n][4]]) for n, df in here.items()})
    return {"qc_coverage": cover, "qc_unmapped": quality.top_unmapped(named), "qc_timing": times, "qc_master": master, "qc_dups": dups, "qc_summary": quality.qc_summary(cover, times, master, dups)}


def check_analysis(spark: SparkSession, analysis: Mapping[str, DataFrame], run_id: str) -> dict[str, DataFrame]:
    """Completeness and key reconciliation of the analysis tables, and their range and uniqueness checks as result rows."""
    subjects, los = analysis["adam_adsl"], analysis["adam_adbds_los"]
    found = quality.DQResults(spark, run_id)
    found.add(quality.range_checks, subjects, table="adsl")
    for name, df, keys, severity in (("adsl", subjects, ["USUBJID"], quality.HARD), ("adbds_los", los, ["USUBJID"], quality.HARD), ("adbds_los", los, ["USUBJID", "PARAMCD", "ADT"], quality.SOFT)):
        found.add(quality.check_unique, df, name, keys, severity, table=name)
    complete = quality.union_all([quality.completeness(subjects, "adsl", ["USUBJID", "SEX", "AGE", "INDEX_LOS_DAYS"]), quality.completeness(los, "adbds_los", ["USUBJID", "AVAL", "ADT"])])
    return {"qc_completeness": complete, "qc_reconcile": quality.reconcile(subjects, los, "USUBJID"), "qc_analysis": found.frame()}


def train(merged: DataFrame, trees: int = TREES, folds: int = 5, model_path: str | None = None) -> dict[str, DataFrame]:
    """Compare models by cross-validation on the training part, fit the best, and measure it on the rest; empty without a model when rows are too few."""
    rows, missing = model.target_rows(merged, "LOS_LAST")
    sets = model.feature_sets(merged, "LOS_LAST")
    scaled, lo, hi = model.minmax(model.quantile_cap(rows, "LOS_LAST"), "LOS_LAST", "y")
    split = cut(model.stratified_split(model.decile_bins(scaled, "LOS_LAST"), "bin"))
    fit, held = split.where("part = 'train'"), split.where("part = 'test'")
    if fit.count() < folds * 10 or held.isEmpty():
        return {"ml_target": missing}
    makers = {"gbt": lambda: model.gbt_regressor("y", trees), "rf": lambda: model.rf_regressor("y", trees)}
    compared = model.cv_compare(fit, "y", {k: f() for k, f in makers.items()}, sets, folds)
    best = model.best_of(compared)
    chosen = best.first()
    kept = [c for c in sets[chosen["feature_set"]] if c not in model.drop_unobserved(fit, sets[chosen["feature_set"]])]
    fitted = model.fit_pipeline(fit, kept, makers[chosen["model"]]())
    if model_path:
        model.save_model(fitted[0], model_path)
    predictions = model.holdout_predictions(model.predict(*fitted, held), "LOS_LAST", lo, hi)
    return {"ml_target": missing, "ml_cv": compared, "ml_best": best, "ml_predictions": predictions, "ml_metrics": model.regression_metrics(predictions, "y", "yhat")}


def archive(spark: SparkSession, tables: Mapping[str, DataFrame], salt: str, out: str | None = None, patterns: Sequence[str] = ("^mart_",), access: Sequence[str] = ("^mart_merged$",)) -> dict[str, DataFrame]:
    """De-identified tables and a report on them; with a folder also the reduced access copy and the checksums of all that was written."""
    names = deid.matching_tables(sorted(tables), patterns)
    safe = {n: deid.deid_table(tables[n], "USUBJID", salt) for n in names if "USUBJID" in tables[n].columns}
    found = {f"deid_{n}": df for n, df in safe.items()}
    found["deid_report"] = quality.union_all([deid.deid_report(n, tables[n], df) for n, df in safe.items()])
    if out:
        deid.access_copy(safe, patterns, f"{out}/archive/tables")
        deid.access_copy(safe, access, f"{out}/archive/access", "csv")
        found["fixity"] = fixity.fixity_manifest(spark, f"{out}/archive")
    return found


def run_chain(spark: SparkSession, folder: str, run_id: str, strict: bool = True, vitals: Sequence[str] = domains.VITAL_CODES, out: str | None = None, salt: str | None = None, trees: int = TREES, buckets: int = S.BUCKETS) -> dict[str, DataFrame]:
    """All layers' frames by table name, with the staged checks under ``meta_dq_results``; the gate stops a strict run on hard failures.

    ``out`` is the folder that layers are written to, those of standard and analysis tables in ``buckets`` buckets by subject. With a ``salt`` the marts are archived without identities.
    """

    def keep(frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
        if not out:
            return frames
        for name, df in frames.items():
            df.write.mode("overwrite").parquet(f"{out}/{name}")
        return {name: spark.read.parquet(f"{out}/{name}") for name in frames}

    def bucketed(frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """As ``keep``, by subject: what the marts make of these layers then needs no exchange."""
        if not out:
            return frames
        mark = uuid.uuid4().hex
        return {name: S.write_layer(df, f"lamina_{mark}_{name}", "USUBJID", f"{out}/{name}", buckets) for name, df in frames.items()}

    log = S.load_tables(spark, {n: f"{folder}/{n}.csv" for n in CORE_TABLES}, CORE_TABLES, run_id, f"{out}/meta_stg_load" if out else None)
    staged = stage(read_sources(spark, folder), run_id)
    if out:
        registry.record_run(spark, f"{out}/meta_run", run_id, datetime.now(UTC).isoformat(), folder)
    kept = keep({f"stg_{n}": df for n, df in staged.items()})
    staged = {n.removeprefix("stg_"): df for n, df in kept.items()}
    checks = check_staged(spark, staged, run_id)
    found = {"meta_stg_load": log} | kept | keep({"meta_dq_results": checks})
    if strict:
        quality.gate(checks)
    curated = keep(curate(staged, stored=bool(out)))
    sizes = S.layer_counts({n: df for n, df in curated.items() if n.startswith("cur_")})
    standard = bucketed(standardise(curated, vitals))
    analysis = bucketed(analyse(standard))
    made = keep(marts(standard, analysis))
    found |= curated | standard | analysis | made
    found |= keep({"meta_layer_counts": sizes, "meta_domain_counts": domains.domain_counts(standard)} | check_domains(standard) | check_analysis(spark, analysis, run_id))
    found |= keep(train(made["mart_merged"], trees, model_path=f"{out}/model" if out else None))
    return found | (archive(spark, made, salt, out) if salt else {})
