"""Operators on small frames: nulls, blanks, ties, empty input."""

from __future__ import annotations

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from lamina.functions import columns as C
from lamina.operators import deid, domains, features, model, profile, quality, quarantine, ranks, visits
from lamina.sources import fixity, tables
from lamina.streaming.quality import flag_stream, split_stream

AT = dt.datetime


def one(df):
    return df.first().asDict()


def test_resolve_col_takes_first_candidate_in_any_case(spark):
    df = spark.createDataFrame([(1, 2)], "Id int, patient int")
    assert C.resolve_col(df, ["missing", "ID"]) == "Id"
    assert C.resolve_col(df, ["none"], required=False) is None
    with pytest.raises(KeyError):
        C.resolve_col(df, ["none"])


def test_casts(spark):
    df = spark.createDataFrame([("5d",), ("1e3",), (" 5 ",), ("x",), (None,)], "v string")
    assert [r.n for r in df.select(C.safe_cast(F.col("v"), "double").alias("n")).collect()] == [None, 1000.0, 5.0, None, None]
    counted = C.typed(df, {"v": "double"}, mode="quarantine").collect()
    assert [r._bad_casts for r in counted] == [1, 0, 0, 1, 0]
    with pytest.raises(Exception):  # noqa: B017  strict casts raise in Spark
        C.typed(df, {"v": "double"}).collect()
    with pytest.raises(ValueError):
        C.typed(df, {"v": "double"}, mode="other")


def test_missing_predicates_and_tokens(spark):
    df = spark.createDataFrame([(None,), ("  ",), ("unk",), ("Unknown",), ("n/a",), ("x",)], "v string")
    assert [r.m for r in df.select(C.is_effectively_missing(F.col("v")).alias("m")).collect()] == [True, True, True, True, False, False]
    assert [r.v for r in C.normalize_tokens(df).collect()] == [None, None, "unk", "Unknown", None, "x"]
    numbers = spark.createDataFrame([(float("nan"),), (float("inf"),), (-1.5,), (None,)], "v double")
    assert [r.v for r in C.null_inf(numbers).collect()] == [None, None, -1.5, None]
    assert [r.v for r in numbers.select(C.clip(C.finite(F.col("v")), 0).alias("v")).collect()] == [None, None, 0.0, None]


def test_time_differences(spark):
    rows = [(AT(2020, 1, 1, 0, 0, 0, 900000), AT(2020, 1, 1, 0, 0, 1, 100000)), (AT(2020, 1, 2), AT(2020, 1, 1)), (None, AT(2020, 1, 1))]
    df = spark.createDataFrame(rows, "a timestamp_ntz, b timestamp_ntz")
    out = df.select(C.los_days(F.col("a"), F.col("b")).alias("d"), C.los_minutes(F.col("a"), F.col("b")).alias("m"), C.day_diff(F.col("a"), F.col("b")).alias("n")).collect()
    assert out[0].d == pytest.approx(1 / 86400) and out[0].m == pytest.approx(0.2 / 60) and out[0].n == 0
    assert out[1].d == 0.0 and out[1].m == 0.0 and out[1].n == -1
    assert tuple(out[2]) == (None, None, None)


def test_names(spark):
    assert C.safe_name("a  b//c") == "a_b_c"
    df = spark.createDataFrame([("LOS_12",), ("x",)], "v string")
    assert [r.n for r in df.select(C.trailing_int(F.col("v")).alias("n")).collect()] == [12, None]


def test_quarantine_parts_rows_exactly(spark):
    rows = [(1, 1, AT(2020, 1, 1), AT(2020, 1, 2), 1.0, 1.0), (None, 1, None, None, None, None), (2, None, None, None, 1.0, 1.0), (3, 1, AT(2020, 2, 1), AT(2020, 1, 1), -1.0, 1.0), (4, 1, None, None, -1.0, -2.0), (5, 1, None, None, 1.0, -2.0)]
    df = spark.createDataFrame(rows, "encounter_id int, patient_id int, start_ts timestamp_ntz, stop_ts timestamp_ntz, base_cost double, total_cost double")
    clean, rejects = quarantine.curate_visit(df)
    assert [r.encounter_id for r in clean.collect()] == [1] and clean.first().los_days == 1
    assert [r.reject_reason for r in rejects.collect()] == ["missing_encounter_id", "missing_patient_id", "bad_time_order_start_gt_stop", "negative_base_cost", "negative_total_cost"]
    none, nothing = quarantine.curate_visit(df.limit(0))
    assert none.count() == 0 and nothing.count() == 0


def test_referential_split_keeps_duplicates_and_names_first_parent(spark):
    child = spark.createDataFrame([(1, 1), (1, 1), (None, 1), (2, 9), (9, 9)], "p int, v int")
    subjects, visit = spark.createDataFrame([(1,), (1,), (2,), (None,)], "p int"), spark.createDataFrame([(1,)], "v int")
    clean, rejects = quarantine.ri_split(child, [(subjects, "p", "p", "no subject"), (visit, "v", "v", "no visit")])
    assert clean.count() == 2
    assert sorted(r.reject_reason for r in rejects.collect()) == ["no subject", "no subject", "no visit"]
    assert quarantine.orphans(child, subjects, "p", "p").count() == 2
    assert quarantine.orphans(child, subjects, "p", "p", only_nonnull=True).count() == 1


def test_dup_groups_with_and_without_null_keys(spark):
    df = spark.createDataFrame([(None,), (None,), (1,), (1,), (2,)], "k int")
    assert one(quarantine.dup_groups(df, [F.col("k")])) == {"n_dup_groups": 2}
    assert one(quarantine.dup_groups(df, [F.col("k")], drop_null=True)) == {"n_dup_groups": 1}


def test_visit_chain_imputes_from_next_visit(spark):
    sv = spark.createDataFrame([("A", 1, "x", "2020-01-01 00:00:00", None), ("A", 2, "x", "2020-01-03 00:00:00", None), ("B", 1, "y", "2020-01-01 00:00:00", "2019-01-01 00:00:00")], "USUBJID string, VISITNUM long, VISIT string, SVSTDTC string, SVENDTC string")
    los = {(r.USUBJID, r.VISITNUM): r for r in visits.visit_los(sv).collect()}
    assert (los["A", 1].LOS_DAYS, los["A", 1].END_IMPUTEDFL, los["A", 1].END_MISSING_UNRESOLVEDFL) == (2.0, 1, 0)
    assert (los["A", 2].LOS_DAYS, los["A", 2].END_IMPUTEDFL, los["A", 2].END_MISSING_UNRESOLVEDFL) == (None, 1, 1)
    assert los["B", 1].LOS_DAYS == 0.0
    assert visits.index_visit(visits.visit_los(sv)).count() == 2


def test_sequence_cap_and_round_trip(spark):
    df = spark.createDataFrame([("A", k) for k in range(25)], "s string, k long")
    numbered = visits.sequence(df, "s", ["k"], cap=20)
    assert numbered.count() == 20
    wide = visits.pivot_sequence(numbered, "s", "SEQ", {"k": "K"})
    assert visits.unpivot_sequence(wide, "s", ["K"]).count() == 20
    last, before = visits.split_last(numbered, "s", "SEQ")
    assert last.first().k == 19 and before.count() == 19


def test_first_per_breaks_ties_by_last_key(spark):
    df = spark.createDataFrame([("A", 1, 2), ("A", 1, 1), ("B", None, 3)], "g string, o int, id int")
    assert sorted((r.g, r.id) for r in visits.first_per(df, ["g"], ["o", "id"]).collect()) == [("A", 1), ("B", 3)]


def test_domain_maps(spark):
    subjects = spark.createDataFrame([(1, " m ", dt.date(2000, 1, 1), None, "r", "e"), (2, None, None, None, None, None)], "patient_id int, gender string, birth_date date, death_date date, race string, ethnicity string")
    assert [(r.USUBJID, r.SEX, r.BRTHDTC) for r in domains.map_dm(subjects).collect()] == [("SYN-1", "M", "2000-01-01"), ("SYN-2", "U", None)]
    events = spark.createDataFrame([(1, 7, None, None, None), (1, 8, "d", None, None)], "patient_id int, code int, description string, start_ts timestamp_ntz, stop_ts timestamp_ntz")
    assert [r.CMTRT for r in domains.map_cm(events).collect()] == ["7", "d"]
    assert [r.MHTERM for r in domains.map_mh(events).collect()] == [None, "d"]


def test_null_codes_are_in_neither_finding_domain(spark):
    rows = [(1, "a", None, "5", None, None), (1, None, None, "5", None, None), (1, "b", None, "x", None, None)]
    df = spark.createDataFrame(rows, "patient_id int, code string, description string, value string, units string, obs_ts timestamp_ntz")
    assert [r.LBSTRESN for r in domains.map_lb(df, ["a"]).collect()] == [None] and domains.map_vs(df, ["a"]).first().VSSTRESN == 5.0


def test_checks_and_gate(spark):
    df = spark.createDataFrame([(1, "r"), (1, "r"), (None, "q")], "id int, _run_id string")
    rows = {r.check_name: r for r in quality.check_pk(df, "t", ["id"]).collect()}
    assert rows["pk_not_null"].n_bad == 1 and rows["pk_unique"].n_bad == 1
    assert quality.check_pk(df, "t", ["nope"]).first().status == "ERROR"
    assert quality.check_constant(df, "t", "_run_id", "r").first().n_bad == 1
    assert quality.check_unique(df, "t", ["nope"]).first().status == "SKIP"
    results = quality.DQResults(spark, "run")
    results.add(quality.check_pk, df, "t", ["id"], table="t")
    results.add(quality.check_order, df, "t", "a", "b", table="t")
    frame = results.frame()
    assert quality.failures(frame).count() == 3
    with pytest.raises(quality.GateError):
        quality.gate(frame)
    assert quality.gate(frame, strict=False) is False
    assert quality.gate(frame.where("severity = 'SOFT'")) is True


def test_rates_on_empty_input(spark):
    empty = spark.createDataFrame([], "k int, code string, label string, a timestamp_ntz, b timestamp_ntz")
    parent = spark.createDataFrame([(1,)], "k int")
    assert one(quality.ri_rate(empty, parent, "k", "k"))["ok_rate"] == 1.0
    assert one(quality.coverage(empty, "X", "code", "label"))["code_pct"] == 100.0
    assert one(quality.timing(empty, "X", "a", "b"))["ok_pct"] == 100.0


def test_history_and_target(spark):
    rows = [("A", 1, "x", 10.0), ("A", 2, "y", 20.0), ("A", 3, "x", None), ("B", 1, "x", 5.0)]
    long = spark.createDataFrame(rows, "USUBJID string, SEQ long, VISIT string, LOS double")
    assert {(r.USUBJID, r.LOS_LAST, r.LAST_CAT) for r in features.last_visit_target(long).collect()} == {("A", 20.0, "y"), ("B", 5.0, "x")}
    cats = {r.USUBJID: r for r in features.history_by_category(long).collect()}
    assert cats["A"].N_VISITS_PREV_x == 1 and cats["A"].LOS_MEAN_PREV_y == 0
    assert cats["B"].N_VISITS_PREV == 0 and cats["B"].LOS_MEAN_PREV is None and cats["B"].LOS_IQR_PREV is None


def test_coverage_drop_and_median_fill(spark):
    df = spark.createDataFrame([("A", 1.0, 1, None), ("B", 3.0, None, None), ("C", None, 2, None)], "USUBJID string, m_MEAN double, m_count int, z_MEAN double")
    kept, gone = features.coverage_drop(df)
    assert gone == ["z_MEAN"] and "m_MEAN" in kept.columns
    filled, report = features.median_fill(df)
    assert sorted(tuple(r) for r in filled.collect()) == [("A", 1.0, 1), ("B", 3.0, 0), ("C", 2.0, 2)]
    assert {r.feature: r.action for r in report.collect()} == {"m_MEAN": "median", "z_MEAN": "dropped", "m_count": "zero"}


def test_profile(spark):
    df = spark.createDataFrame([("bad", 1), ("2020-01-01", 1), (None, 1), (None, 1)], "start_date string, v int")
    assert one(profile.profile_table(df, "t")) == {"table_name": "t", "n_rows": 4, "n_cols": 2, "duplicate_rows": 1, "n_date_cols": 1, "max_parse_fail_rate": 0.5, "top_missing_cols": "start_date:50.00%; v:0.00%"}
    assert {r.bin: r.n for r in profile.histogram(df, "v").collect()} == {0: 4}
    flat = profile.iqr_spread(spark.createDataFrame([(1.0, 2.0), (1.0, 2.0)], "a double, b double"))
    assert {r.iqr_norm for r in flat.collect()} == {0.0}


def test_model_helpers(spark):
    df = spark.createDataFrame([(k, float(min(k, 5))) for k in range(20)], "id int, y double")
    bins = model.decile_bins(df, "y")
    assert bins.where("y = 5").select("bin").distinct().count() == 1
    parts = model.stratified_split(bins, "bin", "id")
    assert parts.groupBy("id").count().where("count > 1").count() == 0
    assert 2 <= parts.where("part = 'test'").count() <= 6
    scaled, lo, hi = model.minmax(df, "y")
    assert (lo, hi) == (0.0, 5.0) and scaled.agg(F.max("y_scaled")).first()[0] == 1.0
    assert model.feature_sets(df.withColumn("x_count", F.lit(1)), "y", ("id",)) == {"A": ["x_count"], "B": []}
    text = df.select("id", F.lit("a").alias("t"), F.lit(None).cast("double").alias("n"))
    assert model.drop_unobserved(text, ["t", "n"]) == ["n"]
    assert model.drop_unobserved(text, ["t", "n"], numeric_only=False) == ["n", "t"]


def test_deidentification(spark):
    df = spark.createDataFrame([("1", "x", dt.date(2020, 1, 1), "nan"), ("", "y", None, "ok"), (None, "z", None, "")], "key string, first_name string, birth date, note string")
    out = deid.deid_table(df, "key", "s")
    assert sorted(out.columns) == ["SUBJ_HASH", "note"]
    assert [(r.SUBJ_HASH is None, r.note) for r in out.collect()] == [(False, None), (True, "ok"), (True, None)]
    assert one(deid.deid_report("t", df, out))["dropped"] == "birth,first_name,key"
    assert "ETHNICITY" in deid.drop_identifiers(df.withColumn("ETHNICITY", F.lit("x"))).columns


@pytest.mark.parametrize(
    "name",
    "name email e-mail E_MAIL phone tel TEL_NO address street zip ZipCode zipcode postal city CITY_OF_BIRTH state StateCode mrn MRN_1 patid patientid patient_id PATIENTID ssn social_security passport iban account FirstName LastName firstname LASTNAME".split(),
)
def test_identifier_names_are_found(name):
    assert deid.is_identifier(name)


@pytest.mark.parametrize("name", "ETHNICITY STATUS capacity velocity hotel telemetry STUDYID USUBJID SEX RACE AGE LOS_LAST LAB_8302_2_MEAN N_VISITS_PREV statement accepted".split())
def test_other_names_stay(name):
    assert not deid.is_identifier(name)


def test_upsert_and_contract(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(tuple(r) for r in tables.upsert(old, new, ["k"]).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted((r.table_name, r.present, r.n_rows, r.status) for r in tables.contract_check(spark, {"a": old}, ["a", "b"]).collect()) == [("a", 1, 2, "PASS"), ("b", 0, None, "FAIL")]
    log = tables.load_tables(spark, {"gone": "/nowhere/gone.parquet"}, ["gone", "none"]).collect()
    assert [r.status for r in log] == ["ERROR", "SKIP"]


def test_fixity_finds_a_changed_byte(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    (tmp_path / "b.bin").write_bytes(b"xyz")
    manifest = spark.createDataFrame(fixity.fixity_manifest(spark, str(tmp_path)).select("file", "size", "sha256").collect())
    (tmp_path / "a.bin").write_bytes(b"abd")
    (tmp_path / "b.bin").unlink()
    status = {r.file: r.status for r in fixity.fixity_verify(manifest, fixity.fixity_manifest(spark, str(tmp_path))).collect()}
    assert status == {"a.bin": "mismatch", "b.bin": "missing"}


def test_fixity_tells_files_of_one_name_apart(spark, tmp_path):
    for part in "ab":
        (tmp_path / part).mkdir()
        (tmp_path / part / "part-0").write_text(part)
    kept = fixity.fixity_manifest(spark, str(tmp_path)).select("file", "size", "sha256")
    manifest = spark.createDataFrame(kept.collect())
    assert one(fixity.verify_summary(fixity.fixity_verify(manifest, fixity.fixity_manifest(spark, str(tmp_path))))) == {"checked": 2, "ok": 2, "missing": 0, "mismatch": 0}
    (tmp_path / "b" / "part-0").unlink()
    status = {r.file: r.status for r in fixity.fixity_verify(manifest, fixity.fixity_manifest(spark, str(tmp_path))).collect()}
    assert status == {"a/part-0": "ok", "b/part-0": "missing"}
    assert fixity.source_digest(spark, str(tmp_path / "a" / "part-0")) == hashlib.sha256(b"a").hexdigest()


def test_load_log_is_appended(spark, tmp_path):
    (tmp_path / "x.csv").write_text("k,v\n1,a\n2,b\n")
    for run in ("r1", "r2"):
        tables.load_tables(spark, {"x": str(tmp_path / "x.csv")}, ["x", "y"], run, str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log")).collect()
    assert sorted((r.run_id, r.table_name, r.stg_table, r.row_count, r.status) for r in log) == [(run, t, f"stg_{t}", n, s) for run in ("r1", "r2") for t, n, s in (("x", 2, "OK"), ("y", None, "SKIP"))]
    assert {r.source_sha256 for r in log if r.table_name == "x"} == {hashlib.sha256((tmp_path / "x.csv").read_bytes()).hexdigest()}
    assert all(r.ingested_at for r in log)


def test_a_check_that_fails_at_run_time_is_an_error_row(spark):
    df = spark.createDataFrame([("x",)], "v string").select(F.col("v").cast("int").alias("k"))
    results = quality.DQResults(spark, "run")
    results.add(quality.check_constant, df, "t", "k", 1, table="t")
    assert [(r.status, r.check_name) for r in results.frame().collect()] == [("ERROR", "check_constant")]


def test_row_checks_of_a_table_are_one_aggregate(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (3, None)], "k int, v string")
    got = quality.check_rows(df, "t", {"k_null": (F.col("k").isNull(), quality.HARD), "v_b": (F.col("v") == "b", quality.SOFT), "none": (F.col("k") > 9, quality.SOFT)})
    assert sorted((r.check_name, r.n_bad, r.severity, r.status) for r in got.collect()) == [("k_null", 1, "HARD", "FAIL"), ("none", 0, "SOFT", "PASS"), ("v_b", 1, "SOFT", "FAIL")]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


def test_exact_quantiles_and_ranks(spark):
    import numpy as np

    draw = np.random.default_rng(4)
    rows = [(k, float(v), None if k % 3 else float(k), None) for k, v in enumerate(draw.integers(0, 40, 500))]
    df = spark.createDataFrame(rows, "id int, a double, b double, none double").repartition(7)
    probs = [0.0, 0.1, 0.25, 0.5, 0.99, 1.0]
    got = ranks.exact_quantiles(df, ["a", "b", "none"], probs)
    assert np.allclose(got["a"], np.quantile([r[1] for r in rows], probs)) and np.allclose(got["b"], np.quantile([r[2] for r in rows if r[2] is not None], probs)) and got["none"] is None
    placed = ranks.ranked(df.withColumn("g", F.col("id") % 2).withColumn("lot", F.col("a") / 40), "g", F.col("lot"), [F.col("lot"), F.col("id")], "rank", bucket_rows=3)
    for g in (0, 1):
        part = sorted(placed.where(F.col("g") == g).collect(), key=lambda r: (r.lot, r.id))
        assert [r["rank"] for r in part] == list(range(1, len(part) + 1)) and {r["_n"] for r in part} == {len(part)}


def test_rows_with_null_keys_are_spread_in_referential_joins(spark):
    child = spark.range(400).selectExpr("cast(if(id % 4 = 0, id % 5, null) as int) as p", "id")
    parents = spark.createDataFrame([(0,), (1,)], "p int")
    clean, rejects = quarantine.ri_split(child, [(parents, "p", "p", "no parent")])
    assert clean.count() == 40 and rejects.count() == 360


def test_long_history_takes_any_number_of_categories(spark):
    rows = [(f"S{k}", 1, f"cat{k}", 1.0 + k) for k in range(1200)] + [(f"S{k}", 2, "last", 1.0) for k in range(1200)]
    long = spark.createDataFrame(rows, "USUBJID string, SEQ long, VISIT string, LOS double")
    got = features.history_long(long)
    assert got.count() == 1200 and got.where("VISIT = 'cat7'").first().LOS_MEAN_PREV == 8.0
    with pytest.raises(ValueError, match="long form"):
        features.history_by_category(long)


def test_null_safe_keys(spark):
    a, b = spark.createDataFrame([(1, None), (None, 2)], "x int, y int"), spark.createDataFrame([(1, None), (None, 3)], "x int, y int")
    assert a.join(b, C.null_safe_on(a, b, ["x", "y"])).count() == 1


def test_stream_splits_like_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    df = spark.createDataFrame([(1, 2), (None, 3)], "patient_id int, x int")
    df.write.parquet(source)
    stream = spark.readStream.schema(df.schema).parquet(source)
    assert flag_stream(stream, quarantine.subject_rules()).isStreaming
    done = split_stream(stream, quarantine.subject_rules(), str(tmp_path / "clean"), str(tmp_path / "bad"), str(tmp_path / "cp"))
    done.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "clean")).count() == 1
    assert spark.read.parquet(str(tmp_path / "bad")).first().reject_reason == "missing_patient_id"
