"""The whole chain on a few clinical CSV rows."""

from __future__ import annotations

import pytest

from lamina.operators.quality import GateError
from lamina.plans.chain import run_chain

FILES = {
    "patients": "Id,BIRTHDATE,DEATHDATE,GENDER,RACE,ETHNICITY,CITY,STATE,ZIP,INCOME,HEALTHCARE_EXPENSES,HEALTHCARE_COVERAGE\np1,1980-01-01,,M,white,x,C,S,1,10,1,1\np2,1990-06-01,,F,,y,C,S,1,20,1,1\n",
    "encounters": "Id,START,STOP,PATIENT,ORGANIZATION,PROVIDER,PAYER,ENCOUNTERCLASS,CODE,DESCRIPTION,BASE_ENCOUNTER_COST,TOTAL_CLAIM_COST,PAYER_COVERAGE\n"
    "e1,2020-01-01T00:00:00Z,2020-01-02T12:00:00Z,p1,o,r,y,inpatient,1,d,5,5,1\ne2,2020-02-01T00:00:00Z,2020-02-01T01:00:00Z,p1,o,r,y,wellness,1,d,5,5,1\ne3,2020-01-05T00:00:00Z,2020-01-01T00:00:00Z,p2,o,r,y,wellness,1,d,5,5,1\ne4,2020-03-01T00:00:00Z,,p2,o,r,y,wellness,1,d,-5,5,1\ne5,2020-04-01T00:00:00Z,2020-04-01T02:00:00Z,p2,o,r,y,wellness,1,d,5,5,1\n",
    "conditions": "START,STOP,PATIENT,ENCOUNTER,CODE,DESCRIPTION\n2020-01-01,,p1,e1,c1,cold\n2020-01-01,,p1,e9,c1,cold\n2020-01-01,,,e1,c1,cold\n",
    "procedures": "DATE,PATIENT,ENCOUNTER,CODE,DESCRIPTION\n2020-01-01,p1,e1,x1,\nbad,p1,e1,x1,scan\n",
    "medications": "START,STOP,PATIENT,ENCOUNTER,CODE,DESCRIPTION\n2020-01-01,2020-01-03,p1,e1,m1,pill\n2020-01-01,,p1,e1,,\n",
    "observations": "DATE,PATIENT,ENCOUNTER,CODE,DESCRIPTION,VALUE,UNITS\n2020-01-01T00:00:00Z,p1,e1,8302-2,Height,170,cm\n2020-01-01T00:00:00Z,p1,e1,L1,Lab one,5.5,u\n2020-01-02T00:00:00Z,p2,e5,L1,Lab one,n/a,u\nnever,p2,e5,L1,Lab one,7,u\n",
}


@pytest.fixture
def folder(tmp_path):
    for name, text in FILES.items():
        (tmp_path / f"{name}.csv").write_text(text)
    return tmp_path


def test_chain(spark, folder):
    t = run_chain(spark, str(folder), "r1")
    reasons = lambda n: sorted(r.reject_reason for r in t[n].collect())
    assert reasons("rej_encounters") == ["bad_time_order_start_gt_stop", "negative_base_cost"]
    assert reasons("rej_conditions") == ["missing_patient_id"] and reasons("rej_conditions_ri") == ["missing_in_cur_encounters"]
    assert reasons("rej_procedures") == ["missing_date"] and reasons("rej_medications") == ["missing_code_and_description"]
    assert reasons("rej_observations") == ["bad_date_parse"]
    subjects = {r.USUBJID: r for r in t["adam_adsl"].collect()}
    assert (subjects["SYN-p1"].INDEX_LOS_DAYS, subjects["SYN-p1"].AGE) == (1.5, 40)
    assert t["sdtm_vs"].count() == 1 and t["sdtm_lb"].count() == 2 and t["sdtm_pr"].first().PRTRT == "x1"
    merged = {r.USUBJID: r for r in t["mart_merged"].collect()}
    assert (merged["SYN-p1"].LOS_LAST, merged["SYN-p1"].N_VISITS_PREV, merged["SYN-p1"].LOS_MEAN_PREV_inpatient) == (60.0, 1, 2160.0)
    assert merged["SYN-p2"].N_VISITS_PREV == 0 and merged["SYN-p2"].RACE == "UNKNOWN"
    assert t["meta_dq_results"].where("status = 'ERROR'").count() == 0


def test_strict_gate_stops_on_a_broken_contract(spark, folder):
    path = folder / "patients.csv"
    path.write_text(path.read_text() + ",1990-01-01,,M,,,,,,,,\n")
    with pytest.raises(GateError):
        run_chain(spark, str(folder), "r1")
    assert "cur_patients" in run_chain(spark, str(folder), "r1", strict=False)


def test_chain_reaches_the_archive(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    # enough subjects for a model: patients with two visits each
    many = range(10, 110)
    (folder / "patients.csv").write_text(FILES["patients"] + "".join(f"p{k},1980-01-01,,{'MF'[k % 2]},r{k % 3},x,C,S,1,10,1,1\n" for k in many))
    visits = "".join(f"a{k},2020-01-0{1 + k % 5}T00:00:00Z,2020-01-0{2 + k % 5}T0{k % 9}:00:00Z,p{k},o,r,y,wellness,1,d,5,5,1\nb{k},2020-03-01T00:00:00Z,2020-03-01T0{1 + k % 7}:{k % 60:02}:00Z,p{k},o,r,y,wellness,1,d,5,5,1\n" for k in many)
    (folder / "encounters.csv").write_text(FILES["encounters"] + visits)
    t = run_chain(spark, str(folder), "r1", out=out, salt="s", trees=2, buckets=3)
    log = {r.table_name: r for r in spark.read.parquet(f"{out}/meta_stg_load").collect()}
    assert log["patients"].row_count == 102 and len(log["patients"].source_sha256) == 64 and log["patients"].stg_table == "stg_patients"
    assert {r.table_name: r.n_rows for r in t["meta_layer_counts"].collect()}["cur_encounters"] == 203
    assert t["qc_summary"].first().any_bad_ri == 0 and t["qc_analysis"].where("status = 'ERROR'").count() == 0
    assert {r.domain for r in t["qc_coverage"].collect()} >= {"sdtm_lb", "sdtm_mh"}
    assert t["ml_cv"].count() == 20 and t["ml_best"].count() == 1 and t["ml_predictions"].count() > 10 and t["ml_metrics"].first().mae >= 0
    safe = t["deid_mart_merged"]
    assert "USUBJID" not in safe.columns and safe.select("SUBJ_HASH").distinct().count() == safe.count()
    assert {r.table_name for r in t["deid_report"].collect()} >= {"mart_merged", "mart_wide"}
    files = [r.file for r in t["fixity"].collect()]
    assert any(f.startswith("tables/mart_merged/part-") for f in files) and any(f.startswith("access/mart_merged/") for f in files) and len(files) == len(set(files))
