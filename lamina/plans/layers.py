"""Queries of the staging, curated, standard and analysis layers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import domains, quarantine, references, visits
from ..scratch import fresh_path
from ..sources import registry
from ..sources import tables as S
from .roles import Roles, sql

QUERIES, ORACLE = {}, {}
RUN = "run-1"


def query(oracle: str | None = None):
    """Register a function of roles under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Roles(spark, sf_dir))
        if oracle:
            ORACLE[f.__name__] = oracle
        return f

    return register


def scratch_path(spark: SparkSession, name: str) -> str:
    return fresh_path(spark, name)


# sources and sinks


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(o_orderdate AS DATE) AS o_day FROM orders")
def csv_roundtrip(r: Roles) -> DataFrame:
    orders = r.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.col("o_orderdate").cast("date").alias("o_day"))
    path = scratch_path(r.spark, "csv")
    S.write_csv(orders, path)
    return S.read_csv(r.spark, path, orders.schema)


@query("SELECT c_nationkey, count(*) AS n, round(avg(c_acctbal), 6) AS avg_acctbal FROM customer GROUP BY c_nationkey")
def layer_ctas(r: Roles) -> DataFrame:
    made = r.table("customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 6).alias("avg_acctbal"))
    return S.write_table(made, f"lamina_ctas_{uuid.uuid4().hex}")


@query("SELECT c_custkey, c_name, 'run-1' AS _run_id, 'customer.parquet' AS _source_file FROM customer")
def stage_lineage(r: Roles) -> DataFrame:
    return S.with_lineage(r.table("customer"), RUN).select("c_custkey", "c_name", "_run_id", "_source_file")


def blob(table: str) -> str:
    """The file of a table as SQL: of the test folders, the one whose row count is that of the table's view."""
    files = f"'/root/testdata/sf*/{table}.parquet'"
    return f"(SELECT parse_filename(filename) AS file, CAST(size AS BIGINT) AS size, sha256(content) AS sha256 FROM read_blob({files}) WHERE filename IN (SELECT file_name FROM parquet_file_metadata({files}) WHERE num_rows = (SELECT count(*) FROM {table})))"


@query(
    " UNION ALL ".join(f"SELECT 'run-1' AS run_id, '{t}' AS table_name, 'stg_{t}' AS stg_table, '{t}.parquet' AS source_file, (SELECT sha256 FROM {blob(t)} b) AS source_sha256, (SELECT count(*) FROM {t}) AS row_count, 'OK' AS status, CAST(NULL AS VARCHAR) AS message" for t in ("customer", "orders"))
    + " UNION ALL SELECT 'run-1', 'claims', 'stg_claims', NULL, NULL, NULL, 'SKIP', 'source missing'"
)
def load_log(r: Roles) -> DataFrame:
    path = scratch_path(r.spark, "log")
    S.load_tables(r.spark, {t: f"{r.dir}/{t}.parquet" for t in ("customer", "orders")}, ["customer", "orders", "claims"], RUN, path)
    return r.spark.read.parquet(path).drop("ingested_at")


@query("SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 10 = 0 THEN 'U' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def run_upsert(r: Roles) -> DataFrame:
    """The table is stored, one tenth of its rows updated there, and what is stored then read."""
    target = r.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    path = scratch_path(r.spark, "registry")
    registry.create(target, path, ["o_orderkey"], 16)
    registry.merge(target.where("o_orderkey % 10 = 0").withColumn("o_orderstatus", F.lit("U")), path)
    return registry.read(r.spark, path)


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in ("customer", "orders", "lineitem", "events")))
def layer_counts(r: Roles) -> DataFrame:
    return S.layer_counts({t: r.table(t) for t in ("customer", "orders", "lineitem", "events")})


@query("SELECT 'run-1' AS run_id, 'load' AS step, m AS metric, v AS value FROM (SELECT 'n_orders' AS m, CAST(count(*) AS DOUBLE) AS v FROM orders UNION ALL SELECT 'n_customers', CAST(count(DISTINCT o_custkey) AS DOUBLE) FROM orders) t")
def metric_records(r: Roles) -> DataFrame:
    path = scratch_path(r.spark, "metrics")
    S.write_metrics(r.table("orders").agg(F.count("*").alias("n_orders"), F.countDistinct("o_custkey").alias("n_customers")), RUN, "load", path)
    return r.spark.read.parquet(path)


@query("SELECT 'customer' AS table_name, CAST(1 AS INTEGER) AS present, (SELECT count(*) FROM customer) AS n_rows, 'PASS' AS status UNION ALL SELECT 'orders', 1, (SELECT count(*) FROM orders), 'PASS' UNION ALL SELECT 'claims', 0, NULL, 'FAIL'")
def contract_presence(r: Roles) -> DataFrame:
    required = ["customer", "orders", "claims"]
    present = {t: r.table(t) for t in S.sf_tables(r.spark, r.dir) if t in required}
    return S.contract_check(r.spark, present, required)


# projections and casts


@query("SELECT o_orderkey AS order_id, o_custkey AS customer_id FROM orders")
def resolve_columns(r: Roles) -> DataFrame:
    o = r.table("orders")
    key, cust = C.resolve_col(o, ["id", "O_ORDERKEY"]), C.resolve_col(o, ["customer", "o_custKey"])
    return C.project(o, {"order_id": F.col(key), "customer_id": F.col(cust)})


@query(sql("SELECT event_id, TRY_CAST(obs_ts AS TIMESTAMP) AS obs_ts, TRY_CAST(value AS DOUBLE) AS value, CAST((TRY_CAST(obs_ts AS TIMESTAMP) IS NULL) AS INTEGER) + CAST(TRY_CAST(value AS DOUBLE) IS NULL AS INTEGER) AS _bad_casts FROM r_finding", "r_finding"))
def typed_cast(r: Roles) -> DataFrame:
    return C.typed(r.raw_finding().select("event_id", "obs_ts", "value"), {"obs_ts": "timestamp_ntz", "value": "double"}, mode="quarantine")


@query(sql("SELECT event_id, TRY_CAST(value AS DOUBLE) AS number FROM r_finding", "r_finding"))
def try_cast_numeric(r: Roles) -> DataFrame:
    return r.raw_finding().select("event_id", C.safe_cast(F.col("value"), "double").alias("number"))


@query(
    sql(
        """SELECT event_id, CASE WHEN lower(trim(code)) NOT IN ('', 'nan', 'none', 'null', 'na', 'n/a', 'nat') THEN code END AS code,
        CASE WHEN lower(trim(value)) NOT IN ('', 'nan', 'none', 'null', 'na', 'n/a', 'nat') THEN value END AS value FROM r_finding""",
        "r_finding",
    )
)
def normalize_tokens(r: Roles) -> DataFrame:
    return C.normalize_tokens(r.raw_finding().select("event_id", "code", "value"))


@query(sql("SELECT event_id, CASE WHEN NOT isnan(number) AND NOT isinf(number) THEN number END AS number FROM r_finding", "r_finding"))
def normalize_inf(r: Roles) -> DataFrame:
    return C.null_inf(r.raw_finding().select("event_id", "number"))


@query("SELECT p_partkey, TRY_CAST(nullif(regexp_extract(p_brand, '(\\d+)$', 1), '') AS INTEGER) AS brand_no FROM part")
def trailing_number(r: Roles) -> DataFrame:
    return r.table("part").select("p_partkey", C.trailing_int(F.col("p_brand")).alias("brand_no"))


# curated layer


@query(sql("SELECT patient_id, birth_date, death_date, gender, race, ethnicity, income FROM r_subject WHERE patient_id IS NOT NULL", "r_subject"))
def curate_subject(r: Roles) -> DataFrame:
    return quarantine.curate_subject(r.raw_subject())[0]


@query(sql("SELECT patient_id, gender, race, ethnicity, birth_date, death_date, income, 'missing_patient_id' AS reject_reason FROM r_subject WHERE patient_id IS NULL", "r_subject"))
def quarantine_subject(r: Roles) -> DataFrame:
    return quarantine.curate_subject(r.raw_subject())[1]


VISIT_REASON = """CASE WHEN encounter_id IS NULL THEN 'missing_encounter_id' WHEN patient_id IS NULL THEN 'missing_patient_id' WHEN start_ts > stop_ts THEN 'bad_time_order_start_gt_stop'
    WHEN base_cost < 0 THEN 'negative_base_cost' WHEN total_cost < 0 THEN 'negative_total_cost' END"""


@query(sql(f"SELECT * FROM (SELECT *, {VISIT_REASON} AS reject_reason FROM r_visit) t WHERE reject_reason IS NOT NULL", "r_visit"))
def quarantine_visit(r: Roles) -> DataFrame:
    return quarantine.curate_visit(r.raw_visit())[1]


@query(sql(f"SELECT *, CAST(date_diff('day', CAST(start_ts AS DATE), CAST(stop_ts AS DATE)) AS BIGINT) AS los_days FROM r_visit WHERE {VISIT_REASON} IS NULL", "r_visit"))
def curate_visit(r: Roles) -> DataFrame:
    return quarantine.curate_visit(r.raw_visit())[0]


def _event_sql(second: str) -> str:
    reason = f"CASE WHEN patient_id IS NULL THEN 'missing_patient_id' WHEN {second} WHEN start_ts > stop_ts THEN 'bad_time_order_start_gt_stop' END"
    return f"SELECT * FROM (SELECT *, {reason} AS reject_reason FROM r_event) t WHERE reject_reason IS NOT NULL"


@query(sql(_event_sql("encounter_id IS NULL THEN 'missing_encounter_id'"), "r_event"))
def quarantine_event(r: Roles) -> DataFrame:
    return quarantine.curate_event(r.raw_event())[1]


@query(sql(_event_sql("code IS NULL AND description IS NULL THEN 'missing_code_and_description'"), "r_event"))
def quarantine_medication(r: Roles) -> DataFrame:
    return quarantine.curate_event(r.raw_event(), need_visit=False)[1]


@query(
    sql(
        """SELECT * FROM (SELECT event_id, patient_id, code, obs_ts, CASE WHEN patient_id IS NULL THEN 'missing_patient_id' WHEN code IS NULL THEN 'missing_code'
        WHEN TRY_CAST(obs_ts AS TIMESTAMP) IS NULL THEN 'bad_date_parse' END AS reject_reason FROM r_finding) t WHERE reject_reason IS NOT NULL""",
        "r_finding",
    )
)
def quarantine_finding(r: Roles) -> DataFrame:
    return quarantine.curate_finding(r.raw_finding())[1].select("event_id", "patient_id", "code", "obs_ts", "reject_reason")


@query(
    sql(
        """SELECT * FROM (SELECT patient_id, encounter_id, l_linenumber, code, description, start_ts AS start_date, stop_ts AS stop_date, CASE WHEN patient_id IS NULL THEN 'missing_patient_id'
        WHEN code IS NULL AND description IS NULL THEN 'missing_code_and_description' WHEN start_ts IS NULL THEN 'missing_date' WHEN start_ts > stop_ts THEN 'bad_time_order_start_gt_stop' END AS reject_reason FROM r_event) t
        WHERE reject_reason IS NOT NULL""",
        "r_event",
    )
)
def quarantine_procedure(r: Roles) -> DataFrame:
    rejects = quarantine.curate_procedure(r.raw_event())[1]
    return rejects.select("patient_id", "encounter_id", "l_linenumber", "code", "description", "start_date", "stop_date", "reject_reason")


@query(sql("SELECT v.* FROM r_visit v WHERE NOT EXISTS (SELECT 1 FROM v_subject_ok s WHERE s.patient_id = v.patient_id)", "r_visit", "v_subject_ok"))
def ri_orphans(r: Roles) -> DataFrame:
    return quarantine.orphans(r.raw_visit(), r.subject_ok(), "patient_id", "patient_id").select(*r.raw_visit().columns)


@query(sql("SELECT e.* FROM r_event e WHERE NOT EXISTS (SELECT 1 FROM c_visit v WHERE v.encounter_id = e.encounter_id)", "r_event", "c_visit"))
def ri_orphans_filtered(r: Roles) -> DataFrame:
    """As :func:`ri_orphans`, by the way that parents beyond a broadcast of their keys take."""
    return references.orphans(r.raw_event(), r.clean_visit(), "encounter_id", "encounter_id", broadcast_keys=0)


@query(
    sql(
        """SELECT a.code, a.description, a.n, b.m FROM (SELECT code, description, count(*) AS n FROM r_event GROUP BY ALL) a
        LEFT JOIN (SELECT code, description, count(*) AS m FROM r_event WHERE l_linenumber = 1 GROUP BY ALL) b ON a.code IS NOT DISTINCT FROM b.code AND a.description IS NOT DISTINCT FROM b.description""",
        "r_event",
    )
)
def null_safe_counts(r: Roles) -> DataFrame:
    """Rows of each code and description and of those on a first line: NULL is a value of its own in both keys."""
    keys = ["code", "description"]
    events = r.raw_event()
    n = events.groupBy(*keys).agg(F.count("*").alias("n"))
    m = events.where("l_linenumber = 1").groupBy(*keys).agg(F.count("*").alias("m")).toDF(*keys, "m")
    return n.join(m, C.null_safe_on(n, m, keys), "left").select(n["code"], n["description"], "n", "m")


RI_EVENT = """SELECT e.*, CASE WHEN s.k IS NULL THEN 'orphan_patient' WHEN v.k IS NULL THEN 'orphan_encounter' END AS reject_reason FROM r_event e
    LEFT JOIN (SELECT DISTINCT patient_id AS k FROM v_subject_ok) s ON e.patient_id = s.k LEFT JOIN (SELECT DISTINCT encounter_id AS k FROM c_visit) v ON e.encounter_id = v.k"""


def _ri_event(r: Roles):
    return quarantine.ri_split(r.raw_event(), [(r.subject_ok(), "patient_id", "patient_id", "orphan_patient"), (r.clean_visit(), "encounter_id", "encounter_id", "orphan_encounter")])


@query(sql(f"SELECT * FROM ({RI_EVENT}) t WHERE reject_reason IS NOT NULL", "r_event", "v_subject_ok", "c_visit"))
def ri_rejects_event(r: Roles) -> DataFrame:
    return _ri_event(r)[1]


@query(sql(f"SELECT * EXCLUDE (reject_reason) FROM ({RI_EVENT}) t WHERE reject_reason IS NULL", "r_event", "v_subject_ok", "c_visit"))
def ri_clean_event(r: Roles) -> DataFrame:
    return _ri_event(r)[0]


@query(
    sql(
        """SELECT 'event' AS table_name, count(*) AS n_dup_groups FROM (SELECT encounter_id, l_linenumber FROM r_event GROUP BY ALL HAVING count(*) > 1) a
        UNION ALL SELECT 'visit', count(*) FROM (SELECT patient_id, start_ts FROM r_visit GROUP BY ALL HAVING count(*) > 1) b
        UNION ALL SELECT 'finding', count(*) FROM (SELECT patient_id, coalesce(code, ''), obs_ts FROM r_finding GROUP BY ALL HAVING count(*) > 1) c""",
        "r_event",
        "r_visit",
        "r_finding",
    )
)
def dup_groups(r: Roles) -> DataFrame:
    col = F.col
    specs = {"event": (r.raw_event(), [col("encounter_id"), col("l_linenumber")]), "visit": (r.raw_visit(), [col("patient_id"), col("start_ts")]), "finding": (r.raw_finding(), [col("patient_id"), F.coalesce("code", F.lit("")), col("obs_ts")])}
    return quarantine.dup_report(specs)


# standard domains


@query(sql("SELECT * FROM dm", "dm"))
def map_dm(r: Roles) -> DataFrame:
    return r.dm()


@query(sql("SELECT * FROM sv", "sv"))
def map_sv(r: Roles) -> DataFrame:
    return r.sv()


def _map_sql(domain: str, term: str, label: str) -> str:
    return sql(f"SELECT 'SYN' AS STUDYID, '{domain}' AS DOMAIN, 'SYN-' || patient_id AS USUBJID, {label} AS {term}, CAST(start_ts AS VARCHAR) AS {domain}STDTC, CAST(stop_ts AS VARCHAR) AS {domain}ENDTC FROM r_event", "r_event")


@query(_map_sql("MH", "MHTERM", "description"))
def map_mh(r: Roles) -> DataFrame:
    return domains.map_mh(r.raw_event())


@query(_map_sql("CM", "CMTRT", "coalesce(description, CAST(code AS VARCHAR))"))
def map_cm(r: Roles) -> DataFrame:
    return domains.map_cm(r.raw_event())


@query(_map_sql("PR", "PRTRT", "coalesce(description, CAST(code AS VARCHAR))"))
def map_pr(r: Roles) -> DataFrame:
    return domains.map_pr(r.raw_event())


@query(sql("SELECT * FROM lb", "lb"))
def map_lb(r: Roles) -> DataFrame:
    return r.lb()


@query(sql("SELECT * FROM vs", "vs"))
def map_vs(r: Roles) -> DataFrame:
    return r.vs()


@query(sql("SELECT 'DM' AS domain, count(*) AS n_rows FROM dm UNION ALL SELECT 'SV', count(*) FROM sv UNION ALL SELECT 'LB', count(*) FROM lb UNION ALL SELECT 'VS', count(*) FROM vs", "dm", "sv", "lb", "vs"))
def domain_counts(r: Roles) -> DataFrame:
    return domains.domain_counts({"DM": r.dm(), "SV": r.sv(), "LB": r.lb(), "VS": r.vs()})


# analysis layer


@query(sql("SELECT * REPLACE (round(LOS_DAYS, 6) AS LOS_DAYS) FROM los", "los"))
def visit_los(r: Roles) -> DataFrame:
    return r.los().withColumn("LOS_DAYS", F.round("LOS_DAYS", 6))


@query(sql("SELECT * REPLACE (round(LOS_DAYS, 6) AS LOS_DAYS) FROM idx", "idx"))
def index_visit(r: Roles) -> DataFrame:
    return visits.index_visit(r.los()).withColumn("LOS_DAYS", F.round("LOS_DAYS", 6))


@query(sql("SELECT * REPLACE (round(AVAL, 6) AS AVAL) FROM adbds", "adbds"))
def adbds_los(r: Roles) -> DataFrame:
    return r.adbds().withColumn("AVAL", F.round("AVAL", 6))


@query(sql("SELECT * FROM dm1", "dm1"))
def dedup_subject(r: Roles) -> DataFrame:
    doubled = r.dm().union(r.dm().where(F.expr("cast(substr(USUBJID, 5) as bigint) % 31 = 0")))
    return domains.dedup_subject(doubled)


@query(sql("SELECT * REPLACE (round(INDEX_LOS_DAYS, 6) AS INDEX_LOS_DAYS) FROM adsl", "adsl"))
def adsl(r: Roles) -> DataFrame:
    return r.adsl().withColumn("INDEX_LOS_DAYS", F.round("INDEX_LOS_DAYS", 6))


@query(
    sql(
        """SELECT (SELECT count(*) FROM adsl) AS n_adsl, count(*) AS n_adbds, (SELECT count(*) FROM (SELECT USUBJID FROM adsl GROUP BY 1 HAVING count(*) > 1) t) AS dup_adsl,
        (SELECT count(*) FROM (SELECT USUBJID FROM adbds GROUP BY 1 HAVING count(*) > 1) t) AS dup_adbds, round(100.0::DOUBLE * count(*) FILTER (WHERE AVAL IS NULL) / count(*), 2) AS los_missing_pct,
        round(100.0::DOUBLE * sum(END_IMPUTEDFL) / count(*), 2) AS end_imputed_pct, round(100.0::DOUBLE * sum(END_MISSING_UNRESOLVEDFL) / count(*), 2) AS end_unresolved_pct FROM adbds""",
        "adsl",
        "adbds",
    )
)
def adam_metrics(r: Roles) -> DataFrame:
    return domains.adam_metrics(r.adsl(), r.adbds())


# windows and reshaping


@query(sql("SELECT USUBJID, SEQ, VISITNUM, VISIT FROM vlong", "vlong"))
def visit_sequence(r: Roles) -> DataFrame:
    return r.long().select("USUBJID", "SEQ", "VISITNUM", "VISIT")


@query(sql("SELECT USUBJID, SEQ, VISITNUM, VISIT, START_TS, END_TS, round(LOS, 6) AS LOS FROM vlong", "vlong"))
def visits_long(r: Roles) -> DataFrame:
    return r.long().withColumn("LOS", F.round("LOS", 6))


#: Nine of ten visits are one subject's: what a window over the subject would put into one task.
HOT_SV = """SELECT 'SYN-' || s AS USUBJID, row_number() OVER (PARTITION BY s ORDER BY start_ts NULLS LAST, encounter_id NULLS LAST) AS VISITNUM, encounter_class AS VISIT, start_ts AS START_TS, stop_ts AS END_TS
    FROM (SELECT *, CASE WHEN patient_id % 10 <> 0 THEN 0 ELSE patient_id END AS s FROM c_visit) h"""


def _hot_sv(r: Roles) -> DataFrame:
    hot = r.clean_visit().withColumn("patient_id", F.when(F.col("patient_id") % 10 != 0, F.lit(0)).otherwise(F.col("patient_id")))
    return domains.map_sv(hot, spread=True)


@query(
    sql(
        f"""SELECT USUBJID, VISITNUM, VISIT, START_TS, END_TS, coalesce(END_TS, n) AS END_IMP, CAST(END_TS IS NULL AS INTEGER) AS END_IMPUTEDFL, CAST(END_TS IS NULL AND n IS NULL AS INTEGER) AS END_MISSING_UNRESOLVEDFL,
        round(CASE WHEN START_TS IS NOT NULL AND coalesce(END_TS, n) IS NOT NULL THEN greatest(0.0::DOUBLE, date_diff('second', START_TS, coalesce(END_TS, n)) / 86400.0::DOUBLE) END, 6) AS LOS_DAYS
        FROM (SELECT *, lead(START_TS) OVER (PARTITION BY USUBJID ORDER BY START_TS NULLS LAST, VISITNUM) AS n FROM ({HOT_SV}) v) t""",
        "c_visit",
    )
)
def visit_los_spread(r: Roles) -> DataFrame:
    return visits.visit_los(_hot_sv(r), spread=True).withColumn("LOS_DAYS", F.round("LOS_DAYS", 6))


@query(sql(f"SELECT USUBJID, row_number() OVER (PARTITION BY USUBJID ORDER BY START_TS NULLS LAST, VISITNUM) AS SEQ, VISITNUM, VISIT FROM ({HOT_SV}) v", "c_visit"))
def visit_sequence_spread(r: Roles) -> DataFrame:
    timed = _hot_sv(r).withColumn("START_TS", F.col("SVSTDTC").try_cast("timestamp_ntz"))
    return visits.sequence(timed, "USUBJID", ["START_TS", "VISITNUM"], None, spread=True).select("USUBJID", "SEQ", "VISITNUM", "VISIT")


def _wide_sql(cols: dict[str, str]) -> str:
    cells = ", ".join(f"max(CASE WHEN SEQ = {k} THEN {c} END) AS {stem}_{k}" for k in range(1, 21) for c, stem in cols.items())
    return sql(f"SELECT USUBJID, {cells} FROM vlong GROUP BY USUBJID", "vlong")


@query(_wide_sql({"VISIT": "VISITID", "START_TS": "START", "END_TS": "ENDE"}))
def visits_wide(r: Roles) -> DataFrame:
    return visits.visits_wide(r.sv())


def store(r: Roles, df: DataFrame) -> DataFrame:
    return S.write_layer(df, f"lamina_layer_{uuid.uuid4().hex}", "USUBJID", scratch_path(r.spark, "layer"), 8)


@query(_wide_sql({"VISIT": "VISITID", "START_TS": "START", "END_TS": "ENDE"}))
def visits_wide_stored(r: Roles) -> DataFrame:
    """As :func:`visits_wide`, over visits that are stored by subject."""
    return visits.visits_wide(store(r, r.sv()))


@query(_wide_sql({"round(LOS, 6)": "VISITID", "START_TS": "START", "END_TS": "ENDE"}))
def visits_wide_los(r: Roles) -> DataFrame:
    return visits.visits_wide_los(r.sv())


@query(_wide_sql({"round(LOS, 6)": "LOS", "VISIT": "CAT"}))
def visit_categories(r: Roles) -> DataFrame:
    return visits.visits_wide_cat(r.sv())


@query(sql("SELECT USUBJID, SEQ, round(LOS, 6) AS LOS, VISIT AS CAT FROM vlong WHERE LOS IS NOT NULL OR VISIT IS NOT NULL", "vlong"))
def visits_melt(r: Roles) -> DataFrame:
    return visits.unpivot_sequence(visits.visits_wide_cat(r.sv()), "USUBJID", ["LOS", "CAT"])

