"""Role views over the test tables, as frames and as SQL, with the same injected faults in both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import domains, quarantine, visits
from ..sources.tables import read_table

#: Event types of the test tables that stand for vital signs.
VITALS = ("click", "view")


class Roles:
    """Lazy role views of one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.dir, name)

    def subject(self) -> DataFrame:
        c = self.table("customer").join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
        key = F.col("c_custkey")
        return c.select(
            key.alias("patient_id"),
            F.when(key % 3 == 0, "M").when(key % 3 == 1, "F").otherwise("other").alias("gender"),
            F.col("c_mktsegment").alias("race"),
            F.when(F.col("c_nationkey") != 0, F.col("n_name")).alias("ethnicity"),
            F.date_add(F.lit("1940-01-01").cast("date"), (key * 13 % 20000).cast("int")).alias("birth_date"),
            F.lit(None).cast("date").alias("death_date"),
            F.col("c_acctbal").alias("income"),
        )

    def subject_ok(self) -> DataFrame:
        return self.subject().where("income >= 0")

    def raw_subject(self) -> DataFrame:
        return self.subject().withColumn("patient_id", F.when(F.col("patient_id") % 97 != 0, F.col("patient_id")))

    def visit(self) -> DataFrame:
        ends = self.table("lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("stop_ts"))
        o = self.table("orders").join(ends, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        price = F.col("o_totalprice")
        return o.select(F.col("o_orderkey").alias("encounter_id"), F.col("o_custkey").alias("patient_id"), F.col("o_orderdate").alias("start_ts"), "stop_ts", F.col("o_orderpriority").alias("encounter_class"), price.alias("base_cost"), price.alias("total_cost"))

    def raw_visit(self) -> DataFrame:
        v, key = self.visit(), F.col("encounter_id")
        v = v.withColumn("base_cost", F.when(key % 29 == 0, -F.col("base_cost")).otherwise(F.col("base_cost")))
        v = v.withColumn("patient_id", F.when(key % 97 != 0, F.col("patient_id")))
        return v.withColumn("encounter_id", F.when(key % 101 != 0, key))

    def event(self) -> DataFrame:
        joined = self.table("lineitem").join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left").join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"), "left")
        return joined.select(F.col("o_custkey").alias("patient_id"), F.col("l_orderkey").alias("encounter_id"), "l_linenumber", F.col("l_partkey").alias("code"), F.when(F.col("l_partkey") % 11 != 0, F.col("p_name")).alias("description"), F.col("o_orderdate").alias("start_ts"), F.col("l_shipdate").alias("stop_ts"))

    def raw_event(self) -> DataFrame:
        e, key = self.event(), F.col("encounter_id")
        e = e.withColumns({"patient_id": F.when(key % 97 != 0, F.col("patient_id")), "code": F.when(F.col("code") % 22 != 0, F.col("code"))})
        return e.withColumn("encounter_id", F.when(key % 89 != 0, key))

    def finding(self) -> DataFrame:
        e = self.table("events")
        return e.select("event_id", F.col("user_id").alias("patient_id"), F.col("event_type").alias("code"), F.col("props").alias("description"), F.col("value").cast("string").alias("value"), F.lit(None).cast("string").alias("units"), F.col("ts").alias("obs_ts"), F.col("value").alias("number"))

    def raw_finding(self) -> DataFrame:
        f, key = self.finding(), F.col("event_id")
        return f.withColumns(
            {
                "patient_id": F.when(key % 97 != 0, F.col("patient_id")),
                "code": F.when(key % 13 == 0, "  ").when(key % 13 == 1, "unk").when(key % 13 != 2, F.col("code")),
                "value": F.when(key % 17 == 0, "n/a").when(key % 17 == 1, "5d").otherwise(F.round("number", 2).cast("decimal(12,2)").cast("string")),
                "obs_ts": F.when(key % 23 == 0, "bad").otherwise(F.col("obs_ts").cast("string")),
                "number": F.when(key % 19 == 0, F.lit(float("inf"))).when(key % 19 == 1, F.lit(float("nan"))).otherwise(F.col("number")),
            }
        )

    def clean_visit(self) -> DataFrame:
        return quarantine.curate_visit(self.visit())[0]

    def dm(self) -> DataFrame:
        return domains.map_dm(self.subject())

    def sv(self) -> DataFrame:
        return domains.map_sv(self.clean_visit())

    def los(self) -> DataFrame:
        return visits.visit_los(self.sv())

    def adbds(self) -> DataFrame:
        return domains.adbds_los(visits.index_visit(self.los()))

    def adsl(self) -> DataFrame:
        return domains.adsl(self.dm(), visits.index_visit(self.los()))

    def long(self) -> DataFrame:
        return visits.visits_long(self.sv())

    def numbered_finding(self) -> DataFrame:
        """Findings with a two-place number as text, so that both engines print and read the same."""
        return self.finding().withColumn("value", F.round("number", 2).cast("decimal(12,2)").cast("string"))

    def lb(self) -> DataFrame:
        return domains.map_lb(self.numbered_finding(), VITALS)

    def vs(self) -> DataFrame:
        return domains.map_vs(self.numbered_finding(), VITALS)


#: Named parts of WITH clauses: the parts each needs, and its SELECT.
PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "v_subject": (
        (),
        """SELECT c_custkey AS patient_id, CASE WHEN c_custkey % 3 = 0 THEN 'M' WHEN c_custkey % 3 = 1 THEN 'F' ELSE 'other' END AS gender,
        c_mktsegment AS race, CASE WHEN c_nationkey <> 0 THEN n_name END AS ethnicity,
        CAST(DATE '1940-01-01' + CAST(c_custkey * 13 % 20000 AS INTEGER) AS DATE) AS birth_date, CAST(NULL AS DATE) AS death_date, c_acctbal AS income
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
    ),
    "v_subject_ok": (("v_subject",), "SELECT * FROM v_subject WHERE income >= 0"),
    "r_subject": (("v_subject",), "SELECT * REPLACE (CASE WHEN patient_id % 97 <> 0 THEN patient_id END AS patient_id) FROM v_subject"),
    "v_visit": (
        (),
        """SELECT o_orderkey AS encounter_id, o_custkey AS patient_id, o_orderdate AS start_ts, stop_ts, o_orderpriority AS encounter_class,
        o_totalprice AS base_cost, o_totalprice AS total_cost FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS stop_ts FROM lineitem GROUP BY l_orderkey) e ON o_orderkey = l_orderkey""",
    ),
    "r_visit": (
        ("v_visit",),
        """SELECT * REPLACE (CASE WHEN encounter_id % 29 = 0 THEN -base_cost ELSE base_cost END AS base_cost,
        CASE WHEN encounter_id % 97 <> 0 THEN patient_id END AS patient_id, CASE WHEN encounter_id % 101 <> 0 THEN encounter_id END AS encounter_id) FROM v_visit""",
    ),
    "v_event": (
        (),
        """SELECT o_custkey AS patient_id, l_orderkey AS encounter_id, l_linenumber, l_partkey AS code, CASE WHEN l_partkey % 11 <> 0 THEN p_name END AS description,
        o_orderdate AS start_ts, l_shipdate AS stop_ts FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey""",
    ),
    "r_event": (
        ("v_event",),
        """SELECT * REPLACE (CASE WHEN encounter_id % 97 <> 0 THEN patient_id END AS patient_id, CASE WHEN code % 22 <> 0 THEN code END AS code,
        CASE WHEN encounter_id % 89 <> 0 THEN encounter_id END AS encounter_id) FROM v_event""",
    ),
    "v_finding": (
        (),
        """SELECT event_id, user_id AS patient_id, event_type AS code, props AS description, CAST(CAST(round(value, 2) AS DECIMAL(12,2)) AS VARCHAR) AS value,
        CAST(NULL AS VARCHAR) AS units, ts AS obs_ts, value AS number FROM events""",
    ),
    "r_finding": (
        ("v_finding",),
        """SELECT * REPLACE (CASE WHEN event_id % 97 <> 0 THEN patient_id END AS patient_id,
        CASE WHEN event_id % 13 = 0 THEN '  ' WHEN event_id % 13 = 1 THEN 'unk' WHEN event_id % 13 <> 2 THEN code END AS code,
        CASE WHEN event_id % 17 = 0 THEN 'n/a' WHEN event_id % 17 = 1 THEN '5d' ELSE value END AS value,
        CASE WHEN event_id % 23 = 0 THEN 'bad' ELSE CAST(obs_ts AS VARCHAR) END AS obs_ts,
        CASE WHEN event_id % 19 = 0 THEN CAST('inf' AS DOUBLE) WHEN event_id % 19 = 1 THEN CAST('nan' AS DOUBLE) ELSE number END AS number) FROM v_finding""",
    ),
    "c_visit": (
        ("v_visit",),
        """SELECT *, CAST(date_diff('day', CAST(start_ts AS DATE), CAST(stop_ts AS DATE)) AS BIGINT) AS los_days FROM v_visit WHERE encounter_id IS NOT NULL AND patient_id IS NOT NULL
        AND coalesce(start_ts <= stop_ts, TRUE) AND coalesce(base_cost >= 0, TRUE) AND coalesce(total_cost >= 0, TRUE)""",
    ),
    "dm": (
        ("v_subject",),
        """SELECT 'SYN' AS STUDYID, 'DM' AS DOMAIN, 'SYN-' || patient_id AS USUBJID, CASE upper(trim(gender)) WHEN 'M' THEN 'M' WHEN 'F' THEN 'F' ELSE 'U' END AS SEX,
        CAST(birth_date AS VARCHAR) AS BRTHDTC, CAST(death_date AS VARCHAR) AS DTHDTC, race AS RACE, ethnicity AS ETHNIC FROM v_subject""",
    ),
    "sv": (
        ("c_visit",),
        """SELECT 'SYN' AS STUDYID, 'SV' AS DOMAIN, 'SYN-' || patient_id AS USUBJID, row_number() OVER (PARTITION BY patient_id ORDER BY start_ts NULLS LAST, encounter_id NULLS LAST) AS VISITNUM,
        encounter_class AS VISIT, CAST(start_ts AS VARCHAR) AS SVSTDTC, CAST(stop_ts AS VARCHAR) AS SVENDTC FROM c_visit""",
    ),
    "timed": (
        ("sv",),
        """SELECT USUBJID, VISITNUM, VISIT, TRY_CAST(SVSTDTC AS TIMESTAMP) AS START_TS, TRY_CAST(SVENDTC AS TIMESTAMP) AS END_TS FROM sv""",
    ),
    "los": (
        ("timed",),
        """SELECT USUBJID, VISITNUM, VISIT, START_TS, END_TS, coalesce(END_TS, NEXT_START) AS END_IMP, CAST(END_TS IS NULL AS INTEGER) AS END_IMPUTEDFL,
        CAST(END_TS IS NULL AND NEXT_START IS NULL AS INTEGER) AS END_MISSING_UNRESOLVEDFL,
        CASE WHEN START_TS IS NOT NULL AND coalesce(END_TS, NEXT_START) IS NOT NULL THEN greatest(0.0::DOUBLE, date_diff('second', START_TS, coalesce(END_TS, NEXT_START)) / 86400.0::DOUBLE) END AS LOS_DAYS
        FROM (SELECT *, lead(START_TS) OVER (PARTITION BY USUBJID ORDER BY START_TS NULLS LAST, VISITNUM) AS NEXT_START FROM timed) t""",
    ),
    "idx": (("los",), "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY USUBJID ORDER BY START_TS NULLS LAST, VISITNUM) AS rn FROM los) t WHERE rn = 1"),
    "adbds": (
        ("idx",),
        """SELECT 'SYN' AS STUDYID, USUBJID, 'LOS' AS PARAMCD, 'Length of stay (days)' AS PARAM, LOS_DAYS AS AVAL, CAST(START_TS AS DATE) AS ADT, START_TS AS ADTM,
        strftime(START_TS, '%Y-%m-%dT%H:%M:%S') AS STARTDTC, strftime(END_TS, '%Y-%m-%dT%H:%M:%S') AS ENDDTC, strftime(END_IMP, '%Y-%m-%dT%H:%M:%S') AS ENDDTC_IMP,
        END_IMPUTEDFL, END_MISSING_UNRESOLVEDFL, VISITNUM, VISIT FROM idx""",
    ),
    "dm1": (("dm",), "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY USUBJID ORDER BY BRTHDTC NULLS LAST, SEX NULLS LAST, RACE NULLS LAST, ETHNIC NULLS LAST) AS rn FROM dm) t WHERE rn = 1"),
    "adsl": (
        ("dm1", "idx"),
        """SELECT STUDYID, d.USUBJID AS USUBJID, d.USUBJID AS SUBJID, SEX, BRTHDTC, DTHDTC, RACE, ETHNIC, VISITNUM AS INDEX_VISITNUM, VISIT AS INDEX_VISIT, LOS_DAYS AS INDEX_LOS_DAYS,
        END_IMPUTEDFL AS INDEX_END_IMPUTEDFL, END_MISSING_UNRESOLVEDFL AS INDEX_END_MISSING_UNRESOLVEDFL,
        CAST(floor(date_diff('second', TRY_CAST(BRTHDTC AS TIMESTAMP), START_TS) / (365.25::DOUBLE * 86400)) AS BIGINT) AS AGE FROM dm1 d LEFT JOIN idx i ON d.USUBJID = i.USUBJID""",
    ),
    "vlong": (
        ("timed",),
        """SELECT USUBJID, SEQ, VISITNUM, VISIT, START_TS, END_TS, CASE WHEN START_TS IS NOT NULL AND END_TS IS NOT NULL THEN greatest(0.0::DOUBLE, (epoch_us(END_TS) - epoch_us(START_TS)) / 6e7::DOUBLE) END AS LOS
        FROM (SELECT *, row_number() OVER (PARTITION BY USUBJID ORDER BY START_TS NULLS LAST, VISITNUM) AS SEQ FROM timed) t WHERE SEQ <= 20""",
    ),
    "stays": (("vlong",), "SELECT *, max(SEQ) OVER (PARTITION BY USUBJID) AS last_seq FROM vlong WHERE LOS IS NOT NULL"),
    "hist": (("stays",), "SELECT * FROM stays WHERE SEQ < last_seq"),
    "findings": (
        ("v_finding",),
        """SELECT 'SYN' AS STUDYID, CASE WHEN code IN ('click', 'view') THEN 'VS' ELSE 'LB' END AS DOMAIN, 'SYN-' || patient_id AS USUBJID, code AS TESTCD, description AS TEST, CAST(obs_ts AS VARCHAR) AS DTC,
        value AS ORRES, units AS ORRESU, TRY_CAST(value AS DOUBLE) AS STRESN, units AS STRESU FROM v_finding WHERE code IS NOT NULL""",
    ),
    "lb": (("findings",), "SELECT STUDYID, DOMAIN, USUBJID, TESTCD AS LBTESTCD, TEST AS LBTEST, DTC AS LBDTC, ORRES AS LBORRES, ORRESU AS LBORRESU, STRESN AS LBSTRESN, STRESU AS LBSTRESU FROM findings WHERE DOMAIN = 'LB'"),
    "vs": (("findings",), "SELECT STUDYID, DOMAIN, USUBJID, TESTCD AS VSTESTCD, TEST AS VSTEST, DTC AS VSDTC, ORRES AS VSORRES, ORRESU AS VSORRESU, STRESN AS VSSTRESN, STRESU AS VSSTRESU FROM findings WHERE DOMAIN = 'VS'"),
    "target": (("stays",), "SELECT USUBJID, SEQ AS LAST_SEQ, round(LOS, 6) AS LOS_LAST, VISIT AS LAST_CAT FROM stays WHERE SEQ = last_seq"),
    "demo": (("adsl",), "SELECT USUBJID, CAST(AGE AS DOUBLE) AS AGE, coalesce(SEX, 'UNKNOWN') AS SEX, coalesce(RACE, 'UNKNOWN') AS RACE FROM adsl"),
}


def sql(select: str, *need: str) -> str:
    """``select`` under a WITH clause of the parts it needs, each after those it rests on."""
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for below in PARTS[name][0]:
                add(below)
            order.append(name)

    for name in need:
        add(name)
    return (f"WITH {', '.join(f'{n} AS ({PARTS[n][1]})' for n in order)} " if order else "") + select
