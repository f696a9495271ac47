"""Reading, writing and logging of layer tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fixity import source_digest

#: Buckets of stored layers: the same for all, so that their tables fit each other. Each is read by one task.
BUCKETS = 64
LOG = "run_id string, table_name string, stg_table string, source_file string, source_sha256 string, ingested_at timestamp, row_count bigint, status string, message string"


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header. Without a schema, types are inferred over all rows, at the cost of a second pass."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def write_table(df: DataFrame, name: str, mode: str = "overwrite") -> DataFrame:
    """Replace (or append to) a managed table and return it."""
    df.write.mode(mode).saveAsTable(name)
    return df.sparkSession.table(name)


def write_layer(df: DataFrame, name: str, key: str, path: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Store a layer table in ``buckets`` buckets of ``key``, each one sorted file, and return it.

    Tables of one number of buckets need no exchange on the key any more: windows, pivots and joins of a subject's rows read
    bucket by bucket. With ``path`` the files lie there (what was there goes), else in the warehouse; without the key as a column the table is plain.
    """
    spark = df.sparkSession
    if path:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    writer = df.write
    if key in df.columns:
        writer = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
    writer = writer.mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return spark.table(name)


def with_lineage(df: DataFrame, run_id: str, ingested_at: str | None = None) -> DataFrame:
    """Add ``_run_id``, ``_ingested_at`` and the source file's name; the frame must be a file scan."""
    at = F.lit(ingested_at).cast("timestamp") if ingested_at else F.current_timestamp()
    return df.select("*", F.lit(run_id).alias("_run_id"), at.alias("_ingested_at"), F.col("_metadata.file_name").alias("_source_file"))


def load_tables(spark: SparkSession, sources: Mapping[str, str], tables: Sequence[str], run_id: str = "", log_path: str | None = None) -> DataFrame:
    """A log row per wanted table: OK with its row count, SKIP without a source, ERROR if it can't be read.

    CSV sources have a header; others are Parquet. Rows carry the source's SHA-256, the name of the staged
    table and the time; with ``log_path`` they are appended to the log there. A source that can be read but not
    digested is OK with a null digest and a message.
    """
    rows, at = [], datetime.now(UTC)
    for name in tables:
        path = sources.get(name)
        if path is None:
            rows.append((run_id, name, f"stg_{name}", None, None, at, None, "SKIP", "source missing"))
            continue
        file, digest, count, status, message = path.rstrip("/").rsplit("/", 1)[-1], None, None, "OK", None
        try:
            scan = spark.read.option("header", True).csv(path) if path.lower().endswith(".csv") else spark.read.parquet(path)
            # a lost file shows when rows are counted, so the count is part of the try
            count = scan.count()
        except Exception as e:  # noqa: BLE001  the log row carries the failure
            status, message = "ERROR", type(e).__name__
        else:
            try:
                digest = source_digest(spark, path)
            except Exception as e:  # noqa: BLE001  as above
                message = f"no digest: {type(e).__name__}"
        rows.append((run_id, name, f"stg_{name}", file, digest, at, count, status, message))
    out = spark.createDataFrame(rows, LOG)
    if log_path:
        out.write.mode("append").parquet(log_path)
    return out


def upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``target`` whose key isn't updated, and all updates. NULL keys never match."""
    return target.join(updates.select(*keys).distinct(), list(keys), "left_anti").unionByName(updates)


def metrics_long(df: DataFrame, run_id: str, step: str) -> DataFrame:
    """One-row metric frame as records (run_id, step, metric, value), ready to append."""
    values = df.select(*[F.col(c).cast("double").alias(c) for c in df.columns])
    return values.unpivot([], values.columns, "metric", "value").select(F.lit(run_id).alias("run_id"), F.lit(step).alias("step"), "metric", "value")


def write_metrics(df: DataFrame, run_id: str, step: str, path: str) -> None:
    metrics_long(df, run_id, step).write.mode("append").parquet(path)


def layer_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows) of each frame, in one job."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no tables")
    return out


def contract_check(spark: SparkSession, present: Mapping[str, DataFrame], required: Sequence[str]) -> DataFrame:
    """(table_name, present, n_rows, status) of the required tables; those that are there are counted, so a table that can't be read fails here."""
    wanted = spark.createDataFrame([(name,) for name in required], "table_name string")
    have = {n: present[n] for n in required if n in present}
    counts = layer_counts(have) if have else spark.createDataFrame([], "table_name string, n_rows bigint")
    there = F.col("n_rows").isNotNull()
    return wanted.join(counts, "table_name", "left").select("table_name", there.cast("int").alias("present"), "n_rows", F.when(there, "PASS").otherwise("FAIL").alias("status"))


def sf_tables(spark: SparkSession, sf_dir: str) -> list[str]:
    """Names of the Parquet tables under a folder, listed by Spark's own file system."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(sf_dir)
    listed = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return sorted(s.getPath().getName().removesuffix(".parquet") for s in listed if s.getPath().getName().endswith(".parquet"))
