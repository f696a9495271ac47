"""Stored tables that are updated by key: only touched buckets are rewritten, and a commit swaps them all at once.

A table is a folder. ``data/<write>/bucket=<k>`` holds Parquet files that are never changed, ``commits/<version>.json`` names the
folder of every bucket. Readers take the highest commit, so a writer that dies before its commit leaves the old table, and
one that dies after it the new one; what it left behind is removed by :func:`vacuum`.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import cut
from .tables import upsert

BUCKETS = 64


class ConflictError(RuntimeError):
    """Another writer committed first: read again and repeat."""


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, at = _hadoop(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    """Committed versions, oldest first."""
    return sorted(int(n.removesuffix(".json")) for n in _names(spark, f"{path}/commits") if n.endswith(".json"))


def _commit_of(spark: SparkSession, path: str, version: int | None = None) -> dict:
    there = versions(spark, path)
    if not there or version is not None and version not in there:
        raise ValueError(f"no committed version at {path}" if version is None else f"{path} has no version {version}")
    at = f"{path}/commits/{version or there[-1]:020d}.json"
    return json.loads("".join(r[0] for r in spark.read.text(at, wholetext=True).collect()))


def _commit(spark: SparkSession, path: str, found: dict) -> int:
    """Make ``found`` the current table: a file that is complete before it gets its name, which only one writer can give."""
    fs, at = _hadoop(spark, f"{path}/commits/{found['version']:020d}.json")
    _, draft = _hadoop(spark, f"{path}/commits/{uuid.uuid4().hex}.draft")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(found).encode()))
    out.close()
    if fs.exists(at) or not fs.rename(draft, at):
        fs.delete(draft, False)
        raise ConflictError(f"version {found['version']} of {path} is there already")
    return found["version"]


def _bucket(df: DataFrame, keys: Sequence[str], buckets: int) -> Column:
    """A row's bucket, by its key; rows with a NULL key match nothing and are spread by all their columns."""
    null = reduce(lambda a, b: a | b, [F.col(f"`{k}`").isNull() for k in keys])
    by = lambda names: F.xxhash64(*[F.col(f"`{c}`") for c in names])
    return F.pmod(F.when(null, by(df.columns)).otherwise(by(keys)), F.lit(buckets)).cast("int")


def _write(df: DataFrame, path: str, keys: Sequence[str], buckets: int) -> dict[str, str]:
    """Write rows to new folders by bucket: bucket to folder, below ``path``. A bucket may be several files, so a large one isn't one task."""
    write = f"data/{uuid.uuid4().hex}"
    df.withColumn("bucket", _bucket(df, keys, buckets)).hint("rebalance", F.col("bucket")).write.partitionBy("bucket").parquet(f"{path}/{write}")
    return {n.removeprefix("bucket="): f"{write}/{n}" for n in _names(df.sparkSession, f"{path}/{write}") if n.startswith("bucket=")}


def create(df: DataFrame, path: str, keys: Sequence[str], buckets: int = BUCKETS) -> int:
    """Store ``df`` as version 1 of a new table; ConflictError if one is there."""
    if "bucket" in (c.lower() for c in df.columns):
        raise ValueError("a column named bucket would clash with the layout")
    if versions(df.sparkSession, path):
        raise ConflictError(f"{path} is there already")
    folders = _write(df, path, keys, buckets)
    return _commit(df.sparkSession, path, {"version": 1, "keys": list(keys), "buckets": buckets, "schema": df.schema.jsonValue(), "folders": folders})


def _scan(spark: SparkSession, path: str, found: dict, buckets: Sequence[str] | None = None) -> DataFrame:
    schema = T.StructType.fromJson(found["schema"])
    folders = [f"{path}/{folder}" for b, folder in found["folders"].items() if buckets is None or b in buckets]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as of its last commit, or of ``version`` as long as :func:`vacuum` left that."""
    return _scan(spark, path, _commit_of(spark, path, version))


def merge(updates: DataFrame, path: str) -> int:
    """Replace rows by key and add new ones; the version that is current afterwards.

    Updates are brought to the table's columns and types. Their keys should be unique: all rows of a repeated key are kept.
    NULL keys match nothing, so such rows are added. Buckets without an update aren't read; no updates make no version.
    """
    spark = updates.sparkSession
    found = _commit_of(spark, path)
    schema, keys = T.StructType.fromJson(found["schema"]), found["keys"]
    rows = updates.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])
    held = cut(rows.withColumn("bucket", _bucket(rows, keys, found["buckets"])))
    touched = {str(r[0]) for r in held.select("bucket").distinct().collect()}
    if not touched:
        return found["version"]
    merged = upsert(_scan(spark, path, found, touched), held.drop("bucket"), keys).select(*schema.names)
    folders = found["folders"] | _write(merged, path, keys, found["buckets"])
    return _commit(spark, path, found | {"version": found["version"] + 1, "folders": folders})


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Remove what only commits before the last ``keep`` name, and what no commit names; the number of folders removed.

    Not while others write: an uncommitted write looks like one that was given up.
    """
    there = versions(spark, path)
    used = {folder for v in there[-keep:] for folder in _commit_of(spark, path, v)["folders"].values()}
    fs, _ = _hadoop(spark, path)
    for v in there[:-keep]:
        fs.delete(_hadoop(spark, f"{path}/commits/{v:020d}.json")[1], False)
    gone = 0
    for write in _names(spark, f"{path}/data"):
        for bucket in _names(spark, f"{path}/data/{write}"):
            if bucket.startswith("bucket=") and f"data/{write}/{bucket}" not in used:
                fs.delete(_hadoop(spark, f"{path}/data/{write}/{bucket}")[1], True)
                gone += 1
        if not any(n.startswith("bucket=") for n in _names(spark, f"{path}/data/{write}")):
            fs.delete(_hadoop(spark, f"{path}/data/{write}")[1], True)
    return gone


def record_run(spark: SparkSession, path: str, run_id: str, started_at: str, source: str) -> int:
    """Insert or replace the run in a run registry, made where there is none yet."""
    row = spark.createDataFrame([(run_id, started_at, source)], "run_id string, started_at string, source string").withColumn("started_at", F.col("started_at").cast("timestamp"))
    return merge(row, path) if versions(spark, path) else create(row, path, ["run_id"], 8)
