"""Checksums of files of any size: manifests and their verification.

Files are listed without reading them and hashed by tasks, in chunks: no task holds a file. What workers can open
themselves (``file:``, and what Arrow's file systems reach) is streamed there. In a store that only Spark opens, files up to
``WHOLE`` bytes are hashed as Spark's ``binaryFile`` rows, and the rest, which such a row can't hold, one after the other
through the driver's Hadoop stream, whose memory is one buffer.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import cut

# functions that run on executors travel with the job: workers need not have this package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes read at a time.
CHUNK = 8 << 20
#: Files that a ``binaryFile`` row may hold: below Spark's limit of 2 GB, and small beside an executor's memory.
WHOLE = 256 << 20
#: Lines of a folder's manifest that are put together for one digest, about.
LINES = 1_000


def _stream(path: str):
    """A binary stream of a file that a worker can open without Spark."""
    if path.startswith("file:"):
        return open(re.sub("^file:/*", "/", path), "rb")  # noqa: SIM115
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    return store.open_input_stream(at)


def _hash(paths: Iterator[pd.DataFrame], chunk: int = CHUNK) -> Iterator[pd.DataFrame]:
    """SHA-256 of each path, null where the worker can't open it."""
    for batch in paths:
        found = []
        for path in batch["path"]:
            digest = hashlib.sha256()
            try:
                stream = _stream(path)
            except (OSError, ValueError, NotImplementedError, ImportError):
                found.append(None)
                continue
            with stream:
                while piece := stream.read(chunk):
                    digest.update(piece)
            found.append(digest.hexdigest())
        yield batch.assign(sha256=found)


def _through_driver(spark: SparkSession, path: str) -> str:
    """SHA-256 by one Hadoop stream of the driver."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    digest = jvm.java.security.MessageDigest.getInstance("SHA-256")
    sink = jvm.java.security.DigestOutputStream(jvm.java.io.OutputStream.nullOutputStream(), digest)
    jvm.org.apache.hadoop.io.IOUtils.copyBytes(at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at), sink, CHUNK, True)
    return bytes(b & 255 for b in digest.digest()).hex()


def _below(spark: SparkSession, path: str) -> Column:
    """The path below the root folder; the scheme and authority are spelled in more than one way, so paths are compared from there on."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri().getPath()
    plain = F.regexp_replace("path", r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?", "")
    return F.when(F.startswith(plain, F.lit(f"{root}/")), F.substr(plain, F.lit(len(root) + 2))).otherwise(F.regexp_replace(plain, r"^.*/", ""))


def _scheme(spark: SparkSession, path: str) -> str:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri().getScheme()


def fixity_manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, file, size, sha256) of every file below ``path`` whose name matches; ``file`` is its path below that root.

    Spark lists no empty files, so they have no row; a folder without files gives none, a path that isn't there is an error.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    listed = files.select("path", F.col("length").cast("bigint").alias("size"))
    named = lambda df: df.select("path", _below(spark, path).alias("file"), "size", "sha256")
    if _scheme(spark, path) == "file":
        return named(listed.mapInPandas(_hash, "path string, size bigint, sha256 string"))
    small = files.where(F.col("length") <= WHOLE).select("path", F.col("length").cast("bigint").alias("size"), F.sha2("content", 256).alias("sha256"))
    large = listed.where(F.col("size") > WHOLE)
    if large.isEmpty():
        return named(small)
    large = cut(large.mapInPandas(_hash, "path string, size bigint, sha256 string"))
    rest = [(r["path"], r["size"], _through_driver(spark, r["path"])) for r in large.where("sha256 IS NULL").toLocalIterator()]
    parts = [small, large.where("sha256 IS NOT NULL"), *([spark.createDataFrame(rest, "path string, size bigint, sha256 string")] if rest else [])]
    return named(reduce(DataFrame.unionByName, parts))


def folder_digest(manifest: DataFrame) -> str | None:
    """One digest of all ``file`` and ``sha256`` of a manifest, in any order of its rows.

    Lines are put into groups by the first digits of their names' digests; a group's digest is that of its sorted lines, and groups
    are put together the same way, digit by digit, so no task and no row has the whole list. No files: null.
    """
    name = F.sha2(F.col("file").cast("binary"), 256)
    lines = cut(manifest.select(name.alias("at"), F.concat_ws("  ", "sha256", "file").alias("line")))
    n = lines.count()
    if not n:
        return None
    digits = 0
    while n > LINES * 16**digits:
        digits += 1
    while True:
        group = F.substring("at", 1, digits).alias("at")
        lines = lines.groupBy(group).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("line")), "\n").cast("binary"), 256).alias("line"))
        if not digits:
            return lines.first()["line"]
        lines, digits = cut(lines.select("at", F.concat_ws("  ", "line", "at").alias("line"))), max(0, digits - 2)


def source_digest(spark: SparkSession, path: str) -> str | None:
    """SHA-256 of a source: of the file itself, or :func:`folder_digest` of a folder; one of no files has none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    alone = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile()
    manifest = fixity_manifest(spark, path)
    return manifest.first()["sha256"] if alone else folder_digest(manifest)


def fixity_verify(manifest: DataFrame, current: DataFrame) -> DataFrame:
    """Status of each manifest row against recomputed checksums, by the path below the root: ok, mismatch or missing."""
    now = current.select("file", F.col("sha256").alias("now_sha256"), F.col("size").alias("now_size"))
    status = F.when(F.col("now_sha256").isNull(), "missing").when((F.col("now_sha256") == F.col("sha256")) & (F.col("now_size") == F.col("size")), "ok").otherwise("mismatch")
    return manifest.join(now, "file", "left").select("file", "size", "sha256", status.alias("status"))


def verify_summary(verified: DataFrame) -> DataFrame:
    return verified.agg(F.count("*").alias("checked"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "missing").alias("missing"), F.count_if(F.col("status") == "mismatch").alias("mismatch"))
