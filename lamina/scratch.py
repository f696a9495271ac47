"""Cut lineage with tables in the cluster's shared checkpoint folder, and clear them away at the end."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Arrow batches hold at most so many rows and about so many bytes, whole texts included.
BATCH_ROWS, BATCH_BYTES = 400, 8 << 20
_runs: dict[str, tuple[str, object, object]] = {}
_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only for plain local masters that have none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="spark-lamina-"))
    return f"file://{_local[0]}"


def _delete(jvm, conf, path: str) -> None:
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(conf).delete(at, True)


def run_dir(spark: SparkSession) -> str:
    """This application's folder below :func:`shared_dir`, removed by :func:`clear` or when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _runs:
        if not _runs:
            atexit.register(clear)
        _runs[app] = (f"{shared_dir(spark)}/lamina-{app}-{uuid.uuid4().hex}", spark._jvm, spark.sparkContext._jsc.hadoopConfiguration())
    return _runs[app][0]


def clear() -> None:
    """Remove the scratch tables of all applications of this driver; frames that read them can't be used afterwards."""
    while _runs:
        path, jvm, conf = _runs.popitem()[1]
        try:
            _delete(jvm, conf, path)
        except Exception:  # noqa: BLE001,S110  a driver that is ending may have lost its file system: the folder then stays
            pass


def fresh_path(spark: SparkSession, name: str = "table") -> str:
    """An unused path in the run's folder."""
    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of what was written.

    Later jobs reread the table, so a lost executor costs no recomputation, and
    a column that was computed by Python is not computed again.
    """
    path = fresh_path(df.sparkSession)
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found._scratch = path
    return found


def drop(df: DataFrame) -> None:
    """Delete the table that :func:`cut` wrote for ``df``, which nothing may read any more."""
    path = df.__dict__.get("_scratch")
    if path:
        _delete(df.sparkSession._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration(), path)


def small_batches(spark: SparkSession) -> None:
    """Bound the rows and bytes of Arrow batches, so that whole texts of a batch fit a Python worker.

    Lazy plans read the session's setting when they run, so it is only ever lowered.
    """
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key).lower().rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))
