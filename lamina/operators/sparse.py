"""Marts of any width: a dictionary of codes and a sparse vector for each subject, which models read as it is."""

from __future__ import annotations

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import cut, fresh_path
from .references import BROADCAST_KEYS
from .spread import along


def code_dictionary(cells: DataFrame, code: str = "code") -> DataFrame:
    """(code, index): the codes of a long mart numbered from 0 in their order, in ranges over the tasks. NULL is no code."""
    codes = cells.where(F.col(code).isNotNull()).select(F.col(code).alias("code")).distinct().withColumn("_all", F.lit(0))
    return cut(along(codes, "_all", ["code"], "_at").select("code", (F.col("_at") - 1).cast("int").alias("index")))


def sparse_features(cells: DataFrame, dictionary: DataFrame, value: str = "mean", code: str = "code", subject: str = "USUBJID") -> DataFrame:
    """(subject, size, indices, values): each subject's values at the places of their codes, in order of place.

    ``cells`` has one row for a subject and code, such as :func:`features.finding_cells` gives; NULL values and codes out of the dictionary
    have no place. A subject's list is no longer than the dictionary.
    """
    size = dictionary.count()
    known = dictionary.select(F.col("code").alias("_code"), "index")
    placed = cells.where(F.col(subject).isNotNull() & F.col(value).isNotNull()).select(subject, F.col(code).alias("_own"), F.col(value).cast("double").alias("_value"))
    placed = placed.join(F.broadcast(known) if size <= BROADCAST_KEYS else known, F.col("_own") == F.col("_code"))
    lists = placed.groupBy(subject).agg(F.array_sort(F.collect_list(F.struct("index", "_value"))).alias("_l"))
    return lists.select(subject, F.lit(size).alias("size"), F.col("_l.index").alias("indices"), F.col("_l._value").alias("values"))


def as_vectors(sparse: DataFrame, subject: str = "USUBJID", out: str = "features") -> DataFrame:
    """(subject, ``out``): sparse vectors of ``pyspark.ml``. They are written in a vector's own storage form and read as vectors, so no row goes through Python."""
    kind = T.StructType([sparse.schema[subject], T.StructField(out, VectorUDT())])
    path = fresh_path(sparse.sparkSession, "vectors")
    form = F.struct(F.lit(0).cast("tinyint").alias("type"), F.col("size").cast("int").alias("size"), F.col("indices"), F.col("values"))
    sparse.select(subject, form.alias(out)).write.parquet(path)
    return sparse.sparkSession.read.schema(kind).parquet(path)


def as_cells(sparse: DataFrame, dictionary: DataFrame, subject: str = "USUBJID") -> DataFrame:
    """(subject, code, value): the long form again."""
    each = sparse.select(subject, F.explode(F.arrays_zip("indices", "values")).alias("_x")).select(subject, F.col("_x.indices").alias("_at"), F.col("_x.values").alias("value"))
    known = dictionary.select("code", F.col("index").alias("_index"))
    return each.join(known, F.col("_at") == F.col("_index")).select(subject, "code", "value")
