"""De-identification of tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words that name direct identifiers, and names of dates.
IDENTIFIERS = frozenset(
    "name email phone tel address street zip postal city state mrn patid patientid ssn social passport iban account".split()
)
#: Columns of the patients' source that are identifiers by their whole name.
WHOLE = frozenset({"first", "last", "maiden", "drivers", "birthplace"})
DATES = r"(?i)(dtc|date|datetime|timestamp|_ts$|_dt$|admit|discharge|^start|^stop|^ende|^adt)"
#: Words that are parts of many others, and what they may be joined to, as in ``zipcode``; the rest count wherever they stand in a word.
SHORT = frozenset("name tel zip city state mrn ssn iban".split())
TAILS = frozenset("code no nr num number id name address key".split())
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def is_identifier(column: str, words: frozenset[str] = IDENTIFIERS) -> bool:
    """Whether a column name holds an identifier word: on its own, in camel case, or joined to others.

    Words are told apart, so ``ETHNICITY`` isn't a city and ``STATUS`` no state.
    """
    if column.lower() in WHOLE:
        return True
    parts = [w.lower() for w in WORD.findall(column)]
    joined = {a + b for a, b in zip(parts, parts[1:], strict=False)}
    for part in {*parts, *joined}:
        if part in words or part.endswith("name"):
            return True
        for w in words:
            if (w not in SHORT and w in part) or (part.startswith(w) and part[len(w) :] in TAILS):
                return True
    return False


def drop_identifiers(df: DataFrame, pattern: str | None = None) -> DataFrame:
    """Columns named like identifiers go: by :func:`is_identifier`, or by a pattern of the caller's."""
    return df.drop(*[c for c in df.columns if (re.search(pattern, c) if pattern else is_identifier(c))])


def drop_dates(df: DataFrame, pattern: str = DATES, by_type: bool = True) -> DataFrame:
    """Columns named like dates go, and with ``by_type`` all date and time columns."""
    timed = [f.name for f in df.schema if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))] if by_type else []
    return df.drop(*{*timed, *[c for c in df.columns if re.search(pattern, c)]})


def hashed(col: Column, salt: str) -> Column:
    text = col.cast("string")
    return F.when(~F.lower(F.trim(text)).isin("", "none", "nan"), F.sha2(F.concat(F.lit(salt), F.lit("::"), text), 256))


def pseudonymize(df: DataFrame, key: str, salt: str, out: str = "SUBJ_HASH") -> DataFrame:
    """Salted digest in place of the key; NULL for missing keys."""
    return df.withColumn(out, hashed(F.col(key), salt)).drop(key)


def null_tokens(df: DataFrame) -> DataFrame:
    """Texts nan, None and '' become NULL."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.when(~F.lower(F.trim(c)).isin("", "none", "nan"), F.col(c)) for c in texts}) if texts else df


def deid_table(df: DataFrame, key: str, salt: str, identifiers: str | None = None, dates: str = DATES) -> DataFrame:
    return null_tokens(drop_dates(drop_identifiers(pseudonymize(df, key, salt), identifiers), dates))


def deid_report(name: str, before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: rows and columns in and out, dropped columns."""
    gone = ",".join(sorted(set(before.columns) - set(after.columns)))
    counts = before.agg(F.count("*").alias("rows_in")).crossJoin(after.agg(F.count("*").alias("rows_out")))
    return counts.select(F.lit(name).alias("table_name"), "rows_in", "rows_out", F.lit(len(before.columns)).alias("cols_in"), F.lit(len(after.columns)).alias("cols_out"), F.lit(gone).alias("dropped"), F.lit(int("SUBJ_HASH" in after.columns)).alias("pseudonymized"))


def matching_tables(names: Sequence[str], patterns: Sequence[str]) -> list[str]:
    return [n for n in names if any(re.search(p, n) for p in patterns)]


def deid_layer(spark: SparkSession, patterns: Sequence[str], salt: str, key: str = "USUBJID") -> dict[str, DataFrame]:
    """De-identified frame of every catalog table (or temporary view) whose name matches and that has the key."""
    names = matching_tables([t.name for t in spark.catalog.listTables()], patterns)
    return {n: deid_table(spark.table(n), key, salt) for n in names if key in spark.table(n).columns}


def access_copy(tables: dict[str, DataFrame], patterns: Sequence[str], path: str, fmt: str = "parquet") -> list[str]:
    """Write the frames whose name matches below ``path``; the names written."""
    chosen = matching_tables(sorted(tables), patterns)
    for n in chosen:
        tables[n].write.mode("overwrite").option("header", True).format(fmt).save(f"{path}/{n}")
    return chosen
