"""Column expressions shared by the operators. All are built-in functions; none runs Python on rows."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts that mean "missing".
MISSING_TOKENS = ("", "nan", "none", "null", "na", "n/a", "nat")
UNKNOWN_TOKENS = ("UNKNOWN", "UNK")
#: Parts of column names that mean a date.
DATE_HINTS = ("date", "dt", "start", "stop", "birth", "death")


def resolve_col(df: DataFrame, candidates: Sequence[str], required: bool = True) -> str | None:
    """Real name of the first candidate that ``df`` has, in any case; KeyError or None without one."""
    have = {c.lower(): c for c in reversed(df.columns)}
    for name in candidates:
        if name.lower() in have:
            return have[name.lower()]
    if required:
        raise KeyError(f"none of {list(candidates)} in {df.columns}")
    return None


def project(df: DataFrame, mapping: Mapping[str, Column]) -> DataFrame:
    """Rename-and-select: the new names and their expressions, in order."""
    return df.select(*[c.alias(name) for name, c in mapping.items()])


def drop_cols(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """All columns but the named ones."""
    return df.drop(*names)


def with_constants(df: DataFrame, **values: object) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def safe_cast(col: Column, kind: str) -> Column:
    """Cast that gives NULL on bad input. Numbers with a Java type suffix (``5d``) are bad."""
    if kind in ("double", "float"):
        suffixed = col.cast("string").rlike(r"[0-9.][dDfF]\s*$")
        return F.when(~suffixed, col.try_cast(kind))
    return col.try_cast(kind)


def typed(df: DataFrame, kinds: Mapping[str, str], mode: str = "strict") -> DataFrame:
    """Cast columns. ``strict`` raises on bad input; ``quarantine`` gives NULL and counts bad casts in ``_bad_casts``."""
    if mode == "strict":
        return df.withColumns({c: F.col(c).cast(k) for c, k in kinds.items()})
    if mode != "quarantine":
        raise ValueError(mode)
    bad = sum((F.when(F.col(c).isNotNull() & safe_cast(F.col(c), k).isNull(), 1).otherwise(0) for c, k in kinds.items()), F.lit(0))
    flagged = df.withColumn("_bad_casts", bad)
    return flagged.withColumns({c: safe_cast(F.col(c), k) for c, k in kinds.items()})


def iso_text(col: Column) -> Column:
    return col.cast("string")


def fmt_ts(col: Column, pattern: str = "yyyy-MM-dd'T'HH:mm:ss") -> Column:
    return F.date_format(col, pattern)


def seconds(col: Column) -> Column:
    """Whole seconds since the epoch; fractions are cut, as second differences need."""
    return F.unix_seconds(col.cast("timestamp"))


def day_diff(start: Column, end: Column) -> Column:
    """Calendar days from start to end."""
    return F.datediff(end.cast("date"), start.cast("date")).cast("bigint")


def los_days(start: Column, end: Column) -> Column:
    """Fractional days of stay, not below 0; NULL if either end is."""
    days = (seconds(end) - seconds(start)) / F.lit(86400.0)
    return F.when(start.isNotNull() & end.isNotNull(), F.greatest(F.lit(0.0), days))


def los_minutes(start: Column, end: Column) -> Column:
    """Minutes of stay with fractions, not below 0; NULL if either end is."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return F.when(start.isNotNull() & end.isNotNull(), F.greatest(F.lit(0.0), micros / F.lit(6e7)))


def age_years(birth: Column, at: Column) -> Column:
    """Whole years of 365.25 days."""
    return F.floor((seconds(at) - seconds(birth)) / F.lit(365.25 * 86400)).cast("bigint")


def first_reason(rules: Sequence[tuple[str, Column]]) -> Column:
    """Name of the first rule that holds, NULL if none does."""
    out = F.lit(None).cast("string")
    for reason, holds in reversed(rules):
        out = F.when(holds, F.lit(reason)).otherwise(out)
    return out


def coalesce_text(*cols: Column) -> Column:
    return F.coalesce(*[c.cast("string") for c in cols])


def subject_id(col: Column, prefix: str = "SYN-") -> Column:
    """Prefixed id; NULL if the id is."""
    return F.concat(F.lit(prefix), col.cast("string"))


def norm_text(col: Column) -> Column:
    return F.upper(F.trim(col))


def in_codes(col: Column, codes: Sequence[str]) -> Column:
    return col.isin(*codes)


def not_in_codes(col: Column, codes: Sequence[str]) -> Column:
    """A NULL code is neither in nor not in."""
    return ~col.isin(*codes)


def is_effectively_missing(col: Column) -> Column:
    """NULL, blank, or UNKNOWN / UNK in any case."""
    text = norm_text(col.cast("string"))
    return col.isNull() | (text == "") | text.isin(*UNKNOWN_TOKENS)


def null_safe_on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & left[k].eqNullSafe(right[k])
    return out


def blank_token(col: Column, tokens: Sequence[str] = MISSING_TOKENS) -> Column:
    return F.when(~F.lower(F.trim(col)).isin(*tokens), col)


def normalize_tokens(df: DataFrame, tokens: Sequence[str] = MISSING_TOKENS) -> DataFrame:
    """Missing tokens become NULL in all text columns."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: blank_token(F.col(c), tokens) for c in texts}) if texts else df


def finite(col: Column) -> Column:
    """NULL in place of NaN and infinities."""
    return F.when(~F.isnan(col) & (F.abs(col) != float("inf")), col)


def null_inf(df: DataFrame) -> DataFrame:
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: finite(F.col(c)) for c in floats}) if floats else df


def clip(col: Column, lower: float | None = None, upper: float | None = None) -> Column:
    out = col
    if lower is not None:
        out = F.greatest(out, F.lit(float(lower)))
    if upper is not None:
        out = F.least(out, F.lit(float(upper)))
    return F.when(col.isNotNull(), out)


def safe_name(text: str) -> str:
    """Letters, digits and single underscores."""
    return re.sub(r"_+", "_", re.sub(r"[^A-Za-z0-9_]", "_", str(text))).strip("_")


def fill_constants(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return df.fillna(dict(values))


def trailing_int(col: Column) -> Column:
    """Number at the end of a name; NULL without one."""
    return F.regexp_extract(col, r"(\d+)$", 1).try_cast("int")


def pct(n: Column, d: Column, on_empty: float = 0.0) -> Column:
    """100 n / d, or ``on_empty`` for an empty denominator; 2 places."""
    return F.when(d > 0, F.round(F.lit(100.0) * n / d, 2)).otherwise(F.lit(float(on_empty)))
