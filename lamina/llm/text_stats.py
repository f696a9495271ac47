"""Statistics of whole texts as Spark expressions, and bounded labelled samples of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .secret_scan import let

#: Characters that part words, and symbols.
SPACE = "[\\x20\\x09-\\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Labelled rows that a model is fitted on, at most: those first in a hash order of their ids.
LABELLED = 20_000

STATS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
RATES = ("n_words", "mean_word", "symbol_rate", "upper_rate", "mark_rate", "digit_rate", "distinct_rate", "repeat_rate", "dup_line_rate")


def _without(text: Column, characters: str) -> Column:
    return F.char_length(F.translate(text, characters, ""))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of ``window`` words found twice or more, the first included.

    Windows are compared by 64-bit hashes of the words' hashes; texts without a
    repeated window, the usual case, are told by one distinct count.
    """
    n = F.size(words) - (window - 1)
    none = F.expr("cast(array() as array<bigint>)")

    def windows(hashed):
        return F.transform(F.slice(hashed, 1, n), lambda _, i: F.xxhash64(*[F.get(hashed, i + k) for k in range(window)]))

    prints = F.when(n > 1, let(F.transform(words, lambda w: F.xxhash64(w)), windows)).otherwise(none)

    def covered(found):
        placed = F.array_sort(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(placed, lambda s: F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))))
        order = F.array_sort(F.transform(twice, lambda x: x["i"]))
        state = F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum"))
        grow = lambda s, i: F.struct((i + window).alias("end"), (s["sum"] + i + window - F.greatest(s["end"], i)).alias("sum"))
        total = F.aggregate(order, state, grow, lambda s: s["sum"])
        return F.when(F.size(F.array_distinct(found)) < F.size(found), total).otherwise(F.lit(0))

    return let(prints, covered).cast("long")


def with_base_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """Add word and line counts of the whole text; a null text has none of anything."""
    plain = F.coalesce(F.col(text), F.lit(""))
    split = df.withColumn("__plain", plain).withColumn("__words", F.array_remove(F.split("__plain", SPACE), "")).withColumn("__lines", F.filter(F.split("__plain", "\n"), lambda x: _without(x, SPACES) > 0))
    return split.select(
        *df.columns,
        "__plain",
        "__words",
        F.size("__words").cast("long").alias("n_words"),
        _without(F.col("__plain"), SPACES).cast("long").alias("word_chars"),
        (F.char_length("__plain") - _without(F.col("__plain"), SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("__words")).alias("n_repeat_words"),
    )


def with_rates(df: DataFrame, text: str = "text") -> DataFrame:
    """:func:`with_base_stats` and the rates of ``RATES``, 0 where there is nothing to divide by."""
    stats = with_base_stats(df, text)
    per = lambda x, n: F.when(F.col(n) > 0, x / F.col(n)).otherwise(F.lit(0.0)).cast("double")
    count = lambda chars: F.char_length("__plain") - _without(F.col("__plain"), chars)
    return stats.select(
        *[c for c in stats.columns if c not in ("__plain", "__words")],
        per(F.col("word_chars"), "n_words").alias("mean_word"),
        per(F.col("n_symbols"), "n_words").alias("symbol_rate"),
        per(count("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "word_chars").alias("upper_rate"),
        per(count("!?"), "n_words").alias("mark_rate"),
        per(count("0123456789"), "word_chars").alias("digit_rate"),
        per(F.size(F.array_distinct("__words")), "n_words").alias("distinct_rate"),
        per(F.col("n_repeat_words"), "n_words").alias("repeat_rate"),
        per(F.col("n_dup_lines"), "n_lines").alias("dup_line_rate"),
    )


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % divisor


def labelled(df: DataFrame, labels: DataFrame, label: str, where: Column | None = None, limit: int = LABELLED, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, text, label)`` of at most ``limit`` labelled documents, picked by a hash of the id.

    The picked labels are at most ``limit`` small rows, which bounds the broadcast
    and all that a model gathers. Null labels and labels on null ids don't count.
    """
    marks = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    if where is not None:
        marks = marks.where(where)
    marks = marks.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    picked = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).select(F.col("doc_id").alias("_labelled"), "label")
    documents = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return documents.join(F.broadcast(picked), F.col("doc_id") == F.col("_labelled")).select("doc_id", "text", "label")
