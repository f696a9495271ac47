"""Small helpers on frames."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Key tables of up to so many rows (ids and digests: some tens of bytes each) are broadcast, larger ones are shuffled.
BROADCAST_ROWS = 400_000


def without(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """``df`` less the columns of these names, in any case: added columns take their place."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def sized(keys: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``keys``, a table that was written, marked for broadcast if it has at most ``rows`` rows: the other side then stays where it is.

    Larger ones are marked for a sort merge join. Left to itself Spark may broadcast either side by its estimate, which takes an
    ``explode`` to give one row for each it reads.
    """
    return F.broadcast(keys) if keys.limit(rows + 1).count() <= rows else keys.hint("merge")


def text_tag(text: Column) -> Column:
    """A 64-bit digest of a text, null as empty: tells rows with the same id apart."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))
