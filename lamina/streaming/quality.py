"""Row-local checks on streams: the same rules as in batch, split per micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.quarantine import REASON, flag


def flag_stream(stream: DataFrame, rules: Sequence[tuple[str, Column]]) -> DataFrame:
    """The stream with each row's reject reason; stateless, so it needs no watermark."""
    return flag(stream, rules)


def split_stream(stream: DataFrame, rules: Sequence[tuple[str, Column]], clean_path: str, reject_path: str, checkpoint: str, start: Callable[..., StreamingQuery] | None = None) -> StreamingQuery:
    """Append clean rows and rejects of each micro-batch to two Parquet tables.

    A batch that is retried after a failure overwrites its own folder, so rows are neither lost nor doubled.
    """

    def split(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        kept.where(f"{REASON} is null").drop(REASON).write.mode("overwrite").parquet(f"{clean_path}/batch={batch_id}")
        kept.where(f"{REASON} is not null").write.mode("overwrite").parquet(f"{reject_path}/batch={batch_id}")
        kept.unpersist()

    writer = flag_stream(stream, rules).writeStream.foreachBatch(split).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return start(writer) if start else writer.start()
