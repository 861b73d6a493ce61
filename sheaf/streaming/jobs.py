"""Streaming counterparts of the JSON quarantine and the newest-response rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from sheaf.operators.jsonops import json_process, quarantine


def stream_json_quarantine(
    source: DataFrame, text: str, good_path: str, reject_path: str, checkpoint: str, *, available_now: bool = True
) -> StreamingQuery:
    """Route arriving rows to a good table and a reject table.

    Each batch writes to its own ``batch=<id>`` folder with overwrite, so a batch that is replayed
    after a failure leaves one copy."""

    def write(batch: DataFrame, batch_id: int) -> None:
        processed = json_process(batch, text).persist()
        good, bad = quarantine(processed)
        good.write.mode("overwrite").parquet(f"{good_path}/batch={batch_id}")
        bad.write.mode("overwrite").parquet(f"{reject_path}/batch={batch_id}")
        processed.unpersist()

    writer = source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def stream_latest(source: DataFrame, key: str, generation: Sequence[str]) -> DataFrame:
    """Newest row per key as a streaming aggregate (update or complete mode).

    The rule has no time bound, so state is one row per key and no watermark applies."""
    rest = [c for c in source.columns if c != key]
    return source.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*generation)).alias("r")).select(key, "r.*")
