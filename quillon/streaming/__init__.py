"""Micro-batch ingestion into the snapshot store."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.incremental import newer
from ..sources.registry import SourceSpec
from ..sources.snapshots import SnapshotStore


def merge(batch: DataFrame, number: int, query: str, store: SnapshotStore, spec: SourceSpec) -> bool:
    """Merges one micro-batch; False if it is committed already.

    The table's notes hold, for each query, its last batch and the watermark that the table had when the query began. Rows
    are compared with that one, so rows of one new date may come in as many batches as they like. Where late corrections
    replace rows, the first batch replaces those from the watermark on; later ones add to them.
    """
    seen = store.notes(spec.table).get(query)
    if seen and number <= seen["batch"]:
        return False
    if seen:
        mark = date.fromisoformat(seen["mark"]) if seen["mark"] else None
    else:
        mark = store.watermark(spec.table, spec.watermark)
    note = {query: {"batch": number, "mark": mark.isoformat() if mark else None}}
    if not store.exists(spec.table):
        store.write(spec.table, batch, notes=note)
    elif spec.overlap and not seen:
        store.overlap_replace(spec.table, batch, spec.watermark, note)
    else:
        rows = newer(store.read(spec.table), batch, spec.watermark, None)
        if mark is not None:
            day = F.col(spec.watermark)
            rows = rows.where(day >= F.lit(mark) if spec.overlap else day > F.lit(mark))
        store.append(spec.table, rows, note)
    return True


def ingest(stream: DataFrame, store: SnapshotStore, spec: SourceSpec, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Merges each micro-batch of ``stream``. A batch that is replayed after a failure changes nothing: a table's version
    carries the number of the batch that made it."""

    def run(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            merge(batch, number, batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId"), store, spec)

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
