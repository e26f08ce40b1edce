"""Incremental ingestion: a stream of trees appended to a collection log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql.streaming import StreamingQuery

from docmatch.operators import collection as col
from docmatch.operators import hierarchy, validate
from docmatch.operators.models import EmbedFn


def start_ingest(
    trees: DataFrame, path: str, fn: EmbedFn, *, dim: int, depth: int, chunk_size: int,
    checkpoint: str, available_now: bool = True, on_counts: Callable[[int, dict[str, int]], None] | None = None,
) -> StreamingQuery:
    """Validate, flatten, chunk, embed and append each micro-batch of ``(project_id, doc_id, side, raw)``.

    The batch id is the sequence number, so a later batch replaces earlier points, and a batch
    replayed after a failure adds equal rows that resolve to the same state. ``on_counts`` gets the counts of
    every batch (``metrics.log_metrics``), taken while it is written.
    """
    def append(batch: DataFrame, batch_id: int) -> None:
        valid, _ = validate.split_valid(batch)
        rows = hierarchy.chunk(hierarchy.flatten(valid, depth), chunk_size)
        seen = Observation() if on_counts else None
        col.ingest(rows, path, fn, batch_id, dim=dim, few_files=True, observation=seen)
        if on_counts:
            on_counts(batch_id, seen.get)

    writer = trees.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
