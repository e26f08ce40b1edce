"""One stream of typed operations on a collection: write trees, change and delete points, and ask.

Each operation carries the producer's sequence number, which decides between operations wherever they arrive, so a
micro-batch that is replayed, or an operation that comes twice, changes nothing. A micro-batch first writes its changes
in one append and then asks, so its questions meet the collection as of their batch. What cannot be done is set aside
with a reason; only failures of the job itself stop the stream.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from docmatch.operators import collection as col
from docmatch.operators import hierarchy, models, validate
from docmatch.operators.models import EmbedFn
from docmatch.operators.scenario import Scenario
from docmatch.plans.match import match
from docmatch.sources.staging import stage
from docmatch.sources.trees import SIDES

SCHEMA = T.StructType([
    T.StructField("seq", T.LongType()),
    *[T.StructField(c, T.StringType()) for c in ("op", "project_id", "side", "doc_id", "raw", "orig_sid", "uid", "text")],
])
# What an operation needs besides its number and project: a tree, a point and its text, or a document.
NEEDS = {"upsert": ["raw", "side"], "update": ["uid", "text"], "delete": ["orig_sid"], "ask": ["raw", "side"]}


@dataclass(frozen=True)
class Asking:
    """How questions are answered, and where predictions go: a folder per batch."""

    scenario: Scenario | DataFrame
    generators: dict[str, models.GenerateFn]
    default_model: str
    results: str
    options: dict = field(default_factory=dict)


def split_operations(ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Operations that can be done, and the others with a ``reason``."""
    reason = F.when(~F.coalesce(F.col("op").isin(*NEEDS), F.lit(False)), "unknown_op").when(F.col("seq").isNull(), "missing_seq")
    reason = reason.when(~F.coalesce(F.col("project_id").rlike(validate.PROJECT_ID_PATTERN), F.lit(False)), "bad_project_id")
    for op, needed in NEEDS.items():
        for name in needed:
            reason = reason.when((F.col("op") == op) & F.col(name).isNull(), f"missing_{name}")
    has_side = F.col("op").isin(*(op for op, needed in NEEDS.items() if "side" in needed))
    reason = reason.when(has_side & ~F.col("side").isin(*SIDES), "bad_side")
    checked = ops.select(*SCHEMA.names).withColumn("reason", reason)
    return checked.where("reason IS NULL").drop("reason"), checked.where("reason IS NOT NULL")


def _set_aside_trees(trees: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid trees, and the others as operations with a reason."""
    valid, broken = validate.split_valid(trees.withColumn("_raw", F.col("raw")))
    reason = F.when(F.col("tree").isNull(), "not_json").otherwise("invalid_tree")
    return valid.drop("_raw"), broken.withColumns({"raw": F.col("_raw"), "reason": reason}).select(*SCHEMA.names, "reason")


def log_rows(good: DataFrame, fn: EmbedFn, *, dim: int, depth: int, chunk_size: int) -> tuple[DataFrame, DataFrame]:
    """The log rows of the operations that write, and the trees that are set aside."""
    valid, broken = _set_aside_trees(good.where("op = 'upsert'").select(*SCHEMA.names))
    written = hierarchy.chunk(hierarchy.flatten(valid.drop("orig_sid", "uid", "text", "op"), depth), chunk_size)
    changed = good.where("op = 'update'").select("seq", "project_id", "side", "orig_sid", "uid", "text")
    rows = col.embedded(written, fn, F.col("seq"), dim=dim).unionByName(col.embedded(changed, fn, F.col("seq"), dim=dim))
    return rows.unionByName(col.deletes(good.where("op = 'delete'"), F.col("seq"))), broken


def apply_batch(
    batch: DataFrame, batch_id: int, path: str, fn: EmbedFn, *, dim: int, depth: int, chunk_size: int, quarantine: str,
    asking: Asking | None = None,
) -> None:
    """Do a batch of operations. Doing it again leaves the same collection, results and quarantine."""
    ops = stage(batch.select(*SCHEMA.names), "operations")
    good, bad = split_operations(ops)
    rows, broken = log_rows(good, fn, dim=dim, depth=depth, chunk_size=chunk_size)
    col.append_log(rows, path, few_files=True)
    asked, unreadable = _set_aside_trees(good.where("op = 'ask'"))
    aside = bad.unionByName(broken).unionByName(unreadable)
    if asking is not None:
        made = match(asked.select("project_id", "doc_id", "side", F.to_json("tree").alias("raw")), asking.scenario, fn, asking.generators,
                     default_model=asking.default_model, dim=dim, collection_path=path, seq=batch_id, **asking.options)
        made.predictions.write.mode("overwrite").parquet(f"{asking.results}/batch={batch_id}")
    else:
        aside = aside.unionByName(asked.withColumns({"raw": F.to_json("tree"), "reason": F.lit("nobody_answers")}).select(*aside.columns))
    aside.write.mode("overwrite").parquet(f"{quarantine}/batch={batch_id}")


def start_operations(
    ops: DataFrame, path: str, fn: EmbedFn, *, dim: int, depth: int, chunk_size: int, checkpoint: str, quarantine: str,
    asking: Asking | None = None, available_now: bool = True, after: Callable[[int], None] | None = None,
) -> StreamingQuery:
    """Apply a stream of operations (``SCHEMA``) to the collection at ``path``; ``after`` hears of every batch."""
    def each(batch: DataFrame, batch_id: int) -> None:
        apply_batch(batch, batch_id, path, fn, dim=dim, depth=depth, chunk_size=chunk_size, quarantine=quarantine, asking=asking)
        if after:
            after(batch_id)

    writer = ops.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
