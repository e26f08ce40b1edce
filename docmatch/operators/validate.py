"""Row checks that yield violations instead of stopping the job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmatch.functions import variants as vr
from docmatch.sources.trees import parse

MAX_DEPTH = 5

MESSAGES = {
    "unparsable": "text is not valid JSON",
    "root_not_object": "the root is not an object",
    "level1_missing": "the root has no level1",
    "level_not_list": "the level is not a list",
    "item_not_object": "the item is not an object",
    "sid_not_string": "sid is missing or not a string",
    "text_not_string": "text is missing or not a string",
}

_ENTRY = "struct<path:string,ord:array<int>,node:variant,code:string>"


def _found(test: Column, code: str, path: Column, ord_: Column) -> Column:
    entry = F.struct(
        path.alias("path"), ord_.alias("ord"), F.lit(None).cast("variant").alias("node"),
        F.lit(code).alias("code"),
    )
    return F.when(test, entry.cast(_ENTRY))


def _children(node: Column, level: int, path: Column, ord_: Column) -> Column:
    """Entries for the items of the next level."""
    def entry(item: Column, i: Column) -> Column:
        return F.struct(
            F.concat(path, F.lit(f"/level{level}["), i.cast("string"), F.lit("]")).alias("path"),
            F.array_append(ord_, i).alias("ord"),
            item.alias("node"),
            F.lit(None).cast("string").alias("code"),
        ).cast(_ENTRY)

    found = F.transform(vr.items(node, f"$.level{level}"), entry)
    return F.coalesce(found, F.array().cast(f"array<{_ENTRY}>"))


def _not_list(node: Column, level: int, path: Column, ord_: Column) -> Column:
    child = vr.field(node, f"level{level}")
    return _found(
        child.isNotNull() & ~vr.is_list(child), "level_not_list",
        F.concat(path, F.lit(f"/level{level}")), F.array_append(ord_, F.lit(-1)),
    )


def violations(trees: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """All violations as ``(doc_id, path, code, message, ord)``; sort by ``ord`` for depth-first order.

    One scan and no shuffle: each level is one ``Generate`` whose rows are either violations already
    found, which pass through, or nodes still to be checked. ``ord`` is the position path; negative
    last elements put a node's own violations before those of its children.
    """
    top = min(max(max_depth, 1), MAX_DEPTH)
    tree = F.col("tree") if "tree" in trees.columns else F.try_parse_json("raw")
    start = trees.select("doc_id", tree.alias("node"))

    root, none = F.lit("root"), F.array().cast("array<int>")
    node = F.col("node")
    is_object = F.coalesce(vr.is_object(node), F.lit(False))
    first = F.concat(
        F.array_compact(F.array(
            _found(node.isNull(), "unparsable", root, none),
            _found(node.isNotNull() & ~is_object, "root_not_object", root, none),
            _found(is_object & vr.field(node, "level1").isNull(), "level1_missing",
                   F.lit("root/level1"), F.array(F.lit(-1))),
            _not_list(node, 1, root, none),
        )),
        _children(node, 1, root, none),
    )
    rows = start.select("doc_id", F.inline(first))

    for level in range(1, top + 1):
        node, path, ord_ = F.col("node"), F.col("path"), F.col("ord")
        is_object = F.coalesce(vr.is_object(node), F.lit(False))
        checks = [
            _found(~is_object, "item_not_object", path, ord_),
            _found(is_object & ~vr.is_string(vr.field(node, "sid")), "sid_not_string", path,
                   F.concat(ord_, F.array(F.lit(-2), F.lit(0)))),
            _found(is_object & ~vr.is_string(vr.field(node, "text")), "text_not_string", path,
                   F.concat(ord_, F.array(F.lit(-2), F.lit(1)))),
        ]
        entries = F.array_compact(F.array(*checks))
        if level < top:
            below = F.array_compact(F.array(_not_list(node, level + 1, path, ord_)))
            entries = F.concat(entries, below, _children(node, level + 1, path, ord_))
        itself = F.array(F.struct("path", "ord", "node", "code").cast(_ENTRY))
        step = F.when(F.col("code").isNotNull(), itself).otherwise(entries)
        rows = rows.select("doc_id", F.inline(step))

    message = F.create_map(*[F.lit(x) for pair in MESSAGES.items() for x in pair])
    return rows.where("code IS NOT NULL").select(
        "doc_id", "path", "code", message[F.col("code")].alias("message"), "ord"
    )


def _level_ok(node: Column, level: int, top: int) -> Column:
    """True if the children at ``level`` are absent, or a list of well-formed nodes."""
    child = vr.field(node, f"level{level}")

    def node_ok(item: Column) -> Column:
        ok = (
            vr.is_object(item)
            & vr.is_string(vr.field(item, "sid"))
            & vr.is_string(vr.field(item, "text"))
        )
        return ok & _level_ok(item, level + 1, top) if level < top else ok

    listed = F.coalesce(F.forall(vr.items(child), node_ok), F.lit(False))
    # A list below the last checked level may hold anything.
    return child.isNull() | listed


def is_valid(tree: Column, max_depth: int = MAX_DEPTH) -> Column:
    """True for trees without violations; a row-local test, so filtering by it moves no data."""
    top = min(max(max_depth, 1), MAX_DEPTH)
    ok = vr.is_object(tree) & vr.field(tree, "level1").isNotNull() & _level_ok(tree, 1, top)
    return F.coalesce(ok, F.lit(False))


def split_valid(trees: DataFrame, max_depth: int = MAX_DEPTH) -> tuple[DataFrame, DataFrame]:
    """Trees without and trees with violations, both parsed (column ``tree``)."""
    parsed = trees if "tree" in trees.columns else parse(trees)
    valid = is_valid(F.col("tree"), max_depth)
    return parsed.where(valid), parsed.where(~valid)


def scenario_violations(scenarios: DataFrame) -> DataFrame:
    """Broken parameter rules as ``(project_id, field, code)``."""
    rules = [("direction", "not_in_set", F.coalesce(
        F.lower("direction").isin("forward", "reverse", "both"), F.lit(True)))]
    rules += [
        (k, "less_than_1", F.coalesce(F.col(k) >= 1, F.lit(True)))
        for k in ("rag_k", "rag_k_forward", "rag_k_reverse") if k in scenarios.columns
    ]
    rules.append(("cof_threshold", "not_in_0_1", F.coalesce(
        F.col("cof_threshold").between(0.0, 1.0), F.lit(True))))
    broken = F.array_compact(F.array(*[
        F.when(~ok, F.struct(F.lit(f).alias("field"), F.lit(c).alias("code"))) for f, c, ok in rules
    ]))
    return scenarios.select("project_id", F.inline(broken))


# Fixed value: the pattern a project id must match.
PROJECT_ID_PATTERN = r"^[A-Za-z0-9_-]+$"


def valid_project_ids(df: DataFrame, column: str = "project_id") -> DataFrame:
    return df.where(F.col(column).rlike(PROJECT_ID_PATTERN))


def vector_rejects(points: DataFrame, dim: int, column: str = "vector") -> DataFrame:
    """Rows whose vector is missing, empty or of another size, with the reason."""
    size = F.coalesce(F.size(column), F.lit(0))
    reason = F.when(size <= 0, "empty_vector").when(size != dim, "wrong_size")
    return points.withColumn("reason", reason).where("reason IS NOT NULL")


def split_ingestable(rows: DataFrame, batch: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows with ``uid`` and ``text``, and the others with a ``reason``.

    With ``batch`` (strict mode) one bad row rejects its whole batch. The flag is aggregated per
    batch first, so a batch that holds a large share of the rows never meets in one task.
    """
    reason = F.when(F.col("uid").isNull(), "missing_uid").when(F.col("text").isNull(), "missing_text")
    checked = rows.withColumn("reason", reason)
    if batch:
        flags = checked.groupBy(*batch).agg(F.bool_or(F.col("reason").isNotNull()).alias("_bad"))
        checked = checked.join(flags, batch).withColumn(
            "reason", F.coalesce("reason", F.when(F.col("_bad"), "batch_rejected"))
        ).drop("_bad")
    return checked.where("reason IS NULL").drop("reason"), checked.where("reason IS NOT NULL")
