"""Flatten document trees into text rows and cut long texts into chunks.

Everything here is narrow: one scan, no shuffle. A tree is cast once to nested rows, since taking a list out of
a variant copies all that is below it. Each level is one ``Generate`` over the children
of the node reached so far; a path that ended earlier passes through with its node set to NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmatch.functions import text as tx
from docmatch.functions import variants as vr

MAX_DEPTH = 5


def _node_type(level: int, levels: int) -> str:
    """A node with all levels below it that are taken. What has another type than it should is null, by itself."""
    below = f", level{level + 1}: array<{_node_type(level + 1, levels)}>" if level < levels else ""
    return f"struct<sid: string, text: string{below}>"


def flatten(
    trees: DataFrame,
    depth: int | Column,
    *,
    as_coded: bool = False,
    keep_extra: bool = False,
    spread: int | None = None,
    max_depth: int = MAX_DEPTH,
) -> DataFrame:
    """One row per path of at most ``depth`` levels, with sids and texts joined along the path.

    Takes ``raw`` (JSON text) or ``tree`` (variant), ``side``, and any further columns, which are
    carried along. Adds ``orig_sid, group_uid, uid, text, pos``; ``pos`` is the position path that
    gives document order. ``as_coded`` counts levels as N-1 for N of 2 and more. ``keep_extra``
    keeps the other keys of the deepest node as a map. ``spread`` redistributes the first-level
    nodes, for inputs of few but very large trees. ``depth`` may be a column of the trees, of values up
    to ``max_depth``; a larger one is an error, since its deeper texts would be lost.
    """
    if isinstance(depth, int):
        if depth < 1:
            raise ValueError("depth must be at least 1")
        levels = max(1, depth - 1) if as_coded else depth
        reaches = None
    else:
        levels, reaches = max_depth, depth - 1 if as_coded else depth
        too_deep = F.raise_error(F.concat(F.lit("a depth is above max_depth: "), reaches.cast("string")))
        reaches = F.when(reaches > max_depth, too_deep.cast("int")).otherwise(reaches)
    tree = F.col("tree") if "tree" in trees.columns else F.try_parse_json("raw")
    carried = [c for c in trees.columns if c not in ("raw", "tree")]

    if keep_extra:
        # Other keys are found in the node itself, so each level is taken out of the one above.
        nodes = vr.items(tree, "$.level1")
    else:
        nodes = F.try_variant_get(tree, "$.level1", f"array<{_node_type(1, levels)}>")

    def text_of(node: Column, name: str) -> Column:
        return F.coalesce(vr.string_field(node, name) if keep_extra else node[name], F.lit(""))

    rows = trees.select(*carried, F.posexplode(nodes).alias("_p", "_node"))
    if spread:
        rows = rows.repartition(spread)
    rows = rows.select(
        *carried,
        "_node",
        F.array("_p").alias("pos"),
        text_of(F.col("_node"), "sid").alias("orig_sid"),
        text_of(F.col("_node"), "sid").alias("_sids"),
        text_of(F.col("_node"), "text").alias("text"),
    )
    if reaches is not None and levels == 1:
        rows = rows.where(reaches >= 0)
    if keep_extra:
        rows = rows.withColumn("extra", _extra(F.col("_node")))
    for level in range(2, levels + 1):
        ended = F.col("_p").isNull()
        child = F.col("_child")
        kept = [*carried, "orig_sid"]
        children = vr.items(F.col("_node"), f"$.level{level}") if keep_extra else F.col("_node")[f"level{level}"]
        if reaches is not None:
            children = F.when(reaches >= level, children)
        rows = rows.select(
            *kept, "pos", "_sids", "text", *(["extra"] if keep_extra else []),
            F.posexplode_outer(children).alias("_p", "_child"),
        )
        step = [
            child.alias("_node"),
            F.when(ended, F.col("pos")).otherwise(F.array_append("pos", F.col("_p"))).alias("pos"),
            F.when(ended, F.col("_sids"))
            .otherwise(F.concat_ws("_", "_sids", text_of(child, "sid"))).alias("_sids"),
            F.when(ended, F.col("text"))
            .otherwise(F.concat_ws("\n", "text", text_of(child, "text"))).alias("text"),
        ]
        if keep_extra:
            step.append(F.when(ended, F.col("extra")).otherwise(_extra(child)).alias("extra"))
        rows = rows.select(*kept, *step)
    group_uid = F.concat_ws("-", "side", "_sids")
    return rows.select(
        *carried, "orig_sid", group_uid.alias("group_uid"), group_uid.alias("uid"), "text", "pos",
        *(["extra"] if keep_extra else []),
    )


def _extra(node: Column) -> Column:
    """Keys of a node other than its sid, text and children, values as text."""
    return vr.other_fields(node, lambda k: k.isin("sid", "text") | k.rlike("^level[0-9]+$"))


def chunk(docs: DataFrame, size: int | Column) -> DataFrame:
    """Cut each text into pieces of ``size`` code points, one row per piece.

    Piece ``i`` gets ``{group_uid}_c{i}`` as ``uid`` and ``sid``. A size of 0 or less leaves the
    rows as they are, without a ``sid``. ``size`` may be a column of the rows.
    """
    if isinstance(size, int) and size <= 0:
        return docs.withColumns({"sid": F.lit(None).cast("string"), "chunk_no": F.lit(0)})
    size = F.lit(size) if isinstance(size, int) else size
    rest = [c for c in docs.columns if c not in ("text", "uid", "sid", "chunk_no")]
    pieces = docs.select(
        *rest, F.col("uid").alias("_whole"), (size > 0).alias("_cut"),
        F.posexplode(tx.chunks(F.col("text"), size)).alias("chunk_no", "text"),
    )
    chunk_id = F.concat("group_uid", F.lit("_c"), F.col("chunk_no").cast("string"))
    return pieces.withColumns({
        "uid": F.when(F.col("_cut"), chunk_id).otherwise(F.col("_whole")),
        "sid": F.when(F.col("_cut"), chunk_id),
    }).drop("_whole", "_cut")


def flag_oversize(docs: DataFrame, size: int) -> DataFrame:
    """Mark texts whose UTF-8 form is longer than ``size`` bytes."""
    return docs.withColumn("oversize", F.octet_length("text") > size)
