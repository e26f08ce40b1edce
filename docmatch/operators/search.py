"""Nearest-neighbour joins: for every query row, the ``k`` most similar points by cosine.

All strategies share one kernel: a block of queries times a block of points as a matrix product,
reduced at once to the block's top ``k``. They differ in how rows get into blocks:

``points``   the points fit the broadcast bound: one pass over the queries, no shuffle
``queries``  the queries fit the broadcast bound: one pass over the points, shuffling only top lists
``grid``     neither fits: stripes of one query block each, past which any number of points streams
``lsh``      approximate: random-hyperplane buckets as extra scopes of the grid, exact scores, and
             an exact search for queries whose buckets held fewer than ``k`` points

``scope`` columns (a project, say) must be equal on both sides. A scope or bucket of any size is cut
by a hash of the row key into query blocks and, where one task would read too much, lanes of points, so
a hot one spreads over many tasks. A point is copied once per query block, a query once per lane, and a
task holds one query block, one batch of points and one running top list. Ties rank by point key.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmatch.operators.payload import payload_filter
from docmatch.sources.staging import stage

BROADCAST_BYTES = 32 << 20
BLOCK_BYTES = 16 << 20
# All points are copied once per stripe, so smaller query blocks share a stripe of this size.
STRIPE_BYTES = 16 << 20
# What a task reads of the side that streams past the one it holds.
READ_BYTES = 4 << 20
# What one stripe reads (in query blocks) and multiplies at most, before its points are dealt over lanes.
LANE_BLOCKS = 32
LANE_PRODUCTS = 1 << 40
# Streams that stripes are dealt to: a small stripe costs its rows, not the start of a group.
DEALS = 4096
QUERY_ROWS = 16_384
BROADCAST_SCOPES = 100_000
TILE_CELLS = 2 << 20
BUCKET_ROWS = 4096
GROUP = 32
# Hits, and tables of them, that wait at most before they are merged into the top lists of a stripe.
WAITING, WAITING_TABLES = 1 << 17, 64

STRATEGIES = ("auto", "points", "queries", "grid", "lsh")


# --- kernel (runs in tasks) --------------------------------------------------------------------


def _raw(vectors: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """List column to a matrix, in single precision if that is what the column has."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    rows = len(vectors)
    sizes = pc.list_value_length(vectors)
    if rows and (sizes.null_count or pc.min(sizes).as_py() != pc.max(sizes).as_py()):
        raise ValueError("vectors of different sizes in one search")
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    if flat.dtype != np.float32:
        flat = flat.astype(np.float64, copy=False)
    return flat.reshape(rows, -1) if rows else flat.reshape(0, 0)


def _matrix(vectors: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """List column to a double matrix and its row lengths."""
    m = _raw(vectors).astype(np.float64, copy=False)
    return m, np.sqrt(np.einsum("ij,ij->i", m, m))


class _Block:
    """Rows of one side with their vectors as they came, lengths, and unit rows in single precision.

    Double precision is made for a bounded number of rows at a time, where it is needed.
    """

    def __init__(self, table: pa.Table, vector: str):
        self.table = table.drop_columns([vector])
        self.m = _raw(table[vector])
        self.lengths, self.unit = np.empty(len(self.m)), np.empty(self.m.shape, np.float32)
        step = max(1, TILE_CELLS // max(1, self.m.shape[1]))
        for i in range(0, len(self.m), step):
            part = self.m[i:i + step].astype(np.float64, copy=False)
            lengths = self.lengths[i:i + step] = np.sqrt(np.einsum("ij,ij->i", part, part))
            scale = np.divide(1.0, lengths, out=np.zeros_like(lengths), where=lengths > 0)
            self.unit[i:i + step] = part * scale[:, None]

    def __len__(self) -> int:
        return len(self.m)


def _exact(q: _Block, p: _Block, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Cosines of the pairs (r, c) in double precision."""
    dots = np.empty(len(r))
    step = max(1, TILE_CELLS // max(1, q.m.shape[1]))
    for i in range(0, len(r), step):
        part = slice(i, i + step)
        dots[part] = np.einsum("ij,ij->i", q.m[r[part]].astype(np.float64, copy=False), p.m[c[part]].astype(np.float64, copy=False))
    lengths = q.lengths[r] * p.lengths[c]
    return np.divide(dots, lengths, out=np.zeros_like(dots), where=lengths > 0)


def _slack(q: _Block) -> float:
    """Twice the largest rounding error of a product of unit vectors in single precision."""
    return 2 * (q.m.shape[1] + 8) * np.finfo(np.float32).eps


def _reached(near: np.ndarray, k: int) -> np.ndarray:
    """Per row a value that ``k`` of its columns reach, near the k-th largest."""
    n = near.shape[1]
    groups = n // GROUP
    if groups >= 4 * k:
        # The k-th largest of disjoint groups' maxima is at most the k-th largest value.
        tops = near[:, :GROUP * groups].reshape(len(near), GROUP, groups).max(axis=1)
        return np.partition(tops, groups - k, axis=1)[:, groups - k]
    if n > k:
        return np.partition(near, n - k, axis=1)[:, n - k]
    return np.full(len(near), -np.inf, dtype=np.float32)


def _best(q: _Block, p: _Block, k: int):
    """Top ``k`` points per query as (query row, point row, score); equal scores keep point order.

    A product of unit vectors in single precision only picks candidates: everything within twice its
    largest rounding error of a lower bound for the k-th score. Those are scored in double precision.
    """
    n = len(p)
    if n and len(q) and q.m.shape[1] != p.m.shape[1]:
        raise ValueError("vectors of different sizes in one search")
    if not n or not len(q):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)
    tile = max(1, TILE_CELLS // n)
    out = []
    for start in range(0, len(q), tile):
        near = q.unit[start:start + tile] @ p.unit.T
        r, c = np.nonzero(near >= (_reached(near, k) - _slack(q))[:, None])
        r += start
        s = _exact(q, p, r, c)
        order = np.lexsort((c, -s, r))
        r, c, s = r[order], c[order], s[order]
        keep = np.arange(len(r)) - np.searchsorted(r, r) < k
        out.append((r[keep], c[keep], s[keep]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _in_key_order(table: pa.Table, key: str) -> pa.Table:
    return table.take(pc.sort_indices(table[key]))


def _as_hits(q: pa.Table, qcols: list[str], pcol: str, r: np.ndarray, keys: pa.Array, s: np.ndarray) -> pa.Table:
    """Hit rows from query positions, point keys and scores, given query by query, best first."""
    columns = {name: q[name].take(pa.array(r)) for name in qcols}
    columns[pcol] = keys
    columns["score"] = pa.array(s, pa.float64())
    # A rank is the distance from the query's first row.
    columns["rank"] = pa.array(np.arange(len(r)) - np.searchsorted(r, r) + 1, pa.int32())
    return pa.table(columns)


def _hits(q: _Block, p: _Block, qcols: list[str], pcol: str, k: int) -> pa.Table:
    """Kernel result as rows; the points must be in key order."""
    r, c, s = _best(q, p, k)
    return _as_hits(q.table, qcols, pcol, r, p.table[pcol].take(pa.array(c)), s)


def _merge(old: pa.Table | None, new: pa.Table, k: int) -> pa.Table:
    """Top ``k`` per query position ``r`` of two lists of ``(r, key, s)``."""
    return new if old is None else _first_of_each(pa.concat_tables([old, new]), k)


def _first_of_each(lists: pa.Table, k: int) -> pa.Table:
    """Top ``k`` per query position ``r`` of ``(r, key, s)``, best first."""
    lists = lists.take(pc.sort_indices(lists, [("r", "ascending"), ("s", "descending"), ("key", "ascending")]))
    r = lists["r"].to_numpy()
    return lists.filter(pa.array(np.arange(len(r)) - np.searchsorted(r, r) < k))


class _Top:
    """The ``k`` best points of each query so far, and the score that a further one must reach.

    ``least`` may start at scores that ``k`` points outside of this search reach (-inf: none known).
    """

    def __init__(self, queries: _Block, k: int, least: np.ndarray | None = None):
        self.q, self.k, self.waiting, self.size, self.calls, self.in_order = queries, k, [], 0, 0, True
        self.least = np.full(len(queries), -np.inf) if least is None else least
        self.near, self.over = np.empty(0, np.float32), np.empty(0, bool)
        self.held: pa.Table | None = None

    def add(self, p: _Block, keys: pa.ChunkedArray, start: int, stop: int, rows: np.ndarray) -> None:
        """Points from ``start`` to ``stop``, in key order, meet some of the queries."""
        if self.q.m.shape[1] != p.m.shape[1]:
            raise ValueError("vectors of different sizes in one search")
        self.calls += 1
        n, slack, points, every = stop - start, _slack(self.q), p.unit[start:stop], len(rows) == len(self.q)
        tile = max(1, TILE_CELLS // n)
        for at in range(0, len(rows), tile):
            part = rows[at:at + tile]
            # Written to the same memory each time; fresh pages would cost more than the comparison.
            if self.near.size < len(part) * n:
                self.near, self.over = np.empty(len(part) * n, np.float32), np.empty(len(part) * n, bool)
            near, over = (x[:len(part) * n].reshape(len(part), n) for x in (self.near, self.over))
            np.matmul(self.q.unit[at:at + tile] if every else self.q.unit[part], points.T, out=near)
            cut = self.least[part]
            unknown = np.isneginf(cut)
            if unknown.any():
                cut[unknown] = _reached(near[unknown], self.k)
            np.greater_equal(near, (cut - slack).astype(np.float32)[:, None], out=over)
            some = np.flatnonzero(over.any(axis=1))
            if not len(some):
                continue
            r, c = np.divmod(np.flatnonzero(over if len(some) == len(part) else over[some]), n)
            r, c = part[some[r]], c + start
            s = _exact(self.q, p, r, c)
            order = np.lexsort((c, -s, r))
            order = order[s[order] >= self.least[r[order]]]
            r, c, s = r[order], c[order], s[order]
            keep = np.arange(len(r)) - np.searchsorted(r, r) < self.k
            self.waiting.append(pa.table({"r": r[keep], "key": keys.take(pa.array(c[keep])), "s": s[keep]}))
            self.size += int(keep.sum())
            if self.size >= min(WAITING, 2 * self.k * len(self.q)) or len(self.waiting) >= WAITING_TABLES:
                self.settle()

    def settle(self) -> None:
        """Merge what waits into the lists of the queries that it belongs to."""
        if not self.waiting:
            return
        new, rest = pa.concat_tables(self.waiting), []
        self.waiting, self.size = [], 0
        if self.held is not None:
            met = np.zeros(len(self.q), bool)
            met[new["r"].to_numpy()] = True
            met = met[self.held["r"].to_numpy()]
            rest, new = [self.held.filter(pa.array(~met))], pa.concat_tables([self.held.filter(pa.array(met)), new])
        if rest or self.calls > 1:  # what one call finds is in order
            new = _first_of_each(new, self.k)
        r, s = new["r"].to_numpy(), new["s"].to_numpy()
        full = np.arange(len(r)) - np.searchsorted(r, r) == self.k - 1
        self.least[r[full]] = np.maximum(self.least[r[full]], s[full])
        self.held, self.in_order = pa.concat_tables([*rest, new]).combine_chunks(), not rest

    def hits(self, qcols: list[str], pcol: str) -> Iterator[pa.RecordBatch]:
        self.settle()
        if self.held is not None:
            best = self.held if self.in_order else _first_of_each(self.held, self.k)
            found = _as_hits(self.q.table, qcols, pcol, best["r"].to_numpy(), best["key"], best["s"].to_numpy())
            yield from found.to_batches(max_chunksize=10_000)


def _by_scope(table: pa.Table, scope: list[str]) -> dict[tuple, pa.Table]:
    """Split a bounded table by scope values; rows keep their order within a scope."""
    if not scope:
        return {(): table}
    table = table.combine_chunks()
    code = np.zeros(len(table), np.int64)
    for name in scope:
        column = table[name].combine_chunks() if isinstance(table[name], pa.ChunkedArray) else table[name]
        coded = column.dictionary_encode(null_encoding="encode")
        code = np.unique(code * (len(coded.dictionary) + 1) + coded.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    cuts = np.flatnonzero(np.diff(code[order], prepend=-1))
    if len(cuts) > 1:
        table = table.take(pa.array(order))
    ends = [*cuts[1:].tolist(), len(order)]
    return {tuple(table[name][a].as_py() for name in scope): table.slice(a, z - a) for a, z in zip(cuts.tolist(), ends)}


# --- strategies --------------------------------------------------------------------------------


class _Join:
    """Column names of one search."""

    def __init__(self, queries, points, k, scope, query_key, point_key, query_vector, point_vector):
        self.k, self.scope = k, list(scope)
        self.qkey, self.pkey, self.qv, self.pv = query_key, point_key, "_qv", "_pv"
        # Fresh column identities, so both sides may come from one table.
        fresh = [F.col(s).alias(s) for s in self.scope]
        # A row without a vector neither asks nor answers.
        self.q = queries.select(*fresh, query_key, F.col(query_vector).alias("_qv")).where(F.col("_qv").isNotNull())
        self.p = points.select(*fresh, point_key, F.col(point_vector).alias("_pv")).where(F.col("_pv").isNotNull())
        self.qcols = [*self.scope, query_key]
        self.schema = T.StructType(
            [self.q.schema[c] for c in self.qcols]
            + [self.p.schema[point_key], T.StructField("score", T.DoubleType()), T.StructField("rank", T.IntegerType())]
        )

    def ranked(self, hits: DataFrame) -> DataFrame:
        """Global top ``k`` over block top lists."""
        w = Window.partitionBy(*self.qcols).orderBy(F.desc("score"), F.asc(self.pkey))
        return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= self.k)


def _rows_within(side: DataFrame, key: str, vector: str, max_bytes: int, max_rows: int | None = None) -> bool:
    """Proof that a side fits, from one aggregate over it: its rows, largest vector and keys."""
    size = side.agg(F.count(F.lit(1)).alias("rows"), F.max(F.size(vector)).alias("dim"),
                    F.sum(F.octet_length(F.col(key).cast("string"))).alias("keys")).head()
    bytes_needed = size["rows"] * (4 * max(size["dim"] or 1, 1) + 64) + (size["keys"] or 0)
    return bytes_needed <= max_bytes and (max_rows is None or size["rows"] <= max_rows)


def _rows_at_most(table: DataFrame, rows: int) -> pa.Table:
    """A table whose number of rows has a bound, gathered; more rows are an error, not a cut."""
    found = table.limit(rows + 1).toArrow()
    if len(found) > rows:
        raise ValueError(f"more than {rows} rows")
    return found


def _collect_bounded(side: DataFrame, key: str) -> pa.Table:
    """A side that ``_rows_within`` has proven to fit."""
    return _in_key_order(side.toArrow(), key)


def _broadcast_points(j: _Join) -> DataFrame:
    table = _collect_bounded(j.p, j.pkey)
    small = j.q.sparkSession.sparkContext.broadcast(table)
    qcols, pkey, qv, pv, k, scope = j.qcols, j.pkey, j.qv, j.pv, j.k, j.scope

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = {key: _Block(rows, pv) for key, rows in _by_scope(small.value, scope).items()}
        for table in _tables(batches, READ_BYTES):
            for key, rows in _by_scope(table, scope).items():
                if key in groups:
                    yield from _hits(_Block(rows, qv), groups[key], qcols, pkey, k).to_batches(max_chunksize=10_000)

    # Every query meets all points in one task, so the kernel's ranks are final.
    return j.q.mapInArrow(search, j.schema)


def _broadcast_queries(j: _Join) -> DataFrame:
    table = _collect_bounded(j.q, j.qkey)
    small = j.q.sparkSession.sparkContext.broadcast(table)
    qcols, pkey, qv, pv, k, scope = j.qcols, j.pkey, j.qv, j.pv, j.k, j.scope

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = {key: _Block(rows, qv) for key, rows in _by_scope(small.value, scope).items()}
        best: dict[tuple, pa.Table] = {}
        for table in _tables(batches, READ_BYTES):
            for key, rows in _by_scope(table, scope).items():
                if key in groups:
                    rows = _in_key_order(rows, pkey)
                    r, c, s = _best(groups[key], _Block(rows, pv), k)
                    new = pa.table({"r": r, "key": rows[pkey].take(pa.array(c)), "s": s})
                    best[key] = _merge(best.get(key), new, k)
        # One list per query and task, however many points the task has read.
        for key, top in best.items():
            hits = _as_hits(groups[key].table, qcols, pkey, top["r"].to_numpy(), top["key"], top["s"].to_numpy())
            yield from hits.to_batches(max_chunksize=10_000)

    return j.ranked(j.p.mapInArrow(search, j.schema))


def _tables(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Join record batches into tables of about ``size`` bytes."""
    held, held_bytes = [], 0
    for batch in batches:
        held.append(batch)
        held_bytes += batch.nbytes
        if held_bytes >= size:
            table, held, held_bytes = pa.Table.from_batches(held), [], 0
            yield table
    if held:
        yield pa.Table.from_batches(held)


def _rows_of(vector: str) -> list[Column]:
    return [F.count(F.lit(1)).alias("rows"), F.greatest(F.max(F.size(vector)), F.lit(1)).alias("dim")]


def _cuts(queries: Column, points: Column, dim: Column, block_bytes: int) -> tuple[Column, Column]:
    """Query blocks and point lanes of a scope: a block is bounded in bytes, a stripe in bytes and in work."""
    blocks = F.greatest(F.lit(1.0), F.ceil(queries * dim * 4 / F.lit(float(block_bytes))))
    in_block = F.greatest(F.lit(1.0), F.ceil(queries / blocks))
    lane = F.least(F.lit(float(LANE_BLOCKS * block_bytes)) / 4, F.lit(float(LANE_PRODUCTS)) / in_block) / dim
    return blocks.cast("int"), F.ceil(F.greatest(F.lit(1.0), points / F.greatest(lane, F.lit(1.0)))).cast("int")


def _with_cuts(j: _Join, block_bytes: int) -> tuple[DataFrame, DataFrame, bool]:
    """Both sides with the numbers of query blocks and point lanes of their scope, ``_nq`` and ``_lanes``, and
    whether any scope has several lanes.

    Without a scope there are at least as many stripes as the session has cores. With scopes the counts are one
    narrow row per scope, stored once; they are broadcast if their number proves that they fit, else the join is
    a shuffle whose hot scopes Spark splits.
    """
    if not j.scope:
        q, p = (side.agg(*_rows_of(vector)).head() for side, vector in ((j.q, j.qv), (j.p, j.pv)))
        dim = max(q["dim"] or 1, p["dim"] or 1)
        one = j.q.sparkSession.range(1).select(*(c.alias(n) for c, n in zip(_cuts(
            F.lit(float(q["rows"])), F.lit(float(p["rows"])), F.lit(float(dim)), block_bytes), ("nq", "lanes")))).head()
        cores = j.q.sparkSession.sparkContext.defaultParallelism
        numbers = {"_nq": F.lit(one["nq"]), "_lanes": F.lit(max(one["lanes"], -(-cores // one["nq"])))}
        return j.q.withColumns(numbers), j.p.withColumns(numbers), True
    asked = j.q.groupBy(*j.scope).agg(*_rows_of(j.qv)).withColumnsRenamed({"rows": "_q", "dim": "_qd"})
    there = j.p.groupBy(*j.scope).agg(*_rows_of(j.pv)).withColumnsRenamed({"rows": "_p", "dim": "_pd"})
    blocks, lanes = _cuts(F.col("_q"), F.col("_p"), F.greatest("_qd", "_pd"), block_bytes)
    sizes = stage(asked.join(there, j.scope).select(*j.scope, blocks.alias("_nq"), lanes.alias("_lanes")), "stripe-counts")
    seen = sizes.agg(F.count(F.lit(1)).alias("scopes"), F.max("_lanes").alias("lanes")).head()
    if seen["scopes"] <= BROADCAST_SCOPES:
        sizes = F.broadcast(sizes)
    return j.q.join(sizes, j.scope), j.p.join(sizes, j.scope), (seen["lanes"] or 1) > 1


def _queries_first(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Table | None, Iterator[pa.RecordBatch]]:
    """A stripe's queries, which come first, and the batches of its points; none if there are none of either."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        n = int(pc.sum(pc.invert(batch["_point"])).as_py() or 0)
        if n:
            held.append(batch.slice(0, n))
        if n < batch.num_rows:
            return (pa.Table.from_batches(held) if held else None), itertools.chain([batch.slice(n)], batches)
    return None, iter(())


def _named(table: pa.Table, qcols: list[str], qkey: str) -> _Block:
    """A stripe's queries as a block, their key by its name."""
    return _Block(table.select([*(c if c != qkey else "_qk" for c in qcols), "_v"]).rename_columns([*qcols, "_v"]), "_v")


def _one_stripe(batches: Iterator[pa.RecordBatch], qcols: list[str], qkey: str, pkey: str, k: int,
                block_bytes: int) -> Iterator[pa.RecordBatch]:
    """Top lists of a stripe's queries, which come first; its points follow in key order.

    Held are the queries, one table of points, of ``READ_BYTES`` or of ``block_bytes`` if that is less, one
    list of ``k`` per query, and hits that wait to enter them.
    """
    table, batches = _queries_first(batches)
    if table is None:
        return
    top = _Top(_named(table, qcols, qkey), k)
    del table
    rows = np.arange(len(top.q))
    for points in _tables(batches, min(block_bytes, READ_BYTES)):
        top.add(_Block(points, "_v"), points["_pk"], 0, len(points), rows)
    yield from top.hits(qcols, pkey)


def _runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Each batch cut where the values of some columns change, with these values."""
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for name in names:
            code = batch[name].dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            new[1:] |= code[1:] != code[:-1]
        cuts = np.flatnonzero(new)
        values = zip(*(batch[name].take(pa.array(cuts)).to_pylist() for name in names))
        for key, a, z in zip(values, cuts.tolist(), [*cuts[1:].tolist(), batch.num_rows]):
            yield key, batch.slice(a, z - a)


def _in_large_batches(batches: Iterator[pa.RecordBatch], rows: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Small batches joined until they have some rows."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=rows)
            held, size = [], 0
    if size:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=rows)


def _grid(j: _Join, block_bytes: int) -> tuple[DataFrame, bool]:
    """Top lists per stripe, and whether a query can have several."""
    q, p, several = _with_cuts(j, max(block_bytes, STRIPE_BYTES))

    def slot(key: str, n: str) -> Column:
        return F.pmod(F.xxhash64(key), F.col(n)).cast("int")

    def each(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    def typed(schema: T.StructType, name: str) -> Column:
        return F.lit(None).cast(schema[name].dataType)

    q = q.withColumns({"_qb": slot(j.qkey, "_nq"), "_lane": each("_lanes")})
    p = p.withColumns({"_lane": slot(j.pkey, "_lanes"), "_qb": each("_nq")})
    cell = [*j.scope, "_qb", "_lane"]
    rows = q.select(*cell, F.lit(False).alias("_point"), F.col(j.qkey).alias("_qk"), typed(j.p.schema, j.pkey).alias("_pk"),
                    F.col(j.qv).alias("_v")).unionByName(
        p.select(*cell, F.lit(True).alias("_point"), typed(j.q.schema, j.qkey).alias("_qk"), F.col(j.pkey).alias("_pk"),
                 F.col(j.pv).alias("_v")))
    qcols, qkey, pkey, k = j.qcols, j.qkey, j.pkey, j.k

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stripes = itertools.groupby(_runs(batches, cell), key=lambda run: run[0])
        return _in_large_batches(itertools.chain.from_iterable(
            _one_stripe((part for _, part in stripe), qcols, qkey, pkey, k, max(block_bytes, READ_BYTES)) for _, stripe in stripes))

    # One exchange and one sort bring a stripe's rows in the order in which it reads them. Stripes are dealt to a
    # bounded number of streams, each read one stripe after the other, since most may be of a few rows.
    rows = rows.withColumn("_deal", F.pmod(F.xxhash64(*cell), F.lit(DEALS)).cast("int"))
    dealt = rows.repartition("_deal").sortWithinPartitions("_deal", *cell, "_point", "_pk")
    return dealt.groupBy("_deal").applyInArrow(search, j.schema), several


def _by_grid(j: _Join, block_bytes: int) -> DataFrame:
    hits, several = _grid(j, block_bytes)
    return j.ranked(hits) if several else hits


def _signatures(df: DataFrame, vector: str, dim: int, tables: int, bits: int, seed: int) -> DataFrame:
    """One row per hash table with the sign pattern of ``bits`` random projections."""
    @F.arrow_udf("array<bigint>")
    def sign(vectors: pa.Array) -> pa.Array:
        planes = np.random.default_rng(seed).standard_normal((dim, tables * bits))
        m, _ = _matrix(vectors)
        if not len(m):
            return pa.array([], pa.list_(pa.int64()))
        on = (m @ planes > 0).reshape(len(m), tables, bits)
        codes = (on * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2)
        offsets = pa.array(np.arange(len(m) + 1) * tables, pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(codes.ravel(), pa.int64()))

    return df.select("*", F.posexplode(sign.asNondeterministic()(vector)).alias("_table", "_code"))


def _lsh(j: _Join, block_bytes: int, tables: int, bits: int | None, seed: int) -> DataFrame:
    first = j.p.select(F.size(j.pv)).head()
    dim = first[0] if first else 1
    if bits is None:
        # Buckets of some thousand points whatever the size of the collection.
        bits = max(4, math.ceil(math.log2(max(1, j.p.count()) / BUCKET_ROWS)))
    scope = [*j.scope, "_table", "_code"]
    near = _Join(
        _signatures(j.q, j.qv, dim, tables, bits, seed), _signatures(j.p, j.pv, dim, tables, bits, seed),
        j.k, scope, j.qkey, j.pkey, j.qv, j.pv,
    )
    # A pair found in several tables has the same exact score each time. The narrow lists are read
    # three times below, so they are stored.
    found = _grid(near, block_bytes)[0].groupBy(*j.qcols, j.pkey).agg(F.max("score").alias("score"))
    found = stage(j.ranked(found), "lsh-hits")
    full = found.where(F.col("rank") == j.k).select(*j.qcols)
    short = j.q.join(full, j.qcols, "left_anti")
    exact = _Join(short, j.p, j.k, j.scope, j.qkey, j.pkey, j.qv, j.pv)
    rest = _by_grid(exact, block_bytes)
    return found.join(full, j.qcols, "left_semi").unionByName(rest)


def knn(
    queries: DataFrame,
    points: DataFrame,
    k: int,
    *,
    filters: dict[str, object] | None = None,
    scope: list[str] | tuple[str, ...] = (),
    strategy: str = "auto",
    query_key: str = "query_uid",
    point_key: str = "uid",
    query_vector: str = "vector",
    point_vector: str = "vector",
    k_column: str | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
    block_bytes: int = BLOCK_BYTES,
    tables: int = 16,
    bits: int | None = None,
    seed: int = 0,
) -> DataFrame:
    """Top ``k`` points per query as ``(scope…, query_key, point_key, score, rank)``.

    Keys must be unique within a scope. Pass stored tables: ``auto`` counts both sides, the grid counts
    rows per scope, and ``lsh`` stores its lists. ``bits`` of a bucket follow from the number of points
    unless given. ``k_column`` names a per-query limit on ``queries``; ``k`` is then its
    upper bound.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    if filters:
        points = points.where(payload_filter(points, filters))
    j = _Join(queries, points, k, scope, query_key, point_key, query_vector, point_vector)
    # A side is gathered only behind the proof that it fits, whoever asked for it.
    if strategy in ("auto", "points") and _rows_within(j.p, j.pkey, j.pv, broadcast_bytes):
        hits = _broadcast_points(j)
    elif strategy in ("auto", "queries") and _rows_within(j.q, j.qkey, j.qv, broadcast_bytes, QUERY_ROWS):
        hits = _broadcast_queries(j)
    elif strategy != "lsh":
        hits = _by_grid(j, block_bytes)
    else:
        hits = _lsh(j, block_bytes, tables, bits, seed)
    if k_column:
        limits = queries.select(*j.qcols, F.greatest(F.lit(1), F.col(k_column)).alias("_k"))
        hits = hits.join(limits, j.qcols).where(F.col("rank") <= F.col("_k")).drop("_k")
    return hits


def with_payload(hits: DataFrame, points: DataFrame, columns: list[str], *, scope=(), point_key="uid") -> DataFrame:
    """Attach payload columns to hits; only the surviving top lists meet the wide table.

    A missing text reads as empty.
    """
    wanted = points.select(*scope, point_key, *columns)
    joined = hits.join(wanted, [*scope, point_key])
    return joined.withColumn("text", F.coalesce("text", F.lit(""))) if "text" in columns else joined


def without_hits(queries: DataFrame, hits: DataFrame, keys: list[str]) -> DataFrame:
    """Queries that no point answered."""
    return queries.join(hits.where(F.col("rank") == 1), keys, "left_anti")
