"""Clustered points: an exact search that leaves clusters out, and a measured approximate one.

``cluster_points`` gives every point its nearest centroid and the distance to it, and every cluster its radius and
number of rows. Centroids come from k-means on a sample of bounded size, the rows with the lowest hashes of their
keys; assignment, radii and counts cover all rows, so the sample decides how much is left out and never what is
found. Points are stored in ranges of clusters, so that a scan for few clusters reads few row groups.

Queries move in blocks, not once per cluster: a stripe holds a block of queries that lie near each other, each with the
clusters it meets as bits, and the points of all clusters that any of them meets stream past it, cluster by cluster. So
a query is copied once per lane of points, a point at most once per block, however many clusters a query meets.

``knn_clustered`` first searches each query's nearest clusters that hold ``k`` points. The k-th score found is a bound:
a cluster stays out if no point of it can reach the bound, by the triangle inequality between unit vectors or by the
plane half-way between its centroid and the one nearest to the query, on whose other side all its points lie. What is
left is searched, so results equal those of ``search.knn``, ties included. With ``probes`` only so many nearest clusters
are searched (more where they hold fewer than ``k`` points): scores are exact, lists are approximate.

Points of length zero have no direction; they are a cluster of their own that is never left out. Queries of length zero
meet all clusters. Rows without a vector take no part.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmatch.operators import search
from docmatch.operators.search import _matrix
from docmatch.sources.staging import new_path, stage

SAMPLE_ROWS, SAMPLE_BYTES = 65_536, 64 << 20
MAX_CLUSTERS = 4096
ROUNDS = 10
BLOCK_ROWS = 256  # queries of a block at least, or points of a lane, where only idle cores ask for more of them
ASSIGN_CELLS = 1 << 19  # distances that a task holds at once
SLACK = 1e-6  # of distances, far above the rounding of single-precision unit vectors


@dataclass(frozen=True)
class Clustered:
    """Stored points with ``cluster`` and ``distance``, and at most ``MAX_CLUSTERS`` + 1 clusters."""

    points: DataFrame
    clusters: DataFrame  # cluster, centroid, radius, rows


# --- numbers ---------------------------------------------------------------------------------------------

def _units(vectors: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    m, lengths = _matrix(vectors)
    return m / np.where(lengths > 0, lengths, 1.0)[:, None], lengths


def distances(unit: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Between unit vectors and centroids of any length."""
    squares = 1.0 + (centroids * centroids).sum(axis=1) - 2.0 * (unit @ centroids.T)
    return np.sqrt(np.maximum(squares, 0.0))


def k_means(unit: np.ndarray, clusters: int, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of a bounded sample of unit vectors; a cluster that runs empty keeps its centroid."""
    rng = np.random.default_rng(seed)
    found = unit[np.sort(rng.choice(len(unit), clusters, replace=False))]
    for _ in range(rounds):
        nearest = np.concatenate([distances(unit[at:at + 4096], found).argmin(axis=1) for at in range(0, len(unit), 4096)])
        sums, counts = np.zeros_like(found), np.bincount(nearest, minlength=clusters)
        np.add.at(sums, nearest, unit)
        found = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], found)
    return np.unique(found, axis=0)


def lower_bounds(unit: np.ndarray, centroids: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances to the centroids, and what a cluster's points have at least."""
    d = distances(unit, centroids)
    near = d.argmin(axis=1)
    squares = (centroids * centroids).sum(axis=1)
    apart = np.sqrt(np.maximum(squares[near][:, None] + squares - 2.0 * (centroids[near] @ centroids.T), 0.0))
    # Centroids that all but coincide say nothing, and their difference is rounding.
    plane = np.divide(d ** 2 - d[np.arange(len(d)), near][:, None] ** 2, 2 * apart, out=np.zeros_like(d), where=apart > 1e-4)
    return d, np.maximum(np.maximum(d - radius, plane), 0.0)


# --- clusters --------------------------------------------------------------------------------------------

def cluster_points(points: DataFrame, *, key: str = "uid", vector: str = "vector", clusters: int | None = None,
                   sample_rows: int = SAMPLE_ROWS, seed: int = 0) -> Clustered:
    """Cluster and store points. ``clusters`` follows the square root of their number unless given."""
    spark = points.sparkSession
    points = points.where(F.col(vector).isNotNull())
    told = points.agg(F.count(F.lit(1)).alias("rows"), F.max(F.size(vector)).alias("dim")).head()
    dim = max(told["dim"] or 1, 1)
    sample_rows = max(1, min(sample_rows, SAMPLE_BYTES // (4 * dim)))
    wanted = min(MAX_CLUSTERS, clusters or max(1, math.isqrt(told["rows"])))
    sample = points.orderBy(F.xxhash64(key), key).limit(sample_rows).select(vector)
    sample = search._rows_at_most(sample, sample_rows)
    unit, lengths = _units(sample[vector])
    unit = np.unique(unit[lengths > 0], axis=0) if len(unit) else np.zeros((0, dim))
    found = k_means(unit, min(wanted, len(unit)), seed) if len(unit) else np.zeros((0, dim))
    shared = spark.sparkContext.broadcast(found)  # at most MAX_CLUSTERS vectors
    schema = T.StructType([*points.schema.fields, T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.DoubleType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids = shared.value
        for batch in batches:
            step = max(1, ASSIGN_CELLS // max(1, len(centroids)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                unit, lengths = _units(part[vector])
                nearest, far = np.full(len(unit), len(centroids)), np.zeros(len(unit))
                if len(centroids) and len(unit):
                    d = distances(unit, centroids)
                    own = d.argmin(axis=1)
                    nearest = np.where(lengths > 0, own, nearest)
                    far = np.where(lengths > 0, d[np.arange(len(d)), own], 0.0)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(nearest, pa.int32()), pa.array(far)],
                    names=[*part.schema.names, "cluster", "distance"])

    path = new_path(spark, "clustered")
    dealt = points.mapInArrow(assign, schema).repartitionByRange("cluster", key)
    dealt.sortWithinPartitions("cluster", key).write.parquet(path)
    stored = spark.read.schema(schema).parquet(path)
    sizes = search._rows_at_most(stored.groupBy("cluster").agg(
        F.max("distance").alias("radius"), F.count(F.lit(1)).alias("rows")), MAX_CLUSTERS + 1).sort_by("cluster")
    rows = [(c, found[c].tolist() if c < len(found) else None, radius if c < len(found) else None, n)
            for c, radius, n in zip(*(sizes[name].to_pylist() for name in ("cluster", "radius", "rows")))]
    table = spark.createDataFrame(rows, "cluster int, centroid array<double>, radius double, rows bigint")
    return Clustered(stored, stage(table, "clusters"))


# --- search ----------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class _Visits:
    """Which clusters a query meets."""

    numbers: np.ndarray
    centroids: np.ndarray
    places: np.ndarray
    radius: np.ndarray
    rows: np.ndarray
    others: tuple[int, ...]  # clusters without a direction
    k: int
    probes: int

    def first(self, d: np.ndarray) -> np.ndarray:
        """The nearest clusters that hold ``k`` points together, and at least ``probes`` of them."""
        order = np.argsort(d, axis=1, kind="stable")
        before = np.cumsum(self.rows[order], axis=1) - self.rows[order]
        taken = (before < self.k) | (np.arange(d.shape[1]) < self.probes)
        out = np.zeros(d.shape, bool)
        np.put_along_axis(out, order, taken, axis=1)
        return out

    def of(self, unit: np.ndarray, lengths: np.ndarray, scores: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """The place of the nearest centroid among ``places``, and which clusters are met by number: those of the first
        search, or, with the k-th scores (NaN: fewer than k found), those left to search."""
        met = np.zeros((len(unit), max([-1, *self.numbers, *self.others]) + 1), bool)
        if scores is None:
            met[:, list(self.others)] = True
        if not len(self.centroids):
            return np.zeros(len(unit), np.int64), met
        d, least = lower_bounds(unit, self.centroids, self.radius)
        first = self.first(d)
        if scores is not None:
            bound = np.sqrt(np.maximum(2.0 - 2.0 * scores, 0.0))[:, None]
            first = ~first & (np.isnan(bound) | (lengths == 0)[:, None] | (least <= bound + SLACK))
        met[:, self.numbers] = first
        return self.places[d.argmin(axis=1)], met


def _chain(centroids: np.ndarray) -> np.ndarray:
    """The place of each centroid in a chain that goes to the nearest one not yet in it."""
    places, at = np.full(len(centroids), -1), 0
    squares = (centroids * centroids).sum(axis=1)
    for place in range(len(centroids)):
        places[at] = place
        at = int(np.where(places < 0, squares - 2.0 * (centroids @ centroids[at]), np.inf).argmin())
    return places


def _asking(queries: DataFrame, visits: _Visits, vector: str, bound: str | None) -> DataFrame:
    """Queries that meet any cluster, with ``_place`` and, as bits, ``_met``."""
    schema = T.StructType([*queries.schema.fields, T.StructField("_place", T.IntegerType()), T.StructField("_met", T.BinaryType())])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, ASSIGN_CELLS // max(1, len(visits.centroids)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                unit, lengths = _units(part[vector])
                scores = None if bound is None else part[bound].to_numpy(zero_copy_only=False).astype(float)
                place, met = visits.of(unit, lengths, scores)
                some = met.any(axis=1)
                bits = pa.array([row.tobytes() for row in np.packbits(met[some], axis=1)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [*part.filter(pa.array(some)).columns, pa.array(place[some], pa.int32()), bits], names=schema.names)

    return queries.mapInArrow(visit, schema)


def _bits(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _visits(clustered: Clustered, k: int, probes: int | None) -> _Visits:
    told = search._rows_at_most(clustered.clusters, MAX_CLUSTERS + 1).sort_by("cluster").to_pylist()
    real = [r for r in told if r["centroid"] is not None]
    centroids = np.array([r["centroid"] for r in real]) if real else np.zeros((0, 1))
    return _Visits(
        np.array([r["cluster"] for r in real], np.int64), centroids, _chain(centroids),
        np.array([r["radius"] for r in real]), np.array([r["rows"] for r in real], np.int64),
        tuple(r["cluster"] for r in told if r["centroid"] is None), k, probes or 0)


def knn_clustered(queries: DataFrame, clustered: Clustered, k: int, *, probes: int | None = None,
                  scope: list[str] | tuple[str, ...] = (), query_key: str = "query_uid", point_key: str = "uid",
                  vector: str = "vector", block_bytes: int = search.BLOCK_BYTES) -> DataFrame:
    """Top ``k`` points per query as ``(scope…, query_key, point_key, score, rank)``; see the module's text.

    Pass stored queries: they are read for each of the two searches.
    """
    if k < 1 or (probes is not None and probes < 1):
        raise ValueError("k and probes must be at least 1")
    keys = [*scope, query_key]
    asked = queries.select(*keys, vector).where(F.col(vector).isNotNull())
    visits = _visits(clustered, k, probes)
    j = search._Join(asked, clustered.points, k, scope, query_key, point_key, vector, vector)
    found = j.ranked(_striped(asked, clustered, visits, None, scope, query_key, point_key, vector, block_bytes))
    if probes is not None:
        return found
    found = stage(found, "near-hits")
    kth = found.where(F.col("rank") == k).select(*keys, F.col("score").alias("_kth"))
    bounded = asked.join(kth, keys, "left")
    more = _striped(bounded, clustered, visits, "_kth", scope, query_key, point_key, vector, block_bytes)
    return j.ranked(found.unionByName(more))


def _striped(asked: DataFrame, clustered: Clustered, visits: _Visits, bound: str | None, scope, query_key: str,
             point_key: str, vector: str, block_bytes: int) -> DataFrame:
    """Top lists over the clusters that queries meet, one per lane of points. With ``bound`` the lists leave out what
    that score rules out."""
    asking = stage(_asking(asked, visits, vector, bound), "asking")
    asking = asking.withColumn("_bound", F.col(bound) if bound else F.lit(None).cast("double"))
    j = search._Join(asking, clustered.points, visits.k, scope, query_key, point_key, vector, vector)
    fresh = [F.col(s).alias(s) for s in j.scope]
    j.q = asking.select(*fresh, query_key, F.col(vector).alias(j.qv), "_place", "_met", "_bound")
    j.p = clustered.points.select(*fresh, point_key, F.col(vector).alias(j.pv), "cluster")
    q, p = _in_blocks(j, clustered, max(block_bytes, search.STRIPE_BYTES), visits.probes > 0 or bound is not None)
    block = [*j.scope, "_qb"]
    q = q.withColumn("_lane", F.explode(F.sequence(F.lit(0), F.col("_lanes") - 1)))
    p = _meeting(q.where("_lane = 0").select(*block, "_met"), p, block).withColumn(
        "_lane", F.pmod(F.xxhash64(point_key), F.col("_lanes")).cast("int"))
    cell, qcols, k, types = [*block, "_lane"], j.qcols, j.k, {**dict(q.dtypes), **dict(p.dtypes)}

    def side(df: DataFrame, point: bool, **own: str) -> DataFrame:
        """One side's columns; those of the other are null."""
        names = {"_qk": query_key, "_met": "_met", "_bound": "_bound"}, {"_pk": point_key, "_cluster": "cluster"}
        return df.select(*cell, F.lit(point).alias("_point"), F.col(j.pv if point else j.qv).alias("_v"), *(
            (F.col(c) if of == point else F.lit(None).cast(types[c])).alias(n) for of in (False, True) for n, c in names[of].items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stripes = itertools.groupby(search._runs(batches, cell), key=lambda part: part[0])
        return search._in_large_batches(itertools.chain.from_iterable(
            _one_stripe((part for _, part in stripe), qcols, query_key, point_key, k) for _, stripe in stripes))

    rows = side(q, False).unionByName(side(p, True)).withColumn(
        "_deal", F.pmod(F.xxhash64(*cell), F.lit(search.DEALS)).cast("int"))
    dealt = rows.repartition("_deal").sortWithinPartitions("_deal", *cell, "_point", "_cluster", "_pk")
    return dealt.groupBy("_deal").applyInArrow(run, j.schema)


def _in_blocks(j: search._Join, clustered: Clustered, block_bytes: int, many: bool) -> tuple[DataFrame, DataFrame]:
    """Queries with their block ``_qb``, and both sides with the number of ``_lanes``.

    Without a scope blocks follow the chain of clusters, and there are stripes for all cores: one lane where queries meet
    few clusters, else as many lanes as blocks, about. With scopes a scope's queries are dealt by hash.
    """
    spread = F.pmod(F.xxhash64(j.qkey), F.lit(1 << 20)) / float(1 << 20)
    if j.scope:
        q, p, _ = search._with_cuts(j, block_bytes)
        return q.withColumn("_qb", F.floor(spread * F.col("_nq")).cast("int")), p
    told = search._rows_at_most(j.q.groupBy("_place").agg(
        F.count(F.lit(1)).alias("rows"), F.max(F.size(j.qv)).alias("dim")), MAX_CLUSTERS + 1).sort_by("_place")
    rows, dim = told["rows"].to_numpy(), max([1, *told["dim"].to_pylist()])
    total, points = int(rows.sum()), search._rows_at_most(clustered.clusters.select("rows"), MAX_CLUSTERS + 1)["rows"].to_numpy().sum()
    cores = 2 * j.q.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-total * dim * 4 // block_bytes))
    blocks = max(blocks, min(math.ceil(math.sqrt(cores)) if many else cores, total // BLOCK_ROWS))
    lane = min(search.LANE_BLOCKS * block_bytes / 4, search.LANE_PRODUCTS / max(1, total / blocks)) / dim
    lanes = max(1, math.ceil(points / max(1.0, lane)))
    lanes = max(lanes, min(math.ceil(cores / blocks) if many else 1, int(points) // BLOCK_ROWS))
    share = rows / max(1, total)
    places = j.q.sparkSession.createDataFrame(
        list(zip(told["_place"].to_pylist(), (np.cumsum(share) - share).tolist(), share.tolist())), "_place int, _from double, _share double")
    at = F.floor((F.col("_from") + spread * F.col("_share")) * blocks)
    q = j.q.join(F.broadcast(places), "_place").withColumns({
        "_qb": F.least(F.lit(blocks - 1), at).cast("int"), "_lanes": F.lit(lanes)})
    return q, j.p.withColumn("_lanes", F.lit(lanes))


def _meeting(q: DataFrame, p: DataFrame, block: list[str]) -> DataFrame:
    """Points with a row per block that holds a query which meets their cluster."""
    schema = T.StructType([*(q.schema[c] for c in block), T.StructField("cluster", T.IntegerType())])

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def rows() -> pa.RecordBatch:
            which, cluster = np.nonzero(np.unpackbits(np.array(list(held.values())), axis=1))
            columns = list(zip(*held))
            return pa.RecordBatch.from_arrays(
                [*(pa.array(c, f.type).take(pa.array(which)) for c, f in zip(columns, kinds)), pa.array(cluster, pa.int32())], names=names)

        names, kinds = schema.names, None
        for batch in batches:
            kinds = [batch.schema.field(c) for c in block]
            for key, part in search._by_scope(pa.Table.from_batches([batch]), block).items():
                bits = np.bitwise_or.reduce(_bits(part["_met"]), axis=0)
                held[key] = held[key] | bits if key in held else bits
            if len(held) >= BLOCK_ROWS:
                yield rows()
                held = {}
        if held:
            yield rows()

    met = stage(q.mapInArrow(seen, schema).distinct(), "stripe-clusters")
    if met.count() <= search.BROADCAST_SCOPES:
        met = F.broadcast(met)
    return p.join(met, [*block[:-1], "cluster"])


def _one_stripe(batches: Iterator[pa.RecordBatch], qcols: list[str], qkey: str, pkey: str, k: int) -> Iterator[pa.RecordBatch]:
    """Top lists of a stripe's queries, which come first; its points follow by cluster, in key order."""
    table, batches = search._queries_first(batches)
    if table is None:
        return
    met = _bits(table["_met"])
    least = table["_bound"].to_numpy().astype(float)
    top = search._Top(search._named(table, qcols, qkey), k, np.where(np.isnan(least), -np.inf, least))
    del table
    for points in search._tables(batches, search.READ_BYTES):
        block, clusters = search._Block(points, "_v"), points["_cluster"].to_numpy()
        cuts = np.flatnonzero(np.diff(clusters, prepend=-1))
        for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(clusters)]):
            c = int(clusters[a])
            rows = np.flatnonzero(met[:, c >> 3] & (128 >> (c & 7)))
            if len(rows):
                top.add(block, points["_pk"], a, z, rows)
    yield from top.hits(qcols, pkey)


def products(queries: DataFrame, clustered: Clustered, k: int, kth: DataFrame | None = None, *, probes: int | None = None,
             query_key: str = "query_uid", vector: str = "vector") -> tuple[int, int]:
    """Vector products of a search, and of one that leaves nothing out. ``kth`` has the k-th score per query."""
    asked = queries.select(query_key, vector).where(F.col(vector).isNotNull())
    visits = _visits(clustered, k, probes)
    met = _asking(asked, visits, vector, None).select("_met")
    if kth is not None:
        rest = asked.join(kth.select(query_key, F.col("score").alias("_kth")), query_key, "left")
        met = met.unionByName(_asking(rest, visits, vector, "_kth").select("_met"))

    def times(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                counts = np.unpackbits(_bits(batch["_met"]), axis=1).sum(axis=0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(counts)), pa.int32()), pa.array(counts)], names=["cluster", "n"])

    counts = met.mapInArrow(times, "cluster int, n bigint").groupBy("cluster").agg(F.sum("n").alias("n"))
    done = counts.join(clustered.clusters, "cluster").agg(F.sum(F.col("n") * F.col("rows"))).head()[0]
    return done or 0, asked.count() * (clustered.clusters.agg(F.sum("rows")).head()[0] or 0)
