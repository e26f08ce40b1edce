"""Clustered points: exact search with pruning, and probes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docmatch.operators import clusters, search
from tests.test_search import brute, found, tables

K = 4


def clouds(spark, n_points=1200, n_queries=60, dim=12, centres=20, spread=0.05, seed=4):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((centres, dim))
    p = middle[rng.integers(0, centres, n_points)] + spread * rng.standard_normal((n_points, dim))
    q = middle[rng.integers(0, centres, n_queries)] + spread * rng.standard_normal((n_queries, dim))
    p[:200], p[200:205], q[0] = p[0], 0, 0  # a hot vector; points and a query without a direction
    return (spark.createDataFrame([(f"g{i % 3}", f"q{i}", v.tolist()) for i, v in enumerate(q)], "g string, query_uid string, vector array<float>"),
            spark.createDataFrame([(f"g{i % 3}", f"p{i}", v.tolist()) for i, v in enumerate(p)], "g string, uid string, vector array<float>"))


@pytest.mark.parametrize("how", [{}, {"clusters": 1}, {"clusters": 300}, {"sample_rows": 30}])
def test_pruned_search_equals_brute_force_and_skips_products(spark, how):
    queries, points = clouds(spark)
    made = clusters.cluster_points(points, **how)
    hits = clusters.knn_clustered(queries, made, K).cache()
    assert found(hits) == brute(queries, points, K)
    done, all_of_them = clusters.products(queries, made, K, hits.where(F.col("rank") == K))
    assert all_of_them == 60 * 1200
    if not how:
        assert done < 0.35 * all_of_them, "four fifths of the hits' products and more are left out, but for the hot vector"


def test_pruned_search_with_scope_blocks_and_vectors_without_structure(spark):
    queries, points = clouds(spark, 400, 30)
    made = clusters.cluster_points(points)
    got = found(clusters.knn_clustered(queries, made, K, scope=["g"], block_bytes=600))
    assert got == brute(queries, points, K, lambda a, b: a.g == b.g)
    q, p = tables(spark)
    assert found(clusters.knn_clustered(q, clusters.cluster_points(p), K)) == brute(q, p, K)


def test_few_points_none_and_missing_vectors(spark):
    q, p = tables(spark, 5, 3)
    assert clusters.knn_clustered(q, clusters.cluster_points(p), 10).count() == 15
    assert clusters.knn_clustered(q, clusters.cluster_points(p.limit(0)), 3).count() == 0
    assert clusters.knn_clustered(q.limit(0), clusters.cluster_points(p), 3).count() == 0
    bare = p.withColumn("vector", F.when(F.col("uid") != "p0", F.col("vector")))
    assert {r.uid for r in clusters.knn_clustered(q, clusters.cluster_points(bare), 10).collect()} == {"p1", "p2"}
    zeros = p.withColumn("vector", F.transform("vector", lambda c: F.lit(0.0).cast("float")))
    assert found(clusters.knn_clustered(q, clusters.cluster_points(zeros), 2)) == brute(q, zeros, 2)
    with pytest.raises(ValueError):
        clusters.knn_clustered(q, clusters.cluster_points(p), 0)


def test_probes_find_most_neighbours_with_exact_scores(spark):
    queries, points = clouds(spark)
    made = clusters.cluster_points(points)
    near = found(clusters.knn_clustered(queries, made, K, probes=3))
    best = brute(queries, points, K)
    assert len(near) == len(best) and len({x[:2] for x in near} & {x[:2] for x in best}) >= 0.9 * len(best)
    done, all_of_them = clusters.products(queries, made, K, probes=3)
    assert done < 0.35 * all_of_them


def test_bounds_are_below_all_distances():
    rng = np.random.default_rng(2)
    unit = rng.standard_normal((500, 6))
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    centroids = clusters.k_means(unit, 12, 0)
    d = clusters.distances(unit, centroids)
    own = d.argmin(axis=1)
    radius = np.array([d[own == c, c].max(initial=0) for c in range(len(centroids))])
    _, least = clusters.lower_bounds(unit[:50], centroids, radius)
    apart = np.linalg.norm(unit[:50, None] - unit[None], axis=2)
    for c in range(len(centroids)):
        assert (least[:, c][:, None] <= apart[:, own == c] + 1e-9).all()


def test_every_row_is_in_a_cluster_with_its_radius(spark):
    _, points = clouds(spark, 300)
    made = clusters.cluster_points(points, sample_rows=50)
    assert made.points.count() == 300
    told = {r.cluster: r for r in made.clusters.collect()}
    assert sum(r.rows for r in told.values()) == 300
    assert all(told[r.cluster].radius is None or r.distance <= told[r.cluster].radius for r in made.points.collect())
    assert sum(r.radius is None for r in told.values()) == 1
