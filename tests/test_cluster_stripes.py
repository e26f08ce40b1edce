"""Clustered search: what is shuffled does not follow from the number of clusters that queries meet."""

import numpy as np
import pyarrow as pa
import pytest

from docmatch.operators import clusters, search
from tests.test_search import found

K, DIM, QUERIES, POINTS = 5, 8, 1000, 2000


def random_tables(spark):
    """Vectors without structure: no cluster can be left out."""
    rng = np.random.default_rng(8)
    q, p = rng.standard_normal((QUERIES, DIM)), rng.standard_normal((POINTS, DIM))
    p[:50], q[:20] = p[0], p[0]  # ties
    return (spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(q)], "query_uid string, vector array<float>"),
            spark.createDataFrame([(f"p{i}", v.tolist()) for i, v in enumerate(p)], "uid string, vector array<float>"))


@pytest.mark.parametrize("probes", [None, 60])
def test_copies_do_not_grow_with_the_clusters_met(spark, monkeypatch, probes):
    queries, points = random_tables(spark)
    dealt, kind = [], type(queries)
    before = kind.repartition

    def repartition(self, *by):
        if by == ("_deal",):
            dealt.append(self.count())
        return before(self, *by)

    monkeypatch.setattr(kind, "repartition", repartition)
    made = clusters.cluster_points(points, clusters=80)
    hits = found(clusters.knn_clustered(queries, made, K, probes=probes))
    done, every = clusters.products(queries, made, K, probes=60)
    assert dealt and max(dealt) <= 4 * (QUERIES + POINTS), "not a row for each cluster that a query meets"
    best = found(search.knn(queries, points, K))
    if probes is None:
        assert hits == best
    else:
        assert len(hits) == len(best) and len({x[:2] for x in hits} & {x[:2] for x in best}) >= 0.9 * len(best)
        assert done > 0.5 * every


def test_queries_that_no_further_cluster_can_serve_do_not_move(spark, monkeypatch):
    rng = np.random.default_rng(9)
    middle = rng.standard_normal((10, DIM))
    rows = [(i, (middle[i % 10] + 0.001 * rng.standard_normal(DIM)).tolist()) for i in range(1200)]
    queries = spark.createDataFrame([(f"q{i}", v) for i, v in rows[:200]], "query_uid string, vector array<float>")
    points = spark.createDataFrame([(f"p{i}", v) for i, v in rows], "uid string, vector array<float>")
    made = clusters.cluster_points(points, clusters=10)
    kept, asked = clusters._asking, []

    def asking(*args):
        asked.append(kept(*args).count())
        return kept(*args)

    monkeypatch.setattr(clusters, "_asking", asking)
    assert found(clusters.knn_clustered(queries, made, K)) == found(search.knn(queries, points, K))
    assert asked[0] == 200 and asked[1] < 200


def test_top_lists_by_parts_equal_one_product():
    """Any cut of the points into calls, any order of clusters, gives the lists of one product."""
    rng = np.random.default_rng(10)
    def block(n, at=0):
        flat = pa.array(np.round(rng.standard_normal(n * DIM)).astype(np.float32))  # many ties, some without a direction
        return pa.table({"_pk": [f"{at + i:05}" for i in range(n)],
                         "_v": pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * DIM), flat)})

    q, p = search._Block(block(70), "_v"), block(900)
    whole = search._Block(p, "_v")
    want = search._best(q, whole, K)
    for cuts in ([0, 900], [0, 3, 400, 900], [400, 900, 0, 400], list(range(0, 901, 10))):
        top = search._Top(q, K)
        for a, z in zip(cuts, cuts[1:]):
            if a < z:
                top.add(whole, p["_pk"], a, z, np.arange(70))
        top.settle()
        got = search._first_of_each(top.held, K)
        assert (got["r"].to_numpy() == want[0]).all() and (got["s"].to_numpy() == want[2]).all()
        assert got["key"].to_pylist() == [f"{c:05}" for c in want[1]]
