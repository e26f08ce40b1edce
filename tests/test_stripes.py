"""Stripes of the exact search: one query block, any number of points, bounded memory."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docmatch.operators import search
from tests.test_search import brute, found, plan, tables

DIM, K = 16, 4


def stripe(n_batches, batch_rows=2000, n_queries=50, peak=None):
    """The batches of one stripe as Spark sends them, made when they are asked for."""
    rng = np.random.default_rng(n_batches)
    names = ["_point", "_qk", "_pk", "_v"]

    def vectors(n):
        flat = pa.array(rng.standard_normal(n * DIM).astype(np.float32))
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * DIM), flat)

    def batch(n, point, keys):
        other = pa.nulls(n, pa.string())
        both = (other, pa.array(keys)) if point else (pa.array(keys), other)
        return pa.RecordBatch.from_arrays([pa.array([point] * n), *both, vectors(n)], names=names)

    yield batch(n_queries, False, [f"q{i:03}" for i in range(n_queries)])
    for b in range(n_batches):
        if peak is not None:
            peak.append(pa.total_allocated_bytes())
        yield batch(batch_rows, True, [f"p{b:05}-{i:05}" for i in range(batch_rows)])


def run(batches, block_bytes=1 << 18):
    return list(search._one_stripe(batches, ["query_uid"], "query_uid", "uid", K, block_bytes))


def test_a_stripe_of_many_blocks_equals_one_product():
    (hits,) = run(stripe(12))
    whole = list(stripe(12))
    q = np.stack(whole[0]["_v"].to_pylist()).astype(float)
    p = np.concatenate([np.stack(b["_v"].to_pylist()) for b in whole[1:]]).astype(float)
    keys = [k for b in whole[1:] for k in b["_pk"].to_pylist()]
    cosines = (q @ p.T) / np.linalg.norm(q, axis=1)[:, None] / np.linalg.norm(p, axis=1)
    want = [(f"q{i:03}", keys[c], r + 1) for i in range(len(q)) for r, c in enumerate(np.argsort(-cosines[i])[:K])]
    assert list(zip(*(hits[c].to_pylist() for c in ("query_uid", "uid", "rank")))) == want


def test_memory_of_a_stripe_does_not_grow_with_its_points():
    tops = []
    for n in (40, 400):
        seen = []
        run(stripe(n, peak=seen))
        tops.append(max(seen[4:]) - seen[0])
    assert tops[1] <= tops[0] + (1 << 18)


def test_queries_and_points_in_one_batch_and_stripes_without_points():
    first, second = stripe(1)
    assert run(iter([pa.Table.from_batches([first, second]).combine_chunks().to_batches()[0]]))[0].num_rows == 50 * K
    assert run(iter([first])) == [] and run(iter([second])) == [] and run(iter([])) == []


@pytest.mark.parametrize("scope", [[], ["g"]])
def test_points_are_copied_once_per_query_block(spark, scope, monkeypatch):
    queries, points = tables(spark, 64, 300)
    monkeypatch.setattr(search, "LANE_BLOCKS", 2)  # lanes of 64 points
    same = (lambda a, b: a.g == b.g) if scope else (lambda a, b: True)
    assert found(search.knn(queries, points, 3, scope=scope, strategy="grid", block_bytes=1024)) == brute(queries, points, 3, same)
    j = search._Join(queries, points, 3, scope, "query_uid", "uid", "vector", "vector")
    q, p, several = search._with_cuts(j, 1024)
    blocks = {r._nq for r in p.select("_nq").distinct().collect()}
    per_scope = 64 if not scope else 22
    assert several and blocks == {-(-per_scope * 8 * 4 // 1024)}
    lanes = {r._lanes for r in q.select("_lanes").distinct().collect()}
    assert max(lanes) > 1 and max(lanes) <= 8


def test_small_query_blocks_share_a_stripe(spark, monkeypatch):
    """What is shuffled does not follow from the size of a block: all points are copied once per stripe."""
    queries, points = tables(spark, 64, 300)
    copies, cuts = [], search._with_cuts

    def seen(j, size):
        q, p, several = cuts(j, size)
        copies.append(p.agg(F.max("_nq")).head()[0])
        return q, p, several

    monkeypatch.setattr(search, "_with_cuts", seen)
    assert found(search.knn(queries, points, 3, strategy="grid", block_bytes=64)) == brute(queries, points, 3)
    assert copies == [1]
    monkeypatch.setattr(search, "STRIPE_BYTES", 1024)
    assert found(search.knn(queries, points, 3, strategy="grid", block_bytes=64)) == brute(queries, points, 3)
    assert copies == [1, 2]


def test_whole_lists_are_not_ranked_again(spark):
    """With one lane per scope a stripe's list is final: rows move once, and are sorted once."""
    queries, points = tables(spark)
    shown = plan(search.knn(queries, points, 3, scope=["g"], strategy="grid"), "simple")
    assert "Window" not in shown and "FlatMapGroupsInArrow" in shown
    body = shown[shown.index("FlatMapGroupsInArrow"):]
    assert len(re.findall(r"Sort \[", body)) == 1 and len(re.findall(r"Exchange hashpartitioning", body)) == 1


def test_keys_of_other_types(spark):
    queries, points = tables(spark, 10, 40)
    q = queries.withColumn("query_uid", F.substring("query_uid", 2, 9).cast("int"))
    p = points.withColumn("uid", F.substring("uid", 2, 9).cast("bigint"))
    hits = search.knn(q, p, 3, strategy="grid")
    assert [f.dataType.simpleString() for f in hits.schema][:2] == ["int", "bigint"]
    assert hits.count() == 30
