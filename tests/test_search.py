import contextlib
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from docmatch.functions import vectors as vec
from docmatch.operators import search


def plan(df, mode="formatted"):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


def tables(spark, n_queries=60, n_points=300, dim=8, seed=1):
    """A third of the points are copies of one vector and belong to one project."""
    rng = np.random.default_rng(seed)
    q = rng.integers(-3, 4, (n_queries, dim)).astype(float)
    p = rng.integers(-3, 4, (n_points, dim)).astype(float)
    p[: n_points // 3] = p[0]
    q[0] = 0
    queries = [(f"g{i % 3}", f"q{i}", v.tolist()) for i, v in enumerate(q)]
    points = [("g0" if i < n_points // 3 else f"g{i % 3}", f"p{i}", v.tolist(), "abc"[i % 3]) for i, v in enumerate(p)]
    return (
        spark.createDataFrame(queries, "g string, query_uid string, vector array<float>"),
        spark.createDataFrame(points, "g string, uid string, vector array<float>, tag string"),
    )


def brute(queries, points, k, same=lambda q, p: True):
    out = set()
    ps = points.collect()
    for q in queries.collect():
        a = np.array(q.vector)
        scored = []
        for p in ps:
            if same(q, p):
                b = np.array(p.vector)
                n = np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())
                scored.append((-(a @ b / n if n > 0 else 0.0), p.uid))
        out |= {(q.query_uid, uid, r, round(-s, 9) + 0.0) for r, (s, uid) in enumerate(sorted(scored)[:k], 1)}
    return out


def found(hits):
    return {(r.query_uid, r.uid, r["rank"], round(r.score, 9) + 0.0) for r in hits.collect()}


STRATEGIES = [
    {"strategy": "auto"}, {"strategy": "points"}, {"strategy": "queries"}, {"strategy": "grid"},
    {"strategy": "grid", "block_bytes": 500}, {"strategy": "auto", "broadcast_bytes": 10},
]


@pytest.mark.parametrize("how", STRATEGIES)
def test_every_exact_strategy_equals_brute_force_with_ties_and_hot_groups(spark, how):
    q, p = tables(spark)
    assert found(search.knn(q, p, 4, **how)) == brute(q, p, 4)
    got = found(search.knn(q, p, 4, scope=["g"], filters={"tag": "a"}, **how))
    assert got == brute(q, p, 4, lambda a, b: a.g == b.g and b.tag == "a")


def test_fewer_points_than_k_no_points_and_no_queries(spark):
    q, p = tables(spark, 5, 3)
    for how in STRATEGIES:
        assert search.knn(q, p, 10, **how).count() == 15
        assert search.knn(q, p.limit(0), 3, **how).count() == 0
        assert search.knn(q.limit(0), p, 3, **how).count() == 0


def test_lsh_returns_k_exact_scores_and_most_of_the_neighbours(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((30, 16))
    p = [(f"p{i}", (centres[i % 30] + 0.1 * rng.standard_normal(16)).tolist()) for i in range(600)]
    q = [(f"q{i}", (centres[i] + 0.1 * rng.standard_normal(16)).tolist()) for i in range(30)]
    points = spark.createDataFrame(p, "uid string, vector array<float>")
    queries = spark.createDataFrame(q, "query_uid string, vector array<float>")
    exact, near = (found(search.knn(queries, points, 5, strategy=s)) for s in ("grid", "lsh"))
    assert len(near) == len(exact)
    recall = len({x[:2] for x in exact} & {x[:2] for x in near}) / len(exact)
    assert recall > 0.9


def test_lsh_falls_back_to_the_exact_search_for_short_queries(spark):
    q, p = tables(spark, 20, 12)
    assert found(search.knn(q, p, 12, strategy="lsh", tables=1, bits=12)) == brute(q, p, 12)


def test_limit_per_query(spark):
    q, p = tables(spark, 6)
    q = q.withColumn("n", F.substring("query_uid", 2, 1).cast("int"))
    counts = {r.query_uid: r["count"] for r in search.knn(q, p, 9, k_column="n").groupBy("query_uid").count().collect()}
    assert counts == {f"q{i}": max(1, i) for i in range(6)}


def test_bad_arguments(spark):
    q, p = tables(spark, 2, 2)
    with pytest.raises(ValueError):
        search.knn(q, p, 0)
    with pytest.raises(ValueError):
        search.knn(q, p, 1, strategy="magic")


def test_payload_filters(spark):
    p = spark.createDataFrame(
        [("a", "x", {"lang": "en", "n": "1"}), ("b", "x", {"lang": "fr"}), ("c", None, None)],
        "uid string, side string, extra map<string,string>")

    def uids(**filters):
        return [r.uid for r in p.where(search.payload_filter(p, filters)).orderBy("uid").collect()]

    assert uids() == ["a", "b", "c"] and uids(side="x") == ["a", "b"] and uids(side="x", lang="fr") == ["b"]
    assert uids(n=1) == ["a"] and uids(other="x") == []
    bare = p.drop("extra")
    assert bare.where(search.payload_filter(bare, {"lang": "en"})).count() == 0


def test_payload_join_and_unanswered_queries(spark):
    q, p = tables(spark, 4, 9)
    hits = search.knn(q, p, 2, scope=["g"], filters={"g": "g0"})
    missing = search.without_hits(q, hits, ["g", "query_uid"])
    assert {r.query_uid for r in missing.collect()} == {"q1", "q2"}
    texts = p.withColumn("text", F.lit(None).cast("string"))
    assert {r.text for r in search.with_payload(hits, texts, ["text", "tag"], scope=["g"]).collect()} == {""}


def test_cosine_expression(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    assert [round(r.c, 9) for r in df.select(vec.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [0.96, 0.0]


def test_plans_limit_before_the_shuffle_and_prune(spark, tmp_path):
    q, p = tables(spark)
    path = str(tmp_path / "points")
    p.withColumn("wide", F.repeat(F.lit("x"), 100)).write.partitionBy("g").parquet(path)
    stored = spark.read.parquet(path)
    shown = plan(search.knn(q, stored, 3, strategy="grid", filters={"g": "g1"}))
    assert shown.count("WindowGroupLimit") >= 2, "top k must be taken before and after the exchange"
    assert "PartitionFilters: [isnotnull(g" in shown.replace("\n", " ")
    assert "wide" not in shown
    broadcast = plan(search.knn(q, stored, 3, strategy="points"))
    assert "CartesianProduct" not in broadcast and "NestedLoop" not in broadcast


@pytest.mark.parametrize("how", STRATEGIES)
def test_rows_without_a_vector_are_set_aside_and_mixed_sizes_are_an_error(spark, how):
    queries, points = tables(spark, 6, 40)
    none = spark.createDataFrame([("g0", "a-null", None, "a"), ("g1", "z-null", None, "a")], points.schema)
    asked_none = spark.createDataFrame([("g0", "a-null", None)], queries.schema)
    got = search.knn(asked_none.union(queries), none.union(points), 3, **how)
    assert found(got) == brute(queries, points, 3)
    mixed = spark.createDataFrame([("g0", "m2", [1.0, 2.0], "a"), ("g0", "m4", [1.0, 2.0, 3.0, 4.0], "a")], points.schema)
    three = spark.createDataFrame([("g0", "q", [1.0, 2.0, 3.0])], queries.schema)
    with pytest.raises(Exception, match="different sizes"):
        search.knn(three, mixed, 1, **how).collect()


@pytest.mark.parametrize("strategy", ["points", "queries"])
def test_an_asked_for_strategy_gathers_nothing_that_was_not_proven_to_fit(spark, strategy, monkeypatch):
    queries, points = tables(spark, 20, 60)
    monkeypatch.setattr(search, "_collect_bounded", lambda *a: pytest.fail("gathered"))
    assert found(search.knn(queries, points, 3, strategy=strategy, broadcast_bytes=10)) == brute(queries, points, 3)


@pytest.mark.parametrize("scope", [[], ["g"]])
def test_the_grid_multiplies_no_rows_and_reads_its_sources_few_times(spark, tmp_path, scope):
    queries, points = tables(spark, 20, 60)
    for name, df in (("q", queries), ("p", points)):
        df.write.parquet(str(tmp_path / name))
    q, p = (spark.read.parquet(str(tmp_path / n)) for n in "qp")
    shown = plan(search.knn(q, p, 3, scope=scope, strategy="grid"), "simple")
    assert "Cartesian" not in shown and "NestedLoop" not in shown
    assert shown.count("FileScan parquet") <= 4


def test_shuffled_block_counts_give_the_same_rows(spark, monkeypatch):
    queries, points = tables(spark)
    want = found(search.knn(queries, points, 4, scope=["g"], strategy="grid"))
    monkeypatch.setattr(search, "BROADCAST_SCOPES", 0)
    assert found(search.knn(queries, points, 4, scope=["g"], strategy="grid", block_bytes=400)) == want


@pytest.mark.parametrize("deals", [2, 4096])
def test_small_scopes_share_a_stream(spark, monkeypatch, deals):
    """A group is started once for many scopes, wherever batches are cut."""
    monkeypatch.setattr(search, "DEALS", deals)
    rng = np.random.default_rng(3)
    rows = [(f"g{i % 40}" if i % 7 else None, f"p{i}", rng.integers(-3, 4, 8).astype(float).tolist()) for i in range(400)]
    points = spark.createDataFrame(rows, "g string, uid string, vector array<float>")
    queries = points.where("substr(uid, -1) < '4'").withColumnRenamed("uid", "query_uid")
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "7")
    try:
        hits = search.knn(queries, points, 3, scope=["g"], strategy="grid", broadcast_bytes=10)
        assert "FlatMapGroupsInArrow [_deal#" in plan(hits, "simple")
        got = found(hits)
    finally:
        spark.conf.set(size, before)
    # A null scope meets nothing.
    assert got == brute(queries.where("g is not null"), points, 3, lambda q, p: q.g == p.g)
