"""Filters over payload keys: what they match, and what the scan leaves out."""

import pytest
from pyspark.sql import functions as F

from docmatch.operators import collection as col
from docmatch.operators import payload, search

SCHEMA = "project_id string, side string, uid string, text string, vector array<float>, extra map<string,string>"


def write(spark, path, rows, seq=0):
    points = spark.createDataFrame([("p", "input", u, "t", [1.0], e) for u, e in rows], SCHEMA)
    col.append_log(col.upserts(col.prepare_points(points), seq), path)


def uids(spark, path, **filters):
    return sorted(r.uid for r in col.current(col.read_log(spark, path), filters).collect())


ROWS = [("a", {"n": "1", "flag": "true", "name": "x"}), ("b", {"n": "1.0", "flag": "false"}), ("c", {"n": "1.4", "name": "True"}),
        ("d", None), ("e", {}), ("f", {"n": "9007199254740993", "name": ""}), ("g", {"n": None, "flag": "1"}),
        ("h", {f"k{i}": str(i) for i in range(60)}), ("i", {"n": "-0.0"}), ("j", {"n": "NaN"}), ("k", {"odd key.`": "é 'q'"})]
FILTERS = [({"n": 1}, "ab"), ({"n": 1.0}, "ab"), ({"n": "1"}, "a"), ({"n": 1.4}, "c"), ({"n": 9007199254740993}, "f"),
           ({"n": 9007199254740992}, ""), ({"flag": True}, "a"), ({"flag": False}, "b"), ({"flag": 1}, "g"), ({"name": "x"}, "a"),
           ({"name": "True"}, "c"), ({"name": ""}, "f"), ({"none": "x"}, ""), ({"none": 0}, ""), ({"n": None}, ""), ({"n": 0}, "i"),
           ({"n": 1, "flag": True}, "a"), ({"n": 1, "flag": "x"}, ""), ({"k7": 7}, "h"), ({"k59": "59"}, "h"), ({"uid": "d"}, "d"),
           ({"uid": 5}, ""), ({"odd key.`": "é 'q'"}, "k"), ({}, "abcdefghijk")]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("payload") / "log")
    write(spark, path, ROWS)
    return path


@pytest.mark.parametrize("filters,want", FILTERS)
def test_values_by_kind_with_and_without_marks(spark, stored, filters, want):
    assert "".join(uids(spark, stored, **filters)) == want
    bare = col.read_log(spark, stored).drop("marks")
    assert "".join(sorted(r.uid for r in bare.where(search.payload_filter(bare, filters)).collect())) == want


def read_rows(df):
    """Rows that a plan's only scan gave out."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().get("numOutputRows").get().value()


@pytest.mark.parametrize("value", [3, "g3"])
def test_a_key_that_nobody_named_prunes_files(spark, tmp_path, value):
    path = str(tmp_path / "log")
    for i in range(8):
        held = i if isinstance(value, int) else f"g{i}"
        write(spark, path, [(f"u{i}-{j}", {"batch": str(held), "row": str(j)}) for j in range(20)], i)
    log = col.read_log(spark, path)
    found = log.where(payload.payload_filter(log, {"batch": value})).select("uid")
    assert found.count() == 20
    assert read_rows(log.where(payload.payload_filter(log, {"batch": value})).select("uid")) == 20
    assert read_rows(log.where(payload.payload_filter(log, {"other": 3})).select("uid")) == 0
    assert read_rows(log.select("uid")) == 160
    from tests.test_search import plan

    shown = plan(col.current(log, {"batch": value})).replace("\n", " ")
    assert shown.count("In(marks.m") == 2


def test_marks_of_keys_that_share_slots(spark):
    """More keys than slots: marks are mixed, and filters still find what the map holds."""
    df = spark.createDataFrame([({f"k{i}": str(i) for i in range(200)},), ({"k1": "1"},), (None,)], "extra map<string,string>")
    rows = [r.m for r in df.select(payload.marks(F.col("extra")).alias("m")).collect()]
    assert set(rows[0]) == {payload.MIXED} and set(rows[2]) == {0}
    assert sorted(map(bool, rows[1])) == [False] * (payload.SLOTS - 2) + [True] * 2


def test_an_older_version_does_not_pass_for_a_newer_one(spark, tmp_path):
    path = str(tmp_path / "log")
    write(spark, path, [("a", {"lang": "en"}), ("b", {"lang": "en"})])
    write(spark, path, [("a", {"lang": "fr"})], 1)
    assert uids(spark, path, lang="en") == ["b"] and uids(spark, path, lang="fr") == ["a"]
