"""Runs of one project side by side, staged tables that go with their run, and counts of what is written."""

import os

from pyspark.sql import Observation
from pyspark.sql import functions as F

from docmatch.operators import collection as col
from docmatch.operators import metrics
from docmatch.operators.scenario import Scenario
from docmatch.plans.match import job_summary, match
from docmatch.sources import staging
from docmatch.streaming.ingest import start_ingest
from tests.test_jobs import EMBED, sure, trees


def run_of(spark, run_id, inputs, references, path=None, **more):
    return match(trees(spark, inputs, references), Scenario(direction="forward"), EMBED, {"m": sure}, default_model="m", dim=32,
                 sleep=lambda i: None, collection_path=path, run_id=run_id, **more)


def test_two_runs_of_one_project_share_a_collection_and_never_meet(spark, tmp_path):
    path = str(tmp_path / "collection")
    one = run_of(spark, "2024/05 #1", ["red apple"], ["red apple pie", "blue"], path)
    two = run_of(spark, "2024/05 #2", ["red apple"], ["green"], path, seq=1)
    assert {(r.project_id, r.run_id, r.uid) for r in one.hits.collect()} == {("p", "2024/05 #1", f"reference-{i}") for i in (0, 1)}
    assert {(r.project_id, r.run_id, r.uid) for r in two.hits.collect()} == {("p", "2024/05 #2", "reference-0")}
    assert [r.run_id for r in two.envelopes.collect()] == ["2024/05 #2"]
    plain = run_of(spark, None, ["red apple"], ["red"], path, seq=2)
    assert {r.uid for r in plain.hits.collect()} == {"reference-0"} and "run_id" not in plain.hits.columns
    names = col.without_run(col.current(col.read_log(spark, path))).groupBy("project_id", "run_id").count().collect()
    assert {(r.project_id, r.run_id, r["count"]) for r in names} == {("p", "2024/05 #1", 2), ("p", "2024/05 #2", 1), ("p", None, 1)}


def test_staged_tables_of_a_run_are_removed_by_its_name(spark):
    made = run_of(spark, "done", ["a b"], ["a"])
    other = run_of(spark, "open", ["a b"], ["a"])
    folder = staging._folder(spark, "done").removeprefix("file:")
    assert made.predictions.count() == 1 and len(os.listdir(folder)) >= 3
    assert staging.remove_run(spark, "done") and not os.path.exists(folder)
    assert other.predictions.count() == 1 and not staging.remove_run(spark, "never was")
    with staging.staged_by("done"):
        pass
    assert "run-" not in staging.new_path(spark, "x")


def test_counts_of_a_job_equal_its_tables(spark):
    made = run_of(spark, None, ["red apple", "blue sky", ""], ["blue sky today"])
    (told,) = job_summary(made).collect()
    assert (made.counts["queries"], made.counts["failed"]) == (told.queries, told.failed)
    assert (made.counts["points"], made.counts["input_points"], made.counts["reference_points"]) == (4, 3, 1)
    assert made.counts["calls"] == made.answers.agg(F.sum("attempts")).first()[0]


def test_counts_of_a_written_log_equal_the_collection(spark, tmp_path):
    path, seen = str(tmp_path / "log"), Observation()
    rows = spark.createDataFrame([("p", "input", "a", "text"), ("p", "reference", "b", "längst"), ("p", "input", None, "x"), ("p", "input", "c", None)],
                                 "project_id string, side string, uid string, text string")
    col.ingest(rows, path, EMBED, 0, dim=32, observation=seen)
    by_side = {r.side: r.points for r in col.counts(col.current(col.read_log(spark, path))).collect()}
    assert seen.get == {"points": 2, "input_points": by_side["input"], "reference_points": by_side["reference"], "deletions": 0,
                        "rejects": col.rejects(col.read_log(spark, path)).count(), "longest_text_bytes": 7}
    gone = Observation()
    col.append_log(col.deletes(spark.createDataFrame([("p", "x")], "project_id string, orig_sid string"), 1), path, observation=gone)
    assert gone.get["deletions"] == 1 and gone.get["points"] == 0
    over = Observation()
    rows.observe(over, metrics.oversize_metric(4)).count()
    assert over.get == {"oversize": 1}


def test_counts_of_each_batch_of_a_stream(spark, tmp_path):
    seen = {}
    source = str(tmp_path / "trees")
    trees(spark, ["one", "two"], ["three"]).write.parquet(source)
    stream = spark.readStream.schema("project_id string, doc_id string, side string, raw string").parquet(source)
    start_ingest(stream, str(tmp_path / "log"), EMBED, dim=32, depth=1, chunk_size=0, checkpoint=str(tmp_path / "ck"),
                 on_counts=seen.__setitem__).awaitTermination()
    assert sum(c["points"] for c in seen.values()) == 3 == col.current(col.read_log(spark, str(tmp_path / "log"))).count()
    assert sum(c["input_points"] for c in seen.values()) == 2
