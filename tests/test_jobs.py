import json
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from docmatch.operators import collection as col
from docmatch.operators.models import hash_embedder
from docmatch.operators.scenario import Scenario
from docmatch.operators.validate import split_valid
from docmatch.plans.match import job_summary, match, match_requests, text_rows
from docmatch.sources import staging
from docmatch.sources.trees import write_results
from docmatch.streaming.ingest import start_ingest
from docmatch.streaming.jobs import job_state

EMBED = hash_embedder(32)


def trees(spark, inputs, references, project="p"):
    rows = []
    for side, texts in (("input", inputs), ("reference", references)):
        for i, t in enumerate(texts):
            raw = json.dumps({"level1": [{"sid": str(i), "text": t}]}) if isinstance(t, str) else json.dumps(t)
            rows.append((project, f"{project}-{side}-{i}", side, raw))
    return spark.createDataFrame(rows, "project_id string, doc_id string, side string, raw string")


def sure(prompt):
    """Answer with the first candidate."""
    uid = prompt.split("uid=")[1].split(" ")[0]
    return json.dumps([{"input_uid": "asked", "ref_uid": uid, "confidence": 0.9}, {"ref_uid": uid, "confidence": 0.1}])


def run(df, direction="forward", fn=sure, **kw):
    options = {k: kw.pop(k) for k in list(kw) if k in ("as_coded", "max_parallel_calls", "strategy", "dedupe", "collection_path", "seq")}
    return match(df, Scenario(direction=direction, **kw), EMBED, {"m": fn}, default_model="m", dim=32, sleep=lambda i: None, **options)


def test_forward_match_end_to_end(spark):
    df = trees(spark, ["red apple pie", "blue sky"], ["blue sky today", "apple pie red hot"])
    r = run(df)
    got = {p.query_uid: p for p in r.predictions.collect()}
    assert {q: p.ref_uid for q, p in got.items()} == {"input-0": "reference-1", "input-1": "reference-0"}
    assert got["input-0"].similarity_score == pytest.approx(3 / np.sqrt(12)) and got["input-0"].confidence == 0.9
    env = r.envelopes.orderBy("query_uid").collect()
    assert [(e.leg, e.root_uid, e.model_used, e.used_k, len(e.predictions)) for e in env] == [
        ("forward", "input-0", "m", 2, 1), ("forward", "input-1", "m", 2, 1)]
    assert [tuple(x) for x in job_summary(r).collect()] == [("p", "forward", 2, 0, 2)]


def test_both_runs_two_legs_and_swaps_the_reverse_one(spark):
    df = trees(spark, ["a b", "c d"], ["a b x"])
    r = run(df, "both", rag_k_forward=1, rag_k_reverse=2)
    rows = {(p.leg, p.query_uid): p for p in r.predictions.collect()}
    assert set(rows) == {("forward", "input-0"), ("forward", "input-1"), ("reverse", "reference-0")}
    back = rows["reverse", "reference-0"]
    assert (back.input_uid, back.ref_uid) == ("input-0", "asked") and back.similarity_score > 0.8
    coded = {(p.leg, p.query_uid): p for p in run(df, "both", as_coded=True).predictions.collect()}
    assert coded["reverse", "reference-0"].ref_uid == "input-0"
    only = run(df, "reverse")
    assert {p.query_uid for p in only.predictions.collect()} == {"reference-0"}


def test_projects_do_not_mix_and_bad_trees_are_set_aside(spark):
    df = trees(spark, ["a b", {"level1": "bad"}], ["a b c"]).unionByName(trees(spark, ["a b"], ["z a"], "other"))
    r = run(df, rag_k=5)
    assert {(h.project_id, h.uid) for h in r.hits.collect()} == {("p", "reference-0"), ("other", "reference-0")}
    assert [t.doc_id for t in r.rejected_trees.collect()] == ["p-input-1"]
    assert run(trees(spark, ["a"], [])).envelopes.count() == 0


def test_chunked_queries_failures_and_options(spark):
    calls = spark.sparkContext.accumulator(0)

    def fails_on_x(prompt):
        calls.add(1)
        if "x" in prompt.split("# Query")[1].split("#")[0]:
            raise RuntimeError("no")
        return sure(prompt)

    df = trees(spark, ["aa bb xx cc"], ["aa bb", "cc"])
    r = run(df, fn=fails_on_x, chunk_size=6, max_parallel_calls=2, strategy="grid", dedupe=True)
    env = r.envelopes.collect()
    assert {e.query_uid for e in env} == {"input-0_c0"} and {e.root_uid for e in env} == {"input-0"}
    assert r.predictions.count() == 1 and job_summary(r).first().failed == 1
    for _ in range(2):
        r.envelopes.count()
    assert calls.value == 4, "one call for the good chunk and three attempts for the bad one, never repeated"


def test_requests_run_with_their_own_scenarios(spark, tmp_path):
    deep = {"level1": [{"sid": "0", "text": "red", "level2": [{"sid": "1", "text": "apple pie"}, {"sid": "2", "text": "blue sky"}]}]}
    refs = {"level1": [{"sid": str(i), "text": t} for i, t in enumerate(["red apple pie", "blue sky", "other words", "sky"])]}
    scenarios = {
        "a": {"direction": "forward", "rag_k": 1, "input_depth": 2},
        "b": {"direction": "both", "rag_k_forward": 3, "rag_k_reverse": 1, "chunk_size": 7, "cof_threshold": 0.05},
        "c": {"direction": "Reverse", "rag_k": 2, "input_depth": 2, "reference_depth": 1},
        "bad": {"direction": "sideways", "rag_k": 0},
    }
    rows = [{"job_id": j, "project_id": "p", "scenario": s, "input_data": deep, "reference_data": refs} for j, s in scenarios.items()]
    rows.append({"job_id": "part", "project_id": "p", "scenario": {"rag_k": 1}, "input_data": deep})
    (tmp_path / "r.json").write_text("\n".join(map(json.dumps, rows)))
    from docmatch.sources.trees import read_requests
    options = {"default_model": "m", "dim": 32, "sleep": lambda i: None}
    result, rejected = match_requests(read_requests(spark, str(tmp_path)), EMBED, {"m": sure}, **options)
    assert {r.job_id: (r.missing, r.broken) for r in rejected.collect()} == {
        "bad": (None, ["direction", "rag_k"]), "part": (["reference_data"], None)}

    def shown(df):
        return sorted((e.leg, e.project_id, e.query_uid, e.root_uid, e.used_k, str(e.predictions)) for e in df.collect())

    want = []
    for job in "abc":
        trees_of_job = spark.createDataFrame(
            [(job, f"{job}/{s}", s, json.dumps(t)) for s, t in (("input", deep), ("reference", refs))],
            "project_id string, doc_id string, side string, raw string")
        want += shown(run(trees_of_job, **scenarios[job]).envelopes)
    assert shown(result.envelopes) == sorted(want) and len(want) > 8


def test_ten_documents_give_ten_envelopes_into_a_kept_collection(spark):
    path = staging.new_path(spark, "kept")
    df = trees(spark, [f"doc {i}" for i in range(10)], ["doc", "other"])
    assert run(df, collection_path=path).envelopes.count() == 10
    again = run(trees(spark, ["new one"], []), collection_path=path, seq=1, max_prompt_tokens=2000)
    assert [e.query_uid for e in again.envelopes.collect()] == ["input-0"], "only this job's rows ask"
    assert {h.uid for h in again.hits.collect()} == {"reference-0", "reference-1"}, "they search what is kept"
    other = run(trees(spark, ["third"], ["own"], project="q"), collection_path=path, seq=2, max_prompt_tokens=2000)
    assert [(e.project_id, e.query_uid) for e in other.envelopes.collect()] == [("q", "input-0")]
    assert {h.uid for h in other.hits.collect()} == {"reference-0"}, "of their own project"
    kept = col.current(col.read_log(spark, path)).select("project_id", "side").distinct().collect()
    assert {(r.project_id, r.side) for r in kept} == {("p", "reference"), ("q", "reference")}, "only the searched side"


def test_results_are_written_by_project(spark, tmp_path):
    r = run(trees(spark, ["ä b"], ["ä c"]))
    write_results(r.envelopes, str(tmp_path / "out"))
    (file,) = (tmp_path / "out" / "project_id=p").glob("*.json")
    assert json.loads(file.read_text())["predictions"][0]["ref_uid"] == "reference-0"


class FakeSession:
    """A session with chosen settings."""

    def __init__(self, conf, master="local[1]"):
        self.conf, self.sparkContext, self.master, self.checkpoint = conf, self, master, None

    def setCheckpointDir(self, path):
        self.checkpoint = path

    def getCheckpointDir(self):
        return self.checkpoint


def test_staging_uses_the_sessions_folder(spark):
    assert staging.stage_root(FakeSession({staging.CHECKPOINT_DIR: "/shared/x/"})) == "/shared/x"
    local = FakeSession({})
    assert staging.stage_root(local) == staging.stage_root(local) == local.checkpoint
    with pytest.raises(ValueError):
        staging.stage_root(FakeSession({}, "spark://host:7077"))
    named = spark.conf.get(staging.CHECKPOINT_DIR, None)
    assert not named or staging.new_path(spark, "x").startswith(named.rstrip("/"))
    assert staging.stage(spark.range(3), "x").count() == 3


def test_streamed_ingest_equals_batch_and_survives_a_replay(spark, tmp_path):
    df = trees(spark, [f"text {i} " * 9 for i in range(20)], ["ref"])
    df.repartition(5).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    path = str(tmp_path / "log")

    def start(checkpoint):
        start_ingest(stream, path, EMBED, dim=32, depth=1, chunk_size=40, checkpoint=str(tmp_path / checkpoint)).awaitTermination()

    def stored():
        return sorted((r.uid, r.side, r.text, r.vector) for r in col.current(col.read_log(spark, path)).collect())

    start("c1")
    batch = str(tmp_path / "batch")
    col.ingest(text_rows(split_valid(df)[0], Scenario(chunk_size=40)), batch, EMBED, 0, dim=32)
    want = sorted((r.uid, r.side, r.text, r.vector) for r in col.current(col.read_log(spark, batch)).collect())
    assert stored() == want
    start("c1")
    start("c2")
    assert stored() == want


def test_job_stream_reports_states_and_pending_timeouts(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    schema = "job_id string, project_id string, status string, ts timestamp"
    batches = [
        [("a", "p", "pending", 0), ("b", "p", "pending", 0), ("c", "p", "pending", 0)],
        [("a", "p", "running", 10), ("c", "p", "completed", 20)],
        [("a", "p", "completed", 5000), ("d", "p", "pending", 5001)],
        [("e", "p", "pending", 5002)],
    ]
    src = tmp_path / "in"
    for n, rows in enumerate(batches):
        data = [(j, p, s, t0 + timedelta(seconds=t)) for j, p, s, t in rows]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(str(src / f"n={n}"))
    stream = spark.readStream.schema(schema + ", n int").option("maxFilesPerTrigger", 1).parquet(str(src)).drop("n")
    out = job_state(stream, watermark="10 seconds", timeout_seconds=3600)
    (out.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out"))
     .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination())
    got = spark.read.parquet(str(tmp_path / "out"))
    failed = got.where("timed_out").collect()
    assert [(r.job_id, r.status) for r in failed] == [("b", "failed")]
    last = {r.job_id: r.status for r in got.groupBy("job_id").agg(
        F.max_by("status", F.struct("updated_at", "timed_out")).alias("status")).collect()}
    assert last == {"a": "completed", "b": "failed", "c": "completed", "d": "pending", "e": "pending"}


@pytest.mark.parametrize("bound", [1, 2])
def test_requests_store_their_scenarios(spark, tmp_path, monkeypatch, bound):
    """Every later step joins them, so none reads the requests again for it. Only a bounded number is broadcast."""
    from docmatch.operators import search
    from docmatch.plans import match as plan
    from docmatch.sources.trees import read_requests

    tree = {"level1": [{"sid": "t", "text": "red apple"}]}
    asked = [{"job_id": j, "project_id": "p", "scenario": {"rag_k": k}, "input_data": tree, "reference_data": tree}
             for j, k in (("a", 1), ("b", 2))]
    (tmp_path / "r.json").write_text("\n".join(map(json.dumps, asked)))
    given = []
    monkeypatch.setattr(search, "BROADCAST_SCOPES", bound)
    monkeypatch.setattr(plan, "match", lambda trees, scenario, *args, **options: given.append(scenario))
    plan.match_requests(read_requests(spark, str(tmp_path)), EMBED, {"m": sure}, default_model="m", dim=32)
    files = given[0].inputFiles()
    assert files and all("/scenarios-" in f and f.endswith(".parquet") for f in files)
    assert {(r.project_id, r.rag_k) for r in given[0].collect()} == {("a", 1), ("b", 2)}
    joined = plan._with_scenario(spark.range(9).selectExpr("string(id) project_id"), given[0], ["rag_k", "role_desc"])
    assert ("BroadcastHashJoin" in joined._jdf.queryExecution().toString()) == (bound == 2)
