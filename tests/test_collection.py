import uuid

import numpy as np
from pyspark.sql import functions as F

from docmatch.operators import collection as col
from docmatch.operators.models import hash_embedder
from docmatch.sources.staging import new_path

EMBED = hash_embedder(8)


def rows(spark, *items):
    data = [(i.get("project", "p"), i.get("side", "input"), i.get("uid"), i.get("orig"), i.get("text"), [n]) for n, i in enumerate(items)]
    return spark.createDataFrame(data, "project_id string, side string, uid string, orig_sid string, text string, pos array<int>")


def live(spark, path, **kw):
    return {r.uid: r for r in col.current(col.read_log(spark, path, **kw)).collect()}


def test_missing_collection_reads_empty_and_ensure_never_truncates(spark):
    path = new_path(spark, "t")
    assert live(spark, path) == {}
    col.ensure_collection(spark, path)
    col.ensure_collection(spark, path)
    assert live(spark, path) == {}
    col.ingest(rows(spark, {"uid": "a", "text": "x"}), path, EMBED, 1, dim=8)
    col.ensure_collection(spark, path)
    assert set(live(spark, path)) == {"a"}


def test_insert_replace_and_last_of_a_batch_wins(spark):
    path = new_path(spark, "t")
    col.ingest(rows(spark, {"uid": "a", "text": "one"}, {"uid": "b", "text": "b"}, {"uid": "a", "text": "two"}), path, EMBED, 1, dim=8)
    assert live(spark, path)["a"].text == "two"
    col.ingest(rows(spark, {"uid": "a", "text": "three"}), path, EMBED, 2, dim=8)
    points = live(spark, path)
    assert points["a"].text == "three" and points["b"].text == "b"
    assert points["a"].point_id == str(uuid.uuid5(uuid.NAMESPACE_DNS, "a"))
    col.ingest(rows(spark, {"uid": "a", "text": "three"}), path, EMBED, 2, dim=8)
    assert live(spark, path)["a"].text == "three" and len(live(spark, path)) == 2


def test_rejected_rows_are_kept_apart_with_reasons(spark):
    path = new_path(spark, "t")

    def short_for_b(texts):
        return [[] if t == "none" else np.ones(3 if t == "b" else 8) for t in texts]

    col.ingest(rows(spark, {"uid": "a", "text": "a"}, {"text": "x"}, {"uid": "n"}, {"uid": "s", "text": "b"}, {"uid": "e", "text": "none"}),
               path, short_for_b, 1, dim=8)
    assert set(live(spark, path)) == {"a"}
    reasons = sorted(r.reason for r in col.rejects(col.read_log(spark, path)).collect())
    assert reasons == ["empty_vector", "missing_text", "missing_uid", "wrong_size"]


def delete(spark, path, orig, seq, project="p"):
    col.append_log(col.deletes(spark.createDataFrame([(project, orig)], "project_id string, orig_sid string"), seq), path)


def test_delete_removes_every_chunk_of_a_document_on_both_sides(spark):
    path = new_path(spark, "t")
    col.ingest(rows(spark, {"uid": "d_c0", "orig": "d", "text": "1"}, {"uid": "d_c1", "orig": "d", "text": "2"},
                    {"uid": "r", "orig": "d", "text": "3", "side": "reference"}, {"uid": "k", "orig": "k", "text": "4"},
                    {"uid": "other", "orig": "d", "text": "5", "project": "q"}), path, EMBED, 1, dim=8)
    delete(spark, path, "d", 2)
    assert set(live(spark, path)) == {"k", "other"}
    assert set(live(spark, path, project_id="p", side="reference")) == set()
    col.ingest(rows(spark, {"uid": "d_c0", "orig": "d", "text": "again"}), path, EMBED, 3, dim=8)
    assert set(live(spark, path)) == {"k", "other", "d_c0"}


def test_deleting_the_former_document_of_a_point_leaves_it(spark):
    path = new_path(spark, "t")
    col.ingest(rows(spark, {"uid": "a", "orig": "old", "text": "1"}), path, EMBED, 1, dim=8)
    col.ingest(rows(spark, {"uid": "a", "orig": "new", "text": "2"}), path, EMBED, 2, dim=8)
    delete(spark, path, "old", 3)
    assert live(spark, path)["a"].text == "2"
    delete(spark, path, "new", 4)
    assert live(spark, path) == {}


def test_random_logs_equal_a_sequential_replay(spark):
    rng = np.random.default_rng(0)
    ops = [(s, "del" if rng.random() < 0.3 else "put", f"u{rng.integers(12)}", f"o{rng.integers(5)}") for s in range(400)]
    state = {}
    for s, op, uid, orig in ops:
        if op == "put":
            state[uid] = (orig, s)
        else:
            state = {u: v for u, v in state.items() if v[0] != orig}
    df = spark.createDataFrame(ops, "seq long, kind string, uid string, orig_sid string").withColumns(
        {"project_id": F.lit("p"), "side": F.lit("input"), "text": F.lit("t"), "vector": F.lit(None).cast("array<float>")})
    log = col.upserts(col.prepare_points(df.where("kind = 'put'")), F.col("seq")).unionByName(
        col.deletes(df.where("kind = 'del'"), F.col("seq")))
    assert {r.uid: (r.orig_sid, r.seq) for r in col.current(log).collect()} == state


def test_update_replaces_the_whole_payload(spark):
    path = new_path(spark, "t")
    first = rows(spark, {"uid": "a", "orig": "d", "text": "old"}).withColumn("extra", F.create_map(F.lit("k"), F.lit("v")))
    col.ingest(first, path, EMBED, 1, dim=8)
    col.append_log(col.updates(rows(spark, {"uid": "a", "text": "new words"}), EMBED, 2), path)
    a = live(spark, path)["a"]
    assert (a.text, a.extra, a.orig_sid, sum(a.vector)) == ("new words", None, "undefined", 2.0)


def test_lookup_counts_and_compaction(spark):
    path, packed = new_path(spark, "t"), new_path(spark, "t")
    col.ingest(rows(spark, {"uid": "a", "text": "1"}, {"uid": "b", "text": "2", "side": "reference"}), path, EMBED, 1, dim=8)
    col.ingest(rows(spark, {"uid": "a", "text": "3"}), path, EMBED, 2, dim=8)
    ids = spark.createDataFrame([("a",), ("a",), ("zzz",)], "uid string")
    got = col.lookup(col.current(col.read_log(spark, path)), ids).collect()
    assert [(r.uid, r.score, r.text) for r in got] == [("a", 1.0, "3")]
    by = {(r.project_id, r.side): r.points for r in col.counts(col.current(col.read_log(spark, path))).collect()}
    assert by == {("p", "input"): 1, ("p", "reference"): 1}
    col.compact(spark, path, packed)
    assert col.read_log(spark, packed).count() == 2 and live(spark, packed)["a"].text == "3"


def test_ingest_defaults(spark):
    df = spark.createDataFrame([("u", "t")], "uid string, text string")
    for mode, side in [("reference", "reference"), ("input", "input"), ("anything", "input")]:
        r = col.with_defaults(df, mode).first()
        assert (r.side, r.orig_sid, r.group_uid, r.sid) == (side, "undefined", f"{side}-group_???", "u")


def test_reads_are_pruned_to_project_and_side(spark, capsys):
    path = new_path(spark, "t")
    col.ingest(rows(spark, {"uid": "a", "text": "1"}, {"uid": "b", "text": "2", "project": "q"}), path, EMBED, 1, dim=8)
    col.current(col.read_log(spark, path, "p", "input")).explain("formatted")
    shown = capsys.readouterr().out
    assert shown.count("PartitionFilters: [isnotnull(bucket") >= 2 and "project_id,p" in shown
    assert "WindowGroupLimit" in shown


def test_versions_are_resolved_without_texts_and_vectors(spark):
    path = new_path(spark, "t")
    col.ingest(rows(spark, {"uid": "a", "text": "1"}), path, EMBED, 1, dim=8)
    col.ingest(rows(spark, {"uid": "a", "text": "2"}), path, EMBED, 2, dim=8)
    plan = col.live_versions(col.read_log(spark, path))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "Project [" in plan
    scans = [line for line in col.live_versions(col.read_log(spark, path))._jdf.queryExecution().executedPlan().toString().splitlines()
             if "ReadSchema" in line]
    assert scans and not any("vector" in x.split("ReadSchema")[1] or "text" in x.split("ReadSchema")[1] for x in scans)
    (row,) = col.stored_current(col.read_log(spark, path)).collect()
    assert row.text == "2"


def test_many_projects_make_few_folders(spark, tmp_path):
    path = str(tmp_path / "log")
    col.ingest(rows(spark, *({"uid": f"u{i}", "text": "t", "project": f"p{i}"} for i in range(300))), path, EMBED, 1, dim=8, few_files=True)
    assert len(list((tmp_path / "log").glob("bucket=*"))) <= col.BUCKETS
    assert set(live(spark, path, project_id="p7")) == {"u7"}
