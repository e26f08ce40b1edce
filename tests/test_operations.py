"""A stream of typed operations: changes in any order, replays, questions, and what is set aside."""

import json

from docmatch.operators import collection as col
from docmatch.operators.scenario import Scenario
from docmatch.streaming import operations
from tests.test_jobs import EMBED, sure

OPTIONS = {"dim": 32, "depth": 2, "chunk_size": 0}


def tree(*texts):
    return json.dumps({"level1": [{"sid": str(i), "text": t} for i, t in enumerate(texts)]})


def op(seq, kind, project="p", **parts):
    row = {"seq": seq, "op": kind, "project_id": project, **parts}
    return tuple(row.get(f) for f in operations.SCHEMA.names)


def frame(spark, ops):
    return spark.createDataFrame(ops, operations.SCHEMA)


def live(spark, path):
    return sorted((r.project_id, r.uid, r.text) for r in col.current(col.read_log(spark, path)).collect())


CHANGES = [
    op(1, "upsert", side="reference", doc_id="d", raw=tree("red apple", "blue sky", "old")),
    op(5, "delete", orig_sid="2"), op(3, "update", side="reference", uid="reference-1", text="blue sea", orig_sid="1"),
    op(2, "update", side="reference", uid="reference-1", text="too old", orig_sid="1"),
    op(6, "update", side="reference", uid="reference-2", text="new", orig_sid="2"),
    op(7, "upsert", "q", side="reference", doc_id="d", raw=tree("other project")),
]
AFTER = [("p", "reference-0", "red apple"), ("p", "reference-1", "blue sea"), ("p", "reference-2", "new"), ("q", "reference-0", "other project")]
BAD = [op(20, "merge"), op(None, "delete", orig_sid="1"), op(21, "delete", project="a/b", orig_sid="1"), op(22, "delete"),
       op(23, "upsert", side="left", raw=tree("x")), op(24, "upsert", side="input", raw="{"), op(25, "upsert", side="input", raw='{"level1": 5}'),
       op(26, "update", uid="u"), op(27, "ask", side="input", raw=tree("who"))]
WHY = {20: "unknown_op", None: "missing_seq", 21: "bad_project_id", 22: "missing_orig_sid", 23: "bad_side", 24: "not_json",
       25: "invalid_tree", 26: "missing_text", 27: "nobody_answers"}


def test_operations_in_any_order_and_replayed_leave_the_same_collection(spark, tmp_path):
    path, aside = str(tmp_path / "log"), str(tmp_path / "aside")
    operations.apply_batch(frame(spark, CHANGES[3:] + BAD), 0, path, EMBED, quarantine=aside, **OPTIONS)
    operations.apply_batch(frame(spark, CHANGES[:3]), 1, path, EMBED, quarantine=aside, **OPTIONS)
    assert live(spark, path) == AFTER
    for _ in range(2):
        operations.apply_batch(frame(spark, CHANGES[3:] + BAD), 0, path, EMBED, quarantine=aside, **OPTIONS)
    assert live(spark, path) == AFTER
    told = spark.read.parquet(aside).collect()
    assert {r.seq: r.reason for r in told} == WHY and len(told) == len(BAD)
    assert {r.raw for r in told if r.seq in (24, 25)} == {"{", '{"level1": 5}'}


def test_a_stream_writes_and_asks_against_the_collection_as_of_its_batch(spark, tmp_path):
    source, path = str(tmp_path / "ops"), str(tmp_path / "log")
    batches = [[op(1, "upsert", side="reference", doc_id="r", raw=tree("red apple pie")), op(2, "ask", side="input", doc_id="i", raw=tree("apple pie"))],
               [op(3, "upsert", side="reference", doc_id="s", raw=json.dumps({"level1": [{"sid": "9", "text": "apple pie"}]})),
                op(4, "ask", side="input", doc_id="i", raw=tree("apple pie"))],
               [op(5, "delete", orig_sid="9"), op(6, "ask", side="input", doc_id="i", raw=tree("apple pie"))]]
    asking = operations.Asking(Scenario(direction="forward"), {"m": sure}, "m", str(tmp_path / "results"), {"sleep": lambda i: None})
    seen = []
    for i, ops in enumerate(batches):
        frame(spark, ops).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(operations.SCHEMA).parquet(source)
        operations.start_operations(stream, path, EMBED, checkpoint=str(tmp_path / "ck"), quarantine=str(tmp_path / "aside"),
                                    asking=asking, after=seen.append, **OPTIONS).awaitTermination()
    found = spark.read.parquet(str(tmp_path / "results")).collect()
    assert seen == [0, 1, 2]
    assert {r.batch: r.ref_uid for r in found} == {0: "reference-0", 1: "reference-9", 2: "reference-0"}
    assert spark.read.parquet(str(tmp_path / "aside")).count() == 0
    assert {uid for _, uid, _ in live(spark, path)} == {"reference-0"}, "questions are not kept"
