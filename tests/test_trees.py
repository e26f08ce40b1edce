import json
import uuid

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docmatch.functions import text as tx
from docmatch.functions.ids import uuid5
from docmatch.operators import hierarchy, validate
from docmatch.sources import trees as src


def frame(spark, *trees, side="input"):
    rows = [(f"d{i}", side, t if isinstance(t, str) else json.dumps(t, ensure_ascii=False)) for i, t in enumerate(trees)]
    return spark.createDataFrame(rows, "doc_id string, side string, raw string")


def node(sid, text, level=None, *children):
    out = {"sid": sid, "text": text}
    if level:
        out[f"level{level}"] = list(children)
    return out


def root(*items):
    return {"level1": list(items)}


def flat(spark, tree, depth, **kw):
    rows = hierarchy.flatten(frame(spark, tree), depth, **kw).orderBy("doc_id", "pos").collect()
    return [(r.orig_sid, r.uid, r.text) for r in rows]


DEEP = root(node("a", "A", 2, node("b", "B", 3, node("c", "C", 4, node("d", "D", 5, node("e", "E"))))))
RAGGED = root(node("p", "P"), node("q", "Q", 2, node("r", "R")), node("s", "S", 2), node("t", "T", 2, node("u", "U", 3, node("v", ""))))


@pytest.mark.parametrize("depth, uid, text", [
    (1, "input-a", "A"), (2, "input-a_b", "A\nB"), (3, "input-a_b_c", "A\nB\nC"),
    (5, "input-a_b_c_d_e", "A\nB\nC\nD\nE"), (9, "input-a_b_c_d_e", "A\nB\nC\nD\nE"),
])
def test_flatten_takes_as_many_levels_as_asked(spark, depth, uid, text):
    assert flat(spark, DEEP, depth) == [("a", uid, text)]


@pytest.mark.parametrize("depth, levels", [(1, 1), (2, 1), (3, 2), (5, 4)])
def test_flatten_as_coded_counts_one_level_less(spark, depth, levels):
    assert flat(spark, DEEP, depth, as_coded=True) == flat(spark, DEEP, levels)


def test_flatten_ends_paths_early_and_keeps_order(spark):
    assert flat(spark, RAGGED, 3) == [
        ("p", "input-p", "P"), ("q", "input-q_r", "Q\nR"), ("s", "input-s", "S"), ("t", "input-t_u_v", "T\nU\n"),
    ]


@pytest.mark.parametrize("tree, want", [
    ({}, []), ({"level1": []}, []), ({"level1": "x"}, []), ("not json", []),
    (root({}), [("", "input-", "")]),
    (root({"sid": "k", "level2": "no list"}), [("k", "input-k", "")]),
    ('{"level1":[{"sid":"x"}],"level1":[{"sid":"y","text":"last key"}]}', [("y", "input-y", "last key")]),
])
def test_flatten_of_incomplete_trees(spark, tree, want):
    assert flat(spark, tree, 2) == want


def test_flatten_extra_keys_side_and_spread(spark):
    tree = root({"sid": "1", "text": "t", "lang": "en", "n": 3, "level2": []})
    df = hierarchy.flatten(frame(spark, tree, side="reference"), 2, keep_extra=True, spread=3)
    row = df.first()
    assert row.extra == {"lang": "en", "n": "3"} and row.uid == "reference-1" and row.side == "reference"
    assert "extra" not in hierarchy.flatten(frame(spark, tree), 2).columns


def codes(spark, tree, **kw):
    rows = validate.violations(frame(spark, tree), **kw).orderBy("ord").collect()
    return [(r.path, r.code) for r in rows]


VIOLATIONS = [
    (RAGGED, []), (DEEP, []), (root(), []),
    ("oops", [("root", "unparsable")]),
    ([1], [("root", "root_not_object")]), ("null", [("root", "root_not_object")]), ('"s"', [("root", "root_not_object")]),
    ({}, [("root/level1", "level1_missing")]),
    ({"level1": None}, [("root/level1", "level_not_list")]),
    ({"level1": {"sid": "x"}}, [("root/level1", "level_not_list")]),
    (root(node("a", "A") | {"level2": 5}), [("root/level1[0]/level2", "level_not_list")]),
    (root(node("a", "A", 2, node("b", "B") | {"level3": None})), [("root/level1[0]/level2[0]/level3", "level_not_list")]),
    (root(7, node("a", "A", 2, "x", node("b", "B", 3, []))), [
        ("root/level1[0]", "item_not_object"), ("root/level1[1]/level2[0]", "item_not_object"),
        ("root/level1[1]/level2[1]/level3[0]", "item_not_object")]),
    (root({"sid": 1, "text": None}), [("root/level1[0]", "sid_not_string"), ("root/level1[0]", "text_not_string")]),
    (root({"text": "only"}, {"sid": "only"}), [("root/level1[0]", "sid_not_string"), ("root/level1[1]", "text_not_string")]),
    (root({"sid": "a", "level2": [{"text": "t", "level3": 0}]}, 1), [
        ("root/level1[0]", "text_not_string"), ("root/level1[0]/level2[0]", "sid_not_string"),
        ("root/level1[0]/level2[0]/level3", "level_not_list"), ("root/level1[1]", "item_not_object")]),
]


def test_violations_with_paths_in_depth_first_order(spark):
    df = frame(spark, *[tree for tree, _ in VIOLATIONS])
    got = {f"d{i}": [] for i in range(len(VIOLATIONS))}
    for r in validate.violations(df).orderBy("doc_id", "ord").collect():
        got[r.doc_id].append((r.path, r.code))
    assert list(got.values()) == [want for _, want in VIOLATIONS]
    good, bad = validate.split_valid(df)
    assert {r.doc_id for r in good.select("doc_id").collect()} == {d for d, v in got.items() if not v}
    assert {r.doc_id for r in bad.select("doc_id").collect()} == {d for d, v in got.items() if v}


def test_max_depth_ignores_what_lies_below(spark):
    tree = root(node("a", "A", 2, node("b", "B", 3, 9)))
    assert codes(spark, tree, max_depth=2) == []
    assert codes(spark, tree, max_depth=3) == codes(spark, tree, max_depth=99) != []
    assert validate.split_valid(frame(spark, tree), 2)[0].count() == 1


tree_items = st.deferred(lambda: st.lists(st.one_of(
    st.integers(), st.fixed_dictionaries({}, optional={
        "sid": st.one_of(st.text("ab", max_size=2), st.integers()), "text": st.one_of(st.text("xy", max_size=3), st.none()),
        "level2": st.one_of(st.none(), st.lists(st.fixed_dictionaries({}, optional={
            "sid": st.text("ab", max_size=2), "text": st.one_of(st.booleans(), st.text("z", max_size=2)), "level3": st.integers()}), max_size=2))})),
    max_size=3))


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.fixed_dictionaries({}, optional={"level1": tree_items}), min_size=1, max_size=20))
def test_boolean_validity_agrees_with_the_violations(spark, trees):
    df = frame(spark, *trees)
    bad = {r.doc_id for r in validate.violations(df).select("doc_id").distinct().collect()}
    assert {r.doc_id for r in validate.split_valid(df)[1].collect()} == bad


def python_chunks(text, size):
    if size <= 0 or len(text) <= size:
        return [text]
    return [text[i:i + size] for i in range(0, len(text), size)]


def test_chunks(spark):
    texts = ["", "abc", "abcd", "abcdefgh", "中文字漢", "a😀b😀c", "x\ny\r\nz w"]
    cases = [(t, n) for t in texts for n in (-1, 0, 1, 3, 4)]
    df = spark.createDataFrame(cases, "t string, n int")
    got = df.select("t", "n", tx.chunks(F.col("t"), F.col("n")).alias("c")).collect()
    for r in got:
        assert r.c == python_chunks(r.t, r.n) and "".join(r.c) == r.t
    fixed = df.where("n = 3").select("t", tx.chunks(F.col("t"), 3).alias("c")).collect()
    assert [r.c for r in fixed] == [python_chunks(r.t, 3) for r in fixed]


def test_chunk_ids(spark):
    df = spark.createDataFrame([("o", "g", "g", "abcde")], "orig_sid string, group_uid string, uid string, text string")
    rows = hierarchy.chunk(df, 2).orderBy("chunk_no").collect()
    assert [(r.uid, r.sid, r.group_uid, r.orig_sid, r.text) for r in rows] == [
        (f"g_c{i}", f"g_c{i}", "g", "o", t) for i, t in enumerate(["ab", "cd", "e"])]
    whole = hierarchy.chunk(df, 0).first()
    assert (whole.uid, whole.sid, whole.text) == ("g", None, "abcde")
    assert [r.oversize for r in hierarchy.flag_oversize(df, 4).collect()] == [True]


def test_strip_fence(spark):
    want = {
        "[1]": "[1]", " \u3000[1]\n\t": "[1]", "```json\n[1]\n```": "[1]", "```\n[1]": "[1]", "[1]\n```": "[1]",
        "```[1]```": "", "```": "", "a```b```": "a```b", "```x\na```b": "a```b", "": "", "```a\n\n [1] ``` ": "[1]",
        "````": "", "a\n```\n```": "a\n```",
    }
    df = spark.createDataFrame([(t,) for t in want], "t string")
    assert {r.t: r.o for r in df.select("t", tx.strip_fence(F.col("t")).alias("o")).collect()} == want


@pytest.mark.parametrize("n, want", [(-1, "a😀bc"), (0, "a😀bc"), (2, "a😀"), (9, "a😀bc")])
def test_truncate(spark, n, want):
    df = spark.createDataFrame([("a😀bc",)], "t string")
    assert df.select(tx.truncate_chars(F.col("t"), n).alias("o")).first().o == want


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(max_size=20), min_size=1, max_size=50))
def test_uuid5_equals_python(spark, names):
    names = [n.encode("utf-8", "ignore").decode() for n in names]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r.u for r in df.select(uuid5(F.col("n")).alias("u")).collect()]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_DNS, n)) for n in names]


def test_read_trees_by_line_and_by_file(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"level1":[]}\n\nbroken\n')
    lines = src.read_trees(spark, str(tmp_path), "input")
    good, bad = src.split_parsable(lines)
    assert (good.count(), bad.count()) == (1, 1)
    files = tmp_path / "files"
    files.mkdir()
    (files / "t.json").write_text('{\n "level1": [{"sid": "1",\n "text": "x"}]\n}')
    assert hierarchy.flatten(src.read_trees(spark, str(files), "reference", "file"), 1).first().uid == "reference-1"
    with pytest.raises(ValueError):
        src.read_trees(spark, str(files), "input", "table")
    with pytest.raises(Exception):
        src.read_trees(spark, str(tmp_path / "none"), "input").count()


def test_requests_need_every_part(spark, tmp_path):
    full = {"job_id": "j", "project_id": "p", "scenario": {"rag_k": 1}, "input_data": root(node("1", "x")), "reference_data": root()}
    rows = [full, full | {"input_data": {}}, full | {"project_id": ""}, {k: v for k, v in full.items() if k != "scenario"}]
    (tmp_path / "r.json").write_text("\n".join(map(json.dumps, rows)))
    good, bad = src.split_complete(src.read_requests(spark, str(tmp_path)))
    assert good.count() == 1
    assert sorted(r.missing[0] for r in bad.collect()) == ["input_data", "project_id", "scenario"]
    trees = src.request_trees(good).orderBy("side").collect()
    assert [(t.side, t.doc_id) for t in trees] == [("input", "j/input"), ("reference", "j/reference")]
    assert json.loads(trees[0].raw) == root(node("1", "x"))


def test_small_row_checks(spark):
    s = spark.createDataFrame(
        [("a", "Both", 1, None, 0.0), ("b", "up", 0, 2, 1.5), ("c", None, None, 0, None)],
        "project_id string, direction string, rag_k int, rag_k_forward int, cof_threshold double")
    got = {(r.project_id, r.field) for r in validate.scenario_violations(s).collect()}
    assert got == {("b", "direction"), ("b", "rag_k"), ("b", "cof_threshold"), ("c", "rag_k_forward")}
    ids = spark.createDataFrame([("ok_1-A",), ("no way",), ("",), ("ümlaut",)], "project_id string")
    assert [r.project_id for r in validate.valid_project_ids(ids).collect()] == ["ok_1-A"]
    v = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, []), (4, None)], "id int, vector array<float>")
    assert {r.id: r.reason for r in validate.vector_rejects(v, 2).collect()} == {2: "wrong_size", 3: "empty_vector", 4: "empty_vector"}


def test_ingestable_rows_and_strict_batches(spark):
    rows = spark.createDataFrame([(1, "u", "t"), (1, None, "t"), (2, "v", "t"), (3, "w", None)], "b int, uid string, text string")
    good, bad = validate.split_ingestable(rows)
    assert good.count() == 2 and {r.reason for r in bad.collect()} == {"missing_uid", "missing_text"}
    good, bad = validate.split_ingestable(rows, ["b"])
    assert [r.uid for r in good.collect()] == ["v"]
    assert sorted(r.reason for r in bad.collect()) == ["batch_rejected", "missing_text", "missing_uid"]


def test_levels_below_the_fifth_and_a_depth_column_with_a_maximum(spark):
    tree = {"sid": "6", "text": "six"}
    for level in range(5, 0, -1):
        tree = {"sid": str(level), "text": "t", f"level{level + 1}": [tree]}
    df = spark.createDataFrame([(json.dumps({"level1": [tree]}), "input", 6)], "raw string, side string, depth int")
    (row,) = hierarchy.flatten(df, 6).collect()
    assert row.uid == "input-1_2_3_4_5_6" and row.text.endswith("six")
    assert hierarchy.flatten(df, F.col("depth"), max_depth=6).first().uid == row.uid
    with pytest.raises(Exception, match="above max_depth"):
        hierarchy.flatten(df, F.col("depth")).collect()


def test_flatten_takes_a_tree_apart_once(spark):
    """A list taken out of a variant is a copy of all that is below it, so no level may take its own."""
    rows = hierarchy.flatten(frame(spark, DEEP), 6)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("variant_get(") == 1


def test_flatten_of_bad_nodes_at_any_level(spark):
    bad = [7, "x", None, [], {"sid": 3, "text": ["t"]}, {"text": None, "level3": "no list"}, {"sid": "k", "level3": [None, 1.5, {"sid": "m"}]}]
    for depth in (2, 3, 4):
        tree = root(*bad, {"sid": "a", "level2": bad})
        # With keep_extra each level is taken out of the one above.
        assert flat(spark, tree, depth) == flat(spark, tree, depth, keep_extra=True)
