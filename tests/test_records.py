from datetime import datetime, timedelta

import pytest

from docmatch.operators import ledger, scenario, screen
from docmatch.operators.scenario import Scenario

CASES = [
    ([], "abc", []), (["x"], "abc", []), (["b"], "abc", ["b"]), (["bc", "ab"], "abc", ["bc", "ab"]),
    (["abcd"], "abc", []), (["b"], "", []), (["B"], "abc", []), (["a"], "aaa", ["a"]), (["a", "c", "a"], "abc", ["a", "c", "a"]),
    (["", "c"], "abc", ["", "c"]), (["http://bad.example/path/of/some/length"], "see http://bad.example/path/of/some/length.", 
                                    ["http://bad.example/path/of/some/length"]),
    (["中文字漢中文字漢中文字漢"], "前中文字漢中文字漢中文字漢後", ["中文字漢中文字漢中文字漢"]),
]


@pytest.mark.parametrize("strategy", ["automaton", "grams"])
def test_blacklist_cases(spark, strategy):
    for entries, text, want in CASES:
        bl = spark.createDataFrame(list(enumerate(entries)), "idx int, entry string")
        texts = spark.createDataFrame([("t", text)], "uid string, text string")
        found = screen.hits_by_text(screen.hits(texts, bl, strategy=strategy)).collect()
        assert [r.entries for r in found] == ([want] if want else []), (entries, text)


def test_gram_screening_finds_entries_with_a_common_part_in_a_hot_text_group(spark, monkeypatch):
    stem = "https://common.example.org/the/same/long/beginning/"
    entries = [f"{stem}{i}/end" for i in range(200)] + ["tiny", "no such passage in any of these texts at all"]
    bl = spark.createDataFrame(list(enumerate(entries)), "idx int, entry string")
    rows = [(f"d{i}", f"{'filler ' * (i % 7)}{stem}{i}/end tiny") for i in range(300)]
    rows += [(f"h{i}", f"{stem}7/end") for i in range(150)]
    texts = spark.createDataFrame(rows, "uid string, text string")
    want = {(u, i) for u, t in rows for i, e in enumerate(entries) if e in t}
    for keys in (screen.MAX_SHARED_KEYS, 0):
        monkeypatch.setattr(screen, "MAX_SHARED_KEYS", keys)
        got = [(r.uid, r.idx) for r in screen.hits(texts, bl, strategy="grams").collect()]
        assert len(got) == len(set(got)) and set(got) == want
    monkeypatch.setattr(screen, "MAX_AUTOMATON_ENTRIES", 0)
    with pytest.raises(ValueError):
        screen.hits(texts, bl, strategy="automaton")


@pytest.mark.parametrize("direction, general, forward, reverse, leg, want", [
    ("forward", 5, None, None, "forward", 5), ("forward", 5, 2, 9, "forward", 2), ("reverse", 5, 2, 9, "reverse", 9),
    ("reverse", 5, 2, None, "reverse", 5), ("both", 5, 3, 4, "forward", 3), ("both", 5, 3, 4, "reverse", 4),
    ("forward", 0, None, None, "forward", 1), ("forward", 5, 0, None, "forward", 1),
])
def test_k_selection(spark, direction, general, forward, reverse, leg, want):
    s = Scenario(direction=direction, rag_k=general, rag_k_forward=forward, rag_k_reverse=reverse)
    assert s.k(leg) == want and leg in s.legs()
    df = spark.createDataFrame([(general, forward, reverse, leg)], "rag_k int, rag_k_forward int, rag_k_reverse int, leg string")
    assert df.select(scenario.effective_k(df.leg).alias("k")).first().k == want


def test_scenario_layers_and_checks(spark):
    user = spark.createDataFrame([("p", "REVERSE", None, 7)], "project_id string, direction string, cof_threshold double, rag_k int")
    r = scenario.resolve(user, Scenario(cof_threshold=0.6, role_desc="x")).first()
    assert (r.direction, r.cof_threshold, r.rag_k, r.role_desc, r.max_prompt_tokens, r.rag_k_forward) == ("reverse", 0.6, 7, "x", 8000, None)
    for bad in ({"direction": "up"}, {"cof_threshold": 1.1}):
        with pytest.raises(ValueError):
            Scenario(**bad)


T0 = datetime(2024, 5, 1)


def job_rows(spark):
    rows = [("a", "p", "pending", 0), ("a", "p", "running", 10), ("a", "p", "completed", 20), ("b", "p", "pending", 0),
            ("c", "q", "pending", 5), ("c", "q", "failed", 6), ("d", "q", "pending", 60)]
    data = [(j, p, s, T0 + timedelta(seconds=t)) for j, p, s, t in rows]
    return ledger.latest(spark.createDataFrame(data, "job_id string, project_id string, status string, ts timestamp_ntz"))


def test_job_records(spark):
    jobs = job_rows(spark)
    got = {r.job_id: r for r in jobs.collect()}
    assert {j: r.status for j, r in got.items()} == {"a": "completed", "b": "pending", "c": "failed", "d": "pending"}
    assert got["a"].completed_at == T0 + timedelta(seconds=20) and got["a"].failed_at is None
    assert got["c"].failed_at == T0 + timedelta(seconds=6) and got["a"].created_at == T0
    assert {r.job_id for r in ledger.by_project(jobs, "q").collect()} == {"c", "d"}
    assert ledger.by_project(jobs).count() == 4
    kept, purged = ledger.purge(jobs)
    assert ({r.job_id for r in kept.collect()}, {r.job_id for r in purged.collect()}) == ({"b", "d"}, {"a", "c"})


def test_age_limits_are_strict(spark):
    jobs = job_rows(spark)
    at = T0 + timedelta(seconds=100)
    assert {r.job_id for r in ledger.unexpired(jobs, at, 100).collect()} == {"a", "b", "c", "d"}
    assert {r.job_id for r in ledger.unexpired(jobs, at, 99.5).collect()} == {"c", "d"}
    late = {r.job_id: r for r in ledger.apply_timeout(jobs, at, 50).collect()}
    assert (late["b"].status, late["b"].failed_at, late["b"].error) == ("failed", at, "pending timeout")
    assert late["d"].status == "pending" and late["a"].status == "completed"
    assert ledger.apply_timeout(jobs, at, 100).where("status = 'failed'").count() == 1
