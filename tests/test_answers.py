import numpy as np
import pytest
from pyspark.sql import functions as F

from docmatch.functions import text as tx
from docmatch.operators import models, predictions, prompt

KEYS = ["q"]


def candidates(spark, *items, header="h" * 10, limit=100):
    rows = [("q", u, s, r, t, len(header) + 1, limit) for r, (u, s, t) in enumerate(items, 1)]
    df = spark.createDataFrame(
        rows, "q string, uid string, score double, rank int, text string, header_tokens int, max_prompt_tokens int")
    queries = spark.createDataFrame(
        [("q", header, len(header) + 1, limit)], "q string, header string, header_tokens int, max_prompt_tokens int")
    lines = prompt.rank_candidates(df, KEYS).withColumn("line", F.col("text"))
    return prompt.assemble(prompt.budget(lines, KEYS), queries, KEYS).first()


A, B, C = ("a", 0.9, "a" * 20), ("b", 0.8, "b" * 30), ("c", 0.7, "c" * 5)


@pytest.mark.parametrize("limit, used, status", [
    (66, 3, "ok"), (65, 2, "ok"), (61, 2, "ok"), (60, 1, "ok"), (30, 0, "no_candidate_fits"), (11, 0, "header_too_long"),
])
def test_budget_keeps_the_longest_prefix(spark, limit, used, status):
    r = candidates(spark, A, B, C, limit=limit)
    assert (r.used_k, r.status) == (used, status)
    texts = [A[2], B[2], C[2]]
    assert r.prompt == ("h" * 10 + "".join(texts[:used]) if used else None)
    assert r.prompt_tokens == (11 + sum(map(len, texts[:used])) if used else None)


def test_candidates_go_by_score_then_retrieval_order(spark):
    r = candidates(spark, ("x", None, "1"), ("y", 0.5, "2"), ("z", 0.5, "3"), ("w", -0.5, "4"))
    assert r.prompt.endswith("2314")


def test_candidate_line_and_word_counter(spark):
    df = spark.createDataFrame([(2, "u", 0.12345, " two  words\n")], "r int, u string, s double, t string")
    c = [F.col(x) for x in "rust"]
    line = df.select(prompt.candidate_line(c[0], c[1], c[2], c[3]).alias("l"), tx.count_words(c[3]).alias("n")).first()
    assert line.l == "[Cand#2] uid=u score=0.123\n two  words\n\n" and line.n == 2


def test_prompt_uses_the_callers_header_and_counter(spark):
    df = spark.createDataFrame([("q", "u", 1.0, 1, "one two three")], "q string, uid string, score double, rank int, text string")
    queries = spark.createDataFrame([("q", "forward", "ask", 8)], "q string, leg string, query_text string, max_prompt_tokens int")
    r = prompt.build_prompts(df, queries, KEYS, header_fn=lambda leg, text: F.concat(leg, F.lit(": "), text, F.lit("\n")),
                             counter=tx.count_words).first()
    assert r.prompt.startswith("forward: ask\n[Cand#1]") and (r.prompt_tokens, r.used_k) == (8, 1)


def parse(spark, raw):
    df = spark.createDataFrame([("q", raw)], "q string, raw_output string")
    return predictions.parse_output(df).orderBy("pred_no").collect()


def test_parse_plain_and_fenced_lists(spark):
    body = '[{"input_uid":"i","ref_uid":"r","input_text":"a","ref_text":"b","evidences":["e"],"start_end_idx":[[0,3]],"confidence":0.5},{}]'
    for raw in (body, f"```json\n{body}\n```", f" {body}\n"):
        one, two = parse(spark, raw)
        assert (one.input_uid, one.ref_uid, one.evidences, one.start_end_idx, one.confidence) == ("i", "r", ["e"], [[0, 3]], 0.5)
        assert (two.evidences, two.start_end_idx, two.confidence, two.item_status) == ([], [], None, "ok")


@pytest.mark.parametrize("raw", ["[]", '{"ref_uid":"r"}', "5", "null", '"text"'])
def test_other_json_gives_no_predictions(spark, raw):
    assert parse(spark, raw) == []


@pytest.mark.parametrize("raw, text", [("sorry", "sorry"), ("```[{}]```", ""), ("[1,", "[1,"), ("", "")])
def test_unparsable_answers_become_plain_text(spark, raw, text):
    (r,) = parse(spark, raw)
    assert (r.plain_text, r.confidence, r.item_status, r.evidences) == (text, 1.0, "ok", [])


def test_bad_items_and_null_fields(spark):
    rows = parse(spark, '[5,{"confidence":"0.9"},{"confidence":null},{"confidence":1},{"evidences":null,"confidence":0.1}]')
    assert [r.item_status for r in rows] == ["bad_item", "bad_item", "bad_item", "ok", "ok"]
    assert rows[3].confidence == 1.0 and rows[4].evidences is None and rows[4].start_end_idx == []


def scored(spark, preds, hits, **kw):
    p = spark.createDataFrame(preds, "q string, pred_no int, leg string, input_uid string, ref_uid string, input_text string, ref_text string, confidence double")
    h = spark.createDataFrame(hits, "q string, uid string, score double, rank int")
    return predictions.attach_scores(predictions.swap_reverse(p), h, KEYS, **kw)


def test_scores_swap_and_threshold(spark):
    hits = [("q", "h1", 0.9, 1), ("q", "h2", 0.8, 2), ("q", "h2", 0.7, 3), ("other", "zz", 0.6, 1)]
    preds = [("q", 0, "forward", "q", "h1", "i", "r", 0.5), ("q", 1, "forward", "q", "h2", None, None, 0.49),
             ("q", 2, "forward", "q", "zz", None, None, None), ("q", 3, "reverse", "q", "h1", "i", "r", 0.7),
             ("none", 0, "forward", None, "h1", None, None, 1.0)]
    df = scored(spark, preds, hits)
    got = {(r.q, r.pred_no): r for r in df.collect()}
    assert got["q", 0].similarity_score == 0.9 and got["q", 1].similarity_score == 0.7
    assert got["q", 2].similarity_score == 0.0 and got["none", 0].similarity_score == 0.0
    r = got["q", 3]
    assert (r.input_uid, r.ref_uid, r.input_text, r.ref_text, r.similarity_score) == ("h1", "q", "r", "i", 0.9)
    coded = {(r.q, r.pred_no): r.similarity_score for r in scored(spark, preds, hits, as_coded=True).collect()}
    assert coded["q", 3] == 0.0 and coded["q", 0] == 0.9
    kept = {(r.q, r.pred_no) for r in predictions.filter_confidence(df, 0.5).collect()}
    assert kept == {("q", 0), ("q", 3), ("none", 0)}
    answers = spark.createDataFrame([("q", 5), ("none", 1), ("empty", 2)], "q string, used_k int")
    env = {r.q: [p.pred_no for p in r.predictions] for r in
           predictions.envelopes(answers, predictions.filter_confidence(df, 0.6), KEYS, ["used_k"]).collect()}
    assert env == {"q": [3], "none": [0], "empty": []}


def test_generation_retries_isolates_failures_and_routes(spark):
    calls = spark.sparkContext.accumulator(0)
    seen = {}

    def flaky(text):
        calls.add(1)
        seen[text] = seen.get(text, 0) + 1
        if text == "bad" or (text == "second" and seen[text] < 2):
            raise ValueError("no")
        return text.upper()

    df = spark.createDataFrame([("ok", None), ("second", " "), ("bad", "m"), ("x", "nobody"), (None, "m")], "prompt string, llm_name string")
    got = {r.prompt: r for r in models.generate(df.coalesce(1), {"m": flaky}, default="m", sleep=lambda i: None).collect()}
    assert (got["ok"].raw_output, got["ok"].attempts, got["ok"].model_used) == ("OK", 1, "m")
    assert (got["second"].raw_output, got["second"].attempts) == ("SECOND", 2)
    assert (got["bad"].raw_output, got["bad"].attempts, got["bad"].error) == (None, 3, "ValueError: no")
    assert got["x"].error == "unknown model: nobody" and got[None].error == "no prompt"
    assert calls.value == 6
    with pytest.raises(ValueError):
        models.generate(df, {"m": flaky}, default="n")


def test_embedding_batches_copies_and_empty_answers(spark):
    calls = spark.sparkContext.accumulator(0)

    def fn(texts):
        calls.add(len(texts))
        return [[] if t == "none" else [float(len(t)), 1.0] for t in texts]

    df = spark.createDataFrame([("a",), ("bb",), ("a",), ("none",), (None,)] + [("a",)] * 50, "text string")
    plain = models.embed(df, fn, batch_rows=2).collect()
    assert {(r.text, tuple(r.vector) if r.vector else None) for r in plain} == {
        ("a", (1.0, 1.0)), ("bb", (2.0, 1.0)), ("none", None), (None, None)}
    assert calls.value == 54
    calls.value = 0
    once = models.embed(df, fn, dedupe=True).collect()
    assert sorted(map(str, once)) == sorted(map(str, plain)) and calls.value == 3
    hashed = models.hash_embedder(16)(["a b a", ""])
    assert hashed.sum() == 3 and np.count_nonzero(hashed[1]) == 0


def test_truncation_pairs_with_any_counter(spark):
    from docmatch.functions import text as tx

    def vowels(t):
        return F.length(t) - F.length(F.translate(t, "aeiou", ""))

    cases = ["", "one two  three", " lead and trail ", "aeiou xyz", "日本語 text", "a\nb\tc d"]
    df = spark.createDataFrame([(c, n) for c in cases for n in range(-1, 6)], "t string, n int")
    out = df.select("t", "n", tx.truncate(F.col("t"), F.col("n")).alias("chars"),
                    tx.truncate(F.col("t"), F.col("n"), tx.count_words).alias("words"),
                    tx.truncate(F.col("t"), F.col("n"), vowels).alias("vowels")).collect()
    for r in out:
        if r.n <= 0:
            assert r.chars == r.words == r.vowels == r.t
            continue
        assert r.chars == r.t[:r.n]
        assert len(r.words.split()) == min(r.n, len(r.t.split())) and r.t.startswith(r.words)
        kept = [i for i in range(len(r.t) + 1) if sum(c in "aeiou" for c in r.t[:i]) <= r.n]
        assert r.vowels == r.t[:max(kept)]


def test_uids_must_be_strings_and_other_keys_are_kept(spark):
    raw = '[{"ref_uid": 5, "input_uid": "u", "reason": "r", "n": 3, "deep": {"a": [1]}, "confidence": 1}]'
    df = spark.createDataFrame([("q", raw)], "query_uid string, raw_output string")
    (row,) = predictions.parse_output(df).collect()
    assert row.ref_uid is None and row.input_uid == "u"
    assert row.extra == {"reason": "r", "n": "3", "deep": '{"a":[1]}'}
