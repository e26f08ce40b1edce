"""Model calls that survive a killed job, and calls side by side in a task."""

import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from docmatch.operators import answers, models
from tests.test_jobs import EMBED, run, sure, trees


def counting(folder, dies_on=()):
    """A model that leaves a file per call; some prompts take the worker down while ``armed`` is there."""
    def fn(text):
        open(f"{folder}/call-{text}-{time.time_ns()}", "w").close()
        if text in dies_on and os.path.exists(f"{folder}/armed"):
            os._exit(1)
        if text.startswith("bad"):
            raise ValueError("no")
        return text.upper()

    return fn


def calls(folder, text=None):
    found = [f.split("-")[1] for f in os.listdir(folder) if f.startswith("call-")]
    return len(found) if text is None else found.count(text)


def asked(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, prompt string")


def test_a_killed_job_keeps_what_it_has_and_asks_the_rest_once(spark, tmp_path):
    folder, path = str(tmp_path / "calls"), str(tmp_path / "ledger")
    os.mkdir(folder)
    texts = [f"p{i}" for i in range(60)]
    df, fn = asked(spark, texts), counting(folder, dies_on=("p41",))
    open(f"{folder}/armed", "w").close()
    with pytest.raises(Exception, match="crashed|exited|EOF|Job aborted|Worker"):
        answers.resumable(df, {"m": fn}, path, default="m", calls_per_task=2, concurrency=1)
    os.remove(f"{folder}/armed")
    kept = {r.raw_output for r in answers.read_ledger(spark, path).collect()}
    paid = {t: calls(folder, t) for t in texts}
    assert 0 < len(kept) < 60 and all(paid[t.lower()] == 1 for t in kept)
    out = answers.resumable(df, {"m": fn}, path, default="m", calls_per_task=2, concurrency=1)
    assert {r.prompt: r.raw_output for r in out.collect()} == {t: t.upper() for t in texts}
    for t in texts:
        assert calls(folder, t) - paid[t] == (0 if t.upper() in kept else 1)
    before = calls(folder)
    again = answers.resumable(df, {"m": fn}, path, default="m")
    assert again.count() == 60 and out.count() == 60 and calls(folder) == before


def test_equal_prompts_are_one_call_failures_are_asked_again_and_nulls_never(spark, tmp_path):
    folder, path = str(tmp_path / "calls"), str(tmp_path / "ledger")
    os.mkdir(folder)
    df = asked(spark, ["a"] * 30 + ["bad", None, "a "]).withColumn("llm_name", F.when(F.col("id") == 0, "n"))
    fns = {"m": counting(folder), "n": counting(folder)}
    options = {"default": "m", "sleep": models_wait, "max_attempts": 2}
    rows = answers.resumable(df, fns, path, **options).orderBy("id").collect()
    assert calls(folder, "a") == 2, "one call per model"
    assert [(r.model_used, r.raw_output, r.attempts, r.error) for r in (rows[0], rows[1], rows[30], rows[31])] == [
        ("n", "A", 1, None), ("m", "A", 1, None), ("m", None, 2, "ValueError: no"), ("m", None, 0, "no prompt")]
    assert calls(folder, "bad") == 2 and len(rows) == 33 and list(rows[0].asDict())[:3] == ["id", "prompt", "llm_name"]
    answers.resumable(df, fns, path, **options)
    assert calls(folder, "bad") == 4 and calls(folder, "a") == 2
    good = dict(fns, m=lambda text: "fixed")
    assert answers.resumable(df, good, path, **options).where("prompt = 'bad'").first().raw_output == "fixed"
    assert answers.read_ledger(spark, path).where("error is not null").count() == 0
    with pytest.raises(ValueError):
        answers.resumable(df, fns, path, default="none")


def models_wait(attempt):
    pass


def test_no_rows_and_no_ledger(spark, tmp_path):
    path = str(tmp_path / "ledger")
    assert answers.read_ledger(spark, path).count() == 0
    assert answers.resumable(asked(spark, ["x"]).limit(0), {"m": str.upper}, path, default="m").count() == 0


@pytest.mark.parametrize("concurrency", [1, 3])
def test_calls_open_at_once_within_a_task(spark, tmp_path, concurrency):
    folder = str(tmp_path)

    def slow(text):
        open(f"{folder}/{text}-{threading.get_ident()}", "w").close()
        open_now = f"{folder}/open-{text}"
        open(open_now, "w").close()
        top = sum(f.startswith("open-") for f in os.listdir(folder))
        time.sleep(0.02)
        os.remove(open_now)
        return f"{text} {top}"

    df = asked(spark, [f"t{i}" for i in range(24)]).coalesce(1)
    rows = models.generate(df, {"m": slow}, default="m", concurrency=concurrency).orderBy("id").collect()
    assert [r.raw_output.split()[0] for r in rows] == [f"t{i}" for i in range(24)]
    tops = [int(r.raw_output.split()[1]) for r in rows]
    assert max(tops) <= concurrency and (max(tops) > 1) == (concurrency > 1)
    with pytest.raises(ValueError):
        models.generate(df, {"m": slow}, default="m", concurrency=0)


def test_a_matching_job_asks_its_models_once_over_two_runs(spark, tmp_path):
    folder = str(tmp_path / "calls")
    os.mkdir(folder)

    def fn(prompt):
        open(f"{folder}/call-x-{time.time_ns()}", "w").close()
        return sure(prompt)

    from docmatch.operators.scenario import Scenario
    from docmatch.plans.match import match

    df = trees(spark, ["red apple pie", "blue sky"], ["blue sky today", "apple pie red hot"])
    got = [match(df, Scenario(), EMBED, {"m": fn}, default_model="m", dim=32, sleep=models_wait, concurrency=3,
                 ledger_path=str(tmp_path / "ledger")) for _ in range(2)]
    assert calls(folder) == 2
    plain = run(df)
    want = sorted(map(str, plain.predictions.collect()))
    assert all(sorted(map(str, r.predictions.collect())) == want for r in got)
