"""The quality model learns from every labelled row."""

import numpy as np

from docmatch.llm import quality
from tests.llm.cases import docs


def test_every_labelled_row_teaches_and_counts_for_the_threshold(spark, monkeypatch):
    """Rows beyond any fixed number of rows move the model, a rare class reaches every group."""
    monkeypatch.setattr(quality, "LEAST_OF_CLASS", 2)
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma."] if i % 50 else ["$$$", "9%9", "!!"], 8))) for i in range(600)]
    table, told = docs(spark, rows), spark.createDataFrame([(i, int(i % 50 > 0)) for i, _ in rows], "doc_id bigint, quality int")
    seen = []
    kept = quality.threshold
    monkeypatch.setattr(quality, "threshold", lambda s, share: seen.append(sorted(s.collect())) or kept(s, share))
    monkeypatch.setattr(quality, "NEAR_CUT", 3)
    made = quality.learn(table, told, group_rows=100)
    teaching = spark.range(600).where("crc32(cast(cast(id as string) as binary)) % 5 <> 0").collect()
    assert len(seen[0]) == len(teaching)
    bad = sum(r.id % 50 == 0 for r in teaching)
    order = sorted(r.s for r in seen[0])
    assert made.threshold == (order[bad - 1] + order[bad]) / 2
    again = quality.learn(table.repartition(7), told.repartition(3), group_rows=100)
    assert (again.weights == made.weights).all() and again.threshold == made.threshold
    fewer = quality.learn(table, told.where("doc_id <> 7"), group_rows=100)
    assert not (fewer.weights == made.weights).all(), "a single row is not left out"


def test_threshold_among_equal_strengths(spark):
    rng = np.random.default_rng(1)
    for share in (0.1, 0.35, 0.8):
        label, s = (rng.random(300) > share).astype(int), rng.integers(0, 40, 300) / 7
        table = spark.createDataFrame([(int(a), float(b)) for a, b in zip(label, s)], "label int, s double")
        bad = int((label == 0).sum())
        order = np.sort(s)
        assert abs(quality.threshold(table, bad / 300) - (order[bad - 1] + order[bad]) / 2) < 1e-12


def test_sketches_give_the_features_and_are_small():
    text = b"The quick brown fox, seen twice: the quick brown fox.\n" * 40 + "Größe 12%\n".encode()
    for t in (text, b"", b"x", b"\n\n", text * 40):
        kinds = quality.CLASS_OF[np.frombuffer(t, np.uint8)]
        pairs = np.bincount(kinds[:-1] * np.uint16(quality.CLASSES) + kinds[1:], minlength=quality.CLASSES ** 2)
        x = quality.features(t)
        assert (x[:-quality.SHAPES] == np.sqrt(pairs / max(1, len(t) - 1)).astype(np.float32)).all()
        assert x[-quality.SHAPES] == np.float32(np.log1p(len(t)))
    assert len(quality.sketch(text)) < len(text) / 4


def test_texts_are_not_shuffled_to_meet_their_labels(spark, monkeypatch):
    """Only sketches move, whatever the size of the labels."""
    seen = []
    kept = quality.kept
    monkeypatch.setattr(quality, "kept", lambda df, name: seen.append(df) or kept(df, name))
    table = docs(spark, [(i, "plain words " * (i + 1)) for i in range(40)])
    told = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, quality int")
    quality.learn(table, told)
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert seen[0].columns == ["doc_id", "sketch", "label"] and "strategy=merge" in plan
    assert plan.index("Join") < plan.index("MapInArrow"), "texts become sketches below the join"
