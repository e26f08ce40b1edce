"""Texts give grams of the sizes that short entries have, and no others."""

import numpy as np

from docmatch.operators import screen


def test_only_needed_sizes_are_hashed(spark, monkeypatch):
    asked, hashes = [], screen._keys_column
    monkeypatch.setattr(screen, "_keys_column", lambda text, of_text, *more: asked.append(len(of_text(b"abcdefghijklmnopqrst"))) or hashes(text, of_text, *more))
    texts = spark.createDataFrame([("a", "one two three"), ("b", "nothing of it"), ("c", None)], "uid string, text string")
    listed = spark.createDataFrame([(1, "two three"), (2, "nothing o"), (3, "absent yes")], "idx int, entry string")
    found = screen.hits(texts, listed, strategy="grams")
    assert {(r.uid, r.idx) for r in found.collect()} == {("a", 1), ("b", 2)}
    assert asked[-1] == 13, "grams of 8 of 20 bytes"


def test_keys_are_looked_up_in_sorted_ones():
    rng = np.random.default_rng(0)
    keys, wanted = np.unique(rng.integers(0, 500, 300)), np.unique(rng.integers(0, 500, 200))
    assert (screen._those_in(keys, wanted) == np.intersect1d(keys, wanted)).all()
    assert not len(screen._those_in(keys, wanted[:0]))
