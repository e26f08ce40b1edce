"""The stand-in embedder remembers a bounded number of tokens."""

import hashlib
import re
import sys

import numpy as np

from docmatch.operators import models
from tests.test_memory import peak_of


def test_the_embedder_remembers_a_bounded_number_of_tokens():
    embed = models.hash_embedder(8)
    texts = [" ".join(f"token-{i}-{j}" for j in range(500)) for i in range(600)]
    assert peak_of(lambda: [embed([t]) for t in texts]) < 20 << 20
    assert (embed(texts[:1]) == embed(texts[:1])).all() and embed(texts[:1]).sum() == 500


def _plain(text: str, dim: int) -> list[int]:
    out = [0] * dim
    for token in re.findall(r"[^ \t\r\n]+", text):
        out[int(hashlib.md5(token.encode("utf-8")).hexdigest()[:8], 16) % dim] += 1
    return out


def test_the_embedder_counts_tokens_as_the_plain_form_does():
    texts = ["", " \t\r\n", "one two  one", "a\x0bb a\x0cb", "a\u00a0b \u2003 c\x1cd\x85e", "\u6771\u4eac \U0001f600 x\x00y\n"]
    assert models.hash_embedder(16)(texts).tolist() == [_plain(t, 16) for t in texts]


def test_the_embedder_calls_no_function_of_its_own_per_known_token():
    embed = models.hash_embedder(64)
    text = " ".join(f"w{i % 50}" for i in range(5000))
    embed([text])
    calls = []
    sys.setprofile(lambda frame, event, arg: calls.append(frame.f_code.co_name) if event == "call" else None)
    try:
        out = embed([text])
    finally:
        sys.setprofile(None)
    assert len(calls) < 100 and (out == np.array([_plain(text, 64)])).all()
