"""Spelling of unknown words: against a bit-by-bit version, as a distribution, and what noise costs."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from docmatch.llm import byte_mixer, lm
from tests.llm.cases import docs, prose


def counted(spelled: bytes) -> byte_mixer.Speller:
    seen, ones = np.zeros((2, byte_mixer.CONTEXTS, byte_mixer.SLOTS))
    for _, slot, bit, _ in byte_mixer.chunks(spelled):
        for c in range(byte_mixer.CONTEXTS):
            np.add.at(seen[c], slot[c].ravel(), 1)
            np.add.at(ones[c], slot[c].ravel(), bit.ravel())
    return byte_mixer.Speller.of(seen, ones)


def plain(spelled: bytes) -> list[list[tuple]]:
    """Per byte its bits, each as (context of each kind with the byte's bits so far, bit, (place, which bit))."""
    out, word = [], b""
    for value in spelled:
        last = (b"\0\0" + b" " + word)[-3:] if len(word) < 3 else word[-3:]
        bits = []
        for k in range(8):
            so_far = f"{value:08b}"[:k]
            known = (min(len(word), 15), last[-1:], last[-2:], last[-3:])
            bits.append(([(c, at, so_far) for c, at in enumerate(known)], value >> (7 - k) & 1, (min(len(word), 3), k)))
        out.append(bits)
        word = b"" if value == 32 else word + bytes([value])
    return out


@pytest.mark.parametrize("learned", [False, True])
def test_against_a_bit_by_bit_version(learned):
    spelled = "straße abc abd  abcabc é zzz abc ".encode()
    told = plain(spelled)
    counts: dict = {}
    for bits in told:
        for contexts, bit, _ in bits:
            for c in contexts:
                counts.setdefault(c, [0, 0])[bit] += 1
    made, want = counted(spelled), []
    made.weights = np.random.default_rng(3).uniform(0.1, 0.6, made.weights.shape)
    for bits in told:
        total = 0.0
        for contexts, bit, gate in bits:
            logit = 0.0
            for c, context in enumerate(contexts):
                n = list(counts[context])
                n[bit] -= learned
                logit += made.weights[(c, *gate)] * math.log((n[1] + 0.4) / (n[0] + 0.4))
            total -= math.log10(1 + math.exp(-logit if bit else logit))
        want.append(total)
    got = made.log10(spelled, np.full(len(spelled), learned))
    # Counters are hashed: at this size hardly any two contexts meet in one.
    assert np.isclose(got, want, atol=1e-5).mean() > 0.9 and abs(got.sum() - sum(want)) < 1


@pytest.mark.parametrize("start", [b"", b"a", b"ab", b"abc", b"abc ", b"\xc3"])
def test_next_bytes_are_a_distribution(start):
    made = counted(b"abc abd abcabc zz ")
    none = np.zeros(len(start) + 1, bool)
    total = sum(10 ** made.log10(start + bytes([b]), none)[-1] for b in range(256))
    assert total == pytest.approx(1, abs=1e-6)


def test_chunks_do_not_matter(monkeypatch):
    made, spelled = counted(b"abc abd abcabc zz " * 50), b"zebra abba  c " * 40
    whole = made.log10(spelled, np.zeros(len(spelled), bool))
    monkeypatch.setattr(byte_mixer, "CHUNK", 7)
    assert np.allclose(made.log10(spelled, np.zeros(len(spelled), bool)), whole)
    assert np.allclose(made.log10(b"", np.zeros(0, bool)), [])


def test_online_weights_tell_the_text_better():
    rng = random.Random(2)
    spelled = " ".join(rng.choice(["un", "re", "in"]) + rng.choice(["mark", "turn", "land"]) + str(rng.randrange(9)) for _ in range(4000)).encode() + b" "
    made = counted(spelled)
    before = made.log10(spelled, np.ones(len(spelled), bool)).sum()
    made.weights = made.learned_online(spelled)
    assert made.log10(spelled, np.ones(len(spelled), bool)).sum() > before


def test_words_and_their_hashes(monkeypatch):
    texts = [b"", b" \t", b"One two\x0bone", b"x" * 100 + b" " + b"x" * 99 + b"y " + b"X" * 100, b"two\n", "é É".encode()]
    split = [t.lower().split() for t in texts]
    for size in (1 << 20, 5):
        monkeypatch.setattr(lm, "HASHED_BYTES", size)
        words = lm.Words.of(texts)
        assert words.numbers.tolist() == [len(w) for w in split]
        every = [w for ws in split for w in ws]
        assert [words.letters[a:z].tobytes() for a, z in zip(words.starts, words.ends)] == every
        assert len(set(zip(every, words.hashes.tolist()))) == len(set(every)) == len(set(words.hashes.tolist()))
    tokens = lm.Tokens(pa.table({"text": pa.array(texts, pa.binary()), "learn": [True] * len(texts)}))
    assert lm.spelled(np.ones(len(tokens.word), bool), tokens) == [b"".join(w + b" " for w in [*ws, b""]) for ws in split]


def test_noise_costs_more_bits_a_byte_than_prose(spark):
    rng, sentences = random.Random(8), [prose(i, 9) for i in range(12)]
    rows = [(i, " ".join(rng.choice(sentences) for _ in range(8))) for i in range(300)]
    noise = [(1000 + i, " ".join("".join(rng.choices("bcdfghjklmnpqrstvwxz", k=9)) for _ in range(60))) for i in range(60)]
    out = lm.score(docs(spark, rows + noise)).collect()
    held = [r for r in out if r.held_out]
    worst = max(r.bits_per_byte for r in held if r.doc_id < 1000)
    assert min(r.bits_per_byte for r in held if r.doc_id >= 1000) > max(2 * worst, 3)


def test_a_batch_is_read_once_for_keys_and_use(spark, tmp_path):
    from docmatch.llm.corpus import Keys, Kind, with_totals

    log = str(tmp_path / "reads")

    def read(table):
        with open(log, "a") as f:
            f.write("x")
        return table

    def keys_of(table):
        n = np.arange(table.num_rows, dtype=np.uint64)
        return [Keys(n, n)]

    table = spark.createDataFrame([(i, b"x") for i in range(4)], "doc_id bigint, text binary")
    out = with_totals(table, [Kind(8)], keys_of, lambda t, totals: t.select(["doc_id"]), "doc_id bigint", read)
    assert out.count() == 4 and len(open(log).read()) == 2, "once to send, once to finish"


def test_a_kept_table_is_written_with_its_shuffles_cleaned_up(spark):
    from docmatch.llm import common

    seen, before = [], spark.conf.get(common.CLEAN_UP)

    class Frame:
        sparkSession = spark
        schema = spark.range(1).schema

        @property
        def write(self):
            seen.append(spark.conf.get(common.CLEAN_UP))
            return spark.range(100).repartition(3).write

    assert common.kept(Frame(), "clean").count() == 100
    assert seen == ["true"] and spark.conf.get(common.CLEAN_UP) == before
