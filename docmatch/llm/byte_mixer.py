"""Words spelled bit by bit: several hashed-context predictors, mixed online by gated weights.

A spelled word is its bytes and one space. Each bit of a byte is predicted by what followed in four contexts:
the place in the word and the last one, two and three bytes of the word, each with the byte's bits so far. A
context is hashed to one of ``SLOTS`` counters, of which there are as many for any corpus. The predictions are
mixed in the logistic domain by weights that a gate selects (which bit it is, and how far into the word).
The bits of a byte are told one after another, so the probabilities of all spellings sum to at most one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmatch.llm.common import arrow_schema, mixed
from docmatch.llm.corpus import narrow, widths

CONTEXTS, SLOT_BITS = 4, 17
SLOTS = 1 << SLOT_BITS
# Gates: the first places of a word by themselves, all later ones together, times the eight bits of a byte.
PLACES = 4
SPACE = 32
# Bytes told at a time, bytes between two steps of the weights, bytes that one group learns from.
CHUNK, STEP, GROUP_BYTES = 1 << 13, 1 << 11, 1 << 20
RATE, START_WEIGHT = np.float32(0.02), 0.3
SPREAD = np.uint32(0x9E3779B1)
# Of each byte value its bits, highest first, and the bits before each of them behind a leading one.
BITS = np.array([[v >> (7 - k) & 1 for k in range(8)] for v in range(256)], np.uint8)
NODES = np.array([[1 << k | v >> (8 - k) for k in range(8)] for v in range(256)], np.uint32)
# Counters leave a task in blocks, so that few rows are added up.
BLOCK = 1 << 14


def contexts(spelled: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes, a hash per context and byte, and each byte's place in its word."""
    value = np.frombuffer(spelled, np.uint8)
    before = np.full((3, len(value)), SPACE, np.uint64)
    for i in range(3):
        before[i, i + 1:] = value[:-i - 1]
    one, two, three = before
    two = np.where(one == SPACE, 0, two)
    three = np.where((two == SPACE) | (two == 0), 0, three)
    at = np.arange(len(value))
    place = at - np.maximum.accumulate(np.where(one == SPACE, at, 0))
    said = np.stack([np.minimum(place, 15).astype(np.uint64), one, one | two << np.uint64(8),
                     one | two << np.uint64(8) | three << np.uint64(16)])
    hashed = mixed(said * np.uint64(8) + np.arange(CONTEXTS, dtype=np.uint64)[:, None])
    return value, (hashed >> np.uint64(32)).astype(np.uint32), np.minimum(place, PLACES - 1)


def chunks(spelled: bytes, size: int | None = None):
    """Some bytes at a time: where they begin, the counter of each context and bit, the bits, the places."""
    size = size or CHUNK
    value, said, place = contexts(spelled)
    for at in range(0, len(value), size):
        v = value[at:at + size]
        slot = ((said[:, at:at + size, None] + NODES[v]) * SPREAD) >> np.uint32(32 - SLOT_BITS)
        yield at, slot, BITS[v], place[at:at + size]


@dataclass
class Speller:
    """What each counter says: as counted, without one zero, without one one; and the weights by context,
    place and bit."""

    said: np.ndarray
    weights: np.ndarray

    @classmethod
    def of(cls, seen: np.ndarray, ones: np.ndarray) -> Speller:
        def stretched(seen, ones):
            seen = np.maximum(seen, 0)
            ones = np.clip(ones, 0, seen)
            return np.log((ones + 0.4) / (seen - ones + 0.4)).astype(np.float32)

        said = [stretched(seen, ones), stretched(seen - 1, ones), stretched(seen - 1, ones - 1)]
        return cls(np.stack(said).ravel(), np.full((CONTEXTS, PLACES, 8), START_WEIGHT, np.float32))

    def inputs(self, slot: np.ndarray, bit: np.ndarray, learned: np.ndarray) -> list[np.ndarray]:
        """What each context says of (byte, bit); bytes that were learned from are left out of their counters."""
        table = (bit + np.uint32(1)) * learned[:, None] * np.uint32(CONTEXTS * SLOTS)
        return [self.said.take(table + slot[c] + np.uint32(c * SLOTS)) for c in range(CONTEXTS)]

    def log10(self, spelled: bytes, learned: np.ndarray) -> np.ndarray:
        """Log10 probability of each byte; ``learned`` tells which bytes were learned from."""
        out = np.empty(len(spelled))
        for at, slot, bit, place in chunks(spelled):
            logit = mix(self.inputs(slot, bit, learned[at:at + len(bit)]), self.weights, place)
            told = 1 / (1 + np.exp(np.where(bit > 0, -logit, logit)))
            out[at:at + len(bit)] = np.log10(told.prod(axis=1, dtype=float))
        return out

    def learned_online(self, spelled: bytes) -> np.ndarray:
        """Weights after one pass, a few bytes a step, each bit predicted before it is learned from."""
        weights = self.weights.astype(np.float32)
        for _, slot, bit, place in chunks(spelled, STEP):
            said = self.inputs(slot, bit, np.ones(len(bit), bool))
            error = 1 / (1 + np.exp(-mix(said, weights, place))) - bit
            here = (place == np.arange(PLACES)[:, None]).astype(np.float32)
            here /= np.maximum(1, here.sum(axis=1, keepdims=True))
            for c, x in enumerate(said):
                weights[c] -= RATE * (here @ (error * x).astype(np.float32))
        return weights


def mix(said: list[np.ndarray], weights: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The logit of each bit, kept where its probability is a number of its own."""
    logit = said[0] * weights[0].take(place, axis=0)
    for x, w in zip(said[1:], weights[1:]):
        logit += x * w.take(place, axis=0)
    return np.clip(logit, -25, 25)


def learn(told: DataFrame) -> Speller:
    """Counters over all training rows of ``spelled``, then weights learned online.

    Weights are learned in groups of about ``GROUP_BYTES``, which a row's hash chooses, in the order of their
    texts, and averaged by bytes; the result does not depend on how rows are partitioned. A word spelled in a
    training row is in no other one, so rows are not equal and no group is hot. The driver receives the
    counters, whose number is fixed, and one row of weights.
    """
    rows = told.filter("learn AND octet_length(spelled) > 0").select("spelled")
    blob = "block int, counts binary"
    out = arrow_schema(blob)

    def blocks(counts):
        flat = counts.reshape(-1, BLOCK)
        some = np.flatnonzero(flat.any(axis=1))
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([narrow(flat[b]).tobytes() for b in some], pa.binary())],
                                          schema=out)

    def count(batches):
        counts = np.zeros((2, CONTEXTS, SLOTS), np.int64)
        for batch in batches:
            for _, slot, bit, _ in chunks(b"".join(batch["spelled"].to_pylist())):
                for c in range(CONTEXTS):
                    counts[0, c] += np.bincount(slot[c].ravel(), minlength=SLOTS)
                    counts[1, c] += np.bincount(slot[c][bit > 0], minlength=SLOTS)
        yield blocks(counts)

    def add_up(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BLOCK, np.int64)
        for batch in batches:
            for counts in batch["counts"].to_pylist():
                total += widths(counts, BLOCK)[0].astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()),
                                          pa.array([narrow(total).tobytes()], pa.binary())], schema=out)

    counts = np.zeros(2 * CONTEXTS * SLOTS, np.int64)
    sums = rows.mapInArrow(count, blob).groupBy("block").applyInArrow(add_up, blob)
    for block, values in sums.toLocalIterator():
        counts[block * BLOCK:(block + 1) * BLOCK] = widths(values, BLOCK)[0]
    speller = Speller.of(*counts.reshape(2, CONTEXTS, SLOTS).astype(float))

    size = rows.agg(F.sum(F.octet_length("spelled"))).first()[0] or 0
    groups = max(1, -(-size // GROUP_BYTES))
    schema = "size bigint, weights array<double>"
    learned_out = arrow_schema(schema)

    def online(table):
        spelled = b"".join(sorted(table["spelled"].to_pylist()))
        weights = speller.learned_online(spelled)
        return pa.Table.from_arrays([pa.array([len(spelled)], pa.int64()), pa.array([weights.ravel().tolist()], learned_out[1].type)],
                                    schema=learned_out)

    dealt = rows.withColumn("_group", F.pmod(F.xxhash64("spelled"), F.lit(groups)))
    learned = (dealt.groupBy("_group").applyInArrow(online, schema)
               .select("size", F.posexplode("weights").alias("at", "weight"))
               .groupBy("at").agg((F.sum(F.col("weight") * F.col("size")) / F.sum("size")).alias("weight")))
    for at, weight in learned.toLocalIterator():
        speller.weights.ravel()[at] = weight
    return speller
