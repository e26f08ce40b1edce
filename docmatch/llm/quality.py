"""Quality scores by Bradley-Terry pairwise ranking.

A document's strength is a linear function of what its text looks like: how classes of characters follow
each other, how words and lines repeat, how long they are. The weights are learned from preference pairs,
each a good and a bad document, by the logistic loss on the difference of their features. The threshold is
the quantile of the learned strengths that leaves the share of rejected documents the labels show.

Every labelled row that is not held out teaches. Rows are dealt into groups of bounded size by a hash of their ids,
each group learns weights from pairs of its own, and the strengths of the model are the mean of the groups'. The
threshold is a quantile over all labelled rows, found by counting. Every text is scored whole. An empty or null text has the strength of its (empty) features. Without both classes every score is 0.5.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmatch.llm.common import arrow_schema, kept, labelled, per_document, remainder, same_columns, texts
from docmatch.sources.staging import stage

ACCEPT = 0.3
# Labelled rows that learn together, and rows of a rarer class that each group gets by copying.
GROUP_ROWS, LEAST_OF_CLASS = 8192, 64
# Strengths that are read at once to find the threshold, and intervals counted at a time.
NEAR_CUT, INTERVALS = 4096, 1024
# Means of groups are sums of whole numbers, so they do not depend on the order of the groups.
PLACES = float(1 << 40)
_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
LOWER, UPPER, DIGIT, SPACE, BREAK, HIGH, OTHER = range(7)
CLASSES = 7 + len(_PUNCTUATION)
SHAPES = 10


def _classes() -> np.ndarray:
    table = np.full(256, OTHER, np.uint16)
    for codes, kind in ((range(97, 123), LOWER), (range(65, 91), UPPER), (range(48, 58), DIGIT), (b" ", SPACE),
                        (b"\t\n\x0b\x0c\r", BREAK), (range(128, 256), HIGH)):
        table[list(codes)] = kind
    for i, c in enumerate(_PUNCTUATION):
        table[c] = 7 + i
    return table


CLASS_OF = _classes()


def sketch(text: bytes) -> bytes:
    """What the features of a text are made from: its length, shapes of words and lines, and how often which neighbouring
    character classes occur, packed into a fraction of the text's size."""
    kinds = CLASS_OF[np.frombuffer(text, np.uint8)]
    pairs = np.bincount(kinds[:-1] * np.uint16(CLASSES) + kinds[1:], minlength=CLASSES * CLASSES)
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    n, distinct = max(1, len(words)), len(set(words))
    again = sum(a == b for a, b in zip(words, words[1:]))
    shapes = [
        math.log1p(len(text)), math.log1p(len(words)), len(text) / n / 10, distinct / n, again / n,
        math.log1p(n / max(1, distinct)), len(set(lines)) / max(1, len(lines)), math.log1p(len(text) / max(1, len(lines))),
        float(not words), float(len(words) < 5),
    ]
    at = np.flatnonzero(pairs)
    counts = pairs[at].astype(np.uint16 if len(text) < 1 << 16 else np.uint32)
    return np.int64(len(text)).tobytes() + np.array(shapes, np.float32).tobytes() + at.astype(np.uint16).tobytes() + counts.tobytes()


def sketched(packed: bytes) -> np.ndarray:
    """Square roots of the shares of neighbouring character classes, and shapes of words and lines."""
    size, start = int(np.frombuffer(packed, np.int64, 1)[0]), 8 + 4 * SHAPES
    kind = np.dtype(np.uint16 if size < 1 << 16 else np.uint32)
    n = (len(packed) - start) // (2 + kind.itemsize)
    out = np.zeros(CLASSES * CLASSES + SHAPES, np.float32)
    out[np.frombuffer(packed, np.uint16, n, start)] = np.sqrt(np.frombuffer(packed, kind, n, start + 2 * n) / max(1, size - 1))
    out[-SHAPES:] = np.frombuffer(packed, np.float32, SHAPES, 8)
    return out


def features(text: bytes) -> np.ndarray:
    return sketched(sketch(text))


@dataclass
class Ranking:
    mean: np.ndarray
    weights: np.ndarray
    threshold: float

    def strength(self, x: np.ndarray) -> float:
        return float((x - self.mean) @ self.weights)

    def score(self, x: np.ndarray) -> float:
        """0.3 at the threshold, by the logistic function of the distance to it."""
        at = self.strength(x) - self.threshold + math.log(ACCEPT / (1 - ACCEPT))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, at))))


def neutral() -> Ranking:
    """Without both classes nothing is known: every score is 0.5."""
    width = CLASSES * CLASSES + SHAPES
    return Ranking(np.zeros(width, np.float32), np.zeros(width, np.float32), math.log(ACCEPT / (1 - ACCEPT)))


def weigh(good: np.ndarray, bad: np.ndarray, steps: int = 400, pairs: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Mean and weights of features, learned so that good rows win against bad ones; needs rows of both classes."""
    every = np.concatenate([good, bad])
    mean, scale = every.mean(0), every.std(0) + 0.02
    del every
    g, b = (good - mean) / scale, (bad - mean) / scale
    rng, w = np.random.default_rng(7), np.zeros(len(mean), np.float32)
    seen = np.full_like(w, 1e-6)
    for _ in range(steps):
        difference = g[rng.integers(len(g), size=pairs)] - b[rng.integers(len(b), size=pairs)]
        lose = 1 / (1 + np.exp(np.clip(difference @ w, -50, 50)))
        gradient = -(lose @ difference) / pairs + 1e-3 * w
        seen += gradient * gradient
        w -= 0.05 * gradient / np.sqrt(seen)
    return mean, (w / scale).astype(np.float32)


def fit(good: np.ndarray, bad: np.ndarray, share_bad: float, steps: int = 400, pairs: int = 1024) -> Ranking:
    """Learn strengths so that good documents win against bad ones, from the rows of one group."""
    if not len(good) or not len(bad):
        return neutral()
    mean, weights = weigh(good, bad, steps, pairs)
    strengths = np.concatenate([(bad - mean) @ weights, (good - mean) @ weights])
    weight = np.concatenate([np.full(len(bad), share_bad / len(bad)), np.full(len(good), (1 - share_bad) / len(good))])
    order = np.argsort(strengths, kind="stable")
    at = int(np.searchsorted(np.cumsum(weight[order]), share_bad - 1e-9))
    low, high = strengths[order[min(at, len(order) - 1)]], strengths[order[min(at + 1, len(order) - 1)]]
    return Ranking(mean, weights, float((low + high) / 2))


def grouped_weights(taught: DataFrame, counts: dict[int, int], group_rows: int = GROUP_ROWS) -> Ranking | None:
    """The mean of what groups of ``doc_id, label, sketch`` rows learn; None if no group has both classes.

    A class too rare for all groups has its rows copied to several, so no row is left out.
    """
    groups = max(1, -(-sum(counts.values()) // group_rows))
    copies = F.lit(1)
    for label, n in counts.items():
        copies = F.when(F.col("label") == label, min(groups, -(-LEAST_OF_CLASS * groups // n))).otherwise(copies)
    to = F.transform(F.sequence(F.lit(0), copies - 1), lambda i: F.pmod(F.xxhash64("doc_id") + i, F.lit(groups)).cast("int"))
    dealt = taught.select("doc_id", "sketch", "label", F.explode(to).alias("_group"))
    schema = "at int, mean double, weight double"
    out = arrow_schema(schema)

    def teach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(i, label, sketched(x).tobytes()) for batch in batches for i, x, label in zip(
            batch["doc_id"].to_pylist(), batch["sketch"].to_pylist(), batch["label"].to_pylist())]
        held.sort()  # the pairs drawn do not depend on the order of arrival
        bad, good = (np.frombuffer(b"".join(x for _, label, x in held if label == c), np.float32).reshape(
            -1, CLASSES * CLASSES + SHAPES) for c in (0, 1))
        del held
        if len(good) and len(bad):
            mean, weights = weigh(good, bad)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(mean), dtype=np.int32)), pa.array(mean.astype(float)),
                                              pa.array(weights.astype(float))], schema=out)

    learned = dealt.groupBy("_group").applyInArrow(teach, schema)
    fixed = [F.sum(F.round(F.col(c) * PLACES).cast("decimal(38,0)")).alias(c) for c in ("mean", "weight")]
    rows = sorted(learned.groupBy("at").agg(F.count(F.lit(1)).alias("n"), *fixed).toLocalIterator())  # a row per feature
    if not rows:
        return None
    mean, weights = (np.array([float(r[c]) / PLACES / r["n"] for r in rows], np.float32) for c in ("mean", "weight"))
    return Ranking(mean, weights, 0.0)


def threshold(strengths: DataFrame, share_bad: float) -> float:
    """Where the share of rejected documents is ``share_bad``, exact over all ``label, s`` rows.

    Intervals are counted and the one with the quantile is cut again, until few distinct strengths are left.
    """
    values = stage(strengths.groupBy("s").agg(F.count(F.when(F.col("label") == 0, 1)).alias("bad"),
                                              F.count(F.when(F.col("label") == 1, 1)).alias("good")), "quality-strengths")
    told = values.agg(F.min("s").alias("low"), F.max("s").alias("high"), F.sum("bad").alias("bad"), F.sum("good").alias("good")).head()
    weight = {"bad": share_bad / max(1, told["bad"]), "good": (1 - share_bad) / max(1, told["good"])}
    target, below = share_bad - 1e-9, {"bad": 0, "good": 0}

    def reached(counts) -> float:
        return sum(counts[c] * weight[c] for c in ("bad", "good"))

    low, high, inside = told["low"], told["high"], values
    while inside.count() > NEAR_CUT:
        width = (high - low) / INTERVALS
        slot = F.least(F.lit(INTERVALS - 1), F.floor((F.col("s") - low) / width)).alias("slot")
        parts = sorted(inside.groupBy(slot).agg(F.min("s").alias("low"), F.max("s").alias("high"), F.sum("bad").alias("bad"),
                                                F.sum("good").alias("good")).toLocalIterator(), key=lambda r: r["low"])
        for part in parts:
            after = {c: below[c] + part[c] for c in below}
            if reached(after) >= target or part is parts[-1]:
                break
            below = after
        low, high = part["low"], part["high"]
        inside = values.where(F.col("s").between(low, high))
    rows = sorted(inside.toLocalIterator())  # at most NEAR_CUT
    for at, row in enumerate(rows):
        after = {c: below[c] + row[c] for c in below}
        if reached(after) >= target:
            break
        below = after
    # Equal strengths: bad rows come first; the next row may have the same one.
    last = weight["good"] if row["good"] else weight["bad"]
    if row["bad"] + row["good"] > 1 and reached(after) - last >= target:
        return row["s"]
    above = rows[at + 1]["s"] if at + 1 < len(rows) else values.where(F.col("s") > row["s"]).agg(F.min("s")).head()[0]
    return row["s"] if above is None else (row["s"] + above) / 2


def sketches(docs: DataFrame, divisor: int, held_out: int) -> DataFrame:
    """``doc_id, sketch`` of the documents that may teach, which is all that meets the labels: texts stay where they are."""
    def start():
        def row(doc_id, text):
            return doc_id, sketch(text)
        return row

    return per_document(texts(docs).where(remainder("doc_id", divisor) != held_out), "doc_id bigint, sketch binary", start)


def learn(docs: DataFrame, labels: DataFrame, divisor: int = 5, held_out: int = 0, group_rows: int = GROUP_ROWS) -> Ranking:
    """Learn the ranking from all labelled documents that are not held out.

    Sketches and labels are always merged, so what is shuffled grows with the input whatever the size of the labels.
    """
    rows, counts = labelled(labels, "quality", divisor, held_out)
    if len(counts) < 2:
        return neutral()
    taught = kept(sketches(docs, divisor, held_out).join(rows.hint("merge"), "doc_id"), "quality-taught")
    ranking = grouped_weights(taught, counts, group_rows)
    if ranking is None:
        return neutral()
    out = arrow_schema("label int, s double")

    def strengths_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [ranking.strength(sketched(x)) for x in batch["sketch"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["label"], pa.array(s, pa.float64())], schema=out)

    strengths = taught.select("label", "sketch").mapInArrow(strengths_of, "label int, s double")
    ranking.threshold = threshold(strengths, counts[0] / sum(counts.values()))
    return ranking


def score(docs: DataFrame, ranking: Ranking) -> DataFrame:
    """``doc_id, score, predicted`` of every text."""
    def start():
        def row(doc_id, text):
            s = ranking.score(features(text))
            return doc_id, s, int(s >= ACCEPT)
        return row

    return per_document(texts(docs), "doc_id bigint, score double, predicted int", start)


def classify(docs: DataFrame, labels: DataFrame, divisor: int = 5, held_out: int = 0) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    return (score(docs, learn(docs, labels, divisor, held_out))
            .withColumn("held_out", remainder("doc_id", divisor) == held_out))


def keep_good(docs: DataFrame, labels: DataFrame, divisor: int = 5, held_out: int = 0) -> DataFrame:
    """The documents that the classifier accepts, with all their columns."""
    ranking = learn(docs, labels, divisor, held_out)

    def start():
        def change(batch):
            return batch.filter(pa.array([ranking.score(features((t or "").encode())) >= ACCEPT
                                          for t in batch["text"].to_pylist()], pa.bool_()))
        return change

    return same_columns(docs, start)
