"""Toxicity by nearest labelled examples.

Documents and examples are TF-IDF vectors over terms that the labels show to matter (chi-square); document
frequencies count all documents. The nearest examples by exact cosine come from a block-max inverted index:
each term's postings lie in blocks of examples with the block's largest weight, blocks are visited by their
bound and left once no bound reaches the k-th best cosine. Votes weighted by closeness become a probability
through monotone calibration on the examples, each scored without itself; the neighbours are the evidence.

Examples are a bounded sample of labelled rows (``per_class``). Every text is scored whole. A text that
shares no term with any example, an empty or null one too, gets the calibrated score of such examples.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmatch.llm.common import FOLDED, arrow_schema, labelled_sample, per_document, remainder, texts
from docmatch.sources.staging import stage

ACCEPT = 0.3
PER_CLASS = 1500
NEIGHBOURS = 15
BLOCK = 64
# Terms: those whose chi-square is beyond chance, at least so many of the best and at most so many.
CHI_SQUARE, LEAST_TERMS, MOST_TERMS = 25.0, 16, 512


def terms(text: bytes) -> dict[bytes, int]:
    """How often each word occurs."""
    return Counter(text.translate(FOLDED).split())


@dataclass
class Index:
    """Unit vectors of examples, block by block and term by term; ``postings`` are (examples, weights) of each
    term. A block's lists lie under each other, so that the lists of a query's terms are read at once. Blocks,
    terms and a block's examples are bounded, and so is the whole."""

    labels: np.ndarray
    ids: np.ndarray
    postings: list[tuple[np.ndarray, np.ndarray]]
    lists: np.ndarray = field(init=False)
    largest: np.ndarray = field(init=False)

    def __post_init__(self):
        blocks = -(-max(1, len(self.labels)) // BLOCK)
        self.lists = np.zeros((blocks, len(self.postings), BLOCK))
        for t, (examples, weights) in enumerate(self.postings):
            self.lists[examples // BLOCK, t, examples % BLOCK] = weights
        self.largest = self.lists.max(axis=2).T.copy()

    def nearest(self, which: list[int], weights: np.ndarray, k: int, without: int = -1) -> list[tuple[float, int]]:
        """The k largest (cosine, example), ties by example; only positive cosines."""
        bounds = weights @ self.largest[which]
        found, last = (np.empty(0), np.empty(0, np.int64)), 0.0
        for block in np.argsort(-bounds, kind="stable"):
            if bounds[block] <= 0 or bounds[block] < last - 1e-12:
                break
            cosines = weights @ self.lists[block, which]
            if without >= 0 and without // BLOCK == block:
                cosines[without % BLOCK] = 0
            good = np.flatnonzero(cosines > max(0.0, last - 1e-12))
            if not len(good):
                continue
            values = np.concatenate([found[0], cosines[good]])
            examples = np.concatenate([found[1], block * BLOCK + good])
            best = np.lexsort((examples, -values))[:k]
            found = values[best], examples[best]
            if len(best) == k:
                last = found[0][-1]
        return list(zip(found[0].tolist(), found[1].tolist()))


@dataclass
class Model:
    numbers: dict[bytes, int]
    idf: np.ndarray
    index: Index
    cuts: np.ndarray
    rates: np.ndarray
    unmatched: float

    def vector(self, text: bytes) -> tuple[list[int], np.ndarray]:
        found = terms(text)
        return unit({self.numbers[t]: found[t] for t in self.numbers.keys() & found.keys()}, self.idf)

    def score(self, text: bytes) -> tuple[float, list[tuple[float, int]]]:
        which, weights = self.vector(text)
        found = self.index.nearest(which, weights, NEIGHBOURS) if which else []
        return self.calibrated(found), found

    def calibrated(self, found: list[tuple[float, int]]) -> float:
        if not found:
            return self.unmatched
        return float(self.rates[np.searchsorted(self.cuts, vote(found, self.index.labels), side="right")])


def unit(counts: dict[int, int], idf: np.ndarray) -> tuple[list[int], np.ndarray]:
    which = sorted(counts)
    weights = np.array([(1 + np.log(counts[t])) * idf[t] for t in which])
    return which, weights / (np.sqrt((weights ** 2).sum()) or 1.0)


def vote(found: list[tuple[float, int]], labels: np.ndarray) -> float:
    """Share of toxic examples, each weighted by its closeness."""
    return sum(c * labels[e] for c, e in found) / sum(c for c, _ in found)


def calibrate(votes: np.ndarray, labels: np.ndarray, weights: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Monotone rates by pooling neighbouring bins of votes that are out of order."""
    cuts = np.linspace(0, 1, 21)[1:-1]
    which = np.searchsorted(cuts, votes, side="right")
    pools: list[list[float]] = []
    for b in range(len(cuts) + 1):
        at = which == b
        # The light prior leans towards the bin's own vote, so that an empty bin stays between its neighbours.
        lean = min(max((b + 0.5) / (len(cuts) + 1), prior), 1.0)
        pools.append([float((weights * labels)[at].sum()) + 0.5 * lean, float(weights[at].sum()) + 0.5, 1])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] > pools[-1][0] / pools[-1][1]:
            a, b2 = pools[-2], pools.pop()
            pools[-1] = [a[0] + b2[0], a[1] + b2[1], a[2] + b2[2]]
    return cuts, np.concatenate([np.full(n, p / w) for p, w, n in pools])


def learn(docs: DataFrame, labels: DataFrame, divisor: int = 4, held_out: int = 2, per_class: int = PER_CLASS) -> Model:
    """Choose terms, count documents, index the examples, calibrate."""
    sample, counts = labelled_sample(labels, "toxic", divisor, held_out, per_class)

    def start():
        def row(doc_id, text):
            return doc_id, [dict(term=t, n=n) for t, n in terms(text).items()]
        return row

    source = texts(docs)
    chosen = source.join(F.broadcast(sample), "doc_id").select("doc_id", "text")
    made = per_document(chosen, "doc_id bigint, terms array<struct<term: binary, n: int>>", start, 64)
    examples = stage(made.join(F.broadcast(sample), "doc_id"), "toxicity-examples")

    size = {r["label"]: r["count"] for r in examples.groupBy("label").count().toLocalIterator()}
    n1, n = size.get(1, 0), sum(size.values())
    per_term = (examples.select("label", F.explode("terms.term").alias("term"))
                .groupBy("term").agg(F.count("*").alias("d"), F.sum("label").alias("d1")))
    d, d1 = F.col("d").cast("double"), F.col("d1").cast("double")
    # A term twice as frequent on one side as on the other, in both directions; smoothed for empty cells.
    chi = n * F.pow(d1 * (n - n1) - (d - d1) * n1, 2) / (d * (n + 1 - d) * max(1, n1) * max(1, n - n1))
    best = per_term.withColumn("chi", chi).orderBy(F.desc("chi"), "term").limit(MOST_TERMS)
    ranked = [(bytes(r["term"]), r["chi"]) for r in best.toLocalIterator()]
    kept = sorted(t for i, (t, c) in enumerate(ranked) if i < LEAST_TERMS or c >= CHI_SQUARE)
    numbers = {t: i for i, t in enumerate(kept)}

    frequencies, documents = document_frequencies(source, numbers)
    idf = np.log((documents + 1) / (frequencies + 1)) + 1e-3

    picked = examples.select("doc_id", "label", F.filter("terms", lambda t: t.term.isin(*map(bytearray, kept))).alias("own")
                             if kept else F.expr("slice(terms, 1, 0)").alias("own"))
    rows = sorted(((r["label"], r["doc_id"], unit({numbers[bytes(t["term"])]: t["n"] for t in r["own"]}, idf))
                   for r in picked.toLocalIterator()), key=lambda r: (r[0], r[2][0][:1], r[1]))
    by_term: list[list[tuple[int, float]]] = [[] for _ in kept]
    for e, (_, _, (which, weights)) in enumerate(rows):
        for t, w in zip(which, weights):
            by_term[t].append((e, w))
    postings = [(np.array([e for e, _ in p], np.int64), np.array([w for _, w in p])) for p in by_term]
    index = Index(np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.int64), postings)

    total = max(1, sum(counts.values()))
    share = {c: counts.get(c, 0) / total for c in (0, 1)}
    weight = {c: share[c] * n / max(1, size.get(c, 0)) for c in (0, 1)}
    votes, own_labels, own_weights, blank = [], [], [], [share[1] * 2, 2.0]
    for e, (label, _, (which, weights)) in enumerate(rows):
        found = index.nearest(which, weights, NEIGHBOURS, without=e) if which else []
        if found:
            votes.append(vote(found, index.labels))
            own_labels.append(label)
            own_weights.append(weight[label])
        else:
            blank = [blank[0] + weight[label] * label, blank[1] + weight[label]]
    cuts, rates = calibrate(np.array(votes), np.array(own_labels), np.array(own_weights), share[1])
    return Model(numbers, idf, index, cuts, rates, blank[0] / blank[1])


def document_frequencies(docs: DataFrame, numbers: dict[bytes, int]) -> tuple[np.ndarray, int]:
    """Documents that hold each term, over all documents, and how many documents there are."""
    import pyarrow as pa

    schema = "term int, n bigint"
    out = arrow_schema(schema)

    def count(batches):
        chosen, n = numbers.keys(), np.zeros(len(numbers) + 1, np.int64)
        for batch in batches:
            n[-1] += batch.num_rows
            for text in batch["text"].to_pylist():
                for t in chosen & terms(text).keys():
                    n[numbers[t]] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n)), pa.int32()), pa.array(n)], schema=out)

    totals = docs.select("text").mapInArrow(count, schema).groupBy("term").agg(F.sum("n").alias("n"))
    found = dict(map(tuple, totals.toLocalIterator()))
    return np.array([found.get(i, 0) for i in range(len(numbers))], float), found.get(len(numbers), 0)


def classify(docs: DataFrame, labels: DataFrame, divisor: int = 4, held_out: int = 2,
             per_class: int = PER_CLASS) -> DataFrame:
    """``doc_id, held_out, score, predicted, evidence``: evidence lists the three nearest examples."""
    model = learn(docs, labels, divisor, held_out, per_class)

    # The model travels with the function, by value, as its class does: executors need not have this package.
    def start():
        def row(doc_id, text):
            s, found = model.score(text)
            near = [dict(doc_id=int(model.index.ids[e]), toxic=int(model.index.labels[e]), cosine=c) for c, e in found[:3]]
            return doc_id, s, int(s >= ACCEPT), near
        return row

    scored = per_document(texts(docs), "doc_id bigint, score double, predicted int, "
                          "evidence array<struct<doc_id: bigint, toxic: int, cosine: double>>", start)
    return scored.withColumn("held_out", remainder("doc_id", divisor) == held_out)
