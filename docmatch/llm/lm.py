"""Language-model scores by online logistic context mixing.

A text is a sequence of words (A-Z in lower case) and an end. Each token is told by at most two bits and a
choice: does it follow its predecessor as it did in training; if not, is it a training word at all. A word
that follows is chosen by how often it did, another one by how often it occurs, an unknown one is spelled
(``byte_mixer``), so the probabilities of all tokens sum to at most one and every byte is paid.

Each bit is predicted by several contexts with their outcomes in training: the predecessor (by its 64-bit
hash), how often it occurred, and the latest outcomes. Their predictions are mixed in the logistic domain by
weights that the predecessor's frequency selects, and an adaptive stage per document corrects the mix as the
document goes on.

All counts cover all training documents of the corpus: of words and pairs, then of the outcomes after each
predecessor (both by ``corpus.with_totals``), then of the outcomes in each cell of what the contexts say. The
cells are few whatever the corpus; one set of weights is fitted to them and scores every document. A training
document is scored by counts of words, pairs, predecessors and spellings that leave itself out (of spellings, one
occurrence), so its score compares with that of one held out. A word that no other training document has is what
spelling is learned from. A null or empty text is the end alone. Documents of equal text have equal scores
where both are trained on or both held out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmatch.llm import byte_mixer
from docmatch.llm.common import arrow_schema, kept, mixed, remainder, texts
from docmatch.llm.corpus import Keys, Kind, with_totals

# Hashes of the start and the end, which no word's hash is made from.
START, END = np.uint64(0x5374617274), np.uint64(0x456E64)
PAIR_FACTOR = np.uint64(0x9E3779B97F4A7C15)
FREQUENCIES, HISTORIES = 48, 64
# What a predecessor says is told in steps of 1/16, as one signed byte.
LEVELS, PER_UNIT = 256, 16
# The two bits of a token: does it follow, is it known. A cell is all that the contexts of a bit say, and the bit.
FOLLOWS, KNOWN = 0, 1
CELLS = 2 * FREQUENCIES * 8 * LEVELS * 2
IN_WORD = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])
# Bytes of words hashed at a time, and the values of each byte in the first places.
HASHED_BYTES, PLACED = 1 << 20, mixed(np.arange(32 * 256) + 1)
# Words per step of a document's own correction, documents scored at a time, rounds of fitting the weights.
OWN_STEP, OWN_RATE, AT_A_TIME, ROUNDS = 32, 0.02, 1024, 12


def stretch(p):
    return np.log(p / (1 - p))


def squash(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Words:
    """All words of some texts: lower-cased letters, where each word starts and ends, how many each text has,
    and their 64-bit hashes. A word's hash adds up a mixed value per byte and place; some are hashed at a time."""

    letters: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    numbers: np.ndarray
    hashes: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes]) -> Words:
        letters = np.frombuffer(b" ".join([*texts, b""]).lower(), np.uint8)
        inside = np.zeros(len(letters) + 2, bool)
        inside[1:-1] = IN_WORD[letters]
        change = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = change[::2], change[1::2]
        bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
        hashes, size = np.empty(len(starts), np.uint64), np.cumsum(ends - starts)
        at = 0
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(size, size[at] + HASHED_BYTES)))
            some = slice(starts[at], ends[to - 1])
            lengths = ends[at:to] - starts[at:to]
            first = np.cumsum(lengths) - lengths
            code = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
            code = (code << 8) + letters[some][inside[1:-1][some]]
            values = PLACED.take(np.minimum(code, len(PLACED) - 1))
            late = np.flatnonzero(code >= len(PLACED))
            values[late] = mixed(code[late] + 1)
            hashes[at:to] = mixed(np.add.reduceat(values, first) + lengths.astype(np.uint64))
            at = to
        return cls(letters, starts, ends, np.diff(np.searchsorted(starts, bounds)), hashes)


class Tokens:
    """All tokens of a batch, document after document."""

    def __init__(self, table: pa.Table):
        self.words = Words.of(table["text"].to_pylist())
        self.lengths = self.words.numbers + 1
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        self.word = np.empty(int(self.lengths.sum()), np.uint64)
        is_word = np.ones(len(self.word), bool)
        is_word[self.ends - 1] = False
        self.word[is_word], self.word[~is_word] = self.words.hashes, END
        self.before = np.empty_like(self.word)
        self.before[1:] = self.word[:-1]
        self.before[self.starts] = START
        self.doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        self.pair = mixed(self.before * PAIR_FACTOR + self.word)
        self.learn = np.array(table["learn"].to_pylist(), bool)[self.doc]


def of_same_document(tokens: Tokens, hashes: np.ndarray, counts: np.ndarray | None = None,
                     own: np.ndarray | None = None) -> np.ndarray:
    """How often each token's key occurs (or what it counts, a row for each column) in its document, for
    documents that are learned from; else 0. ``own`` are the tokens that take part."""
    out = np.zeros((1 if counts is None else len(counts), len(hashes)), np.int64)
    own = np.flatnonzero(tokens.learn if own is None else tokens.learn & own)
    group = pd.factorize(mixed(hashes[own] + tokens.doc[own].astype(np.uint64) * PAIR_FACTOR))[0]
    for row, c in zip(out, [None] if counts is None else counts):
        row[own] = np.bincount(group, None if c is None else c[own])[group]
    return out if counts is not None else out[0]


def outcomes(word_count: np.ndarray, pair_count: np.ndarray, before_count: np.ndarray) -> np.ndarray:
    """One byte per token: whether it follows, whether it is known, and how often its predecessor occurs."""
    frequency = np.minimum(FREQUENCIES - 1, (2 * np.log2(before_count + 1)).astype(np.int64))
    return ((pair_count > 0) + 2 * (word_count > 0) + 4 * frequency).astype(np.uint8)


def choices(word_count: np.ndarray, pair_count: np.ndarray, before_count: np.ndarray, total: int) -> np.ndarray:
    """Log10 probability of each token among those that its two bits leave."""
    follows, known = pair_count > 0, word_count > 0
    out, chosen = np.zeros(len(follows)), ~follows & known
    out[follows] = np.log10(pair_count[follows] / before_count[follows])
    out[chosen] = np.log10(word_count[chosen] / total)
    return out


@dataclass
class Told:
    """The bits of all tokens of some documents, and what is known before each."""

    follows: np.ndarray
    known: np.ndarray
    frequency: np.ndarray
    latest: np.ndarray
    position: np.ndarray
    doc: np.ndarray

    @classmethod
    def of(cls, codes: np.ndarray, lengths: np.ndarray) -> Told:
        starts = np.cumsum(lengths) - lengths
        follows, known = (codes & 1).astype(bool), (codes & 2).astype(bool)
        last = np.zeros((3, len(codes)), np.int64)
        for i, outcome in enumerate((follows, known)):
            last[i, 1:] = outcome[:-1]
            last[i, starts] = 0
        last[2, 1:] = last[0, :-1]
        last[2, starts] = 0
        doc = np.repeat(np.arange(len(lengths)), lengths)
        return cls(follows, known, (codes >> 2).astype(np.int64), last[0] + 2 * last[1] + 4 * last[2],
                   np.arange(len(codes)) - starts[doc], doc)

    def bits(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """The tokens that are told this bit, and the bit: a token can follow a word that occurred; one that
        does not follow is known or not."""
        some = np.flatnonzero(self.frequency > 0) if kind == FOLLOWS else np.flatnonzero(~self.follows)
        return some, (self.follows if kind == FOLLOWS else self.known)[some]

    def cells(self, kind: int, some: np.ndarray, bits: np.ndarray, said: np.ndarray) -> np.ndarray:
        """Numbers of the cells; ``said`` is what the predecessors say, in steps."""
        cell = ((kind * FREQUENCIES + self.frequency[some]) * 8 + self.latest[some]) * LEVELS
        return 2 * (cell + said[some] + LEVELS // 2) + bits


def says(ones: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """What outcomes so far say about the next one, in steps."""
    return np.clip(np.rint(PER_UNIT * stretch((ones + 0.4) / (seen + 0.8))), 1 - LEVELS // 2, LEVELS // 2 - 1).astype(np.int8)


@dataclass
class Model:
    """What each cell's bit is mixed to, in the logistic domain."""

    logits: np.ndarray

    @classmethod
    def fit(cls, counts: np.ndarray) -> Model:
        """Fit the mixing weights to how often each cell occurred in training, by Newton's method."""
        n = counts.reshape(2, FREQUENCIES, 8, LEVELS, 2).astype(float)
        frequency = np.arange(FREQUENCIES)
        by_frequency, by_latest = n.sum((2, 3)), n.sum(3)
        by_history = np.zeros((2, HISTORIES // 8, 8, 2))
        for f in frequency:
            by_history[:, f // 6] += by_latest[:, f]
        level = np.broadcast_to((np.arange(LEVELS) - LEVELS // 2) / PER_UNIT, (8, LEVELS))
        logits = np.zeros((2, FREQUENCIES, 8, LEVELS))

        def inputs(kind: int, f: int, without: int | None) -> np.ndarray:
            """(latest, level, context) for a bit; in training without the bit itself."""
            def of(table):
                seen, ones = table.sum(-1), table[..., 1]
                if without is not None:
                    seen, ones = np.maximum(0, seen - 1), np.maximum(0, ones - without)
                return np.clip(stretch((np.minimum(ones, seen) + 0.4) / (seen + 0.8)), -8, 8)

            said = np.broadcast_to(of(by_history[kind, f // 6])[:, None], (8, LEVELS))
            return np.stack([np.full((8, LEVELS), of(by_frequency[kind, f])), level, said], -1)

        for kind in (FOLLOWS, KNOWN):
            for f in frequency:
                x = np.concatenate([inputs(kind, f, bit).reshape(-1, 3) for bit in (0, 1)])
                size = np.concatenate([n[kind, f, :, :, bit].ravel() for bit in (0, 1)])
                bit = np.repeat([0.0, 1.0], 8 * LEVELS)
                x, size, bit = x[size > 0], size[size > 0], bit[size > 0]
                start = w = np.full(3, 1 / 3)

                def loss(w):
                    return size @ np.logaddexp(0, np.where(bit > 0, -1, 1) * (x @ w)) + 4 * ((w - start) ** 2).sum()

                for _ in range(ROUNDS):
                    p = squash(x @ w)
                    gradient = x.T @ (size * (p - bit)) + 8 * (w - start)
                    step = np.linalg.solve((x.T * (size * p * (1 - p))) @ x + 8 * np.eye(3), gradient)
                    while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:
                        step = step / 2
                    w = w - step
                logits[kind, f] = inputs(kind, f, None) @ w
        return cls(logits.ravel())

    def log_bits(self, told: Told, said: np.ndarray) -> np.ndarray:
        """Log10 probability of each token's bits, each document's own correction included."""
        out = np.zeros(len(told.doc))
        for kind in (FOLLOWS, KNOWN):
            some, bits = told.bits(kind)
            p = corrected(self.logits[told.cells(kind, some, bits, said[kind]) // 2], bits, told.doc[some], told.position[some])
            out[some] += np.log10(np.where(bits, p, 1 - p))
        return out


def corrected(logits: np.ndarray, bits: np.ndarray, doc: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Probability of a one for each bit. Each document corrects the mix from its past only, a few words at a time."""
    shift = np.zeros(int(doc.max(initial=-1)) + 1)
    step = position // OWN_STEP
    order = np.argsort(step, kind="stable")
    bounds = np.searchsorted(step[order], np.arange(int(step.max(initial=-1)) + 2))
    p = np.empty(len(bits))
    for a, z in zip(bounds, bounds[1:]):
        some = order[a:z]
        p[some] = squash(logits[some] + shift[doc[some]])
        np.add.at(shift, doc[some], OWN_RATE * (bits[some] - p[some]))
    return np.clip(p, 1e-6, 1 - 1e-6)


def log_probabilities(tokens: Tokens, word_count: np.ndarray, pair_count: np.ndarray, before_count: np.ndarray,
                      total: int, said: np.ndarray | None = None, model: Model | None = None) -> np.ndarray:
    """Log10 probability of each token, by counts that leave its own document out; without a model, by one
    that has learned nothing."""
    told = Told.of(outcomes(word_count, pair_count, before_count), tokens.lengths)
    said = np.zeros((2, len(tokens.word)), np.int8) if said is None else said
    return (choices(word_count, pair_count, before_count, total)
            + (model or Model.fit(np.zeros(CELLS))).log_bits(told, said))


def joined(table: pa.Table | pa.RecordBatch, column: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(table[column].to_pylist()), kind)


# ``base`` and ``chosen`` are sums of logarithms of counts; ``share`` adds up to the number of distinct training words.
TOLD = ("doc_id bigint, learn boolean, size bigint, n_tokens bigint, n_known bigint, n_chosen bigint, "
        "base double, chosen double, share double, codes binary")


def cut(values: np.ndarray, tokens: Tokens) -> pa.Array:
    return pa.array([values[a:z].tobytes() for a, z in zip(tokens.starts, tokens.ends)], pa.binary())


def with_predecessors(told: DataFrame) -> DataFrame:
    """Add what the predecessor of each token says about its two bits, counted over all training documents.

    A token whose predecessor no other training document has is told nothing by it. ``spelled`` are the words
    that no other training document has, each with a space after it; an unknown end is the space alone.
    """
    schema = f"{TOLD}, said_follows binary, said_known binary, spelled binary"
    out = arrow_schema(schema)

    def read(table: pa.Table):
        tokens, codes = Tokens(table), joined(table, "codes", np.uint8)
        follows, known = (codes & 1).astype(bool), (codes & 2).astype(bool)
        return table, tokens, codes, np.stack([tokens.learn, tokens.learn & follows, tokens.learn & ~follows & known])

    def keys_of(batch) -> list[Keys]:
        _, tokens, codes, counts = batch
        can = codes > 3
        before = tokens.before[can]
        return [Keys(before, mixed(before), counts[:, can])]

    def use(batch, totals: list[np.ndarray]) -> pa.Table:
        table, tokens, codes, counts = batch
        can = codes > 3
        others = np.zeros((3, len(can)), np.int64)
        others[:, can] = totals[0]
        seen, follow, known = others - of_same_document(tokens, tokens.before, counts, can)
        columns = [table[c] for c in out.names[:-3]]
        columns += [cut(says(follow, seen), tokens), cut(says(known, seen - follow), tokens),
                    pa.array(spelled(codes & 3 == 0, tokens), pa.binary())]
        return pa.Table.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], schema=out)

    return with_totals(told, [Kind(8, columns=3)], keys_of, use, schema, read)


def spelled(unknown: np.ndarray, tokens: Tokens) -> list[bytes]:
    """The unknown tokens of each document, a space after each."""
    words, letters = tokens.words, tokens.words.letters.tobytes()
    out: list[list[bytes]] = [[] for _ in tokens.lengths]
    at = np.flatnonzero(unknown)
    doc, end = tokens.doc[at], at == tokens.ends[tokens.doc[at]] - 1
    # A document's end is no word, so a token's word stands as many places earlier as there are documents before.
    which = np.where(end, 0, at - doc)
    starts, ends = ((w[which] if len(w) else np.zeros(len(at), int)) for w in (words.starts, words.ends))
    for d, e, a, z in zip(doc.tolist(), end.tolist(), starts.tolist(), ends.tolist()):
        out[d].append(b" " if e else letters[a:z] + b" ")
    return [b"".join(o) for o in out]


def parts(batches):
    """Some documents at a time: their rows, bits and what predecessors say."""
    for batch in batches:
        for at in range(0, batch.num_rows, AT_A_TIME):
            part = batch.slice(at, AT_A_TIME)
            lengths = np.array(part["n_tokens"].to_pylist(), np.int64)
            said = np.stack([joined(part, f"said_{c}", np.int8) for c in ("follows", "known")]).astype(np.int64)
            yield part, Told.of(joined(part, "codes", np.uint8), lengths), said


def count_cells(told: DataFrame) -> np.ndarray:
    """How often each cell occurs in all training documents; at most ``CELLS`` numbers reach the driver."""
    schema = "cell int, n bigint"
    out = arrow_schema(schema)

    def count(batches):
        n = np.zeros(CELLS, np.int64)
        for _, t, said in parts(batches):
            for kind in (FOLLOWS, KNOWN):
                n += np.bincount(t.cells(kind, *t.bits(kind), said[kind]), minlength=CELLS)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at])], schema=out)

    counts = np.zeros(CELLS, np.int64)
    for cell, n in told.filter("learn").mapInArrow(count, schema).groupBy("cell").agg(F.sum("n")).toLocalIterator():
        counts[cell] = n
    return counts


def score(docs: DataFrame, divisor: int = 7, held_out: int = 2) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte``."""
    source = texts(docs, "doc_id", "text", (remainder("doc_id", divisor) != held_out).alias("learn"))
    documents = source.filter("learn").count()
    schema = f"{TOLD}, text binary"
    out = arrow_schema(schema)

    def read(table: pa.Table) -> tuple[pa.Table, Tokens]:
        return table, Tokens(table)

    def keys_of(batch) -> list[Keys]:
        tokens = batch[1]
        return [word_keys(tokens), Keys(tokens.pair, tokens.pair, tokens.learn)]

    def use(batch, totals: list[np.ndarray]) -> pa.Table:
        (table, tokens), (word_total, pair_total) = batch, totals
        word_count = word_total - of_same_document(tokens, tokens.word)
        pair_count = pair_total - of_same_document(tokens, tokens.pair)
        before_count = np.empty_like(word_count)
        before_count[1:] = word_count[:-1]
        before_count[tokens.starts] = documents - tokens.learn[tokens.starts]
        # A pair counts at most as often as what it begins with; hashed pairs may share a count.
        pair_count = np.minimum(pair_count, before_count)

        def per_doc(values):
            return pa.array(np.bincount(tokens.doc, values, len(tokens.lengths)))

        size = np.array([len(t.as_py()) for t in table["text"]]) + 1
        columns = [table["doc_id"], table["learn"], pa.array(size), pa.array(tokens.lengths),
                   per_doc(word_total > 0).cast(pa.int64()), per_doc((pair_count == 0) & (word_count > 0)).cast(pa.int64()),
                   per_doc(np.log10(word_total + 1)), per_doc(choices(word_count, pair_count, before_count, 1)),
                   per_doc(tokens.learn / np.maximum(1, word_total)),
                   cut(outcomes(word_count, pair_count, before_count), tokens), table["text"]]
        return pa.Table.from_arrays(columns, schema=out)

    # Half of a pair's hash will do: pairs are contexts, words count exactly.
    told = kept(with_totals(source, [Kind(8), Kind(4)], keys_of, use, schema, read), "lm-outcomes")
    told = kept(with_predecessors(told), "lm-told")
    # Each of the c occurrences of a training word adds 1 / c.
    total, vocabulary = told.filter("learn").agg(F.sum("n_tokens"), F.sum("share")).first()
    return scored(told, Model.fit(count_cells(told)), byte_mixer.learn(told), total or 0, round(vocabulary or 0))


def scored(told: DataFrame, model: Model, speller: byte_mixer.Speller, total: int, vocabulary: int) -> DataFrame:
    """Every document by the one model."""
    schema = ("doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
              "base_score double, score double, bits_per_byte double")
    out = arrow_schema(schema)

    def run(batches):
        for part, t, said in parts(batches):
            size, n_tokens, n_chosen, base, chosen = (
                np.array(part[c].to_pylist()) for c in ("size", "n_tokens", "n_chosen", "base", "chosen"))
            learned, words = np.array(part["learn"].to_pylist(), bool), part["spelled"].to_pylist()
            doc = np.repeat(np.arange(part.num_rows), [len(w) for w in words])
            scores = (chosen - n_chosen * np.log10(max(1, total)) + np.bincount(t.doc, model.log_bits(t, said), part.num_rows)
                      + np.bincount(doc, speller.log10(b"".join(words), learned[doc]), part.num_rows))
            base = base - n_tokens * np.log10(total + vocabulary + 1)
            held = pa.array(~learned)
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], held, part["n_tokens"], part["n_known"], pa.array(np.full(len(size), total, np.int64)),
                 pa.array(base), pa.array(scores), pa.array(-scores * np.log2(10) / size)], schema=out)

    return told.mapInArrow(run, schema)


def word_keys(tokens: Tokens) -> Keys:
    return Keys(tokens.word, mixed(tokens.word), tokens.learn)
