"""Exact repeats: Rabin-Karp hashes of every window of a fixed number of words, counted over the corpus.

Every window of every whole text is hashed by a rolling polynomial (a second polynomial chooses where it is
counted, so that two windows must agree in both). Windows that start in more than one place, in one document
or in several, are repeated; overlapping ones merge into maximal intervals of words to remove.

Words are compared unchanged. A null or short text has no window and stays as it is, but for its white
space: kept words are joined by one space. Repeated rows repeat each other's windows and lose them all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docmatch.llm.common import WordHashes, arrow_schema, mixed, texts
from docmatch.llm.corpus import Keys, Kind, with_totals

WINDOW = 35
# Odd factors of the two rolling polynomials modulo 2^64.
FACTOR, CHOOSING_FACTOR = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


class Rolling:
    """Polynomial hashes of all windows, from differences of prefix sums."""

    def __init__(self, factor: int, window: int):
        self.factor, self.window = factor, window
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, values: np.ndarray) -> np.ndarray:
        n = len(values)
        if n > len(self.up):
            size = max(n, 2 * len(self.up))
            for name, factor in (("up", self.factor), ("down", pow(self.factor, -1, 1 << 64))):
                powers = np.full(size, factor, np.uint64)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * self.up[:n], out=sums[1:])
        starts = n - self.window + 1
        return mixed((sums[self.window:] - sums[:starts]) * self.down[:starts])


def intervals(starts: np.ndarray, window: int) -> np.ndarray:
    """Maximal (first word, end) intervals that windows at the sorted ``starts`` cover."""
    if not len(starts):
        return np.empty((0, 2), np.int64)
    gap = np.flatnonzero(np.diff(starts) > window)
    return np.stack([starts[np.r_[0, gap + 1]], starts[np.r_[gap, len(starts) - 1]] + window], 1)


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, removed, text``: the intervals of words removed, and the words that stay."""
    schema = (f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_words bigint, "
              "removed array<struct<start: bigint, end: bigint>>, text string")
    out = arrow_schema(schema)

    def keys_of(table: pa.Table) -> list[Keys]:
        known, first, second = WordHashes(), Rolling(FACTOR, window), Rolling(CHOOSING_FACTOR, window)
        hashes, choose = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
        for text in table["text"]:
            words = text.as_py().split()
            if len(words) >= window:
                values = known.of(words)
                hashes.append(first.of(values))
                choose.append(second.of(mixed(values)))
        return [Keys(np.concatenate(hashes), np.concatenate(choose))]

    def use(table: pa.Table, totals: list[np.ndarray]) -> pa.Table:
        starts_in, = totals
        counts, removed, left, at = [], [], [], 0
        for text in table["text"]:
            words = text.as_py().split()
            windows = max(0, len(words) - window + 1)
            found = intervals(np.flatnonzero(starts_in[at:at + windows] > 1), window)
            at += windows
            counts.append(len(words))
            removed.append([dict(start=int(a), end=int(b)) for a, b in found])
            for a, b in found[::-1]:
                del words[a:b]
            left.append(b" ".join(words))
        return pa.Table.from_arrays(
            [table["doc_id"], pa.array(counts, pa.int64()), pa.array(removed, out[2].type),
             pa.array(left, pa.binary()).cast(pa.string())], schema=out)

    return with_totals(texts(docs, id_col, text_col), [Kind(8)], keys_of, use, schema)
