"""Token counters that know where their tokens end.

A tokenizer is a counter: called with a column it gives the number of tokens. ``ends`` gives the UTF-8 byte offset
behind each token, found once per text in Arrow batches, and everything else reads that array: a count is its
length, a cut to ``n`` tokens the text up to entry ``n``, a budget the sum of counts. The work is linear in the text,
whatever ``n``. Null texts have no ends.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = b" \t\r\n"
# From a text's UTF-8 bytes to the offsets behind its tokens, ascending.
EndsFn = Callable[[bytes], "np.ndarray | list[int]"]


@dataclass(frozen=True)
class Tokenizer:
    """A counter by token ends; ``make`` builds the function once per task."""

    make: Callable[[], EndsFn]

    def ends(self, text: Column) -> Column:
        make = self.make

        @F.arrow_udf("array<int>")
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            find = make()
            for batch in batches:
                found = [None if t is None else np.asarray(find(t.encode()), np.int32) for t in batch.to_pylist()]
                yield pa.array(found, pa.list_(pa.int32()))

        return run(text)

    def __call__(self, text: Column) -> Column:
        return F.size(self.ends(text))

    def cut(self, text: Column, n: Column) -> Column:
        """The text up to its ``n``-th token; whole where it has no more. A code point that a token splits
        becomes U+FFFD."""
        ends = self.ends(text)
        head = F.substring(text.cast("binary"), F.lit(1), F.element_at(ends, F.greatest(n, F.lit(1))))
        return F.when(F.size(ends) > n, F.make_valid_utf8(head.cast("string"))).otherwise(text)


def _word_edges(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of bytes other than blanks; no blank is part of a longer character."""
    blank = np.isin(np.frombuffer(text, np.uint8), np.frombuffer(BLANKS, np.uint8))
    inside = np.concatenate([[False], ~blank, [False]])
    return np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(~inside[1:] & inside[:-1])


def words() -> Tokenizer:
    """Runs of characters between blanks, tabs and line breaks."""
    return Tokenizer(lambda: lambda text: _word_edges(text)[1])


def pieces(size: int) -> Tokenizer:
    """Words in pieces of ``size`` code points, the last one shorter: a model-free stand-in for sub-words."""
    if size < 1:
        raise ValueError("a piece has at least one code point")

    def find(text: bytes) -> np.ndarray:
        starts, ends = _word_edges(text)
        if not len(starts):
            return ends
        # Characters by their first bytes; of a word, every size-th one ends a piece before it.
        first = np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
        begin, stop = np.searchsorted(first, starts), np.searchsorted(first, ends)
        bounds = np.append(first, len(text))
        counts = -(-(stop - begin) // size)
        of = np.repeat(np.arange(len(starts)), counts)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts) + 1
        return bounds[np.minimum(begin[of] + nth * size, stop[of])]

    return Tokenizer(lambda: find)


def byte_pairs(ranks: dict[bytes, int], pattern: str) -> Tokenizer:
    """Tokens of a byte-level BPE vocabulary, as the tiktoken library splits them; special strings are plain text.

    The ranks travel with the function, so executors need the library and no file.
    """
    def make() -> EndsFn:
        import tiktoken

        encoding = tiktoken.Encoding("counter", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        sizes = np.zeros(max(ranks.values(), default=0) + 1, np.int64)
        for token, rank in ranks.items():
            sizes[rank] = len(token)
        return lambda text: np.cumsum(sizes[encoding.encode_ordinary(text.decode())])

    return Tokenizer(make)


def from_tokens(split: Callable[[str], list[str]]) -> Tokenizer:
    """A caller's function from a text to its tokens, which must follow each other in the text; what lies between
    two tokens belongs to the later one."""
    def find(text: bytes) -> list[int]:
        at, out, whole = 0, [], text.decode()
        for token in split(whole):
            start = text.index(token.encode(), at)
            at = start + len(token.encode())
            out.append(at)
        return out

    return Tokenizer(lambda: find)
