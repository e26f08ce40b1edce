"""Text expressions: trimming, fences, chunking and token counting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docmatch.functions.tokens import Tokenizer

TokenCounter = Callable[[Column], Column]
FENCE = "```"


_BLANK = r"[\s\x1c-\x1f]+"


def strip(text: Column) -> Column:
    """Remove all Unicode white space at both ends (``trim`` removes blanks only)."""
    return F.regexp_replace(text, rf"(?U)^{_BLANK}|{_BLANK}\z", "")


def strip_fence(text: Column) -> Column:
    """Take a code fence off a model answer.

    An opening fence goes together with the rest of its line; a closing fence goes from the end. An
    opening fence without a line break leaves nothing. Each step reads the one before it once, so the
    plan holds every pattern once.
    """
    opened = F.regexp_replace(strip(text), rf"^{FENCE}[^\n]*(?:\n|\z)", "")
    return strip(F.regexp_replace(strip(opened), rf"{FENCE}\z", ""))


def chunks(text: Column, size: int | Column) -> Column:
    """Split into pieces of ``size`` code points; a size of 0 or less keeps the text whole.

    One regular-expression pass keeps the cost linear in the text; repeated ``substring`` calls
    would rescan the text for every piece.
    """
    size = F.lit(size) if isinstance(size, int) else size
    pieces = F.regexp_extract_all(text, F.concat(F.lit("(?s).{1,"), size.cast("string"), F.lit("}")), F.lit(0))
    return F.when((size <= 0) | (F.length(text) <= size), F.array(text)).otherwise(pieces)


def count_chars(text: Column) -> Column:
    """Default token counter: one token per code point."""
    return F.length(text)


def count_words(text: Column) -> Column:
    """Token counter: runs of characters between blanks, tabs and line breaks."""
    return F.size(F.filter(F.split(text, r"[ \t\r\n]+"), lambda w: w != ""))


def truncate_words(text: Column, n: int | Column) -> Column:
    """Keep the text up to its ``n``-th token of the word counter, blanks between tokens included;
    ``n <= 0`` keeps the text whole."""
    n = F.lit(n) if isinstance(n, int) else n
    # Tokens, each with the blanks before it: one linear pass, no repeated group that could exhaust the stack.
    tokens = F.regexp_extract_all(text, F.lit(r"[ \t\r\n]*[^ \t\r\n]+"), F.lit(0))
    return F.when(n <= 0, text).otherwise(F.array_join(F.slice(tokens, F.lit(1), F.greatest(n, F.lit(1))), ""))


def truncate(text: Column, n: int | Column, counter: TokenCounter | None = None) -> Column:
    """Keep the first ``n`` tokens as ``counter`` counts them (code points unless given).

    A ``tokens.Tokenizer`` cuts where its ``n``-th token ends. Any other counter is asked for the longest beginning of at most ``n`` tokens; it
    must not fall as a text grows.
    """
    if counter in (None, count_chars):
        return truncate_chars(text, n)
    if counter is count_words:
        return truncate_words(text, n)
    n = F.lit(n) if isinstance(n, int) else n
    if isinstance(counter, Tokenizer):
        return F.when(n <= 0, text).otherwise(counter.cut(text, n))
    # Halving steps over the length: each adds the next smaller power of two where the beginning still fits.
    steps = F.transform(F.sequence(F.lit(30), F.lit(0), F.lit(-1)), lambda i: F.pow(F.lit(2), i).cast("int"))
    fits = F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        (at + step <= F.length(text)) & (counter(F.substring(text, F.lit(1), at + step)) <= n), at + step).otherwise(at))
    return F.when(n <= 0, text).otherwise(F.substring(text, F.lit(1), fits))


def truncate_chars(text: Column, n: int | Column) -> Column:
    """Keep the first ``n`` tokens of the character counter; ``n <= 0`` keeps the text whole."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(n <= 0, text).otherwise(F.substring(text, F.lit(1), n))
