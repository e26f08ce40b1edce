"""Spelling variants: words one edit apart, found by sorted permuterm rotations.

A word ``w`` of L code points, marked at its end by ``$``, has a rotation for each place of the mark. The rotation
that starts behind code point i ends with that code point, so all words that differ there, and there only, share
the rest as a prefix: ``w[i+1:] $ w[:i]``. A word that lacks the code point has this prefix as its whole rotation.
So the prefix ranges of the sorted rotations, each without the edited code point, are groups of words that are
all one edit apart: one member without the code point at most, and one per code point of the alphabet, 91 in all.

Rotations are range-partitioned by prefix, sorted within it by occurrences, and scanned once. A member of a group
needs two neighbours only, the first and the second of the order, and a count; pairs are never made. A deletion
out of a run of equal code points leads to the same word from each of them; it counts where the run begins.

Words are read and counted in the tasks that read the texts and added up in Spark, so a frequent word is a row per
task. ``forms`` never leave Spark; roots follow by joins on written tables, halving what is left of a path each
time. A form has ten times the occurrences of its word, so paths are short and have no circles.

Null, empty and wordless texts give no words. Rows are counted as they come, repeated ones too; a null id reads as
empty in the hash. Of neighbours with equal counts the smallest in code-point order is the form. Rotations of words
of more than ``LONG`` code points are held as digests, next to the word: memory stays in proportion to the word.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmatch.llm.common import kept, texts

LEAST_CHARS, LEAST_COUNT, FORM_RATIO, TYPO_DIVISOR = 7, 2, 10, 31
LONG = 128
# Words that a task counts before it sends what it has.
COUNTED = 1 << 18
END = "$"
RUN = "[a-zÀ-ÿ]{%d,}"  # A-Z are lower-cased before


def words(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT,
          id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n``: the words of all documents with their occurrences.

    A run of letters whose crc32 with its document's id is a multiple of ``TYPO_DIVISOR`` loses a code point.
    Runs shorter than ``least_chars`` cannot become words.
    """
    runs = re.compile(RUN % least_chars)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"word": pa.array(seen.keys(), pa.string()), "n": pa.array(seen.values(), pa.int64())})

        for batch in batches:
            for i, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                start = zlib.crc32(b"%s:" % (b"" if i is None else str(i).encode()))
                for run, n in Counter(runs.findall(text.lower().decode("utf-8", "replace"))).items():
                    h = zlib.crc32(run.encode(), start)
                    if h % TYPO_DIVISOR == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1:]
                        if len(run) < least_chars:
                            continue
                    seen[run] += n
                if len(seen) >= COUNTED:
                    yield sent()
                    seen.clear()
        yield sent()

    counted = texts(docs, id_col, text_col).mapInArrow(count, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def rotations(counted: DataFrame) -> DataFrame:
    """``prefix, edited, once, n, long``: a word's rotations, each without its last code point, and each whole.

    ``edited`` is the code point left out, empty for a whole rotation. ``once`` marks the first of equal ones in
    a row. ``long`` is the word itself where the prefix is a digest.
    """
    n_chars = F.char_length("word")
    each = counted.select("word", "n", n_chars.alias("size"), F.explode(F.sequence(F.lit(0), 2 * n_chars)).alias("i"))
    whole = F.col("i") >= F.col("size")
    at = F.when(whole, F.col("i") - F.col("size")).otherwise(F.col("i"))
    behind = F.when(whole, at + 1).otherwise(at + 2)
    head = F.substring("word", F.lit(1), at)
    edited = F.when(whole, "").otherwise(F.substring("word", at + 1, F.lit(1)))
    rotation = F.concat(F.substring("word", behind, F.col("size")), F.lit(END), head)
    digest = F.char_length(rotation) > LONG
    return each.select(
        F.when(digest, F.sha2(rotation, 256)).otherwise(rotation).alias("prefix"), edited.alias("edited"),
        (~whole & (edited != F.right(head, F.lit(1)))).alias("once"), "n", F.when(digest, F.col("word")).alias("long"))


def neighbours(counted: DataFrame) -> DataFrame:
    """``word, n_near, best``: for words that have any, how many near words, and ``n, word`` of the best one."""
    rotated = rotations(counted).repartitionByRange("prefix")
    word: Column = F.coalesce("long", F.concat(F.substring_index("prefix", END, -1), F.col("edited"), F.substring_index("prefix", END, 1)))
    group = Window.partitionBy("prefix").orderBy(F.desc("n"), "word")
    over = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    whole = F.col("edited") == ""
    other = F.struct((-F.col("n")).alias("n"), "word")
    ranged = rotated.select("prefix", "edited", "once", "n", word.alias("word")).withColumns({
        "_place": F.row_number().over(group), "_second": F.lead(other).over(group), "_first": F.first(other).over(over),
        "_size": F.count(F.lit(1)).over(over), "_once": F.sum(F.col("once").cast("int")).over(over),
        "_whole": F.sum(whole.cast("int")).over(over)})
    near = F.when(whole, F.col("_once")).otherwise(F.col("_size") - F.col("_whole") - 1 + F.when(F.col("once"), F.col("_whole")).otherwise(0))
    best = F.when(F.col("_place") == 1, F.col("_second")).otherwise(F.col("_first"))
    return (ranged.filter("_size > 1").select("word", near.alias("near"), best.alias("best"))
            .groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best")))


def roots(links: DataFrame) -> DataFrame:
    """``word, root`` for every word of ``links(word, form)``: the end of its path of forms."""
    paths = kept(links.select("word", F.col("form").alias("root")), "spelling-paths")
    while True:
        onward = paths.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        longer = kept(paths.join(onward, "root", "left"), "spelling-paths")
        paths = longer.select("word", F.coalesce("_further", "root").alias("root"))
        if longer.filter(F.col("_further").isNotNull()).isEmpty():
            return paths


def variants(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, ratio: int = FORM_RATIO,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word."""
    if ratio < 2:
        raise ValueError("a form must be more frequent than its word")
    counted = kept(words(docs, least_chars, least_count, id_col, text_col), "spelling-words")
    is_form = -F.col("best.n") >= ratio * F.col("n")
    found = kept(counted.join(neighbours(counted), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, -F.col("best.n")).alias("form_n")), "spelling-forms")
    ends = roots(found.filter("form is not null").select("word", "form"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
