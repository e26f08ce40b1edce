"""Benchmark decontamination by spaced-seed hashing.

Fixed masks pick some of a run of words and ignore the others, so a substituted word spoils only the masks
that pick it. The hashes of all masks at all positions of the benchmark and of the documents are joined; a
hit fixes how the two texts lie against each other, and around it the overlap is verified word by word:
a stretch of ``STRETCH`` words (or a shorter item as a whole) in which at least ``EQUAL`` of the words agree
is contamination.

The masks miss no overlap that verification accepts, of 8 to 20 words and so of any length: whichever words are
substituted, one mask at one position picks equal words only. Items of fewer than ``LEAST_WORDS`` words match
where all their words stand in a row. Items of the same words are searched once, as one class.

Before the join, a filter of fixed size drops the documents' hashes that no item has; if a huge benchmark
fills it, more reaches the join and the result stays the same. Words are lower-cased runs of letters and
digits. Null or empty texts match nothing. Repeated rows are found each time, under their id; rows and items
without an id are found under a null one, and ``keep_clean`` tells such rows by the hash of their text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmatch.llm.common import FOLDED, WordHashes, arrow_schema, kept, mixed, per_document, texts

MASKS = ("11111", "110111", "11010011")
LEAST_WORDS = 8
STRETCH, EQUAL = 20, 0.8
FILTER_BITS = 1 << 23


def seeds(values: np.ndarray, short: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every mask at every position of a text's word hashes, and the positions.

    ``short`` are lengths of short items: runs of so many words are hashed as a whole.
    """
    hashes, positions = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for number, mask in [*enumerate(MASKS, 1), *((len(MASKS) + n, "1" * n) for n in short)]:
        starts = len(values) - len(mask) + 1
        if starts <= 0:
            continue
        out = np.full(starts, number, np.uint64)
        with np.errstate(over="ignore"):
            for i, picked in enumerate(mask):
                if picked == "1":
                    out = out * np.uint64(0x9E3779B97F4A7C15) + values[i:i + starts]
        hashes.append(mixed(out))
        positions.append(np.arange(starts))
    return np.concatenate(hashes), np.concatenate(positions)


def item_seeds(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An item's seeds; a short item has one, the whole of it."""
    if len(values) >= LEAST_WORDS:
        return seeds(values)
    hashes, positions = seeds(values, (len(values),) if len(values) else ())
    return hashes[-1:], positions[-1:]


def overlap(doc: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int] | None:
    """(equal words, first word, end) of the verified overlap where word ``i`` of the item lies on word
    ``i + shift`` of the document, or none."""
    first, end = max(0, shift), min(len(doc), len(item) + shift)
    length = min(STRETCH, len(item))
    if not length or end - first < length:
        return None
    equal = doc[first:end] == item[first - shift:end - shift]
    sums = np.concatenate([[0], np.cumsum(equal)])
    least = EQUAL * length if length >= LEAST_WORDS else length
    starts = np.flatnonzero(sums[length:] - sums[:-length] >= least)
    if not len(starts):
        return None
    a, z = int(starts[0]), int(starts[-1]) + length
    return int(equal[a:z].sum()), first + a, first + z


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, n_equal, first_word, end_word``: the best verified overlap of each pair."""
    return overlaps(docs, benchmark).drop("text_key")


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """What ``contaminated`` returns, with ``text_key``: the hash of a text without an id, 0 with one."""
    hit = "array<struct<hash: bigint, at: int>>"

    def listed(hashes, positions):
        return [dict(hash=h, at=p) for h, p in zip(hashes.view(np.int64).tolist(), positions.tolist())]

    def read_items():
        words = WordHashes()

        def row(item_id, text):
            values = words.of(text.translate(FOLDED).split())
            return item_id, values.tobytes(), listed(*item_seeds(values))
        return row

    items = kept(per_document(texts(benchmark, "item_id"), "doc_id bigint, words binary, seeds " + hit, read_items)
                 .select(F.col("doc_id").alias("item_id"), F.xxhash64("words").alias("class"),
                         F.col("words").alias("item_words"), "seeds"), "benchmark-seeds")
    classes = items.groupBy("class").agg(F.first("item_words").alias("item_words"), F.first("seeds").alias("seeds"))
    by_hash = classes.select("class", F.explode("seeds").alias("s")).select("class", "s.hash", F.col("s.at").alias("item_at"))
    n_words = F.octet_length("item_words") / 8
    lengths = items.filter(n_words.between(1, LEAST_WORDS - 1)).select(n_words).distinct()
    short = tuple(sorted(int(r[0]) for r in lengths.toLocalIterator()))  # below LEAST_WORDS

    # Two bits per hash in a filter of fixed size; at most FILTER_BITS / 64 numbers reach the driver.
    slots = by_hash.select(F.explode(F.array(F.col("hash").bitwiseAND(FILTER_BITS - 1),
                                                F.shiftright("hash", 32).bitwiseAND(FILTER_BITS - 1))).alias("slot"))
    numbers = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 AS INT)))").alias("bits"))
    filled = np.zeros(FILTER_BITS // 64, np.int64)
    for word, bits in numbers.toLocalIterator():
        filled[word] = bits
    sent = docs.sparkSession.sparkContext.broadcast(np.unpackbits(filled.view(np.uint8), bitorder="little").astype(bool))

    def read_docs():
        import xxhash

        words, maybe, mask = WordHashes(), sent.value, np.uint64(FILTER_BITS - 1)

        def row(doc_id, text):
            values = words.of(text.translate(FOLDED).split())
            hashes, positions = seeds(values, short)
            found = np.flatnonzero(maybe[(hashes & mask).astype(np.int64)]
                                   & maybe[((hashes >> np.uint64(32)) & mask).astype(np.int64)])
            key = 0 if doc_id is not None else int(np.uint64(xxhash.xxh64_intdigest(text, seed=42)).view(np.int64))
            return doc_id, key, values.tobytes() if len(found) else None, listed(hashes[found], positions[found])
        return row

    hits = kept(per_document(texts(docs), f"doc_id bigint, text_key bigint, words binary, hits {hit}", read_docs)
                .filter("words is not null").withColumn("row", F.monotonically_increasing_id()), "decontaminate-hits")
    met = (hits.select("row", F.explode("hits").alias("h")).select("row", F.col("h.hash").alias("hash"), F.col("h.at").alias("at"))
           .join(by_hash, "hash").groupBy("row", "class", (F.col("at") - F.col("item_at")).alias("shift")).agg(F.count("*").alias("n")))
    pairs = met.groupBy("row", "class").agg(F.collect_list("shift").alias("shifts"))
    placed = (pairs.join(hits.select("row", "doc_id", "text_key", "words"), "row")
              .join(classes.select("class", "item_words"), "class"))
    schema = "doc_id bigint, text_key bigint, class bigint, n_equal int, first_word int, end_word int"
    out = arrow_schema(schema)
    read = ("doc_id", "text_key", "class", "shifts", "words", "item_words")

    def verify(batches):
        for batch in batches:
            rows = []
            for doc_id, key, which, shifts, words, item_words in zip(*(batch[c].to_pylist() for c in read)):
                doc, item = np.frombuffer(words, np.uint64), np.frombuffer(item_words, np.uint64)
                found = [o for o in (overlap(doc, item, s) for s in sorted(shifts)) if o]
                if found:
                    rows.append((doc_id, key, which, *max(found, key=lambda o: (o[0], -o[1]))))
            columns = list(zip(*rows)) or [()] * len(out)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, out)], schema=out)

    return (placed.select(*read).mapInArrow(verify, schema).join(items.select("class", "item_id"), "class")
            .select("doc_id", "item_id", "n_equal", "first_word", "end_word", "text_key"))


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without contamination, with all their columns."""
    found = overlaps(docs, benchmark).select(F.col("doc_id").alias("_found_id"), F.col("text_key").alias("_found_key")).distinct()
    key = F.when(docs["doc_id"].isNull(), F.xxhash64(docs["text"])).otherwise(F.lit(0))
    return docs.join(found, docs["doc_id"].eqNullSafe(found["_found_id"]) & (key == found["_found_key"]), "left_anti")
