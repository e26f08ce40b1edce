"""Small helpers that the operators of this package share.

Words are maximal runs without ASCII white space, which is what ``bytes.split`` yields, and
lower-casing touches A-Z only, which is what ``bytes.lower`` does.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docmatch.sources.staging import new_path

# Words whose hash a task remembers; beyond that the memory is emptied, the results stay the same.
REMEMBERED = 1 << 19
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """The two columns an operator reads, as ``doc_id`` and ``text`` in bytes; a null text is empty.

    All other columns, whatever their names, are left behind at the scan.
    """
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"),
                       F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"), *more)


def remainder(id_col: str | Column, divisor: int) -> Column:
    """crc32 of an id's decimal text, modulo ``divisor``; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % divisor, F.lit(0))


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema for a DDL string of this package's output tables."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(ddl))


def per_document(docs: DataFrame, schema: str, start: Callable[[], Callable[[object, bytes], tuple]],
                 rows_per_batch: int = 512) -> DataFrame:
    """One output row per (doc_id, text), made by the function that ``start`` builds once per task.

    Rows leave in batches of ``rows_per_batch``, so a task holds one incoming batch and one outgoing.
    """
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = start()
        for batch in batches:
            for at in range(0, batch.num_rows, rows_per_batch):
                part = batch.slice(at, rows_per_batch)
                rows = [make(i, t) for i, t in zip(part["doc_id"].to_pylist(), part["text"].to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(values), kind.type) for values, kind in zip(zip(*rows), out)], schema=out)

    return docs.mapInArrow(run, schema)


def mixed(values: np.ndarray) -> np.ndarray:
    """Mix 64-bit values so that every bit depends on every other (a public-domain finaliser)."""
    x = values.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """64-bit hashes of words, remembered per task."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def ngram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` words; with fewer words, the whole sequence as one; without words, none."""
    if not len(hashes):
        return hashes
    n = min(n, len(hashes))
    last = len(hashes) - n + 1
    out = np.full(last, n, np.uint64)
    for i in range(n):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i:i + last])
    return out




def labelled(labels: DataFrame, label_col: str, divisor: int, held_out: int) -> tuple[DataFrame, dict[int, int]]:
    """``doc_id, label`` of the labelled rows that teach, and the rows of each class.

    Rows held out (crc32 of the id modulo ``divisor`` equals ``held_out``), null ids and null labels teach
    nothing. A document labelled twice counts once, with its larger label.
    """
    rows = (labels.select("doc_id", F.col(label_col).cast("int").alias("label"))
            .filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)
                    & (remainder("doc_id", divisor) != held_out))
            .groupBy("doc_id").agg(F.max("label").alias("label")))
    return rows, {r["label"]: r["count"] for r in rows.groupBy("label").count().toLocalIterator()}


def labelled_sample(labels: DataFrame, label_col: str, divisor: int, held_out: int,
                    per_class: int) -> tuple[DataFrame, dict[int, int]]:
    """At most ``per_class`` rows of each class of ``labelled``, and the rows of each class.

    The sample takes the lowest hashes of the ids, so it is the same on every run; ``per_class`` bounds what
    may be broadcast.
    """
    rows, counts = labelled(labels, label_col, divisor, held_out)
    picked = [rows.filter(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    return picked[0].unionByName(picked[1]), counts


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder, compressed well, and return the stored table.

    What was shuffled for it is deleted when it is written, not when the driver happens to collect garbage.
    """
    path, conf = new_path(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(CLEAN_UP, "false")
    conf.set(CLEAN_UP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        conf.set(CLEAN_UP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Lower case, and a space for what is neither a letter, a digit nor part of a multi-byte character.
FOLDED = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))


def same_columns(docs: DataFrame, start: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]) -> DataFrame:
    """Rows changed or left out in place, whatever other columns there are; nothing is shuffled."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        change = start()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                yield change(batch.slice(at, 512)).cast(out)

    return docs.mapInArrow(run, docs.schema)
