"""Line deduplication in plain DataFrame expressions: one document keeps a line that many hold.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Keys of ``least_chars`` code
points and more that ``least_docs`` documents hold stay in the document with the largest id and leave all others.
Keys travel as 96 bits of hash; texts don't move until bitmaps meet them.

Hashes are range-partitioned and sorted by document and position, largest document first, so one pass over a
range sees a hash's documents one after the other: the first occurrence names the document that keeps the line,
every change of document counts. A hash is cut into shards by document, as many as keep the shard of a line that
every document holds within ``SHARD_LINES``; what shards found is added up per hash, combined before the shuffle.
Hashes that many documents hold then meet the stored lines in a join whose hot keys Spark splits.

``keep_bitmaps`` returns bitmaps instead of texts: of every document that loses lines, the runs of lines that stay
(a run-length compressed bitmap). ``dedup_lines`` applies them to the texts.

A null or empty text is one empty line. Rows with a null id count as one document, smaller than all others. Rows
with one id and different texts are one document too, each with a bitmap of its own; repeated rows stay repeated.
An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmatch.llm.common import kept

LEAST_CHARS, LEAST_DOCS = 40, 5
SHARD_LINES = 4096
_SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def folded(line: Column) -> Column:
    """A line's key; plain ASCII takes the shorter way to the same result."""
    key = F.btrim(line, F.lit(_SPACE))
    return F.when(F.octet_length(key) == F.char_length(key), F.lower(key)).otherwise(F.translate(key, _UPPER, _LOWER))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def _keyed(docs: DataFrame, least_chars: int) -> DataFrame:
    """``hash, check, doc_id, text_hash, n_lines, line`` of every line whose key is long enough."""
    split = docs.select("doc_id", "text_hash", lines_of(F.col("text")).alias("lines"))
    each = split.select("doc_id", "text_hash", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("line", "said"))
    long = each.filter(F.char_length("said") >= least_chars).withColumn("key", folded(F.col("said")))
    return long.filter(F.char_length("key") >= least_chars).select(
        F.xxhash64("key").alias("hash"), F.crc32(F.col("key").cast("binary")).alias("check"), "doc_id", "text_hash",
        "n_lines", "line")


def _shared(lines: DataFrame, least_docs: int) -> DataFrame:
    """``hash, check, keeper`` of the keys that at least ``least_docs`` documents hold."""
    shards = max(1, lines.count() // SHARD_LINES)
    dealt = lines.select("hash", "check", "doc_id", "line", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard"))
    key = ["hash", "check", "shard"]
    order = Window.partitionBy(*key).orderBy(F.col("doc_id").desc_nulls_last(), "line")
    first = F.row_number().over(order) == 1
    turned = ~F.lag("doc_id").over(order).eqNullSafe(F.col("doc_id"))
    seen = dealt.repartitionByRange(*key).withColumns({"_first": first, "_turned": first | turned})
    return (seen.filter("_turned").groupBy("hash", "check")
            .agg(F.count(F.lit(1)).alias("docs"), F.max(F.when(F.col("_first"), F.col("doc_id"))).alias("keeper"))
            .filter((F.col("docs") >= least_docs) & F.col("keeper").isNotNull()).select("hash", "check", "keeper"))


def keep_bitmaps(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_hash, n_lines, keep`` of every document that loses lines.

    ``keep`` lists the runs of lines that stay as ``start, length``, from line 0.
    """
    lines = kept(_keyed(_texts(docs, id_col, text_col), least_chars), "lines")
    # Stored, so that both sides of the join are plain exchanges and Spark can split a hot key.
    shared = kept(_shared(lines, least_docs), "shared-lines")
    gone = (lines.join(shared, ["hash", "check"])
            .filter(F.col("doc_id").isNull() | (F.col("doc_id") < F.col("keeper"))))
    # A repeated row brings each of its lines again.
    found = (gone.groupBy("doc_id", "text_hash")
             .agg(F.first("n_lines").alias("n_lines"), F.array_sort(F.collect_set("line")).alias("gone")))
    ends = F.concat("gone", F.array("n_lines"))

    def run(end: Column, i: Column) -> Column:
        start = F.when(i == 0, 0).otherwise(F.get("gone", i - 1) + 1)
        return F.struct(start.alias("start"), (end - start).alias("length"))

    return found.select("doc_id", "text_hash", "n_lines", F.filter(F.transform(ends, run), lambda r: r.length > 0).alias("keep"))


def dedup_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_lines, n_dropped, text``: what stays of each document."""
    bitmaps = (keep_bitmaps(docs, least_chars, least_docs, id_col, text_col)
               .select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "keep"))
    whole = _texts(docs, id_col, text_col)
    met = whole.join(bitmaps, (F.col("text_hash") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    lines = lines_of(F.col("text"))
    stays = F.flatten(F.transform("keep", lambda r: F.slice(lines, r.start + 1, r.length)))
    n_kept = F.aggregate("keep", F.lit(0), lambda n, r: n + r.length)
    lost = F.col("keep").isNotNull()
    return met.select(
        "doc_id", F.size(lines).cast("bigint").alias("n_lines"),
        F.when(lost, F.size(lines) - n_kept).otherwise(0).cast("bigint").alias("n_dropped"),
        F.when(lost, F.array_join(stays, "\n")).otherwise(F.col("text")).alias("text"))
