"""Blacklist screening: which entries occur in which texts, as plain case-sensitive substrings.

``automaton``  the list fits a bound: one pass per text with an Aho-Corasick automaton per task
``grams``      any list: texts meet entries by equal hashed grams, then the match is verified
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmatch.sources.staging import stage

MAX_AUTOMATON_ENTRIES = 50_000
MAX_AUTOMATON_CHARS = 5_000_000
GRAM = 16
WINDOW = 16
KEYED_BYTES = GRAM + WINDOW - 1
MAX_SHARED_KEYS = 4_000_000
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _bounded_entries(blacklist: DataFrame) -> list[str] | None:
    """The distinct entries if their number and length are within the bounds, else None."""
    entries = blacklist.select("entry").where(F.col("entry").isNotNull()).distinct()
    size = entries.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("entry")).alias("chars")).head()
    if size["n"] > MAX_AUTOMATON_ENTRIES or (size["chars"] or 0) > MAX_AUTOMATON_CHARS:
        return None
    return [r["entry"] for r in entries.collect()]


def _by_automaton(texts: DataFrame, entries: list[str], text: str) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast(entries)

    @F.arrow_udf("array<string>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        always = [e for e in shared.value if e == ""]
        automaton = ahocorasick.Automaton()
        for e in shared.value:
            if e:
                automaton.add_word(e, e)
        automaton.make_automaton()
        searchable = len(automaton) > 0
        for batch in batches:
            rows = []
            for value in batch.to_pylist():
                hits = {e for _, e in automaton.iter(value)} if value and searchable else set()
                rows.append(None if value is None else [*always, *sorted(hits)])
            yield pa.array(rows, pa.list_(pa.string()))

    marked = texts.withColumn("entry", found.asNondeterministic()(text))
    return marked.withColumn("entry", F.explode("entry"))


def _window_minima(text: bytes) -> np.ndarray:
    """Distinct minima of gram hashes over every window of ``WINDOW`` grams (winnowing).

    Wherever a string of ``KEYED_BYTES`` or more occurs, its windows occur with it, so each of its
    minima is among those of the surrounding text.
    """
    raw = np.frombuffer(text, dtype=np.uint8)
    if len(raw) < KEYED_BYTES:
        return np.empty(0, dtype=np.int64)
    h = np.zeros(len(raw) - GRAM + 1, dtype=np.uint64)
    for i in range(GRAM):
        h = h * _FACTOR + raw[i:i + len(h)]
    h ^= h >> np.uint64(31)
    h *= _MIX
    h ^= h >> np.uint64(29)
    span = 1
    while span < WINDOW:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    return np.unique(h).view(np.int64)


def _short_size(length: int) -> int:
    """Bytes of the grams that stand for a short entry: the largest power of two within it."""
    return min(GRAM, 1 << (length.bit_length() - 1))


def _short_grams(text: bytes, sizes: list[int]) -> np.ndarray:
    """Distinct hashes of the grams of the given sizes."""
    raw, found = np.frombuffer(text, dtype=np.uint8), [np.empty(0, np.uint64)]
    for size in sizes:
        if len(raw) >= size:
            h = np.full(len(raw) - size + 1, size, dtype=np.uint64)
            for i in range(size):
                h = h * _FACTOR + raw[i:i + len(h)] + np.uint64(1)
            h ^= h >> np.uint64(31)
            found.append(h * _MIX)
    return np.unique(np.concatenate(found)).view(np.int64)


def _those_in(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The keys that the sorted ``wanted`` holds; its own size matters by its logarithm only."""
    if not len(wanted):
        return keys[:0]
    at = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
    return keys[wanted[at] == keys]


def _keys_column(text: str, of_text, wanted: np.ndarray | None = None, spark=None) -> Column:
    """``array<bigint>`` of a text's keys, only those in the sorted ``wanted`` if given."""
    shared = spark.sparkContext.broadcast(wanted) if wanted is not None else None

    @F.arrow_udf("array<bigint>")
    def keys(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [of_text(t.encode("utf-8")) if t else np.empty(0, np.int64) for t in batch.to_pylist()]
            if shared is not None:
                rows = [_those_in(r, shared.value) for r in rows]
            yield pa.array(rows, pa.list_(pa.int64()))

    return keys.asNondeterministic()(text)


def _meet(texts: DataFrame, entries: DataFrame, text: str, key: str, of_entry, of_text, name: str) -> DataFrame:
    """Texts that contain an entry: both meet by equal keys, then the match is verified.

    Each entry is found by the rarest of its keys, so entries with a common part do not share one. The
    texts give only keys that some entry needs as long as those fit a bound; beyond it they give all.
    """
    spark = texts.sparkSession
    every = entries.select("entry", F.explode(_keys_column("entry", of_entry)).alias("_gram"))
    shared_by = every.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    keyed = every.join(shared_by, "_gram").groupBy("entry").agg(F.min_by("_gram", F.struct("_n", "_gram")).alias("_gram"))
    keyed = stage(keyed, name)

    grams = keyed.select("_gram").distinct()
    wanted = None
    if grams.count() <= MAX_SHARED_KEYS:
        wanted = np.sort(grams.toPandas()["_gram"].to_numpy(dtype=np.int64))
    at = texts.select(key, F.explode(_keys_column(text, of_text, wanted, spark)).alias("_gram"))
    pairs = at.join(keyed, "_gram").select(key, "entry")
    return texts.join(pairs, key).where(F.col(text).contains(F.col("entry")))


def _by_grams(texts: DataFrame, blacklist: DataFrame, text: str, key: str) -> DataFrame:
    entries = blacklist.select("entry").where(F.col("entry").isNotNull()).distinct()
    size = F.octet_length("entry")
    found = _meet(texts, entries.where(size >= KEYED_BYTES), text, key, _window_minima, _window_minima, "blacklist-keys")

    # Short entries have no full window; their grams have one of a few sizes.
    short = entries.where((size > 0) & (size < KEYED_BYTES))
    # Texts give grams of the sizes that entries have; at most one per length below a window's.
    sizes = sorted({_short_size(r["n"]) for r in short.select(size.alias("n")).distinct().collect()})
    if sizes:
        found = found.unionByName(_meet(
            texts, short, text, key, lambda e: _short_grams(e, [_short_size(len(e))]),
            lambda t: _short_grams(t, sizes), "blacklist-short-keys"))
    if not entries.where(size == 0).isEmpty():
        found = found.unionByName(texts.where(F.col(text).isNotNull()).withColumn("entry", F.lit("")))
    return found


def hits(
    texts: DataFrame, blacklist: DataFrame, *, key: str = "uid", text: str = "text", strategy: str = "auto",
) -> DataFrame:
    """``texts`` columns plus ``idx`` and ``entry``, one row per text and list position found.

    ``blacklist`` is ``(idx, entry)``. An entry counts once per text however often it occurs; an entry
    listed twice is reported twice.
    """
    if strategy not in ("auto", "automaton", "grams"):
        raise ValueError(f"unknown strategy {strategy!r}")
    entries = None if strategy == "grams" else _bounded_entries(blacklist)
    if strategy == "automaton" and entries is None:
        raise ValueError("blacklist is larger than the automaton bound")
    found = _by_grams(texts, blacklist, text, key) if entries is None else _by_automaton(texts, entries, text)
    return found.join(blacklist.select("idx", "entry"), "entry")


def hits_by_text(found: DataFrame, key: str = "uid") -> DataFrame:
    """The entries found per text, in list order."""
    listed = F.sort_array(F.collect_list(F.struct("idx", "entry")))
    return found.groupBy(key).agg(listed.alias("_l")).select(key, F.col("_l.entry").alias("entries"))
