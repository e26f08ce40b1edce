"""Counts of hashed keys over the whole corpus, brought back to every place that holds the key.

Millions of keys per megabyte would be too many rows. So documents are dealt into batches of bounded size;
a batch sends each distinct key once, with its own count, packed and sorted by bucket of the hash; a bucket
adds up what the batches sent and returns totals only for keys that others hold too, with one bit per key
sent to tell which. A key in a third of all documents costs one entry per batch, so no task receives more
than its share. Batches and buckets are plain groups of a Spark shuffle: a lost one is made again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmatch.llm.common import arrow_schema

BATCH_BYTES = 4 << 20
BUCKET_KEYS = 1 << 20

SENT = "kind int, bucket int, batch int, slots binary, counts binary"
RETURNED = "batch int, kind int, bucket int, shared binary, totals binary"


@dataclass(frozen=True)
class Kind:
    """A kind of keys: how many bytes of the hash are sent, and about how many keys a byte of text has, which
    only sets the number of buckets. With 4 bytes some rare keys share a slot, and so their counts. A key may
    have several ``columns`` of counts."""

    width: int = 8
    keys_per_byte: float = 1 / 7
    columns: int = 1

    @property
    def slot(self):
        return np.uint32 if self.width == 4 else np.uint64

    def buckets(self, size: int) -> int:
        return max(1, round(size * self.keys_per_byte / BUCKET_KEYS))


@dataclass
class Keys:
    """Keys of a batch in the order of their occurrence: 64-bit hashes, other hashes that choose the bucket,
    and what each occurrence counts (None: one), a row for each column if there are several."""

    hashes: np.ndarray
    choose: np.ndarray
    counts: np.ndarray | None = None


@dataclass
class Packed:
    """Distinct keys by (bucket, slot); ``which`` leads from an occurrence to its distinct key, ``own`` has a
    row for each column of counts."""

    slots: np.ndarray
    edges: np.ndarray
    which: np.ndarray
    own: np.ndarray


def pack(keys: Keys, buckets: int, kind: Kind) -> Packed:
    """Group equal keys of a batch, by bucket."""
    bucket = ((keys.choose >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    bucket = bucket.astype(np.uint16 if buckets < 1 << 16 else np.uint32)
    slots = keys.hashes.astype(kind.slot)
    order = np.argsort(slots)
    order = order[np.argsort(bucket[order], kind="stable")]
    slots, bucket = slots[order], bucket[order]
    new = np.ones(len(order), bool)
    new[1:] = (slots[1:] != slots[:-1]) | (bucket[1:] != bucket[:-1])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    slots, bucket = slots[new], bucket[new]
    columns = [None] if keys.counts is None else np.atleast_2d(keys.counts)
    own = np.stack([np.bincount(which, c, len(slots)).astype(np.int64) for c in columns])
    return Packed(slots, np.searchsorted(bucket, np.arange(buckets + 1)), which, own)


def sent_rows(number: int, batch: int, found: Packed) -> pa.Table:
    """One row per bucket that the batch has keys for."""
    counts = narrow(found.own)
    filled = np.flatnonzero(np.diff(found.edges))
    cut = [(found.edges[b], found.edges[b + 1]) for b in filled]
    return pa.Table.from_arrays(
        [pa.array(np.full(len(filled), number), pa.int32()), pa.array(filled, pa.int32()),
         pa.array(np.full(len(filled), batch), pa.int32()),
         pa.array([found.slots[a:z].tobytes() for a, z in cut], pa.binary()),
         pa.array([counts[:, a:z].tobytes() for a, z in cut], pa.binary())],
        names=["kind", "bucket", "batch", "slots", "counts"])


def added_up(table: pa.Table, kind: Kind) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Of a bucket's rows: their numbers of keys; each key's own counts, group and the groups' totals."""
    slots = [np.frombuffer(s, kind.slot) for s in table["slots"].to_pylist()]
    lengths = [len(s) for s in slots]
    own = np.concatenate([widths(c, n, kind.columns).astype(np.int64)
                          for c, n in zip(table["counts"].to_pylist(), lengths)], axis=1)
    every = np.concatenate(slots)
    order = np.argsort(every)
    new = np.ones(len(order), bool)
    new[1:] = every[order[1:]] != every[order[:-1]]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return lengths, own, group, np.stack([np.bincount(group, o).astype(np.int64) for o in own])


WIDTHS = [(8, np.uint8), (16, np.uint16), (32, np.uint32), (64, np.uint64)]


def narrow(counts: np.ndarray) -> np.ndarray:
    top = int(counts.max(initial=0))
    return counts.astype(next(kind for bits, kind in WIDTHS if top < 1 << bits))


def widths(packed: bytes, n: int, columns: int = 1) -> np.ndarray:
    """Counts of ``n`` keys, a row for each column."""
    if not n:
        return np.empty((columns, 0), np.uint8)
    return np.frombuffer(packed, {bits // 8: kind for bits, kind in WIDTHS}[len(packed) // (n * columns)]).reshape(columns, n)


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def with_totals(docs: DataFrame, kinds: list[Kind], keys_of: Callable[[Any], list[Keys]],
                use: Callable[[Any, list[np.ndarray]], pa.Table], schema: str,
                read: Callable[[pa.Table], Any] = lambda table: table) -> DataFrame:
    """``use(batch of docs, corpus-wide totals of each key occurrence, by kind)`` over all documents; totals of
    a kind with several columns have a row for each. Both functions take what ``read`` makes of a batch, once.

    ``docs`` has a binary column ``text``; both functions see the same rows, in any order. A row's keys must
    not depend on other rows of its batch.
    """
    size = text_bytes(docs)
    batches, buckets = max(1, -(-size // BATCH_BYTES)), [k.buckets(size) for k in kinds]
    returned_out = arrow_schema(RETURNED)

    def send(key, table):
        batch = key[0].as_py()
        return pa.concat_tables(
            sent_rows(i, batch, pack(keys, buckets[i], kinds[i])) for i, keys in enumerate(keys_of(read(table))))

    def add_up(key, table):
        number = key[0].as_py()
        lengths, own, group, totals = added_up(table, kinds[number])
        totals = totals[:, group]
        more = (totals > own).any(axis=0)
        rows, at = ([], [], [], [], []), 0
        for batch, bucket, n in zip(table["batch"].to_pylist(), table["bucket"].to_pylist(), lengths):
            shared = more[at:at + n]
            if shared.any():
                for column, value in zip(rows, (batch, number, bucket, np.packbits(shared).tobytes(),
                                                narrow(totals[:, at:at + n][:, shared]).tobytes())):
                    column.append(value)
            at += n
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(rows, returned_out)], schema=returned_out)

    def finish(table, returned):
        batch = read(table)
        found = [pack(keys, buckets[i], kinds[i]) for i, keys in enumerate(keys_of(batch))]
        totals = [f.own.copy() for f in found]
        for number, bucket, shared, values in zip(*(returned[c].to_pylist() for c in ("kind", "bucket", "shared", "totals"))):
            at = np.flatnonzero(np.unpackbits(np.frombuffer(shared, np.uint8)))
            totals[number][:, found[number].edges[bucket] + at] = widths(values, len(at), kinds[number].columns)
        each = [t[:, f.which] for t, f in zip(totals, found)]
        return use(batch, [t if k.columns > 1 else t[0] for t, k in zip(each, kinds)])

    dealt = docs.withColumn("_batch", F.pmod(F.xxhash64(*docs.columns), F.lit(batches)).cast("int"))
    grouped = dealt.groupBy("_batch")
    returned = grouped.applyInArrow(send, SENT).groupBy("kind", "bucket").applyInArrow(add_up, RETURNED)
    return grouped.cogroup(returned.groupBy("batch")).applyInArrow(finish, schema)
