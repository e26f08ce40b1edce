"""Byte-level BPE: a sentencepiece model written directly from a vocabulary of ranks.

Every byte is mapped to one printable character, every vocabulary entry becomes a piece scored by its
negative rank, and normalisation is the identity, so the library's highest-score merge is the
lowest-rank merge. A text is cut by a pattern and each match is encoded on its own; a match that is
an entry itself is that entry. Decoding maps ids back to their bytes.

A null text is empty: no ids, no bytes. Ids are ranks. Texts of any length work; a pre-token of n
characters costs O(n log n). Repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docmatch.llm.common import per_document, texts

# Pre-tokens whose ids a task remembers; most matches of a pattern repeat.
REMEMBERED = 1 << 17


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file: a base64 entry and its rank per line. Its size bounds what is broadcast."""
    with open(path, "rb") as lines:
        return {base64.b64decode(entry): int(rank) for entry, rank in map(bytes.split, lines)}


def byte_characters() -> dict[int, str]:
    """Printable Latin-1 characters stand for themselves, the other bytes for characters from U+0100 on."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(others)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _message(field: int, payload: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(payload)) + payload


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """The serialised model. Piece ids equal ranks; the unknown piece, which no text reaches, is last."""
    # Field numbers and enum values of the public model format.
    pieces_field, trainer_field, normalizer_field = 1, 2, 3
    bpe, normal, unknown = 2, 1, 2
    as_character = byte_characters()
    entries = sorted(ranks, key=ranks.__getitem__)
    if [ranks[e] for e in entries] != list(range(len(entries))):
        raise ValueError("ranks must be 0, 1, 2 … without gaps")
    out = bytearray()
    for rank, entry in enumerate(entries):
        piece = "".join(as_character[b] for b in entry).encode()
        out += _message(pieces_field, _message(1, piece) + b"\x15" + struct.pack("<f", -rank) + _number(3, normal))
    out += _message(pieces_field, _message(1, b"<unk>") + b"\x15" + struct.pack("<f", 0) + _number(3, unknown))
    out += _message(trainer_field, _number(3, bpe) + _number(4, len(entries) + 1) + _number(40, len(entries)))
    out += _message(normalizer_field, _message(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0))
    return bytes(out)


class Codec:
    """Encodes texts to ids and decodes ids to bytes."""

    def __init__(self, entries: list[bytes], model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.entries = entries
        self.ranks = {e: i for i, e in enumerate(entries)}
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.pattern = regex.compile(pattern)
        self.characters = str.maketrans({chr(b): c for b, c in byte_characters().items()})
        self.known: dict[str, list[int]] = {}

    def _encode_match(self, match: str) -> list[int]:
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        raw = match.encode()
        whole = self.ranks.get(raw)
        ids = [whole] if whole is not None else self.pieces.encode(raw.decode("latin-1").translate(self.characters))
        if len(ids) <= 64:
            self.known[match] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        known, more = self.known, ids.extend
        for match in self.pattern.findall(text):
            found = known.get(match)
            more(self._encode_match(match) if found is None else found)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.entries.__getitem__, ids))


def codec_source(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> Callable[[], Codec]:
    """A function that builds the codec in a task; the model travels once per executor."""
    entries = sorted(ranks, key=ranks.__getitem__)
    sent = docs.sparkSession.sparkContext.broadcast((entries, model_bytes(ranks)))
    return lambda: Codec(*sent.value, pattern)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>, n_tokens``: each document's ids."""
    source = codec_source(docs, ranks, pattern)

    def start():
        codec = source()

        def row(doc_id, text):
            ids = codec.encode(text.decode())
            return doc_id, ids, len(ids)
        return row

    id_type = T.StructType([docs.schema[id_col]])[0].dataType.simpleString()
    return per_document(texts(docs, id_col, text_col), f"doc_id {id_type}, ids array<int>, n_tokens bigint", start)


def decode(encoded: DataFrame, ranks: dict[bytes, int], id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, bytes``: ids mapped back; null ids are none. An id outside the vocabulary is an error."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    from docmatch.llm.common import arrow_schema

    sent = encoded.sparkSession.sparkContext.broadcast(sorted(ranks, key=ranks.__getitem__))
    schema = f"doc_id {encoded.schema[id_col].dataType.simpleString()}, bytes binary"

    out = arrow_schema(schema)

    def run(batches):
        entries = sent.value
        for batch in batches:
            raw = [b"".join(map(entries.__getitem__, ids or [])) for ids in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(raw, pa.binary())], schema=out)

    return encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, schema)


def digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: one pass that encodes and decodes every text."""
    source = codec_source(docs, ranks, pattern)

    def start():
        import hashlib

        codec = source()
        decimal = [str(i) for i in range(len(codec.entries))]

        def row(doc_id, text):
            ids = codec.encode(text.decode())
            return (doc_id, len(ids), hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest(),
                    hashlib.sha256(codec.decode(ids)).hexdigest())
        return row

    return per_document(texts(docs), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", start)
