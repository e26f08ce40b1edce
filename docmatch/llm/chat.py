r"""Chat formatting from an event log.

An event is (conv_id, turn, seq, kind, role, text). Events of a conversation are folded in order of
``seq``; equal ``seq`` fall back to turn, kind, role and text, and null sorts first:

* ``message`` adds a message at its turn,
* ``delta`` appends to the turn's latest message (and adds one where there is none),
* ``edit`` replaces the text of the turn's latest message,
* ``regenerate`` does so too and withdraws every message of a later turn.

Messages leave in order of turn. A null text is empty, a null role an empty one, a null kind means
``message``, and an unknown kind changes nothing. A conversation whose messages were all withdrawn, or
that never had one, is formatted as the empty text.

Each message becomes ``<turn ROLE>\nTEXT\n</turn>\n``. Roles are percent-encoded; in texts a backslash
precedes every backslash and every ``<turn`` or ``</turn``, so a marker at a line start is always a
real one and ``parse`` gives the messages back. Loss spans cover each assistant text, in code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmatch.llm.common import arrow_schema

KINDS = {"message": 0, "delta": 1, "edit": 2, "regenerate": 3}
TURNS_PER_CHUNK = 64
_ESCAPE, _UNESCAPE = re.compile(r"(\\|</?turn)"), re.compile(r"\\(\\|</?turn)")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\\\1", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def fold(events: list[dict]) -> list[tuple[str, str]]:
    """The final (role, text) messages of one conversation."""
    def order(e):
        return (e["seq"] is not None, e["seq"] or 0, e["turn"] is not None, e["turn"] or 0,
                KINDS.get(e["kind"] or "message", 9), e["role"] or "", e["text"] or "")

    turns: dict[tuple, list[list]] = {}
    for e in sorted(events, key=order):
        kind, turn = e["kind"] or "message", (e["turn"] is not None, e["turn"] or 0)
        own = turns.setdefault(turn, [])
        if kind == "message" or kind in KINDS and not own:
            own.append([e["role"] or "", [e["text"] or ""]])
        elif kind == "delta":
            own[-1][1].append(e["text"] or "")
        elif kind in ("edit", "regenerate"):
            own[-1][1] = [e["text"] or ""]
        if kind == "regenerate":
            turns = {t: m for t, m in turns.items() if t <= turn}
    return [(role, "".join(parts)) for turn in sorted(turns) for role, parts in turns[turn]]


def render(messages: list[tuple[str, str]], learned: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the spans of the ``learned`` role's texts."""
    out, spans, at = [], [], 0
    for role, text in messages:
        head, body = f"<turn {quote(role, safe='')}>\n", escape(text)
        if role == learned:
            spans.append((at + len(head), at + len(head) + len(body)))
        out.append(f"{head}{body}\n</turn>\n")
        at += len(out[-1])
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The messages of a formatted text."""
    messages = []
    for part in formatted.split("\n</turn>\n")[:-1]:
        head, _, body = part.partition("\n")
        messages.append((unquote(head.removeprefix("<turn ")[:-1]), unescape(body)))
    return messages


def format_chats(events: DataFrame) -> DataFrame:
    """``conv_id, formatted, loss_spans``: one row per conversation of an event log.

    Events are first gathered by conversation and block of turns, so a conversation that holds a
    large part of the log reaches its one result row in few, large pieces.
    """
    event = F.struct("turn", "seq", "kind", "role", "text")
    blocks = (events.groupBy("conv_id", F.floor(F.col("turn") / TURNS_PER_CHUNK).alias("_block"))
              .agg(F.collect_list(event).alias("events")))
    logs = blocks.groupBy("conv_id").agg(F.flatten(F.collect_list("events")).alias("events"))
    kind = events.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, formatted string, loss_spans array<struct<start: bigint, end: bigint>>"

    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                made = [render(fold(log)) for log in part["events"].to_pylist()]
                spans = [[{"start": a, "end": b} for a, b in s] for _, s in made]
                yield pa.RecordBatch.from_arrays(
                    [part["conv_id"], pa.array([t for t, _ in made], out[1].type), pa.array(spans, out[2].type)],
                    schema=out)

    return logs.mapInArrow(run, schema)


def read_back(chats: DataFrame) -> DataFrame:
    """Counts and digests of what the formatted texts and their loss spans say."""
    schema = ("conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, "
              "formatted_chars bigint")

    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        def sha(text: str) -> str:
            return hashlib.sha256(text.encode()).hexdigest()

        for batch in batches:
            rows = []
            for conv, text, spans in zip(*(batch[c].to_pylist() for c in ("conv_id", "formatted", "loss_spans"))):
                messages = parse(text)
                loss = "".join(unescape(text[s["start"]:s["end"]]) for s in spans)
                turns = "".join(f"{role}\n{said}\n" for role, said in messages)
                rows.append((conv, len(messages), sha(turns), len(loss), sha(loss), len(text)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(v), f.type) for v, f in zip(zip(*rows) if rows else [[]] * 6, out)], schema=out)

    return chats.mapInArrow(run, schema)


def events_of(conversations: DataFrame) -> DataFrame:
    """Each row of a table of finished turns as one ``message`` event."""
    return conversations.select("conv_id", F.col("turn"), F.col("turn").alias("seq"),
                                F.lit("message").alias("kind"), "role", "text")
