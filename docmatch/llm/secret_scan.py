"""Secret scans by grammar inference.

Three plain patterns find labelled credentials (assigned values, access keys, long hex runs). From all
their distinct values, each of them whole, one probabilistic automaton per kind is inferred: a prefix tree of the
values, in classes of characters, whose states merge while their outgoing frequencies are statistically
compatible (Hoeffding bound). The tree is counted over the corpus. Of more than ``TREE_STATES`` prefixes
the commonest become states, and all values are run through the automaton once more, which counts its moves. Then every other candidate is scored by its log likelihood per character under
each automaton and becomes a span too where some automaton finds it no less likely than the values it learned
from, and far likelier than by the shares of characters in the corpus. Candidates are all maximal runs of the credentials' alphabet, of any length from the shortest learned
value on; where a plain span lies in a run, what is left of the run on either side is a candidate by itself.
The plain spans always stay.

A null or empty text has no spans. Repeated texts have equal spans. Offsets count code points, end
exclusive. Of automata that like a run equally the later kind names it. Without labelled credentials nothing
is inferred and only the plain patterns report.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmatch.llm.common import arrow_schema, kept, per_document, same_columns, texts

# The kinds in their order, and what each must look like.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = re.compile(r"passw|secret|token|api_?key", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
# The alphabet of all kinds.
ALPHABET = "[A-Za-z0-9+/_.=-]"

# Prefixes per kind that reach the driver as states, and the prefix of no characters.
TREE_STATES, ROOT = 1 << 16, 0
# How much likelier as a credential than as ordinary text a run must be: about one in a million.
EVIDENCE_BITS = 20.0
# Values, prefixes or moves that a task counts before it sends what it has.
COUNTED = 1 << 16


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the plain patterns, by start, then kind."""
    found = []
    if ASSIGN_WORDS.search(text):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def labelled(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, str]]:
    """The credential values of plain spans."""
    return [(kind, ASSIGN.match(text, start, end)[2] if kind == 0 else text[start:end]) for start, kind, end in spans]


def run_pattern(least: int) -> re.Pattern:
    return re.compile(f"{ALPHABET}{{{least},}}", re.ASCII)


def candidates(text: str, spans: list[tuple[int, int, int]], runs: re.Pattern, least: int) -> list[tuple[int, int]]:
    """Maximal runs of at least ``least`` characters, without what plain spans take of them."""
    found = []
    for m in runs.finditer(text):
        at = m.start()
        for start, _, end in spans:
            if end > at and start < m.end():
                if start - at >= least:
                    found.append((at, start))
                at = max(at, end)
        if m.end() - at >= least:
            found.append((at, m.end()))
    return found


def character_class(c: str) -> str:
    return "0" if c in "0123456789" else "a" if c in "abcdef" else "g" if c.islower() else "A" if c.isupper() else c


CLASS_SIZE = {"0": 10, "a": 6, "g": 20, "A": 26}
CLASSES = {code: character_class(chr(code)) for code in range(128)}


@dataclass
class Automaton:
    """States with counts: how often each was left by a class of characters, and how often it ended there."""

    moves: list[dict[str, tuple[int, int]]]
    ends: list[int]
    least: float = -math.inf
    steps: dict[tuple[int, str], tuple[float, int]] = field(default_factory=dict, repr=False, compare=False)

    def score(self, value: str) -> float:
        """Log2 likelihood per character; unseen moves take a small share and go back to the start."""
        state, total = 0, 0.0
        for k in value.translate(CLASSES):
            step = self.steps.get((state, k))
            if step is None:
                step = self.steps[state, k] = self.step(state, k)
            total += step[0]
            state = step[1]
        return total / max(1, len(value))

    def step(self, state: int, k: str) -> tuple[float, int]:
        moves = self.moves[state]
        out = sum(n for n, _ in moves.values()) + self.ends[state]
        n, to = moves.get(k, (0, 0))
        return math.log2((n + 0.01) / (out + 0.06) / CLASS_SIZE.get(k, 1)), to


def infer(values: list[str], alpha: float = 0.01) -> Automaton:
    """The automaton of ``values``."""
    moves: list[dict[str, list[int]]] = [{}]
    ends = [0]
    for value in values:
        at = 0
        for k in value.translate(CLASSES):
            if k not in moves[at]:
                moves[at][k] = [0, len(moves)]
                moves.append({})
                ends.append(0)
            moves[at][k][0] += 1
            at = moves[at][k][1]
        ends[at] += 1
    made = merged(moves, ends, alpha)
    made.least = min(map(made.score, values), default=math.inf)
    return made


def merged(moves: list[dict[str, list[int]]], ends: list[int], alpha: float = 0.01) -> Automaton:
    """Merge compatible states of a prefix tree, breadth first, into an automaton."""
    width = math.sqrt(0.5 * math.log(2 / alpha))

    def total(s: int) -> int:
        return ends[s] + sum(n for n, _ in moves[s].values())

    def differ(x: int, nx: int, y: int, ny: int) -> bool:
        return bool(nx and ny) and abs(x / nx - y / ny) > width * (1 / math.sqrt(nx) + 1 / math.sqrt(ny))

    def compatible(a: int, b: int) -> bool:
        # ``b`` is the root of a tree, so every pair is met once.
        pairs = [(a, b)]
        while pairs:
            a, b = pairs.pop()
            na, nb = total(a), total(b)
            if differ(ends[a], na, ends[b], nb):
                return False
            for k in moves[a].keys() | moves[b].keys():
                (x, p), (y, q) = moves[a].get(k, (0, -1)), moves[b].get(k, (0, -1))
                if differ(x, na, y, nb):
                    return False
                if p >= 0 and q >= 0 and p != q and total(q) > 1:
                    pairs.append((p, q))
        return True

    def absorb(a: int, b: int) -> None:
        """Fold the tree below ``b`` into ``a``."""
        pairs = [(a, b)]
        while pairs:
            a, b = pairs.pop()
            ends[a] += ends[b]
            for k, (n, q) in moves[b].items():
                if k in moves[a]:
                    moves[a][k][0] += n
                    pairs.append((moves[a][k][1], q))
                else:
                    moves[a][k] = [n, q]

    kept, kept_set, at = [0], {0}, 0
    while at < len(kept):
        state = kept[at]
        for k in sorted(moves[state]):
            n, child = moves[state][k]
            if child in kept_set:
                continue
            into = next((r for r in kept if compatible(r, child)), None)
            if into is None:
                kept.append(child)
                kept_set.add(child)
            else:
                moves[state][k] = [n, into]
                absorb(into, child)
        # A state that absorbed children may have gained moves; look again until all lead to kept states.
        if all(q in kept_set for _, q in moves[state].values()):
            at += 1
            if at == len(kept):
                late = next((i for i, s in enumerate(kept) if any(q not in kept_set for _, q in moves[s].values())), at)
                at = late
    number = {s: i for i, s in enumerate(kept)}
    return Automaton([{k: (n, number[q]) for k, (n, q) in moves[s].items()} for s in kept], [ends[s] for s in kept])


def seen(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``kind, value, n``: the credential values of the plain patterns in every whole text, and, as kind -1, the
    characters of the alphabet: what ordinary text looks like. Counted in the tasks first."""
    schema = "kind int, value string, n bigint"
    out = arrow_schema(schema)

    def rows(counts: dict[tuple[int, str], int]) -> pa.RecordBatch:
        columns = zip(*((k, v, n) for (k, v), n in counts.items())) if counts else [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, out)], schema=out)

    def count(batches):
        values, characters = Counter(), np.zeros(256, np.int64)
        for batch in batches:
            for raw in batch["text"].to_pylist():
                characters += np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
                text = raw.decode()
                values.update(labelled(text, base_spans(text)))
                if len(values) >= COUNTED:
                    yield rows(values)
                    values.clear()
        yield rows(values)
        yield rows({(-1, chr(c)): int(n) for c, n in enumerate(characters) if n and c < 128 and re.match(ALPHABET, chr(c))})

    text = docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"))
    return text.mapInArrow(count, schema).groupBy("kind", "value").agg(F.sum("n").alias("n"))


@dataclass
class Formats:
    """What a scan needs: an automaton per kind, and the length that candidates have at least."""

    automata: list[Automaton | None]
    least: int
    ordinary: dict[str, int]

    def __post_init__(self):
        """``ordinary`` characters by class: log2 likelihood of one."""
        by_class = Counter()
        for c, n in self.ordinary.items():
            by_class[character_class(c)] += n
        total = sum(by_class.values())
        self.shares = {k: math.log2((n + 0.5) / (total + 6) / CLASS_SIZE.get(k, 1)) for k, n in by_class.items()}
        self.rarest = -math.log2(2 * total + 12)

    def plain(self, value: str) -> float:
        """Log2 likelihood as ordinary text."""
        return sum(self.shares.get(k, self.rarest) for k in value.translate(CLASSES))

    def spans(self, text: str) -> tuple[list[dict], list[dict]]:
        """Plain spans and all spans of a text, by start."""
        found = base_spans(text)
        base = [dict(start=s, end=e, kind=KINDS[k], score=None) for s, k, e in found]
        if not any(self.automata):
            return base, base
        runs = run_pattern(self.least)
        judged = [self.judge(text[a:b], a) for a, b in candidates(text, found, runs, self.least)]
        added = [s for s in judged if s]
        return base, sorted(base + added, key=lambda s: s["start"]) if added else base

    def judge(self, value: str, start: int) -> dict | None:
        """The span of a run that some automaton finds as likely as its own values, and much likelier than ordinary
        text, or none."""
        best = max(((a.score(value) - a.least, k) for k, a in enumerate(self.automata) if a), default=(-1.0, 0))
        if best[0] < 0:
            return None
        if (best[0] + self.automata[best[1]].least) * len(value) - self.plain(value) < EVIDENCE_BITS:
            return None
        return dict(start=start, end=start + len(value), kind=f"like_{KINDS[best[1]]}", score=best[0])


def prefixes(values: DataFrame) -> DataFrame:
    """``kind, node, parent, class, n, ends`` of every prefix of ``kind, value`` rows, in classes of characters: how many
    values pass it and how many end there. Nodes are hashes of prefixes, added up in the tasks first."""
    schema = "kind int, node bigint, parent bigint, class string, n bigint, ends bigint"
    out = arrow_schema(schema)

    def rows(held: dict[tuple[int, int], list]) -> pa.RecordBatch:
        columns = zip(*((*key, *row) for key, row in held.items())) if held else [()] * 6
        kind, node, parent, *more = map(list, columns)
        hashes = (np.array(x, np.uint64).view(np.int64) for x in (node, parent))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip([kind, *hashes, *more], out)], schema=out)

    def count(batches):
        import xxhash

        held = {}
        for batch in batches:
            for kind, value in zip(batch["kind"].to_pylist(), batch["value"]):
                path, at = xxhash.xxh3_64(), ROOT
                for c in value.as_py().translate(CLASSES):
                    path.update(c)
                    parent, at = at, path.intdigest()
                    row = held.setdefault((kind, at), [parent, c, 0, 0])
                    row[2] += 1
                    if len(held) >= COUNTED:
                        yield rows(held)
                        held = {}
                if at != ROOT:
                    held.setdefault((kind, at), [parent, c, 0, 0])[3] += 1
        yield rows(held)

    told = [F.min("parent").alias("parent"), F.min("class").alias("class"), F.sum("n").alias("n"), F.sum("ends").alias("ends")]
    return values.mapInArrow(count, schema).groupBy("kind", "node").agg(*told)


def structures(values: DataFrame) -> tuple[dict[int, Automaton], bool]:
    """An automaton per kind, and whether its counts are those of all values.

    A kind's prefixes reach the driver if they are at most ``TREE_STATES``, else those that some power of two of values
    pass; of the others the first on a path is known by its number only, and leads back to the start.
    """
    tree = kept(prefixes(values), "secret-prefixes")
    powers: dict[int, Counter] = {}
    for kind, power, nodes in tree.groupBy("kind", F.length(F.bin("n")) - 1).count().toLocalIterator():  # at most 64 a kind
        powers.setdefault(kind, Counter())[power] = nodes
    least, whole = F.lit(1), True
    for kind, nodes in powers.items():
        taken = next(p for p in range(65) if sum(n for q, n in nodes.items() if q >= p) <= TREE_STATES)
        if taken:
            least, whole = F.when(F.col("kind") == kind, F.lit(1 << taken)).otherwise(least), False
    rows = tree.filter(F.col("n") >= least)
    if not whole:
        passed = rows.select("kind", F.col("node").alias("parent")).unionByName(
            tree.select("kind", F.lit(ROOT).cast("bigint").alias("parent")).distinct())
        rare = tree.filter(F.col("n") < least).join(passed, ["kind", "parent"], "left_semi")
        rows = rows.unionByName(rare.withColumn("ends", F.lit(0).cast("bigint")))
    made: dict[int, tuple[dict[int, int], list]] = {}
    for row in rows.toLocalIterator():  # at most TREE_STATES a kind, and one more for each of a state's classes
        number, edges = made.setdefault(row["kind"], ({ROOT: 0}, []))
        number[row["node"]] = len(number)
        edges.append((row["parent"], row["class"], row["n"], row["node"], row["ends"]))
    automata = {}
    for kind, (number, edges) in made.items():
        moves, ends = [{} for _ in number], [0] * len(number)
        for parent, k, n, node, over in edges:
            moves[number[parent]][k] = [n, number[node]]
            ends[number[node]] = over
        automata[kind] = merged(moves, ends)
    return automata, whole


def counted(values: DataFrame, automata: dict[int, Automaton]) -> dict[int, Automaton]:
    """The automata with the numbers of moves and ends that all ``kind, value`` rows make, run through them."""
    moves = {kind: [{k: to for k, (_, to) in m.items()} for m in a.moves] for kind, a in automata.items()}
    schema = "kind int, state int, class string, n bigint"
    out = arrow_schema(schema)

    def rows(counts: Counter) -> pa.RecordBatch:
        columns = zip(*((*key, n) for key, n in counts.items())) if counts else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, out)], schema=out)

    def run(batches):
        counts = Counter()
        for batch in batches:
            for kind, value in zip(batch["kind"].to_pylist(), batch["value"]):
                state, own = 0, moves[kind]
                for k in value.as_py().translate(CLASSES):
                    counts[kind, state, k] += 1
                    state = own[state].get(k, 0)
                counts[kind, state, ""] += 1
                if len(counts) >= COUNTED:
                    yield rows(counts)
                    counts.clear()
        yield rows(counts)

    made = {kind: Automaton([{} for _ in a.moves], [0] * len(a.moves)) for kind, a in automata.items()}
    told = values.mapInArrow(run, schema).groupBy("kind", "state", "class").agg(F.sum("n").alias("n"))
    for kind, state, k, n in told.toLocalIterator():  # a state has a move per class at most
        if k:
            made[kind].moves[state][k] = (n, moves[kind][state].get(k, 0))
        else:
            made[kind].ends[state] = n
    return made


def learn(found: DataFrame) -> Formats:
    """One automaton per kind from all distinct values, whatever their number and length."""
    values = found.filter(F.col("kind") >= 0).select("kind", "value")
    automata, whole = structures(values)
    if not whole:
        automata = counted(values, automata)
    schema = "kind int, score double, size bigint"
    out = arrow_schema(schema)

    def scored(batches):
        for batch in batches:
            own = batch["value"].to_pylist()
            scores = [automata[k].score(v) for k, v in zip(batch["kind"].to_pylist(), own)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(
                (batch["kind"].to_pylist(), scores, list(map(len, own))), out)], schema=out)

    least = values.mapInArrow(scored, schema).groupBy("kind").agg(F.min("score").alias("score"), F.min("size").alias("size"))
    sizes = []
    for kind, score, size in least.toLocalIterator():  # a row per kind
        automata[kind].least = score
        sizes.append(size)
    ordinary = {r["value"]: r["n"] for r in found.filter("kind = -1").toLocalIterator()}  # the alphabet's characters
    return Formats([automata.get(k) for k in range(len(KINDS))], min(sizes, default=1), ordinary)


def formats_of(docs: DataFrame, text_col: str = "text") -> Formats:
    return learn(kept(seen(docs, text_col), "secret-values"))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, base, spans``: plain spans and all spans, as arrays of (start, end, kind, score).

    Spans that the automata add carry the kind whose automaton likes them best, as ``like_KIND``.
    """
    formats = formats_of(docs, text_col)
    span = "array<struct<start: int, end: int, kind: string, score: double>>"

    def start():
        def row(doc_id, raw):
            return doc_id, *formats.spans(raw.decode())
        return row

    return per_document(texts(docs, id_col, text_col),
                        f"doc_id {docs.schema[id_col].dataType.simpleString()}, base {span}, spans {span}", start)


def digests(found: DataFrame) -> DataFrame:
    """Counts by kind, a digest of the plain spans, and all spans as text."""
    def said(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s.kind == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, KINDS), F.sha2(said("base"), 256).alias("base_sha256"),
                        said("spans").alias("spans"))


def redact(text: str, spans: list[dict], mark: str = "[SECRET]") -> str:
    """The text with every span, overlapping ones as one, replaced by ``mark``."""
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:
            out += [text[at:s["start"]], mark]
        at = max(at, s["end"])
    return "".join(out) + text[at:]


def redact_secrets(docs: DataFrame) -> DataFrame:
    """The documents with every secret replaced, and ``n_chars`` (where there is one) counted anew."""
    formats = formats_of(docs)

    def start():
        def clean(text: str | None) -> str | None:
            if not text:
                return text
            found = formats.spans(text)[1]
            return redact(text, found) if found else text

        def change(batch):
            old = batch["text"].to_pylist()
            new = [clean(t) for t in old]
            names = batch.schema.names
            batch = batch.set_column(names.index("text"), "text", pa.array(new, pa.string()))
            if "n_chars" in names:
                counts = [c if a == b else len(b) for c, a, b in zip(batch["n_chars"].to_pylist(), old, new)]
                at = names.index("n_chars")
                batch = batch.set_column(at, "n_chars", pa.array(counts, batch.schema.field(at).type))
            return batch
        return change

    return same_columns(docs, start)
