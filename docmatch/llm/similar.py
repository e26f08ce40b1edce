"""Similar documents: a Jaccard join of word shingles by T-occurrence search.

Two documents link when ``den * |A and B| >= num * |A or B|`` for their sets of shingles. Whoever links with
a set of n shingles shares at least T = ceil(num * n / den) of them. Of the n inverted lists of a document at
most T - 1 may therefore be left aside, the longest ones, and a partner stands in one of the others, the
shortest. So

1. the lengths of all inverted lists are counted over the corpus (``corpus.with_totals``),
2. each document enters its n - T + 1 shortest lists; a list of length one links nothing and is left out,
3. the documents of a list gather under the list's smallest document, in shards of bounded size,
4. in a shard DivideSkip searches one document after the other: its shorter lists are merged by counting, its
   longest ones probed, some at a time, for the candidates that can still reach T. Documents found are
   searched next and leave the lists, so a group of thousands of copies costs about one look at each,
5. where one list's documents needed several shards, those that did not join its main class are searched
   against the other shards,
6. links become classes (``components``).

That finds classes by as few links as will do (``similar_classes``). The join itself (``similar_documents``)
looks at every link: in step 4 each document is searched among all later ones and none leaves the lists for
having been found, and in step 5 the parts of a large group meet pair by pair, in cells of bounded work. There
are as many links as there are, a group's square where all of its sets differ a little, so links stay in their
cell: what leaves it is one row per document that has any, with the first document that it reaches there and
how many it links with. Documents that share several pivots meet in several groups and are counted in that of
the smallest. ``similar_pairs`` returns the links themselves, as many rows as there are.

Equal sets are one document until the last step. A null or empty text has no shingles and links with
nothing, as does a row with a null id. Rows that share an id are one node.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmatch.llm.common import WordHashes, arrow_schema, kept, ngram_hashes, texts
from docmatch.llm.components import components
from docmatch.llm.corpus import Keys, Kind, with_totals

# Shingles that a search task holds at a time, about.
SHARD_SHINGLES = 1 << 19
# Documents of a group that are searched pair by pair in one cell, at most as many asking others.
CELL_DOCUMENTS = 1000
# DivideSkip's constant: how many of the longest lists are probed instead of merged.
MU = 0.01
# Long lists that are probed before candidates are looked at again, and what a place in a list costs less to
# read than to find by binary search, about.
PROBED = 64
SCAN = 8


def shingles(words: WordHashes, text: bytes, n: int) -> np.ndarray:
    """Distinct hashes of a text's shingles, sorted."""
    return np.unique(ngram_hashes(words.of(text.lower().split()), n))


class Lists:
    """Inverted lists of some documents' sets; documents are numbered, lists are sorted by document."""

    def __init__(self, sets: list[np.ndarray], indexed: list[int]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        size = int(self.sizes[indexed].sum())
        grams, docs = np.empty(size, np.uint64), np.empty(size, np.int64)
        at = 0
        for d in sorted(indexed):
            grams[at:at + len(sets[d])], docs[at:at + len(sets[d])] = sets[d], d
            at += len(sets[d])
        order = np.argsort(grams, kind="stable")
        self.docs = docs[order]
        self.grams, starts, which = np.unique(grams[order], return_index=True, return_inverse=True)
        self.bounds = np.append(starts, size)
        # Every place of a list as one number, in order.
        self.places = which * len(sets) + self.docs
        self.live = np.zeros(len(sets), bool)
        self.live[indexed] = True

    def occurrences(self, lists: np.ndarray) -> np.ndarray:
        """How many of the lists hold each document."""
        starts, lengths = self.bounds[lists], self.bounds[lists + 1] - self.bounds[lists]
        ends = np.cumsum(lengths)
        at = np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)
        return np.bincount(self.docs[at], minlength=len(self.live))

    def probes(self, lists: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """How many of the lists hold each of the wanted documents."""
        if (self.bounds[lists + 1] - self.bounds[lists]).sum() <= SCAN * len(lists) * len(wanted):
            return self.occurrences(lists)[wanted]
        asked = lists[:, None] * len(self.live) + wanted
        found = np.minimum(np.searchsorted(self.places, asked), len(self.places) - 1)
        return (self.places[found] == asked).sum(axis=0)

    def partners(self, query: np.ndarray, num: int, den: int, apart: Iterable[int] = ()) -> list[int]:
        """Live documents that link with ``query``, but for those in ``apart``."""
        q = len(query)
        least = -(-num * q // den)
        live = self.live & (self.sizes >= least) & (den * q >= num * self.sizes)
        live[list(apart)] = False
        if not live.any():
            return []
        at = np.searchsorted(self.grams, query)
        query, at = query[at < len(self.grams)], at[at < len(self.grams)]
        at = at[self.grams[at] == query]
        if len(at) < least:
            return []
        lengths = self.bounds[at + 1] - self.bounds[at]
        by_length = at[np.argsort(lengths, kind="stable")]
        # The longest lists are probed; what is merged must then hold a candidate `merged_least` times.
        probed = min(least - 1, int(least / (MU * math.log2(int(lengths.max()) + 1) + 1)))
        short, long = by_length[:len(by_length) - probed], by_length[len(by_length) - probed:]
        counts = self.occurrences(short)
        open_docs = np.flatnonzero(live & (counts >= least - probed))
        counts = counts[open_docs]
        need = -(-num * (q + self.sizes[open_docs]) // (den + num))
        found = []
        for begin in range(0, len(long) + 1, PROBED):
            reached = counts >= need
            found.append(open_docs[reached])
            still = ~reached & (counts + len(long) - begin >= need)
            open_docs, counts, need = open_docs[still], counts[still], need[still]
            if not len(open_docs):
                break
            counts = counts + self.probes(long[begin:begin + PROBED], open_docs)
        found.append(open_docs[counts >= need])
        return np.sort(np.concatenate(found)).tolist()


def classes(sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """(first document, document) for every document that links, over others or not, with an earlier first."""
    lists, pairs = Lists(sets, list(range(len(sets)))), []
    for first in range(len(sets)):
        if not lists.live[first]:
            continue
        lists.live[first] = False
        waiting = [first]
        while waiting and lists.live.any():
            for d in lists.partners(sets[waiting.pop()], num, den):
                lists.live[d] = False
                waiting.append(d)
                pairs.append((first, d))
    return pairs


def pairs(sets: list[np.ndarray], asks: list[bool | None], num: int, den: int) -> Iterator[tuple[int, int]]:
    """Every two documents that link; where some ask, each of them with each of the others."""
    among = asks[0] is None
    lists = Lists(sets, [i for i, a in enumerate(asks) if not a])
    for i in range(len(sets)) if among else [i for i, a in enumerate(asks) if a]:
        lists.live[i] = False
        for d in lists.partners(sets[i], num, den):
            yield i, d


def documents(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Per document its number of shingles, a digest of its set, its short lists, and its text if it has any.

    Copies within a batch enter their lists once, as the one with the smallest id.
    """
    schema = "doc_id bigint, n bigint, same binary, lists array<bigint>, text binary"
    out = arrow_schema(schema)

    def read(table: pa.Table) -> tuple[pa.Table, list[np.ndarray]]:
        words = WordHashes()
        return table, [shingles(words, t, n) for t in table["text"].to_pylist()]

    def keys_of(batch: tuple[pa.Table, list[np.ndarray]]) -> list[Keys]:
        every = np.concatenate(batch[1] or [np.empty(0, np.uint64)])
        return [Keys(every, every)]

    def use(batch: tuple[pa.Table, list[np.ndarray]], totals: list[np.ndarray]) -> pa.Table:
        list_lengths, = totals
        columns, at, first = ([], [], [], []), 0, {}
        table, sets = batch
        ids, raw = table["doc_id"].to_pylist(), table["text"].to_pylist()
        digests = [hashlib.blake2b(own.tobytes(), digest_size=16).digest() if i is not None and len(own) else None
                   for i, own in zip(ids, sets)]
        for i in sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i])):
            if digests[i] is not None:
                first.setdefault(digests[i], i)
        for i, own in enumerate(sets):
            lengths = list_lengths[at:at + len(own)]
            at += len(own)
            same = digests[i]
            entered = np.empty(0, np.uint64)
            if same is not None and first[same] == i:
                short = np.lexsort((own, lengths))[:len(own) - -(-num * len(own) // den) + 1]
                entered = own[short[lengths[short] > 1]]
            for column, value in zip(columns, (len(own), same, entered.view(np.int64).tolist(),
                                               raw[i] if len(entered) else None)):
                column.append(value)
        return pa.Table.from_arrays([table["doc_id"], *(pa.array(c, f.type) for c, f in zip(columns, list(out)[1:]))],
                                    schema=out)

    return with_totals(texts(docs), [Kind(4)], keys_of, use, schema, read)


def groups_of(table: pa.Table) -> Iterator[pa.Table]:
    """A shard's rows by pivot and part, in order of their ids."""
    table = table.sort_by([("pivot", "ascending"), ("part", "ascending"), ("doc_id", "ascending")])
    at = 0
    for _, rows in groupby(list(zip(table["pivot"].to_pylist(), table["part"].to_pylist()))):
        size = sum(1 for _ in rows)
        yield table.slice(at, size)
        at += size


def search(gathered: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Links ``a, b`` in each shard of ``shard, pivot, part, doc_id, asks, class, text``.

    Documents with the same pivot and part meet. Where ``asks`` is null all are searched for classes;
    else those that ask are searched among those that don't and that are of another class so far.
    """
    schema = "a bigint, b bigint"
    out = arrow_schema(schema)

    def run(table: pa.Table) -> pa.Table:
        words, links = WordHashes(), []
        for own in groups_of(table):
            ids, asks, kinds = (own[c].to_pylist() for c in ("doc_id", "asks", "class"))
            sets = [shingles(words, t.as_py(), n) for t in own["text"]]
            if asks[0] is None:
                links += [(ids[a], ids[b]) for a, b in classes(sets, num, den)]
                continue
            lists = Lists(sets, [i for i, a in enumerate(asks) if not a])
            of_class: dict[int, list[int]] = {}
            for i in np.flatnonzero(lists.live).tolist():
                of_class.setdefault(kinds[i], []).append(i)
            for i in (i for i, a in enumerate(asks) if a):
                # One link to a class is enough.
                linked = {kinds[i]}
                for d in lists.partners(sets[i], num, den, of_class.get(kinds[i], [])):
                    if kinds[d] not in linked:
                        linked.add(kinds[d])
                        links.append((ids[i], ids[d]))
        a, b = zip(*links) if links else ((), ())
        return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=out)

    return gathered.groupBy("shard").applyInArrow(lambda table: run(table), schema)


@dataclass
class Groups:
    """All documents, texts of one document for each distinct set, those that share a list with others by
    pivot with the pivot's number of parts, the shard of a pivot's part, and which document stands for a set."""

    found: DataFrame
    node_texts: DataFrame
    dealt: DataFrame
    shard: Column
    smallest: DataFrame
    ties: DataFrame


def groups(docs: DataFrame, n: int, num: int, den: int, by_set: bool = False) -> Groups:
    """With ``by_set`` nodes are sets, numbered by hash, and an id with several sets keeps them apart."""
    found = kept(documents(docs, n, num, den), "similar-documents")
    entered = found.filter(F.size("lists") > 0)
    # One of the equal sets stands for all of them; each entered the same lists.
    stands = entered.groupBy("same").agg(F.min("doc_id").alias("doc_id"))
    nodes = entered.join(stands, ["same", "doc_id"], "left_semi")
    if by_set:
        nodes = nodes.withColumn("doc_id", F.xxhash64("same")).dropDuplicates(["doc_id"])
    entries = nodes.select("doc_id", "n", F.explode("lists").alias("list"))
    pivots = (entries.groupBy("list").agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("last"))
              .filter("pivot < last").drop("last"))
    members = kept(entries.join(pivots, "list").select("pivot", "doc_id", "n").distinct(), "similar-members")
    total = members.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total // SHARD_SHINGLES))
    parts = (members.groupBy("pivot").agg(F.ceil(F.sum("n") / SHARD_SHINGLES).cast("int").alias("parts")))
    shard = F.when(F.col("parts") > 1, F.xxhash64("pivot", "part")).otherwise(F.pmod(F.xxhash64("pivot"), F.lit(shards)))
    same = found.filter("same is not null").select("doc_id", "same")
    smallest = same.groupBy("same").agg(F.min("doc_id").alias("id"))
    smallest = smallest.withColumn("node", F.xxhash64("same") if by_set else F.col("id"))
    # An id with several sets ties their classes together.
    several = (same.groupBy("doc_id").agg(F.min("same").alias("least"), F.max("same").alias("most"))
               .filter("least < most").select("doc_id"))
    ties = same.join(several, "doc_id").join(smallest, "same").select("doc_id", F.col("node").alias("b"))
    if by_set:
        ties = ties.join(ties.groupBy("doc_id").agg(F.min("b").alias("a")), "doc_id")
    else:
        ties = ties.withColumn("a", F.col("doc_id"))
    ties = ties.select("a", "b")
    return Groups(found, nodes.select("doc_id", "text"), members.join(parts, "pivot"), shard, smallest, ties)


def linked(gathered: DataFrame, n: int, num: int, den: int, as_pairs: bool) -> DataFrame:
    """Every link in each shard of ``shard, pivot, part, doc_id, asks, times, before, text``, met by ``search``'s rule.

    A pair with a pivot in common in ``before``, a document's smaller pivots, is left to that pivot's group. Either the
    pairs ``a, b``, or per document that links ``node, root, further``: the first document it reaches by links of
    its cell, and the ``times`` of those it links with.
    """
    schema = "a bigint, b bigint" if as_pairs else "node bigint, root bigint, further bigint"
    out = arrow_schema(schema)

    def run(table: pa.Table) -> pa.Table:
        words, rows = WordHashes(), []
        for own in groups_of(table):
            ids, asks, times = (own[c].to_pylist() for c in ("doc_id", "asks", "times"))
            before = [frozenset(b) for b in own["before"].to_pylist()]
            met = ((i, d) for i, d in pairs([shingles(words, t.as_py(), n) for t in own["text"]], asks, num, den)
                   if not before[i] or before[i].isdisjoint(before[d]))
            if as_pairs:
                rows += [(ids[i], ids[d]) for i, d in met]
                continue
            first, further = list(range(len(ids))), [0] * len(ids)
            for i, d in met:
                further[i] += times[d]
                further[d] += times[i]
                while first[i] != i:
                    first[i] = i = first[first[i]]
                while first[d] != d:
                    first[d] = d = first[first[d]]
                first[max(i, d)] = min(i, d)
            for i, count in enumerate(further):
                if count:
                    root = i
                    while first[root] != root:
                        root = first[root]
                    rows.append((ids[i], ids[root], count))
        columns = zip(*rows) if rows else ([] for _ in out)
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=out)

    return gathered.groupBy("shard").applyInArrow(lambda table: run(table), schema)


def every_link(made: Groups, n: int, num: int, den: int, as_pairs: bool = False) -> DataFrame:
    """``linked`` over all groups, each in cells of bounded size."""
    documents = made.dealt.groupBy("pivot").agg(F.count(F.lit(1)).alias("documents"))
    cut = made.dealt.join(documents, "pivot").withColumn(
        "parts", F.greatest("parts", F.ceil(F.col("documents") / CELL_DOCUMENTS).cast("int")))
    own = F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")
    # Part p of a group meets part q in the cell of (p, q); p asks.
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    cells = (cut.withColumn("own", own).withColumn("other", other)
             .withColumn("part", F.least("own", "other").cast("bigint") * F.col("parts") + F.greatest("own", "other"))
             .withColumn("asks", F.when(F.col("own") != F.col("other"), F.col("own") < F.col("other"))))
    pivots = made.dealt.groupBy("doc_id").agg(F.collect_set("pivot").alias("pivots"))
    nodes = made.node_texts.join(pivots, "doc_id").join(_times(made).select(F.col("node").alias("doc_id"), "times"), "doc_id")
    met = cells.join(nodes, "doc_id").select(
        made.shard.alias("shard"), "pivot", "part", "doc_id", "asks", "times",
        F.filter("pivots", lambda p: p < F.col("pivot")).alias("before"), "text")
    return kept(linked(met, n, num, den, as_pairs), "similar-links")


def _times(made: Groups) -> DataFrame:
    """``same, id, node, times`` of every set: how many ids have it."""
    return (made.found.filter("same is not null").groupBy("same").agg(F.count_distinct("doc_id").alias("times"))
            .join(made.smallest, "same"))


def similar_pairs(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``a, b``: every link between different sets, once, each set named by its smallest id."""
    made = groups(docs, n, num, den, by_set=True)
    a, b = (made.smallest.select(F.col("node").alias(c), F.col("id").alias(f"{c}_id")) for c in "ab")
    return (every_link(made, n, num, den, as_pairs=True).join(a, "a").join(b, "b")
            .select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b")))


def similar_documents(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``doc_id, n_shingles, component_id, n_links``: the class of each document and how many others it links with.

    Others are counted by id and distinct set, copies of the own set included.
    """
    made = groups(docs, n, num, den, by_set=True)
    links = every_link(made, n, num, den)
    labels = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(made.ties))
    further = links.groupBy("node").agg(F.sum("further").alias("further"))
    n_links = F.col("times") - 1 + F.coalesce("further", F.lit(0))
    named = (_times(made).join(labels, "node", "left").join(further, "node", "left")
             .select("same", "id", F.coalesce("component", "node").alias("component"), n_links.alias("n_links")))
    named = named.join(named.groupBy("component").agg(F.min("id").alias("component_id")), "component")
    return (made.found.select("doc_id", F.col("n").alias("n_shingles"), "same").join(named, "same", "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
                    F.coalesce("n_links", F.lit(0)).alias("n_links")))


def similar_classes(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``doc_id, n_shingles, component_id``: the class of each document, named by its smallest id."""
    made = groups(docs, n, num, den)
    found, node_texts, dealt, shard, smallest = made.found, made.node_texts, made.dealt, made.shard, made.smallest
    # A large group is dealt over parts; its pivot is in each.
    part = F.when(F.col("doc_id") == F.col("pivot"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(
        F.array(F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int")))
    placed = dealt.withColumn("part", F.explode(part))
    empty = F.lit(None).cast("bigint")
    first = kept(search(placed.join(node_texts, "doc_id").select(
        shard.alias("shard"), "pivot", "part", "doc_id", F.lit(None).cast("boolean").alias("asks"),
        empty.alias("class"), "text"), n, num, den), "similar-links")
    first = first.unionByName(made.ties)
    labels = components(first)

    # Large groups that are not one class yet: whoever is not in the main class asks the other parts.
    large = (dealt.filter("parts > 1").join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
             .select("pivot", "doc_id", "n", "parts", F.coalesce("component", "doc_id").alias("class")))
    sizes = large.groupBy("pivot", "class").count()
    main = (sizes.groupBy("pivot").agg(F.max_by("class", F.struct("count", "class")).alias("main"),
                                       F.count("*").alias("classes")).filter("classes > 1").drop("classes"))
    open_groups = kept(large.join(main, "pivot"), "similar-open")
    if not open_groups.isEmpty():
        askers = (open_groups.filter("class <> main")
                  .withColumn("askers", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("parts")).cast("int")))
        side = ["pivot", "doc_id", "class", "parts"]
        every_part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        asking = askers.select(*side, "askers", every_part.alias("part"), F.lit(True).alias("asks"))
        asked = (open_groups.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
                 .join(askers.select("pivot", "askers").distinct(), "pivot")
                 .select(*side, "askers", "part", F.lit(False).alias("asks")))
        met = asking.unionByName(asked).withColumn("part", F.col("askers") * F.col("parts") + F.col("part"))
        second = search(met.join(node_texts, "doc_id").select(
            F.xxhash64("pivot", "part").alias("shard"), "pivot", "part", "doc_id", "asks", "class", "text"), n, num, den)
        labels = components(kept(first.unionByName(second), "similar-links"))

    named = smallest.join(labels, "node", "left").select("same", F.coalesce("component", "node").alias("component_id"))
    return (found.select("doc_id", F.col("n").alias("n_shingles"), "same").join(named, "same", "left")
            .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")))


def keep_one(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One document of each class of similar ones, that with the smallest id, with all its columns.

    Of rows that share id and text one stays; rows without an id all stay.
    """
    classes = similar_classes(docs.select("doc_id", "text"), n, num, den)
    first = classes.filter("doc_id = component_id").select(F.col("doc_id").alias("first")).distinct()
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    repeated = Window.partitionBy("row.doc_id", F.xxhash64("row.text")).orderBy("row.doc_id")
    ranked = whole.join(first, F.col("row.doc_id") == F.col("first"), "left").withColumn("copy", F.row_number().over(repeated))
    return ranked.filter("row.doc_id is null or (first is not null and copy = 1)").select("row.*")
