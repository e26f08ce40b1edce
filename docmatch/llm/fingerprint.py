"""I-Match fingerprints in plain DataFrame expressions.

A document's terms are its distinct lower-cased words. The lexicon keeps the terms whose document frequency
lies in a band of shares of all documents: rarer ones are typing errors and numbers, more frequent ones say
little. Document frequencies are counted per term (64-bit hash) over all documents. A lexicon has at most the
mean number of distinct terms of a text divided by the band's lower share, whatever the corpus, so it travels
as a table of slots inside the plan and texts are fingerprinted where they are read, without a row per term. A
lexicon of more than ``MOST_IN_PLAN`` terms (very long texts) meets the texts' terms in a join instead, with
the same results. A document's distinct lexicon terms are sorted and hashed once per randomised subset of the
lexicon. Subsets come in series; in a series they keep a random half, quarter, eighth ... of the lexicon.

Two fingerprints are as alike as the share of series whose hashes agree in the sparsest subset in which either
document has terms. The dense subsets tell near copies apart, the sparse ones, which hold a term or two of a
document, still agree for documents that share a part. Equal texts have equal fingerprints. A null or empty
text, and one without lexicon terms, has an empty fingerprint; two empty ones are alike (1.0), an empty and
another one are not (0.0).
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmatch.llm.common import kept

SLOTS = 1 << 16
MOST_IN_PLAN = 1 << 20
# Document frequencies of the band, as shares of all documents. One document proves nothing in any table, and in
# tables of fewer than 250 documents the upper end is 50 of them.
LEAST_DOCUMENTS, LEAST_SHARE, LARGEST_SHARE = 2, 0.0005, 0.2
RANGES, MOST_RANGES, RANGE_BYTES, STEP = 200, 10_000, 256 << 20, 100
SERIES, HALVINGS = 7, 9  # one bit of a term's hash decides each halving
DIGITS = 6  # hexadecimal digits per hash
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = r"[ \t-\r]+"


def terms(text: Column) -> Column:
    """Hashes of a text's distinct words, sorted."""
    words = F.split(F.translate(text, _UPPER, _LOWER), _SPACE)
    return F.array_sort(F.array_distinct(F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))))


def slot(term: Column) -> Column:
    return F.pmod(F.shiftright(term, 40), F.lit(SLOTS)).cast("int")


def counted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``term, inside`` of the terms in the band (true) and above it (false).

    Counts are combined where the texts are read. Few terms can be above the band: a document of m terms
    pays for at most m / LARGEST_SHARE of them.
    """
    n, seen = docs.count(), F.col("count")
    counts = docs.select(F.explode(terms(F.coalesce(F.col(text_col), F.lit("")))).alias("term")).groupBy("term").count()
    return (counts.filter(seen >= max(LEAST_DOCUMENTS, LEAST_SHARE * n))
            .select("term", (seen <= max(LARGEST_SHARE * n, 50)).alias("inside")))


def constant(values: list, kind: str) -> Column:
    """Nested lists of numbers as one literal of the plan."""
    return F.from_json(F.lit(json.dumps(values, separators=(",", ":"))), kind)


def in_slots(band: DataFrame) -> list[list[int]]:
    """The band's terms, at most ``MOST_IN_PLAN``, by slot."""
    found: list[list[int]] = [[] for _ in range(SLOTS)]
    for which, own in band.groupBy(slot(F.col("term"))).agg(F.collect_list("term")).toLocalIterator():
        found[which] = own
    return found


def in_band(text: Column, known: list[list[int]]) -> Column:
    """A text's terms that are in the band."""
    slots = constant(known, "array<array<bigint>>")
    return F.filter(terms(text), lambda t: F.array_contains(F.element_at(slots, slot(t) + 1), t))


def slots_of(band: DataFrame) -> list[int]:
    """One bit per slot, 64 to a number: set where the slot holds a term of the band."""
    words = band.select(slot(F.col("term")).alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, slot & 63))").alias("bits"))
    bits = [0] * (SLOTS // 64)
    for word, value in words.toLocalIterator():  # at most SLOTS / 64 rows
        bits[word] = value
    return bits


def without_bit(position: int):
    return lambda term: term.bitwiseAND(1 << position) == 0


def maybe_in_band(text: Column, bits: list[int]) -> Column:
    """A text's terms whose slot holds a term of the band."""
    known = constant(bits, "array<bigint>")
    return F.filter(terms(text),
                    lambda t: F.getbit(F.element_at(known, F.shiftright(slot(t), 6) + 1), slot(t).bitwiseAND(63)) == 1)


def with_fingerprint(df: DataFrame, text: str, name: str, known: list[list[int]]) -> DataFrame:
    """Add ``name``: the fingerprint of the text's terms in the band."""
    return of_terms(df.withColumn("_terms", in_band(F.col(text), known)), name)


def of_terms(df: DataFrame, name: str) -> DataFrame:
    """Turn ``_terms`` into ``name``: one hash per subset, in hexadecimal, ``-`` where the subset has none of them."""
    for halving in range(HALVINGS):
        df = df.withColumns({
            f"_{series}_{halving}": F.filter("_terms" if halving == 0 else f"_{series}_{halving - 1}",
                                             without_bit(series * HALVINGS + halving))
            for series in range(SERIES)})
    subsets = [f"_{series}_{halving}" for series in range(SERIES) for halving in range(HALVINGS)]
    digits = [F.when(F.size(s) == 0, "-").otherwise(
        F.lower(F.right(F.concat(F.lit("0" * DIGITS), F.hex(F.xxhash64(s))), F.lit(DIGITS)))) for s in subsets]
    return df.withColumn(name, F.concat_ws(" ", *digits)).drop("_terms", *subsets)


def prints(every_text: DataFrame, lexicon_terms: DataFrame) -> DataFrame:
    """``key, print`` of each text (``key, text``) that has terms of the band.

    Terms above the band leave by a broadcast, so none of the joined ones is in more than the band's share.
    """
    band = lexicon_terms.filter("inside").select("term")
    met = (every_text.select("key", F.explode(maybe_in_band(F.col("text"), slots_of(band))).alias("term"))
           .join(F.broadcast(lexicon_terms.filter("not inside").select("term")), "term", "left_anti")
           .join(band, "term").groupBy("key").agg(F.array_sort(F.collect_set("term")).alias("_terms")))
    return of_terms(met, "print")


def likeness(a: Column, b: Column) -> Column:
    """Share of series that agree in the sparsest subset in which either fingerprint has a hash."""
    pairs = F.arrays_zip(F.split(a, " ").alias("a"), F.split(b, " ").alias("b"))

    def sparsest(series: Column) -> Column:
        own = F.filter(F.slice(pairs, series * HALVINGS + 1, F.lit(HALVINGS)), lambda p: (p.a != "-") | (p.b != "-"))
        return F.try_element_at(own, F.lit(-1))

    told = F.filter(F.transform(F.sequence(F.lit(0), F.lit(SERIES - 1)), sparsest), lambda p: p.isNotNull())
    equal = F.size(F.filter(told, lambda p: p.a == p.b))
    return F.when((a == b) | (F.size(told) == 0), F.lit(1.0)).otherwise(equal / F.size(told))


def with_next(docs: DataFrame) -> DataFrame:
    """Documents in descending order of id, dealt over ranges, each range ended by the next one's first row.

    Columns: ``doc_id, text, _range, _ghost``. The document after the last is the first, so a range's
    neighbour is found for every row by a window over its range. Ranges hold equally many ids, about, and follow
    the bytes of all texts; only their bounds and largest ids, two numbers per range, are known to the driver.
    Null ids come last; rows with one id are ordered by the hash of their text.
    """
    size = docs.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    ranges = min(MOST_RANGES, max(RANGES, size // RANGE_BYTES))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))
    steps = [cuts[i:i + STEP] for i in range(0, len(cuts), STEP)] or [[]]

    def below(cuts: Column) -> Column:
        return F.size(F.filter(cuts, lambda c: c < F.col("doc_id")))

    # First the step whose first bound lies below the id, then the bounds within that step.
    step = below(constant([s[0] for s in steps[1:]], "array<bigint>"))
    within = F.when(F.col("doc_id").isNull(), -1).otherwise(
        step * STEP + below(F.element_at(constant(steps, "array<array<bigint>>"), step + 1)))
    ranged = docs.withColumn("_range", within)
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", F.xxhash64("text").alias("hash"))
    first = ranged.groupBy("_range").agg(F.max(order).alias("first"))
    found = sorted((r["_range"], r["first"]) for r in first.toLocalIterator())  # one row per range
    if not found:
        return ranged.withColumn("_ghost", F.lit(False))
    # The range that ends with the first row of another: the one above it; the lowest is followed by the top.
    follows = [(r, found[i - 1][1]) for i, (r, _) in enumerate(found)]
    ends = docs.sparkSession.createDataFrame(
        [(f["doc_id"], f["hash"], r) for r, f in follows], "_id bigint, _hash bigint, _range int")
    ghosts = (docs.join(F.broadcast(ends), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash")))
              .groupBy("_range").agg(F.min_by(F.struct("doc_id", "text"), "text").alias("d"))
              .select("d.doc_id", "d.text", "_range", F.lit(True).alias("_ghost")))
    return ranged.withColumn("_ghost", F.lit(False)).unionByName(ghosts)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, its edited text's, and their likenesses.

    The edited text's last half of the code points are the first as many, or all, of the next document.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lexicon_terms = kept(counted(docs), "fingerprint-lexicon")
    order = Window.partitionBy("_range").orderBy("_ghost", F.col("doc_id").desc_nulls_last(), F.col("_key").desc())
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")

    def edit(df: DataFrame) -> DataFrame:
        return (df.withColumn("_next", F.lead("text").over(order))
                .withColumn("_edited", F.concat(F.left("text", n - half), F.left(F.coalesce("_next", "text"), half))))

    near = [F.col("doc_id"), n.cast("bigint").alias("n_chars"), F.sha2("_edited", 256).alias("edited_sha256")]
    compared = [F.col("doc_id"), F.col("n_chars"), F.col("edited_sha256"), F.col("fingerprint"), F.col("edited_fingerprint"),
                likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                likeness(F.col("fingerprint"), F.col("_next_fingerprint")).alias("near_next")]
    band = lexicon_terms.filter("inside").select("term")
    if band.count() <= MOST_IN_PLAN:
        known = in_slots(band)
        edited = edit(with_fingerprint(with_next(docs), "text", "fingerprint", known).withColumn(
            "_key", F.xxhash64("text"))).withColumn(
            "_next_fingerprint", F.coalesce(F.lead("fingerprint").over(order), "fingerprint"))
        edited = edited.filter(~F.col("_ghost")).select(*near, "_edited", "fingerprint", "_next_fingerprint")
        return with_fingerprint(edited, "_edited", "edited_fingerprint", known).select(*compared)

    edited = edit(with_next(docs).withColumn("_key", F.xxhash64("text")))
    every = (docs.select(F.xxhash64("text").alias("key"), "text")
             .unionByName(edited.filter(~F.col("_ghost")).select(F.xxhash64("_edited").alias("key"), F.col("_edited").alias("text"))))
    found = kept(prints(every, lexicon_terms), "fingerprints")
    blank = F.lit(" ".join("-" * (SERIES * HALVINGS)))

    def with_print(df: DataFrame, key: str, name: str) -> DataFrame:
        own = found.select(F.col("key").alias(key), F.col("print").alias(name))
        return df.join(own, key, "left").withColumn(name, F.coalesce(name, blank))

    joined = edited.select(*near, "_range", "_ghost", "_key", F.xxhash64("_edited").alias("_edited_key"))
    joined = with_print(with_print(joined, "_key", "fingerprint"), "_edited_key", "edited_fingerprint")
    joined = joined.withColumn("_next_fingerprint", F.coalesce(F.lead("fingerprint").over(order), "fingerprint"))
    return joined.filter(~F.col("_ghost")).select(*compared)
