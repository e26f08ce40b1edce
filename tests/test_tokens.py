"""Token ends: counts, cuts and budgets, on texts of any length."""

import base64
import random
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from docmatch.functions import text as tx
from docmatch.functions import tokens
from docmatch.operators import prompt

CASES = ["", " ", "one two  three", " lead and trail ", "日本語 text", "a\nb\tc\rd", "😀😀😀😀😀 é", "x" * 13, "non breaking space"]
WORD = re.compile(r"[^ \t\r\n]+")


def plain_ends(text, split):
    return [m.end() for m in split(text)]


def piece_matches(size):
    return lambda text: [m for w in WORD.finditer(text) for m in re.compile(f"(?s).{{1,{size}}}").finditer(text, *w.span())]


@pytest.mark.parametrize("tokenizer,split", [
    (tokens.words(), lambda t: list(WORD.finditer(t))), (tokens.pieces(1), piece_matches(1)), (tokens.pieces(4), piece_matches(4)),
    (tokens.from_tokens(lambda t: re.findall(r"\w+|[^\w\s]", t)), lambda t: list(re.finditer(r"\w+|[^\w\s]", t)))])
def test_counts_and_cuts(spark, tokenizer, split):
    df = spark.createDataFrame([(c, n) for c in CASES for n in (-1, 0, 1, 2, 3, 9)], "t string, n int")
    t, n = F.col("t"), F.col("n")
    for r in df.select("t", "n", tokenizer(t).alias("count"), tokenizer.ends(t).alias("ends"), tx.truncate(t, n, tokenizer).alias("cut")).collect():
        ends = plain_ends(r.t, split)
        assert r["count"] == len(ends) and r.ends == [len(r.t[:e].encode()) for e in ends]
        assert r.cut == (r.t if r.n <= 0 or len(ends) <= r.n else r.t[:ends[r.n - 1]])


def test_null_texts(spark):
    df = spark.createDataFrame([(None,)], "t string")
    counter = tokens.words()
    r = df.select(counter(F.col("t")).alias("c"), tx.truncate(F.col("t"), 3, counter).alias("x"), tx.truncate_words(F.col("t"), 3).alias("w")).first()
    assert r.c in (None, -1) and r.x is None and r.w is None


@pytest.mark.parametrize("words,cuts", [(30_000, (1, 5_000, 20_000, 30_000, 40_000)), (1_000_000, (5_000, 500_000))])
def test_long_texts_are_cut_without_repeated_groups(spark, words, cuts):
    rng = random.Random(words)
    said = [rng.choice(["größe", "a", "word,", "😀x"]) for _ in range(words)]
    text = " \n".join(said)
    df = spark.createDataFrame([(text, n) for n in cuts], "t string, n int")
    counters = {"native": tx.count_words, "ends": tokens.words()}
    out = df.select("n", *(tx.truncate(F.col("t"), F.col("n"), c).alias(k) for k, c in counters.items()),
                    *(c(F.col("t")).alias(f"{k}_count") for k, c in counters.items())).collect()
    for r in out:
        want = " \n".join(said[:r.n])
        assert r.native == want and r.ends == want and r.native_count == r.ends_count == words


def test_byte_pairs_equal_the_library(spark):
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    counter = tokens.byte_pairs(ranks, public_tokenizers.PATTERN)
    cases = [*CASES, "token counting, truncating and 日本語の文章 with emoji 😀🤖", "<|endoftext|> is text"]
    df = spark.createDataFrame([(c, n) for c in cases for n in (1, 3, 7)], "t string, n int")
    for r in df.select("t", "n", counter(F.col("t")).alias("c"), tx.truncate(F.col("t"), F.col("n"), counter).alias("x")).collect():
        ids = library.encode_ordinary(r.t)
        assert r.c == len(ids) and r.x.rstrip("�") == library.decode(ids[:r.n]).rstrip("�")


def test_budget_with_a_sub_word_counter(spark):
    counter = tokens.pieces(3)
    lines = spark.createDataFrame([("q", i, t) for i, t in enumerate(["abc", "abcd ef", "x", "abcabcabc"], 1)], "q string, cand_no int, line string")
    rows = lines.withColumns({"header_tokens": F.lit(2), "max_prompt_tokens": F.lit(7)})
    got = [(r.used_tokens, r.fits) for r in prompt.budget(rows, ["q"], counter=counter).orderBy("cand_no").collect()]
    assert got == [(3, True), (6, True), (7, True), (10, False)]


def test_one_pass_finds_the_ends_for_count_and_cut(spark):
    from tests.test_search import plan

    counter, t = tokens.pieces(4), F.col("t")
    df = spark.createDataFrame([("a b", 1)], "t string, n int")
    shown = plan(df.select(counter(t).alias("c"), tx.truncate(t, F.col("n"), counter).alias("x")), "simple")
    assert shown.count("ArrowEvalPython") == 1
