"""Prompts: header, candidate lines and the token budget.

Every query has at most ``k`` candidates here, so the per-query windows and lists are small.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docmatch.functions.text import TokenCounter, count_chars

HeaderFn = Callable[[Column, Column], Column]

LEG_NOTES = {
    "forward": "Task: find the reference entries that the query text matches.",
    "reverse": "Task: find the input texts that match the query entry.",
}


def header(leg: Column, query_text: Column) -> Column:
    """Default header over resolved scenario columns; callers may pass their own function."""
    note = F.create_map(*[F.lit(x) for pair in LEG_NOTES.items() for x in pair])[leg]
    return F.concat_ws(
        "\n",
        F.when(F.col("role_desc") == "", "You compare texts.").otherwise(F.col("role_desc")),
        F.coalesce(note, F.lit("")),
        F.concat(F.lit("References: "), "reference_desc"),
        F.concat(F.lit("Inputs: "), "input_desc"),
        F.concat(F.lit("Scoring: "), "scoring_rule"),
        F.concat(F.lit("Leave out matches below confidence "), F.col("cof_threshold").cast("string"), F.lit(".")),
        F.lit("Answer with a JSON list; give input_uid, ref_uid, evidences, start_end_idx, confidence."),
        F.lit("# Query"),
        query_text,
        F.lit("# Candidates"),
        F.lit(""),
    )


def candidate_line(rank: Column, uid: Column, score: Column, text: Column) -> Column:
    """``[Cand#i] uid=… score=…`` with three decimals, then the text on its own line."""
    # Fixed format: models are given candidates in this form.
    shown = F.format_string("%.3f", F.round(F.coalesce(score, F.lit(0.0)), 3))
    return F.concat(
        F.lit("[Cand#"), rank.cast("string"), F.lit("] uid="), uid, F.lit(" score="), shown,
        F.lit("\n"), text, F.lit("\n"),
    )


def rank_candidates(hits: DataFrame, keys: list[str]) -> DataFrame:
    """Candidate numbers by score, a missing score counting as 0; equal scores keep retrieval order."""
    w = Window.partitionBy(*keys).orderBy(F.desc(F.coalesce("score", F.lit(0.0))), "rank")
    return hits.withColumn("cand_no", F.row_number().over(w))


def with_header(
    queries: DataFrame, *, leg: str = "leg", query_text: str = "query_text",
    header_fn: HeaderFn = header, counter: TokenCounter = count_chars,
) -> DataFrame:
    """Add ``header`` and its token count, line break included, to one row per query."""
    headed = queries.withColumn("header", header_fn(F.col(leg), F.col(query_text)))
    return headed.withColumn("header_tokens", counter(F.col("header")) + counter(F.lit("\n")))


def budget(
    candidates: DataFrame, keys: list[str], *, line: str = "line", max_tokens: str = "max_prompt_tokens",
    counter: TokenCounter = count_chars,
) -> DataFrame:
    """Running token use and whether each candidate still fits, given ``header_tokens``.

    Lines cost at least one token, so the lines that fit by running sum are the longest prefix.
    """
    w = Window.partitionBy(*keys).orderBy("cand_no").rowsBetween(Window.unboundedPreceding, 0)
    used = F.col("header_tokens") + F.sum(counter(F.col(line))).over(w)
    fits = (F.col("header_tokens") < F.col(max_tokens)) & (F.col("used_tokens") <= F.col(max_tokens))
    return candidates.withColumn("used_tokens", used).withColumn("fits", fits)


def assemble(budgeted: DataFrame, queries: DataFrame, keys: list[str], *, max_tokens: str = "max_prompt_tokens") -> DataFrame:
    """``queries`` that have candidates, with ``prompt, used_k, prompt_tokens, status``.

    ``prompt`` is NULL unless the status is ok.
    """
    kept = F.sort_array(F.collect_list(F.when(F.col("fits"), F.struct("cand_no", "line"))))
    lists = budgeted.groupBy(*keys).agg(
        kept.alias("_lines"), F.max(F.when(F.col("fits"), F.col("used_tokens"))).alias("prompt_tokens")
    )
    status = (
        F.when(F.col("header_tokens") >= F.col(max_tokens), "header_too_long")
        .when(F.size("_lines") == 0, "no_candidate_fits").otherwise("ok")
    )
    body = F.concat("header", F.array_join(F.col("_lines.line"), ""))
    return queries.join(lists, keys).withColumns({"used_k": F.size("_lines"), "status": status}).withColumn(
        "prompt", F.when(F.col("status") == "ok", body)
    ).drop("_lines", "header")


def build_prompts(
    candidates: DataFrame, queries: DataFrame, keys: list[str], *, max_tokens: str = "max_prompt_tokens",
    leg: str = "leg", query_text: str = "query_text", header_fn: HeaderFn = header, counter: TokenCounter = count_chars,
) -> DataFrame:
    """Hits with their texts, and one row per query with its text and scenario columns, to prompts.

    Candidates meet only the two token numbers of their query; its text joins once, at the end, and
    every step is keyed alike.
    """
    headed = with_header(queries, leg=leg, query_text=query_text, header_fn=header_fn, counter=counter)
    limits = headed.select(*keys, "header_tokens", max_tokens)
    lines = rank_candidates(candidates.join(limits, keys), keys).withColumn(
        "line", candidate_line(F.col("cand_no"), F.col("uid"), F.col("score"), F.col("text"))
    )
    return assemble(budget(lines, keys, max_tokens=max_tokens, counter=counter), headed, keys, max_tokens=max_tokens)
