"""The whole matching job: trees in, predictions and envelopes out, for all projects at once.

The scenario is one record for all projects, or a table with a row per project.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, fields
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from docmatch.functions.text import TokenCounter, count_chars
from docmatch.operators import collection as col
from docmatch.operators import hierarchy, metrics, models, predictions, prompt, search, validate
from docmatch.operators.answers import resumable
from docmatch.operators.scenario import Scenario, effective_k, resolve, searched_side
from docmatch.sources.staging import stage, staged_by
from docmatch.sources.trees import request_trees, split_complete

SCENARIO_TYPES = {
    "role_desc": "string", "reference_desc": "string", "input_desc": "string", "scoring_rule": "string",
    "direction": "string", "rag_k": "int", "rag_k_forward": "int", "rag_k_reverse": "int",
    "cof_threshold": "double", "reference_depth": "int", "input_depth": "int", "chunk_size": "int",
    "llm_name": "string", "max_prompt_tokens": "int",
}
QUERY = ["leg", "project_id", "query_uid"]
MAX_NAMED_PROJECTS = 200


@dataclass(frozen=True)
class MatchResult:
    """Tables of one job, which hold the legs that ran but for ``rejected_trees``, and its counts."""

    predictions: DataFrame
    envelopes: DataFrame
    answers: DataFrame
    hits: DataFrame
    rejected_trees: DataFrame
    counts: dict[str, int] = field(default_factory=dict)


def _with_scenario(df: DataFrame, scenario: Scenario | DataFrame, names: list[str]) -> DataFrame:
    """Add resolved scenario columns: constants, or one row per project."""
    if isinstance(scenario, DataFrame):
        return df.join(scenario.select("project_id", *names), "project_id")
    kinds = {"llm_name": "string", "cof_threshold": "double", "rag_k_forward": "int", "rag_k_reverse": "int"}
    values = {n: F.lit(getattr(scenario, n)) for n in names}
    return df.withColumns({n: v.cast(kinds[n]) if n in kinds else v for n, v in values.items()})


def text_rows(trees: DataFrame, scenario: Scenario | DataFrame) -> DataFrame:
    """Valid trees to chunked text rows, each side to its own depth."""
    own = _with_scenario(trees, scenario, ["input_depth", "reference_depth", "chunk_size"])
    depth = F.when(F.col("side") == "reference", F.col("reference_depth")).otherwise(F.col("input_depth"))
    if isinstance(scenario, Scenario) and scenario.input_depth == scenario.reference_depth:
        depth = scenario.input_depth
    size = F.col("chunk_size") if isinstance(scenario, DataFrame) else scenario.chunk_size
    return hierarchy.chunk(hierarchy.flatten(own, depth), size).drop("input_depth", "reference_depth", "chunk_size")


def _largest_k(scenario: Scenario | DataFrame, leg: str) -> int:
    """Upper bound of k; one number from a table of one row per project."""
    if isinstance(scenario, Scenario):
        return scenario.k(leg)
    return scenario.agg(F.max(effective_k(F.lit(leg))).alias("k")).head()["k"] or 1


def _sides(leg: str) -> tuple[str, str]:
    """The side that asks and the side that is searched."""
    return ("reference", "input") if leg == "reverse" else ("input", "reference")


def _queries(points: DataFrame, leg: str, scenario: Scenario | DataFrame) -> DataFrame:
    """The rows that ask in a leg, with their k."""
    rows = points.where(F.col("side") == _sides(leg)[0]).select(
        F.lit(leg).alias("leg"), F.col("project_id").alias("project_id"), F.col("uid").alias("query_uid"),
        F.col("vector").alias("vector"), F.col("text").alias("query_text"), F.col("group_uid").alias("root_uid"),
    )
    names = ["direction", "rag_k", "rag_k_forward", "rag_k_reverse"]
    asking = _with_scenario(rows, scenario, names).where(F.lower("direction").isin(leg, "both"))
    return asking.withColumn("k", effective_k(F.lit(leg))).drop(*names)


def _searched(points: DataFrame, leg: str) -> DataFrame:
    return points.where(F.col("side") == _sides(leg)[1])


def _indexed(batch: DataFrame, scenario: Scenario | DataFrame) -> DataFrame:
    """The rows of a batch that a kept collection takes: the sides its direction searches, and rejects."""
    named = _with_scenario(batch, scenario, ["direction"])
    searched = F.lower("direction").isin("both") | (F.col("side") == searched_side(F.lower("direction")))
    return named.where((F.col("op") == "reject") | searched).select(*batch.columns)


def _log_of_projects(path: str, batch: DataFrame) -> DataFrame:
    """The kept log of the batch's projects. A few of them prune folders and row groups by name."""
    spark, projects = batch.sparkSession, batch.select("project_id").distinct()
    names = [r["project_id"] for r in projects.head(MAX_NAMED_PROJECTS + 1)]
    if len(names) <= MAX_NAMED_PROJECTS:
        return col.read_log(spark, path, names)
    return col.read_log(spark, path).join(projects, "project_id", "left_semi")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def match(
    trees: DataFrame,
    scenario: Scenario | DataFrame,
    embed_fn: models.EmbedFn,
    generators: dict[str, models.GenerateFn],
    *,
    default_model: str,
    dim: int,
    header_fn: prompt.HeaderFn = prompt.header,
    counter: TokenCounter = count_chars,
    strategy: str = "auto",
    dedupe: bool = False,
    few_files: bool = False,
    as_coded: bool = False,
    max_parallel_calls: int | None = None,
    sleep: Callable[[int], None] = models.wait,
    collection_path: str | None = None,
    seq: int = 0,
    concurrency: int = 1,
    ledger_path: str | None = None,
    run_id: str | None = None,
) -> MatchResult:
    """Match ``(project_id, doc_id, side, raw)`` trees in the scenario's direction.

    A scenario table has one resolved row per project (see ``scenario.resolve``), valid ones only.
    Both kinds of model calls end in stored tables, the batch of points and the answers, so no later
    stage repeats them. The rows of this job ask, whatever else a kept collection holds. They search the
    points of the job's projects: those of the kept collection at ``collection_path``, to which the job
    first adds its rows of the sides that are searched, or else the job's own. With a ``ledger_path``
    answers are kept there and a job that was stopped asks only what is unanswered. With a ``run_id`` the job meets
    nothing of other runs in a kept collection, its tables have a column ``run_id``, and ``staging.remove_run`` deletes
    what it staged. ``counts`` come from the writes of batch and answers, without a pass of their own.
    """
    if run_id is not None:
        trees, scenario = (df if isinstance(df, Scenario) else df.withColumn("project_id", col.of_run(F.col("project_id"), run_id))
                           for df in (trees, scenario))
        with staged_by(run_id):
            made = match(
                trees, scenario, embed_fn, generators, default_model=default_model, dim=dim, header_fn=header_fn, counter=counter,
                strategy=strategy, dedupe=dedupe, few_files=few_files, as_coded=as_coded, max_parallel_calls=max_parallel_calls,
                sleep=sleep, collection_path=collection_path, seq=seq, concurrency=concurrency, ledger_path=ledger_path)
        tables = {f.name: getattr(made, f.name) for f in fields(made)}
        return MatchResult(**{n: col.without_run(t) if isinstance(t, DataFrame) else t for n, t in tables.items()})
    valid, rejected = validate.split_valid(trees)
    legs = scenario.legs() if isinstance(scenario, Scenario) else ("forward", "reverse")

    rows = text_rows(valid, scenario)
    written, told = Observation(), Observation()
    batch = stage(col.embedded(rows, embed_fn, seq, dim=dim, dedupe=dedupe).observe(written, *metrics.log_metrics()), "batch")
    asking = col.stored_current(batch)
    if collection_path is None:
        points = asking
    else:
        col.append_log(_indexed(batch, scenario), collection_path, few_files)
        points = col.stored_current(_log_of_projects(collection_path, batch))

    # Hits stay narrow; the texts of both ends join where prompts are made.
    hits = stage(_union([
        search.knn(
            _queries(asking, leg, scenario), _searched(points, leg), _largest_k(scenario, leg),
            scope=["project_id"], strategy=strategy, k_column="k" if isinstance(scenario, DataFrame) else None,
        ).withColumn("leg", F.lit(leg))
        for leg in legs
    ]), "hits")
    candidates = _union([
        search.with_payload(hits.where(F.col("leg") == leg), _searched(points, leg), ["text"], scope=["project_id"])
        for leg in legs
    ])
    queries = _with_scenario(
        _union([_queries(asking, leg, scenario).drop("vector", "k") for leg in legs]), scenario,
        ["role_desc", "reference_desc", "input_desc", "scoring_rule", "cof_threshold", "max_prompt_tokens",
         "llm_name", "direction"],
    )
    prompts = prompt.build_prompts(candidates, queries, QUERY, header_fn=header_fn, counter=counter)
    asked = prompts.where(F.col("status") == "ok").select(
        *QUERY, "root_uid", "cof_threshold", "llm_name", "direction", "used_k", "prompt_tokens", "prompt"
    )
    calls = {"default": default_model, "max_parallel_calls": max_parallel_calls, "sleep": sleep, "concurrency": concurrency}
    answered = (models.generate(asked, generators, **calls) if ledger_path is None
                else resumable(asked, generators, ledger_path, **calls))
    answers = stage(answered.drop("prompt").observe(told, *metrics.answer_metrics()), "answers")

    head = [*QUERY, "root_uid", "model_used", "used_k", "cof_threshold"]
    # As coded, the reverse leg of "both" keeps its sides as the model gave them.
    swapped = F.when(F.lower("direction") != "both", F.col("leg")) if as_coded else F.col("leg")
    parsed = predictions.parse_output(answers.select(*head, "raw_output", swapped.alias("_swap")))
    good = predictions.swap_reverse(parsed.where(F.col("item_status") == "ok"), "_swap").drop("_swap")
    scored = predictions.attach_scores(good, hits, QUERY, as_coded=as_coded)
    kept = predictions.filter_confidence(scored)
    done = answers.where(F.col("error").isNull())
    return MatchResult(
        predictions=kept,
        envelopes=predictions.envelopes(done, kept, QUERY, head),
        answers=answers,
        hits=hits,
        rejected_trees=rejected,
        counts={**written.get, **told.get},
    )


def match_requests(
    requests: DataFrame, embed_fn: models.EmbedFn, generators: dict[str, models.GenerateFn],
    *, defaults: Scenario = Scenario(), **options,
) -> tuple[MatchResult, DataFrame]:
    """Run all complete requests, each with its own scenario over the defaults.

    Every job is a project of its own named ``job_id``. Returns the result and the rejected requests:
    incomplete ones, with ``missing`` parts, and ones that break a scenario rule, with ``broken`` fields.
    """
    complete, incomplete = split_complete(requests)
    kinds = ", ".join(f"{n} {k}" for n, k in SCENARIO_TYPES.items())
    given = complete.withColumn("_s", F.from_json("scenario", kinds)).select("*", "_s.*").drop("_s")
    jobs = given.withColumn("project_id", F.col("job_id"))
    broken = validate.scenario_violations(jobs).groupBy("project_id").agg(
        F.sort_array(F.collect_set("field")).alias("broken"))
    good = jobs.join(broken, "project_id", "left_anti")
    # Every step joins the scenarios; stored, they cost no further reading of the requests.
    with staged_by(options.get("run_id")):
        scenarios = stage(resolve(good.select("project_id", *SCENARIO_TYPES), defaults), "scenarios")
    if scenarios.count() > search.BROADCAST_SCOPES:
        # Their files are small, as their columns repeat; their rows are not, and must not be broadcast.
        scenarios = scenarios.hint("merge")
    trees = request_trees(good.select("job_id", "project_id", "input_data", "reference_data"))
    # Requests mix their jobs, so each task would otherwise write into every job's folder.
    options = {"few_files": True, **options}
    result = match(trees.drop("job_id"), scenarios, embed_fn, generators, **options)
    bad = complete.join(broken.withColumnRenamed("project_id", "job_id"), "job_id")
    return result, incomplete.unionByName(bad, allowMissingColumns=True)


def job_summary(result: MatchResult) -> DataFrame:
    """Queries answered, predictions kept and failures per project and leg, without gathering rows."""
    keys = ["project_id", "leg"]
    asked = result.answers.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("queries"), F.count("error").alias("failed")
    )
    kept = result.predictions.groupBy(*keys).agg(F.count(F.lit(1)).alias("predictions"))
    return asked.join(kept, keys, "left").withColumn("predictions", F.coalesce("predictions", F.lit(0)))
