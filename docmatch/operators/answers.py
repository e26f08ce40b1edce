"""A ledger of model answers, so that a job that was stopped asks only what is unanswered.

The ledger is an append-only Parquet table with a row per answer, keyed by the hash of the prompt and the model. Each
task's answers become visible when the task ends, not when the job does, so what a killed job has paid for stays
paid for; a task holds ``calls_per_task`` prompts at most, which bounds what can be lost. Equal prompts to one model are
one call. Failed calls are kept with their error and asked again by the next run; a good answer is never replaced.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmatch.operators import models

KEY = ["prompt_key", "model_used"]
SCHEMA = "prompt_key string, model_used string, raw_output string, attempts int, error string, run bigint"
ANSWER = ["raw_output", "attempts", "error"]
# Files move to the table when their task commits; a task that ran twice leaves equal keys, which reading folds.
AT_ONCE = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The one answer of every key: the first good one, or else the last error."""
    try:
        rows = spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException:
        rows = spark.createDataFrame([], SCHEMA)
    failed = F.col("error").isNotNull()
    order = F.struct(failed.alias("failed"), F.when(failed, -F.col("run")).otherwise(F.col("run")).alias("run"), "raw_output")
    best = rows.groupBy(*KEY).agg(F.min_by(F.struct(*ANSWER), order).alias("_best"))
    return best.select(*KEY, *(F.col(f"_best.{c}").alias(c) for c in ANSWER))


def _next_run(spark: SparkSession, path: str) -> int:
    try:
        return (spark.read.schema(SCHEMA).parquet(path).agg(F.max("run")).head()[0] or 0) + 1
    except AnalysisException:
        return 1


def resumable(
    df: DataFrame, fns: dict[str, models.GenerateFn], path: str, *, default: str, prompt: str = "prompt",
    model: str = "llm_name", calls_per_task: int = 256, concurrency: int = 3, **options,
) -> DataFrame:
    """``df`` with ``model_used, raw_output, attempts, error``, asking models only what the ledger at ``path`` lacks.

    Rows without a prompt are not asked. ``options`` are those of ``models.generate``. The result reads the ledger, so
    it can be evaluated any number of times without a call.
    """
    spark = df.sparkSession
    if default not in fns:
        raise ValueError(f"default model {default!r} is not among the functions")
    keyed = df.withColumns({"model_used": models.model_of(df, model, default), "prompt_key": F.sha2(F.col(prompt), 256)})
    known = read_ledger(spark, path).where(F.col("error").isNull()).select(*KEY)
    # Equal prompts meet before they are asked; one copy per task moves.
    new = (keyed.where(F.col(prompt).isNotNull()).groupBy(*KEY).agg(F.any_value(prompt).alias("_prompt"))
           .join(known, KEY, "left_anti"))
    tasks = max(1, -(-new.count() // calls_per_task))
    if options.get("max_parallel_calls") is None:
        new = new.repartition(tasks, *KEY)
    asked = models.generate(new, fns, default=default, prompt="_prompt", model="model_used", concurrency=concurrency, **options)
    out = asked.select(*KEY, *ANSWER, F.lit(_next_run(spark, path)).cast("bigint").alias("run"))
    out.write.mode("append").options(**AT_ONCE).parquet(path)
    answered = keyed.join(read_ledger(spark, path), KEY, "left")
    none = F.col(prompt).isNull()
    return answered.withColumns({
        "attempts": F.when(none, 0).otherwise(F.col("attempts")),
        "error": F.when(none, "no prompt").otherwise(F.col("error"))}).select(*df.columns, "model_used", *ANSWER)
