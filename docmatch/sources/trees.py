"""Readers for document trees and match requests, and the result writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIDES = ("input", "reference")

REQUEST_SCHEMA = T.StructType([
    T.StructField("job_id", T.StringType()),
    T.StructField("project_id", T.StringType()),
    T.StructField("scenario", T.StringType()),
    T.StructField("input_data", T.StringType()),
    T.StructField("reference_data", T.StringType()),
])


def read_trees(spark: SparkSession, path: str, side: str, layout: str = "lines") -> DataFrame:
    """Read trees as ``(doc_id, side, raw)``.

    ``layout="lines"`` takes one JSON tree per line and scales with the files; ``layout="file"``
    takes one tree per file, for trees printed over several lines.
    """
    if layout not in ("lines", "file"):
        raise ValueError(f"layout must be 'lines' or 'file', got {layout!r}")
    text = spark.read.text(path, wholetext=layout == "file")
    if layout == "lines":
        text = text.where(F.trim("value") != "")
        doc_id = F.sha2("value", 256)
    else:
        doc_id = F.input_file_name()
    return text.select(doc_id.alias("doc_id"), F.lit(side).alias("side"), F.col("value").alias("raw"))


def parse(trees: DataFrame) -> DataFrame:
    """Replace ``raw`` by the parsed ``tree``, NULL where it is not JSON.

    As the output of a generator the tree is made once per row; as a plain expression the optimizer
    would copy the parsing into every later test of it.
    """
    rest = [c for c in trees.columns if c != "raw"]
    return trees.select(*rest, F.explode(F.array(F.try_parse_json("raw"))).alias("tree"))


def split_parsable(trees: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parsed trees (column ``tree``) and the rows whose text is not JSON."""
    parsed = parse(trees.withColumn("_raw", F.col("raw")))
    good = parsed.where("tree IS NOT NULL").drop("_raw")
    return good, parsed.where("tree IS NULL").drop("tree").withColumnRenamed("_raw", "raw")


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Read JSONL requests; nested parts stay JSON text until a stage needs them."""
    return spark.read.schema(REQUEST_SCHEMA).json(path)


def _is_blank_json(text: Column) -> Column:
    """True for NULL and for the JSON values that hold nothing."""
    return F.coalesce(F.trim(text).isin("", "null", "{}", "[]", '""'), F.lit(True))


def split_complete(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with every part present and non-empty, and the rest with ``missing`` names."""
    parts = ["job_id", "project_id", "scenario", "input_data", "reference_data"]
    missing = F.array_compact(F.array(*[F.when(_is_blank_json(F.col(c)), F.lit(c)) for c in parts]))
    checked = requests.withColumn("missing", missing)
    return checked.where(F.size("missing") == 0).drop("missing"), checked.where(F.size("missing") > 0)


def request_trees(requests: DataFrame) -> DataFrame:
    """One ``(job_id, project_id, doc_id, side, raw)`` row per tree of each request."""
    sides = F.array(*[
        F.struct(F.lit(s).alias("side"), F.col(f"{s}_data").alias("raw")) for s in SIDES
    ])
    return requests.select("job_id", "project_id", F.inline(sides)).select(
        "job_id", "project_id", F.concat_ws("/", "job_id", "side").alias("doc_id"), "side", "raw"
    )


def write_results(results: DataFrame, path: str, fmt: str = "json", mode: str = "errorifexists") -> None:
    """Write results in one folder per project.

    Rebalancing by project first keeps the number of files low; a large project still splits by size
    over many tasks and files.
    """
    results.hint("rebalance", "project_id").write.mode(mode).partitionBy("project_id").format(fmt).save(path)
