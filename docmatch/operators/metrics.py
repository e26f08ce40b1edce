"""Counts taken while rows pass, with ``DataFrame.observe``: no second pass over what is written.

A retried stage counts once, but rows of a task that ran twice for speed may count twice, as Spark's observations do.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def log_metrics() -> list[Column]:
    """Of log rows: points by side, deletions, rejects, texts cut into chunks and the longest text in bytes."""
    written = F.col("op") == "upsert"
    return [
        F.count_if(written).alias("points"),
        F.count_if(written & (F.col("side") == "input")).alias("input_points"),
        F.count_if(written & (F.col("side") == "reference")).alias("reference_points"),
        F.count_if(F.col("op") == "delete").alias("deletions"),
        F.count_if(F.col("op") == "reject").alias("rejects"),
        F.coalesce(F.max(F.octet_length("text")), F.lit(0)).alias("longest_text_bytes"),
    ]


def answer_metrics() -> list[Column]:
    """Of answers: queries asked, failed ones, calls and prompt tokens."""
    return [
        F.count(F.lit(1)).alias("queries"), F.count("error").alias("failed"),
        F.coalesce(F.sum("attempts"), F.lit(0)).alias("calls"), F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"),
    ]


def oversize_metric(size: int) -> Column:
    """Texts whose UTF-8 form is longer than ``size`` bytes."""
    return F.count_if(F.octet_length("text") > size).alias("oversize")
