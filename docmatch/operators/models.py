"""Model calls over table columns, with caller-supplied functions."""

from __future__ import annotations

import hashlib
import random
import re
import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EmbedFn = Callable[[Sequence[str]], "np.ndarray | Sequence[Sequence[float]]"]
GenerateFn = Callable[[str], str]

# Tokens whose bucket a task remembers; beyond that the memory is emptied, the results stay the same.
REMEMBERED = 1 << 16
_TOKEN = re.compile(rb"[^ \t\r\n]+")


def _tokens(text: str) -> list[bytes]:
    """Runs without blanks, tabs and line ends. ``bytes.split`` also splits at two more characters."""
    raw = text.encode("utf-8")
    return _TOKEN.findall(raw) if b"\x0b" in raw or b"\x0c" in raw else raw.split()


def hash_embedder(dim: int = 64) -> EmbedFn:
    """Offline embedder: counts of tokens by MD5 bucket.

    The counts are whole numbers, so inner products are exact and do not depend on their order;
    cosine does not need unit length.
    """
    class Buckets(dict):
        def __missing__(self, token: bytes) -> int:
            if len(self) >= REMEMBERED:
                self.clear()
            found = self[token] = int.from_bytes(hashlib.md5(token).digest()[:4], "big") % dim
            return found

    bucket = Buckets().__getitem__

    def embed(texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for row, text in enumerate(texts):
            tokens = _tokens(text)
            if tokens:
                out[row] = np.bincount(np.fromiter(map(bucket, tokens), np.int64, len(tokens)), minlength=dim)
        return out

    return embed


def _lists(vectors: list[Sequence[float] | None]) -> pa.Array:
    return pa.array(vectors, pa.list_(pa.float32()))


def embed_column(text: str | Column, fn: EmbedFn, batch_rows: int = 256) -> Column:
    """Vectors of a text column; NULL texts and empty answers give NULL for the size check to reject."""
    @F.arrow_udf("array<float>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = []
            for start in range(0, len(batch), batch_rows):
                part = batch.slice(start, batch_rows).to_pylist()
                if None in part:
                    known = iter(fn([t for t in part if t is not None]))
                    got = [None if t is None else next(known) for t in part]
                else:
                    got = fn(part)
                if isinstance(got, np.ndarray) and got.ndim == 2 and got.shape[1]:
                    flat = pa.array(np.ascontiguousarray(got, dtype=np.float32).ravel())
                    offsets = pa.array(np.arange(len(got) + 1, dtype=np.int32) * got.shape[1])
                    parts.append(pa.ListArray.from_arrays(offsets, flat))
                else:
                    parts.append(_lists([None if v is None or not len(v) else list(map(float, v)) for v in got]))
            yield pa.concat_arrays(parts) if parts else _lists([])

    # Not repeatable for the optimizer, so that it never evaluates a model call twice.
    return run.asNondeterministic()(text)


def embed(
    df: DataFrame, fn: EmbedFn, *, text: str = "text", out: str = "vector",
    dedupe: bool = False, batch_rows: int = 256,
) -> DataFrame:
    """Add a vector column.

    ``dedupe`` calls the model once per distinct text. It pays for slow models and many copies; the
    cheap default calls it per row and moves no data. Copies are combined before the shuffle, and
    the join back has one row per text, so a text shared by many rows splits at run time.
    """
    if not dedupe:
        return df.withColumn(out, embed_column(F.col(text), fn, batch_rows))
    keyed = df.withColumn("_key", F.sha2(text, 256))
    distinct = keyed.where(F.col(text).isNotNull()).groupBy("_key").agg(F.any_value(text).alias("_t"))
    vectors = distinct.select("_key", embed_column(F.col("_t"), fn, batch_rows).alias(out))
    return keyed.join(vectors, "_key", "left").drop("_key")


def wait(attempt: int) -> None:
    """Back-off before attempt ``attempt + 1``: powers of two with jitter."""
    time.sleep(2 ** attempt + random.random())


def model_of(df: DataFrame, model: str, default: str) -> Column:
    """The model a row names, or the default where it names none."""
    named = F.trim(F.col(model)) if model in df.columns else F.lit("")
    return F.when(F.coalesce(named, F.lit("")) == "", default).otherwise(named)


def generate(
    df: DataFrame,
    fns: dict[str, GenerateFn],
    *,
    default: str,
    prompt: str = "prompt",
    model: str = "llm_name",
    max_attempts: int = 3,
    sleep: Callable[[int], None] = wait,
    max_parallel_calls: int | None = None,
    concurrency: int = 1,
) -> DataFrame:
    """Call the model named per row, or the default where blank.

    Adds ``model_used, raw_output, attempts, error``. A failing call or an unknown name fails its row
    only. ``max_parallel_calls`` bounds the tasks calling at once, ``concurrency`` the calls that a task
    has open at once. Stage the result, or use ``answers.resumable``: replays of its lineage would repeat
    the calls.
    """
    if default not in fns:
        raise ValueError(f"default model {default!r} is not among the functions")
    if concurrency < 1:
        raise ValueError("concurrency must be at least 1")

    def call(name: str, text: str | None):
        fn = fns.get(name)
        if fn is None:
            return None, 0, f"unknown model: {name}"
        if text is None:
            return None, 0, "no prompt"
        for attempt in range(max_attempts):
            try:
                return fn(text), attempt + 1, None
            except Exception as exc:
                error = f"{type(exc).__name__}: {exc}"
                if attempt + 1 < max_attempts:
                    sleep(attempt)
        return None, max_attempts, error

    @F.pandas_udf("raw_output string, attempts int, error string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(concurrency) as pool:
            for names, prompts in batches:
                # Answers keep the order of their rows; one call at a time stays in the task's own thread.
                rows = list(pool.map(call, names, prompts)) if concurrency > 1 else [call(n, p) for n, p in zip(names, prompts)]
                yield pd.DataFrame(rows, columns=["raw_output", "attempts", "error"])

    df = df.withColumn("model_used", model_of(df, model, default))
    if max_parallel_calls:
        df = df.repartition(max_parallel_calls)
    answered = df.withColumn("_answer", run.asNondeterministic()("model_used", prompt))
    return answered.select(*df.columns, "_answer.*")
