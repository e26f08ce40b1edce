"""Keyed point collections on an append-only Parquet log.

The log holds ``upsert`` and ``delete`` rows with a sequence number per batch and an order within the
batch, in folders by a hash bucket of the project, kind and side, so that any number of projects makes a
bounded number of folders; within a file, rows are sorted by project and statistics prune them. Appending
never rewrites data, readers resolve the latest state, and replaying a batch changes nothing because equal
rows resolve to the same state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from docmatch.functions.ids import uuid5
from docmatch.operators.metrics import log_metrics
from docmatch.operators.models import EmbedFn, embed
from docmatch.operators.payload import MARKS, marks, payload_filter
from docmatch.sources.staging import stage

LOG_PARTITIONS = ["bucket", "op", "side"]
BUCKETS = 64

ORD = T.StructType([T.StructField("doc", T.StringType()), T.StructField("pos", T.ArrayType(T.IntegerType()))])

LOG_SCHEMA = T.StructType([
    T.StructField("seq", T.LongType()),
    T.StructField("ord", ORD),
    T.StructField("point_id", T.StringType()),
    *[T.StructField(c, T.StringType()) for c in ("uid", "sid", "orig_sid", "group_uid", "text")],
    T.StructField("vector", T.ArrayType(T.FloatType())),
    T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
    *[T.StructField(c, T.StringType()) for c in ("project_id", "op", "side")],
])
STORED_SCHEMA = T.StructType([*LOG_SCHEMA.fields, T.StructField("marks", MARKS), T.StructField("bucket", T.IntegerType())])
VERSION = ["project_id", "point_id", "seq", "ord"]


def bucket(project_id: Column) -> Column:
    """The folder of a project."""
    return F.pmod(F.xxhash64(project_id), F.lit(BUCKETS)).cast("int")


RUN_MARK = "\x1f"


def of_run(project_id: Column, run_id: str | None) -> Column:
    """A project's name within a run. It takes the place of the project in folders, scopes and pruning, so two
    runs of one project share a collection and never meet."""
    return project_id if run_id is None else F.concat(project_id, F.lit(RUN_MARK + run_id))


def without_run(df: DataFrame) -> DataFrame:
    """Split ``project_id`` into the project's own name and ``run_id``, null where there is none."""
    parts = F.split("project_id", RUN_MARK, 2)
    return df.withColumns({"run_id": F.get(parts, 1), "project_id": F.get(parts, 0)})


def with_defaults(rows: DataFrame, mode: str | None = None) -> DataFrame:
    """Fill what ingestion fills: side, ``orig_sid``, ``group_uid`` and ``sid``.

    ``mode`` sets the side; anything but ``"reference"`` means ``"input"``. Without it the rows'
    own ``side`` is used the same way.
    """
    given = F.lit(mode) if mode is not None else F.col("side")
    side = F.when(given == "reference", "reference").otherwise("input")
    have = set(rows.columns)

    def col(name: str, kind: str = "string") -> Column:
        return F.col(name) if name in have else F.lit(None).cast(kind)

    return rows.withColumns({
        "side": side,
        "orig_sid": F.coalesce(col("orig_sid"), F.lit("undefined")),
        "group_uid": F.coalesce(col("group_uid"), F.concat(side, F.lit("-group_???"))),
        "sid": F.coalesce(col("sid"), col("uid")),
        "extra": col("extra", "map<string,string>"),
    })


def prepare_points(rows: DataFrame, mode: str | None = None) -> DataFrame:
    """Text rows to point rows without vectors: defaults, point id and batch order."""
    rows = with_defaults(rows, mode).withColumn("point_id", uuid5(F.col("uid")))
    doc = F.col("doc_id") if "doc_id" in rows.columns else F.lit("")
    pos = F.col("pos") if "pos" in rows.columns else F.array().cast("array<int>")
    if "chunk_no" in rows.columns:
        pos = F.array_append(pos, F.col("chunk_no"))
    return rows.withColumn("ord", F.struct(doc.alias("doc"), pos.alias("pos")).cast(ORD))


def upserts(points: DataFrame, seq: int | Column) -> DataFrame:
    """Point rows as log rows."""
    seq = F.lit(seq) if isinstance(seq, int) else seq
    return points.withColumns({"seq": seq.cast("long"), "op": F.lit("upsert")}).select(*LOG_SCHEMA.names)


def deletes(ids: DataFrame, seq: int | Column) -> DataFrame:
    """``(project_id, orig_sid)`` rows as log rows that remove every point of those documents."""
    seq = F.lit(seq) if isinstance(seq, int) else seq
    given = {"project_id": F.col("project_id"), "orig_sid": F.col("orig_sid"),
             "seq": seq.cast("long"), "op": F.lit("delete")}
    return ids.select(*[
        given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in LOG_SCHEMA.fields
    ])


def updates(rows: DataFrame, fn: EmbedFn, seq: int | Column) -> DataFrame:
    """Replace points whole: the new text is embedded and nothing of the old payload is kept."""
    points = prepare_points(rows)
    return upserts(embed(points, fn), seq)


def append_log(log_rows: DataFrame, path: str, few_files: bool = False, observation: Observation | None = None) -> None:
    """Append log rows in place, each task writing its own share without a shuffle.

    An ``observation`` counts what is written, see ``metrics.log_metrics``, in the same pass.

    With ``few_files`` rows are rebalanced by folder first: for inputs whose projects are mixed, where
    every task would otherwise write a file into every folder. A large project still splits by size.
    """
    if observation is not None:
        log_rows = log_rows.observe(observation, *log_metrics())
    log_rows = log_rows.withColumns({"marks": marks(F.col("extra")), "bucket": bucket(F.col("project_id"))})
    if few_files:
        log_rows = log_rows.hint("rebalance", *LOG_PARTITIONS)
    log_rows = log_rows.sortWithinPartitions(*LOG_PARTITIONS, "project_id")
    log_rows.write.mode("append").partitionBy(*LOG_PARTITIONS).parquet(path)


def ensure_collection(spark: SparkSession, path: str) -> None:
    """Create an empty log unless one exists; an existing log is left alone."""
    try:
        spark.read.schema(STORED_SCHEMA).parquet(path)
    except AnalysisException:
        spark.createDataFrame([], STORED_SCHEMA).write.mode("ignore").parquet(path)


def read_log(
    spark: SparkSession, path: str, project_id: str | list[str] | None = None, side: str | None = None
) -> DataFrame:
    """The log, limited by folder to projects and a side; a missing collection reads as empty.

    Deletions apply to both sides and are always read.
    """
    try:
        log = spark.read.schema(STORED_SCHEMA).parquet(path)
    except AnalysisException:
        log = spark.createDataFrame([], STORED_SCHEMA)
    if project_id is not None:
        names = [project_id] if isinstance(project_id, str) else project_id
        log = log.where(F.col("bucket").isin(*[bucket(F.lit(n)) for n in names]) & F.col("project_id").isin(*names))
    if side is not None:
        log = log.where((F.col("side") == side) | (F.col("op") == "delete"))
    return log.drop("bucket")


def _latest_versions(log: DataFrame) -> DataFrame:
    """The last version of each point, highest batch, then last row of the batch, in narrow rows.

    The row limit per point is applied before the shuffle as well, so a point rewritten very often
    sends one row per task.
    """
    w = Window.partitionBy("project_id", "point_id").orderBy(F.desc("seq"), F.desc("ord"))
    narrow = log.where(F.col("op") == "upsert").select(*VERSION, "orig_sid")
    return narrow.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def live_versions(log: DataFrame) -> DataFrame:
    """The versions of live points. A deletion removes the points whose latest version belongs to its
    document and is older; taking the latest version first keeps older versions from coming back.
    """
    removed = log.where(F.col("op") == "delete").groupBy(
        F.col("project_id"), F.col("orig_sid")
    ).agg(F.max("seq").alias("_removed"))
    live = _latest_versions(log).join(removed, ["project_id", "orig_sid"], "left")
    return live.where(F.col("_removed").isNull() | (F.col("_removed") <= F.col("seq"))).select(*VERSION)


def rows_of(log: DataFrame, versions: DataFrame) -> DataFrame:
    """The log's rows of some versions: the one join that texts and vectors take part in. Batches that
    were replayed hold a version more than once; one row of each is kept.
    """
    rows = log.where(F.col("op") == "upsert").join(versions.select(*VERSION), VERSION, "left_semi")
    return rows.dropDuplicates(VERSION)


def latest(log: DataFrame) -> DataFrame:
    """The last version of each point."""
    return rows_of(log, _latest_versions(log))


def current(log: DataFrame, filters: dict[str, object] | None = None) -> DataFrame:
    """Live points, those whose payload passes the filters. Versions are resolved on all rows first, so that
    an older version never passes for a newer one; the scan of the wide rows leaves out what cannot pass.
    """
    wide = log.where(payload_filter(log, filters)) if filters else log
    return rows_of(wide, live_versions(log)).drop("op", "marks")


def stored_current(log: DataFrame) -> DataFrame:
    """Live points of a stored log, for several reads. Where one narrow aggregate proves that nothing was
    written twice or removed, the log's rows are the points; else the versions are resolved once and stored.
    """
    upserted = log.where(F.col("op") == "upsert")
    narrow = log.where(F.col("op").isin("upsert", "delete")).groupBy("project_id", "point_id", "op").count()
    twice = narrow.agg(F.max(F.when(F.col("op") == "delete", 2).otherwise(F.col("count")))).head()[0]
    points = upserted if (twice or 1) == 1 else rows_of(log, stage(live_versions(log), "versions"))
    return points.drop("op")


def lookup(points: DataFrame, ids: DataFrame, column: str = "uid") -> DataFrame:
    """Points by id with the fixed score 1.0."""
    wanted = ids.select(uuid5(F.col(column)).alias("point_id")).distinct()
    return points.join(wanted, "point_id").withColumn("score", F.lit(1.0))


def counts(points: DataFrame) -> DataFrame:
    """Points and documents per project and side."""
    return points.groupBy("project_id", "side").agg(
        F.count(F.lit(1)).alias("points"), F.count_distinct("group_uid").alias("documents")
    )


def embedded(rows: DataFrame, fn: EmbedFn, seq: int | Column, *, dim: int, dedupe: bool = False) -> DataFrame:
    """Text rows as log rows with their vectors.

    Rows without a uid or text, or with a vector of the wrong size, become ``reject`` rows: they are
    kept for inspection and never searched.
    """
    points = embed(prepare_points(rows), fn, dedupe=dedupe)
    good = F.col("uid").isNotNull() & F.col("text").isNotNull() & (F.coalesce(F.size("vector"), F.lit(0)) == dim)
    seq = F.lit(seq) if isinstance(seq, int) else seq
    log = points.withColumns({"seq": seq.cast("long"), "op": F.when(good, "upsert").otherwise("reject")})
    return log.select(*LOG_SCHEMA.names)


def ingest(
    rows: DataFrame, path: str, fn: EmbedFn, seq: int, *, dim: int, dedupe: bool = False, few_files: bool = False,
    observation: Observation | None = None,
) -> None:
    """Embed text rows and append them in one pass. See ``embedded`` and ``append_log``."""
    append_log(embedded(rows, fn, seq, dim=dim, dedupe=dedupe), path, few_files, observation)


def rejects(log: DataFrame) -> DataFrame:
    """Rejected rows with their reason."""
    reason = F.when(F.col("uid").isNull(), "missing_uid").when(F.col("text").isNull(), "missing_text")
    size = F.coalesce(F.size("vector"), F.lit(0))
    reason = F.coalesce(reason, F.when(size <= 0, "empty_vector"), F.lit("wrong_size"))
    return log.where(F.col("op") == "reject").withColumn("reason", reason)


def compact(spark: SparkSession, path: str, new_path: str) -> None:
    """Write the live points as a new log; the one being read is not touched."""
    log = current(read_log(spark, path)).withColumn("op", F.lit("upsert")).select(*LOG_SCHEMA.names)
    append_log(log, new_path)
