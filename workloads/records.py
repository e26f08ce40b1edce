"""Queries over scenarios, blacklists, job records and streams."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmatch.operators import collection as col
from docmatch.operators import ledger, models, scenario, screen, validate
from docmatch.sources.staging import new_path
from docmatch.streaming import operations
from docmatch.streaming.ingest import start_ingest
from docmatch.streaming.jobs import job_state
from workloads.registry import query, table
from workloads.trees import _CHUNKS, CHUNK_SIZE, flat_docs

# --- scenarios: one project per customer ---


def scenario_rows(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    segment = F.col("c_mktsegment")
    return c.select(
        F.col("c_name").alias("project_id"),
        F.when(segment == "BUILDING", "Forward").when(segment == "MACHINERY", "reverse")
        .when(segment == "FURNITURE", "BOTH").when(segment == "HOUSEHOLD", "sideways").alias("direction"),
        F.when(F.col("c_nationkey") != 3, F.col("c_nationkey") - 1).alias("rag_k"),
        F.when(F.col("c_acctbal") > 0, F.col("c_nationkey") - 5).alias("rag_k_forward"),
        F.when(F.col("c_acctbal") > 5000, F.lit(20)).alias("rag_k_reverse"),
        F.when(segment != "AUTOMOBILE", F.col("c_acctbal") / 10000).alias("cof_threshold"),
    )


_SCENARIOS = """
WITH s AS (SELECT c_name AS project_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'Forward' WHEN 'MACHINERY' THEN 'reverse'
    WHEN 'FURNITURE' THEN 'BOTH' WHEN 'HOUSEHOLD' THEN 'sideways' END AS direction,
  CASE WHEN c_nationkey <> 3 THEN c_nationkey - 1 END AS rag_k, CASE WHEN c_acctbal > 0 THEN c_nationkey - 5 END AS rag_k_forward,
  CASE WHEN c_acctbal > 5000 THEN 20 END AS rag_k_reverse,
  CASE WHEN c_mktsegment <> 'AUTOMOBILE' THEN c_acctbal / 10000 END AS cof_threshold FROM customer),
r AS (SELECT project_id, lower(coalesce(direction, 'forward')) AS direction, coalesce(rag_k, 5) AS rag_k, rag_k_forward, rag_k_reverse,
  coalesce(cof_threshold, 0.5) AS cof_threshold FROM s)
"""


@query("scenario_violations", _SCENARIOS + """
SELECT project_id, 'direction' AS field, 'not_in_set' AS code FROM s WHERE lower(direction) NOT IN ('forward', 'reverse', 'both')
UNION ALL SELECT project_id, 'rag_k', 'less_than_1' FROM s WHERE rag_k < 1
UNION ALL SELECT project_id, 'rag_k_forward', 'less_than_1' FROM s WHERE rag_k_forward < 1
UNION ALL SELECT project_id, 'rag_k_reverse', 'less_than_1' FROM s WHERE rag_k_reverse < 1
UNION ALL SELECT project_id, 'cof_threshold', 'not_in_0_1' FROM s WHERE NOT cof_threshold BETWEEN 0 AND 1""")
def scenario_violations(spark, sf_dir):
    return validate.scenario_violations(scenario_rows(spark, sf_dir))


@query("resolve_scenario", _SCENARIOS + """
SELECT project_id, direction, rag_k::INT AS rag_k, round(cof_threshold, 6) AS cof_threshold, 8000 AS max_prompt_tokens, 0 AS chunk_size
FROM r""")
def resolve_scenario(spark, sf_dir):
    return scenario.resolve(scenario_rows(spark, sf_dir)).select(
        "project_id", "direction", "rag_k", F.round("cof_threshold", 6).alias("cof_threshold"), "max_prompt_tokens", "chunk_size")


@query("resolve_k", _SCENARIOS + """
SELECT project_id, leg, greatest(1, coalesce(CASE leg WHEN 'forward' THEN rag_k_forward ELSE rag_k_reverse END, rag_k))::INT AS k
FROM r, (VALUES ('forward'), ('reverse')) l(leg) WHERE direction IN (leg, 'both')""")
def resolve_k(spark, sf_dir):
    rows = scenario.resolve(scenario_rows(spark, sf_dir))
    legs = F.when(F.col("direction") == "both", F.array(F.lit("forward"), F.lit("reverse"))).when(
        F.col("direction").isin("forward", "reverse"), F.array("direction"))
    return rows.withColumn("leg", F.explode(legs)).select("project_id", "leg", scenario.effective_k(F.col("leg")).alias("k"))


# --- blacklist: every benchmark passage, listed twice ---


def blacklist(spark, sf_dir) -> DataFrame:
    passages = table(spark, sf_dir, "benchmark")
    twice = F.explode(F.array(F.col("item_id"), F.col("item_id") + 1_000_000_000))
    return passages.select(twice.alias("idx"), F.col("text").alias("entry"))


_FOUND = """
WITH bl AS (SELECT item_id AS idx, text AS entry FROM benchmark UNION ALL SELECT item_id + 1000000000, text FROM benchmark),
found AS (SELECT 'input-' || doc_id AS uid, idx, entry FROM documents, bl WHERE contains(text, entry))
"""


@query("blacklist_hits", _FOUND + "SELECT uid, idx, entry FROM found")
def blacklist_hits(spark, sf_dir):
    return screen.hits(flat_docs(spark, sf_dir), blacklist(spark, sf_dir)).select("uid", "idx", "entry")


@query("blacklist_by_grams", _FOUND + "SELECT uid, idx, entry FROM found")
def blacklist_by_grams(spark, sf_dir):
    found = screen.hits(flat_docs(spark, sf_dir), blacklist(spark, sf_dir), strategy="grams")
    return found.select("uid", "idx", "entry")


@query("blacklist_short", """
WITH b AS (SELECT item_id * 4 + n AS idx, substr(text, (n * 20 + 1)::INT, 12) AS entry FROM benchmark, (SELECT unnest(range(4)) AS n))
SELECT 'input-' || doc_id AS uid, idx::INT AS idx, entry FROM documents, b WHERE contains(text, entry)""")
def blacklist_short(spark, sf_dir):
    """Entries of a few bytes, without a window of their own."""
    places = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("n")
    entries = table(spark, sf_dir, "benchmark").select("item_id", "text", places).select(
        (F.col("item_id") * 4 + F.col("n")).cast("int").alias("idx"),
        F.substring("text", F.col("n") * 20 + 1, F.lit(12)).alias("entry"))
    found = screen.hits(flat_docs(spark, sf_dir), entries, strategy="grams")
    return found.select("uid", "idx", "entry")


@query("blacklist_by_doc", _FOUND + "SELECT uid, count(*)::INT AS n, string_agg(entry, '|' ORDER BY idx) AS entries FROM found GROUP BY uid")
def blacklist_by_doc(spark, sf_dir):
    found = screen.hits(flat_docs(spark, sf_dir), blacklist(spark, sf_dir))
    by = screen.hits_by_text(found)
    return by.select("uid", F.size("entries").alias("n"), F.array_join("entries", "|").alias("entries"))


# --- job records from events ---

AS_OF = datetime(2024, 1, 31)
TTL = 29.75 * 86400
TIMEOUT = 29.9 * 86400


def job_ledger(spark, sf_dir) -> DataFrame:
    kind = F.col("event_type")
    status = (F.when(kind == "signup", "pending").when(kind.isin("view", "click"), "running")
              .when(kind == "purchase", "completed").otherwise("failed"))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("job_id"), F.concat(F.lit("proj-"), F.substring(F.reverse(F.col("user_id").cast("string")), 1, 1)).alias("project_id"),
        status.alias("status"), F.col("value").alias("progress"),
        F.when(kind == "error", F.col("props")).alias("error"), "ts", "event_id",
    )


_JOBS = f"""
WITH l AS (SELECT user_id AS job_id, 'proj-' || right(user_id::VARCHAR, 1) AS project_id, CASE event_type WHEN 'signup' THEN 'pending'
    WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END AS status, value AS progress,
    CASE WHEN event_type = 'error' THEN props END AS error, ts, event_id FROM events),
jobs AS (SELECT job_id, arg_max(project_id, (ts, event_id)) AS project_id, arg_max(status, (ts, event_id)) AS status,
    arg_max(progress, (ts, event_id)) AS progress, min(ts) AS created_at, max(ts) AS updated_at,
    max(ts) FILTER (status = 'completed') AS completed_at, max(ts) FILTER (status = 'failed') AS failed_at FROM l GROUP BY job_id),
late AS (SELECT *, status = 'pending' AND created_at < TIMESTAMP '{AS_OF}' - INTERVAL {int(TIMEOUT)} SECOND AS late FROM jobs)
"""


def jobs(spark, sf_dir) -> DataFrame:
    return ledger.latest(job_ledger(spark, sf_dir), ("ts", "event_id"))


@query("jobs_latest", _JOBS + "SELECT job_id, project_id, status, progress, created_at, updated_at FROM jobs")
def jobs_latest(spark, sf_dir):
    return jobs(spark, sf_dir).select("job_id", "project_id", "status", "progress", "created_at", "updated_at")


@query("job_transitions", _JOBS + "SELECT job_id, status, completed_at, failed_at FROM jobs")
def job_transitions(spark, sf_dir):
    return jobs(spark, sf_dir).select("job_id", "status", "completed_at", "failed_at")


@query("jobs_by_project", _JOBS + "SELECT job_id, status FROM jobs WHERE project_id = 'proj-3'")
def jobs_by_project(spark, sf_dir):
    return ledger.by_project(jobs(spark, sf_dir), "proj-3").select("job_id", "status")


@query("jobs_unexpired", _JOBS + f"""
SELECT job_id, created_at FROM jobs WHERE NOT (created_at < TIMESTAMP '{AS_OF}' - INTERVAL {int(TTL)} SECOND)""")
def jobs_unexpired(spark, sf_dir):
    return ledger.unexpired(jobs(spark, sf_dir), AS_OF, TTL).select("job_id", "created_at")


@query("jobs_timeout", _JOBS + f"""
SELECT job_id, CASE WHEN late THEN 'failed' ELSE status END AS status,
       CASE WHEN late THEN TIMESTAMP '{AS_OF}' ELSE failed_at END AS failed_at FROM late""")
def jobs_timeout(spark, sf_dir):
    return ledger.apply_timeout(jobs(spark, sf_dir), AS_OF, TIMEOUT).select("job_id", "status", "failed_at")


@query("jobs_purge", _JOBS + "SELECT job_id, status NOT IN ('completed', 'failed') AS kept FROM jobs")
def jobs_purge(spark, sf_dir):
    kept, purged = ledger.purge(jobs(spark, sf_dir))
    return kept.select("job_id", F.lit(True).alias("kept")).unionByName(purged.select("job_id", F.lit(False).alias("kept")))


# --- streams ---


@query("stream_ingest", _CHUNKS + "SELECT 'input-' || doc_id || '_c' || i AS uid, text FROM chunks")
def stream_ingest(spark, sf_dir):
    """Trees written to files, streamed in, must leave the same points as a batch over them."""
    node = F.struct(F.col("doc_id").cast("string").alias("sid"), F.col("text").alias("text"))
    trees = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("p-"), "lang").alias("project_id"), F.col("doc_id").cast("string").alias("doc_id"),
        F.lit("input").alias("side"), F.to_json(F.struct(F.array(node).alias("level1"))).alias("raw"))
    source, path = new_path(spark, "stream-source"), new_path(spark, "collection")
    trees.write.parquet(source)
    stream = spark.readStream.schema(trees.schema).option("maxFilesPerTrigger", 4).parquet(source)
    start_ingest(
        stream, path, models.hash_embedder(64), dim=64, depth=1, chunk_size=CHUNK_SIZE,
        checkpoint=new_path(spark, "stream-checkpoint"),
    ).awaitTermination()
    return col.current(col.read_log(spark, path)).select("uid", "text")


@query("stream_operations", """
WITH w AS (SELECT event_id AS seq, 'input-' || user_id AS uid, json_extract_string(props, '$.k') AS orig_sid, event_type, value FROM events),
last AS (SELECT uid, arg_max(orig_sid, seq) AS orig_sid, arg_max(event_type, seq) AS event_type, max(seq) AS seq FROM w WHERE event_type <> 'error' GROUP BY uid)
SELECT uid, orig_sid, event_type AS text, seq FROM last l WHERE NOT EXISTS (
  SELECT 1 FROM w WHERE event_type = 'error' AND w.orig_sid = l.orig_sid AND w.seq > l.seq)""")
def stream_operations(spark, sf_dir):
    """Events as a stream of changes and deletions, in files that hold them in no order, one batch replayed."""
    events = table(spark, sf_dir, "events")
    removal = F.col("event_type") == "error"
    ops = events.select(
        F.col("event_id").alias("seq"), F.when(removal, "delete").otherwise("update").alias("op"), F.lit("p").alias("project_id"),
        F.lit("input").alias("side"), F.lit(None).cast("string").alias("doc_id"), F.lit(None).cast("string").alias("raw"),
        F.get_json_object("props", "$.k").alias("orig_sid"), F.concat(F.lit("input-"), "user_id").alias("uid"), F.col("event_type").alias("text"))
    source, path, aside = (new_path(spark, n) for n in ("stream-source", "collection", "quarantine"))
    ops.repartition(4, F.xxhash64("seq")).write.parquet(source)
    stream = spark.readStream.schema(operations.SCHEMA).option("maxFilesPerTrigger", 2).parquet(source)
    embed = models.hash_embedder(8)
    options = {"dim": 8, "depth": 1, "chunk_size": 0, "quarantine": aside}
    operations.start_operations(stream, path, embed, checkpoint=new_path(spark, "stream-checkpoint"), **options).awaitTermination()
    operations.apply_batch(ops.where(F.col("seq") % 3 == 0), 0, path, embed, **options)
    return col.current(col.read_log(spark, path)).select("uid", "orig_sid", "text", "seq")


@query("stream_job_state", """
WITH l AS (SELECT user_id::VARCHAR AS job_id, 'proj-' || right(user_id::VARCHAR, 1) AS project_id, ts,
    CASE event_type WHEN 'signup' THEN 'pending' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END AS status
  FROM events),
j AS (SELECT job_id, any_value(project_id) AS project_id, arg_max(status, ts) AS status, min(ts) AS created_at, max(ts) AS updated_at
  FROM l GROUP BY job_id),
w AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM l)
SELECT *, false AS timed_out FROM j
UNION ALL SELECT job_id, project_id, 'failed', created_at, updated_at, true FROM j, w
WHERE status = 'pending' AND created_at + INTERVAL 1 HOUR < mark""")
def stream_job_state(spark, sf_dir):
    """Status changes per job as the event stream produces them, with pending timeouts."""
    source, out = new_path(spark, "stream-source"), new_path(spark, "job-state")
    job_ledger(spark, sf_dir).select(F.col("job_id").cast("string"), "project_id", "status", "ts").write.parquet(source)
    schema = "job_id string, project_id string, status string, ts timestamp_ntz"
    states = job_state(spark.readStream.schema(schema).parquet(source), watermark="1 hour", timeout_seconds=3600)
    (states.writeStream.outputMode("append").format("parquet").option("path", out)
     .option("checkpointLocation", new_path(spark, "stream-checkpoint")).trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(states.schema).parquet(out).withColumns(
        {c: F.col(c).cast("timestamp_ntz") for c in ("created_at", "updated_at")})


@query("stream_job_batches", """
WITH l AS (SELECT user_id::VARCHAR AS job_id, 'proj-' || right(user_id::VARCHAR, 1) AS project_id, ts,
    CASE event_type WHEN 'signup' THEN 'pending' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END AS status
  FROM events)
SELECT job_id, any_value(project_id) AS project_id, arg_max(status, ts) AS status, min(ts) AS created_at, max(ts) AS updated_at
FROM l GROUP BY job_id""")
def stream_job_batches(spark, sf_dir):
    """Events in several micro-batches in order of time: jobs outlive the timer and keep their first time."""
    source, out, batches = new_path(spark, "stream-source"), new_path(spark, "job-state"), 5
    events = job_ledger(spark, sf_dir).select(F.col("job_id").cast("string"), "project_id", "status", "ts")
    cuts = events.agg(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), [i / batches for i in range(1, batches)])).head()[0]
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.unix_micros(F.col("ts").cast("timestamp"))))
    for i in range(batches):
        events.where(part == i).write.mode("append").parquet(source)
    schema = "job_id string, project_id string, status string, ts timestamp_ntz"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(source)
    states = job_state(stream, watermark="60 days", timeout_seconds=3600, ttl_seconds=10 * 365 * 86_400)
    (states.writeStream.outputMode("append").format("parquet").option("path", out)
     .option("checkpointLocation", new_path(spark, "stream-checkpoint")).trigger(availableNow=True).start().awaitTermination())
    told = spark.read.schema(states.schema).parquet(out).where("not timed_out")
    last = told.groupBy("job_id", "project_id").agg(
        F.max_by("status", "updated_at").alias("status"), F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"))
    return last.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("created_at", "updated_at")})
