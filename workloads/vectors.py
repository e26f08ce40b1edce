"""Queries over vectors and point collections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmatch.functions import vectors as vec
from docmatch.operators import collection as col
from docmatch.operators import clusters, models, scenario, search
from docmatch.sources.staging import new_path, stage
from workloads.registry import query, table
from workloads.trees import flat_docs, uuid5_sql

K = 5


def points(spark, sf_dir) -> DataFrame:
    """Every embedding as a point on both sides, with the text of the document of the same number."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    e = table(spark, sf_dir, "embeddings").join(docs, F.col("vec_id") == F.col("doc_id"), "left")
    return e.select(
        F.concat(F.lit("proj-"), "label").alias("project_id"),
        F.explode(F.array(F.lit("input"), F.lit("reference"))).alias("side"),
        "vec_id", "label", "text", F.col("embedding").alias("vector"), "lang",
        F.when(F.col("source").isNotNull(), F.create_map(F.lit("source"), "source")).alias("extra"),
    ).withColumn("uid", F.concat_ws("-", "side", "vec_id"))


def query_points(spark, sf_dir) -> DataFrame:
    p = points(spark, sf_dir).where(F.col("side") == "input")
    return p.select("project_id", F.col("uid").alias("query_uid"), "vector", "label", "vec_id", F.col("text").alias("query_text"))


def _knn_sql(where: str = "true", on: str = "true", k: str = str(K)) -> str:
    return f"""
q AS (SELECT 'input-' || vec_id AS query_uid, vec_id AS query_id, label, embedding::DOUBLE[] AS v,
             sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
p AS (SELECT 'reference-' || vec_id AS uid, vec_id, label, embedding::DOUBLE[] AS v, lang, source, coalesce(text, '') AS text,
             sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n
      FROM embeddings LEFT JOIN documents ON vec_id = doc_id WHERE {where}),
pairs AS (SELECT query_uid, query_id, q.label AS label, uid, text,
                 CASE WHEN q.n * p.n > 0 THEN list_dot_product(q.v, p.v) / (q.n * p.n) ELSE 0 END AS score FROM q, p WHERE {on}),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_uid ORDER BY score DESC, uid)::INT AS rank FROM pairs)
         WHERE rank <= {k})"""


HITS = "SELECT query_uid, uid, round(score, 6) AS score, rank FROM hits"


def _shown(hits: DataFrame) -> DataFrame:
    return hits.select("query_uid", "uid", F.round("score", 6).alias("score"), "rank")


def reference_points(spark, sf_dir) -> DataFrame:
    return points(spark, sf_dir).where(F.col("side") == "reference")


@query("knn_topk", f"WITH {_knn_sql()} {HITS}")
def knn_topk(spark, sf_dir):
    return _shown(search.knn(query_points(spark, sf_dir), reference_points(spark, sf_dir), K))


@query("knn_topk_filtered", f"WITH {_knn_sql(where="lang = 'en'")} {HITS}")
def knn_topk_filtered(spark, sf_dir):
    return _shown(search.knn(
        query_points(spark, sf_dir), points(spark, sf_dir), K, filters={"side": "reference", "lang": "en"}))


@query("knn_queries_side", f"WITH {_knn_sql()} {HITS}")
def knn_queries_side(spark, sf_dir):
    return _shown(search.knn(query_points(spark, sf_dir), reference_points(spark, sf_dir), K, strategy="queries"))


@query("knn_blocked", f"WITH {_knn_sql()} {HITS}")
def knn_blocked(spark, sf_dir):
    return _shown(search.knn(
        query_points(spark, sf_dir), reference_points(spark, sf_dir), K, strategy="grid", block_bytes=1 << 16))


@query("knn_by_project", f"WITH {_knn_sql(on='q.label = p.label')} {HITS}")
def knn_by_project(spark, sf_dir):
    return _shown(search.knn(
        query_points(spark, sf_dir), reference_points(spark, sf_dir), K, scope=["project_id"], strategy="grid"))


@query("knn_per_query_k", f"WITH {_knn_sql(k='greatest(1, label)')} {HITS}")
def knn_per_query_k(spark, sf_dir):
    return _shown(search.knn(
        query_points(spark, sf_dir), reference_points(spark, sf_dir), 9, k_column="label"))


@query("knn_lsh", f"""SELECT 'input-' || vec_id AS query_uid, {K} AS hits, true AS exact_scores, true AS recall_holds FROM embeddings""")
def knn_lsh(spark, sf_dir):
    """What is certain of approximate lists: their length, exact scores, and a bound of the recall."""
    queries, refs = query_points(spark, sf_dir), reference_points(spark, sf_dir)
    found = stage(search.knn(queries, refs, K, strategy="lsh"), "lsh-found")
    return _certain(found, search.knn(queries, refs, K), queries, refs)


def _certain(found: DataFrame, best: DataFrame, queries: DataFrame, refs: DataFrame) -> DataFrame:
    shared = found.join(best.select("query_uid", "uid"), ["query_uid", "uid"]).count()
    holds = shared >= 0.9 * found.count()
    vectors = queries.select("query_uid", F.col("vector").alias("qv")), refs.select("uid", F.col("vector").alias("pv"))
    scored = found.join(vectors[0], "query_uid").join(vectors[1], "uid")
    exact = F.abs(F.col("score") - vec.cosine(F.col("qv"), F.col("pv"))) < 1e-6
    return scored.groupBy("query_uid").agg(F.count(F.lit(1)).cast("int").alias("hits"), F.every(exact).alias("exact_scores")).withColumn(
        "recall_holds", F.lit(holds))


def _stored_points(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Queries, and points as search needs them: keys and vectors."""
    return query_points(spark, sf_dir).select("query_uid", "vector"), reference_points(spark, sf_dir).select("uid", "vector")


@query("knn_pruned", f"WITH {_knn_sql()} {HITS}")
def knn_pruned(spark, sf_dir):
    """Exact lists from clustered points, clusters that cannot hold a hit left out."""
    queries, refs = _stored_points(spark, sf_dir)
    return _shown(clusters.knn_clustered(queries, clusters.cluster_points(refs), K))


@query("knn_probed", f"""SELECT 'input-' || vec_id AS query_uid, {K} AS hits, true AS exact_scores, true AS recall_holds FROM embeddings""")
def knn_probed(spark, sf_dir):
    """Approximate lists from three quarters of the clusters: length, exact scores, and a bound of the recall."""
    queries, refs = _stored_points(spark, sf_dir)
    points = clusters.cluster_points(refs)
    found = stage(clusters.knn_clustered(queries, points, K, probes=points.clusters.count() * 3 // 4), "probed-hits")
    return _certain(found, search.knn(queries, refs, K), queries, refs)


@query("cosine_pairs", """
SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_pairs(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(vec.cosine(F.col("embedding"), F.col("other")), 6).alias("score"))


@query("filter_payload", """
SELECT 'reference-' || vec_id AS uid FROM embeddings JOIN documents ON vec_id = doc_id WHERE lang = 'fr' AND source = 'src8'""")
def filter_payload(spark, sf_dir):
    p = points(spark, sf_dir)
    wanted = {"side": "reference", "lang": "fr", "source": "src8"}
    return p.where(search.payload_filter(p, wanted)).select("uid")


@query("filter_side", """
SELECT d.direction, s.side || '-' || vec_id AS uid FROM embeddings, (VALUES ('forward'), ('reverse'), ('both')) d(direction),
(VALUES ('input'), ('reference')) s(side) WHERE s.side = CASE WHEN d.direction = 'reverse' THEN 'input' ELSE 'reference' END""")
def filter_side(spark, sf_dir):
    directions = F.explode(F.array(*map(F.lit, scenario.DIRECTIONS))).alias("direction")
    p = points(spark, sf_dir).select("uid", "side", directions)
    return p.where(F.col("side") == scenario.searched_side(F.col("direction"))).select("direction", "uid")


@query("queries_without_hits", """
WITH p AS (SELECT label FROM embeddings JOIN documents ON vec_id = doc_id WHERE lang = 'de' AND source = 'src3')
SELECT 'input-' || vec_id AS query_uid FROM embeddings WHERE label NOT IN (SELECT label FROM p)""")
def queries_without_hits(spark, sf_dir):
    queries = query_points(spark, sf_dir)
    hits = search.knn(
        queries, points(spark, sf_dir), K, scope=["project_id"],
        filters={"side": "reference", "lang": "de", "source": "src3"})
    return search.without_hits(queries, hits, ["project_id", "query_uid"]).select("query_uid")


@query("embed_hash", """
SELECT doc_id, b::INT AS bucket, count(*)::DOUBLE AS n FROM (
  SELECT doc_id, ('0x' || substr(md5(t), 1, 8))::BIGINT % 64 AS b FROM (
    SELECT doc_id, unnest(regexp_split_to_array(text, '[ \\t\\r\\n]+')) AS t FROM documents) WHERE t <> '')
GROUP BY ALL""")
def embed_hash(spark, sf_dir):
    docs = models.embed(table(spark, sf_dir, "documents"), models.hash_embedder(64), dedupe=True)
    long = docs.select("doc_id", F.posexplode("vector").alias("bucket", "n"))
    return long.where("n > 0").select("doc_id", "bucket", F.col("n").cast("double").alias("n"))


# --- collections ---


def _project_rows(spark, sf_dir) -> DataFrame:
    """Documents of each language as a project."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("p-"), "lang").alias("project_id"))
    doc = docs.select(F.concat(F.lit("input-"), "doc_id").alias("uid"), "project_id")
    return flat_docs(spark, sf_dir).join(doc, "uid")


def _collection(spark, sf_dir) -> str:
    path = new_path(spark, "collection")
    col.ingest(_project_rows(spark, sf_dir), path, models.hash_embedder(64), 0, dim=64)
    return path


_TOKENS = "len(list_filter(regexp_split_to_array(text, '[ \\t\\r\\n]+'), lambda t: t <> ''))"


@query("ingest_collection", f"""
SELECT 'p-' || lang AS project_id, uid, {uuid5_sql('uid')} AS point_id, text, {_TOKENS}::DOUBLE AS tokens
FROM (SELECT *, 'input-' || doc_id AS uid FROM documents)""")
def ingest_collection(spark, sf_dir):
    live = col.current(col.read_log(spark, _collection(spark, sf_dir)))
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return live.select("project_id", "uid", "point_id", "text", total.alias("tokens"))


@query("collection_isolation", "SELECT 'input-' || doc_id AS uid FROM documents WHERE lang = 'fr'")
def collection_isolation(spark, sf_dir):
    return col.current(col.read_log(spark, _collection(spark, sf_dir), "p-fr", "input")).select("uid")


_PAYLOAD = [("source", "src8"), ("length", 416), ("english", True), ("missing", 1)]


@query("filter_payload_keys", """
SELECT filter, uid FROM (
  SELECT unnest(['source', 'length', 'english', 'both']) AS filter, 'input-' || doc_id AS uid,
         unnest([source = 'src8', n_chars = 416, lang = 'en', source = 'src8' AND lang = 'en']) AS passes FROM documents)
WHERE passes""")
def filter_payload_keys(spark, sf_dir):
    """Texts, numbers, truth values and a missing key, none of them a column of the stored log."""
    docs = table(spark, sf_dir, "documents").select(
        F.lit("p").alias("project_id"), F.concat(F.lit("input-"), "doc_id").alias("uid"), "text", F.lit("input").alias("side"),
        F.array(F.lit(1.0).cast("float")).alias("vector"),
        F.create_map(F.lit("source"), "source", F.lit("length"), F.col("n_chars").cast("string"),
                     F.lit("english"), (F.col("lang") == "en").cast("string")).alias("extra"))
    path = new_path(spark, "collection")
    col.append_log(col.upserts(col.prepare_points(docs), 0), path)
    log = col.read_log(spark, path)
    wanted = [(key, {key: value}) for key, value in _PAYLOAD] + [("both", {"source": "src8", "english": True})]
    found = [col.current(log, filters).select(F.lit(name).alias("filter"), "uid") for name, filters in wanted]
    return reduce(DataFrame.unionByName, found)


@query("collection_runs", """
SELECT 'first' AS run_id, 'input-' || doc_id AS uid, length(text)::INT AS chars FROM documents WHERE doc_id % 2 = 0
UNION ALL SELECT 'second', 'input-' || doc_id, length('again ' || text)::INT FROM documents""")
def collection_runs(spark, sf_dir):
    """Two runs of one project write the same points into one collection; each reads back its own."""
    docs = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("input-"), "doc_id").alias("uid"), "doc_id", "text", F.lit("input").alias("side"), F.array(F.lit(1.0).cast("float")).alias("vector"))
    path = new_path(spark, "collection")
    again = docs.withColumn("text", F.concat(F.lit("again "), "text"))
    for seq, (run, rows) in enumerate([("first", docs.where("doc_id % 2 = 0")), ("second", again)]):
        named = rows.drop("doc_id").withColumn("project_id", col.of_run(F.lit("p"), run))
        col.append_log(col.upserts(col.prepare_points(named), seq), path)
    parts = [col.without_run(col.current(col.read_log(spark, path, f"p{col.RUN_MARK}{run}"))) for run in ("first", "second")]
    return parts[0].unionByName(parts[1]).select("run_id", "uid", F.length("text").alias("chars"))


@query("ensure_collection", "SELECT 'p-' || lang AS project_id, count(*) AS points FROM documents GROUP BY ALL")
def ensure_collection(spark, sf_dir):
    path = new_path(spark, "collection")
    col.ensure_collection(spark, path)
    col.ingest(_project_rows(spark, sf_dir), path, models.hash_embedder(64), 0, dim=64)
    col.ensure_collection(spark, path)
    return col.current(col.read_log(spark, path)).groupBy("project_id").agg(F.count(F.lit(1)).alias("points"))


@query("ingest_both_sides", """
SELECT s.side AS side, s.side || '-' || vec_id AS uid FROM embeddings, (VALUES ('input'), ('reference')) s(side)""")
def ingest_both_sides(spark, sf_dir):
    path = new_path(spark, "collection")
    col.append_log(col.upserts(col.prepare_points(points(spark, sf_dir)), 0), path)
    return col.current(col.read_log(spark, path)).select("side", "uid")


@query("ingest_counts", """
SELECT 'proj-' || label AS project_id, s.side AS side, count(*) AS points, count(DISTINCT vec_id // 3) AS documents
FROM embeddings, (VALUES ('input'), ('reference')) s(side) GROUP BY ALL""")
def ingest_counts(spark, sf_dir):
    grouped = points(spark, sf_dir).withColumn("group_uid", F.floor(F.col("vec_id") / 3).cast("string"))
    return col.counts(grouped)


def op_log(spark, sf_dir) -> DataFrame:
    """Log rows from events: an error deletes a document, anything else writes a point.

    The document of a point is the number in the event's properties, so points move between documents.
    """
    e = table(spark, sf_dir, "events")
    rows = e.select(
        F.lit("p").alias("project_id"), F.lit("input").alias("side"),
        F.concat(F.lit("input-"), "user_id").alias("uid"), F.get_json_object("props", "$.k").alias("orig_sid"),
        F.concat_ws(":", "event_type", "value").alias("text"), "event_type", "event_id",
        F.lit(None).cast("array<float>").alias("vector"),
    )
    writes = col.prepare_points(rows.where(F.col("event_type") != "error"))
    removals = rows.where(F.col("event_type") == "error")
    return col.upserts(writes, F.col("event_id")).unionByName(col.deletes(removals, F.col("event_id")))


_LOG = """
WITH w AS (SELECT event_id AS seq, 'input-' || user_id AS uid, json_extract_string(props, '$.k') AS orig_sid, event_type FROM events),
last AS (SELECT uid, arg_max(orig_sid, seq) AS orig_sid, max(seq) AS seq FROM w WHERE event_type <> 'error' GROUP BY uid)
"""


@query("upsert_latest", _LOG + "SELECT uid, orig_sid, seq FROM last")
def upsert_latest(spark, sf_dir):
    return col.latest(op_log(spark, sf_dir)).select("uid", "orig_sid", "seq")


@query("delete_points", _LOG + """
SELECT uid, orig_sid, seq FROM last l WHERE NOT EXISTS (
  SELECT 1 FROM w WHERE event_type = 'error' AND w.orig_sid = l.orig_sid AND w.seq > l.seq)""")
def delete_points(spark, sf_dir):
    return col.current(op_log(spark, sf_dir)).select("uid", "orig_sid", "seq")


@query("update_points", """
SELECT 'input-' || doc_id AS uid, CASE WHEN lang = 'fr' THEN source || ' ' || text ELSE text END AS text,
       CASE WHEN lang = 'fr' THEN 'undefined' ELSE doc_id::VARCHAR END AS orig_sid,
       len(list_filter(regexp_split_to_array(CASE WHEN lang = 'fr' THEN source || ' ' || text ELSE text END, '[ \\t\\r\\n]+'),
           lambda t: t <> ''))::DOUBLE AS tokens
FROM documents""")
def update_points(spark, sf_dir):
    """French documents get a new text; the old payload does not survive."""
    path = _collection(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").where(F.col("lang") == "fr")
    changed = docs.select(
        F.lit("p-fr").alias("project_id"), F.lit("input").alias("side"),
        F.concat(F.lit("input-"), "doc_id").alias("uid"), F.concat_ws(" ", "source", "text").alias("text"))
    col.append_log(col.updates(changed, models.hash_embedder(64), 1), path)
    total = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return col.current(col.read_log(spark, path)).select("uid", "text", "orig_sid", total.alias("tokens"))


@query("lookup_points", """
SELECT DISTINCT 'reference-' || vec_id AS uid, 1.0::DOUBLE AS score FROM embeddings JOIN labels ON doc_id = vec_id""")
def lookup_points(spark, sf_dir):
    live = col.prepare_points(points(spark, sf_dir))
    ids = table(spark, sf_dir, "labels").select(F.concat(F.lit("reference-"), "doc_id").alias("uid"))
    return col.lookup(live, ids).select("uid", "score")
