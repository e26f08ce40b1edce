"""Queries over document trees: loading, validation, flattening, chunking, ids.

Trees are built row by row from ``documents``: lines, sentences, clauses and words are the levels. A
text with one piece is a leaf and carries the text; a text with several is a container without text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmatch.functions.ids import uuid5
from docmatch.operators import collection as col
from docmatch.operators import hierarchy, validate
from docmatch.sources import trees as src
from docmatch.sources.staging import new_path
from workloads.registry import query, table

# Separators of levels 2 to 5: regular expression for Spark, literal for SQL.
SEPARATORS = [("\n", "chr(10)"), (r"\. ", "'. '"), (", ", "', '"), (" ", "' '"), ("e", "'e'")]


def _children(text: Column, level: int, levels: int) -> Column:
    """Array of level nodes from the pieces of a text."""
    def node(piece: Column, i: Column) -> Column:
        fields = [i.cast("string").alias("sid")]
        if level == levels:
            return F.struct(*fields, piece.alias("text"))
        # A search of the bytes; to count the pieces would split the text two times more.
        many = F.contains(piece, F.lit(SEPARATORS[level - 1][0].replace("\\", "")))
        return F.struct(
            *fields,
            F.when(many, "").otherwise(piece).alias("text"),
            F.when(many, _children(piece, level + 1, levels)).alias(f"level{level + 1}"),
        )

    return F.transform(F.split(text, SEPARATORS[level - 2][0]), node)


def doc_trees(spark, sf_dir, levels: int = 5) -> DataFrame:
    root = F.struct(
        F.col("doc_id").cast("string").alias("sid"), F.col("source").alias("text"),
        _children(F.col("text"), 2, levels).alias("level2"),
    )
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"), F.lit("input").alias("side"),
        F.to_json(F.struct(F.array(root).alias("level1"))).alias("raw"),
    )


def _levels_sql(depth: int, levels: int = 5) -> str:
    """Rows of every level down to ``depth`` from plain unnesting."""
    ctes = ["n1 AS (SELECT doc_id::VARCHAR AS orig_sid, doc_id::VARCHAR AS sids, source AS txt, "
            "text AS piece FROM documents)"]
    for level in range(2, depth + 1):
        sep = SEPARATORS[level - 2][1]
        below = SEPARATORS[level - 1][1] if level < levels else None
        many = f"len(string_split(p, {below})) > 1" if below else "false"
        ctes.append(
            f"n{level} AS (SELECT orig_sid, sids || '_' || i AS sids, "
            f"txt || chr(10) || CASE WHEN {many} THEN '' ELSE p END AS txt, p AS piece, {many} AS many FROM ("
            f"SELECT orig_sid, sids, txt, unnest(string_split(piece, {sep})) AS p, "
            f"generate_subscripts(string_split(piece, {sep}), 1) - 1 AS i FROM n{level - 1}"
            f"{' WHERE many' if level > 2 else ''}))"
        )
    parts = [f"SELECT * FROM n{level} WHERE NOT many" for level in range(2, depth)]
    last = "SELECT *, false AS many FROM n1" if depth == 1 else f"SELECT * FROM n{depth}"
    return (
        f"WITH {', '.join(ctes)} SELECT orig_sid, 'input-' || sids AS group_uid, 'input-' || sids AS uid, "
        f"'input' AS side, txt AS text FROM ({' UNION ALL '.join([*parts, last])})"
    )


FLAT = ["orig_sid", "group_uid", "uid", "side", "text"]


def _register_flatten(depth: int) -> None:
    @query(f"flatten_depth{depth}", _levels_sql(depth))
    def run(spark, sf_dir):
        return hierarchy.flatten(doc_trees(spark, sf_dir), depth).select(*FLAT)


for _depth in range(1, 6):
    _register_flatten(_depth)


@query("flatten_depth6", _levels_sql(6, 6))
def flatten_depth6(spark, sf_dir):
    """Words cut once more: levels below the fifth are taken too."""
    return hierarchy.flatten(doc_trees(spark, sf_dir, 6), 6).select(*FLAT)


@query("flatten_as_coded", _levels_sql(2))
def flatten_as_coded(spark, sf_dir):
    return hierarchy.flatten(doc_trees(spark, sf_dir), 3, as_coded=True).select(*FLAT)


@query("flatten_ragged", """
WITH d AS (SELECT doc_id::VARCHAR AS s, source, lang, string_split(text, chr(10)) AS kids FROM documents),
k AS (SELECT s, source, unnest(kids) AS p, generate_subscripts(kids, 1) - 1 AS i FROM d WHERE lang = 'en')
SELECT 'input-' || s || '_' || i AS uid, source || chr(10) || p AS text FROM k
UNION ALL SELECT 'input-' || s, source FROM d WHERE lang <> 'en'
""")
def flatten_ragged(spark, sf_dir):
    """English trees have children; the others have an empty, a missing or a non-list child level."""
    lines = F.transform(F.split("text", "\n"), lambda p, i: F.struct(i.cast("string").alias("sid"), p.alias("text")))
    head = [F.col("doc_id").cast("string").alias("sid"), F.col("source").alias("text")]

    def tree(*more: Column) -> Column:
        return F.to_json(F.struct(F.array(F.struct(*head, *more)).alias("level1")))

    docs = table(spark, sf_dir, "documents")
    raw = (
        F.when(F.col("lang") == "en", tree(lines.alias("level2")))
        .when(F.col("lang") == "fr", tree(F.array().cast("array<string>").alias("level2")))
        .when(F.col("lang") == "de", tree())
        .otherwise(tree(F.lit("none").alias("level2")))
    )
    trees = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("input").alias("side"), raw.alias("raw"))
    return hierarchy.flatten(trees, 2).select("uid", "text")


@query("load_hierarchy", """
SELECT 'input' AS side, doc_id::VARCHAR AS root_sid, len(string_split(text, chr(10)))::INT AS lines FROM documents
""")
def load_hierarchy(spark, sf_dir):
    path = new_path(spark, "trees")
    doc_trees(spark, sf_dir).select("raw").write.text(path)
    parsed, _ = src.split_parsable(src.read_trees(spark, path, "input"))
    return parsed.select(
        "side",
        F.try_variant_get("tree", "$.level1[0].sid", "string").alias("root_sid"),
        F.size(F.try_variant_get("tree", "$.level1[0].level2", "array<variant>")).alias("lines"),
    )


def _write_requests(spark, sf_dir) -> str:
    """A request per conversation turn; some parts are left out or empty."""
    node = F.struct(F.col("turn").cast("string").alias("sid"), F.col("text").alias("text"))
    tree = F.struct(F.array(node).alias("level1"))
    requests = table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", F.lit("job"), "conv_id", "turn").alias("job_id"),
        F.when(F.col("turn") != 1, F.concat(F.lit("conv-"), "conv_id")).otherwise("").alias("project_id"),
        F.struct(F.lit("forward").alias("direction"), F.col("turn").alias("rag_k")).alias("scenario"),
        tree.alias("input_data"),
        F.when(F.col("role") == "assistant", tree).alias("reference_data"),
    )
    path = new_path(spark, "requests")
    requests.write.json(path)
    return path


@query("load_requests", """
SELECT 'job-' || conv_id || '-' || turn AS job_id, CASE WHEN turn <> 1 THEN 'conv-' || conv_id ELSE '' END AS project_id,
       s.side AS side, s.side || '-' || turn AS uid, text
FROM conversations, (VALUES ('input'), ('reference')) s(side) WHERE s.side = 'input' OR role = 'assistant'
""")
def load_requests(spark, sf_dir):
    requests = src.read_requests(spark, _write_requests(spark, sf_dir))
    return hierarchy.flatten(src.request_trees(requests), 1).select("job_id", "project_id", "side", "uid", "text")


@query("reject_incomplete", """
SELECT job_id, missing FROM (
  SELECT 'job-' || conv_id || '-' || turn AS job_id,
         concat_ws(',', CASE WHEN turn = 1 THEN 'project_id' END,
                        CASE WHEN role <> 'assistant' THEN 'reference_data' END) AS missing FROM conversations)
""")
def reject_incomplete(spark, sf_dir):
    complete, rejected = src.split_complete(src.read_requests(spark, _write_requests(spark, sf_dir)))
    return complete.select("job_id", F.lit("").alias("missing")).unionByName(
        rejected.select("job_id", F.concat_ws(",", "missing").alias("missing"))
    )


# --- validation ---


def defect_trees(spark, sf_dir) -> DataFrame:
    """Document trees with defects that depend on source, language and line."""
    source, lang = F.col("source"), F.col("lang")

    def line(p: Column, i: Column) -> Column:
        sid = F.when((i == 0) & (lang == "fr"), F.lit(None)).otherwise(F.concat(F.lit('"sid":"'), i.cast("string"), F.lit('"')))
        text = F.when(p.contains("the"), F.lit(None)).otherwise(F.concat(F.lit('"text":'), F.to_json(F.array(p)), F.lit("[0]")))
        text = F.regexp_replace(text, r"(?s)^(\"text\":)\[(.*)\]\[0\]$", "$1$2")
        below = F.when(source == "src6", F.lit('"level3":null'))
        node = F.concat(F.lit("{"), F.concat_ws(",", sid, text, below), F.lit("}"))
        return F.when(F.length(p) < 20, F.lit("7")).otherwise(node)

    lines = F.concat_ws(",", F.transform(F.split("text", "\n"), line))
    level2 = F.when(source == "src5", F.lit('{"sid":"x"}')).otherwise(F.concat(F.lit("["), lines, F.lit("]")))
    sid = F.when(lang == "de", F.col("doc_id").cast("string")).otherwise(
        F.concat(F.lit('"'), F.col("doc_id").cast("string"), F.lit('"')))
    level1 = F.concat(
        F.lit('{"sid":'), sid, F.lit(',"text":"'), source, F.lit('","note":1,"level2":'), level2, F.lit("}"))
    raw = (
        F.when(source == "src1", '{"other":[]}')
        .when(source == "src2", '{"level1":"none"}')
        .when(source == "src3", F.concat(F.lit("["), level1, F.lit("]")))
        .when(source == "src4", F.concat(F.lit('{"level1":['), level1))
        .otherwise(F.concat(F.lit('{"level1":['), level1, F.lit("]}")))
    )
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"), F.lit("input").alias("side"), raw.alias("raw")
    )


_DEFECTS = """
WITH d AS (SELECT doc_id::VARCHAR AS doc_id, source, lang, text FROM documents),
whole AS (SELECT * FROM d WHERE source NOT IN ('src1', 'src2', 'src3', 'src4')),
lines AS (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS p,
                 generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i
          FROM whole WHERE source <> 'src5'),
ln AS (SELECT *, 'root/level1[0]/level2[' || i || ']' AS path, '0.' || i AS o FROM lines),
found AS (
SELECT doc_id, 'root/level1' AS path, 'level1_missing' AS code, '-1' AS ord FROM d WHERE source = 'src1'
UNION ALL SELECT doc_id, 'root/level1', 'level_not_list', '-1' FROM d WHERE source = 'src2'
UNION ALL SELECT doc_id, 'root', 'root_not_object', '' FROM d WHERE source = 'src3'
UNION ALL SELECT doc_id, 'root', 'unparsable', '' FROM d WHERE source = 'src4'
UNION ALL SELECT doc_id, 'root/level1[0]', 'sid_not_string', '0.-2.0' FROM whole WHERE lang = 'de'
UNION ALL SELECT doc_id, 'root/level1[0]/level2', 'level_not_list', '0.-1' FROM whole WHERE source = 'src5'
UNION ALL SELECT doc_id, path, 'item_not_object', o FROM ln WHERE length(p) < 20
UNION ALL SELECT doc_id, path, 'sid_not_string', o || '.-2.0' FROM ln WHERE length(p) >= 20 AND i = 0 AND lang = 'fr'
UNION ALL SELECT doc_id, path, 'text_not_string', o || '.-2.1' FROM ln WHERE length(p) >= 20 AND contains(p, 'the')
UNION ALL SELECT doc_id, path || '/level3', 'level_not_list', o || '.-1' FROM ln
          WHERE length(p) >= 20 AND source = 'src6')
"""


@query("validate_violations", _DEFECTS + """SELECT doc_id, path, code, ord, CASE code
  WHEN 'level1_missing' THEN 'the root has no level1' WHEN 'level_not_list' THEN 'the level is not a list'
  WHEN 'root_not_object' THEN 'the root is not an object' WHEN 'unparsable' THEN 'text is not valid JSON'
  WHEN 'sid_not_string' THEN 'sid is missing or not a string' WHEN 'item_not_object' THEN 'the item is not an object'
  WHEN 'text_not_string' THEN 'text is missing or not a string' END AS message FROM found""")
def validate_violations(spark, sf_dir):
    found = validate.violations(defect_trees(spark, sf_dir))
    return found.select("doc_id", "path", "code", "message", F.array_join(F.col("ord").cast("array<string>"), ".").alias("ord"))


@query("valid_docs", _DEFECTS + "SELECT doc_id, doc_id NOT IN (SELECT doc_id FROM found) AS valid FROM d")
def valid_docs(spark, sf_dir):
    good, bad = validate.split_valid(defect_trees(spark, sf_dir))
    return good.select("doc_id", F.lit(True).alias("valid")).unionByName(bad.select("doc_id", F.lit(False).alias("valid")))


@query("valid_project_ids", "SELECT o_orderkey AS order_id, o_orderpriority AS project_id FROM orders "
       "WHERE regexp_matches(o_orderpriority, '^[A-Za-z0-9_-]+$')")
def valid_project_ids(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_orderpriority").alias("project_id"))
    return validate.valid_project_ids(orders)


def flat_docs(spark, sf_dir) -> DataFrame:
    """Documents as flat rows of one level."""
    docs = table(spark, sf_dir, "documents")
    uid = F.concat(F.lit("input-"), "doc_id")
    return docs.select(
        F.lit("input").alias("side"), F.col("doc_id").cast("string").alias("orig_sid"),
        uid.alias("group_uid"), uid.alias("uid"), "text",
    )


CHUNK_SIZE = 400
_CHUNKS = f"""
WITH c AS (SELECT doc_id, text, unnest(range(greatest(1, ((length(text) + {CHUNK_SIZE - 1}) // {CHUNK_SIZE})))) AS i FROM documents),
chunks AS (SELECT doc_id, i, substr(text, i * {CHUNK_SIZE} + 1, {CHUNK_SIZE}) AS text FROM c)
"""


@query("chunk_text", _CHUNKS + "SELECT 'input-' || doc_id AS group_uid, i::INT AS chunk_no, text FROM chunks")
def chunk_text(spark, sf_dir):
    return hierarchy.chunk(flat_docs(spark, sf_dir), CHUNK_SIZE).select("group_uid", "chunk_no", "text")


@query("chunk_ids", _CHUNKS + """
SELECT 'input-' || doc_id || '_c' || i AS uid, 'input-' || doc_id || '_c' || i AS sid, doc_id::VARCHAR AS orig_sid,
       'input-' || doc_id AS group_uid FROM chunks""")
def chunk_ids(spark, sf_dir):
    return hierarchy.chunk(flat_docs(spark, sf_dir), CHUNK_SIZE).select("uid", "sid", "orig_sid", "group_uid")


@query("oversize_utf8", """
SELECT 'input-' || doc_id AS uid, octet_length(encode(text)) > 2000 AS oversize FROM documents""")
def oversize_utf8(spark, sf_dir):
    return hierarchy.flag_oversize(flat_docs(spark, sf_dir), 2000).select("uid", "oversize")


_NS = "unhex('6ba7b8109dad11d180b400c04fd430c8')"


def uuid5_sql(name: str) -> str:
    h = f"sha1({_NS} || encode({name}))"
    return (
        f"(substr({h},1,8) || '-' || substr({h},9,4) || '-5' || substr({h},14,3) || '-' || "
        f"substr('89ab', ('0x' || substr({h},17,1))::INT % 4 + 1, 1) || substr({h},18,3) || '-' || substr({h},21,12))"
    )


@query("point_ids", f"SELECT uid, {uuid5_sql('uid')} AS point_id FROM (SELECT 'input-' || doc_id AS uid FROM documents "
       "UNION ALL SELECT p_name || '-' || p_partkey FROM part)")
def point_ids(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.concat_ws("-", "p_name", "p_partkey").alias("uid"))
    uids = flat_docs(spark, sf_dir).select("uid").unionByName(parts)
    return uids.withColumn("point_id", uuid5(F.col("uid")))


@query("ingest_defaults", """
SELECT uid, side, orig_sid, group_uid, coalesce(sid, uid) AS sid FROM (
  SELECT 'u-' || c_custkey AS uid, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'reference' ELSE 'input' END AS side,
         CASE WHEN c_acctbal < 0 THEN 'undefined' ELSE c_custkey::VARCHAR END AS orig_sid,
         CASE WHEN c_acctbal > 5000 THEN CASE WHEN c_mktsegment = 'MACHINERY' THEN 'reference' ELSE 'input' END || '-group_???'
              ELSE c_name END AS group_uid,
         CASE WHEN c_nationkey > 10 THEN c_name END AS sid FROM customer)
""")
def ingest_defaults(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(
        F.concat(F.lit("u-"), "c_custkey").alias("uid"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "reference").otherwise(F.lower("c_mktsegment")).alias("side"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_custkey").cast("string")).alias("orig_sid"),
        F.when(F.col("c_acctbal") <= 5000, F.col("c_name")).alias("group_uid"),
        F.when(F.col("c_nationkey") > 10, F.col("c_name")).alias("sid"),
    )
    return col.with_defaults(c).select("uid", "side", "orig_sid", "group_uid", "sid")


@query("ingest_rejects", """
WITH r AS (SELECT o_custkey AS batch, CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE 'o-' || o_orderkey END AS uid,
                  CASE WHEN o_totalprice < 20000 THEN NULL ELSE o_orderpriority END AS text, o_orderkey FROM orders),
x AS (SELECT *, CASE WHEN uid IS NULL THEN 'missing_uid' WHEN text IS NULL THEN 'missing_text' END AS reason FROM r)
SELECT o_orderkey, coalesce(reason, CASE WHEN bool_or(reason IS NOT NULL) OVER (PARTITION BY batch) THEN 'batch_rejected' END, 'ok') AS reason FROM x
""")
def ingest_rejects(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("batch"), "o_orderkey",
        F.when(F.col("o_orderpriority") != "1-URGENT", F.concat(F.lit("o-"), "o_orderkey")).alias("uid"),
        F.when(F.col("o_totalprice") >= 20000, F.col("o_orderpriority")).alias("text"),
    )
    good, bad = validate.split_ingestable(rows, ["batch"])
    return good.select("o_orderkey", F.lit("ok").alias("reason")).unionByName(bad.select("o_orderkey", "reason"))


@query("bad_vectors", """
SELECT doc_id, CASE WHEN embedding IS NULL THEN 'empty_vector' ELSE 'wrong_size' END AS reason
FROM (SELECT d.doc_id, CASE WHEN d.lang = 'fr' THEN e.embedding[1:63] ELSE e.embedding END AS embedding
      FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id) WHERE embedding IS NULL OR len(embedding) <> 64
""")
def bad_vectors(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id")
    rows = table(spark, sf_dir, "documents").join(e, "doc_id", "left").select(
        "doc_id", F.when(F.col("lang") == "fr", F.slice("embedding", 1, 63)).otherwise(F.col("embedding")).alias("vector"))
    return validate.vector_rejects(rows, 64).select("doc_id", "reason")
