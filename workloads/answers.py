"""Queries over prompts, model answers and predictions."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmatch.functions import text as tx
from docmatch.functions import tokens
from docmatch.operators import answers as answers_ledger
from docmatch.operators import models, predictions, prompt, search
from docmatch.sources.staging import new_path
from docmatch.sources.trees import write_results
from workloads.registry import query, table
from workloads.vectors import K, _knn_sql, query_points, reference_points

KEYS = ["query_uid"]
MAX_TOKENS = 8000
SCENARIO = {
    "role_desc": "", "reference_desc": "known texts", "input_desc": "new texts",
    "scoring_rule": "same wording scores high",
}


def with_scenario(df: DataFrame, **more) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in {**SCENARIO, "cof_threshold": 0.5, "max_prompt_tokens": MAX_TOKENS, **more}.items()})


def header_sql(query_text: str, leg: str) -> str:
    parts = [
        "'You compare texts.'", f"'{prompt.LEG_NOTES[leg]}'", "'References: known texts'", "'Inputs: new texts'",
        "'Scoring: same wording scores high'", "'Leave out matches below confidence 0.5.'",
        "'Answer with a JSON list; give input_uid, ref_uid, evidences, start_end_idx, confidence.'",
        "'# Query'", query_text, "'# Candidates'", "''",
    ]
    return f"concat_ws(chr(10), {', '.join(parts)})"


LINE_SQL = ("'[Cand#' || rank || '] uid=' || uid || ' score=' || printf('%.3f', round(score, 3)) || chr(10) || text || chr(10)")


def prompts_sql(hits: str, leg: str, max_tokens: int, query_text: str = "query_text") -> str:
    """CTEs from ``hits`` (query_uid, query_text, uid, score, rank, text) to ``lines`` and ``prompts``."""
    return f"""
lines AS (SELECT *, {header_sql(query_text, leg)} AS header, {LINE_SQL} AS line FROM {hits}),
running AS (SELECT *, length(header) + 1 AS header_tokens,
  length(header) + 1 + sum(length(line)) OVER (PARTITION BY query_uid ORDER BY rank ROWS UNBOUNDED PRECEDING) AS used_tokens FROM lines),
fit AS (SELECT *, header_tokens < {max_tokens} AND used_tokens <= {max_tokens} AS fits FROM running),
prompts AS (SELECT query_uid, any_value(header) AS header, any_value(header_tokens) AS header_tokens,
  count(*) FILTER (fits) AS used_k, max(used_tokens) FILTER (fits) AS prompt_tokens,
  CASE WHEN any_value(header_tokens) >= {max_tokens} THEN 'header_too_long'
       WHEN count(*) FILTER (fits) = 0 THEN 'no_candidate_fits' ELSE 'ok' END AS status,
  any_value(header) || string_agg(line, '' ORDER BY rank) FILTER (fits) AS prompt FROM fit GROUP BY query_uid)"""


_HITS = f"""WITH {_knn_sql()},
asked AS (SELECT hits.*, coalesce(d.text, '') AS query_text FROM hits LEFT JOIN documents d ON d.doc_id = query_id),
{prompts_sql('asked', 'forward', MAX_TOKENS)}"""


def asked_queries(spark, sf_dir) -> DataFrame:
    queries = query_points(spark, sf_dir).select("query_uid", F.coalesce("query_text", F.lit("")).alias("query_text"))
    return with_scenario(queries.withColumn("leg", F.lit("forward")))


def candidates(spark, sf_dir) -> DataFrame:
    points = reference_points(spark, sf_dir)
    return search.with_payload(search.knn(query_points(spark, sf_dir), points, K), points, ["text"])


@query("token_budget", _HITS + "SELECT query_uid, uid, rank AS cand_no, used_tokens::BIGINT AS used_tokens, fits FROM fit")
def token_budget(spark, sf_dir):
    headed = prompt.with_header(asked_queries(spark, sf_dir)).select("query_uid", "header_tokens", "max_prompt_tokens")
    lines = prompt.rank_candidates(candidates(spark, sf_dir).join(headed, KEYS), KEYS).withColumn(
        "line", prompt.candidate_line(F.col("cand_no"), F.col("uid"), F.col("score"), F.col("text")))
    return prompt.budget(lines, KEYS).select("query_uid", "uid", "cand_no", F.col("used_tokens").cast("long"), "fits")


PIECES = ("coalesce(list_sum(list_transform(list_filter(regexp_split_to_array({0}, '[ \\t\\r\\n]+'), lambda t: t <> ''), "
          "lambda t: ceil(length(t) / 4.0))), 0)::BIGINT")


@query("token_budget_pieces", _HITS + f"""
, counted AS (SELECT *, {PIECES.format('header')} + {PIECES.format('chr(10)')} AS h, {PIECES.format('line')} AS n FROM lines),
summed AS (SELECT *, (h + sum(n) OVER (PARTITION BY query_uid ORDER BY rank ROWS UNBOUNDED PRECEDING))::BIGINT AS used FROM counted)
SELECT query_uid, uid, rank AS cand_no, used AS used_tokens, h < 400 AND used <= 400 AS fits FROM summed""")
def token_budget_pieces(spark, sf_dir):
    """The budget with a sub-word counter: words in pieces of four code points."""
    counter = tokens.pieces(4)
    queries = asked_queries(spark, sf_dir).withColumn("max_prompt_tokens", F.lit(400))
    headed = prompt.with_header(queries, counter=counter).select("query_uid", "header_tokens", "max_prompt_tokens")
    lines = prompt.rank_candidates(candidates(spark, sf_dir).join(headed, KEYS), KEYS).withColumn(
        "line", prompt.candidate_line(F.col("cand_no"), F.col("uid"), F.col("score"), F.col("text")))
    return prompt.budget(lines, KEYS, counter=counter).select("query_uid", "uid", "cand_no", F.col("used_tokens").cast("long"), "fits")


def _prompts(spark, sf_dir) -> DataFrame:
    return prompt.build_prompts(candidates(spark, sf_dir), asked_queries(spark, sf_dir), KEYS)


@query("used_k", _HITS + "SELECT query_uid, used_k::INT AS used_k FROM prompts")
def used_k(spark, sf_dir):
    return _prompts(spark, sf_dir).select("query_uid", "used_k")


@query("assemble_prompt", _HITS + "SELECT query_uid, prompt, prompt_tokens::BIGINT AS prompt_tokens FROM prompts WHERE status = 'ok'")
def assemble_prompt(spark, sf_dir):
    ok = _prompts(spark, sf_dir).where(F.col("status") == "ok")
    return ok.select("query_uid", "prompt", F.col("prompt_tokens").cast("long"))


@query("prompt_status", _HITS + "SELECT query_uid, status FROM prompts")
def prompt_status(spark, sf_dir):
    return _prompts(spark, sf_dir).select("query_uid", "status")


@query("prompt_header", f"SELECT doc_id, {header_sql('text', 'reverse')} AS header FROM documents")
def prompt_header(spark, sf_dir):
    docs = with_scenario(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", prompt.header(F.lit("reverse"), F.col("text")).alias("header"))


@query("token_count", """
SELECT doc_id, length(text)::INT AS chars,
       len(list_filter(regexp_split_to_array(text, '[ \\t\\r\\n]+'), lambda t: t <> ''))::INT AS words FROM documents""")
def token_count(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", tx.count_chars(t).alias("chars"), tx.count_words(t).alias("words"))


@query("token_truncate", """
SELECT c_custkey, CASE WHEN c_nationkey <= 0 THEN c_name ELSE substr(c_name, 1, c_nationkey) END AS text FROM customer""")
def token_truncate(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        "c_custkey", tx.truncate(F.col("c_name"), F.col("c_nationkey")).alias("text"))


@query("token_truncate_words", """
SELECT doc_id, CASE WHEN doc_id % 50 <= 0 THEN text ELSE
  regexp_extract(text, '^(?:[ \\t\\r\\n]*[^ \\t\\r\\n]+){0,' || (doc_id % 50) || '}') END AS text FROM documents""")
def token_truncate_words(spark, sf_dir):
    """The word counter's truncation, and the general one by halving steps where it must agree."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", tx.truncate(F.col("text"), (F.col("doc_id") % 50).cast("int"), tx.count_words).alias("text"))


@query("token_truncate_pieces", f"""
SELECT doc_id, {PIECES.format('text')} AS n_tokens,
       CASE WHEN doc_id % 50 <= 0 THEN text WHEN {PIECES.format('text')} <= doc_id % 50 THEN text
            ELSE regexp_extract(text, '^(?:[ \\t\\r\\n]*[^ \\t\\r\\n]{{1,4}}){{0,' || (doc_id % 50) || '}}') END AS text FROM documents""")
def token_truncate_pieces(spark, sf_dir):
    """Count and cut by one array of token ends."""
    counter, t = tokens.pieces(4), F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", counter(t).cast("bigint").alias("n_tokens"), tx.truncate(t, (F.col("doc_id") % 50).cast("int"), counter).alias("text"))


# --- models ---


def answer_by_digest(text: str) -> str:
    """Deterministic stand-in for a model; fails for one text in sixteen."""
    digest = hashlib.md5(text.encode("utf-8")).hexdigest()
    if digest[0] == "f":
        raise RuntimeError("refused")
    return f'[{{"confidence": 0.{digest[0:2]}}}]'


def no_wait(attempt: int) -> None:
    """Retry at once."""


@query("generate_mock", """
SELECT doc_id, CASE WHEN md5(text)[1] <> 'f' THEN '[{"confidence": 0.' || md5(text)[1:2] || '}]' END AS raw_output,
       CASE WHEN md5(text)[1] = 'f' THEN 3 ELSE 1 END AS attempts,
       CASE WHEN md5(text)[1] = 'f' THEN 'RuntimeError: refused' END AS error FROM documents""")
def generate_mock(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("prompt"))
    out = models.generate(docs, {"digest": answer_by_digest}, default="digest", sleep=no_wait)
    return out.select("doc_id", "raw_output", "attempts", "error")


@query("generate_resumed", """
SELECT doc_id, CASE WHEN md5(text)[1] <> 'f' THEN '[{"confidence": 0.' || md5(text)[1:2] || '}]' END AS raw_output,
       CASE WHEN md5(text)[1] = 'f' THEN 'RuntimeError: refused' END AS error,
       CASE WHEN md5(text)[1] = 'f' AND min(doc_id % 3) OVER (PARTITION BY text) = 0 THEN 2 ELSE 1 END AS rows_kept FROM documents""")
def generate_resumed(spark, sf_dir):
    """Two runs over one ledger: a third of the documents, then all. Only failed prompts are asked twice."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("prompt"))
    path = new_path(spark, "ledger")
    for part in (docs.where("doc_id % 3 = 0"), docs):
        out = answers_ledger.resumable(part, {"digest": answer_by_digest}, path, default="digest", sleep=no_wait)
    rows = spark.read.schema(answers_ledger.SCHEMA).parquet(path).groupBy(F.col("prompt_key").alias("_key")).agg(
        F.count(F.lit(1)).cast("int").alias("rows_kept"))
    return out.join(rows, F.sha2("prompt", 256) == F.col("_key")).select("doc_id", "raw_output", "error", "rows_kept")


@query("model_routing", """
SELECT doc_id, CASE lang WHEN 'en' THEN 'upper' WHEN 'fr' THEN 'size' ELSE 'none' END AS model_used,
       CASE lang WHEN 'en' THEN md5(text) WHEN 'fr' THEN length(text)::VARCHAR END AS raw_output,
       CASE WHEN lang NOT IN ('en', 'fr') THEN 'unknown model: none' END AS error FROM documents""")
def model_routing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.col("text").alias("prompt"),
        F.when(F.col("lang") == "en", " upper ").when(F.col("lang") == "fr", " ").otherwise("none").alias("llm_name"))
    fns = {"upper": lambda t: hashlib.md5(t.encode("utf-8")).hexdigest(), "size": lambda t: str(len(t))}
    return models.generate(docs, fns, default="size", sleep=no_wait).select("doc_id", "model_used", "raw_output", "error")


# --- predictions ---

# One answer per query; the label of its vector chooses the form. {u} is the query, {h} its best hit.
_FORMS = [
    '[{"input_uid":"{u}","ref_uid":"{h}","confidence":0.5,"reason":"close"},{"input_uid":"{u}","ref_uid":"{h}","confidence":0.49}]',
    '```json\n[{"input_uid":"{u}","ref_uid":"{h}","input_text":"a","ref_text":"b","confidence":0.9}]\n```',
    '```[{"ref_uid":"{h}"}]```',
    "  no match for {u} \n",
    '{"ref_uid":"{h}","confidence":0.9}',
    "[]",
    '[{"input_uid":"{u}","ref_uid":"{h}"},{"ref_uid":"{h}","confidence":1}]',
    '[{"ref_uid":"{h}","confidence":"0.9"},5,{"ref_uid":"{u}","confidence":0.75}]',
    '\n[{"ref_uid":"unknown","input_uid":"{h}","confidence":0.8}]\n```  ',
    '[{"ref_uid":"{h}","evidences":null,"start_end_idx":[[0,3],[4,9]],"confidence":0.6},{"evidences":["x","y"],"confidence":0.7}]',
]

# What each form must give: (label, pred_no, input, ref, input_text, ref_text, plain, evidences, spans, confidence, status, reason).
_WANT = """
w(label, pred_no, i, r, it, rt, plain, ev, sp, confidence, item_status, reason) AS (VALUES
 (0, 0, 'u', 'h', NULL, NULL, NULL, '', '', 0.5, 'ok', 'close'), (0, 1, 'u', 'h', NULL, NULL, NULL, '', '', 0.49, 'ok', NULL),
 (1, 0, 'u', 'h', 'a', 'b', NULL, '', '', 0.9, 'ok', NULL), (2, 0, NULL, NULL, NULL, NULL, '', '', '', 1.0, 'ok', NULL),
 (3, 0, NULL, NULL, NULL, NULL, 'text', '', '', 1.0, 'ok', NULL),
 (6, 0, 'u', 'h', NULL, NULL, NULL, '', '', NULL, 'ok', NULL), (6, 1, NULL, 'h', NULL, NULL, NULL, '', '', 1.0, 'ok', NULL),
 (7, 0, NULL, 'h', NULL, NULL, NULL, '', '', NULL, 'bad_item', NULL), (7, 1, NULL, NULL, NULL, NULL, NULL, '', '', NULL, 'bad_item', NULL),
 (7, 2, NULL, 'u', NULL, NULL, NULL, '', '', 0.75, 'ok', NULL),
 (8, 0, 'h', 'x', NULL, NULL, NULL, '', '', 0.8, 'ok', NULL),
 (9, 0, NULL, 'h', NULL, NULL, NULL, NULL, '0-3,4-9', 0.6, 'ok', NULL), (9, 1, NULL, NULL, NULL, NULL, NULL, 'x,y', '', 0.7, 'ok', NULL)),
top AS (SELECT query_uid, label, uid, score FROM hits WHERE rank = 1),
preds AS (SELECT query_uid, pred_no::INT AS pred_no,
  CASE i WHEN 'u' THEN query_uid WHEN 'h' THEN uid END AS input_uid,
  CASE r WHEN 'u' THEN query_uid WHEN 'h' THEN uid WHEN 'x' THEN 'unknown' END AS ref_uid, it AS input_text, rt AS ref_text,
  CASE WHEN plain = 'text' THEN 'no match for ' || query_uid ELSE plain END AS plain_text, ev AS evidences, sp AS spans, reason,
  confidence::DOUBLE AS confidence, item_status FROM top JOIN w USING (label))"""
_PREDS = f"WITH {_knn_sql()}, {_WANT}"


def answers(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Answers and the hits they refer to."""
    queries = query_points(spark, sf_dir)
    hits = search.knn(queries, reference_points(spark, sf_dir), K)
    best = hits.where(F.col("rank") == 1).join(queries.select("query_uid", "label"), "query_uid")
    form = F.element_at(F.array(*map(F.lit, _FORMS)), F.col("label") + 1)
    raw = F.replace(F.replace(form, F.lit("{u}"), F.col("query_uid")), F.lit("{h}"), F.col("uid"))
    return best.select("query_uid", "label", raw.alias("raw_output")), hits


@query("strip_fence", f"""
WITH {_knn_sql()}, forms(label, body) AS (VALUES {', '.join("(%d, '%s')" % x for x in enumerate([
    _FORMS[0], _FORMS[1][8:-4], '', 'no match for {u}', _FORMS[4], '[]', _FORMS[6], _FORMS[7], _FORMS[8][1:-6], _FORMS[9]]))})
SELECT query_uid, replace(replace(body, '{{u}}', query_uid), '{{h}}', uid) AS body
FROM hits JOIN forms USING (label) WHERE rank = 1""")
def strip_fence(spark, sf_dir):
    a, _ = answers(spark, sf_dir)
    return a.select("query_uid", tx.strip_fence(F.col("raw_output")).alias("body"))


def _flat(p: DataFrame, *more: str) -> DataFrame:
    spans = F.transform("start_end_idx", lambda s: F.array_join(s.cast("array<string>"), "-"))
    return p.select(
        "query_uid", "pred_no", "input_uid", "ref_uid", "input_text", "ref_text", "plain_text",
        F.array_join("evidences", ",").alias("evidences"), F.array_join(spans, ",").alias("spans"), "confidence",
        F.try_element_at("extra", F.lit("reason")).alias("reason"), *more)


@query("parse_predictions", _PREDS + "SELECT * FROM preds")
def parse_predictions(spark, sf_dir):
    return _flat(predictions.parse_output(answers(spark, sf_dir)[0].drop("label")), "item_status")


@query("reverse_swap", _PREDS + """
SELECT query_uid, pred_no, ref_uid AS input_uid, input_uid AS ref_uid, ref_text AS input_text, input_text AS ref_text FROM preds""")
def reverse_swap(spark, sf_dir):
    p = predictions.parse_output(answers(spark, sf_dir)[0].drop("label")).withColumn("leg", F.lit("reverse"))
    return predictions.swap_reverse(p).select("query_uid", "pred_no", "input_uid", "ref_uid", "input_text", "ref_text")


_SCORED = _PREDS + """, scored AS (
SELECT p.*, coalesce(r.score, i.score, 0.0) AS similarity_score FROM (SELECT * FROM preds WHERE item_status = 'ok') p
LEFT JOIN hits r ON r.query_uid = p.query_uid AND r.uid = p.ref_uid
LEFT JOIN hits i ON i.query_uid = p.query_uid AND i.uid = p.input_uid) """


def _scored(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    a, hits = answers(spark, sf_dir)
    good = predictions.parse_output(a.drop("label")).where(F.col("item_status") == "ok")
    return a, predictions.attach_scores(good, hits, KEYS)


@query("attach_similarity", _SCORED + "SELECT query_uid, pred_no, ref_uid, round(similarity_score, 6) AS similarity_score FROM scored")
def attach_similarity(spark, sf_dir):
    return _scored(spark, sf_dir)[1].select(
        "query_uid", "pred_no", "ref_uid", F.round("similarity_score", 6).alias("similarity_score"))


@query("filter_confidence", _SCORED + "SELECT query_uid, pred_no, confidence FROM scored WHERE coalesce(confidence, 0) >= 0.5")
def filter_confidence(spark, sf_dir):
    return predictions.filter_confidence(_scored(spark, sf_dir)[1], 0.5).select("query_uid", "pred_no", "confidence")


@query("result_envelope", _SCORED + """
SELECT t.query_uid, count(s.pred_no)::INT AS n, coalesce(string_agg(s.pred_no::VARCHAR, ',' ORDER BY s.pred_no), '') AS pred_nos
FROM top t LEFT JOIN scored s ON s.query_uid = t.query_uid AND coalesce(s.confidence, 0) >= 0.5 GROUP BY t.query_uid""")
def result_envelope(spark, sf_dir):
    a, scored = _scored(spark, sf_dir)
    e = predictions.envelopes(a, predictions.filter_confidence(scored, 0.5), KEYS, [])
    return e.select("query_uid", F.size("predictions").alias("n"),
                    F.array_join(F.col("predictions.pred_no").cast("array<string>"), ",").alias("pred_nos"))


@query("write_results", _SCORED + """
SELECT 'proj-' || t.label AS project_id, count(s.pred_no) AS predictions FROM top t JOIN scored s USING (query_uid) GROUP BY ALL""")
def write_results_query(spark, sf_dir):
    a, scored = _scored(spark, sf_dir)
    path = new_path(spark, "results")
    named = scored.join(a.select("query_uid", F.concat(F.lit("proj-"), "label").alias("project_id")), "query_uid")
    write_results(named.select("project_id", "query_uid", "pred_no", "ref_uid", "similarity_score"), path)
    back = spark.read.schema("query_uid string, pred_no int, project_id string").json(path)
    return back.groupBy("project_id").agg(F.count("pred_no").alias("predictions"))
