"""The whole matching job: documents as input, benchmark passages as reference."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmatch.operators.models import hash_embedder
from docmatch.operators.scenario import Scenario
from docmatch.plans.match import MatchResult, job_summary, match, match_requests
from docmatch.sources.staging import new_path
from docmatch.sources.trees import read_requests
from workloads.answers import SCENARIO, prompts_sql
from workloads.registry import query, table
from workloads.trees import _CHUNKS, CHUNK_SIZE

K_FORWARD, K_REVERSE, MAX_TOKENS, THRESHOLD = 3, 4, 1800, 0.5
_CANDIDATE = re.compile(r"^\[Cand#[0-9]+\] uid=([^ \n]+) score=([0-9.]+)$", re.M)


def scored_answer(prompt: str) -> str:
    """Stand-in for a model: its confidence is the printed score.

    The digest of the prompt picks the form of the answer, so that a prompt that differs in one
    character gives other predictions.
    """
    form = hashlib.md5(prompt.encode("utf-8")).hexdigest()[0]
    if form == "0":
        return "nothing found"
    if form == "1":
        raise RuntimeError("refused")
    found = [{"ref_uid": u, "confidence": float(s)} for u, s in _CANDIDATE.findall(prompt)]
    text = json.dumps(found)
    return f"```json\n{text}\n```" if form == "2" else text


def no_wait(attempt: int) -> None:
    """Retry at once."""


def project_trees(spark, sf_dir) -> DataFrame:
    """One tree per document and per benchmark passage, all in one project."""
    def trees(name: str, key: str, side: str) -> DataFrame:
        node = F.struct(F.col(key).cast("string").alias("sid"), F.col("text").alias("text"))
        return table(spark, sf_dir, name).select(
            F.lit("p").alias("project_id"), F.concat_ws("-", F.lit(side), key).alias("doc_id"), F.lit(side).alias("side"),
            F.to_json(F.struct(F.array(node).alias("level1"))).alias("raw"))

    return trees("documents", "doc_id", "input").unionByName(trees("benchmark", "item_id", "reference"))


def run(spark, sf_dir, direction: str, trees: DataFrame | None = None, **more) -> MatchResult:
    scenario = Scenario(
        **SCENARIO, direction=direction, rag_k_forward=K_FORWARD, rag_k_reverse=K_REVERSE, cof_threshold=THRESHOLD,
        chunk_size=CHUNK_SIZE, max_prompt_tokens=MAX_TOKENS)
    return match(
        project_trees(spark, sf_dir) if trees is None else trees, scenario, hash_embedder(64), {"scored": scored_answer},
        default_model="scored", dim=64, sleep=no_wait, **more)


_POINTS = _CHUNKS + f""",
rchunks AS (SELECT item_id, text, unnest(range(greatest(1, ((length(text) + {CHUNK_SIZE - 1}) // {CHUNK_SIZE})))) AS i FROM benchmark),
pts AS MATERIALIZED (SELECT 'input' AS side, 'input-' || doc_id || '_c' || i AS uid, text FROM chunks
  UNION ALL SELECT 'reference', 'reference-' || item_id || '_c' || i, substr(text, i * {CHUNK_SIZE} + 1, {CHUNK_SIZE}) FROM rchunks),
tok AS MATERIALIZED (SELECT side, uid, ('0x' || substr(md5(t), 1, 8))::BIGINT % 64 AS b, count(*)::DOUBLE AS n FROM (
  SELECT side, uid, unnest(regexp_split_to_array(text, '[ \\t\\r\\n]+')) AS t FROM pts) WHERE t <> '' GROUP BY ALL),
len AS MATERIALIZED (SELECT side, uid, sqrt(sum(n * n)) AS n FROM tok GROUP BY ALL),
dots AS MATERIALIZED (SELECT a.uid AS i, b.uid AS r, sum(a.n * b.n) AS d FROM tok a JOIN tok b USING (b) WHERE a.side = 'input' AND b.side = 'reference' GROUP BY ALL),
sims AS MATERIALIZED (SELECT i.uid AS i, r.uid AS r,
   CASE WHEN li.n * lr.n > 0 THEN coalesce(d.d, 0) / (li.n * lr.n) ELSE 0 END AS score
  FROM (SELECT uid FROM pts WHERE side = 'input') i CROSS JOIN (SELECT uid FROM pts WHERE side = 'reference') r
  LEFT JOIN dots d ON d.i = i.uid AND d.r = r.uid LEFT JOIN len li ON li.uid = i.uid LEFT JOIN len lr ON lr.uid = r.uid)"""


def _leg(leg: str, sims: str = "sims") -> str:
    """CTEs of one leg over ``sims``, ending in ``<leg>_preds`` and ``<leg>_asked``. Ids are ranked; texts
    join what is left."""
    q, p, k = ("r", "i", K_REVERSE) if leg == "reverse" else ("i", "r", K_FORWARD)
    return _answers(leg, f"""SELECT query_uid, q.text AS query_text, h.uid AS uid, p.text AS text, score, rank FROM (
    SELECT * FROM (SELECT {q} AS query_uid, {p} AS uid, score, row_number() OVER (PARTITION BY {q} ORDER BY score DESC, {p}) AS rank
      FROM {sims}) WHERE rank <= {k}) h JOIN pts q ON q.uid = h.query_uid JOIN pts p ON p.uid = h.uid""")


def _answers(leg: str, hits: str) -> str:
    """CTEs from the hits of one leg to its prompts and predictions."""
    prompts = prompts_sql(f"{leg}_hits", leg, MAX_TOKENS)
    for name in ("lines", "running"):
        prompts = prompts.replace(name, f"{leg}_{name}")
    prompts = prompts.replace("fit AS", f"{leg}_fit AS").replace("FROM fit", f"FROM {leg}_fit").replace("prompts AS", f"{leg}_prompts AS")
    return f"""
{leg}_hits AS ({hits}), {prompts},
{leg}_asked AS (SELECT query_uid, used_k, prompt, md5(prompt)[1] AS form FROM {leg}_prompts WHERE status = 'ok'),
{leg}_preds AS (
  SELECT '{leg}' AS leg, query_uid, 0 AS pred_no, NULL AS cand_uid, 'nothing found' AS plain_text, 1.0::DOUBLE AS confidence, 0.0::DOUBLE AS similarity
  FROM {leg}_asked WHERE form = '0'
  UNION ALL SELECT '{leg}', query_uid, (rank - 1)::INT, uid, NULL, round(score, 3), score
  FROM {leg}_asked JOIN {leg}_hits USING (query_uid) WHERE form NOT IN ('0', '1') AND rank <= used_k AND round(score, 3) >= {THRESHOLD})"""


def _shown_sql(leg: str) -> str:
    ends = "cand_uid AS input_uid, NULL AS ref_uid" if leg == "reverse" else "NULL AS input_uid, cand_uid AS ref_uid"
    return (f"SELECT leg, query_uid, pred_no, {ends}, plain_text, round(confidence, 6) AS confidence, "
            f"round(similarity, 6) AS similarity_score FROM {leg}_preds")


def _shown(result: MatchResult) -> DataFrame:
    return result.predictions.select(
        "leg", "query_uid", "pred_no", "input_uid", "ref_uid", "plain_text",
        F.round("confidence", 6).alias("confidence"), F.round("similarity_score", 6).alias("similarity_score"))


@query("match_forward", f"{_POINTS}, {_leg('forward')} {_shown_sql('forward')}")
def match_forward(spark, sf_dir):
    return _shown(run(spark, sf_dir, "forward"))


@query("match_reverse", f"{_POINTS}, {_leg('reverse')} {_shown_sql('reverse')}")
def match_reverse(spark, sf_dir):
    return _shown(run(spark, sf_dir, "reverse"))


@query("match_both", f"{_POINTS}, {_leg('forward')}, {_leg('reverse')} {_shown_sql('forward')} UNION ALL {_shown_sql('reverse')}")
def match_both(spark, sf_dir):
    return _shown(run(spark, sf_dir, "both"))


_NUMBER = "split_part(split_part({}, '-', 2), '_', 1)::BIGINT"


@query("match_incremental", f"""{_POINTS},
own AS (SELECT doc_id, lang = 'en' AS first FROM documents),
seen AS (SELECT s.* FROM sims s JOIN own ON doc_id = {_NUMBER.format('i')} WHERE NOT first OR {_NUMBER.format('r')} % 2 = 0),
{_leg('forward', 'seen')} {_shown_sql('forward')}""")
def match_incremental(spark, sf_dir):
    """Two jobs into one kept collection: each asks its own rows against all points so far."""
    path = new_path(spark, "collection")
    number = F.regexp_extract("doc_id", r"(\d+)$", 1).cast("bigint")
    trees = project_trees(spark, sf_dir).withColumn("number", number)
    english = table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("doc_id").alias("number"), F.lit(True).alias("en"))
    marked = trees.join(english, "number", "left").withColumn(
        "first", F.when(F.col("side") == "reference", F.col("number") % 2 == 0).otherwise(F.coalesce("en", F.lit(False)))).drop("number", "en")
    parts = [marked.where("first").drop("first"), marked.where("not first").drop("first")]
    shown = [_shown(run(spark, sf_dir, "forward", trees=part, collection_path=path, seq=i)) for i, part in enumerate(parts)]
    return shown[0].unionByName(shown[1])


@query("match_envelopes", f"""{_POINTS}, {_leg('forward')}
SELECT a.query_uid, 'input-' || split_part(split_part(a.query_uid, '-', 2), '_', 1) AS root_uid, 'scored' AS model_used, a.used_k::INT AS used_k, count(p.pred_no)::INT AS n
FROM forward_asked a LEFT JOIN forward_preds p USING (query_uid) WHERE form <> '1' GROUP BY ALL""")
def match_envelopes(spark, sf_dir):
    e = run(spark, sf_dir, "forward").envelopes
    return e.select("query_uid", "root_uid", "model_used", "used_k", F.size("predictions").alias("n"))


@query("job_summary", f"""{_POINTS}, {_leg('forward')}
SELECT 'p' AS project_id, 'forward' AS leg, count(*) AS queries, count(*) FILTER (form = '1') AS failed,
       (SELECT count(*) FROM forward_preds) AS predictions FROM forward_asked""")
def job_summary_query(spark, sf_dir):
    return job_summary(run(spark, sf_dir, "forward"))


# --- requests: every conversation turn is a job that matches its text with its lines ---

REQUEST_CHUNK = 150


def _request_hits(leg: str) -> str:
    ask, role = ("input", "=") if leg == "forward" else ("reference", "<>")
    return f"""SELECT * FROM (SELECT q.job || '|' || q.uid AS query_uid, q.text AS query_text, p.uid AS uid, p.text AS text, q.k AS k,
    CASE WHEN lq.n * lp.n > 0 THEN coalesce(d.d, 0) / (lq.n * lp.n) ELSE 0 END AS score,
    row_number() OVER (PARTITION BY q.job, q.uid ORDER BY
      CASE WHEN lq.n * lp.n > 0 THEN coalesce(d.d, 0) / (lq.n * lp.n) ELSE 0 END DESC, p.uid) AS rank
  FROM pts q JOIN pts p ON p.job = q.job AND p.side <> q.side
  LEFT JOIN dots d ON d.job = q.job AND d.a = q.uid AND d.b = p.uid
  LEFT JOIN len lq ON lq.job = q.job AND lq.uid = q.uid LEFT JOIN len lp ON lp.job = p.job AND lp.uid = p.uid
  WHERE q.side = '{ask}' AND q.role {role} 'user') WHERE rank <= k"""


@query("match_requests", f"""
WITH j AS (SELECT 'job-' || conv_id || '-' || turn AS job, role, turn + 1 AS k, text FROM conversations),
src AS (SELECT job, role, k, 'input' AS side, 'input-t' AS g, text FROM j
  UNION ALL SELECT job, role, k, 'reference', 'reference-' || i, p FROM (SELECT job, role, k, unnest(string_split(text, chr(10))) AS p,
    generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM j)),
pts AS (SELECT job, role, k, side, g || '_c' || i AS uid, substr(text, i * {REQUEST_CHUNK} + 1, {REQUEST_CHUNK}) AS text FROM (
  SELECT *, unnest(range(greatest(1, (length(text) + {REQUEST_CHUNK - 1}) // {REQUEST_CHUNK}))) AS i FROM src)),
tok AS (SELECT job, side, uid, ('0x' || substr(md5(t), 1, 8))::BIGINT % 64 AS b, count(*)::DOUBLE AS n FROM (
  SELECT job, side, uid, unnest(regexp_split_to_array(text, '[ \\t\\r\\n]+')) AS t FROM pts) WHERE t <> '' GROUP BY ALL),
len AS (SELECT job, uid, sqrt(sum(n * n)) AS n FROM tok GROUP BY ALL),
dots AS (SELECT a.job, a.uid AS a, c.uid AS b, sum(a.n * c.n) AS d FROM tok a JOIN tok c ON c.job = a.job AND c.b = a.b AND c.side <> a.side GROUP BY ALL),
{_answers('forward', _request_hits('forward'))}, {_answers('reverse', _request_hits('reverse'))}
{_shown_sql('forward')} UNION ALL {_shown_sql('reverse')}""")
def match_requests_query(spark, sf_dir):
    line = F.transform(F.split("text", "\n"), lambda p, i: F.struct(i.cast("string").alias("sid"), p.alias("text")))
    settings = {**SCENARIO, "cof_threshold": THRESHOLD, "chunk_size": REQUEST_CHUNK, "max_prompt_tokens": MAX_TOKENS}
    requests = table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", F.lit("job"), "conv_id", "turn").alias("job_id"), F.concat(F.lit("conv-"), "conv_id").alias("project_id"),
        F.struct(
            F.when(F.col("role") == "user", "forward").otherwise("reverse").alias("direction"),
            (F.col("turn") + 1).alias("rag_k"), *[F.lit(v).alias(n) for n, v in settings.items()],
        ).alias("scenario"),
        F.struct(F.array(F.struct(F.lit("t").alias("sid"), F.col("text").alias("text"))).alias("level1")).alias("input_data"),
        F.struct(line.alias("level1")).alias("reference_data"),
    )
    path = new_path(spark, "requests")
    requests.write.json(path)
    result, _ = match_requests(
        read_requests(spark, path), hash_embedder(64), {"scored": scored_answer}, default_model="scored", dim=64, sleep=no_wait)
    named = result.predictions.withColumn("query_uid", F.concat_ws("|", "project_id", "query_uid"))
    return _shown(MatchResult(named, *[None] * 4))
