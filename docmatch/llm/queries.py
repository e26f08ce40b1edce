"""The registered queries of this package, each next to its SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmatch import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- 1 ---------------------------------------------------------------------------------------------------

SAID = r"\### Assistant: </turn> ok"

CHATS = rf"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{SAID}' UNION ALL SELECT -7, 1, 'assistant', '{SAID}')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<turn ' || url_encode(role) || '>' || chr(10) || regexp_replace(text, '(\\|</?turn)', '\\\1', 'g')
             || chr(10) || '</turn>' || chr(10)))::BIGINT AS formatted_chars
FROM said GROUP BY conv_id
"""


@query("op1_chat_formatting", CHATS)
def op1(spark, sf_dir):
    """Every conversation, and one that is streamed in pieces, corrected and regenerated."""
    from docmatch.llm import chat

    events = chat.events_of(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    streamed = spark.createDataFrame(
        [(-7, 0, 0, "message", "user", "said"), (-7, 0, 1, "edit", None, SAID[:9]), (-7, 0, 2, "delta", None, SAID[9:]),
         (-7, 1, 3, "message", "assistant", "draft"), (-7, 2, 4, "message", "user", "withdrawn"),
         (-7, 1, 5, "regenerate", None, ""), (-7, 1, 6, "delta", None, SAID[:17]), (-7, 1, 7, "delta", None, SAID[17:])],
        events.schema)
    return chat.read_back(chat.format_chats(events.unionByName(streamed)))


# --- 2 ---------------------------------------------------------------------------------------------------

@query("op2_fingerprints")
def op2(spark, sf_dir):
    """I-Match fingerprints of every whole text and of its edited text."""
    from docmatch.llm import fingerprint

    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


# --- 3 ---------------------------------------------------------------------------------------------------

@query("op3_quality")
def op3(spark, sf_dir):
    """Quality of every whole text."""
    from docmatch.llm import quality

    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# --- 4 ---------------------------------------------------------------------------------------------------

@query("op4_lm_scores")
def op4(spark, sf_dir):
    """Language-model scores of every whole text."""
    from docmatch.llm import lm

    return lm.score(table(spark, sf_dir, "documents"))


# --- 5 ---------------------------------------------------------------------------------------------------

@query("op5_decontamination")
def op5(spark, sf_dir):
    """Documents that hold benchmark passages, word substitutions tolerated."""
    from docmatch.llm import decontaminate

    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# --- 6 ---------------------------------------------------------------------------------------------------

@query("op6_similar_documents")
def op6(spark, sf_dir):
    """Classes of documents whose sets of 3-word shingles have a Jaccard similarity of 0.9 or more, and links."""
    from docmatch.llm import similar

    return similar.similar_documents(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


# --- 7 ---------------------------------------------------------------------------------------------------

@query("op7_substring_dedup")
def op7(spark, sf_dir):
    """Words that stay after windows of 35 words that repeat anywhere are removed."""
    from docmatch.llm import repeats

    found = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    n_removed = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, r: n + r.end - r.start)
    return found.select("doc_id", "n_words", n_removed.alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))


# --- 8 ---------------------------------------------------------------------------------------------------

@query("op8_toxicity")
def op8(spark, sf_dir):
    """Toxicity of every whole text."""
    from docmatch.llm import toxicity

    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# --- 9 ---------------------------------------------------------------------------------------------------

@query("op9_secret_scan")
def op9(spark, sf_dir):
    """Secrets in every whole text."""
    from docmatch.llm import secret_scan

    return secret_scan.digests(secret_scan.find_secrets(table(spark, sf_dir, "documents")))


# --- 10 --------------------------------------------------------------------------------------------------

@query("op10_byte_bpe")
def op10(spark, sf_dir):
    """Ids and their bytes for every whole text."""
    import public_tokenizers

    from docmatch.llm import bpe

    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


# --- 11 --------------------------------------------------------------------------------------------------

LINES = r"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS (SELECT doc_id, unnest(lines) AS said, unnest(range(len(lines))) AS pos FROM split),
keyed AS (SELECT doc_id, said, pos, translate(regexp_replace(said, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line),
shared AS (SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (SELECT doc_id, said, pos, coalesce(doc_id < keeper, false) AS gone FROM keyed LEFT JOIN shared USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(said, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


@query("op11_line_dedup", LINES)
def op11(spark, sf_dir):
    """Lines that five documents hold stay in the one with the largest id."""
    from docmatch.llm import lines

    found = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


# --- 12 --------------------------------------------------------------------------------------------------

@query("op12_whitening")
def op12(spark, sf_dir):
    """Every embedding projected on 16 components of unit variance."""
    from docmatch.llm import whitening

    return whitening.whiten(table(spark, sf_dir, "embeddings"))


# --- 13 --------------------------------------------------------------------------------------------------

@query("op13_spelling_variants")
def op13(spark, sf_dir):
    """The words of all documents and the more frequent words that they vary."""
    from docmatch.llm import spelling

    return spelling.variants(table(spark, sf_dir, "documents"))
