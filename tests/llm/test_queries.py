"""Registered queries: against their SQL, over the given tables, and over empty ones."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docmatch.llm import fingerprint
from docmatch.llm.queries import ORACLES, QUERIES
from tests.llm.cases import docs
from workloads.check import rows

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).parents[2]


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", name)[1]) for name in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_its_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    cursor = db.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert rows(df.collect(), df.columns) == rows(cursor.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op1_chat_formatting", "op5_decontamination", "op12_whitening", "op13_spelling_variants"}))
def test_query_has_a_row_for_each_document(spark, name):
    assert QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_over_empty_tables(spark, tmp_path, name):
    for table in ("documents", "benchmark", "labels", "conversations", "embeddings"):
        spark.read.parquet(f"{SF}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert QUERIES[name](spark, str(tmp_path)).count() == (name == "op1_chat_formatting")


def test_pipeline_stages_keep_columns_and_take_effect(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    left, kept = table, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, SF)
        assert left.schema == table.schema or left.dtypes == table.dtypes, name
        kept.append(left.count())
    assert 0 < kept[3] == kept[2] < kept[1] < kept[0] < table.count()
    ids = corpus_pipeline.STAGES[-1][1](spark, left, SF)
    assert ids.columns == ["doc_id", "ids", "n_tokens"] and ids.count() == kept[-1]
    assert corpus_pipeline.run(spark, SF).count() == kept[-1]


def test_pipeline_over_odd_rows(spark):
    left = docs(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, SF)
        assert left.columns == docs(spark).columns
    assert corpus_pipeline.STAGES[-1][1](spark, left, SF).count() == left.count()


def test_pipeline_over_empty_tables(spark, tmp_path):
    for table in ("documents", "benchmark", "labels"):
        spark.read.parquet(f"{SF}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_leave_columns_with_names_of_their_own(spark):
    """Columns named like those that the operators use inside pass through unchanged."""
    extra = ["row", "key", "class", "hash", "text_key", "_found_id", "_batch", "_range", "spans"]
    table = docs(spark).select("*", *(F.concat(F.lit(f"{name} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(name)
                                      for name in extra))
    left = table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, SF)
        assert left.columns == table.columns, name
    found = left.select("doc_id", *extra).collect()
    assert found and all(r[name] == f"{name} of {'none' if r.doc_id is None else r.doc_id}" for r in found for name in extra)
    assert fingerprint.fingerprints(table).count() == table.count()


def test_driver_reads_are_bounded():
    """Rows reach the driver by toLocalIterator only, next to the bound that their docstrings state."""
    for file in (ROOT / "docmatch/llm").glob("*.py"):
        found = set(re.findall(r"\.(collect|toPandas|toArrow|localCheckpoint|crossJoin|rdd)\b", file.read_text()))
        assert not found, file
