import re
from pathlib import Path

import pytest

from workloads import ORACLES, QUERIES
from workloads.check import compare

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).parent.parent


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_its_sql(spark, db, name):
    ok, note = compare(spark, db, name, SF)
    assert ok is not False, note


def test_every_exact_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_library_code_does_not_gather_rows_on_the_driver():
    """Driver-side reads are limited to the ones behind a proven bound."""
    allowed = {"search.py": {"toArrow"}, "screen.py": {"collect", "toPandas"}}
    for file in (f for f in (ROOT / "docmatch").rglob("*.py") if "llm" not in f.parts):
        found = set(re.findall(r"\.(collect|toPandas|toArrow|toLocalIterator|localCheckpoint|crossJoin)\(", file.read_text()))
        assert found <= allowed.get(file.name, set()), file
