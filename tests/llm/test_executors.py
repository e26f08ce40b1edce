"""Workers that cannot import this repository: functions and models travel to them by value."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parents[2]
SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])  # the driver's path alone
from workloads.check import session
import __spark_entry__
spark = session(2)

def importable(batches):
    import importlib.util
    import pyarrow as pa
    for batch in batches:
        yield pa.RecordBatch.from_pydict({"id": [int(importlib.util.find_spec("docmatch") is not None)]})

assert {r.id for r in spark.range(8).mapInArrow(importable, "id bigint").collect()} == {0}, "workers can import the repository"
queries = __spark_entry__.queries()
for name in sorted(queries):
    if name.startswith("op") and name[2].isdigit():
        queries[name](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
        print("ran", name, flush=True)
"""


def test_every_operator_runs_on_workers_without_the_repository(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT, str(ROOT)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    assert sum(line.startswith("ran op") for line in done.stdout.splitlines()) == 13
