"""Compare registered queries with their SQL: ``python -m workloads.check <sf_dir> [name…]``."""

from __future__ import annotations

import sys
import time
from collections import Counter

from pyspark.sql import SparkSession

from workloads import ORACLES, QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def session(cores: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def oracle(sf_dir: str):
    import duckdb  # the comparison alone needs it, not the session

    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return db


def rows(frame_rows, columns) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if isinstance(v, float):
            return round(v, 6) + 0.0
        if isinstance(v, list):
            return tuple(map(plain, v))
        return v

    return Counter(tuple(plain(r[i]) for i in order) for r in frame_rows)


def compare(spark, db, name: str, sf_dir: str) -> tuple[bool | None, str]:
    df = QUERIES[name](spark, sf_dir)
    got = rows(df.collect(), df.columns)
    if name not in ORACLES:
        return None, f"{sum(got.values())} rows"
    cursor = db.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    want = rows(cursor.fetchall(), names)
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    if got != want:
        return False, (f"{sum(got.values())} rows, want {sum(want.values())}; extra {list((got - want))[:2]}; "
                       f"missing {list((want - got))[:2]}")
    return True, f"{sum(got.values())} rows"


def main() -> None:
    sf_dir, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark, db = session(), oracle(sf_dir)
    failed = []
    for name in names:
        start = time.time()
        try:
            ok, note = compare(spark, db, name, sf_dir)
        except Exception as exc:
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:600]}"
        if ok is False:
            failed.append(name)
        print(f"{'ok  ' if ok else 'rows' if ok is None else 'FAIL'} {name} {time.time() - start:.1f}s {note[:900]}", flush=True)
    print(f"{len(names) - len(failed)} of {len(names)} agree; failed: {failed}")


if __name__ == "__main__":
    main()
