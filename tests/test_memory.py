"""What a Python worker holds: vectors once in double precision nowhere."""

import tracemalloc

import numpy as np
import pyarrow as pa

from docmatch.operators import search


def peak_of(work):
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_a_block_of_vectors_takes_little_more_than_its_unit_rows():
    n, dim = 200_000, 64
    flat = pa.array(np.random.default_rng(0).standard_normal(n * dim, dtype=np.float32))
    vectors = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * dim), flat)
    table = pa.table({"k": pa.array(range(n)), "v": vectors})
    assert peak_of(lambda: search._Block(table, "v")) < 2 * 4 * n * dim


def test_streamed_rows_are_read_in_small_tables_whatever_the_block():
    sizes = []
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(65_536, np.int64))], names=["x"])  # half a MB
    for table in search._tables(iter([batch] * 100), search.READ_BYTES):
        sizes.append(table.nbytes)
    assert max(sizes) <= 4.5 * (1 << 20) and sum(sizes) == 100 * batch.nbytes
