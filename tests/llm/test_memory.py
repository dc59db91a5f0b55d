"""What a worker holds at once."""

import tracemalloc

import numpy as np

from apotheca.llm import collocations


def peak_mb(work):
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0]
        out = work()
        return out, (tracemalloc.get_traced_memory()[1] - before) / 1e6
    finally:
        tracemalloc.stop()


def test_hashes_are_counted_in_the_memory_that_holds_them():
    hashes = np.random.default_rng(1).integers(0, 1 << 20, 1 << 21).astype(np.int32)
    want = np.bincount(hashes, minlength=1 << 20)
    got = np.zeros(1 << 20, dtype=np.int64)

    def add():
        for batch in collocations.counted(hashes):
            assert batch.num_rows <= 1 << 16
            np.add.at(got, batch.column("bucket").to_numpy(), batch.column("n").to_numpy())

    assert list(collocations.counted(hashes[:0])) == []
    assert sum(map(len, collocations.counted(np.array([3, 3, 5], dtype=np.int32)))) == 2
    assert peak_mb(add)[1] < 5
    assert np.array_equal(got, want)
