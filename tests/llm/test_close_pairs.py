"""The estimate of candidates: all pairs of the sample are counted, a few rows at a time."""

import tracemalloc

import numpy as np

from quarterdeck.llm import simhash


def test_counts_of_close_pairs_are_those_of_all_pairs():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 62, 150).astype(np.uint64)
    x[100:] = x[:50] ^ np.uint64(0b101)
    masks = [simhash.mask_of(range(k, k + 16)) for k in range(0, 64, 16)]
    want = [[sum(int(np.bitwise_count((x[i] ^ x[j]) & np.uint64(m))) == d for i in range(150) for j in range(i)) for d in range(3)] for m in masks]
    assert simhash.close_pairs(x, masks, 2, rows=7).tolist() == want
    assert not simhash.close_pairs(x[:0], masks, 2).any() and not simhash.close_pairs(x[:1], masks, 2).any()


def test_the_estimate_holds_no_table_of_all_pairs():
    x = np.random.default_rng(2).integers(0, 1 << 62, simhash.ESTIMATE_ROWS).astype(np.uint64)
    tracemalloc.start()
    try:
        simhash.allot([list(range(0, 32)), list(range(32, 64))], x, 100_000, 2)
        assert tracemalloc.get_traced_memory()[1] < 20e6  # all pairs at once are 36 MB, several times over
    finally:
        tracemalloc.stop()
