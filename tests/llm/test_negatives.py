import math

import numpy as np
import pytest

from quarterdeck.llm import negatives


def plain(rows, anchors, low=80, high=100, k=5):
    ok = [(i, l, v) for i, l, v in rows if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: int(sum(x * y for x, y in zip(a, b, strict=False)))
    out = []
    for at, (i, label, v) in enumerate(ok):
        if not anchors(i):
            continue
        scored = sorted((-dot(v, w), j, m) for n, (j, m, w) in enumerate(ok) if n != at)
        for p, j, m in [x for x in scored if x[2] == label][:k]:
            near = [x for x in scored if x[2] != label and low * -p <= 100 * -x[0] <= high * -p][:k]
            out += [(i, j, rank, x[1], -p, -x[0]) for rank, x in enumerate(near, 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [4096, 7])
def test_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(negatives, "BLOCK", block)
    rng = np.random.default_rng(block)
    centres = rng.integers(-60, 60, (4, 20))
    rows = [(i, int(rng.integers(0, 3)), [float(x) for x in centres[rng.integers(0, 4)] + rng.integers(-12, 12, 20)]) for i in range(120)]
    rows += [(200 + i, i % 2, list(rows[10][2])) for i in range(12)] + [rows[10], rows[10], (10, 2, list(rows[11][2]))]  # copies, repeated rows, an id with two labels
    rows += [(300, 0, None), (301, None, list(rows[0][2])), (None, 1, list(rows[0][2])), (302, 1, [1.0, None]), (303, 1, [float("nan")] * 20), (304, 0, [float("inf")] * 20)]
    rows += [(310, 1, []), (320, 0, [0.0] * 20), (330, 7, [5.0] * 20), (340, 2, [9.0, 8.0]), (350, 0, [-x for x in rows[0][2]])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, label int, v array<double>, anchor int").repartition(3)
    got = sorted(map(tuple, negatives.mine(df, "vec_id % 10 = 0").collect()))
    assert got == plain(rows, lambda i: i % 10 == 0)


def test_index_loses_no_pair_at_any_threshold():
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(300, 21)) * 40 * np.linspace(2, 0.05, 21))
    q = np.concatenate([x[:40] + 2, np.zeros((1, 21))])
    index, full = negatives.Index(x), q @ x.T
    for least in (full.max(axis=1) * 0.9, np.full(41, 0.0), np.full(41, -np.inf), np.full(41, full.max() + 1), np.median(full, axis=1)):
        i, j, score = index.above(q, least)
        a, b = np.nonzero(full >= least[:, None])
        assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == sorted(zip(a.tolist(), b.tolist(), strict=True))
        assert (score == full[i, j]).all()


def test_lists_leave_components_out():
    x = np.concatenate([np.full((5, 8), 10.0), np.full((5, 8), 0.1)], axis=1)
    index = negatives.Index(x)
    rows, depth = index.lists(index.remaining(x[:2]), 700.0)
    assert len(rows) == 5 and (depth == 1).all()
    assert not len(index.lists(index.remaining(x[:2]), 1e6)[0])


def test_contract_rows_and_empty_table(spark):
    rows = [(7, [0.5, -0.001, float("nan")], 9), (8, [0.5, None], 3), (9, None, 1)]
    got = {r.vec_id: r for r in negatives.planted(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert got[7].label == 0 and got[7].v[:2] == [128.0, -1.0] and got[8].v == [128.0, None] and got[9].v is None and got[8].label == 3
    for rows in ([], [(1, [1.0], 0)], [(100, [1.0], 0)]):
        assert negatives.hard_negatives(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).count() == 0
