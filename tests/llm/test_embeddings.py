import math

import numpy as np
import pytest

from quarterdeck.llm import embeddings


def plain(rows, cosine):
    ok = {}
    for i, (vec_id, v, label) in enumerate(rows):
        if vec_id is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            ok[i] = np.array(v, dtype=float) / np.linalg.norm(np.array(v, dtype=float))
    links, root = {i: 0 for i in range(len(rows))}, {i: rows[i][0] for i in range(len(rows))}
    pairs = [(i, j) for i in ok for j in ok if i != j and rows[i][2] == rows[j][2] and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] >= cosine]
    for i, _ in pairs:
        links[i] += 1
    for _ in rows:
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
    return [(rows[i][0], links[i], root[i], root[i] == rows[i][0] if rows[i][0] is not None else True) for i in range(len(rows))]


@pytest.mark.parametrize("leaf", [1500, 6])
def test_links_and_components_match_brute_force(spark, leaf):
    rng = np.random.default_rng(2)
    rows, vec_id = [], 0
    for label in (0, 1):
        for _ in range(6):
            c = rng.normal(size=8)
            for spread in rng.choice([0.001, 0.05, 0.12, 0.4], 8):
                rows.append((vec_id, [float(np.float32(x)) for x in c + spread * rng.normal(size=8)], label))
                vec_id += 1
    rows += [(vec_id + k, list(rows[3][1]), 0) for k in range(4)] + [(vec_id + 4, [x * 2 for x in rows[3][1]], 0), (vec_id + 5, None, 0), (vec_id + 6, [0.0] * 8, 0), (vec_id + 7, [1.0] * 7 + [None], 0)]
    rows += [(vec_id + 8, [float("nan")] + [1.0] * 7, 0), (vec_id + 9, list(rows[3][1]), None), (vec_id + 10, [], 0), (None, list(rows[3][1]), 0), (vec_id + 11, [1.0, 2.0], 0), (vec_id + 12, [2.0, 4.0], 0)]
    tight = rng.normal(size=8)
    rows += [(vec_id + 20 + k, [float(x) for x in tight + 1e-4 * rng.normal(size=8)], 2) for k in range(30)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, label int, node int, n int")
    key = lambda r: (-1 if r[0] is None else r[0],)
    got = sorted(map(tuple, embeddings.near_duplicates(df, leaf=leaf).collect()), key=key)
    assert got == sorted(plain(rows, 0.98), key=key)


@pytest.mark.parametrize("levels", [40, 1])
def test_points_of_one_direction_and_large_rests_lose_no_link(spark, monkeypatch, levels):
    monkeypatch.setattr(embeddings, "LEVELS", levels)
    rng = np.random.default_rng(4)
    v, w = rng.normal(size=5), rng.normal(size=5)
    rows = [(k, [float(x) for x in v * (k + 1)], 0) for k in range(40)] + [(100, [float(x) for x in -v], 0), (101, [float(x) for x in v + 0.15 * w], 0)]
    rows += [(200 + k, [float(k + 1)], 1) for k in range(30)] + [(300 + k, [-float(k + 1)], 1) for k in range(3)]
    rows += [(400 + k, [float(x) for x in w + (0.03 + 0.25 * (k % 2)) * rng.normal(size=5)], 2) for k in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(map(tuple, embeddings.near_duplicates(df, leaf=6).collect()))
    assert got == sorted(plain(rows, 0.98))


def test_an_id_with_several_vectors_or_labels(spark):
    near = lambda x: [1.0, x, 0.0]
    rows = [(1, near(0.0), 0), (1, near(0.0), 1), (2, near(0.01), 0), (3, near(0.02), 0), (4, near(0.01), 1)]
    rows += [(7, [0.0, 1.0, 0.0], 2), (7, [0.0, 0.0, 1.0], 2), (8, [0.0, 1.0, 0.01], 2), (6, [0.0, 0.01, 1.0], 2), (8, [0.0, 1.0, 0.01], 2), (8, [0.0, 1.0, 0.01], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    assert sorted(map(tuple, embeddings.near_duplicates(df).collect())) == sorted(plain(rows, 0.98))


def test_empty_table(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
