import numpy as np
from pyspark.sql import functions as F

from quarterdeck.llm import nbsvm
from quarterdeck.llm.common import fold


def test_dual_descent_reaches_the_margin():
    rows = [np.array([0, 2]), np.array([0, 3]), np.array([1, 2]), np.array([1, 3])] * 10
    y = np.array([1, 1, -1, -1] * 10)
    ratio = nbsvm.log_count_ratio(np.array([[sum(i in x for x, t in zip(rows, y, strict=True) if t == c) for i in range(4)] for c in (-1, 1)]))
    assert ratio[0] > 1 and ratio[1] < -1 and abs(ratio[2]) < 1e-9
    w, bias = nbsvm.dual_descent(rows, y, ratio, 10.0, 200)
    margins = np.array([float(w[x] @ ratio[x]) / 2**0.5 + bias for x in rows])
    assert np.allclose(margins * y, 1, atol=1e-2)


def test_held_out_rows_are_classified_and_odd_rows_defined(spark):
    rng = np.random.default_rng(0)
    words = ["alpha", "beta", "gamma", "delta", "mu", "nu"]
    good = [" ".join(rng.choice(words, 30)) for _ in range(150)]
    bad = [" ".join(w + rng.choice(["***", "%%"]) for w in rng.choice(words, 30)) for _ in range(60)]
    texts = good + bad + [None, "", "x" * 100_000, "w " * 50_000]
    docs = spark.createDataFrame([(i, t, "x", 0.0) for i, t in enumerate(texts)] + [(0, texts[0], "x", 0.0), (None, texts[0], "x", 0.0)], "doc_id long, text string, predicted string, score double")
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(210)] + [(3, None, 0)], "doc_id long, quality int, toxic int")
    got = nbsvm.classify(docs, labels).collect()
    assert len(got) == len(texts) + 2
    held = {r.doc_id: r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 210}
    assert 40 < len(held) < 100 and all(r.predicted == (d < 150) for d, r in held.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert len({r.score for r in got if r.doc_id in (0, None)}) == 1
    want = {r.doc_id for r in docs.where(fold(F.col("doc_id"), 3) == 1).collect()}
    assert {r.doc_id for r in got if r.held_out} == want
    assert nbsvm.classify(docs.limit(0), labels).count() == 0
    assert {r.score for r in nbsvm.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_descent_solves_the_dual_of_a_dense_fit():
    rng = np.random.default_rng(5)
    rows = [np.flatnonzero(rng.random(12) < 0.4) for _ in range(60)]
    y = np.where(rng.random(60) < 0.3, 1, -1)
    ratio, cost = rng.normal(size=12), 0.7
    w, bias = nbsvm.dual_descent(rows, y, ratio, cost, 3000)
    dense = np.zeros((60, 13))
    for i, x in enumerate(rows):
        dense[i, x] = ratio[x] / max(len(x), 1) ** 0.5
        dense[i, 12] = 1  # the bias is a weight like any other
    top = cost * np.where(y > 0, 30 / (y > 0).sum(), 30 / (y < 0).sum())
    # by projected gradient on the dual: the least of half a squared norm less the sum of the duals, within 0 and top
    k, dual = (dense * y[:, None]) @ (dense * y[:, None]).T, np.zeros(60)
    rate = 1 / np.linalg.eigvalsh(k)[-1]
    for _ in range(60_000):
        dual = np.clip(dual - rate * (k @ dual - 1), 0, top)
    want = dense.T @ (dual * y)
    primal = lambda v: v @ v / 2 + (top * np.maximum(1 - y * (dense @ v), 0)).sum()
    got = np.append(w, bias)
    assert np.allclose(got, want, atol=2e-3) and abs(primal(got) - primal(want)) < 1e-3
    assert abs(primal(want) - (dual.sum() - want @ want / 2)) < 1e-3


def test_model_is_that_of_a_dense_fit_of_all_labelled_rows(spark, monkeypatch):
    monkeypatch.setattr(nbsvm, "PASSES", 500)
    rng = np.random.default_rng(9)
    words = ["alpha", "Beta", "gamma!", "delta", "mu", "nu3"]
    texts = [" ".join(rng.choice(words, rng.integers(1, 12), p=p)) for p in ([0.3, 0.3, 0.1, 0.1, 0.1, 0.1], [0.1, 0.1, 0.1, 0.1, 0.3, 0.3]) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 20)) for i in range(40)], "doc_id long, quality int")
    model = nbsvm.learn(docs, labels)  # under fifty rows: none is kept apart
    features = nbsvm.Features()
    x = [features(t) for t in texts]
    counts = np.ones((2, nbsvm.SLOTS))
    for i, v in enumerate(x):
        counts[int(i < 20)][v] += 1
    ratio = np.log(counts[1] / counts[1].sum() / (counts[0] / counts[0].sum()))
    y = np.where(np.arange(40) < 20, 1, -1)
    z = np.array([[(ratio[list(set(a.tolist()) & set(b.tolist()))] ** 2).sum() / (len(a) * len(b)) ** 0.5 + 1 for b in x] for a in x]) * y[:, None] * y
    dual = np.zeros(40)
    for _ in range(40_000):
        dual = np.clip(dual - (z @ dual - 1) / np.linalg.norm(z, 2), 0, nbsvm.COST)
    want = (z @ dual) * y
    assert np.allclose([model.margin(v) for v in x], want, atol=5e-3)


def test_repeated_ids_are_learned_from_once(spark):
    docs = spark.createDataFrame([(1, "b b"), (1, "a a")] * 400 + [(i, "c d") for i in range(2, 40)], "doc_id long, text string")
    ids = spark.createDataFrame([(i, i % 2, False) for i in range(1, 40)], "doc_id long, y int, apart boolean")
    apart, y, x = nbsvm._sample(docs, ids, 10**6)
    assert len(y) == 39 and sorted(map(len, x))[0] > 0
    assert len(nbsvm._sample(docs, ids, 20)[1]) < 10
    assert nbsvm.slot_counts(docs.where("doc_id = 1").withColumn("y", F.lit(1).cast("int"))).max() == 800


def test_learns_from_six_thousand_rows():
    assert nbsvm.TRAIN_ROWS >= 6000 and nbsvm.learn.__defaults__[-1] == nbsvm.TRAIN_ROWS
