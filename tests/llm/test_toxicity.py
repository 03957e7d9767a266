import numpy as np
import pandas as pd

from quarterdeck.llm import toxicity
from quarterdeck.llm.common import sampled

COMMON = [f"{a}{b}" for a in ("ba", "ke", "lo", "mi", "nu", "pa") for b in ("ran", "tel", "sim", "dop", "wen")]
RUDE = ["grubsnark", "vilemuck", "snotfool"]


def _documents(n, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        words = rng.choice(COMMON, int(rng.integers(20, 120))).tolist()
        toxic = int(i % 5 == 0)
        for at in rng.integers(0, len(words), max(1, len(words) // 25)) if toxic else ():
            words[at] = str(rng.choice(RUDE))
        rows.append((i, " ".join(words), toxic))
    return rows


def test_class_models_against_the_formula():
    rows = [(1, "a b a c"), (1, "a b"), (0, "b c a a")]
    words = ["a", "b", "c"]
    number = {w: k for k, w in enumerate(words, 2)}
    pairs = [(y, number.get(v, toxicity.START), number[w]) for y, t in rows for v, w in zip(["", *t.split()], t.split(), strict=False)]
    counts = pd.DataFrame(pairs, columns=["toxic", "before", "word"]).value_counts().rename("n").reset_index()
    corpus = np.array([5.0, 3.0, 1.0])
    model = toxicity.fitted(counts, words, corpus, 10)

    def probability(toxic, word, before):
        shared = {toxicity.RARE: 0.1 - 3 * toxicity.UNSEEN}.get(word, corpus[word - 2] / 10 + toxicity.UNSEEN)
        own = counts[counts["toxic"] == toxic]
        heads = own.groupby("word")["before"].nunique()
        off = lambda n, every: (0, *toxicity.discount(np.asarray(every)))[min(int(n), 3)]
        n = heads.get(word, 0)
        p = (n - off(n, heads)) / heads.sum() + sum(off(x, heads) for x in heads) / heads.sum() * shared
        after = own[own["before"] == before]
        if not len(after):
            return p
        c = after[after["word"] == word]["n"].sum()
        return (c - off(c, own["n"])) / after["n"].sum() + sum(off(x, own["n"]) for x in after["n"]) / after["n"].sum() * p

    text = "A b, c unknown a-a c b b"
    own = [number.get(w, toxicity.RARE) for w in toxicity.words_of(text)]
    want = [np.log(probability(1, w, b)) - np.log(probability(0, w, b)) for b, w in zip([toxicity.START, *own], own, strict=False)]
    assert np.allclose(model.gains(text), want)
    for y in (0, 1):  # of a class, all words after any other come to 1
        for b in (toxicity.START, toxicity.RARE, 2, 3, 4):
            assert abs(sum(probability(y, w, b) for w in (toxicity.RARE, 2, 3, 4)) - 1) < 1e-6


def test_held_out_accuracy_and_odd_rows(spark):
    rows = _documents(900)
    odd = [(2000, None), (2001, ""), (2002, "12 34 !!"), (None, rows[0][1]), (0, rows[0][1]), (2003, "grubsnark"), (2004, ("baran ketel " * 40_000) + "vilemuck snotfool")]
    docs = spark.createDataFrame([(i, t, 0.5, 1) for i, t, _ in rows] + [(i, t, 0.1, 0) for i, t in odd], "doc_id long, text string, score double, toxic int").repartition(4)
    labels = spark.createDataFrame([(i, y, 3) for i, _, y in rows] + [(1, None, 1), (3, 7, 1), (None, 1, 1), (5, 0, 0)], "doc_id long, toxic int, text int")
    got = toxicity.classify(docs, labels).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    truth = {i: y for i, _, y in rows}
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 100 and np.mean([p == y for p, y in held]) > 0.98
    by = {r.doc_id: r for r in got}
    assert by[2000].score == by[2001].score == by[2002].score and by[None].score == by[0].score and by[2003].predicted == 1
    again = toxicity.classify(docs.repartition(2), labels).collect()
    assert {(r.doc_id, round(r.score, 9)) for r in again} == {(r.doc_id, round(r.score, 9)) for r in got}


def test_without_both_classes_and_empty_tables(spark):
    docs = spark.createDataFrame([(i, "some words") for i in range(9)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.classify(docs, none).collect()} == {0.0}
    assert {r.score for r in toxicity.classify(docs, spark.createDataFrame([(i, 1) for i in range(9)], "doc_id long, toxic int")).collect()} == {1.0}
    assert toxicity.classify(docs.limit(0), none).count() == 0


def test_sample_is_of_distinct_texts_and_bounded(spark):
    rows = [("x", f"text number {i}") for i in range(500)] + [("x", "copied " * 9)] * 900 + [("y", "one text")] * 700 + [("z", "long " * 5000)] + [("z", f"short {i}") for i in range(50)] + [(None, "a"), ("w", None)]
    got = sampled(spark.createDataFrame(rows, "lang string, text string"), "lang", 60, 20_000).collect()
    by = {k: [r.text for r in got if r.lang == k] for k in "xyzw"}
    assert 40 <= len(by["x"]) <= 60 and len(set(by["x"])) == len(by["x"])
    assert by["y"] == ["one text"] and by["w"] == []
    assert len(by["z"]) == 50 and max(map(len, by["z"])) < 100
