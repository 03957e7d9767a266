import numpy as np
import pytest

import corpus_pipeline
from quarterdeck.llm import shingles


def plain_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_components(rows):
    ids = [i for i, _ in rows]
    sets, root = {i: plain_set(t) for i, t in rows}, {i: i for i in ids}
    alike = [(a, b) for a in ids for b in ids if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))]
    for _ in ids:
        for a, b in alike:
            root[a] = root[b] = min(root[a], root[b])
    return root


def texts():
    rng = np.random.default_rng(3)
    vocabulary, line = [f"w{i}" for i in range(400)], " ".join(f"common{i}" for i in range(12))
    out = [None, "", " ", "one two", "One  two", "a b c d e", "a b c d e f"]
    for _ in range(8):
        base = rng.choice(vocabulary, 90).tolist()
        for edits in (0, 0, 1, 2, 3, 4, 5, 8):
            copy = list(base)
            for at in rng.integers(0, len(copy), edits):
                copy[at] = str(rng.choice(vocabulary))
            out.append(" ".join([*copy, line]))
    chain = [f"c{i}" for i in range(60)]
    return out + [" ".join(chain[at : at + 45]) for at in range(0, 16, 3)]


@pytest.mark.parametrize(("counted", "cool", "block"), [(10_000, 64, 2000), (1, 1, 5)])
def test_components_match_brute_force_jaccard(spark, monkeypatch, counted, cool, block):
    for name, value in (("ORDER_ROWS", counted), ("COOL", cool), ("BLOCK", block)):
        monkeypatch.setattr(shingles, name, value)
    rng, passage = np.random.default_rng(4), " ".join(f"passage{i}" for i in range(40))
    rows = list(enumerate(texts() + [f"{passage} {' '.join(f'own{k}x{i}' for i in range(rng.integers(0, 16)))}" for k in range(40)]))
    got = shingles.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == plain_components(rows) and len(got) == len(rows)


def test_stage_drops_near_copies_alone(spark):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert left == sorted(i for i, to in plain_components(rows).items() if i == to)


def test_bitmaps_of_any_lengths_never_rule_out_similar_sets(spark):
    rng, rows = np.random.default_rng(5), []
    for n in (0, 1, 500, 513, 600, 1020, 1030, 2500, 4090, 4200):
        base = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
        for share in (0.0, 0.05, 0.1, 0.2, 0.25, 1.0):
            cut = base[: len(base) - int(len(base) * share)]
            other = np.unique(np.concatenate([cut, rng.integers(-(1 << 62), 1 << 62, n if share == 1 else int(n * share / 4))]))
            shared = len(np.intersect1d(base, other))
            alike = bool(shingles.similar(shared, len(base), len(other), 0.8))
            rows.append((alike, shared, len(base), len(other), shingles.bitmap(base), shingles.bitmap(other)))
    df = spark.createDataFrame(rows, "alike boolean, shared int, a int, b int, x array<long>, y array<long>")
    may = shingles.may_be_similar(*(shingles.F.col(c) for c in "abxy"), 0.8)
    got = df.select("alike", "shared", "a", may.alias("may")).collect()
    assert all(r.may for r in got if r.alike) and sum(r.alike for r in got) > 15
    assert not any(r.may for r in got if r.a >= 500 and r.shared < 0.6 * r.a)


@pytest.mark.parametrize("weight", [16, 1])
def test_long_texts_with_one_passage_match_brute_force(spark, monkeypatch, weight):
    for name, value in (("COOL", 2), ("BLOCK", 6), ("WEIGHT", weight)):
        monkeypatch.setattr(shingles, name, value)
    rng, passage = np.random.default_rng(6), " ".join(f"p{i}" for i in range(260))
    rows = []
    for k in range(24):
        own = " ".join(f"o{k}x{i}" for i in range(rng.integers(240, 900)))
        rows += [f"{passage} {own}", f"{passage} {own} {' '.join(f'z{k}x{i}' for i in range(rng.integers(0, 250)))}"]
    rows += [f"{passage} {' '.join(f'n{k}x{i}' for i in range(rng.integers(0, 80)))}" for k in range(12)]
    rows = list(enumerate(rows))
    got = shingles.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == plain_components(rows) and len(got) == len(rows)
