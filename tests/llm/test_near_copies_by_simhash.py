"""The near-duplicates stage's SimHash step: what is within the distance is found by it, and checked."""

import numpy as np

from quarterdeck.llm import shingles, simhash


def test_fingerprints_within_the_distance_are_connected(spark):
    rng, fps = np.random.default_rng(8), []
    for _ in range(30):
        base = int(rng.integers(0, 1 << 62))
        fps += [base, base, base ^ 1, base ^ (1 << 20 | 1 << 40), base ^ 0b10111]
    rows = list(enumerate(fps))
    root = {i: i for i, _ in rows}
    near = {(i, j) for i, x in rows for j, y in rows if i < j and (x ^ y).bit_count() <= shingles.DISTANCE}
    pairs = {(r.a, r.b) for r in shingles.fingerprint_pairs(spark.createDataFrame(rows, "sid long, fp long")).collect()}
    assert {tuple(sorted(p)) for p in pairs} <= near
    for links, to in ((near, {}), (pairs, root)):
        to.update({i: i for i, _ in rows})
        for _ in rows:
            for a, b in links:
                to[a] = to[b] = min(to[a], to[b])
        want = to if links is near else want
    assert root == want


def test_the_stage_searches_by_fingerprint_and_checks(spark, monkeypatch):
    asked, plain = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda distinct, distance: asked.append(distance) or plain(distinct, distance))
    one = " ".join(f"w{i}" for i in range(60))
    rows = [(1, one), (2, one + " end"), (3, "something else of other words altogether"), (4, None)]
    got = {r.doc_id: r.component_id for r in shingles.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4} and asked == [2]
    # equal fingerprints alone don't make a link: sets are compared
    monkeypatch.setattr(simhash, "fingerprint_of", lambda hashes: 5)
    assert {r.doc_id: r.component_id for r in shingles.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == got
