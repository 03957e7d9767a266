import numpy as np
import pytest
import xxhash

from quarterdeck.llm import simhash


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split(" ") if text else []
    words = [w for x in words for w in x.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def plain_components(fps, distance):
    root = {i: i for i, _ in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in fps:
        for j, b in fps:
            if bin(a ^ b).count("1") <= distance:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i, _ in fps}


@pytest.mark.parametrize("text", [None, "", " \n\t", "One", "One two", "A b C d", "é É  x y z w", "the the the the the", "x " * 9000])
def test_fingerprint_is_the_majority_of_shingle_hashes(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("bucket", [2000, 40])
def test_links_lose_no_connection(spark, bucket):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64) & np.uint64(0x0FFF0FFF0FFF00FF)
    fps = {0}
    for b in base.tolist():
        for _ in range(40):
            x = b
            for j in rng.integers(0, 64, rng.integers(0, 5)).tolist():
                x ^= 1 << j
            fps.add(x)
    rows = list(enumerate(sorted(fps)))
    df = spark.createDataFrame([(simhash._signed(f), i) for i, f in rows], "fp long, node long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(df, 2, bucket)).collect()}
    assert {i: roots.get(i, i) for i, _ in rows} == plain_components(rows, 2)


def test_whole_query_on_awkward_rows(spark):
    texts = [None, "", "a b c d e f g", "A B c d e f g", "a b c d e f g", "z", "long " * 5000]
    docs = spark.createDataFrame([(i + 1, t, "x", 0, 0) for i, t in enumerate(texts)] + [(3, texts[2], "x", 0, 0), (None, "a b c d e f g", "x", 0, 0)], "doc_id long, text string, fp string, node int, path int")
    got = sorted(((r.doc_id or 0), r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    fps = [(i + 1, plain_fingerprint(t)) for i, t in enumerate(texts)]
    want = plain_components(fps, 2)
    assert got == sorted([(i, f"{f:016x}", want[i]) for i, f in fps] + [(3, f"{fps[2][1]:016x}", 3), (0, f"{fps[2][1]:016x}", 3)])
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
