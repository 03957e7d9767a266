import re

import pytest

from quarterdeck.llm import mixing


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, free, left = {}, set(order), sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total >= most * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in over)
        free -= over
    return out


def docs_of(spark, n):
    rows = [(i, " ".join(["w"] * (1 + i * 7919 % 40)) + ("\n\u00a0" if i % 5 else ""), None if i % 11 == 0 else "hot" if i % 3 else f"s{i % 7}", "x") for i in range(n)]
    rows += [(n, None, "empty", "x"), (n + 1, "  ", "empty", "x"), (n + 2, "one", "\U0001f642", "x"), (n + 3, "one", "\uffee", "x"), (5, rows[5][1], rows[5][2], "x")] if n else []
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string, size string")


@pytest.mark.parametrize("n", [0, 3000])
def test_targets_are_met_and_reruns_agree(spark, n):
    rows, df = docs_of(spark, n)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    size = {d: len(re.findall(mixing.WORD, t or "")) for d, t, *_ in rows}
    source = {d: s for d, _, s, _ in rows}
    sizes = {}
    for d, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + size[d]
    goals, taken, largest = plain_targets(sizes), dict.fromkeys(sizes, 0), {}
    for r in got:
        s = source[r.doc_id]
        assert r.size == size[r.doc_id] and r.source_size == sizes[s] and r.target == pytest.approx(goals[s])
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[s] += r.taken
        largest[s] = max(largest.get(s, 0), r.size)
    for s in sizes:
        assert abs(taken[s] - goals[s]) <= largest[s] + 1, s
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(df.repartition(7)).collect()))


def test_longer_documents_are_taken_sooner(spark):
    df = spark.createDataFrame([(i, "w " * (4 if i % 2 else 400), "ab"[i % 4 // 2]) for i in range(4000)], "doc_id long, text string, source string")
    got = mixing.mix(df, weights=(1, 9), most=3).collect()
    share = {n: sum(r.taken > 0 for r in got if r.size == n and r.target < r.source_size) for n in (4, 400)}
    assert 0 < share[4] < share[400]


@pytest.mark.parametrize("same", [False, True])
def test_rows_without_id_and_repeated_rows_are_drawn_apart(spark, same):
    # three sources of 2,000 rows, without ids and of different texts, or all alike
    rows = [(7 if same else None, "w " * 10 + ("" if same else f"x{i}"), "abc"[i % 3]) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    size = 10 if same else 11
    goals = plain_targets(dict.fromkeys("abc", 2000 * size))
    taken = {}
    for r in got:
        taken[r.target] = taken.get(r.target, 0) + r.taken
        assert r.taken in (0, size, 2 * size, 3 * size)
    assert sorted(taken) == pytest.approx(sorted(goals.values()))
    assert all(abs(n - goal) <= size for goal, n in taken.items())
    count = lambda rows: sorted((r.target, r.taken) for r in rows)
    assert count(got) == count(mixing.mix(df.repartition(3)).collect())


def plain_selection(docs, goals):
    """Pareto order sampling of documents (draw, source, size), by the definition: the rates by bisection, ranks by sorting."""
    out = {}
    for s, goal in goals.items():
        own = [(d, n) for d, of, n in docs if of == s and n]
        expected = lambda rate, n: min(3.0, rate * 2 ** (mixing.TILT * (n.bit_length() - 1)))
        lo, hi = 0.0, 1e9
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(n * expected(mid, n) for _, n in own) < goal else (lo, mid)
        m = {d: expected(hi, n) if abs(expected(hi, n) - round(expected(hi, n))) > 1e-9 else round(expected(hi, n)) for d, n in own}
        sure = {d: int(m[d]) for d, n in own}
        left = goal - sum(sure[d] * n for d, n in own)
        odds = lambda x: x / (1 - x)
        ranked = sorted((odds(u) / odds(m[d] - sure[d]), n, d) for d, n in own if m[d] > sure[d] for u in [UNIT[d]])
        run = 0
        for _, n, d in ranked:
            if run + n / 2 > left:
                break
            run += n
            sure[d] += 1
        out |= sure
    return out


UNIT = {}


def test_selection_is_that_of_the_definition(spark):
    from pyspark.sql import functions as F

    rows = [(i, "w " * (1 + i * 7919 % 90), ["hot", "hot", "a", "b", None][i % 5]) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sized = mixing.drawn(df.select("doc_id", "source", mixing.words(F.col("text")).alias("size"), F.col("text")))
    plain = sized.withColumn("u", mixing.unit(F.col("draw"), F.lit(mixing.SEED))).collect()
    UNIT.update({r.draw: r.u for r in plain})
    sizes = {}
    for r in plain:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
    want = plain_selection([(r.draw, r.source, r["size"]) for r in plain], plain_targets(sizes))
    times = {r.doc_id: r.taken // r["size"] for r in mixing.mix(df).collect()}
    assert times == {r.doc_id: want[r.draw] for r in plain}


def test_the_order_of_rows_does_not_matter(spark):
    rows = [(i % 50, f"text {i % 50} " * (1 + i % 50 % 7), f"s{i % 3}") for i in range(1500)]
    taken = []
    for own in (rows, rows[::-1], sorted(rows, key=lambda r: (r[2], -r[0]))):
        df = spark.createDataFrame(own, "doc_id long, text string, source string").repartition(2)
        by = {}
        for r, times in [((r.doc_id, r.size, r.source_size, r.taken), 1) for r in mixing.mix(df).collect()]:
            by[r] = by.get(r, 0) + times
        taken.append(by)
    assert taken[0] == taken[1] == taken[2]
