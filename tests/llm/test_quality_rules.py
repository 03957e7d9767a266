import re

import numpy as np
import pytest

from quarterdeck.llm import quality_rules as q


def plain(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    cover = {i + k for i, x in enumerate(win) if win.count(x) > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover), len(lines)


def test_counts_match_brute_force():
    rng = np.random.default_rng(0)
    texts = [None, "", "\n \t\n", "a b c d e", "a b c d e a b c d e", "x " * 50, "é é|é b\n é\n é", "a\x1cb c", "l1\r\nl1\r\nl2\n\nl2 "]
    texts += [" ".join(rng.choice(list("ab#\n"), 60)) for _ in range(30)]
    for t in texts:
        assert q.counts(t) == plain(t), repr(t)


@pytest.mark.parametrize("x,n", [(0, 10), (3, 50), (0, 4000), (7, 4000), (50, 50), (20, 25)])
def test_binomial_bound_is_exact(x, n):
    from math import comb

    p = q.binomial_upper(x, n, 0.01)
    if x == n:
        assert p == 1
    else:
        assert sum(comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(x + 1)) == pytest.approx(0.01, rel=1e-6)


def test_cutoffs_keep_the_risk_and_reject_junk(spark):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(500)]
    good = [" ".join(rng.choice(words, 40)) for _ in range(2500)]
    bad = [" ".join(x + "***" for x in rng.choice(words, 40)) for _ in range(300)]
    rows = [(i, t, "en", 1) for i, t in enumerate(good + bad)] + [(9000, None, None, 1), (9001, good[0] + " ***", "xx", 1), (9002, "a b " * 40000, "en", 1), (0, good[0], "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, rule int")
    labels = spark.createDataFrame([(i, int(i < 2500)) for i in range(2800)], "doc_id long, quality int")
    got = q.judge(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(x[1] for x in rows if x[0] == r.doc_id)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (plain(text) if r.doc_id != 9002 else q.counts(text))[:5]
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept)
    by = {r.doc_id: r for r in got}
    assert np.mean([by[i].kept for i in range(2500)]) >= 0.98
    assert not any(by[i].kept for i in range(2500, 2800)) and by[9001].kept and not by[9000].kept
    assert q.judge(docs.limit(0), labels).count() == 0
    assert all(r.kept != r.base_failed for r in q.judge(docs, labels.limit(0)).collect())
