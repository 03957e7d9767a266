import math
from collections import Counter

import numpy as np
import pandas as pd

from quarterdeck.llm import langid


def model_of(texts):
    """A model of {language: text}, counted here."""
    rows = []
    for lang, text in texts.items():
        h = langid.gram_hashes(langid.codes(text))
        for n in range(1, langid.ORDER + 1):
            gram, first, count = np.unique(h[n - 1], return_index=True, return_counts=True)
            ctx = h[n - 2][first] if n > 1 else np.zeros(len(first), np.uint64)
            low = h[n - 2][first + 1] if n > 1 else np.zeros(len(first), np.uint64)
            rows.append(pd.DataFrame({"lang": lang, "n": n, "gram": gram.view(np.int64), "ctx": ctx.view(np.int64), "low": low.view(np.int64), "c": count}))
    return langid._model(pd.concat(rows), sorted(texts))


def plain(text):
    """p(last character of gram after those before it), as the textbook has it."""
    s, d = [chr(int(x)) for x in langid.codes(text)], langid.DISCOUNT
    raw = {n: Counter("".join(s[i : i + n]) for i in range(len(s) - n + 1)) for n in range(1, langid.ORDER + 1)}
    seen = {n: raw[n] if n == langid.ORDER else Counter(g[1:] for g in raw[n + 1]) for n in raw}

    def p(gram):
        n = len(gram)
        own = {g: k for g, k in seen[n].items() if g[:-1] == gram[:-1]}
        below = 1 / langid.ALPHABET if n == 1 else p(gram[1:])
        total = sum(own.values())
        return (max(own.get(gram, 0) - d, 0) + d * len(own) * below) / total if total else below

    return p


TEXTS = {"x": "abracadabra cab bad arc abba", "y": "the cat sat on the mat abra", "z": "\u0434\u0430 \u043d\u0435\u0442"}


def of(s):
    return np.array([ord(x) for x in s], np.uint64)


def test_scorer_is_plain_kneser_ney_for_seen_and_unseen_n_grams():
    model, letters = model_of(TEXTS), sorted({*"".join(TEXTS.values()), "q", "\U0001f642"})
    rng = np.random.default_rng(3)
    lines = ["".join(rng.choice(letters, n)) for n in (2, 3, 4, 5, 9, 40) for _ in range(20)]
    for j, lang in enumerate(sorted(TEXTS)):
        p = plain(TEXTS[lang])
        for line in lines:
            want = sum(math.log(p(line[max(i - langid.ORDER + 1, 0) : i + 1])) for i in range(1, len(line)))
            assert math.isclose(model.log_probability(of(line))[j], want, rel_tol=1e-9), (lang, line)


def test_mass_after_every_context_is_one():
    model, letters = model_of(TEXTS), sorted({*"".join(TEXTS.values())})
    for context in ["a", "ab", "abr", "cad", "bra", "the", "zzz", "q", " ", "at ", "\u043d\u0435"]:
        skip = len(context)
        each = np.array([np.exp(model.log_probability(of(context + x), skip)) for x in [*letters, "\u4e00"]])
        mass = each[:-1].sum(axis=0) + each[-1] * (langid.ALPHABET - len(letters))
        assert np.allclose(mass, 1, rtol=1e-9), context


def test_long_texts_are_read_whole_and_in_chunks_alike(monkeypatch):
    rng = np.random.default_rng(1)
    text = "".join(rng.choice(list("abcd efg\u00e9"), 5000))
    model = model_of({"x": text[:2000], "y": text[1500:]})
    whole = model.entropies(text)
    for size in (1, 2, 3, 700):
        monkeypatch.setattr(langid, "CHUNK", size)
        assert np.allclose(whole, model.entropies(text))


def test_letters_are_those_of_unicode():
    for t in ["\u00b2", "\u00bd", "12 34", "_", "", None, "\u2167", "\U0001f642"]:
        assert not langid.has_letter(t)
    for t in ["\u00aa", "\u05d0", "1a", "\u4e00", "\U00020000"]:
        assert langid.has_letter(t)


def test_held_out_accuracy_and_odd_rows(spark):
    rng = np.random.default_rng(4)
    parts = {"aa": ["the", "and", "ing", "tion"], "bb": ["der", "und", "sch", "ung"], "cc": ["que", "eau", "les", "oux"]}
    rows = [(i, " ".join("".join(rng.choice(parts[k], 2)) for _ in range(30)), k, "x", 0.0) for i, k in enumerate(rng.choice(list(parts), 300).tolist())]
    rows += [(300, None, "aa", "x", 0.0), (301, "", None, "x", 0.0), (302, "12 34 ! \u00b2", "bb", "x", 0.0), (303, "the andtion " * 30_000, None, "x", 0.0), (5, rows[5][1], rows[5][2], "x", 0.0), (None, rows[5][1], None, "x", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")
    got = langid.predict(docs).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in rows}
    for r in got:
        assert 0 <= r.score <= 1
        if r.doc_id is not None and r.doc_id < 300 and r.held_out:
            assert r.lang_pred == truth[r.doc_id]
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (300, 301, 302, 303)] == ["und", "und", "und", "aa"]
    assert langid.predict(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.predict(docs.where("lang is null")).collect()} == {"und"}


def test_no_language_is_lost_to_repeated_or_long_texts(spark):
    rng = np.random.default_rng(6)
    word = lambda parts: "".join(rng.choice(parts, 2))
    english, german, french = ["the", "and", "ing", "tion"], ["der", "und", "sch", "ung"], ["que", "eau", "les", "oux"]
    text = lambda parts, n: " ".join(word(parts) for _ in range(n))
    one = text(german, 60)
    rows = [(text(english, 30), "en") for _ in range(200)] + [(one, "de")] * 3000 + [(text(french, 40_000), "fr")] + [(text(french, 30), "fr") for _ in range(100)]
    docs = spark.createDataFrame([(5 * i + 1, t, k, "x") for i, (t, k) in enumerate(rows)], "doc_id long, text string, lang string, source string")
    model = langid.learn(docs, 60, 300_000)
    assert model.languages == ["de", "en", "fr"] and (model.floor > np.log(1e-12)).all()
    asked = spark.createDataFrame([(1, one), (2, text(english, 30)), (3, text(french, 30))], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.identify(asked, model).collect()} == {1: "de", 2: "en", 3: "fr"}
    none = langid.predict(docs.withColumn("lang", langid.F.lit(None).cast("string")).limit(20)).collect()
    assert len(none) == 20 and {r.lang_pred for r in none} == {"und"}
