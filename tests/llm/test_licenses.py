import re

from quarterdeck.llm import licenses

NOTICE = licenses.NOTICES["bsd-notice"]


def plain(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_matches_brute_force_and_notices_survive_edits(spark):
    texts = [
        None, "", "...", "mit", "Under the MIT License", "x under-the\nMIT\tlicense. under the mit license", "under the mit licen\u017fe", "\u212aelvin under the mit license",
        "Apache License, Version 2.0; CC BY-NC 4.0 cc by nc", "cc by nc " * 3000, "the mit license under the", "under the é mit license", "0CC by nc", NOTICE.upper(),
        "intro words " + NOTICE.replace("binary", "binary or other").replace("modification", "alteration") + " end", "redistribution and use in source", "m\u0130t under the m\u0130t license",
    ]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)] + [(4, texts[4], "x", 1), (None, texts[4], "x", 1)], "doc_id long, text string, name string, pos int")
    rows = licenses.scan(docs).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        text = texts[4 if r.doc_id is None else r.doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain(text), text
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    labels = {r.doc_id: r.labels for r in rows}
    assert labels[13] == "bsd-notice" and labels[14] == "bsd-notice" and labels[15] == ""
    assert licenses.scan(docs.limit(0)).count() == 0
