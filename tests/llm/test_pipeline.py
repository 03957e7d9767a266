import json

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from quarterdeck.llm import mixing, secrets
from quarterdeck.llm.common import keep, table

DIR = "/root/testdata/sf0.001"


def test_stages_hand_on_what_they_keep(spark):
    docs, kept = table(spark, DIR, "documents"), []
    first = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in p.STAGES:
        out = keep(stage(spark, docs, DIR))
        if name != "pack":
            assert out.columns == list(p.COLUMNS) and dict(out.dtypes) == {c: t for c, t in docs.dtypes if c in p.COLUMNS}
        kept.append((name, docs, out))
        docs = out
    labels = {r.doc_id: r.quality for r in table(spark, DIR, "labels").collect()}
    got = {name: out for name, _, out in kept}
    good = {r.doc_id for r in got["quality"].collect()}
    assert all(d in good for d, q in labels.items() if q == 1 and d in first)
    once = [r.doc_id for r in got["near_duplicates"].select("doc_id").collect()]
    assert len(once) == len(set(once)) and set(once) <= good
    masked = got["secret_scan"].collect()
    assert {r.doc_id for r in masked} == set(once)
    for r in masked:
        assert not secrets.base_spans(r.text or "") and r.n_chars == (len(r.text) if r.text is not None else None)
        assert secrets.base_spans(first[r.doc_id] or "") or r.text == first[r.doc_id] or secrets.MASK in r.text
    plan = {r.doc_id: r for r in mixing.mix(got["secret_scan"]).collect()}
    times = {r.doc_id: r["count"] for r in got["mix"].groupBy("doc_id").count().collect()}
    assert all(times.get(d, 0) * r.size == r.taken for d, r in plan.items())
    pieces = got["pack"].collect()
    assert {r.doc_id for r in pieces} == set(times)
    used = {}
    for r in pieces:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= 2048
    assert sum(r.piece == 0 for r in pieces) == sum(times.values())


NOISE = [f"w{i * 7919 % 997}" for i in range(400)]
ODD = [
    (1, None, "en", "web", None), (2, "", "en", "web", 0), (3, "  ", None, None, 2), (None, "lone text of few words", "en", "web", 22), (None, "another text without a name", "en", None, 27),
    (4, " ".join(NOISE[:60]), "en", "web", 1), (4, " ".join(NOISE[100:160]), "en", "books", 1), (4, " ".join(NOISE[100:160]), "en", "books", 1), (5, " ".join(NOISE[:59] + ["changed"]), "en", "web", 1),
    (6, "word " * 60_000, "en", "web", 300_000), (7, "password=abcdefghijkl0 end", None, "web", 26),
]


def odd(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("y", "k", "size", "copies", "draw", "component_id", "part", "piece", "label", "of"):
        docs = docs.withColumn(name, F.lit("clash"))
    return docs


@pytest.mark.parametrize("name", [name for name, _ in p.STAGES])
def test_stages_take_odd_rows_and_empty_tables(spark, tmp_path, name):
    stage = dict(p.STAGES)[name]
    labels = [(i, int(i % 2), 0) for i in range(1, 8)] + [(None, 1, 0), (4, None, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = odd(spark, ODD)
    out = stage(spark, docs, str(tmp_path))
    rows = out.collect()
    if name != "pack":
        assert out.columns == list(p.COLUMNS)
    assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0
    ids = [r.doc_id for r in rows]
    texts = {(d, t) for d, t, *_ in ODD}
    if name == "quality":
        assert {(r.doc_id, r.text) for r in rows} <= texts
        same = [r for r in rows if r.doc_id == 4 and r.source == "books"]
        assert len(same) in (0, 2)
    elif name == "near_duplicates":
        assert ids.count(4) == 1 and 5 not in ids and ids.count(None) == 2
        assert len({1, 2, 3} & set(ids)) == 1 and {6, 7} <= set(ids)
    elif name == "secret_scan":
        assert len(rows) == len(ODD)
        by = {r.doc_id: r for r in rows}
        assert by[7].text == "<secret> end" and by[7].n_chars == 12 and by[1].text is None and by[1].n_chars is None and by[2].n_chars == 0
        assert by[6].text == "word " * 60_000
    elif name == "mix":
        assert {(r.doc_id, r.text) for r in rows} <= texts and not {1, 2, 3} & set(ids)
        assert max(json.dumps(list(r)) and rows.count(r) for r in rows) <= 6  # at most three of each of two equal rows
    else:
        assert sum(r.piece == 0 for r in rows) == len(ODD) and {r.doc_id for r in rows} == {d for d, *_ in ODD}
