import random
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quarterdeck.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", "one two", "  two  spaces ", "a\n b \nc\t d  e", "x <|endoftext|> y<|endoftext|>", "é ß 漢字 مرحبا 🙂", " ", "\n\n", "it's I'll 12 345,6 " * 3, "word nbsp 　wide", "q " * 5000]


TOKENIZER = Tokenizer.from_file(PATH)


def plain_ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def test_ids_are_those_of_the_tokenizer():
    rng = random.Random(3)
    alphabet = ["a", "B", " ", " ", "\n", "'", "s", "1", ".", "\t", "é", " ", "<|endoftext|>"]
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(40)) for _ in range(1500)]
    ids = packing.Ids(PATH)
    for t in texts:
        assert np.frombuffer(ids.encode(t or ""), "<u4").tolist() == plain_ids(t), repr(t)


def test_lower_bound_is_never_above_a_packing_and_sees_large_items():
    rng = np.random.default_rng(1)
    for _ in range(60):
        x = rng.integers(1, 101, rng.integers(1, 40))
        assert packing.lower_bound(x, 100) <= packing.best_fit(x, 100).max() + 1
    assert packing.lower_bound(np.full(7, 51), 100) == 7
    assert packing.lower_bound(np.full(9, 34), 100) == 5
    assert packing.lower_bound(np.zeros(0, int), 100) == 0


@pytest.mark.parametrize("rows", [4000, 5])
def test_every_piece_once_gapless_and_full_round_trip(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in enumerate(TEXTS + ["a b c " * k for k in range(1, 60)])] + [(2, TEXTS[2], "x", 0)], "doc_id long, text string, part string, piece int")
    got = packing.pack(packing.pieces(docs, PATH, 64), 64, rows).collect()
    seqs, by_doc = {}, {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append(r)
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 64
    texts = dict(enumerate(TEXTS + ["a b c " * k for k in range(1, 60)]))
    assert set(by_doc) == set(texts)
    for d, rs in by_doc.items():
        ids = plain_ids(texts[d]) + [0]
        want = []
        start, k = 0, 0
        stop = len(ids) % 64 or min(64, len(ids))
        while start < len(ids):
            want.append((k, start, stop - start, zlib.crc32(np.array(ids[start:stop], "<u4").tobytes())))
            start, stop, k = stop, stop + 64, k + 1
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in rs) == sorted(want * (2 if d == 2 else 1))
    assert packing.pack(packing.pieces(docs.limit(0), PATH, 64), 64).count() == 0


def test_exchange_saves_sequences_and_ends_at_the_bound(spark):
    rows = [(i, 0, 0, n, i) for i, n in enumerate([60] * 200 + [40] * 200)]
    items = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    packed = packing.pack(items, 100, 40)
    alone = packing.pack(items, 100, 40, exchange=False)
    r, before = packing.report(packed, 100).first(), packing.report(alone, 100).first()
    assert r.pieces == before.pieces == 400 and r.bound == before.bound == 200
    assert r.gap == r.sequences - 200 == packed.select("sequence_id").distinct().count() - 200
    assert 0 <= r.gap < before.gap


def test_repeated_rows_and_rows_without_id_fill_no_partition_beyond_its_share(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)
    real = packing._pack

    def counting(*args):
        run = real(*args)

        def checked(pdf):
            assert len(pdf) < 200
            seen.add(1)
            return run(pdf)

        return checked

    monkeypatch.setattr(packing, "_pack", counting)
    rows = [(None, 0, 0, 33, 5)] * 3000 + [(7, 0, 0, 34, 6)] * 3000
    items = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(3)
    got = packing.pack(items, 100, 100).collect()
    assert seen.value >= 60
    assert sorted((r.doc_id is None, r.length) for r in got) == sorted((r[0] is None, r[3]) for r in rows)
    room = {}
    for r in got:
        room.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in room.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 100


def test_numbers_of_sequences_differ_in_all_turns():
    pdf = pd.DataFrame({"doc_id": range(40), "piece": 0, "start": 0, "length": 60, "ids_crc32": 1, "sequence_id": 0})
    names, ids = [*pdf.columns, "part", "offset", "done"], set()
    for turn in range(70):
        for part in (0, 1, 5):
            own = pdf.assign(part=part, sequence_id=range(100, 140) if turn else 0)  # more than it takes, so that a turn saves
            own.loc[:, "length"] = 30
            ids |= set(packing._pack(100, turn, names, np.arange(101) / 100)(own)["sequence_id"])
    assert len(ids) == 70 * 3 * 14
