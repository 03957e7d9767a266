"""The alignment of two tokenizers against the definition, on token ids that the tokenizers' own encoders give."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quarterdeck.llm import alignment

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokens():
    return alignment.Tokens.of(*PATHS)


def _ids(tokens, text):
    whole = Tokenizer.from_file(PATHS[0])
    whole.encode_special_tokens = True
    a, b = whole.encode(" " + text, add_special_tokens=False).ids, tokens.pieces.encode(text)
    spelt = [b"".join(of[i] for i in ids) for of, ids in ((tokens.a_bytes, a), (tokens.b_bytes, b))]
    return (a, b) if text and spelt[0] == spelt[1] == (" " + text).encode() else ([], [])


def _ranges(ids, of):
    out, at = [], 0
    for i in ids:
        out.append((at, at := at + len(of[i]), i))
    return out


def _brute(tokens, text):
    a, b = (_ranges(ids, of) for ids, of in zip(_ids(tokens, text), (tokens.a_bytes, tokens.b_bytes), strict=True))
    links = [(x[2], y[2]) for x in a for y in b if x[0] < y[1] and y[0] < x[1]]
    groups, begin = [], 0
    for end in sorted({x[1] for x in a} & {y[1] for y in b}):
        groups.append("|".join(",".join(str(x[2]) for x in side if begin < x[1] <= end) for side in (a, b)))
        begin = end
    return a, b, groups, links


ODD = [
    None, "", " ", "  a", "a  b", "a ", "a \n", "\n a b", "a▁b", "<s>x</s> <|endoftext|>", "café é 日本語 \U0001f600 　x", "\x00 \x1c a", "12345 don't x_y--z \t\t q",
    "the same words the same words", "the same words the same words", "Unbelievably, antidisestablishmentarianism isn't internationalised." * 3, "a" * 300, "lorem ipsum dolor " * 20_000,
]


@pytest.mark.parametrize("hot", [alignment.HOT_PAIRS, 8, 0])
def test_counts_and_groups(spark, tokens, hot):
    rows = [(i, t, i) for i, t in enumerate(ODD)] + [(13, ODD[13], 0), (13, "another text", 0), (None, "no id", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a long").repartition(3)
    short = [(i, t) for i, t, _ in rows if len(t or "") < 10_000]
    brute = {(i, t): _brute(tokens, t or "") for i, t in short}
    long = ODD[-1]
    unit = _brute(tokens, "lorem ipsum dolor " * 3)
    count = Counter(p for i, t in short for p in brute[i, t][3])
    # the long text repeats its words: from its second on, each adds the same links
    one, two = (Counter(_brute(tokens, "lorem ipsum dolor " * k)[3]) for k in (2, 3))
    extra = Counter(two)
    for p, n in (two - one).items():
        extra[p] += n * (20_000 - 3)
    assert unit[3]
    count.update(extra)
    best = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    got = alignment.cross_align(docs, *PATHS, hot_pairs=hot).collect()
    assert len(got) == len(rows)
    want = Counter()
    for i, t in short:
        a, b, groups, links = brute[i, t]
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        want[i, len(a), len(b), len(groups), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), digest] += 1
    assert Counter(tuple(r) for r in got if r.doc_id != len(ODD) - 1) == want
    (r,) = [r for r in got if r.doc_id == len(ODD) - 1]
    assert r.n_links == sum(extra.values()) and r.count_sum == sum(n * count[p] for p, n in extra.items())
    assert r.n_best == sum(n for p, n in extra.items() if count[p] == best[p[1]])
    assert (r.n_a, r.n_b) == tuple(len(x) for x in (tokens.bpe.encode_ordinary(" " + long), tokens.pieces.encode(long)))


def test_spelt_groups_and_memo(spark, tokens, monkeypatch):
    monkeypatch.setattr(alignment, "MEMO", 3)
    own = alignment.Tokens(*PATHS)
    for at in range(0, len(ODD) - 1, 4):
        texts = ODD[:-1][at : at + 4]
        coded = own.encode(texts)
        for t, every in zip(texts, own.windows.of(coded), strict=True):
            assert "".join(own.windows.spelt[w] for w in every)[:-1] == ";".join(_brute(tokens, t or "")[2])
    rows = alignment.aligned(spark.createDataFrame([(1, "two words")], "doc_id long, text string"), *PATHS, spell=True).collect()
    assert rows[0].groups == ";".join(_brute(tokens, "two words")[2]) and rows[0].n_groups == 2


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.cross_align(docs, *PATHS).count() == 0
    nulls = alignment.cross_align(spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string"), *PATHS).collect()
    assert {tuple(r)[1:] for r in nulls} == {(0, 0, 0, 0, 0, 0, "")}
