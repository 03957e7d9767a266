"""Alignment of the tokens of two tokenizers, a byte-level BPE (A) and a piece BPE with byte fallback (B).

A text is tokenised whole under both. Where tokens of both end and the next of both begin with a space, the document is
split into windows of token ids; as nearly every window is a word seen before, its alignment is looked up under its two
tuples of ids. A group is what lies between two places where tokens of both end; a link is a pair of tokens whose byte
ranges overlap, so links stay within groups.

How often a pair of ids is linked in the whole corpus is counted by Spark. The counts of the most frequent pairs, up to
a fixed number, reach the documents by broadcast; the rest, each of them rare, by a shuffled join.
"""

from __future__ import annotations

import hashlib
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from .common import keep
from .packing import byte_characters

#: Windows that a worker remembers before it starts afresh.
MEMO = 300_000
#: Pairs whose counts are broadcast, at most.
HOT_PAIRS = 1 << 17
#: The mark of a space in pieces.
MARK = "\u2581"
#: The highest bit marks B's ids in a window.
SIDE = np.uint32(1 << 31)


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indices of all ranges, one after the other."""
    return np.arange(size.sum()) + np.repeat(begin - np.append(0, np.cumsum(size)[:-1]), size)


class Tokens:
    """Both tokenizers, the bytes of their tokens, and the windows seen so far."""

    made: ClassVar[dict[tuple[str, str], Tokens]] = {}

    def __init__(self, bytes_path: str, pieces_path: str):
        import json

        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(bytes_path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {x["content"] for x in spec.get("added_tokens", [])}
        of = byte_characters()
        a = {i: bytes(of[c] for c in token) for token, i in spec["model"]["vocab"].items() if token not in special}
        self.bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={x: i for i, x in a.items()}, special_tokens={})
        self.a_bytes = [a.get(i, b"") for i in range(max(a, default=-1) + 1)]
        self.spells = {x for x in self.a_bytes if len(x) == 1} == {bytes([x]) for x in range(256)}  # every text, by construction
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        self.b_bytes = []
        for i in range(self.pieces.get_piece_size()):
            piece = self.pieces.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.pieces.is_byte(i) else piece.replace(MARK, " ").encode())
        self.a_size, self.b_size = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))
        self.a_space, self.b_space = (np.array([x[:1] == b" " for x in y]) for y in (self.a_bytes, self.b_bytes))
        self.windows = Windows(self)

    @classmethod
    def of(cls, *paths: str) -> Tokens:
        """One for each worker process, kept between its tasks."""
        if paths not in cls.made:
            cls.made[paths] = cls(*paths)
        return cls.made[paths]

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """Ids of whole texts, as bytes of unsigned 32-bit numbers; none where either tokenizer's bytes aren't space+text's."""
        out = []
        for text, b in zip(texts, self.pieces.encode([t or "" for t in texts], num_threads=1), strict=True):
            a = self.bpe.encode_to_numpy(f" {text}", disallowed_special=()).tobytes() if text else b""
            ok = text and b"".join([self.b_bytes[i] for i in b]) == f" {text}".encode() and (self.spells or b"".join([self.a_bytes[i] for i in np.frombuffer(a, "<u4")]) == f" {text}".encode())
            out.append((a, np.array(b, "<u4").tobytes()) if ok else (b"", b""))
        return out


class Windows(dict):
    """A dict of the ids of a window to a number; number of groups, spelling and links stand under the number.

    A key is the window's A ids and then its B ids, these with the highest bit set, as one byte string. Links are bytes
    of 64-bit numbers, A's id in the upper half.
    """

    def __init__(self, tokens: Tokens):
        super().__init__()
        self.tokens, self.groups, self.spelt, self.links = tokens, [], [], []
        text = [str(i) for i in range(max(len(tokens.a_size), len(tokens.b_size)))]
        self.text = np.array([[x + "," for x in text], [x + "|" for x in text], [x + ";" for x in text]], dtype=object)

    def of(self, documents: list[tuple[bytes, bytes]]) -> list[list[int]]:
        """Numbers of the windows of whole documents, in order. They hold until the next call."""
        if len(self) >= MEMO:
            self.clear()
            self.groups, self.spelt, self.links = [], [], []
        a, b = (np.frombuffer(b"".join([d[k] for d in documents]), "<u4") for k in (0, 1))
        if not len(a):
            return [[] for _ in documents]
        ends_a, ends_b = np.cumsum(self.tokens.a_size[a]), np.cumsum(self.tokens.b_size[b])
        at = np.searchsorted(ends_b, ends_a)
        i = np.flatnonzero(ends_b[at] == ends_a)  # tokens of both end; the last ones always do
        j = at[i]
        anchor = np.append(self.tokens.a_space[a[i[:-1] + 1]] & self.tokens.b_space[b[j[:-1] + 1]], True)  # so do documents begin
        i, j = i[anchor] + 1, j[anchor] + 1
        size_a, size_b = np.diff(i, prepend=0), np.diff(j, prepend=0)
        both = np.empty(len(a) + len(b), "<u4")  # each window's A ids, then its B ids
        both[np.arange(len(a)) + np.repeat(j - size_b, size_a)] = a
        both[np.arange(len(b)) + np.repeat(i, size_b)] = b | SIDE
        raw, ends = both.tobytes(), (4 * (i + j)).tolist()
        keys = [raw[p:q] for p, q in zip([0, *ends], ends, strict=False)]
        every = list(map(self.get, keys))
        if new := [n for n, x in enumerate(every) if x is None]:
            first: dict[bytes, int] = {}
            for n in new:
                first.setdefault(keys[n], n)
            w = np.array(list(first.values()))
            self.add(list(first), a[_ranges((i - size_a)[w], size_a[w])], b[_ranges((j - size_b)[w], size_b[w])], np.cumsum(size_a[w]))
            for n in new:
                every[n] = self[keys[n]]
        begins = np.searchsorted(i, np.cumsum([len(d[0]) // 4 for d in documents])).tolist()
        out, begin = [], 0
        for d, last in zip(documents, begins, strict=True):
            out.append(every[begin : last + 1] if d[0] else [])
            begin = last + 1 if d[0] else begin
        return out

    def add(self, keys: list[bytes], a: np.ndarray, b: np.ndarray, last: np.ndarray) -> None:
        """Align new windows, laid one after the other; a window's A ids end before last."""
        ends_a, ends_b = np.cumsum(self.tokens.a_size[a]), np.cumsum(self.tokens.b_size[b])
        ends = np.union1d(ends_a, ends_b)  # a link ends wherever a token ends
        ia, ib = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        raw = ((a[ia].astype(np.int64) << 32) | b[ib]).tobytes()
        shared = (ends_a[ia] == ends) & (ends_b[ib] == ends)
        ga, gb = ia[shared] + 1, ib[shared] + 1
        kind_a, kind_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        kind_a[ga - 1], kind_b[gb - 1] = 1, 2
        size_a, size_b = np.diff(ga, prepend=0), np.diff(gb, prepend=0)
        text = np.empty(len(a) + len(b), object)  # each group's A ids, then its B ids
        text[np.arange(len(a)) + np.repeat(gb - size_b, size_a)] = self.text[kind_a, a]
        text[np.arange(len(b)) + np.repeat(ga, size_b)] = self.text[kind_b, b]
        text = text.tolist()
        byte = ends_a[last - 1]
        group = np.searchsorted(ends[shared], byte) + 1
        links = (8 * (np.searchsorted(ends, byte) + 1)).tolist()
        tokens = (ga + gb)[group - 1].tolist()
        n = len(self.spelt)
        self.update(zip(keys, range(n, n + len(keys)), strict=True))
        self.groups += np.diff(group, prepend=0).tolist()
        self.spelt += ["".join(text[p:q]) for p, q in zip([0, *tokens], tokens, strict=False)]
        self.links += [raw[p:q] for p, q in zip([0, *links], links, strict=False)]


#: Documents, and characters, that are aligned at once; a document is never parted.
BATCH, BATCH_CHARS = 64, 200_000


def _batches(ids, texts):
    at, rows, chars = 0, len(texts), 0
    for k in range(rows):
        chars += len(texts[k] or "")
        if k + 1 - at == BATCH or chars >= BATCH_CHARS or k + 1 == rows:
            yield ids[at : k + 1], texts[at : k + 1]
            at, chars = k + 1, 0


def aligned(docs: DataFrame, bytes_path: str, pieces_path: str, spell: bool = False) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, a, b, times) for every row of docs, and groups if to be spelt.

    a, b and times are arrays: the distinct linked pairs of ids, and how many links hold each. Rows without tokens have
    zeros and empty arrays. row numbers the rows of what is written from this, as ids may repeat.
    """

    def run(batches):
        from pyspark import TaskContext

        tokens = Tokens.of(bytes_path, pieces_path)
        windows, number = tokens.windows, TaskContext.get().partitionId() << 40
        for batch in batches:
            out = [[] for _ in kinds]
            for ids, texts in _batches(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                coded = tokens.encode(texts)
                for doc_id, (a, b), every in zip(ids, coded, windows.of(coded), strict=True):
                    pair, times = np.unique(np.frombuffer(b"".join([windows.links[w] for w in every]), np.int64), return_counts=True)
                    spelt = "".join([windows.spelt[w] for w in every])[:-1]
                    digest = hashlib.sha256(spelt.encode()).hexdigest() if every else ""
                    row = number, doc_id, len(a) // 4, len(b) // 4, sum([windows.groups[w] for w in every]), int(times.sum()), digest, pair >> 32, pair & 0xFFFFFFFF, times
                    for column, value in zip(out, (*row, spelt), strict=False):
                        column.append(value)
                    number += 1
            yield pa.RecordBatch.from_arrays([_array(c, f.type) for c, f in zip(out, kinds, strict=True)], schema=kinds)

    schema = _parse_datatype_string("row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a array<int>, b array<int>, times array<long>" + ", groups string" * spell)
    kinds = to_arrow_schema(schema)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def _array(column: list, kind: pa.DataType) -> pa.Array:
    """A column of values, or of numpy arrays."""
    if not pa.types.is_list(kind):
        return pa.array(column, kind)
    offsets = np.cumsum([0, *map(len, column)]).astype(np.int32)
    flat = np.concatenate([np.zeros(0, np.int64), *column])
    return pa.ListArray.from_arrays(offsets, pa.array(flat.astype(kind.value_type.to_pandas_dtype()), kind.value_type), type=kind)


def links(rows: DataFrame) -> DataFrame:
    """(row, a, b, times): each distinct pair of each row of aligned()."""
    return rows.select("row", F.inline(F.arrays_zip("a", "b", "times")))


def pair_counts(rows: DataFrame) -> DataFrame:
    """(a, b, count, best): links of the whole corpus by pair of ids, and if no pair of the same B id has more.

    Counted in each task before the shuffle. There is one maximum for each piece of B's vocabulary, so they are broadcast.
    """
    counts = keep(links(rows).groupBy("a", "b").agg(F.sum("times").alias("count")))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(F.broadcast(most), "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def hot_from(counts: DataFrame, most: int) -> int:
    """The count from which on pairs are at most the given number; powers of two are tried."""
    by = counts.groupBy(F.floor(F.log2(F.col("count").cast("double"))).alias("power")).agg(F.count("*").alias("n")).collect()  # 63 rows at most
    total, least = 0, 62
    for r in sorted(by, key=lambda r: -r.power):
        total += r.n
        if total > most:
            break
        least = r.power
    return 1 << least


def cross_align(docs: DataFrame, bytes_path: str, pieces_path: str, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of docs(doc_id, text).

    n_best: links whose count is the highest of their B id; count_sum: the counts of the row's links, added up. Null and
    empty texts, and those that a tokenizer doesn't spell byte by byte, have zeros and an empty hash. Rows that repeat
    are counted and returned each; ids may be null. An empty table gives no rows. Other columns are not read.
    """
    rows = keep(aligned(docs, bytes_path, pieces_path))
    counts = keep(pair_counts(rows))
    least = hot_from(counts, hot_pairs)
    hot = F.broadcast(counts.where(F.col("count") >= least))  # hot_pairs rows at most
    sums = F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum")
    found = links(rows).join(hot, ["a", "b"]).groupBy("row").agg(*sums)
    rare = counts.where(F.col("count") < least)
    found = found.unionByName(links(rows).join(hot.select("a", "b"), ["a", "b"], "left_anti").join(rare, ["a", "b"]).groupBy("row").agg(*sums))
    found = found.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = rows.drop("a", "b", "times").join(found, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
