"""Best-fit packing with certified bin counts.

The dual feasible function that is strongest on the lengths of all documents gives each partition its share of the
lower bound. A partition that best-fit decreasing packs into less than one sequence above its share is certified. Those
with a gap give up every document of their unfilled sequences; these are dealt anew into partitions of as many pieces, so
that the givers exchange documents, and are packed again if the bound allows fewer. A new packing is taken only where it
saves.
"""

from __future__ import annotations

import json
import logging
import re
import zlib
from typing import ClassVar

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep

#: Pieces in a partition, about.
PART_ROWS = 4000
#: A sequence's number holds its bin below BIN_BITS, its partition below TURN_BITS, and its turn, which ends at LAST_TURN.
BIN_BITS, TURN_BITS, LAST_TURN = 18, 44, (1 << 19) - 1
#: Words whose ids a worker remembers before it starts afresh, and the longest of them.
MEMO, MEMO_CHARS = 400_000, 40
#: A space beside other white space: only there may a token of a byte-level BPE reach across the space's left side.
_LOOSE = re.compile(r"\s | \s")


def byte_characters() -> dict[str, int]:
    """The byte that each printable stand-in of a byte-level vocabulary means."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Ids(dict):
    """Ids of whole texts under the byte-level BPE of a tokenizers file, as little-endian unsigned 32-bit bytes.

    A dict of words (each with the space before it) to ids: words seen before aren't encoded again.
    """

    made: ClassVar[dict[str, Ids]] = {}

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        of = byte_characters()
        ranks = {bytes(of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.special = list(special)
        self.bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    @classmethod
    def of(cls, path: str) -> Ids:
        """One for each worker process, kept between its tasks."""
        if path not in cls.made:
            cls.made[path] = cls(path)
        return cls.made[path]

    def chunk(self, text: str) -> bytes:
        ids = self.bpe.encode(text, allowed_special="all") if any(x in text for x in self.special) else self.bpe.encode_ordinary(text)
        return np.array(ids, dtype="<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        raw = self.chunk(" " + word)
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[word] = raw
        return raw

    def encode(self, text: str) -> bytes:
        if " " not in text or any(" " in x for x in self.special):
            return self.chunk(text)
        first, *words = text.split(" ")
        if _LOOSE.search(text) is None:
            return self.chunk(first) + b"".join(map(self.__getitem__, words))
        out, part, tight = [], first, bool(first) and not first[-1].isspace()
        for w in words:  # what stands beside other white space is encoded together with what is before it
            if tight and w and not w[0].isspace():
                out.append(self.chunk(part) if not part.startswith(" ") or len(part) > MEMO_CHARS else self[part[1:]])
                part = " " + w
            else:
                part += " " + w
            tight = bool(w) and not w[-1].isspace()
        return b"".join([*out, self.chunk(part)])


def pieces(docs: DataFrame, tokenizer: str, size: int = 2048, end: int = 0, batch: int = 10_000) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): every row's ids and the end id, cut only where longer than size.

    The first piece of a long document takes the remainder, so all others are full. Null and empty texts are the end
    id alone. Other columns are not read; repeated rows are packed as often as they stand.
    """
    stop = np.array([end], dtype="<u4").tobytes()

    def run(batches):
        ids, rows = Ids.of(tokenizer), []
        for b in batches:
            for d, text in zip(b["doc_id"], b["text"], strict=True):
                raw = ids.encode(text or "") + stop
                n = len(raw) // 4
                view, start, k, to = memoryview(raw), 0, 0, n % size or min(n, size)
                while start < n:
                    rows.append((d, k, start, to - start, zlib.crc32(view[4 * start : 4 * to])))
                    start, to, k = to, to + size, k + 1
                if len(rows) >= batch:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
        if rows:
            yield pd.DataFrame(rows, columns=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def bound_of(hist: np.ndarray, size: int) -> tuple[int, np.ndarray]:
    """Sequences that any packing of hist (counts by length) needs at least, and the weights by length that prove it.

    The best of three families of dual feasible functions: lengths as they are; lengths above size - k as whole and
    those below k as nothing; and lengths rounded down to m-ths of a sequence.
    """
    x = np.arange(size + 1)
    best, proof = -(-int((hist * x).sum()) // size), x / size
    n_from, sum_from = (np.append(np.cumsum(h[::-1])[::-1], 0) for h in (hist, hist * x))
    k = np.arange(1, size // 2 + 1)
    counts = n_from[size - k + 1] + -(-(sum_from[k] - sum_from[size - k + 1]) // size)
    if len(k) and counts.max() > best:
        least = int(k[counts.argmax()])
        best, proof = int(counts.max()), np.where(x > size - least, 1.0, np.where(x < least, 0.0, x / size))
    for m in range(1, 33):
        scaled = np.where((m + 1) * x % size == 0, x * m, (m + 1) * x // size * size)  # in units of 1 / (m size)
        if (n := -(-int((hist * scaled).sum()) // (m * size))) > best:
            best, proof = n, scaled / (m * size)
    return best, proof


def lower_bound(lengths: np.ndarray, size: int) -> int:
    return bound_of(np.bincount(lengths, minlength=size + 1).astype(np.int64), size)[0]


def best_fit(lengths: np.ndarray, size: int) -> np.ndarray:
    """Bin of each item, packed longest first into the fullest bin that still takes it."""
    out = np.empty(len(lengths), np.int64)
    open_, free, bins = [[] for _ in range(size + 1)], 0, 0  # bins by room left; bit r of free: some bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        fits = free >> need
        if fits:
            room = need + (fits & -fits).bit_length() - 1
            b = open_[room].pop()
            if not open_[room]:
                free &= ~(1 << room)
        else:
            room, b, bins = size, bins, bins + 1
        out[i] = b
        left = room - need
        if left:
            open_[left].append(b)
            free |= 1 << left
    return out


COLUMNS = "piece int, start long, length long, ids_crc32 long, part long, sequence_id long, offset long, done boolean"
_log = logging.getLogger(__name__)


def _pack(size: int, turn: int, names: list[str], proof: np.ndarray):
    """Packs one partition in the given turn; done: certified or full, so it stays as it is."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        lengths = pdf["length"].to_numpy()
        had = pdf["sequence_id"].nunique() if turn else len(pdf) + 1
        bound = lower_bound(lengths, size)
        if bound < had:
            bins = best_fit(lengths, size)
            if (made := int(bins.max()) + 1) < had:
                pdf["sequence_id"] = (turn << TURN_BITS) + (int(pdf["part"].iloc[0]) << BIN_BITS) + bins
                had = made
        pdf = pdf.sort_values("sequence_id", kind="stable").reset_index(drop=True)
        by = pdf.groupby("sequence_id")["length"]
        pdf["offset"] = by.cumsum() - pdf["length"]
        pdf["done"] = (by.transform("sum") == size) | (had - proof[lengths].sum() < 1 - 1e-6)
        return pdf[names]

    return run


def _lengths(items: DataFrame, size: int) -> np.ndarray:
    """How many of items have each length up to size; as many rows reach the driver."""
    counts = items.groupBy("length").count().toPandas()
    hist = np.zeros(size + 1, np.int64)
    hist[counts["length"].to_numpy(dtype=np.int64)] = counts["count"]
    return hist


def pack(items: DataFrame, size: int = 2048, part_rows: int = PART_ROWS, exchange: bool = True) -> DataFrame:
    """items(doc_id, piece, start, length, ids_crc32), each at most size, with sequence_id and offset there.

    Rows are dealt by their place in the table, so repeated rows and those without id go to as many partitions as any.
    In each turn the unfilled sequences of partitions with a gap are dealt anew, into partitions of about as many
    pieces, and packed again. Turns go on until nothing is open, all of it was in one partition, or a turn saved
    nothing; the gap that is left to the lower bound of the whole table is logged, and report() gives it.
    """
    items = keep(items.select("*", F.monotonically_increasing_id().alias("at")))
    hist = _lengths(items, size)
    bound, proof = bound_of(hist, size)
    parts = max(1, -(-int(hist.sum()) // part_rows))
    if parts > 1 << (TURN_BITS - BIN_BITS) or 2 * part_rows > 1 << BIN_BITS:
        raise ValueError("part_rows is too small or too large for the numbers of sequences")
    now = items.select("*", F.pmod(F.xxhash64("at"), F.lit(parts)).cast("long").alias("part"), F.lit(0).cast("long").alias("sequence_id")).drop("at")
    out, schema = None, f"doc_id {items.schema['doc_id'].dataType.simpleString()}, {COLUMNS}"
    names = [c.split()[0] for c in schema.split(", ")]
    closed = had = turn = 0
    while True:
        now = keep(now.groupBy("part").applyInPandas(_pack(size, turn, names, proof), schema))
        out = now.where("done") if out is None else out.unionByName(now.where("done"))
        open_ = now.where("not done")
        first = F.col("offset") == 0
        full, left, rows = now.agg(F.count_if(F.col("done") & first), F.count_if(~F.col("done") & first), F.count_if(~F.col("done"))).first()
        saved, closed = had - full - left, closed + full
        if not left or not exchange or parts == 1 or (turn and saved <= 0) or turn == LAST_TURN:
            break
        had, turn, parts = left, turn + 1, -(-rows // part_rows)
        now = open_.drop("offset", "done").withColumn("part", F.pmod(F.xxhash64("sequence_id", F.lit(turn)), F.lit(parts)).cast("long"))
    _log.info("%d pieces in %d sequences; no packing has under %d; %d turns", hist.sum(), closed + left, bound, turn + 1)
    return out.unionByName(open_).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def report(packed: DataFrame, size: int = 2048) -> DataFrame:
    """One row: pieces, sequences, the bound that no packing of these pieces is under, and the gap between the two."""
    bound = bound_of(_lengths(packed, size), size)[0]
    counts = packed.agg(F.count("*").alias("pieces"), F.count_if(F.col("offset") == 0).alias("sequences"))
    return counts.select("*", F.lit(bound).alias("bound"), (F.col("sequences") - bound).alias("gap"))


def best_fit_pack(docs: DataFrame, tokenizer: str, size: int = 2048) -> DataFrame:
    """Every document packed: pieces with their sequence and the place in it.

    Null and empty texts are the end id alone; repeated rows are packed as often as they stand, and rows without an id
    as any other. Other columns are not read, whatever their names. An empty table gives no rows.
    """
    return pack(pieces(docs, tokenizer, size), size)
