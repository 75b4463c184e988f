"""Best-fit packing by best-two-fit on the histogram of piece lengths.

A document is its token ids and one closing id. Longer ones than a sequence are cut; the first piece takes the remainder,
the others are full. Only the number of pieces of each length (at most `size` rows, whatever the input) reaches the driver.
There a sequence is filled greedily with the longest pieces that fit; then its smallest piece is replaced by two unpacked
ones if a pair fits the gap, widened by that piece, more tightly. The same filling is repeated as often as the counts allow,
so there are at most about as many distinct fillings as lengths. Pieces of one length are interchangeable: each has a rank
among them, by the place of its partition and its place therein, and the rank tells its sequence.

Defined cases: a null or empty text is the closing id alone; repeated rows and null ids are packed like any other row; an
empty table gives no row; input columns of any name pass through `pieces`.
"""

from __future__ import annotations

import base64
import os
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SEQUENCE, CLOSING, TOKENIZER = 2048, 0, "byte_bpe_50k.json"
SPECIAL = "<|endoftext|>"


class Encoder:
    """Ids of texts by a tokenizers file. Where the same vocabulary lies beside it as ranks, those give the same ids in a
    fifth of the time; texts with the special token's string, or that the rank encoder can't split, take the file itself."""

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import tiktoken

        self.path, self.file = path or public_tokenizers.path(TOKENIZER), None
        if os.path.exists(ranks := f"{os.path.splitext(self.path)[0]}.tiktoken"):
            with open(ranks, "rb") as f:
                known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={})
        else:
            self.fast = None

    def slow(self, text: str) -> list[int]:
        if self.file is None:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            self.file = Tokenizer.from_file(self.path)
        return self.file.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str) -> list[int]:
        if self.fast is None or SPECIAL in text:
            return self.slow(text)
        try:
            return self.fast.encode_ordinary(text)
        except (ValueError, RuntimeError):
            return self.slow(text)


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: the first takes what full pieces leave."""
    head = n % size or size
    return [(0, head), *((s, size) for s in range(head, n, size))]


def fill(counts: dict[int, int], size: int) -> list[tuple[dict[int, int], int]]:
    """Fillings (pieces by length) and how often each is used, until no piece is left."""
    left, out = {k: v for k, v in counts.items() if v}, []
    lengths = sorted(left)

    def largest(room: int, held: dict[int, int], below: int = 0) -> int:
        """The longest unpacked length of at most `room`, 0 if none."""
        i = bisect_right(lengths, room) - 1
        while i >= 0 and lengths[i] > below:
            if left[lengths[i]] > held.get(lengths[i], 0):
                return lengths[i]
            i -= 1
        return 0

    while lengths:
        held: dict[int, int] = {}
        room = size
        while x := largest(room, held):
            take = min(room // x, left[x] - held.get(x, 0))
            held[x] = held.get(x, 0) + take
            room -= take * x
        if room and (small := min(held)):
            gap, best = room + small, (small, 0, 0)
            held[small] -= 1
            for a in lengths[: bisect_right(lengths, gap)]:
                if left[a] > held.get(a, 0):
                    held[a] = held.get(a, 0) + 1
                    b = largest(gap - a, held)
                    held[a] -= 1
                    if b and a + b > best[0]:
                        best = (a + b, a, b)
            for x in (best[1:] if best[1] else (small,)):
                held[x] = held.get(x, 0) + 1
        held = {k: v for k, v in held.items() if v}
        times = min(left[k] // v for k, v in held.items())
        out.append((held, times))
        for k, v in held.items():
            left[k] -= v * times
        if any(not left[k] for k in held):
            lengths = [k for k in lengths if left[k]]
    return out


def slots(fillings: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, pieces of it in a sequence, first sequence, offset of its first piece), a row for each length of a filling."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for held, times in fillings:
        at = 0
        for x in sorted(held, reverse=True):
            rows.append((x, rank.get(x, 0), held[x], sequence, at))
            rank[x] = rank.get(x, 0) + held[x] * times
            at += held[x] * x
        sequence += times
    return sorted(rows)


def _pieces(where: int, keep: list[int], names: list[str], tokenizer: str | None, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = Encoder(tokenizer), TaskContext.get().partitionId(), {}
        for batch in batches:
            for a, b in C.text_chunks(batch.column(where)):
                rows: list[tuple] = []
                for i, text in enumerate(batch.column(where).slice(a, b - a).to_pylist()):
                    ids = np.array([*(encode(text) if text else ()), CLOSING], dtype="<u4")
                    for k, (start, length) in enumerate(cut(len(ids), size)):
                        seen[length] = seen.get(length, -1) + 1
                        rows.append((a + i, k, start, length, zlib.crc32(ids[start : start + length]), part, seen[length]))
                at, *made = (pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True))
                yield pa.RecordBatch.from_arrays([*(batch.column(j).take(at) for j in keep), *made], names=[*names, "piece", "start", "length", "ids_crc32", "__part", "__rank"])

    return run


def pieces(docs: DataFrame, text_col: str, keep: list[str], tokenizer: str | None = None, size: int = SEQUENCE) -> DataFrame:
    """The pieces of every document, with the partition and the place of each among those of its length there."""
    names = [f"__{i}" for i in range(len(keep))]
    df = docs.select(F.col(text_col).alias("__text"), *(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)))
    out = C.with_fields(df.select(*names), piece="int", start="long", length="long", ids_crc32="long", __part="int", __rank="long")
    return df.mapInArrow(_pieces(0, list(range(1, len(keep) + 1)), names, tokenizer, size), out)


def _place(table: list[tuple[int, int, int, int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, many, sequence, offset = np.array(table, dtype=np.int64).reshape(-1, 5).T
        at = np.searchsorted(length, np.arange(int(length.max(initial=0)) + 2))
        for batch in batches:
            n, rank = (batch.column(batch.schema.get_field_index(x)).to_numpy() for x in ("length", "__rank"))
            row = np.empty(len(n), dtype=np.int64)
            for x in np.unique(n):
                own = n == x
                row[own] = at[x] + np.searchsorted(first[at[x] : at[x + 1]], rank[own], side="right") - 1
            k = rank - first[row]
            cols = [c for c, name in zip(batch.columns, batch.schema.names, strict=True) if name not in ("__part", "__rank", "__before")]
            names = [name for name in batch.schema.names if name not in ("__part", "__rank", "__before")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sequence[row] + k // many[row]), pa.array(offset[row] + k % many[row] * n)], names=[*names, "sequence_id", "offset"])

    return run


def packed(cut_: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """Adds sequence_id and offset to written pieces."""
    by_part = C.written(cut_.groupBy("length", "__part").agg(F.count("*").alias("__n")), "counts")
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("__n").alias("n")).collect()}  # at most `size` rows
    from pyspark.sql import Window as W

    before = by_part.select("length", "__part", (F.sum("__n").over(W.partitionBy("length").orderBy("__part")) - F.col("__n")).alias("__before"))
    ranked = C.looked_up(cut_, C.written(before, "before"), ["length", "__part"]).withColumn("__rank", F.col("__rank") + F.col("__before")).drop("__before", "__part")
    ranked = ranked.select(*(c for c in cut_.columns if c != "__part"))
    return ranked.mapInArrow(_place(slots(fill(counts, size))), C.with_fields(ranked.drop("__rank"), sequence_id="long", offset="long"))


def pack(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, tokenizer: str | None = None, size: int = SEQUENCE) -> DataFrame:
    """Pieces of docs with the columns in `keep` (by default doc_id), packed into sequences of at most `size` ids."""
    keep = ["doc_id"] if keep is None else keep
    out = packed(C.written(pieces(docs, text_col, keep, tokenizer, size), "pieces"), size)
    return out.select(*(F.col(f"__{i}").alias(c) for i, c in enumerate(keep)), *out.columns[len(keep) :])


def op5_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, packed."""
    return pack(docs)
