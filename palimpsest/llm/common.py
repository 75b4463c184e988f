"""Pieces that the corpus operators share: folds, written tables, checked broadcasts and vectorised word hashing.

Words are maximal runs of bytes that are not ASCII white space, after Unicode lower-casing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import scratch, shared_dir, written

__all__ = ["scratch", "shared_dir", "written"]

#: Bytes of files up to which a written table may be broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 16 << 20
#: Bytes of text that one vectorised step holds at a time.
CHUNK_BYTES = 1 << 20

U64 = np.uint64
_GOLD, _M1, _M2 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def few(df: DataFrame) -> DataFrame:
    """df in at most three tasks for each core, for a light table that is written. A file of Hadoop's local file system takes several
    child processes of an executor, and each of them shares the executor's memory, and is counted with it, until it runs its program."""
    return df.coalesce(3 * df.sparkSession.sparkContext.defaultParallelism)


def apart(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """df with its columns named by their places, so that no column of its own clashes with an operator's, and its names."""
    return df.toDF(*(f"_{i}" for i in range(len(df.columns)))), df.columns


def together(df: DataFrame, names: list[str], *more: str) -> DataFrame:
    """The columns of a table set apart under their own names again, and further ones."""
    return df.select(*(f"_{i}" for i in range(len(names))), *more).toDF(*names, *more)


def at(df: DataFrame, name: str) -> str:
    """The name that a column has once its table is set apart."""
    return f"_{df.columns.index(name)}"


def with_fields(df: DataFrame, **more: str) -> T.StructType:
    """The schema of df and more fields, given as SQL types."""
    out = T.StructType(list(df.schema.fields))
    for name, kind in more.items():
        out = out.add(name, T.DataType.fromDDL(kind))
    return out


def looked_up(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", most: int = BROADCAST_BYTES) -> DataFrame:
    """big joined to small, a written table; small is broadcast only if its files stay within the bound in bytes."""
    size = small._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return big.join(F.broadcast(small) if int(str(size)) <= most else small, keys, how)


def held_out(doc_id: Column | str) -> Column:
    """True for the fold that no model learns from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 3 == 1, F.lit(False))


def unit(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 of the parts' texts; SQL engines other than Spark can repeat it."""
    text = F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def step(n: int) -> np.uint64:
    """The n-th of a sequence of odd-looking constants."""
    return U64(n * 0x9E3779B97F4A7C15 & (1 << 64) - 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> U64(30))) * _M1
    x = (x ^ (x >> U64(27))) * _M2
    return x ^ (x >> U64(31))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n + 1, base, dtype=U64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = mix(np.arange(1, 257, dtype=U64) * _GOLD) | U64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_POW: list[np.ndarray] = [np.ones(1, dtype=U64), np.ones(1, dtype=U64)]


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span of raw, equal for equal bytes wherever they stand."""
    n = len(raw)
    if len(_POW[0]) <= n:
        size = max(n, CHUNK_BYTES)
        _POW[:] = [_powers(size, _BASE), _powers(size, pow(_BASE, -1, 1 << 64))]
    sums = np.zeros(n + 1, dtype=U64)
    np.cumsum(_TABLE[raw] * _POW[0][:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _POW[1][starts] + (ends - starts).astype(U64))


def text_chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of about `most` bytes; a longer text makes a range of its own."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    total = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(total, total[a] + most, side="right")) - 1)
        yield a, min(b, len(sizes))
        a = b


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of the texts end to end, and where each begins; null counts as empty."""
    flat = pc.fill_null(texts.cast(pa.large_string()), "")
    flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
    offsets = np.frombuffer(flat.buffers()[1], dtype=np.int64)[flat.offset : flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, dtype=np.int64)
    data = flat.buffers()[2] if len(flat) else None
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(raw: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word; no word crosses from one text into the next."""
    if not len(raw):
        return (np.zeros(0, dtype=np.int64),) * 3
    inside = ~_SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = begins[:-1][begins[:-1] < len(raw)]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(begins, starts, side="right") - 1
