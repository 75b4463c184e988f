"""Media columns: texts stored as images in archives, read back by a Spark data source.

Each payload (UTF-8 bytes, zeros up to a positive multiple of 64) is stored losslessly as the 8-bit grey samples of a PNG of
64 rows, a member of an uncompressed ZIP archive in the folder that driver and executors share. The data source
`media_archive` plans byte ranges over the archives' sizes alone; a reader takes the members of the archive's directory whose
headers begin in its range, streams them in Arrow batches, checks each member's CRC and, where a read fails, opens the
archive again and retries that member at its offset. An archive is written under another name and then moved, so that a task
that runs again replaces it.

Defined cases: a null text counts as empty (64 zeros); ids are kept as text in the member's name, so null and repeated ids
stay; an empty table gives no archive and no row; equal texts have equal stored forms; other columns are not stored.
"""

from __future__ import annotations

import io
import json
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import common as C

UNIT, ROWS = 64, 64
#: An archive is closed when it holds this many bytes; a range of it is one partition, a longer one where there would be more
#: than PARTITIONS of them; a batch is sent at its size.
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES, TRIES, PARTITIONS = 1 << 30, 8 << 20, 4 << 20, 4, 50_000
LISTED = "archives.json"
SCHEMA = "member string, offset long, n_bytes long, payload binary, media binary, feature string"
_PNG = b"\x89PNG\r\n\x1a\n"


def payload(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + bytes(max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw)), len(raw)


def encode(data: bytes, n: int) -> bytes:
    """A PNG of 64 rows of 8-bit grey samples; n, the bytes before padding, is noted in it."""
    width = len(data) // ROWS
    rows = np.zeros((ROWS, width + 1), dtype=np.uint8)
    rows[:, 1:] = np.frombuffer(data, dtype=np.uint8).reshape(ROWS, width)
    out = [_PNG]
    for kind, body in ((b"IHDR", struct.pack(">IIBBBBB", width, ROWS, 8, 0, 0, 0, 0)), (b"tEXt", b"Bytes\0%d" % n), (b"IDAT", zlib.compress(rows, 1)), (b"IEND", b"")):
        out += [struct.pack(">I", len(body)), kind, body, struct.pack(">I", zlib.crc32(kind + body))]
    return b"".join(out)


def decode(png: bytes) -> tuple[np.ndarray, int]:
    """Samples (64 by width) and the number of bytes before padding."""
    at, n, width, data = len(_PNG), 0, 0, []
    while at < len(png):
        size, kind = struct.unpack(">I", png[at : at + 4])[0], png[at + 4 : at + 8]
        body = png[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width = struct.unpack(">I", body[:4])[0]
        elif kind == b"tEXt" and body.startswith(b"Bytes\0"):
            n = int(body[6:])
        elif kind == b"IDAT":
            data.append(body)
        at += size + 12
    rows = np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8).reshape(ROWS, width + 1)
    if rows[:, 0].any():
        raise ValueError("only unfiltered rows are written here")
    return rows[:, 1:], n


def feature(samples: np.ndarray) -> str:
    """One bit a row, set where it is brighter than the whole, then mean and deviation of the samples."""
    sums = samples.sum(axis=1, dtype=np.int64)
    bits = np.packbits(sums * ROWS > sums.sum()).tobytes().hex()
    return f"{bits}:{samples.mean():.3f}:{samples.std(dtype=np.float64):.3f}"


class _Counted(io.RawIOBase):
    """A stream that tells how much went into it and cannot be wound back."""

    def __init__(self, out):
        self.out, self.size = out, 0

    def writable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return False

    def write(self, data) -> int:
        self.out.write(bytes(data))
        self.size += len(data)
        return len(data)


def _archived(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, root = fs.FileSystem.from_uri(folder)
        part, count, closed, now = TaskContext.get().partitionId(), 0, [], None

        def close() -> None:
            nonlocal now
            if now is not None:
                name, stream, archive = now
                archive.close()
                stream.out.close()
                closed.append((name, stream.size))
                now = None

        for batch in batches:
            for a, b in C.text_chunks(batch.column(1)):
                for name, text in zip(batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_pylist(), strict=True):
                    if now is None:
                        path = f"part-{part:06d}-{len(closed):05d}-{uuid.uuid4().hex}.zip"
                        stream = _Counted(place.open_output_stream(f"{root}/{path}"))
                        now = path, stream, zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED)
                    now[2].writestr(zipfile.ZipInfo(f"{count:09d}-{'null' if name is None else name}.png"), encode(*payload(text)))
                    count += 1
                    if now[1].size >= ARCHIVE_BYTES:
                        close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in closed], pa.string()), pa.array([z for _, z in closed], pa.int64())], names=["name", "size"])

    return run


def archive(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> str:
    """Writes the archives of every text and the list of them, and returns their folder."""
    folder = f"{C.shared_dir(docs.sparkSession)}/palimpsest/media-{uuid.uuid4().hex}"
    folder = folder if "://" in folder else folder.removeprefix("file:")
    place, root = fs.FileSystem.from_uri(folder)
    place.create_dir(root, recursive=True)
    made = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInArrow(_archived(folder), "name string, size long").collect()  # a row for each archive of up to 1 GB
    with place.open_output_stream(f"{root}/{LISTED}") as out:
        out.write(json.dumps(sorted([r.name, r.size] for r in made)).encode())
    return folder


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    end: int


class ArchiveReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[ByteRange]:
        place, root = fs.FileSystem.from_uri(self.folder)
        with place.open_input_file(f"{root}/{LISTED}") as listed:
            files = json.loads(listed.read())
        step = max(RANGE_BYTES, -(-sum(size for _, size in files) // PARTITIONS))
        return [ByteRange(f"{root}/{name}", at, min(at + step, size)) for name, size in files for at in range(0, size, step)] or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        place, _ = fs.FileSystem.from_uri(self.folder)
        members = _retried(lambda: directory(place, partition))
        source = None
        rows: list[tuple] = []
        size = 0

        def one(offset: int, length: int, crc: int) -> bytes:
            nonlocal source
            try:
                source = source or place.open_input_file(partition.path)
                return member(source, offset, length, crc)
            except Exception:
                source = None  # the next try opens the archive anew
                raise

        for offset, name, length, crc in members:
            media = _retried(lambda at=(offset, length, crc): one(*at))
            samples, n = decode(media)
            data = samples.tobytes()
            rows.append((name, offset, n, data, media, feature(samples)))
            size += len(data) + len(media)
            if size >= BATCH_BYTES:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _retried(f):
    for attempt in range(TRIES):
        try:
            return f()
        except (OSError, ValueError, struct.error, zipfile.BadZipFile):
            if attempt == TRIES - 1:
                raise


def directory(place, partition: ByteRange) -> list[tuple[int, str, int, int]]:
    """(offset, name, length, CRC) of the members whose headers begin in a range."""
    with place.open_input_file(partition.path) as source, zipfile.ZipFile(source) as archive_:
        return [(m.header_offset, m.filename, m.file_size, m.CRC) for m in archive_.infolist() if partition.start <= m.header_offset < partition.end]


def member(source, offset: int, length: int, crc: int) -> bytes:
    """The stored bytes of the member whose header begins at offset."""
    source.seek(offset)
    head = source.read(30)
    name, extra = struct.unpack("<26xHH", head)
    source.seek(offset + 30 + name + extra)
    data = source.read(length)
    if len(data) != length or zlib.crc32(data) != crc:
        raise ValueError(f"damaged member at {offset}")
    return data


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.string())
    names = ["member", "offset", "n_bytes", "payload", "media", "feature"]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


class MediaArchive(DataSource):
    """spark.read.format("media_archive").load(folder)"""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"])


def media(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").load(folder)


def op2_media_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = media(spark, archive(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
    return rows.select(
        F.expr("try_cast(regexp_extract(member, '^[0-9]+-(.*)[.]png$', 1) AS bigint)").alias("doc_id"),
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", F.octet_length("payload") - UNIT + 1, F.lit(UNIT))).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
