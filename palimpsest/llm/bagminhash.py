"""MinHash near-dedup by BagMinHash: signatures of weighted word shingles, bands, verification and classes.

A document is the bag of its five-word shingles, each weighted by how often it occurs (a document of fewer words is one
shingle). Points of a Poisson process over (time, weight level) belong to each shingle; level intervals double in width,
[0,1), [1,2), [2,4) ..., and a point counts if its level lies below the shingle's weight. Each point falls on one of the
signature's components, which keep their earliest time. Two bags agree on a component with probability equal to their
weighted Jaccard similarity. Bags that share a band are compared with hubs of that bucket, then across the classes that
remain in it; a link needs a multiset overlap (sum of minima by sum of maxima) of the threshold or more.

Defined cases: a null text counts as empty; texts without a word form one class; equal texts (up to case and white space)
fall in one class without being compared; null and repeated ids are kept, since rows are told apart by their place; the
class id is the smallest doc_id of its rows (null if all are null); other columns pass, those that begin with two underscores
only if they are set apart first, as the stage does.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

WORDS, THRESHOLD = 5, 0.8
#: With 26 bands of 5, a pair at 0.8 shares no band with probability 3e-5.
BANDS, BAND_ROWS = 26, 5
#: Members up to which a group's classes are compared by pairs, and members of a block beyond.
SMALL, BLOCK = 24, 256
_U = C.U64


def shingles(raw: np.ndarray, begins: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash (48 bits), text number and weight of each text's distinct shingles, sorted by text and hash."""
    starts, ends, doc = C.words(raw, begins)
    n_docs = len(begins) - 1
    hashes = C.span_hashes(raw, starts, ends)
    count = np.bincount(doc, minlength=n_docs)
    at = np.concatenate([[0], np.cumsum(count)])
    n = np.where(count > 0, np.maximum(count - k + 1, 1), 0)
    owner = np.repeat(np.arange(n_docs), n)
    first = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + at[owner]
    out = np.zeros(len(owner), dtype=_U)
    for j in range(k):
        there = first + j < at[owner + 1]
        word = hashes[np.minimum(first + j, max(len(hashes) - 1, 0))] if len(hashes) else out
        out = C.mix(out + C.step(j + 1) ^ np.where(there, word, _U(0)))
    keys, weight = np.unique((owner.astype(_U) << _U(48)) | (out >> _U(16)), return_counts=True)
    return keys & _U((1 << 48) - 1), (keys >> _U(48)).astype(np.int64), weight


def signatures(element: np.ndarray, doc: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """BagMinHash: the earliest time of each component, n_docs by m; inf for an empty bag."""
    parts = [(element, doc, weight, np.zeros(len(element)), np.ones(len(element)))]
    low, level = 1, 1
    while (more := weight > low).any():
        k = int(more.sum())
        parts.append((C.mix(element[more] + C.step(level)), doc[more], weight[more], np.full(k, float(low)), np.full(k, float(low))))
        low, level = low * 2, level + 1
    key, doc, weight, base, width = (np.concatenate(x) for x in zip(*parts, strict=True))
    key, doc = C.mix(key), doc.astype(np.int64)
    time, times = np.zeros(len(key)), np.full(n_docs * m, np.inf)
    while len(key):
        key = C.mix(key + C._GOLD)
        time = time - np.log1p(-((key >> _U(11)).astype(np.float64) * 2.0**-53)) / width
        second = C.mix(key ^ C._M2)
        slot = doc * m + ((second >> _U(32)) % _U(m)).astype(np.int64)
        counts = base + width * ((second & _U(0xFFFFFFFF)).astype(np.float64) * 2.0**-32) < weight
        np.minimum.at(times, slot[counts], time[counts])
        live = time < times.reshape(n_docs, m).max(axis=1)[doc]
        key, doc, weight, base, width, time = (x[live] for x in (key, doc, weight, base, width, time))
    return times.reshape(n_docs, m)


def overlaps(left: pa.Array, right: pa.Array, k: int = WORDS) -> np.ndarray:
    """Weighted Jaccard similarity of the bags of each pair of texts; 1 for two texts without words."""
    out = []
    for texts in (left, right):
        h, d, w = shingles(*C.raw_bytes(pc.utf8_lower(pc.fill_null(texts, ""))), k)
        out.append(((d.astype(_U) << _U(48)) | h, d, w))
    (ka, da, wa), (kb, db, wb) = out
    n = len(left)
    _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    both = np.bincount(da[ia], np.minimum(wa[ia], wb[ib]), minlength=n)
    total = np.bincount(da, wa, minlength=n) + np.bincount(db, wb, minlength=n) - both
    return np.where(total > 0, both / np.maximum(total, 1), 1.0)


def _signed(where: int, k: int, bands: int, rows: int):
    """Adds to each row its place, the digest of its words and its bands; the text is column number `where`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 33
        for batch in batches:
            for a, b in C.text_chunks(batch.column(where)):
                part = batch.slice(a, b - a)
                lower = pc.utf8_lower(pc.fill_null(part.column(where), ""))
                digests = [hashlib.md5(b" ".join(t.encode().split())).digest() for t in lower.to_pylist()]
                raw, begins = C.raw_bytes(lower)
                h, d, w = shingles(raw, begins, k)
                sig = signatures(h, d, w, b - a, bands * rows).view(_U).reshape(b - a, bands, rows)
                key = np.zeros((b - a, bands), dtype=_U) + np.arange(1, bands + 1, dtype=_U) * C._GOLD
                for j in range(rows):
                    key = C.mix(key ^ sig[:, :, j])
                key[np.bincount(d, minlength=b - a) == 0] = 0
                keys = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * bands), pa.array(key.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.arange(at, at + b - a)), pa.array(digests, pa.binary()), keys], names=[*part.schema.names, "__row", "__digest", "__bands"])
                at += b - a

    return run


def _verify(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in C.text_chunks(batch.column("__ta"), C.CHUNK_BYTES // 2):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column("__a"), part.column("__b"), pa.array(overlaps(part.column("__ta"), part.column("__tb"), k))], names=["__a", "__b", "__sim"])

    return run


def compared(edges: DataFrame, signed: DataFrame, text_col: str, k: int) -> DataFrame:
    """The edges (__a, __b: rows) with the overlap of their texts. Only texts that stand in an edge move."""
    ids = C.written(C.few(edges.select(F.explode(F.array("__a", "__b")).alias("__row")).distinct()), "ids")
    texts = C.looked_up(signed.select("__row", F.col(text_col).alias("__t")), ids, ["__row"])
    a, b = texts.select(F.col("__row").alias("__a"), F.col("__t").alias("__ta")), texts.select(F.col("__row").alias("__b"), F.col("__t").alias("__tb"))
    return edges.join(a, "__a").join(b, "__b").select("__a", "__b", "__ta", "__tb").mapInArrow(_verify(k), "__a long, __b long, __sim double")


def components(links: DataFrame) -> DataFrame:
    """(__node, __comp): the smallest node that each node of a link reaches, by alternating large and small stars."""
    edges = C.written(C.few(links.select(F.greatest("__a", "__b").alias("u"), F.least("__a", "__b").alias("v")).distinct()), "links")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        edges = C.written(C.few(small), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == seen:
            break
        seen = now
    nodes = edges.select(F.col("u").alias("__node"), F.col("v").alias("__comp"))
    return nodes.unionByName(nodes.select(F.col("__comp").alias("__node"), "__comp").distinct())


def _bags(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in C.text_chunks(batch.column("__t")):
                part = batch.slice(a, b - a)
                h, d, w = shingles(*C.raw_bytes(pc.utf8_lower(pc.fill_null(part.column("__t"), ""))), k)
                # An element for each occurrence, so that overlaps of bags are those of sets.
                copy = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
                elements, size = C.mix(np.repeat(h, w) ^ (copy.astype(_U) << _U(48))), np.bincount(d, w, minlength=b - a).astype(np.int64)
                ends = np.concatenate([[0], np.cumsum(size)])
                yield pa.RecordBatch.from_arrays([part.column("__row"), pa.array([elements[x:y].tobytes() for x, y in zip(ends, ends[1:], strict=False)], pa.binary())], names=["__row", "__bag"])

    return run


def _blocks(threshold: float):
    """One link for each two classes that have one within the block pair."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        one = pc.equal(table.column("__mine"), key[1].as_py() if hasattr(key[1], "as_py") else key[1])
        nodes, comps = table.column("__node").to_numpy(), table.column("__comp").to_numpy()
        bags = [np.frombuffer(x, dtype=_U) for x in table.column("__bag").to_pylist()]
        size = np.array([len(x) for x in bags])
        elements, owner = np.concatenate(bags), np.repeat(np.arange(len(bags)), size)
        _, at, count = np.unique(elements, return_inverse=True, return_counts=True)
        shared = count > 1
        column = (np.cumsum(shared) - 1)[at]
        keep = shared[at]
        column, owner = column[keep], owner[keep]
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        both = np.zeros((len(bags), len(bags)), dtype=np.float32)
        for start in range(0, int(shared.sum()), 4096):
            x, y = np.searchsorted(column, [start, start + 4096])
            m = np.zeros((len(bags), 4096), dtype=np.float32)
            m[owner[x:y], column[x:y] - start] = 1
            both += m @ m.T
        link = both / np.maximum(size[:, None] + size[None, :] - both, 1) >= threshold - 1e-7
        link &= comps[:, None] < comps[None, :]
        side = one.to_numpy()
        link &= (side[:, None] != side[None, :]) | np.bool_(side.all())
        a, b = np.nonzero(link)
        _, first = np.unique(np.stack([comps[a], comps[b]], axis=1), axis=0, return_index=True)
        a, b = a[first], b[first]
        return pa.table({"__a": pa.array(nodes[a], pa.int64()), "__b": pa.array(nodes[b], pa.int64()), "__sim": pa.array([float(threshold)] * len(a), pa.float64())})

    return run


def across(open_: DataFrame, signed: DataFrame, text_col: str, k: int, threshold: float) -> DataFrame:
    """Links between different classes inside large groups (__hub, __node, __comp, __n): block by block of about BLOCK members,
    so that a row stands for a member in a pair of blocks, not for a pair of members."""
    ids = C.written(C.few(open_.select(F.col("__node").alias("__row")).distinct()), "ids")
    texts = C.looked_up(signed.select("__row", F.col(text_col).alias("__t")), ids, ["__row"])
    bags = texts.mapInArrow(_bags(k), "__row long, __bag binary").withColumnRenamed("__row", "__node")
    blocks = F.ceil(F.col("__n") / BLOCK).cast("int")
    rows = open_.withColumn("__mine", F.pmod(F.xxhash64("__node"), blocks).cast("int")).join(bags, "__node")
    rows = rows.withColumn("__other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("__hub", "__node", "__comp", "__bag", "__mine", F.least("__mine", "__other").alias("__i"), F.greatest("__mine", "__other").alias("__j"))
    return rows.groupBy("__hub", "__i", "__j").applyInArrow(_blocks(threshold), "__a long, __b long, __sim double")


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD, k: int = WORDS, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """Every row of docs with __class (smallest id of its class), __first (one row of each class) and its internal columns.

    Copies collapse by the digest of their words before any comparison. Rows that share a bucket form a group with the
    bucket's smallest row, its hub, and are compared with it. In groups of more than two rows and more than one class the
    classes are then compared with each other: in small groups by pairs, unless their distances to the hub differ by more
    than a link may be long (one less the overlap is a metric), in large ones by blocks. So every pair of different texts
    that shares a band is compared, or already in one class, or proven to be no link.
    """
    if any(c.startswith("__") for c in docs.columns):
        raise ValueError("columns that begin with two underscores must be set apart first")
    signed = C.written(docs.mapInArrow(_signed(docs.columns.index(text_col), k, bands, rows), C.with_fields(docs, __row="long", __digest="binary", __bands="array<long>")), "signed")
    nodes = C.written(C.few(signed.groupBy("__digest").agg(F.min("__row").alias("__node"), F.min(id_col).alias("__id"))), "nodes")
    buckets = C.written(signed.select("__row", "__bands").join(nodes.select(F.col("__node").alias("__row")), "__row", "left_semi").select(F.col("__row").alias("__node"), F.explode("__bands").alias("__bucket")).where("__bucket <> 0"), "buckets")
    shared = C.written(C.few(buckets.groupBy("__bucket").agg(F.min("__node").alias("__hub"), F.count("*").alias("__n")).where("__n > 1").drop("__n")), "shared")
    near = buckets.join(shared, "__bucket").where("__node <> __hub").select("__hub", "__node").distinct()
    tested = C.written(compared(near.select(F.col("__hub").alias("__a"), F.col("__node").alias("__b")), signed, text_col, k), "tested")
    comps = C.written(C.few(components(tested.where(F.col("__sim") >= threshold))), "components")
    members = tested.select(F.col("__a").alias("__hub"), F.col("__b").alias("__node"), F.col("__sim").alias("__near"))
    members = members.unionByName(members.select("__hub", F.col("__hub").alias("__node"), F.lit(1.0).alias("__near")).distinct()).join(comps, "__node", "left").withColumn("__comp", F.coalesce("__comp", "__node"))
    mixed = members.groupBy("__hub").agg(F.count("*").alias("__n"), F.min("__comp").alias("__lo"), F.max("__comp").alias("__hi")).where("__n > 2 AND __lo <> __hi").select("__hub", "__n")
    open_ = C.written(C.looked_up(members, C.written(C.few(mixed), "mixed"), ["__hub"]), "open")
    few = open_.where(F.col("__n") <= SMALL)
    right = few.select("__hub", F.col("__node").alias("__b"), F.col("__comp").alias("__other"), F.col("__near").alias("__far"))
    pairs = few.join(right, "__hub").where("__comp < __other").where(F.abs(F.col("__near") - F.col("__far")) <= 1 - threshold + 1e-9)
    pairs = C.written(pairs.select(F.least("__node", "__b").alias("__a"), F.greatest("__node", "__b").alias("__b")).distinct().join(tested, ["__a", "__b"], "left_anti"), "pairs")
    more = compared(pairs, signed, text_col, k).unionByName(across(open_.where(F.col("__n") > SMALL), signed, text_col, k, threshold))
    more = C.written(more.where(F.col("__sim") >= threshold), "more")
    if not more.isEmpty():
        comps = C.written(C.few(components(tested.where(F.col("__sim") >= threshold).unionByName(more))), "components")
    named = nodes.join(comps, "__node", "left").withColumn("__comp", F.coalesce("__comp", "__node"))
    classes = named.groupBy("__comp").agg(F.min("__id").alias("__class"))
    named = C.written(C.few(named.join(classes, "__comp").select("__digest", "__class", "__comp")), "classes")
    return signed.join(named, "__digest").withColumn("__first", F.col("__row") == F.col("__comp"))


def op8_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.col("__class").alias("class_id"), F.col("__first").alias("kept"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays."""
    rows, names = C.apart(docs)
    return C.together(near_duplicates(rows, C.at(docs, "text"), C.at(docs, "doc_id")).where("__first"), names)
