"""Language ID by a linear-chain conditional random field over the words of a text.

A word is a run of ASCII letters and bytes above 127 in the lower-cased UTF-8 text. Its scores per language come from its
affixes (first and last two and three bytes), its byte trigrams and a lexicon of frequent words; learned transitions join
neighbouring words, and forward-backward gives each word's probabilities, so that a text may switch language. The text's
prediction is the language with the largest share of letters, and its score that share.

Only documents carry labels, so training first fits the emissions to them, then relabels the words by what the chain says
and fits emissions and transitions together. It uses whole texts of at most about `sample` documents of each language.

Defined cases: `und` with score 0 where the text is null or has no letter, or where there is nothing to learn from; ties go
to the language first in code order; null languages teach nothing; repeated rows and null ids are predicted like any other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Documents of each language that training reads; every language is learned.
SAMPLE = 500
#: Bytes of text whose chains are in memory at a time.
PREDICTED = 1 << 19
SEGMENT, GRAMS, AFFIXES, LEXICON = 64, 1 << 16, 1 << 14, 40_000
_LETTER = re.compile(r"[^\W\d_]")
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[np.r_[65:91, 97:123, 128:256]] = True


@dataclass
class Words:
    """The words of some texts and the feature numbers of each."""

    doc: np.ndarray
    size: np.ndarray
    grams: np.ndarray  # of each byte that ends a trigram
    owner: np.ndarray  # the word of each such byte
    affixes: np.ndarray  # words by 4
    lexicon: np.ndarray


def _ids(raw: np.ndarray, at: np.ndarray, n: int, salt: int, size: int) -> np.ndarray:
    x = np.full(len(at), C.step(salt), dtype=C.U64)
    for j in range(n):
        x = C.mix(x ^ raw[np.minimum(at + j, len(raw) - 1)].astype(C.U64))
    return (x & C.U64(size - 1)).astype(np.int32)


def read(texts: pa.Array, lexicon: np.ndarray) -> tuple[Words, np.ndarray]:
    raw, begins = C.raw_bytes(pc.utf8_lower(pc.fill_null(texts, "")))
    inside = _IN_WORD[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    edges = begins[:-1][begins[:-1] < len(raw)]
    first[edges] = inside[edges]
    last[:-1] &= ~inside[1:] | first[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.searchsorted(begins, starts, side="right") - 1
    # A trigram stands on each byte of a word, with a mark before its first.
    owner = np.cumsum(first)[inside] - 1
    at = np.flatnonzero(inside)
    b = raw.astype(np.uint32)
    marked = np.where(first, np.uint32(32), np.concatenate([[np.uint32(32)], b[:-1]]) if len(b) else b)
    after = np.where(last, np.uint32(32), np.concatenate([b[1:], [np.uint32(32)]]) if len(b) else b)
    x = (marked << np.uint32(16) | b << np.uint32(8) | after)[at] * np.uint32(0x9E3779B1)
    grams = (x >> np.uint32(16)).astype(np.int32)
    if not len(starts):
        return Words(doc, ends - starts, grams, owner, np.zeros((0, 4), dtype=np.int32), np.zeros(0, dtype=np.int32)), np.zeros(0, dtype=C.U64)
    hashes = C.span_hashes(raw, starts, ends)
    back = np.maximum
    affixes = np.stack([_ids(raw, starts, 2, 1, AFFIXES), _ids(raw, starts, 3, 2, AFFIXES) + AFFIXES, _ids(raw, back(ends - 2, starts), 2, 3, AFFIXES) + 2 * AFFIXES, _ids(raw, back(ends - 3, starts), 3, 4, AFFIXES) + 3 * AFFIXES], axis=1)
    found = np.minimum(np.searchsorted(lexicon, hashes), max(len(lexicon) - 1, 0))
    known = np.where(lexicon[found] == hashes, found, -1).astype(np.int32) if len(lexicon) else np.full(len(hashes), -1, dtype=np.int32)
    return Words(doc, ends - starts, grams, owner, affixes, known), hashes


@dataclass
class Model:
    labels: list[str]
    lexicon: np.ndarray
    grams: np.ndarray
    affixes: np.ndarray
    words: np.ndarray  # the last row is for words outside the lexicon
    transitions: np.ndarray

    def emissions(self, w: Words) -> np.ndarray:
        out = self.affixes[w.affixes].sum(axis=1) + self.words[w.lexicon]
        for k in range(len(self.labels)):
            out[:, k] += np.bincount(w.owner, self.grams[w.grams, k], minlength=len(w.doc))
        return out


def marginals(emission: np.ndarray, transitions: np.ndarray, doc: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Each word's probabilities by forward-backward, and the expected transitions if asked for.

    Chains are cut into segments; the products of their step matrices carry messages from one to the next, so that the
    number of vectorised steps follows the segment's length, not the text's."""
    n, k = emission.shape
    expected = np.zeros((k, k))
    if not n:
        return emission, expected
    e = np.exp(emission - emission.max(axis=1, keepdims=True)) + 1e-12
    t = np.exp(transitions - transitions.max())
    begins = np.flatnonzero(np.diff(doc, prepend=-1))
    counts = np.diff(np.append(begins, n))
    segs = -(-counts // SEGMENT)
    first_seg = np.cumsum(segs) - segs
    place = np.arange(n) - np.repeat(begins, counts)
    seg, at = np.repeat(first_seg, counts) + place // SEGMENT, place % SEGMENT
    total = int(segs.sum())
    grid, valid = np.ones((SEGMENT, total, k)), np.zeros((SEGMENT, total), dtype=bool)
    grid[at, seg], valid[at, seg] = e, True
    product = np.broadcast_to(np.eye(k), (total, k, k)).copy()
    opens = np.zeros(total, dtype=bool)
    opens[first_seg] = True
    for s in range(SEGMENT):
        live = valid[s]
        if not live.any():
            break
        step = (product[live] @ t) * grid[s, live][:, None, :]
        if s == 0:  # nothing leads to a text's first word
            step = np.where(opens[live][:, None, None], np.eye(k) * grid[s, live][:, None, :], step)
        product[live] = step / step.max(axis=(1, 2), keepdims=True)
    into, back = np.ones((total, k)), np.ones((total, k))
    order = np.argsort(-segs, kind="stable")
    for j in range(1, int(segs.max())):
        own = first_seg[order[: np.searchsorted(-segs[order], -j)]]
        x = (into[own + j - 1][:, None, :] @ product[own + j - 1])[:, 0]
        into[own + j] = x / x.sum(axis=1, keepdims=True)
    for j in range(int(segs.max()) - 1, 0, -1):
        own = first_seg[order[: np.searchsorted(-segs[order], -j)]]
        x = (product[own + j] @ back[own + j][:, :, None])[:, :, 0]
        back[own + j - 1] = x / x.sum(axis=1, keepdims=True)
    forward, backward, came = np.empty_like(grid), np.empty_like(grid), np.empty_like(grid) if pairs else None
    a, b = into, back
    for s in range(SEGMENT):
        if pairs:
            came[s] = a
        x = np.where(opens[:, None], grid[s], (a @ t) * grid[s]) if s == 0 else (a @ t) * grid[s]
        a = np.where(valid[s][:, None], x / x.sum(axis=1, keepdims=True), a)
        forward[s] = a
    for s in range(SEGMENT - 1, -1, -1):
        backward[s] = b
        x = (grid[s] * b) @ t.T
        b = np.where(valid[s][:, None], x / x.sum(axis=1, keepdims=True), b)
    out = forward[at, seg] * backward[at, seg]
    out /= out.sum(axis=1, keepdims=True)
    if pairs:
        inner = place > 0
        left, right = came[at[inner], seg[inner]], grid[at[inner], seg[inner]] * backward[at[inner], seg[inner]]
        scale = ((left @ t) * right).sum(axis=1, keepdims=True)
        expected = t * ((left / scale).T @ right)
    return out, expected


def train(texts: list[str], langs: list[str], epochs: tuple[int, int] = (4, 3), rate: float = 0.08) -> Model:
    """Fits a model to whole texts, each with its language."""
    labels = sorted(set(langs))
    k, everything = len(labels), pa.array(texts, pa.large_string())
    gold = np.array([labels.index(x) for x in langs], dtype=np.int64)
    order = np.random.default_rng(7).permutation(len(texts))
    everything, gold = everything.take(pa.array(order)), gold[order]
    parts = list(C.text_chunks(everything, 1 << 20))
    hashes = np.concatenate([read(everything.slice(a, b - a), np.zeros(0, dtype=C.U64))[1] for a, b in parts] or [np.zeros(0, dtype=C.U64)])
    kinds, counts = np.unique(hashes, return_counts=True)
    keep = np.argsort(-counts, kind="stable")[:LEXICON]
    lexicon = np.sort(kinds[keep[counts[keep] >= 3]])
    model = Model(labels, lexicon, np.zeros((GRAMS, k), dtype=np.float32), np.zeros((4 * AFFIXES, k), dtype=np.float32), np.zeros((len(lexicon) + 1, k), dtype=np.float32), np.zeros((k, k)))
    speed = {name: np.full(getattr(model, name).shape, 1e-9 if name == "transitions" else 1e-3, dtype=np.float32) for name in ("grams", "affixes", "words", "transitions")}
    sticky = np.eye(k) * 3.0
    for phase, rounds in enumerate(epochs):
        if phase:
            model.transitions = sticky.copy()
        for _ in range(rounds):
            for a, b in parts:
                w, _ = read(everything.slice(a, b - a), lexicon)
                if not len(w.doc):
                    continue
                e = model.emissions(w)
                target = np.eye(k)[gold[a:b][w.doc]]
                if phase:
                    said = marginals(e, sticky, w.doc)[0]
                    target = np.where(said.max(axis=1, keepdims=True) > 0.9, np.eye(k)[said.argmax(axis=1)], target)
                    p, expected = marginals(e, model.transitions, w.doc, pairs=True)
                    same = w.doc[1:] == w.doc[:-1]
                    seen = target[:-1][same].T @ target[1:][same]
                    step = (expected - seen) / max(len(w.doc), 1)
                    speed["transitions"] += step**2
                    model.transitions -= rate * step / np.sqrt(speed["transitions"])
                else:
                    p = marginals(e, model.transitions, w.doc)[0]
                r = ((p - target) / 1e3).astype(np.float32)
                for c in range(k):
                    for name, index, value in (("grams", w.grams, r[w.owner, c]), ("affixes", w.affixes.reshape(-1), np.repeat(r[:, c], 4)), ("words", w.lexicon % len(model.words), r[:, c])):
                        table = getattr(model, name)
                        g = np.bincount(index, value, minlength=len(table)).astype(np.float32) + 1e-5 * table[:, c]
                        speed[name][:, c] += g * g
                        table[:, c] -= rate * g / np.sqrt(speed[name][:, c])
    model.words[-1] = 0
    return model


def shares(model: Model, texts: pa.Array) -> np.ndarray:
    """Share of each text's letters in each language; zeros where it has no word."""
    w, _ = read(texts, model.lexicon)
    p, _ = marginals(model.emissions(w).astype(np.float64), model.transitions, w.doc)
    out = np.zeros((len(texts), len(model.labels)))
    for k in range(len(model.labels)):
        out[:, k] = np.bincount(w.doc, p[:, k] * w.size, minlength=len(texts))
    return out / np.maximum(out.sum(axis=1, keepdims=True), 1e-300)


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE) -> Model | None:
    """Trains on about `sample` documents a language outside the held-out fold, picked by hash; None if there are none."""
    seen = docs.where(~C.held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = seen.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).collect()
    if not counts:
        return None
    share: Column = F.lit(0.0)
    for r in counts:
        share = F.when(F.col(lang_col) == r[0], float(min(1.0, sample / r["count"]))).otherwise(share)
    rows = seen.where(C.unit(F.col(id_col), F.lit("language")) < share).select(text_col, lang_col).toPandas()
    return train(list(rows[text_col]), list(rows[lang_col])) if len(rows) else None


def _predict(where: int, model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in C.text_chunks(batch.column(where), PREDICTED):
                part = batch.slice(a, b - a)
                texts = part.column(where)
                lang, score = ["und"] * (b - a), np.zeros(b - a)
                if model is not None:
                    got = shares(model, texts)
                    for i, t in enumerate(texts.to_pylist()):
                        if t and got[i].any() and _LETTER.search(t):
                            lang[i], score[i] = model.labels[int(got[i].argmax())], got[i].max()
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang), pa.array(np.minimum(score, 1.0))], names=[*part.schema.names, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score; columns of those names are replaced."""
    text = docs.select(F.col(text_col).alias("t"), *(c for c in docs.columns if c.lower() not in ("lang_pred", "score")))
    rows, names = C.apart(text)
    out = rows.mapInArrow(_predict(0, model), C.with_fields(rows, lang_pred="string", score="double"))
    return out.select(*(f"_{i}" for i in range(1, len(names))), "lang_pred", "score").toDF(*names[1:], "lang_pred", "score")


def op3_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs.select("doc_id", "text"), fit(docs)).select("doc_id", C.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language, however many they hold; those without a letter go. Without a model none goes."""
    model = fit(docs)
    rows, names = C.apart(docs)
    kept = identify(rows, model, C.at(docs, "text"))
    return C.together(kept if model is None else kept.where("lang_pred <> 'und'"), names)
