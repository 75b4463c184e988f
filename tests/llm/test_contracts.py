"""Results of the ten queries and of the stages on awkward rows, and on empty tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import bagminhash, langid, media, mixing, packing, quality, secrets, spotsigs
from palimpsest.llm.queries import QUERIES

from .conftest import SCHEMA, held, prose


def rows(df, *by):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: tuple((r[b] is not None, r[b]) for b in by))


def test_ids_survive(spark, odd, saved):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 8)] + [(None, 1, None), (3, None, None)], "doc_id long, quality int, toxic int")
    sf = saved(documents=odd, labels=labels)
    want = sorted(odd.toPandas().doc_id.fillna(-1).astype(int).tolist())
    for name in ("op1_pu_quality", "op2_media_archive", "op3_crf_language", "op8_bagminhash", "op9_spotsigs", "op10_markov_secrets"):
        got = QUERIES[name](spark, sf).toPandas().doc_id.fillna(-1).astype(int).tolist()
        assert sorted(got) == want, name


def test_empty_tables(spark, nothing, saved):
    sf = saved(
        documents=nothing,
        labels=spark.createDataFrame([], "doc_id long, quality int, toxic int"),
        pages=spark.createDataFrame([], "page_id long, url string, html string"),
        conversations=spark.createDataFrame([], "conv_id long, turn long, role string, text string"),
    )
    for name, query in QUERIES.items():
        assert query(spark, sf).count() == 0, name
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_clashing_columns(spark, odd):
    """Columns named like an operator's outputs, and like its inner tables' columns, pass or are replaced."""
    docs = odd.withColumns({c: F.lit("mine") for c in ("score", "lang_pred", "key", "word", "start", "copy", "piece", "k", "h", "secrets")})
    assert langid.identify(docs, None).where("key = 'mine'").count() == docs.count()
    assert {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"}
    model = quality.Model(np.zeros(0), np.ones(0), [], 0.25)
    assert {r.score for r in quality.score(docs, model).collect()} == {0.25}
    assert bagminhash.near_duplicates(docs).where("word = 'mine'").count() == docs.count()
    assert packing.pack(docs).count() >= docs.count()
    assert mixing.replicate(docs, {"a": 0.5, "b": 0.5}).where("start = 'mine' AND copy = 'mine'").count() > 0
    assert secrets.scan(docs).schema["secrets"].dataType.simpleString().startswith("array")
    docs = docs.withColumns({c: F.lit("mine") for c in ("__row", "__digest", "__spans", "__s", "_0", "__copy", "Score")}).drop("score")
    assert {r.score for r in quality.score(docs, model).collect()} == {0.25}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns, name
    with pytest.raises(ValueError, match="apart"):
        bagminhash.near_duplicates(docs)


def test_media_round_trip(spark, odd, saved):
    sf = saved(documents=odd)
    got = defaultdict(set)
    for r in QUERIES["op2_media_archive"](spark, sf).collect():
        got[r.doc_id].add((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature))
    texts = defaultdict(set)
    for r in odd.collect():
        texts[r.doc_id].add(r.text or "")
    for doc_id, values in texts.items():
        want = set()
        for t in values:
            raw, n = media.payload(t)
            samples, kept = media.decode(media.encode(raw, n))
            assert samples.tobytes() == raw and kept == n == len(t.encode()) and len(raw) % 64 == 0 and len(raw) >= 64
            want.add((n, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:])))
        assert {v[:4] for v in got[doc_id]} == want


def test_media_retries_a_member(spark, odd, monkeypatch):
    folder = media.archive(odd)
    calls, real = [], media.member

    def flaky(source, offset, length, crc):
        calls.append(offset)
        if len(calls) % 2:
            raise OSError("lost")
        return real(source, offset, length, crc)

    monkeypatch.setattr(media, "member", flaky)
    reader = media.ArchiveReader(folder)
    n = sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
    assert n == odd.count() and len(calls) == 2 * n


def test_packing_is_a_partition(spark, odd, saved):
    sf = saved(documents=odd.withColumn("doc_id", F.monotonically_increasing_id()))
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    encode, out, bins = packing.Encoder(), defaultdict(list), defaultdict(list)
    for r in QUERIES["op5_best_two_fit"](spark, sf).collect():
        out[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    for doc_id, text in docs.items():
        ids = np.array([*encode(text), 0], dtype="<u4")
        at = 0
        for k, r in enumerate(sorted(out[doc_id], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.SEQUENCE


def test_two_fit_beats_or_equals_greedy():
    rng = np.random.default_rng(3)
    for _ in range(20):
        lengths = rng.integers(1, 101, size=200)
        counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
        fillings = packing.fill(counts, 100)
        used = defaultdict(int)
        for held_, times in fillings:
            assert sum(k * v for k, v in held_.items()) <= 100
            for k, v in held_.items():
                used[k] += v * times
        assert used == counts
        rooms: list[int] = []
        for x in sorted(lengths.tolist(), reverse=True):  # best-fit decreasing
            fit = min((i for i, r in enumerate(rooms) if r >= x), key=lambda i: rooms[i], default=None)
            if fit is None:
                rooms.append(100 - x)
            else:
                rooms[fit] -= x
        assert sum(t for _, t in fillings) <= len(rooms) + 1


def test_fast_encoder_agrees_with_the_file():
    encode = packing.Encoder()
    for t in ("", "Hello  world\n\n don't 12345 ünï \U0001f600", "<|endoftext|> x", "a" * 5000, "\x00\xa0 tab\t"):
        assert list(encode(t)) == encode.slow(t)


def brute_base(text: str) -> list[tuple[int, int, int, str]]:
    found = []
    for rank, (kind, pattern, group, least) in enumerate((("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24))):
        found += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text) if len(m.group(group)) >= least]
    return sorted(found)


def test_secrets_match_brute_force(spark, saved):
    texts = [None, "", "password: hunter2x and TOKEN='abcdef' token=abc", "AKIA" + "A1" * 10 + " é\U0001f600 " + "0a" * 12, "api_key=\"" + "0f" * 20 + '"', "secret = = x", "nothing here at all", prose(5, 2000), "get_user_name_from_session_manager kX9vQ2mZ7pLw4RtY8sBn"]
    sf = saved(documents=spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], SCHEMA))
    for r in QUERIES["op10_markov_secrets"](spark, sf).collect():
        base = brute_base(texts[r.doc_id] or "")
        text = ",".join(f"{k}:{s}:{e}" for s, _, e, k in base)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest(), r
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(b[3] == k for b in base) for k in ("assign", "access", "hex")]
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))
    assert "random:" in [r for r in QUERIES["op10_markov_secrets"](spark, sf).collect() if r.doc_id == 8][0].spans


def test_markov_models_separate():
    import random

    table, rng = secrets.trained(), random.Random(99)

    def llr(s):
        at = [secrets._CLASSES.index(c) for c in s]
        return sum(table[a * secrets._N + b] for a, b in zip(at, at[1:], strict=False)) / (len(s) - 1)

    keys = [s for s in secrets.random_strings(500, rng) if len(s) >= 16]
    plain = [s for s in secrets.ordinary(500, rng) if len(s) >= 16 and re.search("[a-z]{4}", s)]
    assert np.mean([llr(s) > secrets.MARGIN for s in keys]) > 0.95
    assert np.mean([llr(s) > secrets.MARGIN for s in plain]) < 0.05


def test_redaction_keeps_the_rest(spark):
    docs = spark.createDataFrame([(1, "a password=hunter22 b token: abcdef1", "en", "s", 99), (2, None, None, None, None), (3, "clean", "en", "s", 5)], SCHEMA)
    got = {r.doc_id: r for r in secrets.stage(spark, docs, "").collect()}
    assert got[1].text == "a [SECRET] b [SECRET]" and got[1].n_chars == len(got[1].text)
    assert got[2].text is None and got[3].text == "clean" and got[3].n_chars == 5


def brute_signatures(text: str) -> set[tuple]:
    anchors = set(spotsigs.ANCHORS)
    words = re.sub(r"[^\w]|_", " ", text.lower()).split()
    content = [(w, i) for i, w in enumerate(words) if w not in anchors]
    out = set()
    for (w, i), (x, _) in zip(content, content[1:], strict=False):
        if i and words[i - 1] in anchors:
            out.add((words[i - 1], w, x))
    return out if out or not words else {tuple(words)}


def test_spotsigs_match_brute_force(spark, saved):
    texts = [prose(i, 80).replace(" ba", " the ba").replace(" mo", " of a mo") for i in range(12)]
    texts += [texts[0], texts[0] + " the last words here", "", "the of and", "single", None]
    sf = saved(documents=spark.createDataFrame([(i * 3, t, "en", "a", 1) for i, t in enumerate(texts)], SCHEMA))
    got = {r.doc_id // 3: r for r in QUERIES["op9_spotsigs"](spark, sf).collect()}
    plain = [t or "" for t in texts]
    for i, t in enumerate(plain):
        nxt = plain[i - 1]
        n = len(t) // 2
        edited = t[: len(t) - n] + nxt[:n]
        a, b, c = (brute_signatures(x) for x in (t, edited, nxt))
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].near_edited == pytest.approx(like(a, b)) and got[i].near_next == pytest.approx(like(a, c)), i
    assert got[0].fingerprint == got[12].fingerprint and got[1].fingerprint != got[2].fingerprint


@pytest.mark.parametrize("part", [512, 2])
def test_spotsigs_pairs(spark, part):
    """All pairs of different fingerprints, whatever the ids: null ones, and one id on two texts; hot signatures dealt over blocks too."""
    texts = [prose(i, 80).replace(" ba", " the ba").replace(" mo", " of a mo").replace(" ka", " to ka") for i in range(30)]
    texts += [t + " the very end" for t in texts[:10]] + texts[:5]
    ids = [None if i in (3, 4) else 7 if i in (7, 20) else i for i in range(len(texts))]
    pairs, members = spotsigs.near_pairs(spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string"), 0.6, part=part)
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", F.sha2(spotsigs.fingerprint(spotsigs.signatures(F.col("text"))), 256).alias("f")).collect()
    sets = {r.f: brute_signatures(texts[r.i]) for r in rows}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}
    assert {(r.a, r.b) for r in pairs.collect()} == want and len(want) >= 5
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint) for r in members.collect()) == sorted((ids[r.i] is None, ids[r.i] or 0, r.f) for r in rows)


def test_language_accuracy_and_switching(spark):
    import random

    rng = random.Random(4)
    kinds = {"xx": [w for w in ("zorak", "zumel", "zebru", "zotti", "zilka", "zarno")], "yy": ["hopple", "hindel", "hammer", "hefty", "hodden", "hulver"]}
    make = lambda k, n: " ".join(rng.choice(kinds[k]) for _ in range(n))
    data = [(i, make("xx" if i % 2 else "yy", 50), "xx" if i % 2 else "yy") for i in range(200)] + [(1000, None, "xx"), (1001, "123 !!", "yy"), (None, make("xx", 9), None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    got = {r.doc_id: r for r in langid.identify(docs.drop("lang"), model).collect()}
    assert all(got[i].lang_pred == ("xx" if i % 2 else "yy") for i in range(200) if held(i))
    assert got[1000].lang_pred == got[1001].lang_pred == "und" and got[None].lang_pred == "xx"
    mixed = spark.createDataFrame([(make("xx", 30) + " " + make("yy", 10),)], "text string")
    r = langid.identify(mixed, model).first()
    assert r.lang_pred == "xx" and 0.6 < r.score < 0.9


def test_forward_backward_matches_enumeration():
    import itertools

    rng = np.random.default_rng(1)
    e, t = rng.normal(size=(5, 3)), rng.normal(size=(3, 3))
    want, total = np.zeros((5, 3)), 0.0
    for path in itertools.product(range(3), repeat=5):
        p = np.exp(sum(e[i, k] for i, k in enumerate(path)) + sum(t[a, b] for a, b in itertools.pairwise(path)))
        total += p
        for i, k in enumerate(path):
            want[i, k] += p
    got, _ = langid.marginals(e, t, np.zeros(5, dtype=int))
    assert np.allclose(got, want / total, atol=1e-6)
    long = rng.normal(size=(300, 3))
    whole, _ = langid.marginals(long, t, np.zeros(300, dtype=int))
    a = np.ones(3) / 3
    for i in range(300):
        a = (a @ np.exp(t) if i else a) * np.exp(long[i])
        a /= a.sum()
    assert np.allclose(whole[-1], a, atol=1e-6)


def test_quality_learns_without_negatives(spark):
    good = [(i, prose(i, 80), 1) for i in range(300)]
    bad = [(1000 + i, "$$$ @@@ ### CLICK NOW!!! " * 12 + str(i), 0) for i in range(100)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in good + bad] + [(5000, None), (5001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in good + bad] + [(None, 1), (7000, None)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    held_rows = [(got[i], y) for i, _, y in good + bad if held(i)]
    assert np.mean([(s >= 0.5) == bool(y) for s, y in held_rows]) > 0.95
    assert got[5000] == got[5001] and 0 <= got[5000] <= 1
    assert quality.fit(docs, labels.where("quality = 1")).score(quality.features(pa.array([prose(3000, 80)])))[0] == model.score(quality.features(pa.array([prose(3000, 80)])))[0]
    assert quality.fit(docs, labels.where("quality = 5")).score(np.zeros((2, 3))).tolist() == [0.5, 0.5]


def test_mixing_counts(spark):
    docs = spark.createDataFrame([(i, "x" * 100, "en", "a" if i % 10 else "b", 100) for i in range(4000)] + [(None, "y" * 100, None, None, None), (9999, None, "en", "a", 0)], SCHEMA)
    out = mixing.replicate(docs, {"a": 0.5, "b": 0.5}).groupBy("source").count().collect()
    n = {r.source: r["count"] for r in out}
    assert abs(n["a"] - 2000) < 200 and abs(n["b"] - 2000) < 200 and None not in n
    again = {r.source: r["count"] for r in mixing.replicate(docs.repartition(7), {"a": 0.5, "b": 0.5}).groupBy("source").count().collect()}
    assert again == n


def test_class_prior():
    """The share of positives among unlabelled rows, found without a negative label."""
    rng = np.random.default_rng(3)
    for share in (0.3, 0.6, 0.85):
        u = np.where(rng.random(3000)[:, None] < share, rng.normal(2, 1, (3000, 4)), rng.normal(-2, 1, (3000, 4)))
        assert abs(quality.class_prior(rng.normal(2, 1, (1500, 4)), u) - share) < 0.06


@pytest.mark.parametrize("prior", [0.2, 0.95])
def test_risk_gradient(prior):
    """The step against differences of the risk, or of its negative part where that is below zero."""
    rng = np.random.default_rng(8)
    w = [rng.normal(0, 0.5, (3, 5)), rng.normal(0, 0.1, 5), rng.normal(0, 0.5, (5, 1)), np.zeros(1)]
    p, u = rng.normal(1, 1, (40, 3)), rng.normal(-1 if prior > 0.5 else 0, 1, (60, 3))

    def parts(w):
        g = lambda x: (np.maximum(x @ w[0] + w[1], 0) @ w[2] + w[3])[:, 0]
        negative = np.logaddexp(0, g(u)).mean() - prior * np.logaddexp(0, g(p)).mean()
        return prior * np.logaddexp(0, -g(p)).mean(), negative

    plus, negative = parts(w)
    risk, grads = quality.gradient(w, p, u, prior)
    assert risk == pytest.approx(plus + max(0, negative))
    value = (lambda w: sum(parts(w))) if negative >= 0 else (lambda w: -parts(w)[1])
    for i, grad in enumerate(grads):
        for at in list(np.ndindex(*w[i].shape))[:6]:
            step = [x.copy() for x in w]
            step[i][at] += 1e-6
            assert (value(step) - value(w)) / 1e-6 == pytest.approx(grad[at], abs=1e-4)
