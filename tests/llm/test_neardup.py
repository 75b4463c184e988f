"""Near-duplicate classes against all pairs, with groups large enough for the block comparison."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from palimpsest.llm import bagminhash as B
from palimpsest.llm import common as C
from palimpsest.llm import templates
from palimpsest.llm.chat import OP6_SQL, collapse, op6_snapshot_collapse
from palimpsest.llm.mixing import OP4_SQL, op4_poisson_mixing

from ..conftest import duck_rows, spark_rows
from .conftest import prose


def bag(text: str | None) -> Counter:
    w = (text or "").lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else Counter()


def overlap(a: Counter, b: Counter) -> float:
    both, either = sum((a & b).values()), sum((a | b).values())
    return both / either if either else 1.0


def classes(texts: list[str | None]) -> list[int]:
    """The smallest index that each text reaches over all pairs of 0.8 or more."""
    bags = [bag(t) for t in texts]
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if root(i) != root(j) and overlap(bags[i], bags[j]) >= 0.8:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return [root(i) for i in range(len(texts))]


def edited(text: str, n: int, seed: int) -> str:
    rng, w = random.Random(seed), text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
    return " ".join(w)


def corpus() -> list[str | None]:
    base = [prose(i, 100) for i in range(30)]
    out: list[str | None] = [*base, *(edited(t, k % 4, k) for k, t in enumerate(base)), *base[:5], base[0].upper(), f"  {base[1]} \n", None, "", " ", "one two", "one two", "x " * 500, "x " * 450, "x " * 200]
    common = prose(77, 150)
    out += [edited(common, 1 + i % 3, 1000 + i) for i in range(80)]  # a group beyond SMALL
    step = prose(78, 100).split()
    for i in range(12):  # a chain whose ends are no link
        step = edited(" ".join(step), 1, 2000 + i).split()
        out.append(" ".join(step))
    return out


def test_classes_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK", 16)
    texts = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in B.near_duplicates(df).collect()}
    assert [got[i]["__class"] for i in range(len(texts))] == classes(texts)
    firsts = Counter(r["__class"] for r in got.values() if r["__first"])
    assert set(firsts) == {r["__class"] for r in got.values()} and set(firsts.values()) == {1}


def test_overlaps_and_signatures():
    texts = [prose(i, 120) for i in range(20)]
    pairs = [(t, edited(t, i % 6, i)) for i, t in enumerate(texts)] + [("x " * 300, "x " * 200), ("", "")]
    got = B.overlaps(pa.array([a for a, _ in pairs]), pa.array([b for _, b in pairs]))
    want = [overlap(bag(a), bag(b)) for a, b in pairs]
    assert np.allclose(got, want)
    both = pa.array([x for p in pairs[:-1] for x in p])
    h, d, w = B.shingles(*C.raw_bytes(both))
    sig = B.signatures(h, d, w, len(both), 2048)
    near = [(sig[2 * i] == sig[2 * i + 1]).mean() for i in range(len(pairs) - 1)]
    assert np.abs(np.array(near) - want[:-1]).max() < 0.05


def test_null_ids(spark):
    t = prose(1, 80)
    got = B.near_duplicates(spark.createDataFrame([(None, t), (None, t), (4, prose(2, 80)), (3, t)], "doc_id long, text string")).collect()
    assert Counter(r["__class"] for r in got) == {3: 3, 4: 1}


@pytest.mark.parametrize("name,query,sql", [("mixing", op4_poisson_mixing, OP4_SQL), ("chat", op6_snapshot_collapse, OP6_SQL)])
def test_sql(spark, name, query, sql):
    sf = "/root/testdata/sf0.001"
    assert spark_rows(query(spark, sf)) == duck_rows(sql, sf)


def test_chat_cases(spark):
    rows = [(1, 0, "user", "a"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (4, 0, "user", "c"), (4, 0, "user", "c"), (None, 0, None, None), (5, None, "user", "z"), (5, 2500, "user", "late")]
    got = {r.conv_id: r for r in collapse(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {2, 4, None, 5}
    assert got[5].n_turns == 2 and got[5].rendered == "<|user|>\nz<|end|>\n<|user|>\nlate<|end|>\n"
    assert got[2].rendered == "<|user|>\na<|end|>\n<|assistant|>\nb<|end|>\n" and got[4].n_turns == 1
    ids = spark.createDataFrame([("07", 0, "user", "a"), ("7", 0, "user", "b"), ("x", 0, "user", "b"), ("x", 1, "user", "c")], "conv_id string, turn long, role string, text string")
    assert sorted((r.conv_id, r.n_turns) for r in collapse(ids).collect()) == [("07", 1), ("x", 2)]


PAGE = """<html><head><title>T{i}</title><script>var a="<p>no</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="{box}"><h1>Head {i}</h1><p>First  &amp; <b>bold</b> text {i}.</p><p>Second&nbsp;part<br>of {i}.</p></div><div class="cookie-notice">Accept</div><footer>&copy; x</footer></body></html>"""


def test_main_text(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.format(i=i, box="content")) for i in range(12)]
    rows += [(100, None, None), (101, "not a url", ""), (102, "http://one.example/", "plain <p>unclosed"), (102, "http://one.example/", "plain <p>unclosed"), (None, "http://two.example/", "<article><p>" + "w " * 100_000 + "</p></article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'mine' AS host", "'mine' AS tokens", "'mine' AS linked")
    got = {}
    for r in templates.extract(df).collect():
        got[r.page_id] = r
        assert r.host == r.tokens == r.linked == "mine"
    for i in range(12):
        assert got[i]["__main"] == f"Head {i}\nFirst & bold text {i}.\nSecond part of {i}."
    assert got[100]["__main"] == got[101]["__main"] == "" and got[102]["__main"] == "plain\nunclosed"
    assert len(got[None]["__main"]) == 199_999


def test_light_tables_are_few_files(spark, monkeypatch):
    docs = spark.createDataFrame([(i, prose(i % 40, 60) + (" x" if i % 3 == 0 else "")) for i in range(200)], "doc_id long, text string").repartition(40)
    files, written = {}, C.written

    def counted(df, tag, **more):
        out = written(df, tag, **more)
        files[tag] = max(files.get(tag, 0), len(out.inputFiles()))
        return out

    monkeypatch.setattr(C, "written", counted)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert B.near_duplicates(docs).select("__class").distinct().count() == 40
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    light = {k: files[k] for k in ("nodes", "shared", "ids", "links", "components", "mixed", "classes")}
    assert max(light.values()) <= 3 * spark.sparkContext.defaultParallelism, light
