"""The pairs of keys that matching finds, against every pair measured."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import near
from palimpsest.functions import text as T


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("pairs", [10**9, 0])
def test_no_pair_within_the_tolerance_is_missed(monkeypatch, pairs):
    monkeypatch.setattr(near, "PAIRS", pairs)
    rng = random.Random(7)
    keys = {"".join(rng.choices("abé😀", k=rng.randint(1, 24))) for _ in range(400)}
    for k in list(keys):
        for _ in range(2):
            at = rng.randint(0, len(k))
            keys.add(rng.choice((k[:at] + k[at + 1 :], k[:at] + "x" + k[at:], k[:at] + "y" + k[at + 1 :])) or "a")
    keys = sorted(keys)
    goals = keys[::3]
    want = {(k, g) for k in keys for g in goals if distance(k, g) <= min(near.edits(k), near.edits(g))}
    assert {(k, g) for k, gs in near.Near(goals).met(keys).items() for g in gs} == want and len(want) > len(goals)


def test_work_grows_with_words_not_with_pairs(monkeypatch):
    calls, within = [], near.within
    monkeypatch.setattr(near, "within", lambda *a: calls.append(1) or within(*a))
    rng = random.Random(3)
    keys = ["".join(rng.choices("abdefgiklmnoprstu", k=9)) for _ in range(2000)]
    near.Near(keys).met(keys)
    assert len(calls) < 0.05 * len(keys) ** 2


def test_keys_of_ascii_words(spark):
    words = ["Wright", "Xochitl", "phishy", "QUEEN", "Yves-y", "O'Hara", "xx9aa11", "ch", "h", "Geoffrey", "boxcar"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", T.phonetic_key(F.col("w")).alias("k")).collect()
    assert {r.w: r.k for r in got} == {w: near.ascii_key(w) for w in words}


def test_keys_are_measured_in_one_go_as_one_by_one():
    rng = random.Random(5)
    seen = near.Words(near.plain_key)
    for _ in range(20):
        seen.numbers(["".join(rng.choices("abcdehxyq9éß'😀", k=rng.randint(1, 12))) for _ in range(100)] + ["h"], {"😀": "😀"})
    assert [tuple(map(int, m)) for m in seen.masks[: len(seen.keys)]] == [(*near.letters(k), *near.packed(k)) for k in seen.keys] and "" in seen.keys
    assert seen.sizes[: len(seen.keys)].tolist() == list(map(len, seen.keys))


def test_words_of_near_letters_are_cut_as_spark_cuts_them(spark):
    near_by = [chr(c) for c in range(0x250) if not 0xB2 <= c <= 0xBE] + list("’‐–—“”…")
    texts = [f"a{c}e ph{c}c {c}'ge{c}-xy x{c}9{c}{c}q" for c in near_by] + ["a²b", "½ x", "e\u0301te", "ΟΔΟΣ a", "😀a", "", "it's l’été"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.regexp_like("t", F.lit(f"[{near.FAR}]")).alias("far"), T.words(F.col("t")).alias("ws"))
    rows = rows.select("*", F.transform("ws", T.phonetic_key).alias("ks"), F.transform("ws", T.fold).alias("fs")).collect()
    assert {r.t for r in rows if r.far} == {"a²b", "½ x", "e\u0301te", "ΟΔΟΣ a", "😀a"}
    for r in rows:
        parts = near._parts_of(r.t, r.ws if r.far else None)
        assert "".join(parts) == r.t and parts[1::2] == r.ws
        if not r.far:
            assert ([near.plain_key(w) for w in r.ws], [T.fold_word(w) for w in r.ws]) == (r.ks, r.fs), r.t
