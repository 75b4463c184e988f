"""Files, evaluation, reviews, alignment, streaming, and every query against its SQL."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from palimpsest.operators import alignment as A
from palimpsest.operators import checks as K
from palimpsest.operators import detect as D
from palimpsest.operators import evaluate as E
from palimpsest.operators import redact as R
from palimpsest.operators import vault as V
from palimpsest.plans.queries import ORACLES, QUERIES
from palimpsest.rules import Lineage
from palimpsest.sources import files
from palimpsest.streaming.redaction import redact_stream

from .conftest import duck_rows, spark_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, SF)) == duck_rows(ORACLES[name], SF)


def test_entry(spark):
    assert entry.entry(spark).count() == 200
    assert set(entry.oracle_sql()) <= set(entry.queries())


def gold_folder(tmp_path, **changes):
    doc = {"documentId": "d1", "source": "s", "recordedOn": "2026-01-01", "text": "\U0001f600 Ann Lee called 602-555-0147.", "roster": [{"value": "Ann Lee", "kind": "patientname", "subjectId": "p1"}], "spans": [{"start": 3, "length": 7, "kind": "PatientName", "annotator": "x"}, {"start": 18, "length": 12, "kind": "Phone", "annotator": "x"}]} | changes
    (tmp_path / "deep").mkdir(exist_ok=True)
    (tmp_path / "deep" / "one.json").write_text(json.dumps(doc))
    return str(tmp_path)


def test_gold_and_evaluation(spark, tmp_path):
    docs, people, spans = files.gold(spark, gold_folder(tmp_path))
    assert sorted((r.start, r.len) for r in spans.collect()) == [(2, 7), (17, 12)]
    scores, kinds = K.evaluate(docs, people, spans)
    got = {(r.configuration, r.scope): r for r in scores.collect()}
    assert set(got) == {(c, s) for c in K.CONFIGURATIONS for s in ("in", "all")}
    assert got["full", "all"].recall == 1.0 and not got["full", "all"].leaked
    assert got["patterns-only", "all"].covered == 12 and got["patterns-only", "all"].leaked
    assert got["known-values-only", "all"].covered == 7
    rate = E.leak_rate(scores, "configuration", "scope").where("configuration = 'full' AND scope = 'all'").first()
    assert rate.rate == 0 and rate.lower == 0 and rate.upper > 0.5
    assert K.described(docs, spans).first().asDict() == {"source": "s", "documents": 1, "twice_annotated": 0}
    for bad in ({"text": None}, {"spans": [{"start": 3, "length": 99, "kind": "Phone", "annotator": "x"}]}, {"spans": [{"start": 3, "length": 2, "kind": "Phone"}]}):
        with pytest.raises(ValueError):
            files.gold(spark, gold_folder(tmp_path, **bad))


def test_rosters_and_texts(spark, tmp_path):
    (tmp_path / "r.json").write_text('[{"value": "Ann", "kind": "staffNAME", "subjectId": "s"}]')
    assert files.roster_json(spark, str(tmp_path / "r.json")).first().asDict() == {"subject_id": "s", "value": "Ann", "kind": "StaffName"}
    (tmp_path / "bad.json").write_text('[{"value": "Ann", "kind": "nope", "subjectId": "s"}]')
    with pytest.raises(ValueError, match="1 roster"):
        files.roster_json(spark, str(tmp_path / "bad.json"))
    lines = spark.createDataFrame([(" Ann | phone | s ",), ("  ",)], "line string")
    assert [tuple(r) for r in files.roster_inline(lines).collect()] == [("s", "Ann", "Phone")]
    for line in ("bad|line", "Ann|nope|s"):
        with pytest.raises(ValueError, match="1 roster"):
            files.roster_inline(spark.createDataFrame([(line,)], "line string"))
    (tmp_path / "t.txt").write_text("﻿hello\nthere")
    assert files.transcripts(spark, str(tmp_path / "t.txt")).first().asDict() == {"record_id": "t.txt", "text": "hello\nthere"}
    (tmp_path / "z.json").write_text('{"populations": {"850": 5, "001": 1}}')
    assert {tuple(r) for r in files.zips_json(spark, str(tmp_path / "z.json")).collect()} == {("850", 5), ("001", 1)}


def test_vault_files(spark, tmp_path):
    path = f"{tmp_path}/vault"
    assert files.load_vault(spark, path).isEmpty()
    one = V.minted(spark.createDataFrame([("b",), ("a",), ("a",), ("",)], "subject_id string"), V.empty(spark), Lineage())
    files.save_vault(one, path)
    stored = files.load_vault(spark, path)
    two = V.minted(spark.createDataFrame([("a",), ("c",)], "subject_id string"), stored, Lineage())
    files.save_vault(two, path)
    assert {r.subject_id for r in files.load_vault(spark, path).collect()} == {"a", "b", "c"}
    names = {r.subject_id: r.surrogate for r in two.collect()}
    assert len(set(names.values())) == 3
    with pytest.raises(ValueError, match="lacks"):
        files.save_vault(one, path)
    files.save_vault(V.remint(two, spark.createDataFrame([("a", "New Name")], "subject_id string, surrogate string")), path)
    assert files.load_vault(spark, path).where("subject_id = 'a'").first().retired == [names["a"]]
    schema = "subject_id string, surrogate string"
    for clash in ([("a", "Other")], [("z", names["b"])], [("y", "Same"), ("z", "Same")], [("z", "One"), ("z", "Two")]):
        with pytest.raises(ValueError):
            V.assign(two, spark.createDataFrame(clash, schema))
    again = V.remint(two, spark.createDataFrame([("a", "New Name")], schema))
    for clash in ([("b", names["a"])], [("b", names["c"])], [("b", "New Name")]):
        with pytest.raises(ValueError, match="taken"):
            V.remint(again, spark.createDataFrame(clash, schema))
    more = V.minted(spark.createDataFrame([(f"n{i}",) for i in range(60)], "subject_id string"), again, Lineage())
    given = [r.surrogate for r in more.collect()]
    assert len(set(given)) == 63 and names["a"] not in given
    codes = [r.pseudonym for r in more.collect()]
    assert len(set(codes)) == 63 and codes == [r.pseudonym for r in more.collect()]
    with pytest.raises(ValueError, match="exhausted"):
        V.minted(spark.createDataFrame([(f"m{i}",) for i in range(60)], "subject_id string"), more, Lineage())
    renamed = V.reminted(spark.createDataFrame([("b",)], "subject_id string"), again, Lineage()).where("subject_id = 'b'").first()
    assert renamed.retired == [names["b"]] and renamed.surrogate not in given[:3]


def test_results_ids_and_caveats(spark, tmp_path):
    docs = spark.createDataFrame([("r1", "Ann called 602-555-0147"), ("602-555-0147", "nothing"), ("r3", None)], "record_id string, text string")
    roster = spark.createDataFrame([("r1", "s1", "Ann", "PatientName")], "record_id string, subject_id string, value string, kind string")
    out = R.redact(docs, roster)
    files.save_result(out, f"{tmp_path}/out")
    assert spark.read.parquet(f"{tmp_path}/out/texts").count() == 3 and spark.read.json(f"{tmp_path}/out/manifest").count() == 3
    assert [r.id for r in K.readable_ids(docs, roster).collect()] == ["602-555-0147"]
    assert {r.record_id: r.reason for r in K.withheld(out.manifest, out.applied, roster).collect()} == {"r1": None, "602-555-0147": "no roster", "r3": "no roster"}
    assert all("Some kinds are kept on purpose." in r.caveats for r in K.caveats(out.manifest).collect())


def test_reviews(spark):
    schema = "record_id string, start int, len int, kind string"
    a = spark.createDataFrame([("d", 0, 3, "Phone"), ("d", 5, 2, "Date")], schema)
    b = spark.createDataFrame([("d", 0, 3, "Phone"), ("d", 5, 2, "Email"), ("e", 1, 1, "Date")], schema)
    assert {tuple(r) for r in K.compared(a, b).collect()} == {("d", 1, 1, 1), ("e", 0, 0, 1)}
    docs = spark.createDataFrame([("d", "abcdef")], "record_id string, text string")
    quotes = a.withColumn("quote", F.lit("abc"))
    assert [r.start for r in K.misquoted(docs, quotes).collect()] == [5]


def test_alignment(spark):
    script = "Hello [[PatientName|Eleanor Vasquez]], call [[Phone|five five]] or [[City|Mesa]]."
    assert A.marked("a [[City|Mesa]] b") == ("a Mesa b", [(2, 4, "City")])
    pairs = spark.createDataFrame([("d", script, "Hello Ellenor Vasques, call five five or.")], "record_id string, script string, heard string")
    got = {r.kind: (r.start, r.len, r.flag) for r in A.align(pairs).collect()}
    assert got["PatientName"] == (6, 15, "ok") and got["Phone"] == (28, 9, "ok") and got["City"][2] in ("deleted", "boundary")
    fixed = A.corrected(A.align(pairs), spark.createDataFrame([("d", "Phone", 1, 27, 10)], "record_id string, kind string, nth int, start int, len int"))
    assert {r.kind: r.flag for r in fixed.collect()}["Phone"] == "reviewed"
    assert A.survival("Ann Lee 12", "Ann x 12", [(0, 7), (8, 2), (4, 3)]) == ["partial", "whole", "gone"]


def test_long_runs(spark):
    """No rule, word or run of numbers exhausts the stack, and a text beyond the limit costs no other row."""
    texts = ["one two " * 5_000, "a" + "-b" * 5_000, "mail x" + " dot y" * 500 + " at c" + " dot d" * 5_000 + " dot com", "Calle " + "de " * 5_000 + "Luz", "@" * 5_000, "1." * 5_000, " " * 5_000, "Ab " * 5_000, "x" * 1_000_001]
    docs = spark.createDataFrame(list(enumerate(texts)), "record_id long, text string").repartition(8)
    out = R.redact(docs.where("record_id <> 7"), find_relatives=False)
    state = {r.record_id: (r.refused, r.withheld) for r in out.manifest.collect()}
    assert state[8] == ("more than 1000000 characters", True) and sum(w for _, w in state.values()) == 1
    got = {r.record_id: r.redacted for r in out.documents.where("record_id IN (0, 2, 8)").collect()}
    assert got == {0: "[REMOVED] ", 2: "mail [EMAIL]", 8: None}
    assert D.relatives(docs.where("record_id = 7")).count() == 0


def test_too_many_candidates(spark):
    docs = spark.createDataFrame([(1, "a@b.com " * 30), (2, "a@b.com")], "record_id long, text string")
    out = R.redact(docs, find_relatives=False, most_candidates=10)
    assert {r.record_id: (r.refused, r.withheld) for r in out.manifest.collect()} == {1: ("more than 10 candidates", True), 2: (None, False)}


def test_places_of_many_hits(spark):
    import re

    from palimpsest.functions import text as T

    for text in ("", "x", "a1b22 " * 700, "7" + "é😀9" * 900):
        df = spark.createDataFrame([(text,)], "text string")
        row = df.select(T.spans(F.col("text"), "[0-9]+").alias("s"), T.tokens(F.col("text")).alias("t"), T.part(T.chunks(F.col("text")), F.lit(1020), F.lit(1100)).alias("p")).first()
        assert [(s.start, s.value) for s in row.s] == [(m.start(), m.group()) for m in re.finditer("[0-9]+", text)]
        assert all(text[t.start : t.start + t.len] == t.word and text[t.start + t.len :].startswith(t.gap) for t in row.t)
        assert row.p == text[1020:2120]


def test_bootstrap_against_brute_force(spark):
    rows = [(i, i % 5, 5, bool(i % 5 < 5 and i % 3)) for i in range(40)]
    a = spark.createDataFrame(rows, "record_id long, covered long, sensitive long, leaked boolean")
    b = spark.createDataFrame([(i, 4, 5, bool(i % 2)) for i, *_ in rows], a.schema)
    got = E.paired(a, b, resamples=200).first()
    hashes = {r.record_id: r.h for r in a.select("record_id", F.xxhash64("record_id", F.lit(20260916)).alias("h")).collect()}
    import numpy as np

    u = E.uniform(np.array([hashes[i] for i, *_ in rows]), 200)
    below = np.cumsum([np.exp(-1) / np.prod(range(1, k + 1)) for k in range(18)])
    w = (u[:, :, None] >= below).sum(axis=2)
    diffs = [sum(w[i, s] * (c / 1) for i, (_, c, _, _) in enumerate(rows)) / (5 * w[:, s].sum()) - 0.8 for s in range(200)]
    assert abs(got.recall_difference - (sum(r[1] for r in rows) / 200 - 0.8)) < 1e-12
    assert np.allclose([got.recall_lower, got.recall_upper], np.quantile(diffs, [0.025, 0.975])) and abs(w.mean() - 1) < 0.1


def test_islands_invariants(spark):
    rows = [(i % 7, (i * 37) % 60, i % 9 + 1, "Phone" if i % 2 else "PatientName", f"d{i % 3}", 0.9, f"s{i % 4}" if not i % 2 else None, "Exact") for i in range(200)]
    df = spark.createDataFrame(rows, "record_id int, start int, len int, kind string, detector_id string, confidence double, subject_id string, match string")
    out = R.resolve(df)
    spans = [(r.record_id, r.start, r.start + r.len) for r in out.collect()]
    assert all(any(d == r and s <= a and b <= e for d, s, e in spans) for r, a, b in ((x[0], x[1], x[1] + x[2]) for x in rows))
    assert all(b <= c for r in range(7) for (_, _, b), (_, c, _) in zip(*(sorted(x for x in spans if x[0] == r)[k:] for k in (0, 1)), strict=False))
    key = lambda d: sorted(map(repr, d.collect()))
    assert key(R.resolve(df.orderBy(F.rand(3)))) == key(out)


def test_stream(spark, tmp_path):
    docs = spark.createDataFrame([(1, "mail a@b.com"), (2, "call 602-555-0147")], "record_id long, text string")
    docs.write.parquet(f"{tmp_path}/in")
    query = redact_stream(spark.readStream.schema(docs.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/check")
    query.awaitTermination(120)
    assert {r.redacted for r in spark.read.parquet(f"{tmp_path}/out/texts").collect()} == {"mail [EMAIL]", "call [PHONE]"}


def test_long_roster_values(spark):
    docs = spark.createDataFrame([(1, "the Banner North West Valley Health Group said")], "record_id long, text string")
    roster = spark.createDataFrame([(1, "o", "Banner North West Valley Health Group", "Organization")], "record_id long, subject_id string, value string, kind string")
    assert [(r.start, r.len) for r in D.known_values(docs, roster).collect()] == [(4, 37)]
