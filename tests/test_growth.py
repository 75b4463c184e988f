"""What a step moves, and in how many tasks, must not hang on how small its table's file is."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import checks as K
from palimpsest.operators import detect as D
from palimpsest.operators import evaluate as E
from palimpsest.operators import redact as R
from palimpsest.plans.queries import ORACLES, QUERIES
from palimpsest.plans.sentences import sentences
from palimpsest.rules import Lineage

from .conftest import TABLES, duck_rows, spark_rows

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_records_are_never_copied_to_the_driver(spark):
    docs = sentences(spark, SF, "customer", "c_custkey", "'pay Acme Tools now'")
    roster = docs.select("record_id", F.lit("s").alias("subject_id"), F.lit("Acme Tools").alias("value"), F.lit("Organization").alias("kind"))
    for found in (D.known_values(docs, roster), D.deny_list(docs, roster)):
        assert "Broadcast" not in plan(found)
        assert found.count() == docs.count()


def test_ids_meet_a_value_once_whatever_its_subjects(spark, monkeypatch):
    ids = spark.range(50).select(F.lit("ann").alias("record_id"))
    roster = spark.range(50).select(F.lit("ann").alias("record_id"), F.concat(F.lit("s"), "id").alias("subject_id"), F.lit("Ann").alias("value"), F.lit("PatientName").alias("kind"))
    met, known = [], D.known_values
    monkeypatch.setattr(D, "known_values", lambda docs, people, *a: met.append(people.count()) or known(docs, people, *a))
    assert [tuple(r) for r in K.readable_ids(ids, roster).collect()] == [("ann", "ann")]
    assert met == [51]


def test_kinds_in_scope_compare_records_not_rows_of_kinds(spark):
    docs = spark.createDataFrame([(1,), (1,), (2,)], "record_id long")
    roster = spark.createDataFrame([(1, "PatientName"), (1, "Date"), (3, None), (3, "Phone")], "record_id long, kind string")
    got = K.in_scope(docs, roster, Lineage())
    rules = {r.kind for r in Lineage().compiled()[0]}
    want = {(1, k) for k in rules | {"PatientName"}} | {(2, k) for k in rules} | {(3, None), (3, "Phone")}
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert plan(got).index("Generate") < plan(got).index("Aggregate")


def test_distinct_spans_move_once_by_record(spark):
    spans = spark.range(100).selectExpr("id % 7 AS record_id", "CAST(id % 5 AS int) AS start", "3 AS len")
    found = R.islands(R.unique(spans))
    assert plan(found).count("Exchange") == 1
    assert found.count() == 35


def test_numbers_parted_by_one_character(spark, tmp_path):
    texts = ["b6405768150e0411590525cf", "6025550147 6025550148 6025550149", "+1 602-555-0147\n+1 602-555-0148", "6025550147\n", "6025550147", None, ""]
    for name in TABLES:
        rows = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
        (rows if name == "documents" else spark.range(1)).coalesce(1).write.parquet(f"{tmp_path}/parts/{name}")
        next((tmp_path / "parts" / name).glob("part-*.parquet")).rename(tmp_path / f"{name}.parquet")
    got = spark_rows(QUERIES["detect_phone"](spark, str(tmp_path)))
    assert got == duck_rows(ORACLES["detect_phone"], str(tmp_path)) and len(got[1]) == 7
    both = D.patterns(rows.select(F.col("doc_id").alias("record_id"), "text"), only=("phone-us",))
    assert sorted((r.record_id, r.start) for r in both.where("record_id < 3").collect()) == [(0, 1), (0, 12), (1, 0), (1, 11), (1, 22), (2, 0), (2, 16)]


def test_refused_texts_do_not_move(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "mail a@b.com"), (2, " x" * 500_001)], "record_id long, text string")
    moved, spliced = [], R.splice
    monkeypatch.setattr(R, "splice", lambda d, spans: moved.append(d.count()) or spliced(d, spans))
    out = R.redact(docs, find_relatives=False)
    assert moved == [1]
    assert {r.record_id: (len(r.text), r.redacted, r.refused) for r in out.documents.collect()} == {1: (12, "mail [EMAIL]", None), 2: (1_000_002, None, "more than 1000000 characters")}
    assert {r.record_id: r.withheld for r in out.manifest.collect()} == {1: False, 2: True}


def test_texts_are_parted_without_a_pattern_for_each_row(spark):
    texts = ["to Mesa, AZ 85004 and Flagstaff, Arizona", "\0to Mesa, AZ\0 to Mesa, AZ\0", "to", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "record_id long, text string")
    found = D.patterns(docs, only=("city-us",))
    assert "split(regexp_replace(" in plan(found)
    assert sorted((r.record_id, r.start, r.len) for r in found.collect()) == [(0, 3, 4), (0, 22, 9), (1, 4, 4), (1, 17, 4)]
    one = docs.where("record_id = 0").select(T.spans(F.lit("abcb"), "(?=a)|b").alias("s"))  # a hit without length stands first
    assert [(x.start, x.value) for x in one.first().s] == [(1, "b"), (3, "b")]
    assert docs.where("record_id = 0").select(T.to_digits(F.lit("Nine, zero two-one oh"), {"nine": "9", "zero": "0", "two": "2", "one": "1", "oh": "0"}).alias("d")).first().d == "90210"


def test_linkage_sums_words_before_names_meet_them(spark):
    texts = [(1, "Ana Roe stayed, Bo"), (1, "ana in 1999 with her niece"), (2, "BO in 2001, 1850 and 2001"), (2, None), (None, "Bo in 1950"), (3, "Caĺ is 90 or older"), (4, "ΟΔΟΣ.Α in 1905"), (5, "Ana of 2010")]
    docs = spark.createDataFrame(texts, "record_id long, text string")
    names = spark.createDataFrame([("Ana Roe",), ("Bo",), ("Bo",), ("Cál",), ("Cal",), ("ΟΔΟΣ",), ("Zoe",)], "name string")
    got = sorted(tuple(r) for r in E.linkage(docs, names, ["niece", *(f"k{i}" for i in range(70))], ["90 or older"]).collect())
    # Rows of a record are one text; the two spellings of a name are two names, and their heads nobody's.
    assert got == [("Ana Roe", 2, "1999,2010|false|niece", 1), ("Bo", 2, "1999,2001|false|niece", 1), ("Cal", 1, "|true|", 2), ("Cál", 1, "|true|", 2), ("ΟΔΟΣ", 1, "1905|false|", 1)]
    odd = spark.createDataFrame([("Él ́dit: ΟΔΟΣ.Α a'́b İstanbul l’été x́-y",), ("",), (None,), ("plain Words, ça va",)], "text string")
    assert [tuple(r) for r in odd.select(T.folded_words(F.col("text"))).collect()] == [tuple(r) for r in odd.select(F.transform(T.words(F.col("text")), T.fold)).collect()]


def test_united_spans_stay_with_their_records(spark):
    spans = spark.range(100).selectExpr("id % 7 AS record_id", "CAST(id % 50 AS int) AS start", "3 AS len", "IF(id % 2 = 0, 'a', 'b') AS kind")
    both = E.united(spans, "kind").groupBy("record_id").agg(F.sum(F.col("end") - F.col("start")).alias("n")).join(E.united(spans).groupBy("record_id").count().hint("merge"), "record_id")
    assert plan(both).count("Exchange hashpartitioning") == 2
    one = {(r.record_id, r.kind): [] for r in spans.collect()}
    for r in sorted(spans.distinct().collect(), key=lambda r: r.start):
        runs = one[r.record_id, r.kind]
        if runs and r.start <= runs[-1][1]:
            runs[-1][1] = r.start + 3
        else:
            runs.append([r.start, r.start + 3])
    assert sorted((r.record_id, r.kind, r.start, r.end) for r in E.united(spans, "kind").collect()) == sorted((*k, *x) for k, v in one.items() for x in v)


def test_a_text_is_moved_and_matched_once(spark):
    docs = spark.createDataFrame([(1, "Ana Ruiz, ana ruis. Ana! Ruiz"), (2, "Bo"), (3, None)], "record_id long, text string")
    roster = spark.createDataFrame([(1, "s", "Ana Ruiz", "PatientName"), (1, "t", "Ana", "PatientName"), (1, "u", "Ana", "PatientName"), (2, "s", "Ana", "PatientName")], "record_id long, subject_id string, value string, kind string")
    found = D.known_values(docs, roster)
    assert plan(found).count("SortMergeJoin") == 1
    assert sorted((r.subject_id, r.start, r.len, r.match) for r in found.collect()) == [("s", 0, 8, "Exact"), ("s", 10, 8, "Phonetic"), *((s, at, 3, "Exact") for s in "tu" for at in (0, 10, 20))]


#: For each rule a text that it finds, some in letters or white space that only Java takes for those of the rule.
FOUND = """email a@b.com|email-spoken ann at mail dot com|url see HTTP\u017f://x|ipv4 at 1.2.3.4|phone-us 602-555-0147|ssn-us 123-45-6789|record-number MRN: 12345|zip-us zip 85004
state-us in New\x0bYork|state-us W\u0131sconsin|state-us in Ala\u017fka|state-us Mesa,AZ|state-us AZ\x0b85004|city-us to Mesa, AZ|city-us to Mesa,\x0bArizona|street-us 12 North Oak St|street-us 12 1st Street|street-name-us Old\x0bMill Road
street-mx Av. de la Reforma 12|po-box P.O. Box 12|po-box apartado\x0bpostal 7|date-numeric 1/2/2020|date-month-en May\x0b2, 2020|date-month-es 2 de mayo|date-words-en may the twenty first|date-words-en second of may
date-words-es dos de ENERO|age-over-89 95 años|age-over-89-words ninety-one years old|age-over-89-said edad:\x0b91"""


def test_cues_stand_wherever_a_rule_finds(spark):
    cases = [x.split(" ", 1) for line in FOUND.split("\n") for x in line.split("|")]
    assert {rule for rule, _ in cases} == {r.id for r in Lineage().compiled()[0]}
    said = ["my number is five five five one two three four", "born in 1931", "Her m\u00e1dre, Ana Roe", "her SI\u017fTER\x0bAna", "nothing here", "", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([t for _, t in cases] + said)], "record_id long, text string").withColumn("recorded_on", F.lit("2026-01-01").cast("date"))
    read = D.cued(docs)
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    hits = rows(D.patterns(docs))
    assert {(i, f"pattern:{rule}") for i, (rule, _) in enumerate(cases)} <= {(h[0], h[4]) for h in hits}
    none = spark.createDataFrame([], D.patterns(docs).schema)
    for f in (D.patterns, D.spoken_digits, D.relatives, lambda d: D.birth_years(d, none)):
        assert rows(f(read)) == rows(f(docs)) != []
    assert {r.record_id for r in read.where(f"{D.CUED} = 0").collect()} >= {len(cases) + 4, len(cases) + 5, len(cases) + 6}
