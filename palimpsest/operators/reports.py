"""Reports and refusals: evaluation reports, published rates and their table, texts and paths not to be read, and the checks of a
blind study: its candidates and its adjudication."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..rules import KINDS, VERSION, Lineage, Policy
from . import evaluate as E


def vault_like(text: Column) -> Column:
    """Whether a text could be a vault, which is never read as a document: eager on purpose."""
    return F.contains(F.lower(text), F.lit('"pseudonym"')) | F.contains(text, F.lit("PAL-")) | F.regexp_like(text, F.lit(r'(?i)"subjects"\s*:\s*\{\s*"'))


def confined(path: str, root: str) -> str:
    """The real path, which must lie inside root: links and parent steps are followed first."""
    if not path.strip():
        raise ValueError("a path is needed")
    full, base = os.path.realpath(os.path.join(root, path)), os.path.realpath(root)
    if os.path.commonpath([full, base]) != base or full == base:
        raise ValueError("the path is outside the folder that may be touched")
    return full


def report(scores: DataFrame) -> DataFrame:
    """(configuration, documents, leaking, leaking_in_scope, recall, recall_in_scope, over) of the scores of `checks.evaluate`."""
    rates = E.leak_rate(scores, "configuration", "scope")
    side = lambda s, n: rates.where(F.col("scope") == s).select("configuration", F.col("documents").alias(f"documents{n}"), F.col("leaking").alias(f"leaking{n}"), F.col("pooled_recall").alias(f"recall{n}"), F.col("over").alias(f"over{n}"))
    rows = side("all", "").join(side("in", "_in_scope"), "configuration")
    return rows.select("configuration", "documents", "leaking", "leaking_in_scope", "recall", "recall_in_scope", "over")


def save_report(rows: DataFrame, path: str) -> None:
    rows.coalesce(1).write.json(path, mode="overwrite")  # a row a configuration


def published(rows: DataFrame, sources: DataFrame, corpus: str, measured_on: str, lineage: Lineage | None = None, policy: Policy | None = None) -> str:
    """The JSON of a measured rate: counts and dates, never percentages. rows: `report`; sources: (source, documents)."""
    import datetime

    datetime.date.fromisoformat(measured_on)
    lineage, policy = lineage or Lineage(), policy or Policy()
    made = [r.asDict() for r in rows.orderBy("configuration").collect()]  # a row a configuration
    if not corpus.strip() or not made:
        raise ValueError("a published rate needs a corpus and configurations")
    facts = {"corpus": corpus, "documents": made[0]["documents"], "sources": {r["source"]: r["documents"] for r in sources.orderBy("source").collect()}, "measuredOn": measured_on, "engine": VERSION}
    return json.dumps(facts | {"lineage": lineage.name, "lineageFingerprint": lineage.fingerprint(), "policyFingerprint": policy.fingerprint(), "configurations": made}, sort_keys=True)


def rate_text(leaking: int, documents: int) -> str:
    """leaking of documents, with its interval."""
    p, z2 = leaking / documents, E.Z * E.Z
    centre, half = p + z2 / (2 * documents), E.Z * (p * (1 - p) / documents + z2 / (4 * documents * documents)) ** 0.5
    low, high = max(0.0, (centre - half) / (1 + z2 / documents)), min(1.0, (centre + half) / (1 + z2 / documents))
    return f"{leaking}/{documents} = {p:.1%} (95 % CI {low:.1%} to {high:.1%})"


def table(published_json: str) -> str:
    """The published rate as a table of a page."""
    x = json.loads(published_json)
    rows = [f"| {x['documents']} documents, {x['measuredOn']}, engine {x['engine']} | every kind | in scope | recall in scope |", "|-|-|-|-|"]
    for c in x["configurations"]:
        rows.append(f"| {c['configuration']} | {rate_text(c['leaking'], c['documents'])} | {rate_text(c['leaking_in_scope'], c['documents'])} | {c['recall_in_scope']:.3f} |")
    return "\n".join(rows)


def replaced_block(page: str, name: str, contents: str) -> str:
    """The page with what stands between its marks <!-- name:start ... --> and <!-- name:end replaced, in the page's line ends."""
    start, end = page.find(f"<!-- {name}:start"), page.find(f"<!-- {name}:end")
    close = page.find("-->", start)
    if start < 0 or end <= start or not start < close < end:
        raise ValueError(f"the page has no block {name}")
    line = "\r\n" if "\r\n" in page else "\n"
    return page[: close + 3] + line + line.join(contents.splitlines()) + line + page[end:]


def corpus_caveats(docs: DataFrame, gold: DataFrame, few: int = 30) -> DataFrame:
    """(documents, sources, twice_annotated, caveats): what a gold corpus can't show."""
    who = gold.groupBy("record_id").agg(F.countDistinct("annotator").alias("n"))
    rows = docs.join(who, "record_id", "left").agg(F.count("*").alias("documents"), F.countDistinct("source").alias("sources"), F.count_if(F.coalesce("n", F.lit(0)) >= 2).alias("twice_annotated"))
    parts = ((F.col("documents") < few, f"fewer than {few} documents"), (F.col("sources") > 1, "several sources"), (F.col("twice_annotated") == 0, "a single annotator"))
    return rows.withColumn("caveats", F.array_compact(F.array(*(F.when(c, F.lit(t)) for c, t in parts))))


IDENTIFIER = "^[a-z][a-z0-9-]{0,63}$"


def candidate_faults(docs: DataFrame, roster: DataFrame, scenarios: dict[str, dict[str, int]], source: str, recorded_on: str, most: int = 10_000) -> DataFrame:
    """(record_id, fault) of a study's candidates (record_id, case_group, scenario, source, language, recorded_on, text) and their
    rosters; scenarios gives the number of documents of each language. Faults of the whole set have a null record_id."""
    known = F.array(*map(F.lit, scenarios))
    languages = F.array(*map(F.lit, sorted({x for c in scenarios.values() for x in c})))
    bad = lambda c: ~F.coalesce(F.regexp_like(c, F.lit(IDENTIFIER)), F.lit(False))
    no = lambda c: F.coalesce(~c, F.lit(True))
    tests = (
        (bad(F.col("record_id")), "odd id"),
        (F.col("times") > 1, "repeated id"),
        (bad(F.col("case_group")), "odd case group"),
        (no(F.array_contains(known, F.col("scenario"))) | no(F.array_contains(languages, F.col("language"))), "unknown scenario or language"),
        (no(F.col("source") == source) | no(F.col("recorded_on").cast("string") == recorded_on), "odd source or date"),
        (no(F.length("text").between(1, most)), "odd length"),
    )
    out = docs.withColumn("times", F.count("*").over(W.partitionBy("record_id"))).select("record_id", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(t)) for c, t in tests)))).alias("fault"))
    listed = bad(F.col("subject_id")) | no(F.length(F.trim("value")) > 0) | no(F.col("kind").isin(*KINDS))
    out = out.unionByName(roster.where(listed).select("record_id", F.lit("odd roster entry").alias("fault")))
    owners = roster.join(docs.select("record_id", "case_group"), "record_id").withColumn("n", F.size(F.collect_set(F.struct("value", "case_group")).over(W.partitionBy("subject_id"))))
    out = out.unionByName(owners.where("n > 1").select("record_id", F.lit("a subject changes").alias("fault")))
    wanted = docs.sparkSession.createDataFrame([(s, x, n) for s, c in scenarios.items() for x, n in c.items()], "scenario string, language string, n long")
    balance = wanted.join(docs.groupBy("scenario", "language").count(), ["scenario", "language"], "full_outer").where("NOT (n <=> count)")
    return out.unionByName(balance.select(F.lit(None).cast("string").alias("record_id"), F.concat_ws(" ", F.lit("unbalanced:"), "scenario", "language").alias("fault"))).distinct()


def adjudicated(docs: DataFrame, a: DataFrame, b: DataFrame, decisions: DataFrame, own: DataFrame, annotator: str) -> tuple[DataFrame, DataFrame]:
    """Gold spans (record_id, start, len, kind, annotator) that an adjudicator's decisions (record_id, selected: A, B or null) make of
    two reviews, with spans of their own where none is selected; and (record_id, fault) of what must be put right first."""
    keys = ["record_id", "start", "len", "kind"]
    ids = docs.select("record_id").distinct()
    faults = decisions.groupBy("record_id").count().where("count > 1").select("record_id", F.lit("decided twice").alias("fault"))
    faults = faults.unionByName(ids.join(decisions, "record_id", "left_anti").select("record_id", F.lit("not decided").alias("fault"))).unionByName(decisions.join(ids, "record_id", "left_anti").select("record_id", F.lit("unknown document").alias("fault")))
    faults = faults.unionByName(decisions.where("selected IS NOT NULL AND selected NOT IN ('A', 'B')").select("record_id", F.lit("odd decision").alias("fault")))
    faults = faults.unionByName(own.join(decisions.where("selected IS NOT NULL"), "record_id", "left_semi").select("record_id", F.lit("a selection and spans").alias("fault")))
    side = lambda x, s: x.select(*keys).distinct().join(decisions.where(F.col("selected").eqNullSafe(s)).select("record_id"), "record_id")
    final = side(a, "A").unionByName(side(b, "B")).unionByName(side(own, None))
    n = docs.select("record_id", F.length("text").alias("n"))
    outside = final.join(n, "record_id").where("start < 0 OR len <= 0 OR start + len > n")
    faults = faults.unionByName(outside.select("record_id", F.lit("outside the text").alias("fault"))).unionByName(final.where(~F.col("kind").isin(*KINDS)).select("record_id", F.lit("odd kind").alias("fault")))
    return final.withColumn("annotator", F.lit(annotator)), faults.distinct()


def survivors(docs: DataFrame, gold: DataFrame) -> DataFrame:
    """(record_id, start, len, kind, survives): gold spans of docs (record_id, text, redacted) that stand in the redacted text."""
    return E.surviving(gold.select("record_id", "start", "len", "kind"), docs)

