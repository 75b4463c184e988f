"""Overlap resolution, replacement under a policy, read-back and manifests."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..rules import DIGITS, KEPT_PREFIXES, KINDS, MAX_CANDIDATES, ORDINAL, UNKNOWN_LABEL, VERSION, ZIP_THRESHOLD, Lineage, Policy, rule_print
from ..sources.tables import beside, scratch, spread, written
from . import detect as D
from . import vault as V


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def ordinal(kind: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in ORDINAL.items() for x in kv)), kind)


def permitted(candidates: DataFrame, policy: Policy) -> DataFrame:
    """Confident enough, and of a kind that is not kept."""
    return candidates.where((F.col("confidence") >= policy.min_confidence) & (F.coalesce(F.element_at(_map(policy.actions), F.col("kind")), F.lit("Label")) != "Keep"))


def islands(spans: DataFrame, touching: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Adds `island`: runs of spans of a record (and of equal columns `by`) that overlap (or also touch)."""
    order = ["start", F.desc("len"), F.desc("confidence"), ordinal(F.col("kind")), F.asc_nulls_first("subject_id"), "detector_id"] if "confidence" in spans.columns else ["start", F.desc("len")]
    w = W.partitionBy("record_id", *by).orderBy(*order)
    before = F.max(F.col("start") + F.col("len")).over(w.rowsBetween(W.unboundedPreceding, -1))
    apart = F.col("start") > before if touching else F.col("start") >= before
    return spans.withColumn("island", F.sum(F.when(before.isNull() | apart, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))


def unique(spans: DataFrame) -> DataFrame:
    """Distinct spans, moved by record first: what a task holds is its share of the records, and islands need no further move."""
    return spread(spans, "record_id").distinct()


def resolve(candidates: DataFrame, policy: Policy | None = None) -> DataFrame:
    """One span for each island: (record_id, start, len, kind, detector_id, confidence, subject_id, match, ambiguous).

    The longest, then most confident candidate gives kind, detector and match. Those that cover the whole span say whose it is;
    without any, all candidates must agree."""
    policy = policy or Policy()
    rows = islands(unique(permitted(candidates, policy)))
    rank = F.struct(-F.col("len"), -F.col("confidence"), F.col("start"), ordinal(F.col("kind")), F.coalesce("subject_id", F.lit("")), F.col("detector_id"))
    who, named = F.coalesce("subject_id", F.lit("\0")).alias("who"), F.coalesce("subject_id", F.lit("")) != ""
    made = rows.groupBy("record_id", "island").agg(
        F.min("start").alias("start"),
        F.max(F.col("start") + F.col("len")).alias("hi"),
        F.min_by(F.struct("kind", "detector_id", "confidence", "match", "subject_id"), rank).alias("a"),
        F.count("*").alias("n"),
        # Of the longest candidates, named ones first, the greatest subject and the least: they cover the span if any does.
        F.max(F.struct("len", named.alias("named"), who)).alias("most"),
        F.min(F.struct(-F.col("len"), ~named, who)).alias("least"),
        F.min(who).alias("from"),
        F.max(who).alias("to"),
        F.min("subject_id").alias("any"),
        F.max(named).alias("someone"),
    )
    made = made.withColumn("len", (F.col("hi") - F.col("start")).cast("int"))
    covered, alone = F.col("most.len") == F.col("len"), F.col("most.who") == F.col("least.who")
    subject = F.when(F.col("n") == 1, F.col("a.subject_id")).when(covered, F.when(F.col("most.named") & alone, F.col("most.who")).otherwise("")).when(F.col("from") == F.col("to"), F.col("any")).otherwise("")
    surrogate = F.coalesce(F.element_at(_map(policy.actions), F.col("a.kind")), F.lit("Label")) == "Surrogate"
    unsure = (F.col("n") > 1) & F.col("someone") & surrogate & F.when(covered, F.col("most.named") & ~alone).otherwise(F.col("from") != F.col("to"))
    return made.select("record_id", "start", "len", "a.kind", "a.detector_id", "a.confidence", subject.alias("subject_id"), "a.match", unsure.alias("ambiguous"))


def year_only(value: Column, label: str) -> Column:
    year = F.regexp_extract(value, r"\b(1[5-9][0-9]{2}|20[0-9]{2})\b", 1)
    return F.when(year != "", year).otherwise(F.lit(label))


def zip_digits(value: Column) -> Column:
    """The digits of a postal code, written or said."""
    return F.when(T.has_digit(value), F.regexp_replace(value, "[^0-9]", "")).otherwise(F.coalesce(T.to_digits(value, DIGITS), F.lit("")))


def kept_prefix(prefix: Column) -> Column:
    """Whether the census counts more than the threshold behind a prefix."""
    return F.coalesce(prefix.isin(*sorted(KEPT_PREFIXES)), F.lit(False))


def zip_prefix(value: Column, population: Column | None, label: str, threshold: int = ZIP_THRESHOLD) -> Column:
    """The first three digits and XX where the prefix has people enough (by `population`, or by the built-in table), else 000XX; a
    label unless 5 or 9 digits."""
    digits = zip_digits(value)
    kept = kept_prefix(F.substring(digits, 1, 3)) if population is None else F.coalesce(population, F.lit(0)) > threshold
    return F.when(~F.length(digits).isin(5, 9), F.lit(label)).otherwise(F.concat(F.when(kept, F.substring(digits, 1, 3)).otherwise("000"), F.lit("XX")))


def fit(surrogate: Column, mention: Column, heads: list[str] | None = None) -> Column:
    """The whole invented name for a mention of several words, else its head: the longest of `heads` that begins it, or its first word."""
    return F.when(F.size(T.words(mention)) > 1, surrogate).otherwise(V.head(surrogate, heads))


def _valued(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """spans with `value`, the text they cover. A text meets its spans once, as a list, not once for each of them."""
    names = [c for c in spans.columns if c != "record_id"]
    lists = spans.groupBy("record_id").agg(F.collect_list(F.struct(*names)).alias("xs"))
    rows = beside(lists, docs.select("record_id", T.chunks(F.col("text")).alias("ps")))
    with_value = F.transform("xs", lambda x: F.struct(*(x[c].alias(c) for c in names), T.part(F.col("ps"), x["start"], x["len"]).alias("value")))
    return rows.select("record_id", F.explode(with_value).alias("x")).select("record_id", "x.*")


def replaced(docs: DataFrame, spans: DataFrame, vault: DataFrame | None, policy: Policy, lineage: Lineage, zips: DataFrame | None = None) -> DataFrame:
    """spans with `replacement`, and `unavailable`: the kind, where a name was due and the lineage has no pool to invent it from."""
    rows = _valued(docs, spans)
    if vault is None:
        rows = rows.withColumn("surrogate", F.lit(None).cast("string"))
    else:
        rows = rows.join(vault.select("subject_id", "surrogate"), "subject_id", "left")
    if zips is None:
        rows = rows.withColumn("population", F.lit(None).cast("long"))
    else:
        rows = rows.withColumn("prefix", F.substring(zip_digits(F.col("value")), 1, 3)).join(zips.select("prefix", "population"), "prefix", "left").drop("prefix")
    label = F.coalesce(F.element_at(_map(lineage.labels), F.col("kind")), F.lit(UNKNOWN_LABEL))
    action = F.coalesce(F.element_at(_map(policy.actions), F.col("kind")), F.lit("Label"))
    code = zip_prefix(F.col("value"), None if zips is None else F.col("population"), lineage.labels.get("PostalCode", UNKNOWN_LABEL))
    wide = F.when(F.col("kind") == "PostalCode", code).otherwise(F.coalesce(F.element_at(_map(lineage.generalizations or {"": ""}), F.col("kind")), label))
    due = (action == "Surrogate") & (F.coalesce("subject_id", F.lit("")) != "")
    named = F.coalesce(fit(F.col("surrogate"), F.col("value"), lineage.heads()), label)
    out = F.when(due, named).when(action == "YearOnly", year_only(F.col("value"), lineage.labels.get("Date", UNKNOWN_LABEL))).when(action == "Generalize", wide).otherwise(label)
    poolless = F.when(due & F.col("surrogate").isNull() & ~F.col("kind").isin(*lineage.minted_kinds()), F.col("kind"))
    return rows.withColumn("replacement", out).withColumn("unavailable", poolless).drop("surrogate", "population", "value")


def splice(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs with `redacted`: each span's text replaced, gaps copied."""
    lists = spans.groupBy("record_id").agg(F.sort_array(F.collect_list(F.struct("start", "len", "replacement"))).alias("xs"))
    rows = beside(docs, lists, how="left")

    def made(ps: Column) -> Column:
        end = lambda i: F.when(i == 0, 0).otherwise(F.get("xs", i - 1)["start"] + F.get("xs", i - 1)["len"])
        pieces = F.transform("xs", lambda x, i: F.concat(T.part(ps, end(i), x["start"] - end(i)), x["replacement"]))
        tail = F.element_at("xs", -1)["start"] + F.element_at("xs", -1)["len"]
        return F.concat(F.array_join(pieces, ""), T.part(ps, tail, F.length("text") - tail))

    return rows.withColumn("redacted", F.when(F.col("xs").isNull(), F.col("text")).otherwise(T.bound(T.chunks(F.col("text")), made))).drop("xs")


def detect(docs: DataFrame, roster: DataFrame, detectors: Sequence[D.Detector]) -> DataFrame:
    """Candidates of the detectors and of said digits; years of birth are read against them (`detect.birth_years`)."""
    found = D.spoken_digits(docs)
    for d in detectors:
        found = found.unionByName(d.detect(docs, roster).select(*D.CANDIDATE))
    return found


@dataclass
class Result:
    """Redacted texts, the spans applied, what the read-back still finds, and a manifest row for each record."""

    documents: DataFrame
    applied: DataFrame
    residue: DataFrame
    manifest: DataFrame


def _resolved(docs: DataFrame, roster: DataFrame, detectors: Sequence[D.Detector], policy: Policy, most: int) -> tuple[DataFrame, DataFrame]:
    """Spans, and the records (record_id) that have more candidates than the limit: they get none."""
    found = written(detect(docs, roster, detectors), "found")
    crowded = written(found.groupBy("record_id").agg(F.count("*").alias("n")).where(F.col("n") > most).select("record_id"), "crowded")
    found = beside(found, crowded, how="left_anti")
    return resolve(D.birth_years(docs, found) if "recorded_on" in docs.columns else found, policy), crowded


def redact(docs: DataFrame, roster: DataFrame | None = None, vault: DataFrame | None = None, policy: Policy | None = None, lineage: Lineage | None = None, zips: DataFrame | None = None, detectors: Sequence[D.Detector] | None = None, find_relatives: bool = True, measured: str | None = None, most_candidates: int = MAX_CANDIDATES) -> Result:
    """Detects, resolves, replaces and reads its own output back with the same detectors and roster.

    A text beyond the limits is not read: its `redacted` is null and its manifest row withheld with the reason; the rest goes on."""
    policy, lineage = policy or Policy(), lineage or Lineage()
    detectors = list(detectors) if detectors is not None else [D.Patterns(lineage), D.KnownValues(lineage)]
    with scratch(docs.sparkSession):
        # Texts are made and measured once. One beyond the limit stays where it is: it meets no spans and moves with no records.
        whole = D.cued(D.guarded(docs).withColumn("__long", F.col("refused").isNotNull()), F.when(F.col("refused").isNull(), F.col("text")))
        whole = written(whole, "texts", keep=True, by="__long")
        docs = D.placed(whole.where("NOT __long").drop("__long"))
        unread = whole.where("__long").drop("__long", D.CUED).withColumn("redacted", F.lit(None).cast("string"))
        wide = roster if roster is not None else docs.sparkSession.createDataFrame([], ROSTER).withColumn("record_id", F.col("record_id").cast(docs.schema["record_id"].dataType))
        people = written(D.unlisted(docs, wide, lineage), "unlisted", keep=True) if find_relatives else None
        if people is not None:
            wide = written(D.widened(wide, people), "roster")
        spans, crowded = _resolved(docs, wide, detectors, policy, most_candidates)
        applied = written(replaced(docs, spans, vault, policy, lineage, zips), "applied", keep=True)
        out = splice(_refused(docs.drop(D.CUED), crowded, most_candidates), applied).withColumnRenamed("redacted", "__redacted")
        out = T.once(out, redacted=F.when(F.col("refused").isNull(), F.col("__redacted"))).drop("__redacted")
        out = written(D.cued(out, "redacted"), "redacted", keep=True)
        again = D.placed(out.where("refused IS NULL")).select(*[c for c in docs.columns if c not in ("text", "refused")], F.col("redacted").alias("text"))
        left, crowded = _resolved(again, wide, detectors, policy, most_candidates)
        residue, crowded = written(left, "residue", keep=True), written(crowded, "crowded", keep=True)
    out = _refused(out.drop(D.CUED), crowded, most_candidates).unionByName(unread)
    return Result(out, applied, residue, manifest(out, applied, residue, policy, lineage, detectors, people, zips is None, measured))


def _refused(docs: DataFrame, crowded: DataFrame, most: int) -> DataFrame:
    why = F.coalesce("refused", F.when(F.col("crowded"), f"more than {most} candidates"))
    return beside(docs, crowded.withColumn("crowded", F.lit(True)), how="left").withColumn("refused", why).drop("crowded")


ROSTER = "record_id string, subject_id string, value string, kind string"


def counted(spans: DataFrame, by: str) -> DataFrame:
    """(record_id, map of counts by `by`)."""
    return spans.groupBy("record_id", by).count().groupBy("record_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(by, F.col("count").cast("int"))))).alias(f"by_{by}"))


def manifest(out: DataFrame, applied: DataFrame, residue: DataFrame, policy: Policy, lineage: Lineage, detectors: Sequence[D.Detector] = (), people: DataFrame | None = None, census: bool = True, measured: str | None = None) -> DataFrame:
    """A row for each record: what was found, replaced and left, and by which rules, policy and lineage."""
    detectors = detectors or [D.Patterns(lineage), D.KnownValues(lineage)]
    rows = out.select("record_id", F.length("text").alias("text_length"), T.digest(F.col("text")).alias("input_sha256"), T.digest(F.col("redacted")).alias("output_sha256"), "refused", *([F.year("recorded_on").alias("age_reference")] if "recorded_on" in out.columns else [F.lit(None).cast("int").alias("age_reference")]))
    for by in ("kind", "detector_id", "match"):
        rows = beside(rows, counted(applied, by), how="left")
    facts = applied.groupBy("record_id").agg(F.countDistinct(F.when(F.col("subject_id") != "", F.col("subject_id"))).alias("subjects"), F.count_if("ambiguous").alias("ambiguous_attributions"), F.array_sort(F.collect_set("unavailable")).alias("surrogates_unavailable"))
    rows = beside(beside(rows, facts, how="left"), residue.groupBy("record_id").agg(F.count("*").alias("residual_spans")), how="left")
    if people is None:
        rows = rows.withColumn("unrostered_people", F.lit(0).cast("long"))
    else:
        rows = beside(rows, people.groupBy("record_id").agg(F.count("*").alias("unrostered_people")), how="left")
    rows = rows.fillna(0, ["subjects", "ambiguous_attributions", "residual_spans", "unrostered_people"]).withColumn("surrogates_unavailable", F.coalesce("surrogates_unavailable", F.array().cast("array<string>")))
    loaded = [(d.id, *d.rules()) for d in detectors]
    kept = [k for k in KINDS if policy.action(k) == "Keep"]
    texts = {
        "policy": policy.name, "policy_version": policy.version, "policy_fingerprint": policy.fingerprint(), "lineage": lineage.name, "lineage_version": lineage.version, "lineage_language": lineage.language, "lineage_fingerprint": lineage.fingerprint(),
        "engine_version": VERSION, "measured_leak_rate": measured, "relatives_rule": "off" if people is None else rule_print("relatives"), "birth_year_rule": rule_print("birth-year") if "recorded_on" in out.columns else "off",
        "spoken_digits_rule": rule_print("spoken-digits"), "postal_code_table": rule_print("census") if census else "given",
    }
    lists = (("detector_rules_skipped", [x for _, _, xs in loaded for x in xs]), ("kept_kinds", kept), ("departures_from_safe_harbor", policy.departures()), ("lineage_keys_skipped", lineage.skipped))
    prints = F.create_map(*(F.lit(x) for d in detectors for x in (d.id, d.fingerprint())))
    rows = rows.select("*", *(F.lit(v).cast("string").alias(k) for k, v in texts.items()), prints.alias("detector_fingerprints"), F.lit(sum(n for _, n, _ in loaded)).alias("detector_rules_loaded"), *(F.array(*map(F.lit, xs)).cast("array<string>").alias(name) for name, xs in lists), F.current_timestamp().alias("run_utc"))
    return rows.withColumn("withheld", (F.col("residual_spans") > 0) | F.col("refused").isNotNull())
