"""Configurations of detectors over a gold corpus, opaque ids, reasons to withhold, caveats, and comparison of reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..rules import LISTS, Lineage, Policy
from ..sources.tables import beside, scratch, written
from . import detect as D
from . import evaluate as E
from . import redact as R

#: The detectors of each configuration; said digits, years of birth and relatives run in all of them.
CONFIGURATIONS = {"full": ("known-values", "patterns"), "deny-list": ("deny-list", "patterns"), "known-values-only": ("known-values",), "patterns-only": ("patterns",)}


def in_scope(docs: DataFrame, roster: DataFrame, lineage: Lineage) -> DataFrame:
    """(record_id, kind): the kinds that some rule finds, and those of the record's roster."""
    rules = F.array(*map(F.lit, sorted({r.kind for r in lineage.compiled()[0]}))).cast("array<string>")
    rows = docs.select("record_id", F.lit(True).alias("read"), F.lit(None).cast("string").alias("kind")).unionByName(roster.select("record_id", F.lit(False).alias("read"), "kind"))
    # A record is one row until its kinds are known: rows of kinds are never compared.
    kinds = rows.groupBy("record_id").agg(F.max("read").alias("read"), F.collect_set("kind").alias("own"), F.max(~F.col("read") & F.col("kind").isNull()).alias("void"))
    own = F.concat("own", F.when(F.col("void"), F.array(F.lit(None).cast("string"))).otherwise(F.array().cast("array<string>")))
    return kinds.select("record_id", F.explode(F.array_union(F.when(F.col("read"), rules).otherwise(F.array().cast("array<string>")), own)).alias("kind"))


def evaluate(docs: DataFrame, roster: DataFrame, gold: DataFrame, lineage: Lineage | None = None, kinds: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """Scores (configuration, record_id, ...), in scope and over all kinds, and (configuration, kind, ...) for each configuration;
    without `kinds` the latter, which a report does not read, is not worked out.

    Each detector runs once; a configuration is a choice among its candidates. A text beyond the limit has no spans."""
    lineage = lineage or Lineage()
    spark = docs.sparkSession
    with scratch(spark):
        whole = written(D.guarded(docs).withColumn("__long", F.col("refused").isNotNull()), "texts", by="__long")
        docs = D.placed(whole.where("NOT __long").drop("__long"))
        wide = written(D.widened(roster, D.unlisted(docs, roster, lineage)), "roster")
        inside = written(gold.join(in_scope(docs, roster, lineage), ["record_id", "kind"], "left_semi"), "gold")
        parts = {"said": D.spoken_digits(docs)} | {d.id: d.detect(docs, wide) for d in (D.Patterns(lineage), D.KnownValues(lineage), D.DenyList(lineage))}
        found = None
        for name, rows in parts.items():
            rows = rows.select(*D.CANDIDATE, F.lit(name).alias("part"))
            found = rows if found is None else found.unionByName(rows)
        found = written(found, "found")
        scores, by_kind = None, None
        for name, chosen in CONFIGURATIONS.items():
            own = found.where(F.col("part").isin("said", *chosen)).drop("part")
            own = D.birth_years(docs, own) if "recorded_on" in docs.columns else own
            spans = written(R.replaced(docs, R.resolve(own), None, Policy(), lineage), "spans")
            out = written(R.splice(docs, spans).select("record_id", "text", "redacted").unionByName(whole.where("__long").select("record_id", "text", F.col("text").alias("redacted"))), "texts")
            s = E.scores(inside, spans, out).withColumn("scope", F.lit("in")).unionByName(E.scores(gold, spans, out).withColumn("scope", F.lit("all"))).withColumn("configuration", F.lit(name))
            scores = s if scores is None else scores.unionByName(s)
            if kinds:
                k = E.by_kind(gold, spans, out).withColumn("configuration", F.lit(name))
                by_kind = k if by_kind is None else by_kind.unionByName(k)
        return written(scores, "scores", keep=True), written(by_kind, "kinds", keep=True) if kinds else None


def readable_ids(docs: DataFrame, roster: DataFrame, lineage: Lineage | None = None) -> DataFrame:
    """Record and subject ids in which a detector finds something: they would carry what is removed elsewhere."""
    ids = docs.select("record_id", F.col("record_id").cast("string").alias("text")).unionByName(roster.select("record_id", F.col("subject_id").alias("text"))).distinct()
    keyed = ids.select(F.struct("record_id", "text").alias("record_id"), "text")
    # Whose a value is does not matter here: a record's ids meet each of its values once, not once for each of its subjects.
    values = roster.select("record_id", F.lit("").alias("subject_id"), "value", "kind").distinct()
    people = beside(ids, values).select(F.struct("record_id", "text").alias("record_id"), "subject_id", "value", "kind")
    found = D.patterns(keyed, lineage).unionByName(D.known_values(keyed, people))
    return found.where(f"confidence >= {Policy().min_confidence}").select("record_id.record_id", F.col("record_id.text").alias("id")).distinct()


def withheld(manifest: DataFrame, applied: DataFrame, roster: DataFrame) -> DataFrame:
    """(record_id, reason): why a text is not handed out; null where it is."""
    n = applied.groupBy("record_id").agg(F.count("*").alias("n"))
    known = roster.select("record_id", F.lit(True).alias("known")).distinct()
    rows = manifest.join(n, "record_id", "left").join(known, "record_id", "left")
    return rows.select("record_id", F.when(F.col("residual_spans") > 0, "residue").when(F.col("known").isNull(), "no roster").when(F.coalesce("n", F.lit(0)) == 0, "nothing replaced").alias("reason"))


def caveats(manifest: DataFrame) -> DataFrame:
    """(record_id, caveats): sentences about what a manifest can't promise."""
    parts = (
        (F.col("residual_spans") > 0, "Reading the output back still finds spans."),
        (F.col("ambiguous_attributions") > 0, "Some mentions could not be given to one person."),
        (F.col("subjects") == 0, "No known person was found."),
        (F.size("kept_kinds") > 0, "Some kinds are kept on purpose."),
        (F.size("departures_from_safe_harbor") > 0, "The policy departs from the built-in one."),
        (F.size("detector_rules_skipped") > 0, "Some rules were not loaded."),
    )
    return manifest.select("record_id", F.array_compact(F.array(*(F.when(c, t) for c, t in parts))).alias("caveats"))


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """(record_id, both, only_a, only_b): spans (record_id, start, len, kind) of two reviews."""
    side = lambda x, n: x.select("record_id", "start", "len", "kind", F.lit(1).alias(n)).distinct()
    rows = side(a, "a").join(side(b, "b"), ["record_id", "start", "len", "kind"], "full_outer")
    return rows.groupBy("record_id").agg(F.sum(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1).otherwise(0)).alias("both"), F.sum(F.when(F.col("b").isNull(), 1).otherwise(0)).alias("only_a"), F.sum(F.when(F.col("a").isNull(), 1).otherwise(0)).alias("only_b"))


def misquoted(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Spans (record_id, start, len, quote) whose place in the text does not hold their quote."""
    return spans.join(docs.select("record_id", "text"), "record_id").where(~F.col("quote").eqNullSafe(F.substring("text", F.col("start") + 1, F.col("len")))).drop("text")


def described(docs: DataFrame, gold: DataFrame) -> DataFrame:
    """(source, documents, annotators): what a gold corpus is made of."""
    who = gold.groupBy("record_id").agg(F.countDistinct("annotator").alias("n"))
    return docs.join(who, "record_id", "left").groupBy("source").agg(F.count("*").alias("documents"), F.count_if(F.coalesce("n", F.lit(0)) >= 2).alias("twice_annotated"))


def kinship_words() -> list[str]:
    return sorted({D.unaccented(w) for w in LISTS["kinship"]})
