"""Scores of spans against gold: interval arithmetic, leak rates and intervals, agreement, linkage and continuity."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.tables import spread, written
from .redact import islands, unique

Z = 1.959963984540054


def united(spans: DataFrame, *by: str) -> DataFrame:
    """Intervals (record_id, *by, start, end) of spans, those that touch united as well. They stay dealt out by record, so that sums
    and joins by record move nothing."""
    rows = islands(unique(spans.select("record_id", *by, "start", "len")), touching=True, by=by)
    rows = rows.groupBy("record_id", *by, "island").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("len")).alias("end"))
    return rows.select("record_id", *by, "start", "end")


def overlap(a: DataFrame, b: DataFrame, on: list[str], *by: str) -> DataFrame:
    """(on, by, common): characters that the united intervals of both share; `by` are further columns of a."""
    right = b.select(*on, F.col("start").alias("s2"), F.col("end").alias("e2"))
    rows = a.join(right, on).where("start < e2 AND s2 < end")
    return rows.groupBy(*on, *by).agg(F.sum(F.least("end", "e2") - F.greatest("start", "s2")).alias("common"))


def scores(gold: DataFrame, found: DataFrame, docs: DataFrame) -> DataFrame:
    """(record_id, sensitive, covered, removed, over, surviving, leaked, recall, precision) for every document of docs (record_id, text, redacted)."""
    g, f = united(gold), united(found)
    total = lambda x, name: x.groupBy("record_id").agg(F.sum(F.col("end") - F.col("start")).alias(name))
    kept = surviving(gold, docs).groupBy("record_id").agg(F.count_if("survives").alias("surviving"))
    rows = docs.select("record_id").join(total(g, "sensitive"), "record_id", "left").join(total(f, "removed"), "record_id", "left").join(overlap(g, f, ["record_id"]).withColumnRenamed("common", "covered"), "record_id", "left").join(kept, "record_id", "left").fillna(0)
    return rows.select("*", (F.col("removed") - F.col("covered")).alias("over"), ((F.col("covered") < F.col("sensitive")) | (F.col("surviving") > 0)).alias("leaked"), share(F.col("covered"), F.col("sensitive")).alias("recall"), share(F.col("covered"), F.col("removed")).alias("precision"))


def share(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, 1.0).otherwise(part / whole)


def surviving(gold: DataFrame, docs: DataFrame) -> DataFrame:
    """gold with `survives`: whether a span's tightened text still stands, as whole words, in its record's redacted text."""
    names = [c for c in gold.columns if c != "record_id"]
    lists = gold.groupBy("record_id").agg(F.collect_list(F.struct(*names)).alias("xs"))
    rows = lists.join(docs.select("record_id", T.chunks(F.col("text")).alias("ps"), T.spaced(F.col("redacted")).alias("line")), "record_id")
    one = lambda x: T.bound(T.spaced(T.tightened(T.part(F.col("ps"), x["start"], x["len"]))), lambda v: F.contains("line", v) & (F.length(F.trim(v)) > 0))
    return rows.select("record_id", F.explode(F.transform("xs", lambda x: F.struct(*(x[c].alias(c) for c in names), one(x).alias("survives")))).alias("x")).select("record_id", "x.*")


def by_kind(gold: DataFrame, found: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """(kind, sensitive, covered, recall, surviving, over) pooled over documents: gold's kind for what is sensitive, covered and
    surviving (null without docs: record_id, text, redacted), the finder's kind for what is removed beyond gold."""
    g, f = united(gold, "kind"), united(found)
    size = F.sum(F.col("end") - F.col("start"))
    hit = overlap(g, f, ["record_id"], "kind").groupBy("kind").agg(F.sum("common").alias("covered"))
    rows = g.groupBy("kind").agg(size.alias("sensitive")).join(hit, "kind", "left").fillna(0, ["covered"])
    fk, ga = united(found, "kind"), united(gold)
    right = overlap(fk, ga, ["record_id"], "kind").groupBy("kind").agg(F.sum("common").alias("right"))
    over = fk.groupBy("kind").agg(size.alias("removed")).join(right, "kind", "left").select("kind", (F.col("removed") - F.coalesce("right", F.lit(0))).alias("over"))
    rows = rows.join(over, "kind", "full_outer").fillna(0, ["sensitive", "covered", "over"]).withColumn("recall", share(F.col("covered"), F.col("sensitive")))
    if docs is None:
        return rows.withColumn("surviving", F.lit(None).cast("long"))
    left = surviving(gold, docs).groupBy("kind").agg(F.count_if("survives").alias("surviving"))
    return rows.join(left, "kind", "left").fillna(0, ["surviving"])


def by_detector(gold: DataFrame, found: DataFrame) -> DataFrame:
    """(detector_id, removed, covered)."""
    f, g = united(found, "detector_id"), united(gold)
    hit = overlap(f, g, ["record_id"], "detector_id").groupBy("detector_id").agg(F.sum("common").alias("covered"))
    return f.groupBy("detector_id").agg(F.sum(F.col("end") - F.col("start")).alias("removed")).join(hit, "detector_id", "left").fillna(0)


def wilson(hits: Column, n: Column) -> tuple[Column, Column]:
    p, z2 = hits / n, Z * Z
    centre, half = p + z2 / (2 * n), Z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    return F.greatest(F.lit(0.0), (centre - half) / (1 + z2 / n)), F.least(F.lit(1.0), (centre + half) / (1 + z2 / n))


def leak_rate(scored: DataFrame, *by: str) -> DataFrame:
    rows = scored.groupBy(*by).agg(F.count("*").alias("documents"), F.count_if("leaked").alias("leaking"), F.sum("covered").alias("covered"), F.sum("sensitive").alias("sensitive"), F.sum("over").alias("over"))
    low, high = wilson(F.col("leaking"), F.col("documents"))
    return rows.select("*", (F.col("leaking") / F.col("documents")).alias("rate"), low.alias("lower"), high.alias("upper"), share(F.col("covered"), F.col("sensitive")).alias("pooled_recall"))


def paired(a: DataFrame, b: DataFrame, resamples: int = 1000, seed: int = 20260916) -> DataFrame:
    """Differences of pooled recall and leak rate, a less b, with percentile intervals over resampled documents.

    Each document weighs a Poisson(1) count in a resample, so that no index table is needed and sums combine: a batch of documents
    becomes a row of sums for each resample, and rows of batches are added up. Resample -1 is the documents themselves."""
    import numpy as np
    import pandas as pd

    left, right = a.select("record_id", *(F.col(c).alias(f"a_{c}") for c in ("covered", "sensitive", "leaked"))), b.select("record_id", *(F.col(c).alias(f"b_{c}") for c in ("covered", "sensitive", "leaked")))
    names = ["a_covered", "a_sensitive", "a_leaked", "b_covered", "b_sensitive", "b_leaked"]
    both = left.join(right, "record_id").select(F.xxhash64("record_id", F.lit(seed)).alias("h"), *(F.col(c).cast("double") for c in names))
    below = np.array([sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(18)])

    def run(frames):
        sums = np.zeros((resamples + 1, len(names) + 1))
        for frame in frames:
            for at in range(0, len(frame), 2000):
                rows = frame.iloc[at : at + 2000]
                x = np.column_stack([np.ones(len(rows)), rows[names].to_numpy()])
                sums[0] += x.sum(axis=0)
                u = uniform(rows["h"].to_numpy(), resamples)
                sums[1:] += np.searchsorted(below, u, side="right").T.astype(np.float64) @ x
        yield pd.DataFrame(np.column_stack([np.arange(-1, resamples), sums]), columns=["sample", "n", *names])

    sums = both.mapInPandas(run, "sample double, n double, " + ", ".join(f"{c} double" for c in names)).groupBy("sample").agg(*(F.sum(c).alias(c) for c in ("n", *names)))
    sums = sums.where("n > 0 AND a_sensitive > 0 AND b_sensitive > 0").select("sample", (F.col("a_covered") / F.col("a_sensitive") - F.col("b_covered") / F.col("b_sensitive")).alias("recall"), ((F.col("a_leaked") - F.col("b_leaked")) / F.col("n")).alias("leak"))
    drawn = lambda c: F.when(F.col("sample") >= 0, F.col(c))
    return sums.agg(*(x for c in ("recall", "leak") for x in (F.max(F.when(F.col("sample") < 0, F.col(c))).alias(f"{c}_difference"), F.percentile(drawn(c), 0.025).alias(f"{c}_lower"), F.percentile(drawn(c), 0.975).alias(f"{c}_upper"))))


def uniform(hashes, resamples: int):
    """Numbers in [0, 1), documents by resamples, from the documents' hashes: the same wherever a document is read."""
    import numpy as np

    u64 = np.uint64
    x = hashes.astype(np.int64).view(u64)[:, None] + np.arange(1, resamples + 1, dtype=u64)[None, :] * u64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> u64(30))) * u64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> u64(27))) * u64(0x94D049BB133111EB)
    return ((x ^ (x >> u64(31))) >> u64(11)).astype(np.float64) * 2.0**-53


def kappa(n: Column, a: Column, b: Column, both: Column) -> Column:
    """Cohen's kappa over characters from the text's length and the marked characters of each and of both."""
    seen = (both + (n - a - b + both)) / n
    expected = (a / n) * (b / n) + (1 - a / n) * (1 - b / n)
    return F.when(n == 0, F.lit(None)).when(expected >= 1, F.when(seen >= 1, 1.0).otherwise(0.0)).otherwise((seen - expected) / (1 - expected))


def agreement(docs: DataFrame, gold: DataFrame) -> DataFrame:
    """(record_id, kind, kappa) of the first two annotators of a record, by name, for each kind that either marks; null where there
    is no second one or no text."""
    who = gold.groupBy("record_id").agg(F.slice(F.array_sort(F.collect_set("annotator")), 1, 2).alias("who"))
    marks = united(gold.join(who, "record_id").where(F.array_contains("who", F.col("annotator"))).select("*", (F.array_position("who", F.col("annotator")) - 1).alias("side")), "kind", "side")
    sides = marks.groupBy("record_id", "kind").agg(*(F.coalesce(F.sum(F.when(F.col("side") == i, F.col("end") - F.col("start"))), F.lit(0)).alias(f"n{i}") for i in (0, 1)))
    both = overlap(marks.where("side = 0").drop("side"), marks.where("side = 1").drop("side"), ["record_id", "kind"])
    rows = sides.join(both, ["record_id", "kind"], "left").join(who, "record_id").join(docs.select("record_id", F.length("text").alias("n")), "record_id")
    value = kappa(F.col("n"), F.col("n0"), F.col("n1"), F.coalesce("common", F.lit(0)))
    return rows.select("record_id", "kind", F.when(F.size("who") == 2, value).alias("kappa"))


def forms(names: DataFrame, heads: list[str] | None = None) -> DataFrame:
    """(name, form): the folded words of each invented name and, where no other name has the same head, of its head."""
    from .vault import head

    folded = lambda c: F.array_join(F.transform(T.words(c), T.fold), " ")
    rows = names.select("name").distinct().withColumn("head", head(F.col("name"), heads))
    own = rows.withColumn("f", T.fold(F.col("head")))
    alone = own.join(own.groupBy("f").count().where("count = 1").select("f"), "f", "left_semi").where(F.lower("head") != F.lower("name"))
    return rows.select("name", folded(F.col("name")).alias("form")).unionByName(alone.select("name", folded(F.col("head")).alias("form"))).where("form <> ''").distinct()


def _parts(known: list[str]) -> list[Column]:
    """The known words in order, each with a bit of its own, in parts that fit a number."""
    words = sorted(set(known))
    parts = [words[at : at + 62] for at in range(0, len(words), 62)]
    return [F.array(*(F.struct(F.lit(w).alias("w"), F.lit(1 << i).cast("long").alias("b")) for i, w in enumerate(part))) for part in parts]


def _marked(words: Column, known: list[str]) -> list[Column]:
    """Which of the known words are among `words`, a bit for each: bits are put together by a hash aggregate, sets are not."""
    none = F.lit(0).cast("long")
    return [F.when(F.size(words) == 0, none).otherwise(F.aggregate(part, none, lambda a, x: F.when(F.array_contains(words, x["w"]), a + x["b"]).otherwise(a))) for part in _parts(known)]


def _told(bits: list[Column], known: list[str]) -> Column:
    """The words that bits stand for, joined by commas."""
    chosen = lambda part, m: F.transform(F.filter(part, lambda x: m.bitwiseAND(x["b"]) != 0), lambda x: x["w"])
    return F.array_join(F.concat(F.array().cast("array<string>"), *(chosen(part, m) for part, m in zip(_parts(known), bits, strict=True))), ",")


_YEARS = [str(y) for y in range(1900, 2100)]


def linkage(docs: DataFrame, names: DataFrame, kinship: list[str], brackets: list[str], heads: list[str] | None = None) -> DataFrame:
    """(name, documents, signature, class_size): what texts with an invented name (docs: record_id, text; names: name, retired ones
    too) still tell of it.

    Rows of one record are read together. A name of one word is held wherever the word is, so that facts are summed up by word before
    names meet them; only records that may hold a name of several words, or one with two forms, meet these as a list."""
    wanted = written(forms(written(names.select("name").distinct(), "names"), heads), "forms")
    single = (F.col("n") == 1) & ~F.contains("form", F.lit(" "))
    kinds = wanted.groupBy("name").agg(F.count("*").alias("n"), F.min("form").alias("form"))
    records = spread(docs.select("record_id", "text").where("record_id IS NOT NULL AND text IS NOT NULL"), "record_id").groupBy("record_id").agg(F.collect_list("text").alias("texts"))
    aged = F.exists("texts", lambda t: T.bound(T.fold(t), lambda f: F.exists(F.array(*map(F.lit, brackets)).cast("array<string>"), lambda b: F.contains(f, b))))
    rows = T.once(records, wss=F.transform("texts", T.folded_words), age=aged).drop("texts")
    rows = T.once(rows, ws=F.array_distinct(F.flatten("wss")))
    years, kin = F.filter("ws", lambda w: (F.length(w) == 4) & F.regexp_like(w, F.lit("^(?:19|20)[0-9]{2}$"))), F.filter("ws", lambda w: w.isin(*kinship))
    rows = T.once(rows, years=years, kin=kin)
    bits = {f"{n}{i}": c for n, known in (("y", _YEARS), ("k", kinship)) for i, c in enumerate(_marked(F.col("years" if n == "y" else "kin"), known))}
    facts = T.once(rows, **bits)
    summed = lambda by: by.agg(F.count("*").alias("documents"), *(F.bit_or(c).alias(c) for c in bits), F.max("age").alias("age"))
    of_words = summed(facts.select(F.explode("ws").alias("form"), *bits, "age").groupBy("form"))
    found = of_words.join(kinds.where(single).select("name", "form"), "form").select("name", "documents", *bits, "age")
    others = wanted.join(kinds.where(~single).select("name"), "name", "left_semi")
    if not others.isEmpty():
        firsts = others.withColumn("first", F.substring_index("form", " ", 1))
        maybe = facts.select("record_id", F.explode("ws").alias("first")).join(firsts, "first").groupBy("record_id").agg(F.collect_list(F.struct("name", "form")).alias("xs"))
        lines = F.transform("wss", lambda ws: F.concat(F.lit(" "), F.array_join(ws, " "), F.lit(" "))).alias("lines")
        held = F.filter("xs", lambda x: F.exists("lines", lambda line: F.contains(line, F.concat(F.lit(" "), x["form"], F.lit(" ")))))
        hits = maybe.join(facts.select("record_id", lines, *bits, "age"), "record_id").select(F.explode(F.array_distinct(F.transform(held, lambda x: x["name"]))).alias("name"), *bits, "age")
        found = found.unionByName(summed(hits.groupBy("name")))
    told = lambda n, known: _told([F.col(c) for c in bits if c[0] == n], known)
    signature = F.concat_ws("|", told("y", _YEARS), F.col("age").cast("string"), told("k", kinship))
    found = written(found.select("name", "documents", signature.alias("signature")), "linked")
    return found.join(found.groupBy("signature").agg(F.count("*").alias("class_size")), "signature").select("name", "documents", "signature", "class_size")


def linkage_summary(exposed: DataFrame) -> DataFrame:
    """(subjects, smallest_class, unique_subjects, most_documents, median_documents) of `linkage`'s rows."""
    return exposed.agg(F.count("*").alias("subjects"), F.min("class_size").alias("smallest_class"), F.count_if(F.col("class_size") == 1).alias("unique_subjects"), F.coalesce(F.max("documents"), F.lit(0)).alias("most_documents"), F.coalesce(F.median("documents"), F.lit(0.0)).alias("median_documents"))


def continuity(applied: DataFrame, vault: DataFrame) -> DataFrame:
    """(subject_id, documents, names, retired, holds): one name for a subject wherever it occurs."""
    rows = applied.where("subject_id <> ''").groupBy("subject_id").agg(F.countDistinct("record_id").alias("documents"), F.countDistinct(F.substring_index("replacement", " ", 1)).alias("names"))
    rows = rows.join(vault.select("subject_id", F.size("retired").alias("retired")), "subject_id", "left").fillna(0)
    return rows.withColumn("holds", (F.col("names") <= 1) & (F.col("retired") == 0))


def attributions(applied: DataFrame, gold: DataFrame) -> DataFrame:
    """Flags of each applied span with a subject: no-gold-span, several-gold-spans, kind-differs."""
    g = gold.select("record_id", F.col("start").alias("s2"), F.col("len").alias("l2"), F.col("kind").alias("k2"))
    rows = applied.where("subject_id <> ''").join(g, "record_id", "left").withColumn("hit", (F.col("start") < F.col("s2") + F.col("l2")) & (F.col("s2") < F.col("start") + F.col("len")))
    rows = rows.groupBy("record_id", "start", "len", "kind", "subject_id").agg(F.count_if("hit").alias("n"), F.count_if(F.col("hit") & (F.col("kind") != F.col("k2"))).alias("other"))
    return rows.withColumn("flag", F.when(F.col("n") == 0, "no-gold-span").when(F.col("n") > 1, "several-gold-spans").when(F.col("other") > 0, "kind-differs").otherwise("ok"))
