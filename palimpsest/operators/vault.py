"""The vault: (subject_id, pseudonym, surrogate, retired).

Codes are drawn at random for new subjects and written at once, so that no later step draws them again; they say nothing of the
subject. Names are given by rank, so that a run can be repeated: subjects by a hash of their id, names by their place in the pools.
A name once given, retired ones included, is never given to anyone else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..rules import PERSONS, POOLS, Lineage
from ..sources.tables import numbered, written
from . import detect as D

SCHEMA = "subject_id string, pseudonym string, surrogate string, retired array<string>"
_NONE = lambda: F.array().cast("array<string>")


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def head(surrogate: Column, heads: list[str] | None = None) -> Column:
    """The head of a name: the longest of `heads` that begins it, whole words only, else its first word."""
    first = F.substring_index(surrogate, " ", 1)
    long_ = [h for h in heads or [] if " " in h]  # a head of one word is the first word
    low = F.lower(surrogate)
    for h in sorted(long_, key=len):
        first = F.when((low == h.lower()) | F.startswith(low, F.lit(h.lower() + " ")), F.substring(surrogate, 1, len(h))).otherwise(first)
    return first


def taken(vault: DataFrame) -> DataFrame:
    """(subject_id, name): every name given so far, retired ones included."""
    return vault.select("subject_id", F.explode(F.concat(F.array("surrogate"), F.coalesce("retired", _NONE()))).alias("name")).where("name <> ''")


def pool_names(spark: SparkSession, lineage: Lineage, pools: tuple[str, str] = ("given", "family")) -> DataFrame:
    """(place, head, surrogate): every head once before any comes again with another tail; whole names where there are no tails."""
    heads, tails = lineage.pools.get(pools[0], []), lineage.pools.get(pools[1], [])
    if not heads:
        return spark.createDataFrame([], "place long, head string, surrogate string")
    rows = spark.range(len(heads) * max(len(tails), 1)).withColumnRenamed("id", "place")
    h, t = F.col("place") % len(heads), F.floor(F.col("place") / len(heads))
    one = F.get(F.array(*map(F.lit, heads)), h.cast("int"))
    name = F.concat(one, F.lit(" "), F.get(F.array(*map(F.lit, tails)), ((h + t) % len(tails)).cast("int"))) if tails else one
    return rows.select("place", one.alias("head"), name.alias("surrogate"))


def permitted_names(spark: SparkSession, lineage: Lineage, avoid: DataFrame | None = None, pools: tuple[str, str] = ("given", "family")) -> DataFrame:
    """Names of the pools that no rule finds and, where a roster to avoid (value, and kind if it has one) is given, that it does not
    hear, neither in whole nor in the head alone."""
    names = pool_names(spark, lineage, pools)
    forms = names.select("surrogate", F.explode(F.array_distinct(F.array("head", "surrogate"))).alias("text"))
    docs = forms.select(F.col("text").alias("record_id"), "text").distinct()
    found = D.patterns(D.cued(docs), lineage).select(F.col("record_id").alias("text"))
    if avoid is not None:
        found = found.unionByName(_heard(spark, lineage, avoid, pools, docs))
    return names.join(forms.join(found.distinct(), "text", "left_semi").select("surrogate").distinct(), "surrogate", "left_anti")


def _heard(spark: SparkSession, lineage: Lineage, avoid: DataFrame, pools: tuple[str, str], docs: DataFrame) -> DataFrame:
    """(text): forms in which the roster would be found. The words of the pools, a lineage's list, are matched first, with every
    distinct word of the roster; only values all of whose words sound like some of them are then looked for in the names."""
    words = sorted({w for pool in pools for entry in lineage.pools.get(pool, []) for w in entry.split()})
    texts = spark.createDataFrame([(w,) for w in words], "word string").withColumn("key", T.phonetic_key(F.col("word")))
    listed = F.lit(None).cast("string").alias("record_id")
    values = avoid.select(listed, F.lit("").alias("subject_id"), "value", F.col("kind") if "kind" in avoid.columns else F.lit("PatientName").alias("kind")).distinct()
    parts = D.targets(values)
    keys = parts.select("t_key").distinct()
    near = keys.join(F.broadcast(texts), F.levenshtein("key", "t_key", 2) >= 0).select("t_key").distinct()  # the pools' words alone are broadcast
    alike = parts.join(near, "t_key", "left_semi").groupBy("value", "kind", "n").agg(F.count("*").alias("k")).where("k = n").select("value", "kind")
    hits = written(alike, "alike")
    roster = docs.select("record_id", F.explode(F.array_distinct(T.words(F.col("text")))).alias("word")).withColumn("key", T.phonetic_key(F.col("word")))
    first = hits.select("value", "kind", T.phonetic_key(F.element_at(T.words(F.col("value")), 1)).alias("t_key"))
    reach = keys.join(F.broadcast(texts), T.accepts(F.col("key"), F.col("t_key"))).select("t_key", "key").distinct()
    own = roster.join(reach, "key").join(first, "t_key").select("record_id", F.lit("").alias("subject_id"), "value", "kind").distinct()
    return D.known_values(docs, own).select(F.col("record_id").alias("text"))


def minted(subjects: DataFrame, vault: DataFrame, lineage: Lineage, avoid: DataFrame | None = None) -> DataFrame:
    """The vault with a name for each subject (subject_id, and kind if there is one) that has none. Subjects of kinds without a pool
    get a code and no name; an exhausted pool raises."""
    spark = subjects.sparkSession
    kind = F.col("kind") if "kind" in subjects.columns else F.lit("PatientName")
    fresh = subjects.where("subject_id <> ''").groupBy("subject_id").agg(F.min(kind).alias("kind")).join(vault, "subject_id", "left_anti")
    fresh = written(fresh.select("subject_id", "kind", F.sha2("subject_id", 256).alias("h")), "fresh")
    given = written(taken(vault).select(F.col("name").alias("surrogate")).distinct(), "taken")
    used = given.select(head(F.col("surrogate"), lineage.heads()).alias("head"), F.lit(True).alias("used")).distinct()
    made = fresh.where(~F.col("kind").isin(*lineage.minted_kinds())).select("subject_id", F.lit("").alias("surrogate"))
    for pools in dict.fromkeys(POOLS.values()):
        kinds = [k for k in lineage.minted_kinds() if POOLS[k] == pools]
        own = fresh.where(F.col("kind").isin(*kinds)) if kinds else None
        if own is None or own.isEmpty():
            continue
        free = permitted_names(spark, lineage, avoid, pools).join(given, "surrogate", "left_anti").join(used, "head", "left")
        ranked = numbered(own.select("h", "subject_id"), ["h", "subject_id"])
        names = numbered(free.select(F.coalesce("used", F.lit(False)).alias("used"), "place", "surrogate"), ["used", "place"])
        if names.count() < ranked.count():
            raise ValueError(f"the pool {pools[0]} is exhausted")
        made = made.unionByName(ranked.join(names, "r").select("subject_id", "surrogate"))
    rows = made.select("subject_id", _code().alias("pseudonym"), "surrogate", _NONE().alias("retired"))
    return vault.unionByName(written(rows, "minted"))


def _code() -> Column:
    """128 random bits, not derived from anything."""
    return F.concat(F.lit("PAL-"), F.substring(F.sha2(F.concat(F.uuid(), F.uuid()), 256), 1, 32))


def _checked(vault: DataFrame, names: DataFrame, owners: str) -> DataFrame:
    """names, trimmed and distinct; refuses two names for a subject, and names that two subjects share or that are taken."""
    names = names.select("subject_id", F.trim("surrogate").alias("surrogate")).distinct()
    faults = (
        (names.where("subject_id IS NULL OR trim(subject_id) = '' OR surrogate IS NULL OR surrogate = ''"), "a subject or a name is empty"),
        (names.groupBy("subject_id").count().where("count > 1"), "a subject is given two names"),
        (names.groupBy("surrogate").count().where("count > 1"), "two subjects are given one name"),
        (names.join(taken(vault).select(F.col("subject_id").alias("o"), F.col("name").alias("surrogate")), "surrogate").where(owners), "a name is taken"),
    )
    for rows, message in faults:
        if not rows.isEmpty():
            raise ValueError(message)
    return names


def assign(vault: DataFrame, names: DataFrame) -> DataFrame:
    """Pins names (subject_id, surrogate). Renaming a subject, sharing a name and giving a name anew, retired ones too, are refused."""
    names = names.select("subject_id", F.trim("surrogate").alias("surrogate")).distinct()
    old = vault.select("subject_id", F.col("surrogate").alias("old"))
    if not names.join(old, "subject_id").where("surrogate <> old AND old <> ''").isEmpty():
        raise ValueError("a subject has another name already")
    same = names.join(old, "subject_id").where("surrogate = old").select("subject_id")
    fresh = _checked(vault, names, "NOT (subject_id <=> o)").join(same, "subject_id", "left_anti")
    coded = fresh.join(vault.select("subject_id", "pseudonym", "retired"), "subject_id", "left")
    rows = coded.select("subject_id", F.coalesce("pseudonym", _code()).alias("pseudonym"), "surrogate", F.coalesce("retired", _NONE()).alias("retired"))
    return vault.join(fresh, "subject_id", "left_anti").unionByName(written(rows, "assigned"))


def remint(vault: DataFrame, names: DataFrame) -> DataFrame:
    """New names (subject_id, surrogate); the old ones are retired and stay taken. A name that anyone has or had is refused."""
    new = _checked(vault, names, "true").withColumnRenamed("surrogate", "new")
    rows = vault.join(new, "subject_id", "left")
    retired = F.when(F.col("new").isNotNull() & (F.col("surrogate") != ""), F.concat("retired", F.array("surrogate"))).otherwise(F.col("retired"))
    return rows.select("subject_id", "pseudonym", F.coalesce("new", "surrogate").alias("surrogate"), retired.alias("retired"))


def reminted(subjects: DataFrame, vault: DataFrame, lineage: Lineage, avoid: DataFrame | None = None) -> DataFrame:
    """The vault with a new minted name for each of the subjects; those without an entry get their first."""
    known = subjects.join(vault.select("subject_id"), "subject_id", "left_semi")
    again = known.withColumn("subject_id", F.concat(F.lit("again:"), "subject_id"))
    grown = minted(again, vault, lineage, avoid)
    names = grown.join(vault, "subject_id", "left_anti").select(F.substring("subject_id", 7, 1 << 30).alias("subject_id"), "surrogate").where("surrogate <> ''")
    return minted(subjects.join(vault, "subject_id", "left_anti"), remint(vault, names), lineage, avoid)


def by_surrogate(vault: DataFrame, names: DataFrame) -> DataFrame:
    """(name, subject_id): whose the names (name) are or were."""
    return names.select(F.trim("name").alias("name")).distinct().join(taken(vault), "name").select("name", "subject_id")


def by_code(vault: DataFrame, codes: DataFrame) -> DataFrame:
    """(pseudonym, subject_id) of the codes (pseudonym)."""
    return codes.select("pseudonym").distinct().join(vault.select("pseudonym", "subject_id"), "pseudonym")


def lost(stored: DataFrame, proposed: DataFrame) -> DataFrame:
    """Stored codes and names, current or retired, that a proposed vault does not keep; must be empty before it is saved."""
    facts = lambda v: v.select("subject_id", "pseudonym", F.explode(F.concat(F.array("surrogate"), "retired")).alias("name"))
    return facts(stored).join(facts(proposed), ["subject_id", "pseudonym", "name"], "left_anti")


def pool_faults(pools: DataFrame) -> DataFrame:
    """(pool, entry, fault) of pools (pool, entry): empty entries, digits outside products, entries that are equal without case and
    accents, entries that sound alike, and heads that another kind's head and tail can also make."""
    rows = pools.select("pool", F.trim("entry").alias("entry")).withColumn("f", T.fold(F.col("entry"))).withColumn("s", F.array_join(F.transform(T.words(F.col("entry")), T.phonetic_key), " "))
    w = lambda c: F.count("*").over(W.partitionBy("pool", c))
    product = F.col("pool").isin("product", "productSuffix")
    fault = F.when(F.col("entry") == "", "empty").when(T.has_digit(F.col("entry")) & ~product, "digit").when(w("f") > 1, "twice").when(w("s") > 1, "sounds alike")
    out = rows.withColumn("fault", fault).where("fault IS NOT NULL").select("pool", "entry", "fault")
    pairs = [p for p in dict.fromkeys(POOLS.values())]
    split = rows.where(F.col("pool").isin(*(h for h, _ in pairs))).withColumn("ws", F.split("f", " +"))
    split = split.select("pool", "entry", "ws", F.explode(F.sequence(F.lit(1), F.greatest(F.size("ws") - 1, F.lit(1)))).alias("i")).where(F.size("ws") > 1)
    split = split.select("pool", "entry", F.array_join(F.slice("ws", F.lit(1), F.col("i")), " ").alias("front"), F.array_join(F.slice("ws", F.col("i") + 1, F.size("ws")), " ").alias("back"))
    for h, t in pairs:
        heads = rows.where(F.col("pool") == h).select(F.col("f").alias("front"))
        tails = rows.where(F.col("pool") == t).select(F.col("f").alias("back"))
        both = split.where(F.col("pool") != h).join(heads, "front", "left_semi").join(tails, "back", "left_semi")
        out = out.unionByName(both.select("pool", "entry", F.lit("another kind's name").alias("fault")))
    return out.distinct()


def pools_of(spark: SparkSession, lineage: Lineage) -> DataFrame:
    """(pool, entry) of a lineage."""
    return spark.createDataFrame([(p, e) for p, es in lineage.pools.items() for e in es], "pool string, entry string")


assert all(POOLS[k] == ("given", "family") for k in PERSONS)
