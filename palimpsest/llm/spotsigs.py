"""Document fingerprints by SpotSigs, by DataFrame functions alone.

Common words of several languages are anchors. Where one or more stand before a content word, the last of them with the
chain of the next two content words (those that are no anchor) makes a signature; a document's fingerprint is its set of
signatures. Fingerprints are compared by Jaccard similarity; `near_pairs` partitions sets by length and prunes by length
and by prefixes of rare signatures before it compares.

Defined cases: a null text counts as empty; case and all but letters and digits do not matter; a text with words but no
signature has one signature of its whole word sequence; a text without words has an empty fingerprint, alike (1.0) only to
another empty one; documents are told apart by id and text, so repeated rows count as one document in the order and each
give a row; null ids come last in descending order; a single document is its own next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

ANCHORS = """the of and a to in is it you that he was for on are with as i his they be at one have this from or had by but not what all were we
when your can said there use an each which she do how their if will up other about out many then them these so some her would him into has
der die das und ist ein eine einer den dem des zu von mit sich auf für nicht auch es an als im am aus bei nach wie oder aber wenn nur noch
le la les un une et est que qui dans pour pas sur au aux du ce il elle nous vous ne se plus par avec son sa ses ou mais
el los las una unos y en por con para su al lo como más pero sus o este sí porque esta entre cuando muy sin sobre también me hasta hay""".split()
GLUE = "\x01"
_LAST = -(1 << 63)


def _trie(words: list[str]) -> str:
    """A pattern for the words that looks at each character once."""
    heads: dict[str, list[str]] = {}
    for w in words:
        heads.setdefault(w[:1], []).append(w[1:])
    options = [c + _trie(rest) for c, rest in sorted(heads.items()) if c]
    body = f"(?:{'|'.join(options)})" if options else ""
    return (body + "?") if "" in heads and options else body


PATTERN = f"(?<= )({_trie(sorted(set(ANCHORS)))}) "


def normal(text: Column) -> Column:
    """Lower-case words with a space before and after each."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "), F.lit(" "))


def signatures(text: Column) -> Column:
    """array<int>: the sorted distinct signatures of a text."""
    content = F.split(F.trim(F.regexp_replace(normal(text), PATTERN, f"$1{GLUE}")), " ")
    word = lambda w: F.substring_index(w, GLUE, -1)

    def chains(content: Column, later: Column) -> Column:
        pairs = F.zip_with(content, later, lambda a, b: F.when((F.instr(a, GLUE) > 0) & b.isNotNull() & ~F.endswith(b, F.lit(GLUE)), F.hash(F.substring_index(a, GLUE, -2), word(b))))
        return F.sort_array(F.array_distinct(F.array_compact(pairs)))

    # Each transform over one element names what it holds, so that it is computed once.
    bound = F.transform(F.array(F.struct(content.alias("c"))), lambda x: F.struct(x["c"].alias("c"), F.slice(x["c"], 2, F.greatest(F.size(x["c"]) - 1, F.lit(0))).alias("d")))
    bound = F.transform(bound, lambda x: F.struct(x["c"].alias("c"), chains(x["c"], x["d"]).alias("s")))
    none = F.array().cast("array<int>")
    whole = lambda x: F.when(F.element_at(x["c"], 1) == "", none).otherwise(F.array(F.hash(x["c"])))
    return F.element_at(F.transform(bound, lambda x: F.when(F.size(x["s"]) > 0, x["s"]).otherwise(whole(x))), 1)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two fingerprints."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1)))


def fingerprint(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda x: F.lower(F.hex(x.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))))), ".")


def _chain(keyed: DataFrame) -> DataFrame:
    """(k, h, pk, ph, half): each document and, of the one before it in descending order, the key and half the length.

    Only keys and lengths move. They are dealt out by range and written with their partition's number; neighbours inside a
    partition come from a window over it, those across partitions from the partitions' ends, a row each."""
    ids = keyed.select("k", "h", F.length("text").alias("n")).distinct()
    laid = C.written(ids.repartitionByRange(F.desc("k"), F.asc("h")).withColumn("p", F.spark_partition_id()), "order")
    w = W.partitionBy("p").orderBy(F.desc("k"), F.asc("h"))
    here = F.struct("k", "h", "n")
    rows = laid.select("p", "k", "h", F.lag(here).over(w).alias("before"), F.lead(here).over(w).isNull().alias("end"), here.alias("own"))
    ends = C.written(rows.where("end").select("p", "own"), "ends")
    over = W.orderBy("p")
    wrap = F.last("own").over(over.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    ends = C.written(ends.select("p", F.coalesce(F.lag("own").over(over), wrap).alias("edge")), "edges")
    rows = C.looked_up(rows, ends, ["p"], "left").withColumn("before", F.coalesce("before", "edge"))
    return rows.select("k", "h", F.col("before.k").alias("pk"), F.col("before.h").alias("ph"), F.floor(F.col("before.n") / 2).cast("int").alias("half"))


def edited_fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, text, edited, own, changed, next): each text, its edited text and the signatures of both and of the next."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    k = F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST))
    keyed = docs.select(k.alias("k"), F.xxhash64(k, text).alias("h"), text.alias("text"))
    chain = C.written(_chain(keyed), "chain")
    heads = keyed.join(chain, ["k", "h"]).select(F.col("pk").alias("k"), F.col("ph").alias("h"), F.substring("text", F.lit(1), F.col("half")).alias("head"), signatures(F.col("text")).alias("next")).dropDuplicates(["k", "h"])
    rows = keyed.join(heads, ["k", "h"])
    n = F.length("text")
    edited = F.concat(F.substring("text", F.lit(1), n - F.floor(n / 2).cast("int")), "head")
    rows = rows.select(F.nullif("k", F.lit(_LAST)).alias("doc_id"), "text", edited.alias("edited"), "next")
    return rows.select("*", signatures(F.col("text")).alias("own"), signatures(F.col("edited")).alias("changed"))


def near_pairs(docs: DataFrame, threshold: float = 0.8, text_col: str = "text", id_col: str = "doc_id", part: int = 512) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, similarity) of different fingerprints, each named by its digest, and membership (doc_id, a row each, null ids and
    repeated ones too, with the digest of its fingerprint).

    A set's prefix holds its |S| - ceil(t |S|) + 1 rarest signatures; two sets that are alike share one of both prefixes and
    differ in length by the factor t at most, so their length partitions are equal or neighbours. A signature that stands in many
    prefixes of a partition is dealt over blocks of about `part` of them, block against block, so that no task holds them all."""
    sets = C.written(docs.select(F.col(id_col).alias("doc_id"), signatures(F.col(text_col)).alias("s")).withColumn("f", F.sha2(fingerprint(F.col("s")), 256)), "sets")
    reps = C.written(sets.groupBy("f").agg(F.first("s").alias("s")), "reps")
    words = reps.select("f", F.explode("s").alias("x"), F.size("s").alias("n"))
    common = words.groupBy("x").agg(F.count("*").alias("df"))
    ranked = words.join(common, "x").groupBy("f", "n").agg(F.sort_array(F.collect_list(F.struct("df", "x"))).alias("xs"))
    first = F.slice("xs", F.lit(1), F.col("n") - F.ceil(F.col("n") * threshold - 1e-9).cast("int") + 1)
    prefix = C.written(ranked.select("f", "n", F.floor(F.log("n") / -F.log(F.lit(threshold)) + 1e-9).alias("part"), F.explode(first).alias("e")).select("f", "n", "part", "e.x"), "prefix")
    both = prefix.select("f", "n", "x", F.lit(0).alias("side"), F.col("part")).unionByName(prefix.select("f", "n", "x", F.lit(1).alias("side"), F.explode(F.array(F.col("part") - 1, F.col("part"), F.col("part") + 1)).alias("part")))
    sizes = C.written(both.groupBy("x", "part").agg(F.max("side").alias("hi"), F.min("side").alias("lo"), F.count("*").alias("m")).where("hi > lo").select("x", "part", F.ceil(F.col("m") / part).cast("int").alias("blocks")), "sizes")
    dealt = C.looked_up(both, sizes, ["x", "part"]).withColumn("mine", F.pmod(F.xxhash64("f"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = dealt.where("side = 0").select(F.col("f").alias("a"), "n", "x", "part", F.col("mine").alias("i"), every.alias("j"))
    right = dealt.where("side = 1").select(F.col("f").alias("b"), F.col("n").alias("m"), "x", "part", F.col("mine").alias("j"), every.alias("i"))
    pairs = left.join(right, ["x", "part", "i", "j"]).where("a < b").where((F.col("n") >= threshold * F.col("m")) & (F.col("m") >= threshold * F.col("n"))).select("a", "b").distinct()
    pairs = pairs.join(reps.select(F.col("f").alias("a"), F.col("s").alias("sa")), "a").join(reps.select(F.col("f").alias("b"), F.col("s").alias("sb")), "b")
    pairs = pairs.select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("similarity")).where(F.col("similarity") >= threshold)
    return pairs, sets.select("doc_id", F.col("f").alias("fingerprint"))


def op9_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
