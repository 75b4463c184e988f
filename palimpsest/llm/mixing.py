"""Mixing sources to target weights by Poisson replication.

A source's rate is its target share of all characters over its own share: the mean number of times one of its documents
is to occur. A document's count is the inverse of the Poisson distribution function at a number in [0, 1) hashed from its
id and a seed; rates above `PART` are split into equal parts, each with a number of its own, so that no term underflows.
Documents are exploded by their counts and shuffled globally: dealt out and sorted by a hash of id, copy and seed.

Defined cases: a null source is a source of its own; a source without characters has rate 1; sources without a given
target have weight 0; null ids are hashed by their text; repeated rows get equal counts; an empty table gives no row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Default targets: shares in proportion to a source's characters to this power.
TEMPERATURE = 0.7
#: Largest mean of one inversion, and how many terms of its distribution count (the rest is below 2**-60).
PART, TERMS = 32.0, 140


def rates(docs: DataFrame, targets: dict[str, float] | DataFrame | None = None, source_col: str = "source", text_col: str = "text", temperature: float = TEMPERATURE) -> DataFrame:
    """(__source, __chars, __rate), a row a source."""
    sizes = docs.groupBy(F.col(source_col).alias("__source")).agg(F.sum(F.coalesce(F.length(text_col), F.lit(0)).cast("double")).alias("__chars"))
    if targets is None:
        sizes = sizes.withColumn("__weight", F.pow("__chars", F.lit(temperature)))
    else:
        given = targets if isinstance(targets, DataFrame) else docs.sparkSession.createDataFrame(list(targets.items()), "source string, weight double")
        given = given.select(F.col(given.columns[0]).alias("__given"), F.col(given.columns[1]).cast("double").alias("__weight"))
        sizes = sizes.join(given, F.col("__source").eqNullSafe(F.col("__given")), "left").select("__source", "__chars", F.coalesce("__weight", F.lit(0.0)).alias("__weight"))
    total = sizes.agg(F.sum("__chars").alias("__all"), F.sum("__weight").alias("__weights"))
    rate = F.when(F.col("__chars") > 0, F.col("__weight") / F.col("__weights") * F.col("__all") / F.col("__chars")).otherwise(1.0)
    return sizes.join(F.broadcast(total)).select("__source", "__chars", rate.alias("__rate"))  # total is one row


def _distribution(mean: Column) -> Column:
    """array<double>: the distribution function at 0, 1, 2, ..."""
    first = F.exp(-mean)
    start = F.struct(first.alias("p"), F.array(first).alias("c"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS)),
        start,
        lambda acc, k: F.struct((acc["p"] * mean / k).alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + acc["p"] * mean / k)).alias("c")),
        lambda acc: acc["c"],
    )


def replicate(docs: DataFrame, targets: dict[str, float] | DataFrame | None = None, source_col: str = "source", text_col: str = "text", id_col: str = "doc_id", seed: int = 42, temperature: float = TEMPERATURE) -> DataFrame:
    """The columns of docs and __copy (from 1), a row a replica, in shuffled order. A row without an id is told by its text; those
    without one are also dealt out by all they hold."""
    source, text, row_id = C.at(docs, source_col), C.at(docs, text_col), C.at(docs, id_col)
    docs, names = C.apart(docs)
    table = rates(docs, targets, source, text, temperature)
    parts = F.greatest(F.ceil(F.col("__rate") / PART), F.lit(1)).cast("int")
    table = C.written(table.select(F.coalesce("__source", F.lit("")).alias("__s"), F.col("__source").isNull().alias("__none"), parts.alias("__parts"), _distribution(F.col("__rate") / parts).alias("__below")), "rates")
    who = F.coalesce(F.col(row_id).cast("string"), F.md5(F.coalesce(F.col(text), F.lit(""))))
    keyed = docs.select("*", F.coalesce(F.col(source), F.lit("")).alias("__s"), F.col(source).isNull().alias("__none"), who.alias("__who"))
    keyed = C.looked_up(keyed, table, ["__s", "__none"])

    def drawn(part: Column) -> Column:
        u = C.unit(F.col("__who"), F.lit(seed), part)
        return F.size(F.filter("__below", lambda c: c <= u))

    count = F.aggregate(F.sequence(F.lit(1), F.col("__parts")), F.lit(0), lambda acc, part: acc + drawn(part))
    copies = keyed.withColumn("__count", count).where("__count > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__count"))))
    order = F.xxhash64("__who", "__copy", F.lit(seed), F.when(F.col(row_id).isNull(), F.xxhash64(*docs.columns)))
    return C.together(copies.withColumn("__order", order).repartition("__order").sortWithinPartitions("__order"), names, "__copy")


def op4_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return replicate(docs).withColumnRenamed("__copy", "copy")


#: The distribution by logarithms here, by products there: they differ by less than the numbers' grain of 2**-48.
OP4_SQL = f"""
WITH sizes AS (SELECT source, sum(length(text))::DOUBLE AS chars FROM documents GROUP BY source),
rates AS (SELECT source, chars ** {TEMPERATURE} / (SELECT sum(chars ** {TEMPERATURE}) FROM sizes) * (SELECT sum(chars) FROM sizes) / chars AS rate FROM sizes),
terms AS (SELECT source, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p FROM rates, generate_series(0, 60) t(k)),
below AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
numbers AS (SELECT *, ('0x' || substr(md5(doc_id::VARCHAR || ':42:1'), 1, 12))::BIGINT / {float(1 << 48)} AS u FROM documents),
counts AS (SELECT n.doc_id, count(b.k) AS n FROM numbers n LEFT JOIN below b ON b.source = n.source AND b.c <= n.u GROUP BY n.doc_id)
SELECT d.*, c.copy::INTEGER AS copy FROM documents d JOIN (SELECT doc_id, unnest(range(1, n + 1)) AS copy FROM counts) c ON c.doc_id = d.doc_id
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's rate asks for."""
    rows, names = C.apart(docs)
    return C.together(replicate(rows, None, C.at(docs, "source"), C.at(docs, "text"), C.at(docs, "doc_id")), names)


assert math.exp(-PART) > 0
