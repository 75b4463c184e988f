"""Chat formatting after cumulative-snapshot collapse.

Logs hold snapshots of conversations, each a prefix of a later one. Every turn gets the hash of its conversation's prefix up
to it: the running sum of two hashes of role, text and place. A conversation whose whole hash, with its length, is a proper
prefix of another is dropped by an anti-join; of equal conversations the one with the smallest id stays. The remaining ones
are rendered with role marks.

Turns are ordered by turn, role and text. Sums run over blocks of `BLOCK` turn numbers, so that no window holds a whole long
conversation; each kept conversation is rendered as one row, however many turns it has.

Defined cases: repeated rows count once; a null role or text counts as empty, a null turn comes first; rows without a
conv_id form one conversation (null id); ids of any type are kept as they are; an empty table gives no row; other columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

BLOCK = 1000


def _summed(turns: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Running sums of values over each conversation: inside blocks by a window, across blocks by their totals."""
    local = W.partitionBy("c", "block").orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, W.currentRow)
    totals = turns.groupBy("c", "block").agg(*(F.sum(v).alias(f"t_{k}") for k, v in values.items()))
    earlier = W.partitionBy("c").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    before = totals.select("c", "block", *(F.coalesce(F.sum(f"t_{k}").over(earlier), F.lit(0)).alias(f"b_{k}") for k in values))
    rows = turns.select("*", *(F.sum(v).over(local).alias(f"l_{k}") for k, v in values.items())).join(before, ["c", "block"])
    return rows.select(*turns.columns, *((F.col(f"l_{k}") + F.col(f"b_{k}")).alias(k) for k in values))


def prefixes(logs: DataFrame) -> DataFrame:
    """(c, block, turn, role, text, pos, p, q): each distinct turn with its place and the hashes of its prefix."""
    turns = logs.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("c"),
        "conv_id",
        F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 63))).alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).distinct()
    turns = turns.withColumn("block", F.floor(F.col("turn") / BLOCK))
    placed = _summed(turns, {"pos": F.lit(1)})
    one = lambda salt: F.xxhash64(F.lit(salt), "pos", "role", "text").cast("decimal(20,0)")
    return _summed(placed, {"p": one(1), "q": one(2)})


def maximal(turns: DataFrame) -> DataFrame:
    """(c, n): conversations that are no proper prefix of another, one of each set of equal ones."""
    whole = turns.groupBy("c").agg(F.max(F.struct("pos", "p", "q")).alias("w"), F.min("conv_id").alias("conv_id")).select("c", "conv_id", "w.*")
    ends = whole.groupBy("pos", "p", "q").agg(F.min(F.struct("conv_id", "c")).alias("m")).select("pos", "p", "q", "m.c")
    inner = turns.join(whole.select("c", F.col("pos").alias("n")), "c").where("pos < n").select("pos", "p", "q").distinct()
    return ends.join(inner, ["pos", "p", "q"], "left_anti").select("c", F.col("pos").alias("n"))


def render(turns: DataFrame, kept: DataFrame) -> DataFrame:
    """(conv_id, n_turns, rendered): the kept conversations, joined block by block and then into one text."""
    piece = F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("<|end|>\n"))
    joined = lambda xs: F.array_join(F.transform(F.sort_array(xs), lambda x: x["x"]), "")
    rows = turns.join(kept, "c").groupBy("c", "n", "block").agg(F.min("conv_id").alias("conv_id"), joined(F.collect_list(F.struct("pos", piece.alias("x")))).alias("x"))
    rows = rows.groupBy("c", "n").agg(F.min("conv_id").alias("conv_id"), joined(F.collect_list(F.struct("block", "x"))).alias("rendered"))
    return rows.select("conv_id", F.col("n").cast("long").alias("n_turns"), "rendered")


def collapse(logs: DataFrame) -> DataFrame:
    turns = C.written(prefixes(logs), "turns")
    return render(turns, C.written(maximal(turns), "maximal"))


def op6_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: Compares whole conversations as lists.
OP6_SQL = """
WITH turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
whole AS (SELECT conv_id, list(role || chr(1) || text ORDER BY turn, role, text) AS l, list('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) ORDER BY turn, role, text) AS r FROM turns GROUP BY conv_id),
ends AS (SELECT l, min(conv_id) AS conv_id FROM whole GROUP BY l),
inner_ AS (SELECT DISTINCT l[1:k] AS l FROM (SELECT l, unnest(range(1, len(l))) AS k FROM whole))
SELECT e.conv_id, len(w.l)::BIGINT AS n_turns, array_to_string(w.r, '') AS rendered
FROM ends e JOIN whole w ON w.conv_id = e.conv_id WHERE NOT EXISTS (SELECT 1 FROM inner_ i WHERE i.l = e.l)
"""
