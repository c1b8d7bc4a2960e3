"""Distributed union-find, and a bounded filter for the rows of few keys."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeproof.llm.base import stage

#: Bits of the key filter: 1,024 bitmaps of 4 kB, whatever the number of keys.
FILTER_BITS = 25


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of the nodes of edges (a, b); component is the smallest node reachable.

    Large-star and small-star steps in turn; a star only sends its smallest node, and each round is written to the shared folder.
    """
    def directed(e: DataFrame) -> DataFrame:
        return e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u != v").distinct()

    def step(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        hooked = both.join(low, "u")
        if large:
            return directed(hooked.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        return directed(hooked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))))

    def open_nodes(e: DataFrame) -> bool:
        """Whether some node has two roots, or is a root and has one itself."""
        ends = e.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("root")).union(e.select("v", F.lit(0), F.lit(1)))
        return ends.groupBy("node").agg(F.sum("below").alias("n"), F.max("root").alias("r")).agg(F.count_if(F.expr("n > 1 or n = 1 and r = 1"))).first()[0] > 0

    e = stage(directed(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))), "links")
    for _ in range(most_rounds):
        if not open_nodes(e):
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        e = stage(step(step(e, True), False), "stars")
    raise RuntimeError("components did not converge")


def key_filter(keys: DataFrame, column: str) -> DataFrame:
    """(slot, bits): a bitmap over a 64-bit hash column, of fixed size, so it may be broadcast."""
    at = F.pmod(F.col(column), F.lit(1 << FILTER_BITS))
    return (keys.select(at.alias("at")).groupBy(F.shiftright("at", 15).cast("int").alias("slot"))
            .agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(32767)).alias("bits")))


def mark_match(rows: DataFrame, column: str, filter_: DataFrame, name: str) -> DataFrame:
    """Adds whether the row's hash may be among the keys: never false for one of them."""
    at = F.pmod(F.col(column), F.lit(1 << FILTER_BITS))
    kept = rows.withColumn("slot", F.shiftright(at, 15).cast("int")).join(F.broadcast(filter_), "slot", "left")
    bit = at.bitwiseAND(32767)
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return kept.withColumn(name, F.coalesce(F.getbit(byte, bit.bitwiseAND(7).cast("int")) == 1, F.lit(False))).drop("slot", "bits")


def may_match(rows: DataFrame, column: str, filter_: DataFrame) -> DataFrame:
    """Rows whose hash may be among the keys: never too few; the exact join follows.

    Let that be an inner join with distinct keys: the optimizer moves a semi-join below this filter, and then shuffles all rows.
    """
    return mark_match(rows, column, filter_, "hit").filter("hit").drop("hit")
