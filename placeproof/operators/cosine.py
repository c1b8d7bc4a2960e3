"""Cosine joins of sparse vectors without scoring pairs that cannot reach the threshold."""
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _prefixes(vectors: DataFrame, freq: DataFrame, key: str, threshold: float) -> DataFrame:
    """(key, term, tail): the terms, rarest first, whose remaining norm still reaches the threshold; tail is that norm of the unit vector."""
    unit = vectors.join(freq, "term").withColumn("sq", F.pow(F.col("w") / F.col("norm"), 2.0))
    rest = Window.partitionBy("key").orderBy(F.desc("df"), F.desc("term")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (unit.withColumn("tail", F.sqrt(F.sum("sq").over(rest))).filter(F.col("tail") >= threshold)
            .select(F.col("key").alias(key), "term", F.col("tail").alias(f"{key}_tail")))


def _items(vectors: DataFrame, key: str) -> DataFrame:
    return vectors.groupBy(F.col("key").alias(key)).agg(
        F.map_from_entries(F.collect_list(F.struct("term", "w"))).alias(f"{key}_v"), F.max("norm").alias(f"{key}_norm"))


def cosine_of(pairs: DataFrame, a: DataFrame, b: DataFrame, digits: int = 4) -> DataFrame:
    """(a, b, cos) of given distinct pairs of keys; vectors are (key, term, w, norm) with distinct terms."""
    both = pairs.join(_items(a, "a"), "a").join(_items(b, "b"), "b")
    dot = F.aggregate(F.map_entries("a_v"), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.element_at(F.col("b_v"), e["key"]), F.lit(0.0)))
    return both.select("a", "b", F.round(dot / (F.col("a_norm") * F.col("b_norm")), digits).alias("cos"))


def cosine_pairs(a: DataFrame, b: DataFrame, threshold: float, digits: int = 4) -> DataFrame:
    """(a, b, cos) of all pairs of keys with a rounded cosine of threshold or more; exact, threshold above 0.

    Terms are taken in one order, rarest first.  What is left of a unit vector from a term on bounds its part of any product, so a pair
    that reaches the threshold meets in a term at which both remaining norms still do, and the first such term of a pair has a product
    of remaining norms that does (both sides are cut there, and the product is a join condition).  Frequent terms stand last and are
    mostly cut off.  Only pairs that met are scored.
    """
    low = threshold - 0.6 * 10.0 ** -digits             # the cosine is rounded
    freq = a.select("key", "term").union(b.select("key", "term")).groupBy("term").agg(F.count("*").alias("df"))
    met = (_prefixes(a, freq, "a", low).join(_prefixes(b, freq, "b", low), "term")
           .filter(F.col("a_tail") * F.col("b_tail") >= low - 1e-9).select("a", "b").distinct())
    return cosine_of(met, a, b, digits).filter(F.col("cos") >= threshold)
