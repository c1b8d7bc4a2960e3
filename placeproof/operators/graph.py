"""Connected components and place blocks."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeproof.operators.pyramid import links_within
from placeproof.session import checkpoint


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): component is the smallest node id reachable.

    Alternating large-star and small-star steps: the edge set shrinks towards stars in a logarithmic
    number of rounds.  Each round is checkpointed, so lost executors replay one round only.
    """
    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            sym = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            sym = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        hooked = sym.join(low, "u")
        if large:
            hooked = hooked.filter(F.col("v") > F.col("u")).select(
                F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            hooked = hooked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
                low.select("u", F.col("m").alias("v")))
        return hooked.filter(F.col("u") != F.col("v")).distinct()

    e = checkpoint(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
                   .filter(F.col("a") != F.col("b")).distinct())
    def shape(x):
        return x.agg(F.count("*"), F.sum("u"), F.sum("v"),
                     F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    last = shape(e)
    for _ in range(max_rounds):
        e = checkpoint(star(star(e, True), False))
        now = shape(e)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not converge")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def place_blocks(points: DataFrame, id_col: str, r: float = 30.0,
                 scope: list[str] | None = None) -> DataFrame:
    """(id, block_id): components of points 0 < d <= r apart, singletons kept.

    Copies of one position are folded to a single representative before the distance join, so a pile
    of coincident points costs one row there.  Coincident points link only through a third position.
    Cells with many points are linked as cells (see `operators.pyramid`), not pair by pair.
    """
    scope = scope or []
    spots = checkpoint(points.groupBy(*scope, "x", "y").agg(F.min(id_col).alias("rep")))
    comp = connected_components(links_within(spots.withColumnRenamed("rep", "id"), r, scope))
    member = points.join(spots, [*scope, "x", "y"]).join(
        comp, F.col("rep") == F.col("node"), "left")
    return member.select(id_col, F.coalesce("component", id_col).alias("block_id"))
