"""Distance joins on a grid: an equi-join on cells, never a nested loop."""
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeproof.functions.geo import distance
from placeproof.session import checkpoint


def _cells(x: Column, y: Column, r: float):
    return F.floor(x / r).cast("long"), F.floor(y / r).cast("long")


def _spread(df: DataFrame, x: str, y: str, r: float) -> DataFrame:
    """One copy of each row per cell of the 3 x 3 neighbourhood."""
    cx, cy = _cells(F.col(x), F.col(y), r)
    near = [F.struct((cx + i).alias("gx"), (cy + j).alias("gy"))
            for i in (-1, 0, 1) for j in (-1, 0, 1)]
    return df.withColumn("_g", F.explode(F.array(*near))).select("*", "_g.gx", "_g.gy").drop("_g")


def within(left: DataFrame, right: DataFrame, r: float, scope: list[str] | None = None,
           lxy=("x", "y"), rxy=("x2", "y2"), salts: int = 1) -> DataFrame:
    """Inner join of rows at most r apart, within equal `scope` columns; adds `d`.

    Column names of the two sides must differ except for `scope`.  `salts` splits a hot cell: left
    rows take one salt, right rows are copied to every salt.
    """
    scope = scope or []
    gx, gy = _cells(F.col(lxy[0]), F.col(lxy[1]), r)
    lhs = left.withColumn("gx", gx).withColumn("gy", gy)
    rhs = _spread(right, rxy[0], rxy[1], r)
    keys = [*scope, "gx", "gy"]
    if salts > 1:
        lhs = lhs.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
        rhs = rhs.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        keys.append("_salt")
    d = distance(F.col(lxy[0]), F.col(lxy[1]), F.col(rxy[0]), F.col(rxy[1]))
    return lhs.join(rhs, keys).withColumn("d", d).filter(F.col("d") <= r).drop("gx", "gy", "_salt")


def close_pairs(points: DataFrame, id_col: str, r: float, scope: list[str] | None = None,
                include_coincident: bool = False, salts: int = 1) -> DataFrame:
    """Unordered pairs a < b with 0 < d <= r (d >= 0 with `include_coincident`)."""
    scope = scope or []
    a = points.select(*scope, F.col(id_col).alias("a"), "x", "y")
    b = points.select(*scope, F.col(id_col).alias("b"), F.col("x").alias("x2"),
                      F.col("y").alias("y2"))
    out = within(a, b, r, scope, salts=salts).filter(F.col("a") < F.col("b"))
    return out if include_coincident else out.filter(F.col("d") > 0)


STEP = 3                                                # bits of a grid step: a cell has 8 x 8 cells below it
DEPTH = 7
FEW = 64                                                # points of a cell that are simply compared


def nearest(left: DataFrame, right: DataFrame, left_id: str, right_id: str, start_r: float | None = None,
            scope: list[str] | None = None) -> DataFrame:
    """Nearest right row per left row (ties by id): (left_id, right_id, d).

    Right rows lie on a pyramid of grids.  A left row starts with the few coarse cells of its scope and goes down: of the cells it
    holds, the smallest largest distance bounds its answer, and cells that begin beyond it are dropped.  Cells of few points are compared
    point by point at the end, again only within the bound.  So a far row follows the rim that faces it and never meets its whole
    scope.  Coincident right rows are folded to the smallest id.  Rows without a position and rows in a scope without right rows stay out;
    a position that is not finite raises ValueError.  start_r is not used any more.
    """
    scope = scope or []
    spots = right.filter("x2 is not null and y2 is not null").groupBy(*scope, "x2", "y2").agg(F.min(right_id).alias(right_id))
    own = left.filter("x is not null and y is not null").select(*scope, left_id, "x", "y")
    reach = max(r[0] or 0.0 for r in (spots.agg(F.max(F.greatest(F.abs("x2"), F.abs("y2")))).first(), own.agg(F.max(F.greatest(F.abs("x"), F.abs("y")))).first()))
    if not reach < 1e15:
        raise ValueError("a position is not finite")
    size = 2.0 ** math.ceil(math.log2(reach + 1))
    bits = STEP * DEPTH
    fine = [F.floor(F.col(f"{c}2") / size * float(1 << bits)).cast("long").alias(f"c{c}") for c in ("x", "y")]
    placed = checkpoint(spots.select("*", *fine))

    def cells(level: int) -> DataFrame:
        down = STEP * (DEPTH - level)
        g = placed.groupBy(*scope, F.shiftright("cx", down).alias("gx"), F.shiftright("cy", down).alias("gy")).agg(F.count("*").alias("n"))
        return g.withColumn("px", F.shiftright("gx", STEP)).withColumn("py", F.shiftright("gy", STEP))

    def bounds(rows: DataFrame, level: int) -> DataFrame:
        """Adds the smallest and largest distance of each row to its cell."""
        side = size / (1 << (STEP * level))
        slack = size * 1e-12
        begin = {c: F.col(f"g{c}") * side - slack for c in "xy"}
        end = {c: (F.col(f"g{c}") + 1) * side + slack for c in "xy"}
        near = [F.greatest(begin[c] - F.col(c), F.col(c) - end[c], F.lit(0.0)) for c in "xy"]
        far = [F.greatest(F.abs(F.col(c) - begin[c]), F.abs(F.col(c) - end[c])) for c in "xy"]
        return rows.withColumn("level", F.lit(level)).withColumn("lo", F.hypot(*near)).withColumn("hi", F.hypot(*far))
    top = cells(0).drop("px", "py")
    rest = bounds(own.join(top, scope) if scope else own.join(F.broadcast(top)), 0)   # four cells at most around the origin
    keep = [*scope, left_id, "x", "y", "level", "gx", "gy", "n", "lo", "hi"]
    small = None
    for level in range(DEPTH + 1):
        told = rest.select(*keep)
        held = told if small is None else told.unionByName(small)
        held = held.join(held.groupBy(left_id).agg(F.min("hi").alias("most")), left_id).filter("lo <= most").drop("most")
        held = checkpoint(held)
        done = (F.col("n") <= FEW) | (F.col("level") < level) | F.lit(level == DEPTH)
        small, rest = held.filter(done), held.filter(~done)
        if rest.isEmpty():
            break
        down = rest.withColumnsRenamed({"gx": "px", "gy": "py"}).drop("n", "level", "lo", "hi")
        rest = bounds(down.join(cells(level + 1), [*scope, "px", "py"]), level + 1)
    levels = [r[0] for r in small.select("level").distinct().collect()]                # DEPTH + 1 at most
    if not levels:
        return own.select(left_id).limit(0).join(placed.select(right_id), F.lit(False)).withColumn("d", F.lit(0.0))
    at = [F.struct(F.lit(k).alias("level"), F.shiftright("cx", STEP * (DEPTH - k)).alias("gx"), F.shiftright("cy", STEP * (DEPTH - k)).alias("gy")) for k in levels]
    points = placed.withColumn("c", F.explode(F.array(*at))).select(*scope, right_id, "x2", "y2", "c.*")
    d = distance(F.col("x"), F.col("y"), F.col("x2"), F.col("y2"))
    met = small.join(points, [*scope, "level", "gx", "gy"]).select(left_id, d.alias("d"), right_id)
    return met.groupBy(left_id).agg(F.min(F.struct("d", right_id)).alias("m")).select(left_id, F.col(f"m.{right_id}").alias(right_id), F.col("m.d").alias("d"))
