"""Distance questions that do not need the pairs: how many within r, is any within r, what hangs together.

Both sides are laid on a pyramid of grids (cell side r, r/2, r/4, ...).  Pairs of occupied cells of one level are told by their corners:
all of their points are within r, none is, or it is open.  Open pairs with few points are compared point by point, the others go one level
down.  So a dense cell is settled by a few counts and only the rim of its circle is looked at closely: the pairs formed grow with the
points, not with their square.
"""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeproof.functions.geo import distance
from placeproof.operators.profile import union_all
from placeproof.session import checkpoint

LEVELS = 20                                             # the finest cells are a millionth of r
FEW = 256                                               # point pairs of two cells that are simply compared


def _at(level: int, c: str) -> Column:
    return F.shiftright(c, LEVELS - level)


def _placed(points: DataFrame, r: float, scope: list[str]) -> DataFrame:
    """(scope, id, x, y, w, cx, cy): cells of the finest level; rows without a position leave; w is 1 where the points have no weight."""
    w = F.col("w") if "w" in points.columns else F.lit(1).cast("long").alias("w")
    fine = [F.floor(F.col(c) / r * float(1 << LEVELS)).cast("long").alias(f"c{c}") for c in ("x", "y")]
    return points.filter("x is not null and y is not null").select(*scope, "id", "x", "y", w, *fine)


def _cells(placed: DataFrame, level: int, scope: list[str], side: str) -> DataFrame:
    """Occupied cells of a level: coordinates, those of the cell above, points and their weight."""
    c = placed.groupBy(*scope, _at(level, "cx").alias(f"{side}x"), _at(level, "cy").alias(f"{side}y")).agg(F.count("*").alias(f"n{side}"), F.sum("w").alias(f"w{side}"))
    return c.withColumn(f"{side}px", F.shiftright(f"{side}x", 1)).withColumn(f"{side}py", F.shiftright(f"{side}y", 1))


def _bound(level: int, r: float, far: int) -> Column:
    """Smallest (far = -1) or largest (far = 1) distance of two points of the cells a and b."""
    side = r / (1 << level)
    dx, dy = (F.greatest(F.abs(F.col(f"a{c}") - F.col(f"b{c}")) + far, F.lit(0)) for c in ("x", "y"))
    return F.hypot(dx, dy) * side


def descend(left: DataFrame, right: DataFrame, r: float, scope: list[str], settle: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(sure, near) of two sides (scope, id, x, y).

    sure: (scope, level, ax, ay, bx, by, na, nb, wb[, top]) cell pairs all of whose points are within r; near: (scope, a, b, w, d[, top])
    point pairs within r that are in no sure pair.  w, wb: weight of the right side.  settle: "left" stops at a left cell once it has a sure partner, "top" once the two cells of level 1 have a
    sure or near pair (top tells them); None gives all pairs.
    """
    p, q = checkpoint(_placed(left, r, scope)), checkpoint(_placed(right, r, scope))
    around = F.explode(F.array(*[F.struct((F.col("ax") + i).alias("bx"), (F.col("ay") + j).alias("by")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    open_ = (_cells(p, 0, scope, "a").withColumn("g", around).select(*scope, "ax", "ay", "na", "wa", "g.bx", "g.by")
             .join(_cells(q, 0, scope, "b").drop("bpx", "bpy"), [*scope, "bx", "by"]))
    sures, few = [], []
    top = ["top"] if settle == "top" else []
    for level in range(LEVELS + 1):
        if level == 1 and settle == "top":
            open_ = open_.withColumn("top", F.struct("ax", "ay", "bx", "by"))
        told = checkpoint(open_.withColumn("level", F.lit(level)).filter(_bound(level, r, -1) <= r * (1 + 1e-9)).withColumn("sure", _bound(level, r, 1) <= r * (1 - 1e-9)))
        keep = [*scope, "level", "ax", "ay", "bx", "by", "na", "nb", "wb", *(top if level else [])]
        sure = told.filter("sure").select(*keep)
        if level or settle != "top":                    # cells of level 0 are never sure
            sures.append(sure)
        rest = told.filter("not sure")
        if settle == "left":
            rest = rest.join(sure.select(*scope, "ax", "ay").distinct(), [*scope, "ax", "ay"], "left_anti")
        elif top and level:
            rest = rest.join(sure.select(*scope, "top").distinct(), [*scope, "top"], "left_anti")
        small = (F.col("na") * F.col("nb") <= FEW) if level < LEVELS else F.lit(True)
        if level or settle != "top":
            few.append(rest.filter(small).select(*keep))
            rest = rest.filter(~small)
        rest = checkpoint(rest.select(*keep))
        if rest.isEmpty():
            break
        down = rest.withColumnsRenamed({"ax": "apx", "ay": "apy", "bx": "bpx", "by": "bpy"}).drop("na", "nb", "wb", "level")
        open_ = down.join(_cells(p, level + 1, scope, "a"), [*scope, "apx", "apy"]).join(_cells(q, level + 1, scope, "b"), [*scope, "bpx", "bpy"]).drop("apx", "apy", "bpx", "bpy")
    sure, small = union_all(sures), union_all(few)
    levels = sorted({*range(level + 1)})

    def rows(placed: DataFrame, side: str) -> DataFrame:
        every = placed.withColumn("l", F.explode(F.array(*[F.struct(F.lit(k).alias("level"), _at(k, "cx").alias(f"{side}x"), _at(k, "cy").alias(f"{side}y")) for k in levels])))
        return every.select(*scope, F.col("id").alias(side), F.col("x").alias(f"x_{side}"), F.col("y").alias(f"y_{side}"), F.col("w").alias(f"w_{side}"), "l.*")
    d = distance(F.col("x_a"), F.col("y_a"), F.col("x_b"), F.col("y_b"))
    near = (small.join(rows(p, "a"), [*scope, "level", "ax", "ay"]).join(rows(q, "b"), [*scope, "level", "bx", "by"]).withColumn("d", d).filter(F.col("d") <= r))
    return sure, near.select(*scope, "a", "b", F.col("w_b").alias("w"), "d", *top)


def _members(points: DataFrame, r: float, scope: list[str], cells: DataFrame) -> DataFrame:
    """(scope, id, ...) of the points of given cells (scope, level, ax, ay, ...)."""
    levels = [x["level"] for x in cells.select("level").distinct().collect()]        # at most LEVELS + 1
    p = _placed(points, r, scope)
    if not levels:
        return p.select(*scope, "id").limit(0).join(cells.drop("level", "ax", "ay"), scope)
    spread = p.withColumn("l", F.explode(F.array(*[F.struct(F.lit(k).alias("level"), _at(k, "cx").alias("ax"), _at(k, "cy").alias("ay")) for k in levels]))).select(*scope, "id", "l.*")
    return spread.join(cells, [*scope, "level", "ax", "ay"]).drop("level", "ax", "ay")


def _spots(points: DataFrame, scope: list[str]) -> DataFrame:
    """Coincident points folded to one, with their number."""
    return points.filter("x is not null and y is not null").groupBy(*scope, "x", "y").agg(F.min("id").alias("id"), F.count("*").alias("w"))


def count_within(left: DataFrame, right: DataFrame, r: float, scope: list[str]) -> DataFrame:
    """(scope, id, n): how many right points are at most r away from each left point that has any."""
    own, other = checkpoint(_spots(left, scope)), _spots(right, scope)
    sure, near = descend(own, other, r, scope)
    whole = checkpoint(sure.groupBy(*scope, "level", "ax", "ay").agg(F.sum("wb").alias("n")))
    parts = _members(own, r, scope, whole).select(*scope, "id", "n").unionByName(near.groupBy(*scope, F.col("a").alias("id")).agg(F.sum("w").alias("n")))
    counted = parts.groupBy(*scope, "id").agg(F.sum("n").alias("n"))
    placed = counted.join(own.select(*scope, "id", "x", "y"), [*scope, "id"]).drop("id")
    return left.select(*scope, "id", "x", "y").join(placed, [*scope, "x", "y"]).select(*scope, "id", "n")


def any_within(left: DataFrame, right: DataFrame, r: float, scope: list[str]) -> DataFrame:
    """(scope, id) of the left points that have a right point at most r away."""
    own, other = checkpoint(_spots(left, scope)), _spots(right, scope)
    sure, near = descend(own, other, r, scope, settle="left")
    whole = checkpoint(sure.select(*scope, "level", "ax", "ay").distinct())
    hit = _members(own, r, scope, whole).select(*scope, "id").unionByName(near.select(*scope, F.col("a").alias("id"))).distinct()
    placed = own.select(*scope, "id", "x", "y").join(hit, [*scope, "id"]).drop("id")
    return left.select(*scope, "id", "x", "y").join(placed, [*scope, "x", "y"], "left_semi").select(*scope, "id")


def links_within(spots: DataFrame, r: float, scope: list[str]) -> DataFrame:
    """(a, b): enough links that spots (distinct positions) hang together exactly as with all pairs at most r apart.

    The points of a sure cell pair are all linked: each goes to the smallest id of its cell, and the two smallest to each other.
    """
    sure, near = descend(spots, spots, r, scope, settle="top")
    sure = checkpoint(sure)
    ends = sure.select(*scope, "level", "ax", "ay").union(sure.select(*scope, "level", "bx", "by")).distinct()
    member = _members(spots, r, scope, ends.withColumn("cell", F.struct("level", "ax", "ay")))
    first = checkpoint(member.groupBy(*scope, "cell").agg(F.min("id").alias("first")))
    own = member.join(first, [*scope, "cell"]).select(F.col("first").alias("a"), F.col("id").alias("b"))
    cell = lambda side, name: first.select(*scope, F.col("cell").alias(f"{side}_cell"), F.col("first").alias(name))
    across = (sure.select(*scope, F.struct("level", "ax", "ay").alias("a_cell"), F.struct("level", F.col("bx").alias("ax"), F.col("by").alias("ay")).alias("b_cell"))
              .join(cell("a", "a"), [*scope, "a_cell"]).join(cell("b", "b"), [*scope, "b_cell"]).select("a", "b"))
    single = near.filter("a <> b").groupBy(*scope, "top").agg(F.min(F.struct("a", "b")).alias("p")).select("p.a", "p.b")
    return own.union(across).union(single).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
