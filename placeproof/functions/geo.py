"""Geometry on a local metric plane: x and y in metres, Euclidean."""
from pyspark.sql import Column
from pyspark.sql import functions as F

# Compass names, clockwise from north.
COMPASS = ["N", "NE", "E", "SE", "S", "SW", "W", "NW"]


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))


def bearing(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Degrees clockwise from +y; 0 for identical points."""
    dx, dy = x2 - x1, y2 - y1
    return F.when((dx == 0) & (dy == 0), F.lit(0.0)).otherwise(
        F.pmod(F.degrees(F.atan2(dx, dy)) + 360.0, F.lit(360.0)))


def compass(deg: Column) -> Column:
    return F.get(F.array(*[F.lit(c) for c in COMPASS]),
                 (F.floor((deg + 22.5) / 45.0) % 8).cast("int"))


def round10(v: Column) -> Column:
    """Nearest 10 m, half to even."""
    return (F.bround(v / 10.0, 0) * 10).cast("long")
