"""Event-sourced intervals: from opening and closing events to spans, the state at any instant, and how many are open over time."""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeproof.operators.asof import latest_before


def spans(events: DataFrame, keys: list[str], at: str, event_id: str, opens: Column) -> DataFrame:
    """(keys, opened_by, begin, closed_by, end): maximal spans between an opening event and the next closing one; end is null while open.

    events holds opening (`opens` true) and closing rows.  An opening event inside a span and a closing one outside change nothing.
    A key's events are read in order by one task, with spill.
    """
    e = events.select(*keys, F.col(at).alias("_at"), F.col(event_id).alias("_id"), opens.alias("_open"))
    order = Window.partitionBy(*keys).orderBy("_at", "_id")
    turns = e.withColumn("_was", F.lag("_open").over(order)).filter(F.col("_open") != F.coalesce("_was", F.lit(False)))
    pair = turns.withColumn("_next", F.lead(F.struct("_at", "_id")).over(order)).filter("_open")
    return pair.select(*keys, F.col("_id").alias("opened_by"), F.col("_at").alias("begin"), F.col("_next._id").alias("closed_by"), F.col("_next._at").alias("end"))


def state_at(points: DataFrame, events: DataFrame, keys: list[str], point_at: str, at: str, event_id: str, opens: Column) -> DataFrame:
    """points with `is_open` (false before the first event) and `since_event`: the latest event at or before the instant decides."""
    log = events.select(*keys, F.col(at).alias("_ts_"), F.col(event_id).alias("since_event"), opens.alias("_open"))
    got = latest_before(points, log, keys, point_at, "_ts_", ["since_event", "_open"], ["since_event"], inclusive=True)
    return got.select(*points.columns, F.coalesce("_open", F.lit(False)).alias("is_open"), "since_event")


def open_over_time(spans_: DataFrame, group: list[str], days: DataFrame) -> DataFrame:
    """(group, day, opened, closed, open_at_end) for each group and each day of `days`: a sweep over begins and ends.

    Begins and ends are counted per (group, day) before anything is ordered, so the sweep sees a row per group and day.
    """
    change = (spans_.select(*group, F.to_date("begin").alias("day"), F.lit(1).alias("o"), F.lit(0).alias("c"))
              .unionByName(spans_.filter("end is not null").select(*group, F.to_date("end").alias("day"), F.lit(0).alias("o"), F.lit(1).alias("c"))))
    per = change.groupBy(*group, "day").agg(F.sum("o").alias("opened"), F.sum("c").alias("closed"))
    calendar = days.agg(F.sort_array(F.collect_set("day")).alias("days"))                                # one row
    grid = spans_.select(*group).distinct().withColumn("day", F.explode(calendar.scalar()))
    line = grid.join(per, [*group, "day"], "full_outer")
    upto = Window.partitionBy(*group).orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    zero = lambda c: F.coalesce(c, F.lit(0))
    return line.select(*group, "day", zero("opened").alias("opened"), zero("closed").alias("closed"),
                       F.sum(zero(F.col("opened")) - zero(F.col("closed"))).over(upto).alias("open_at_end"))
