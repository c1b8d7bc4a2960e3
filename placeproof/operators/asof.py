"""As-of reads of an append-only log.  One rule: strictly before the cut."""
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placeproof.session import checkpoint


def known_before(log: DataFrame, cut, ts: str = "observed_at") -> DataFrame:
    """Rows strictly before one instant (a pushed-down filter)."""
    return log.filter(F.col(ts) < F.lit(cut).cast("timestamp"))


def first_cuts(log: DataFrame, cuts: DataFrame, ts: str = "observed_at") -> tuple[DataFrame, DataFrame]:
    """(rows with `_first`, cuts with `_i`): each log row with the number of the first cut strictly after it.

    Rows and cuts are range-partitioned on one time line and scanned backwards; what a partition cannot answer comes from the first cut
    of the later ones, one row per partition.  So a day (or any span) that holds most of the log is spread.  Rows without an instant and rows
    that no cut follows leave.
    """
    c = cuts.select(F.col("cut").cast("timestamp").alias("cut")).filter("cut is not null").distinct().withColumn("_i", F.row_number().over(Window.orderBy("cut")))
    rows = log.select(*log.columns, F.col(ts).cast("timestamp").alias("_t"), F.lit(0).alias("_o"), F.lit(None).cast("int").alias("_i"))
    marks = c.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in log.schema], F.col("cut").alias("_t"), F.lit(1).alias("_o"), "_i")
    n = int(log.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # both branches below must see the same range bounds, so the partitioned rows are materialised
    line = checkpoint(rows.filter("_t is not null").unionByName(marks).repartitionByRange(n, "_t").withColumn("_pid", F.spark_partition_id()))
    # a log row at the instant of a cut comes before it on the way back, so it does not see that cut
    inside = F.min("_i").over(Window.partitionBy("_pid").orderBy(F.desc("_t"), "_o").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ends = line.groupBy("_pid").agg(F.min("_i").alias("_m"), F.max("_t").alias("_e")).withColumn("_later", F.min("_m").over(
        Window.orderBy("_e").rowsBetween(1, Window.unboundedFollowing)))        # a row per partition
    found = line.withColumn("_in", inside).filter("_o = 0").join(F.broadcast(ends.select("_pid", "_later")), "_pid").withColumn("_first", F.coalesce("_in", "_later"))
    return found.filter("_first is not null").select(*log.columns, "_first"), c


def known_before_each(log: DataFrame, cuts: DataFrame, ts: str = "observed_at") -> DataFrame:
    """Rows strictly before each instant of a cut table (column `cut`), one row per log row and cut, any number of cuts.

    Where sums or extremes per cut are wanted, `known_totals` gives them without these rows.
    """
    rows, c = first_cuts(log, cuts, ts)
    last = c.agg(F.max("_i").alias("_n"))
    known = rows.crossJoin(F.broadcast(last)).select(*log.columns, F.explode(F.sequence("_first", "_n")).alias("_i"))  # one row
    return known.join(c, "_i").select(*log.columns, "cut")


def known_totals(log: DataFrame, cuts: DataFrame, sums: dict, latest: dict | None = None, ts: str = "observed_at") -> DataFrame:
    """(cut, ...): sums and maxima over the rows strictly before each cut that has any.

    Rows are summed by the first cut that sees them; a running sum (maximum) over the cuts gives the rest.  Rows times cuts is never formed.
    """
    rows, c = first_cuts(log, cuts, ts)
    latest = latest or {}
    by = rows.groupBy(F.col("_first").alias("_i")).agg(F.count("*").alias("_rows"), *[F.sum(e).alias(n) for n, e in sums.items()], *[F.max(e).alias(n) for n, e in latest.items()])
    upto = Window.orderBy("_i").rowsBetween(Window.unboundedPreceding, Window.currentRow)             # a row per cut
    run = [F.coalesce(F.sum(n).over(upto), F.lit(0)).alias(n) for n in ("_rows", *sums)] + [F.max(n).over(upto).alias(n) for n in latest]
    return c.join(by, "_i", "left").select("cut", *run).filter("_rows > 0").drop("_rows")


def latest_before(points: DataFrame, log: DataFrame, keys: list[str], at: str, ts: str,
                  payload: list[str], tie: list[str], inclusive: bool = False,
                  bucket: str = "day") -> DataFrame:
    """As-of join: for every point the latest log row of the same key before `at`.

    Points and log rows are put on one time line per (key, bucket); the last row inside the bucket
    wins, else the last row of the nearest earlier bucket, found over one row per (key, bucket).  A hot
    key is spread over its buckets.
    """
    val = F.struct(F.col(ts).alias("_ts"), *[F.col(c) for c in tie], *[
        F.col(c) for c in payload if c not in tie])
    log_line = log.select(*keys, F.col(ts).alias("_t"), F.lit(0 if inclusive else 1).alias("_o"),
                          val.alias("_val"), F.lit(None).cast("struct<" + ",".join(
                              f"{f.name}:{f.dataType.simpleString()}" for f in points.schema)
                              + ">").alias("_pt"))
    pt_line = points.select(*keys, F.col(at).alias("_t"), F.lit(1 if inclusive else 0).alias("_o"),
                            F.lit(None).cast(log_line.schema["_val"].dataType).alias("_val"),
                            F.struct(*points.columns).alias("_pt"))
    line = log_line.unionByName(pt_line).withColumn("_b", F.date_trunc(bucket, "_t"))
    inside = F.max("_val").over(Window.partitionBy(*keys, "_b").orderBy("_t", "_o")
                                .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    per_bucket = line.groupBy(*keys, "_b").agg(F.max("_val").alias("_bv"))
    carried = per_bucket.withColumn("_prev", F.max("_bv").over(
        Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)))
    got = (line.withColumn("_in", inside).filter(F.col("_pt").isNotNull())
           .join(carried.select(*keys, "_b", "_prev"), [*keys, "_b"]))
    best = F.coalesce("_in", "_prev")
    return got.select("_pt.*", *[best[c].alias(c) for c in payload])


def cut_table(spark, cuts: list[str]) -> DataFrame:
    return spark.createDataFrame([(c,) for c in cuts], "cut string").withColumn(
        "cut", F.col("cut").cast("timestamp"))
