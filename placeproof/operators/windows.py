"""Window operators, written so that one hot key does not become one hot task where it matters."""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeproof.session import checkpoint


def _middle(values: Column) -> Column:
    """Median of a sorted array without nulls (null where it is empty)."""
    low, high = (F.get(values, F.floor((F.size(values) - i) / 2).cast("int")).cast("double") for i in (1, 0))
    return low * 0.5 + high * 0.5


def _tail(k: int) -> list[Column]:
    """Aggregates of rows numbered from the last fix (rn): plain maxima of at most k rows, which hash aggregation keeps without buffers."""
    def median(c: str) -> Column:
        return _middle(F.array_sort(F.array_compact(F.array(*[F.max(F.when(F.col("rn") == i, F.col(c))) for i in range(1, k + 1)]))))
    return [median("dx").alias("tail_dx"), median("dy").alias("tail_dy"), F.count_if(F.col("rn") <= k).alias("tail_n")]


def trace_tail(trace: DataFrame, k: int = 3) -> DataFrame:
    """Median of the last k fixes per visit.

    `row_number() <= k` lets Spark cut each task to k rows per visit before the shuffle
    (WindowGroupLimit), so a visit holding a third of all fixes is harmless.
    """
    w = Window.partitionBy("visit_id").orderBy(F.col("seq").desc(), F.col("dx"), F.col("dy"))
    last = trace.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)
    return last.groupBy("visit_id").agg(*_tail(k))


def trace_medians(trace: DataFrame, k: int = 3) -> DataFrame:
    """`trace_tail` and the medians of whole traces (med_dx, med_dy, trail_points) in one shuffle.

    The fixes of a task are sorted by (visit, value) and the middle ones taken by number, so no visit has a buffer of its own; a long
    trace is sorted with spill.
    """
    own = Window.partitionBy("visit_id")
    rows = trace.select("visit_id", "seq", "dx", "dy").withColumn("rn", F.row_number().over(own.orderBy(F.col("seq").desc(), F.col("dx"), F.col("dy"))))
    rows = rows.withColumns({f"_n{c}": F.count(c).over(own) for c in ("dx", "dy")})          # both counts in one pass, in the order there is
    for c in ("dx", "dy"):
        rows = rows.withColumn(f"_r{c}", F.row_number().over(own.orderBy(F.col(c).asc_nulls_last())))

    def middle(c: str) -> Column:
        low, high = (F.max(F.when(F.col(f"_r{c}") == F.floor((F.col(f"_n{c}") + i) / 2), F.col(c))).cast("double") for i in (1, 2))
        return (low * 0.5 + high * 0.5).alias(f"med_{c}")
    return rows.groupBy("visit_id").agg(*_tail(k), middle("dx"), middle("dy"), F.count("*").alias("trail_points"))


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1,
                name: str = "rank") -> DataFrame:
    """First n rows per key; the partial limit runs before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Latest row per key as a mergeable aggregate (no sort, no per-key buffer)."""
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys)
            .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
            .select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest]))


def running_before(df: DataFrame, keys: list[str], ts: str, order: list[str],
                   values: dict[str, Column], bucket: Column) -> DataFrame:
    """Running sums over strictly earlier rows, hot keys split by time bucket.

    Each (key, bucket) is summed on its own; the bucket totals (small) are prefix-summed per key and
    joined back.  A key holding a third of all rows is spread over its buckets.
    """
    df = df.withColumn("_b", bucket)
    pairs = {f"_v_{n}": c for n, c in values.items()}
    df = df.withColumns(pairs)
    totals = df.groupBy(*keys, "_b").agg(*[F.sum(c).alias(c) for c in pairs])
    wk = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    prefix = totals.select(*keys, "_b", *[F.coalesce(F.sum(c).over(wk), F.lit(0)).alias(f"_p{c}")
                                          for c in pairs])
    wb = (Window.partitionBy(*keys, "_b").orderBy(ts, *order)
          .rowsBetween(Window.unboundedPreceding, -1))
    inner = df.withColumns({f"_i{c}": F.coalesce(F.sum(c).over(wb), F.lit(0)) for c in pairs})
    out = inner.join(prefix, [*keys, "_b"])
    return out.withColumns({n: F.col(f"_p_v_{n}") + F.col(f"_i_v_{n}") for n in values}).drop(
        "_b", *pairs, *[f"_p{c}" for c in pairs], *[f"_i{c}" for c in pairs])


def trailing_rate(events: DataFrame, key: str, ts: str, row_id: str, flag: Column,
                  days: int = 60, min_rows: int = 10) -> DataFrame:
    """Share of flagged rows among the same key's rows in [t - days, t), null under `min_rows`.

    rate(t) = C(t) - C(t - days) with C the count strictly before an instant.  Rows and both kinds
    of query instants are put on one line per (key, day); only day totals are summed per key.
    """
    us = F.unix_micros(ts)
    span = days * 86_400_000_000
    base = events.filter(F.col(key).isNotNull()).select(key, row_id, us.alias("t"),
                                                        flag.cast("int").alias("f"))
    hit = base.select(key, "t", F.lit(1).alias("n"), "f", F.lit(None).cast("long").alias("q"),
                      F.lit(0).alias("sign"))
    upper = base.select(key, "t", F.lit(0).alias("n"), F.lit(0).alias("f"),
                        F.col(row_id).alias("q"), F.lit(1).alias("sign"))
    lower = base.select(key, (F.col("t") - span).alias("t"), F.lit(0).alias("n"),
                        F.lit(0).alias("f"), F.col(row_id).alias("q"), F.lit(-1).alias("sign"))
    line = hit.unionByName(upper).unionByName(lower).withColumn(
        "_b", F.floor(F.col("t") / 86_400_000_000))
    totals = line.groupBy(key, "_b").agg(F.sum("n").alias("dn"), F.sum("f").alias("df"))
    wk = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    prefix = totals.select(key, "_b", F.coalesce(F.sum("dn").over(wk), F.lit(0)).alias("pn"),
                           F.coalesce(F.sum("df").over(wk), F.lit(0)).alias("pf"))
    wb = Window.partitionBy(key, "_b").orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    counted = (line.withColumn("cn", F.coalesce(F.sum("n").over(wb), F.lit(0)))
               .withColumn("cf", F.coalesce(F.sum("f").over(wb), F.lit(0)))
               .filter(F.col("q").isNotNull()).join(prefix, [key, "_b"]))
    return (counted.groupBy(F.col("q").alias(row_id))
            .agg(F.sum(F.col("sign") * (F.col("pn") + F.col("cn"))).alias("window_n"),
                 F.sum(F.col("sign") * (F.col("pf") + F.col("cf"))).alias("window_flagged"))
            .withColumn("rate", F.when(F.col("window_n") >= min_rows,
                                       F.col("window_flagged") / F.col("window_n"))))


def global_rank(df: DataFrame, order: list[str], name: str = "rank0") -> DataFrame:
    """Zero-based global rank without a single-task sort.

    Rows are range-partitioned, ranked inside each partition, and shifted by the partition offsets;
    only one row per partition is summed globally.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # both branches must see the same range bounds, so the partitioned rows are materialised
    parts = checkpoint(df.repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id()))
    cols = df.columns
    local = parts.withColumn("_r", F.row_number().over(
        Window.partitionBy("_pid").orderBy(*order)))
    sizes = parts.groupBy("_pid").agg(F.count("*").alias("_n"), F.min(F.struct(*order)).alias("_m"))
    offs = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(
        Window.orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return local.join(F.broadcast(offs.select("_pid", "_off")), "_pid").select(
        *cols, (F.col("_r") - 1 + F.col("_off")).alias(name))
