"""Medians that leave the row itself out."""
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def leave_one_out_median(df: DataFrame, key: str, row_id: str, value: str, name: str) -> DataFrame:
    """Median of the other rows' values in the same group, for every row.

    Removing one row shifts order statistics by at most one, so four order statistics of the group
    give the answer for all its rows; no row pairs are formed.
    """
    w = Window.partitionBy(key).orderBy(value, row_id)
    whole = Window.partitionBy(key)
    r = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(whole))
    m = F.col("_n") - 1
    lo, hi = F.floor((m - 1) / 2), F.floor(m / 2)

    def stat(k):
        return F.max(F.when(F.col("_i") == k, F.col(value))).over(whole)

    r = (r.withColumn("_a0", stat(lo)).withColumn("_a1", stat(lo + 1))
         .withColumn("_b0", stat(hi)).withColumn("_b1", stat(hi + 1)).filter("_n > 1"))
    first = F.when(lo < F.col("_i"), F.col("_a0")).otherwise(F.col("_a1"))
    second = F.when(hi < F.col("_i"), F.col("_b0")).otherwise(F.col("_b1"))
    return r.select(row_id, ((first + second) / 2.0).alias(name), m.alias("n_others"))
