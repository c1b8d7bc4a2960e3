"""Table and column profiles as set-based aggregates."""
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def row_hash(cols: list[str], seed: int):
    """64-bit hash of a row; which cells are null is hashed too, because a hash skips nulls."""
    return F.xxhash64(F.lit(seed), F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in cols]), *cols)


def table_profile(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Rows, columns, key uniqueness, full-row duplicates and null cells.

    Rows are folded map-side by key and a 128-bit hash of the whole row, so neither texts nor vectors
    are shuffled; the key count then runs over the folded rows.
    """
    cols = df.columns
    nulls = sum((F.col(c).isNull().cast("int") for c in cols), F.lit(0))
    folded = df.select(*keys, row_hash(cols, 1).alias("_h1"), row_hash(cols, 2).alias("_h2"), nulls.alias("_nulls")).groupBy(*keys, "_h1", "_h2").agg(
        F.count("*").alias("_n"), F.sum("_nulls").alias("_nulls"))
    by_key = folded.groupBy(*keys).agg(
        F.sum("_n").alias("rows"), F.count("*").alias("distinct_rows"), F.sum("_nulls").alias("null_cells"))
    return by_key.agg(
        F.lit(name).alias("table_name"), F.sum("rows").alias("n_rows"),
        F.lit(len(cols)).cast("long").alias("n_cols"),
        (F.count("*") == F.sum("rows")).alias("key_unique"),
        (F.sum("rows") - F.sum("distinct_rows")).alias("full_duplicates"),
        F.round(100.0 * F.sum("null_cells") / (F.sum("rows") * len(cols)), 3).alias("null_pct"))


NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")
SHOWN = 40                                  # characters of a value in the top list


def shown(df: DataFrame, c: str):
    """Short text of a value for the top list."""
    t = dict(df.dtypes)[c]
    if t in ("double", "float"):
        return F.col(c).cast("decimal(20,4)").cast("string")
    if t.startswith("timestamp"):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    if t.startswith("array"):
        return F.concat(F.size(c).cast("string"), F.lit(" values"))
    return F.left(F.col(c).cast("string"), F.lit(SHOWN))


def value_counts(df: DataFrame) -> DataFrame:
    """(column_name, h1, h2, value, n): every column unpivoted and counted in one shuffle.

    Values are told apart by a 128-bit hash of the value itself; only a short text rides along.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.when(F.col(c).isNotNull(), F.xxhash64(c)).alias("h1"),
                               F.xxhash64(F.lit(1), c).alias("h2"), shown(df, c).alias("value")) for c in df.columns])
    return (df.select(F.explode(pairs).alias("p")).select("p.*")
            .groupBy("column_name", "h1", "h2", "value").agg(F.count("*").alias("n")))


def column_profile(df: DataFrame) -> DataFrame:
    """Nulls, distinct values, % unique, numeric min/max/mean and top-3 values per column.

    Numbers are aggregated as they are, in one pass without a shuffle of rows.
    """
    num = {c for c, t in df.dtypes if t in NUMBERS}
    none = F.lit(None).cast("double")
    one = df.agg(*[F.struct(F.lit(c).alias("column_name"), F.count("*").alias("n_rows"), F.count_if(F.col(c).isNull()).alias("n_null"),
                            *[(f(c).cast("double") if c in num else none).alias(a) for f, a in ((F.min, "min_value"), (F.max, "max_value"), (F.avg, "mean_value"))]).alias(f"_{i}")
                   for i, c in enumerate(df.columns)])
    base = one.select(F.explode(F.array(*[f"_{i}" for i in range(len(df.columns))])).alias("r")).select("r.*").withColumn("mean_value", F.round("mean_value", 3))
    vc = value_counts(df).filter("h1 is not null")
    distinct = vc.groupBy("column_name").agg(F.count("*").alias("n_distinct"))
    w = Window.partitionBy("column_name").orderBy(F.col("n").desc(), "value")
    top = (vc.withColumn("rn", F.row_number().over(w))
           .filter("rn <= 3").groupBy("column_name")
           .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rn", "value", "n"))),
                                         lambda s: F.concat_ws(":", s["value"], s["n"])), "|")
                .alias("top_values")))
    return base.join(distinct, "column_name", "left").join(top, "column_name", "left").withColumn(
        "n_distinct", F.coalesce("n_distinct", F.lit(0))).withColumn(
        "pct_unique", F.round(100.0 * F.col("n_distinct") / F.col("n_rows"), 3))


def constant_flags(profile: DataFrame) -> DataFrame:
    """Constant, near-constant (one value on >= 99 %) and >= 90 %-unique columns."""
    share = F.regexp_extract("top_values", r"(?s)^.{0,60}?:(\d+)(\||$)", 1).try_cast("long") / F.col("n_rows")
    return profile.select(
        "column_name", (F.col("n_distinct") <= 1).alias("is_constant"),
        (share >= 0.99).alias("is_near_constant"), (F.col("pct_unique") >= 90).alias("is_id_like"))


def key_links(child: DataFrame, child_col: str, parent: DataFrame, parent_col: str,
              name: str) -> DataFrame:
    """Orphans in both directions and fan-out, from one outer join of per-key counts."""
    c = child.groupBy(F.col(child_col).alias("k")).agg(F.count("*").alias("nc"))
    p = parent.groupBy(F.col(parent_col).alias("k")).agg(F.count("*").alias("np"))
    j = c.filter("k is not null").join(p, "k", "full_outer")
    return j.agg(
        F.lit(name).alias("relation"),
        F.count_if(F.col("np").isNull()).alias("orphan_child_keys"),
        F.coalesce(F.sum(F.when(F.col("np").isNull(), F.col("nc"))), F.lit(0))
        .alias("orphan_child_rows"),
        F.count_if(F.col("nc").isNull()).alias("parents_without_child"),
        F.count_if(F.col("np").isNotNull() & (F.col("nc") > 1)).alias("parents_with_many"),
        F.max(F.when(F.col("np").isNotNull(), F.col("nc"))).alias("max_per_parent"))
