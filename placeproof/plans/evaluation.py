"""Evaluation helpers shared by the evaluation jobs."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeproof.functions import geo


def archetype(norm: Column, raw: Column) -> Column:
    """Six address classes by token tests."""
    w = F.split(norm, " ")
    pin = F.exists(w, lambda t: t.rlike("^[0-9]{6}$"))
    road = F.arrays_overlap(w, F.array(*[F.lit(x) for x in ("gali", "road", "cross", "main", "street")]))
    house = F.exists(w, lambda t: t.rlike("^[0-9]+$"))
    rel = norm.rlike(r"\b(near|opposite|behind|beside|adjacent|next to)\b")
    return (F.when(rel, "landmark-relation").when(pin & road & house, "pincode+road+house")
            .when(pin & road, "pincode+road").when(road, "road-only")
            .when(raw.rlike(r"[\x{0C01}-\x{FFFF}]"), "multi-script").otherwise("plain"))


def with_error(cands: DataFrame, labels: DataFrame) -> DataFrame:
    """Candidates joined to a label (lx, ly), with their error in metres."""
    return cands.join(labels, "address_id").withColumn(
        "err", geo.distance(F.col("x"), F.col("y"), F.col("lx"), F.col("ly")))


def grade(err: Column) -> Column:
    return F.when(err <= 100, 3).when(err <= 250, 2).when(err <= 500, 1).otherwise(0)


def hits(err: str = "err") -> list[Column]:
    return [F.round(F.avg((F.col(err) <= t).cast("int")), 4).alias(f"hit_{t}m") for t in (100, 250, 500)]


def oracle_pick(cands: DataFrame) -> DataFrame:
    """Best candidate per address by error (ties by id), and the set size."""
    return cands.groupBy("address_id").agg(
        F.min(F.struct("err", "candidate_id", "arm", "granularity")).alias("m"), F.count("*").alias("n_cand")) \
        .select("address_id", F.col("m.err").alias("oracle_err"), F.col("m.arm").alias("oracle_arm"),
                F.col("m.candidate_id").alias("oracle_id"), F.col("m.granularity").alias("oracle_granularity"),
                "n_cand")


def top1(cands: DataFrame, order: list[Column]) -> DataFrame:
    """First candidate per address under an ordering, as a mergeable minimum."""
    keys = [o.alias(f"k{i}") for i, o in enumerate(order)]
    return cands.groupBy("address_id").agg(F.min(F.struct(
        *keys, "candidate_id", "arm", "err", "x", "y", "granularity")).alias("m")).select("address_id", "m.candidate_id", "m.arm",
                                                                       "m.err", "m.x", "m.y", "m.granularity")


def ndcg5(cands: DataFrame, no_relevance: str = "exclude") -> DataFrame:
    """Per-address nDCG@5 over the rule order (`rank`).

    Two rules for an address without any relevant candidate: `exclude` drops it, `one` scores it 1.0.
    The `one` rule takes the ideal over the five shown, the `exclude` rule over the whole set.
    """
    g = cands.withColumn("g", grade(F.col("err")))
    pool = g if no_relevance == "exclude" else g.filter("rank <= 5")
    ideal = pool.groupBy("address_id").agg(F.slice(F.reverse(F.sort_array(F.collect_list("g"))), 1, 5).alias("ideal"))
    shown = g.filter("rank <= 5").groupBy("address_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "g"))), lambda s: s["g"]).alias("shown"))

    def dcg(arr):
        return F.aggregate(F.transform(arr, lambda x, i: (F.pow(F.lit(2.0), x) - 1) / F.log2(i + 2.0)),
                           F.lit(0.0), lambda a, b: a + b)

    j = shown.join(ideal, "address_id").withColumn("idcg", dcg(F.col("ideal")))
    val = F.when(F.col("idcg") > 0, dcg(F.col("shown")) / F.col("idcg"))
    if no_relevance == "one":
        val = F.coalesce(val, F.lit(1.0))
    return j.select("address_id", val.alias("ndcg")).filter("ndcg is not null")
