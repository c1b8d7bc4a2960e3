"""Belief versions over time: diffs, timelines, provenance, why-lost reasons, geometry."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeproof import policy
from placeproof.operators.profile import union_all
from placeproof.plans import belief

DIFF_FIELDS = ["tier", "status", "candidate_id", "radius_m"]


def versions(v, cuts: list[str]) -> DataFrame:
    """Belief versions at several cuts, numbered in time order."""
    return union_all([belief.belief_at(v, c).withColumn("v", F.lit(i + 1)) for i, c in enumerate(cuts)])


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows whose belief differs in any of the four fields, with the changed field names."""
    b = before.select("address_id", *[F.col(c).alias(f"{c}_before") for c in DIFF_FIELDS])
    a = after.select("address_id", *[F.col(c).alias(f"{c}_after") for c in DIFF_FIELDS])
    j = b.join(a, "address_id", "full_outer")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"{c}_before").eqNullSafe(F.col(f"{c}_after")), F.lit(c))
                                        for c in DIFF_FIELDS]))
    return j.withColumn("changed", F.array_join(changed, "+")).filter("changed <> ''")


def changes(vers: DataFrame) -> DataFrame:
    """Typed change events between consecutive versions of each address.

    An address has one version per cut (a handful), so the ordered window per address stays small.
    """
    from pyspark.sql import Window
    w = Window.partitionBy("address_id").orderBy("v")
    p = vers.select("address_id", "v", "as_of", "tier", "status", "radius_m",
                    F.lag("tier").over(w).alias("pt"), F.lag("status").over(w).alias("ps"),
                    F.lag("radius_m").over(w).alias("pr"))
    has = F.col("v") > 1
    moved = ~F.col("tier").eqNullSafe(F.col("pt")) | ~F.col("status").eqNullSafe(F.col("ps"))
    kinds = F.array_compact(F.array(
        F.when(has & moved, F.struct(F.lit("decision_changed").alias("kind"), F.concat_ws(">", F.concat_ws("/", "pt", "ps"), F.concat_ws("/", "tier", "status")).alias("detail"))),
        F.when(has & ~F.col("radius_m").eqNullSafe(F.col("pr")), F.struct(
            F.lit("uncertainty_changed").alias("kind"),
            F.when(F.coalesce("radius_m", F.lit(0.0)) > F.coalesce("pr", F.lit(0.0)), "widened").otherwise("narrowed").alias("detail"))),
        F.when(F.col("status").isin("MOVED_SUSPECTED", "CONTESTED") & (~has | ~F.col("status").eqNullSafe(F.col("ps"))),
               F.struct(F.lit("contradiction_detected").alias("kind"), F.col("status").alias("detail")))))
    return p.select("address_id", "as_of", F.explode(kinds).alias("k")).select("address_id", "as_of", "k.kind", "k.detail")


def lost_reasons(ranked: DataFrame, chosen: DataFrame) -> DataFrame:
    """Why each non-winner lost, read off the score terms both sides carry."""
    win = chosen.filter("candidate_id is not null").select("address_id", F.col("candidate_id").alias("wid"))
    x = ranked.join(win, "address_id").withColumn("w", F.get(F.filter("ranked", lambda r: r["candidate_id"] == F.col("wid")), F.lit(0)))
    l = x.select("address_id", "wid", "w", F.explode("ranked").alias("r")).filter("r.candidate_id <> wid")
    has = lambda side, name: F.exists(f"{side}.terms", lambda t: t["name"] == name)

    def prior(side):
        return F.get(F.filter(f"{side}.terms", lambda t: t["name"].startswith("arm_prior:")), F.lit(0))["value"]

    def gran(side):
        out = F.lit(0.25)
        for k, val in policy.GRANULARITY_RANK.items():
            out = F.when(F.col(f"{side}.c.granularity") == k, F.lit(val)).otherwise(out)
        return out

    def only(name, label):
        return F.when(has("r", name), F.lit(label))

    reasons = F.array_compact(F.array(
        F.when(prior("r") < prior("w"), F.lit("lower_arm_prior")),
        F.when(gran("r") < gran("w"), F.lit("coarser_granularity")),
        F.when(has("w", "evidence_promotion_eligible") & ~has("r", "evidence_promotion_eligible"), F.lit("no_promotion_credit")),
        F.when(~F.coalesce("r.c.primary_eligible", F.lit(True)), F.lit("single_observation_not_primary_eligible")),
        F.when(has("w", "locality_match") & ~has("r", "locality_match"), F.lit("locality_name_mismatch")),
        only("pin_unknown_penalty", "pin_unknown_penalty"), only("outside_town_penalty", "outside_town_penalty"),
        only("landmark_ambiguous_penalty", "landmark_ambiguous"), only("coarse_precision_penalty", "coarse_precision_penalty")))
    return l.select("address_id", "r.candidate_id", F.round(F.col("w.score") - F.col("r.score"), 6).alias("margin"),
                    F.array_join(reasons, "+").alias("lost_reasons"))
