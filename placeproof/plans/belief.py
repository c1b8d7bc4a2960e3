"""Belief per address as of an instant: tier, status, radius, support."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeproof import policy
from placeproof.functions import geo, times
from placeproof.functions.digest import candidate_id
from placeproof.operators.asof import known_before, latest_before
from placeproof.plans import candidates as cand
from placeproof.plans import evidence, ranking
from placeproof.policy import BASE, Policy
from placeproof.sources.stages import stage, together


def published(stratum: Column) -> Column:
    """The stratum whose radius is shown: its own where publishable with enough calibration rows, else the fallback."""
    own = [s for s, r, n, _, ok in policy.RADIUS_TABLE if ok and r is not None and n >= policy.RADIUS_MIN_N]
    return F.when(stratum.isin(own), stratum).otherwise(F.lit(policy.FALLBACK_STRATUM))


def radius_entry(stratum: Column, field: int) -> Column:
    """A column of the radius table for the published stratum (1 radius, 2 calibration rows, 3 measured coverage)."""
    out = F.lit(None)
    for row in policy.RADIUS_TABLE:
        out = F.when(published(stratum) == row[0], F.lit(row[field])).otherwise(out)
    return out


def radius(tier: Column, n_neg: Column, stale: Column, stratum: Column) -> Column:
    """Radius of the published stratum times the widening factors."""
    factor = F.when(tier == "PROBABLE", 1.25).when(tier == "APPROXIMATE", 1.5).otherwise(1.0)
    neg = F.least(F.lit(1.5), 1.0 + 0.05 * n_neg) * F.when(n_neg >= 2, 1.35).otherwise(1.0)
    factor = F.when(n_neg >= 1, factor * neg).otherwise(factor)
    factor = F.when(stale, factor * 1.2).otherwise(factor)
    return F.when(tier != "UNPLACEABLE", F.round(radius_entry(stratum, 1) * factor, 1))


def widen_reason(stratum: Column, tier: Column, n_neg: Column, stale: Column) -> Column:
    return F.when(tier != "UNPLACEABLE", F.when(n_neg >= 1, "negative_accumulation")
                  .when(stale, "stale_pack").when(stratum != "locality", "calibration_fallback"))


def with_primary(ranked: DataFrame) -> DataFrame:
    """Primary candidate: best ranked that may be primary, else best ranked."""
    ok = F.filter("ranked", lambda r: F.coalesce(r["c"]["primary_eligible"], F.lit(True)))
    return ranked.withColumn("p", F.coalesce(F.get(ok, F.lit(0)), F.get("ranked", F.lit(0)))) \
        .withColumn("top_granularity", F.get("ranked", F.lit(0))["c"]["granularity"])


def support(ev: DataFrame, tops: DataFrame, as_of: str, p: Policy = BASE) -> DataFrame:
    """All log-derived numbers of a belief in one aggregate per address, plus the strong spread."""
    at = F.lit(as_of).cast("timestamp")
    gran = F.coalesce("top_granularity", F.lit("locality"))
    pos = (F.col("polarity") == "positive") & (F.col("weight") >= p.w_min)
    neg = F.col("polarity") == "negative"
    strong = pos & (F.col("weight") >= p.w_promote)
    e = ev.join(tops, "address_id", "left").withColumn("w_eff", F.when(pos, F.round(
        F.col("weight") * times.recency_factor(F.col("observed_at"), at, gran), 6)))
    cut = F.lit(p.period_cut).cast("date")
    on = lambda c: F.when(strong, F.col(c))
    a = e.groupBy("address_id").agg(
        F.count("*").alias("n_obs"), F.count_if(pos).alias("n_pos"),
        F.count_if(strong).alias("n_strong"),
        F.count_if(F.col("w_eff") >= p.w_promote).alias("n_strong_eff"),
        F.count_if((F.col("w_eff") >= p.w_min) & (F.col("w_eff") < p.w_promote))
        .alias("n_weak_eff"),
        F.round(F.sum("w_eff"), 6).alias("positive_weight_sum"),
        F.max(F.when(pos, F.col("observed_at"))).alias("newest_pos"),
        F.count_distinct(F.when(neg, F.struct("agent_id", "period", "media"))).alias("n_neg"),
        F.count_distinct(on("agent_id")).alias("n_collectors"),
        F.count_distinct(on("period")).alias("n_periods"),
        F.count_distinct(on("media")).alias("n_media"), F.count(on("media")).alias("n_with_media"),
        F.min(on("day")).alias("first_day"), F.max(on("day")).alias("last_day"),
        F.percentile(on("x"), 0.5).alias("mx"), F.percentile(on("y"), 0.5).alias("my"),
        F.count(on("x")).alias("n_xy"))
    far = (ev.filter(strong).join(a.select("address_id", "mx", "my"), "address_id")
           .groupBy("address_id").agg(F.max(geo.distance(
               F.col("x"), F.col("y"), F.col("mx"), F.col("my"))).alias("far")))
    period_ok = ((F.col("n_periods") >= 2)
                 | ((F.col("first_day") < cut) & (F.col("last_day") >= cut))
                 | (F.datediff("last_day", "first_day") >= p.period_gap_days))
    media_ok = ((F.col("n_strong") >= 2) & (F.col("n_with_media") == F.col("n_strong"))
                & (F.col("n_media") == F.col("n_strong")))
    return (a.join(far, "address_id", "left")
            .withColumn("promoted", F.coalesce((F.col("n_strong") >= 2) & (
                (F.col("n_collectors") >= 2) | period_ok) & media_ok, F.lit(False)))
            .withColumn("spread", F.when((F.col("n_xy") == F.col("n_strong"))
                                         & (F.col("n_strong") >= 2), F.col("far"))))


def decide(ranked: DataFrame, ev: DataFrame, as_of: str, p: Policy = BASE) -> DataFrame:
    """One belief row per address that has a candidate set or an observation."""
    prim = with_primary(ranked)
    s = support(ev, prim.select("address_id", "top_granularity"), as_of, p)
    at = F.lit(as_of).cast("timestamp")
    d = prim.join(s, "address_id", "left")
    for c in ("n_obs", "n_pos", "n_strong", "n_strong_eff", "n_weak_eff", "n_neg"):
        d = d.withColumn(c, F.coalesce(c, F.lit(0)).cast("long"))
    d = (d.withColumn("promoted", F.coalesce("promoted", F.lit(False)))
         .withColumn("positive_weight_sum", F.coalesce("positive_weight_sum", F.lit(0.0))))
    stratum = F.coalesce("p.c.stratum", "p.c.granularity", F.lit("locality"))
    base_r = F.round(radius_entry(stratum, 1) * 1.5, 1)
    contested = F.coalesce(F.col("spread") > p.contest_multiple * base_r, F.lit(False))
    fine = F.col("p.c.granularity").isin("street", "rooftop")
    tier = (F.when(F.col("p").isNull(), "UNPLACEABLE").when(F.col("contested"), "APPROXIMATE")
            .when(F.col("promoted"), "CONFIRMED").when(F.col("n_strong_eff") >= 1, "PROBABLE")
            .when(F.col("n_weak_eff") >= 2, "PROBABLE")
            .when(fine & (F.col("p.c.agreement_arms") > 0), "PROBABLE").otherwise("APPROXIMATE"))
    tier_reason = (
        F.when(F.col("p").isNull(), "no_candidate").when(F.col("contested"), "contested_supports")
        .when(F.col("promoted"), F.concat(F.lit("field_confirmed_x"),
                                          F.greatest("n_strong_eff", F.lit(2))))
        .when(F.col("n_strong_eff") >= 1, "field_confirmed_x1")
        .when(F.col("n_weak_eff") >= 2, "weak_positives_x2")
        .when(fine & (F.col("p.c.agreement_arms") > 0), "fine_pin_with_cross_arm_agreement")
        .when(F.col("p.c.granularity") == "town", "town_anchor_only")
        .otherwise("cold_start_no_field_evidence"))
    capped = (F.col("n_neg") >= p.negatives_min) & F.col("tier0").isin("CONFIRMED", "PROBABLE")
    stale = (~F.col("contested") & (F.col("n_neg") < p.negatives_min)
             & F.coalesce(times.age_days(F.col("newest_pos"), at) > p.stale_days, F.lit(False)))
    d = (d.withColumn("contested", contested).withColumn("tier0", tier)
         .withColumn("tier", F.when(capped, "APPROXIMATE").otherwise(F.col("tier0")))
         .withColumn("stale", stale & F.col("newest_pos").isNotNull())
         .withColumn("status", F.when(F.col("contested"), "CONTESTED")
                     .when(F.col("n_neg") >= p.negatives_min, "MOVED_SUSPECTED")
                     .when(F.col("stale"), "STALE").otherwise("STABLE")))
    return d.select(
        "address_id", "town_id", at.alias("as_of"),
        (F.col("n_obs") + 1).alias("belief_version"),
        F.col("p.candidate_id").alias("candidate_id"), F.col("p.c.arm").alias("arm"),
        F.col("p.c.x").alias("x"), F.col("p.c.y").alias("y"),
        F.col("p.c.granularity").alias("granularity"), stratum.alias("stratum"),
        F.col("p.c.primary_eligible").alias("primary_eligible"),
        F.col("p.score").alias("score"), "tier", "status",
        radius(F.col("tier"), F.col("n_neg"), F.col("stale"), stratum).alias("radius_m"),
        widen_reason(stratum, F.col("tier"), F.col("n_neg"), F.col("stale"))
        .alias("widen_reason"),
        tier_reason.alias("tier_reason"), capped.alias("negative_cap"), "promoted", "contested",
        F.round("spread", 1).alias("spread_m"), "n_obs", "n_pos", "n_strong", "n_neg",
        "positive_weight_sum", "newest_pos", "ranked")


def memory_arm(prior: DataFrame, as_of: str, own: Column | None = None) -> DataFrame:
    """Prior belief as a candidate, only where it rests on accumulated field evidence (own: see `candidate_sets`)."""
    named = F.col("address_id") if own is None else own
    m = prior.filter(F.col("arm") == "field_evidence")
    return cand._arm(m, "memory", F.concat(F.lit("memory:"), named, F.lit("@v"),
                                           "belief_version"), F.col("x"), F.col("y"),
                     F.col("granularity"), F.col("stratum"),
                     eligible=F.col("tier").isin("CONFIRMED", "PROBABLE"),
                     valid=F.lit(as_of))


REMEMBERED = ["candidate_id", "arm", "x", "y", "granularity", "stratum", "tier", "belief_version"]


def stored_memory(points: DataFrame, versions: DataFrame, prior: DataFrame, rules: str = policy.RULES_VERSION) -> DataFrame:
    """Memory arm at points (address_id, as_of) from stored belief versions (with rules_version), as an as-of join.

    The newest version strictly before the instant counts, of the given rules only.  Where there is none, or it has no candidate, the
    belief computed without memory (`prior`, one row per address) stands in; a version that rests on a static arm gives no memory.
    """
    own = versions.filter(F.col("rules_version") == rules).withColumnRenamed("as_of", "stored_at")
    last = latest_before(points.select("address_id", "as_of"), own, ["address_id"], "as_of", "stored_at", [*REMEMBERED, "stored_at"], ["belief_version"], bucket="month")
    now = prior.select("address_id", F.struct(*REMEMBERED).alias("now"))
    used = F.when(F.col("candidate_id").isNotNull(), F.struct(*REMEMBERED)).otherwise(F.col("now"))
    rows = last.join(now, "address_id", "left").select("address_id", "as_of", F.coalesce("stored_at", "as_of").alias("valid"), used.alias("m")).select("address_id", "as_of", "valid", "m.*")
    kept = rows.filter(F.col("candidate_id").isNotNull() & (F.col("arm") == "field_evidence"))
    return cand._arm(kept, "memory", F.concat(F.lit("memory:"), "address_id", F.lit("@v"), "belief_version"), F.col("x"), F.col("y"), F.col("granularity"), F.col("stratum"),
                     eligible=F.col("tier").isin("CONFIRMED", "PROBABLE"), valid=F.col("valid"))


def add_arm(sets: DataFrame, arm: DataFrame, p: Policy = BASE, own: Column | None = None, how: str = "left") -> DataFrame:
    """Adds one more single-candidate arm to finished sets and renews the agreement counts of those that get one (how: "inner" returns only these)."""
    a = (arm.withColumn("candidate_id", candidate_id(F.col("arm"), F.col("address_id") if own is None else own,
                                                     F.col("source_ref")))
         .withColumn("arm_index", cand.arm_index(F.col("arm")))
         .withColumn("agreement_arms", F.lit(0)).withColumn("f_agreement_count", F.lit(0)))
    item = sets.schema["cands"].dataType.elementType
    one = a.select("address_id", F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name)
                                                 for f in item])
                   .alias("extra"))
    j = sets.join(one, "address_id", how).withColumn("cands", F.when(
        F.col("extra").isNull(), F.col("cands")).otherwise(
        F.array_append("cands", F.col("extra"))))
    return j.select("address_id", F.when(F.col("extra").isNull(), F.col("cands")).otherwise(cand.agreement(p)).alias("cands"))


def _on_evidence(arm: Column) -> Column:
    """Whether a first-pass belief gives a memory candidate: its primary candidate is field evidence."""
    return F.coalesce(arm == "field_evidence", F.lit(False))


def remembered_sets(sets: DataFrame, prior: DataFrame, as_of: str, p: Policy = BASE) -> DataFrame:
    """The sets that the memory arm adds to, with it; only sets with field evidence can be among them, so the others are not shuffled."""
    held = sets.filter(F.exists("cands", lambda c: c["arm"] == "field_evidence"))
    return add_arm(held, memory_arm(prior, as_of), p, how="inner")


def renewed(prior: DataFrame, again: DataFrame, ev: DataFrame, as_of: str, p: Policy = BASE) -> DataFrame:
    """Beliefs after the pass with memory: decided again where memory added a candidate, else those of the first pass, whose sets are the same."""
    return prior.filter(~_on_evidence(F.col("arm"))).unionByName(decide(again, ev, as_of, p))


def evidence_stage(v) -> DataFrame:
    return stage(v, "evidence", lambda: evidence.scored_view(v))


def prepared_stage(v) -> DataFrame:
    """Addresses with normal form, tokens and pin: the text work of every arm, done once."""
    return stage(v, "prepared_addresses", lambda: cand.prepared_addresses(v.address()))


def features_stage(v) -> DataFrame:
    return stage(v, "address_features", lambda: ranking.address_features(prepared_stage(v), v.locality()))


def static_stage(v) -> DataFrame:
    return stage(v, "static_arms", lambda: cand.static_union(v, addr=prepared_stage(v)))


def inputs(v) -> None:
    """Everything a belief starts from; the three stages do not depend on each other."""
    prepared_stage(v)
    together(v.spark, [lambda: evidence_stage(v), lambda: static_stage(v), lambda: features_stage(v)])


def bare_sets(v, as_of: str, p: Policy = BASE) -> DataFrame:
    """Candidate sets of the static and field-evidence arms at a cut."""
    def build():
        inputs(v)
        ev = known_before(evidence_stage(v), as_of)
        return cand.with_agreement(cand.candidate_sets(
            static_stage(v).unionByName(cand.field_evidence(ev, p)), p), p)
    return stage(v, f"bare_sets|{as_of}|{p}", build)


def bare_ranked(v, as_of: str, p: Policy = BASE) -> DataFrame:
    return stage(v, f"bare_ranked|{as_of}|{p}", lambda: ranking.ranked_sets(
        bare_sets(v, as_of, p), features_stage(v)))


def prior_at(v, as_of: str, p: Policy = BASE) -> DataFrame:
    """Belief computed without the memory arm."""
    return stage(v, f"prior|{as_of}|{p}", lambda: decide(
        bare_ranked(v, as_of, p), known_before(evidence_stage(v), as_of), as_of, p))


def full_sets(v, as_of: str, p: Policy = BASE) -> DataFrame:
    return stage(v, f"sets|{as_of}|{p}", lambda: add_arm(
        bare_sets(v, as_of, p), memory_arm(prior_at(v, as_of, p), as_of), p))


def ranked_again(v, as_of: str, p: Policy = BASE) -> DataFrame:
    """Ranked sets of the addresses to which the memory arm adds a candidate."""
    return stage(v, f"ranked_again|{as_of}|{p}", lambda: ranking.ranked_sets(
        remembered_sets(bare_sets(v, as_of, p), prior_at(v, as_of, p), as_of, p), features_stage(v), "inner"))


def ranked_at(v, as_of: str, p: Policy = BASE) -> DataFrame:
    """Ranked sets with the memory arm: those of the first pass, but for the addresses ranked again."""
    first = bare_ranked(v, as_of, p)
    same = with_primary(first).filter(~_on_evidence(F.col("p.c.arm"))).select(*first.columns)
    return same.unionByName(ranked_again(v, as_of, p))


def belief_at(v, as_of: str, p: Policy = BASE) -> DataFrame:
    """Whole-book belief at a cut: a prior pass without memory, then a pass with it over the addresses that it gives a candidate."""
    return stage(v, f"belief|{as_of}|{p}", lambda: renewed(
        prior_at(v, as_of, p), ranked_again(v, as_of, p), known_before(evidence_stage(v), as_of), as_of, p))


def belief_from_log(v, ev: DataFrame, as_of: str, name: str, p: Policy = BASE) -> DataFrame:
    """The same two passes over any evidence log (what-if rows included), as stages named by log, cut and policy."""
    name = f"{name}|{as_of}|{p}"
    known = known_before(ev, as_of)
    sets = stage(v, f"{name}|sets0", lambda: cand.with_agreement(cand.candidate_sets(
        static_stage(v).unionByName(cand.field_evidence(known, p)), p), p))
    r0 = stage(v, f"{name}|ranked0", lambda: ranking.ranked_sets(sets, features_stage(v)))
    prior = stage(v, f"{name}|prior", lambda: decide(r0, known, as_of, p))
    r1 = stage(v, f"{name}|ranked", lambda: ranking.ranked_sets(
        remembered_sets(sets, prior, as_of, p), features_stage(v), "inner"))
    return stage(v, f"{name}|belief", lambda: renewed(prior, r1, known, as_of, p))


FLAT = ["address_id", "town_id", "as_of", "belief_version", "candidate_id", "arm", "x", "y",
        "granularity", "stratum", "score", "tier", "status", "radius_m", "widen_reason",
        "tier_reason", "negative_cap", "promoted", "contested", "spread_m", "n_obs", "n_pos",
        "n_strong", "n_neg", "positive_weight_sum"]
