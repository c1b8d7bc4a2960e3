"""Evidence: validated observations to weights with reason codes, promotion and proxy labels."""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeproof import policy
from placeproof.functions import geo, times
from placeproof.policy import BASE, Policy


def base_weight(outcome: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, w in policy.OUTCOME_BASE.items():
        out = F.when(outcome == name, F.lit(w)).otherwise(out)
    return out


def validate(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantine).  Derives class, polarity and the time fallback chain."""
    at = F.coalesce("observed_at", "checkin_ts", "captured_at_device")
    neg = F.col("outcome").isin(policy.NEGATIVE_OUTCOMES)
    amb = F.col("outcome").isin(policy.AMBIGUOUS_OUTCOMES)
    blank = lambda c: F.col(c).isNull() | (F.col(c).cast("string") == "")
    reason = (F.when(blank("kind"), "missing_kind").when(blank("address_id"), "missing_address_id")
              .when(blank("outcome"), "missing_outcome").when(blank("agent_id"), "missing_agent_id")
              .when(~F.col("outcome").isin(list(policy.OUTCOME_BASE)), "unknown_outcome")
              .when(~F.col("kind").isin(policy.OBSERVATION_KINDS), "unknown_kind")
              .when(at.isNull(), "missing_timestamp")
              .when(neg & F.col("x").isNotNull() & F.coalesce("coordinate_claim", F.lit(False)),
                    "negative_coordinate_claim"))
    tagged = (raw.withColumn("reject_reason", reason).withColumn("observed_at", at)
              .withColumn("evidence_class", F.when(neg, "process").when(amb, "ambiguous")
                          .otherwise("positive"))
              .withColumn("polarity", F.when(neg, "negative").when(amb, "ambiguous")
                          .otherwise("positive")))
    return (tagged.filter("reject_reason is null").drop("reject_reason"),
            tagged.filter("reject_reason is not null"))


def duplicate_media(obs: DataFrame) -> DataFrame:
    """Media hashes seen on more than one observation of the whole table (bulk rule)."""
    return (obs.filter("media is not null").groupBy("media").agg(F.count("*").alias("n_rows"))
            .filter("n_rows > 1"))


def media_seen_before(obs: DataFrame) -> DataFrame:
    """(observation_id, seen_before): whether an earlier observation carried the same hash.

    The as-of-safe form of `duplicate_media`: it looks at nothing later than the observation itself.
    """
    first = obs.filter("media is not null").groupBy("media").agg(F.min("observed_at").alias("first_at"))
    return (obs.filter("media is not null").join(first, "media")
            .select("observation_id", (F.col("observed_at") > F.col("first_at")).alias("seen_before")))


def duplicate_claims(obs: DataFrame) -> DataFrame:
    """Each observation whose hash another observation at the same address already carries.

    The earliest other row (time, id) is the one linked.  Only the two earliest rows per (address,
    hash) can be that row, so two mergeable minima replace a self-join.
    """
    has = obs.filter("media is not null")
    key = F.struct("observed_at", "observation_id")
    first = has.groupBy("address_id", "media").agg(
        F.min(key).alias("k1"), F.count("*").alias("n")).filter("n > 1")
    second = (has.join(first.select("address_id", "media", "k1"), ["address_id", "media"])
              .filter(key > F.col("k1")).groupBy("address_id", "media").agg(F.min(key).alias("k2")))
    ends = first.join(second, ["address_id", "media"])
    return (has.join(ends, ["address_id", "media"])
            .select("observation_id", F.when(key == F.col("k1"), F.col("k2.observation_id"))
                    .otherwise(F.col("k1.observation_id")).alias("duplicate_claim_of")))


def _factor(conds: list[tuple[Column, float]], default: float = 1.0) -> Column:
    out = F.lit(default)
    for cond, f in reversed(conds):
        out = F.when(cond, F.lit(f)).otherwise(out)
    return out


def score(obs: DataFrame, agent_rate: DataFrame | None = None) -> DataFrame:
    """Adds `weight`, `reason_codes` (sorted) and the independence fields.

    Bulk rule: duplicate hashes come from the whole table.  With `agent_rate` (observation_id, rate)
    the collector factor of the live rule applies too.
    """
    dup = duplicate_media(obs).select(F.col("media"), F.lit(True).alias("media_dup"))
    df = obs.join(dup, "media", "left")
    if agent_rate is not None:
        df = df.join(agent_rate.select("observation_id", "rate"), "observation_id", "left")
    return score_columns(df, with_rate=agent_rate is not None)


def score_columns(df: DataFrame, with_rate: bool = False) -> DataFrame:
    """The stateless part of the scorer (also used on streams); needs `media_dup`."""
    base = base_weight(F.col("outcome"))
    dwell, acc, agree = F.col("dwell_s"), F.col("gps_accuracy_m"), F.col("trail_agreement_m")
    hour = times.local_hour(F.col("observed_at"))
    claim = F.col("duplicate_claim_of") if "duplicate_claim_of" in df.columns else F.lit(None)
    dup = F.coalesce("media_dup", F.lit(False))
    off = ~((hour >= 8) & (hour < 19))
    w = base
    w = w * _factor([(dwell < 60, 0.5), (dwell < 180, 0.8)])
    w = w * _factor([(dwell > 7200, 0.7)])
    w = w * _factor([(acc.isNull(), 0.9), (acc <= 15, 1.0), (acc <= 30, 0.9), (acc <= 50, 0.75)],
                    0.5)
    w = w * _factor([(agree.isNull(), 1.0), (agree <= 50, 1.0), (agree <= 150, 0.85)], 0.6)
    w = w * _factor([(F.col("media").isNull(), 0.85), (dup, 0.4)])
    w = w * _factor([(off, 0.7)])
    if with_rate:
        w = w * _factor([(F.col("rate") > 0.40, 0.9)])
    w = w * _factor([(claim.isNotNull(), 0.0)])
    weight = F.when(base == 0.0, F.lit(0.0)).otherwise(F.round(F.least(F.greatest(
        w, F.lit(0.0)), F.lit(1.0)), 6))

    def code(cond, name):
        return F.when(cond, F.lit(name))

    codes = [
        code(dwell < 60, "dwell_short"), code((dwell >= 60) & (dwell < 180), "dwell_brief"),
        code(dwell > 7200, "dwell_implausible"), code(acc.isNull(), "gps_unknown"),
        code(acc <= 15, "gps_fine"), code((acc > 15) & (acc <= 30), "gps_moderate"),
        code((acc > 30) & (acc <= 50), "gps_coarse"), code(acc > 50, "gps_very_coarse"),
        code(agree <= 50, "trail_agrees"), code((agree > 50) & (agree <= 150), "trail_loose"),
        code(agree > 150, "trail_disagreement"), code(F.col("media").isNull(), "no_media"),
        code(F.col("media").isNotNull() & dup, "duplicate_media_cluster"),
        code(F.col("media").isNotNull() & ~dup, "media_present"),
        code(off, "off_hours"), code(~off, "business_hours"),
        code(claim.isNotNull(), "linked_duplicate_claim"),
    ]
    if with_rate:
        codes += [code(F.col("rate") > 0.40, "agent_negative_rate_high"),
                  code(F.col("rate") < 0.20, "agent_negative_rate_low")]
    label = F.concat(F.lit("outcome:"), "outcome")
    reasons = F.when(base == 0.0, F.array(label, F.lit("negative_no_coordinate_claim"))).otherwise(
        F.array_sort(F.array_compact(F.array(label, *codes))))
    return (df.withColumn("weight", weight).withColumn("reason_codes", reasons)
            .withColumn("period", F.date_format("observed_at", "yyyy-MM"))
            .withColumn("day", F.to_date("observed_at")))


def scored_view(v, agent_rate: bool = False) -> DataFrame:
    return score(v.observation())


def promotion(ev: DataFrame, keys: list[str], p: Policy = BASE) -> DataFrame:
    """Independence test over the strong positives of each key, as one mergeable aggregate.

    Adds the strong median position and count; spread needs the median and is joined by the caller.
    """
    s = ev.filter((F.col("polarity") == "positive") & (F.col("weight") >= p.w_promote))
    cut = F.lit(p.period_cut).cast("date")
    agg = s.groupBy(*keys).agg(
        F.count("*").alias("n_strong"),
        F.count_distinct("agent_id").alias("n_collectors"),
        F.count_distinct("period").alias("n_periods"),
        F.count_distinct("media").alias("n_media"),
        F.count("media").alias("n_with_media"),
        F.min("day").alias("first_day"), F.max("day").alias("last_day"),
        F.percentile("x", 0.5).alias("mx"), F.percentile("y", 0.5).alias("my"),
        F.count("x").alias("n_xy"), F.percentile("gps_accuracy_m", 0.5).alias("acc_med"),
        F.max("observed_at").alias("last_strong_at"))
    period_ok = ((F.col("n_periods") >= 2)
                 | ((F.col("first_day") < cut) & (F.col("last_day") >= cut))
                 | (F.datediff("last_day", "first_day") >= p.period_gap_days))
    media_ok = ((F.col("n_strong") >= 2) & (F.col("n_with_media") == F.col("n_strong"))
                & (F.col("n_media") == F.col("n_strong")))
    return (agg.withColumn("period_ok", period_ok).withColumn("media_ok", media_ok)
            .withColumn("promoted", (F.col("n_strong") >= 2)
                        & ((F.col("n_collectors") >= 2) | F.col("period_ok")) & F.col("media_ok")))


def with_spread(ev: DataFrame, promo: DataFrame, keys: list[str], p: Policy = BASE) -> DataFrame:
    """Joins the largest distance of a strong positive from the strong median (null if any lacks xy)."""
    s = ev.filter((F.col("polarity") == "positive") & (F.col("weight") >= p.w_promote))
    far = (s.join(promo.select(*keys, "mx", "my"), keys)
           .groupBy(*keys).agg(F.max(geo.distance(F.col("x"), F.col("y"), F.col("mx"), F.col("my")))
                               .alias("far")))
    ok = (F.col("n_xy") == F.col("n_strong")) & (F.col("n_strong") >= 2)
    return promo.join(far, keys, "left").withColumn("spread", F.when(ok, F.col("far"))).drop("far")


def proxy_label(ev: DataFrame, p: Policy = BASE) -> DataFrame:
    """Median of at least two strong positives per address: the operational proxy label."""
    return (ev.filter((F.col("polarity") == "positive") & (F.col("weight") >= p.w_promote)
                      & F.col("x").isNotNull())
            .groupBy("address_id")
            .agg(F.percentile("x", 0.5).alias("lx"), F.percentile("y", 0.5).alias("ly"),
                 F.count("*").alias("n_label")).filter("n_label >= 2"))
