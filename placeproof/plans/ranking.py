"""Features and the additive rule score."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeproof import policy
from placeproof.functions import geo, text
from placeproof.operators.nearest_name import best_by_edits, best_by_tokens
from placeproof.session import checkpoint


def _lookup(table: dict, key: Column, default: float) -> Column:
    out = F.lit(default)
    for k, x in table.items():
        out = F.when(key == k, F.lit(x)).otherwise(out)
    return out


def address_features(addr: DataFrame, loc: DataFrame) -> DataFrame:
    """Per address: best locality name by token Jaccard, its 3-gram Jaccard, best edit similarity.

    Equal texts of a town are matched once; names are met through their tokens and lengths (see `operators.nearest_name`).
    """
    names = loc.select("town_id", text.norm_text(F.col("locality_name")).alias("name")).distinct().withColumn(
        "toks", F.array_distinct(text.tokens(F.col("name"))))
    towns = loc.groupBy("town_id").agg(F.avg("cx").alias("tcx"), F.avg("cy").alias("tcy"))
    pins = loc.select("town_id", F.col("pincode").alias("pin_text")).distinct().withColumn("known", F.lit(True))
    texts = addr.select("town_id", F.col("norm").alias("text"), F.array_distinct("toks").alias("toks")).distinct()
    # few bytes, much work per row: dealt out by number, as small shuffles would be merged into a few tasks
    parts = int(addr.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    flat = [F.replace(c, F.lit(" "), F.lit("")).alias(f"flat_{c}") for c in ("text", "name")]
    best = checkpoint(best_by_tokens(texts, names).repartition(parts, "town_id", "text").select("*", *flat))
    edits = best_by_edits(best.select("town_id", "text", F.col("name").alias("guess")), names.select("town_id", "name"))
    # grams of stored columns: what a lambda holds is worked out again for each of its elements
    grams = [text.flat_ngrams(F.col(f"flat_{c}")) for c in ("text", "name")]
    inter = F.size(F.array_intersect(*grams))
    union = F.size(grams[0]) + F.size(grams[1]) - inter
    char3 = F.round(F.when(union > 0, inter / union).otherwise(0.0), 4)
    matched = best.select("town_id", "text", "j", char3.alias("char3")).join(edits, ["town_id", "text"]).withColumnRenamed("text", "norm")
    base = (addr.join(matched, ["town_id", "norm"], "left").join(towns, "town_id", "left").join(pins, ["town_id", "pin_text"], "left"))
    raw, pin, j = F.col("address_text"), F.col("pin_text"), F.coalesce(F.col("j"), F.lit(0.0))
    return base.select(
        "address_id", "town_id", "tcx", "tcy",
        (j > 0).cast("int").alias("f_locality_name_matched"),
        pin.isNotNull().cast("int").alias("f_pin_in_text"),
        (pin.isNotNull() & F.col("known").isNull()).cast("int").alias("f_pin_unknown"),
        (~raw.rlike(r"\d")).cast("int").alias("f_no_digit"),
        (~raw.contains(",")).cast("int").alias("f_no_separator"),
        (F.col("town_id") == "OUT").cast("int").alias("f_outside_town"),
        F.round(j, 4).alias("f_sim_jaccard"),
        F.coalesce("char3", F.lit(0.0)).alias("f_sim_char3"),
        F.round(F.coalesce("ratio", F.lit(0.0)), 4).alias("f_sim_ratio"))


FEATURES = ["f_arm_prior", "f_granularity_rank", "f_locality_name_matched", "f_pin_in_text",
            "f_pin_unknown", "f_no_digit", "f_no_separator", "f_outside_town",
            "f_baseline_stratum", "f_sim_jaccard", "f_sim_char3", "f_sim_ratio", "f_n_candidates",
            "f_agreement_count", "f_dist_to_town_centroid_m"]


def score_terms(c, a) -> list[tuple[Column, Column]]:
    """(name, value) of each additive term; a null value means the term does not apply."""
    gran = _lookup(policy.GRANULARITY_RANK, c["granularity"], 0.25)
    agree = c["f_agreement_count"]
    base = c["arm"] == "frozen_baseline"
    prec = c["baseline_precision"]
    return [
        (F.concat(F.lit("arm_prior:"), c["arm"]), _lookup(policy.ARM_PRIOR, c["arm"], 0.20)),
        (F.concat(F.lit("granularity:"), c["granularity"]), F.lit(0.12) * gran),
        (F.lit("coarse_precision_penalty"), F.when(base & prec.isin("locality", "pincode"), -0.06)),
        (F.lit("fine_precision_bonus"), F.when(base & (prec == "rooftop"), 0.04)),
        (F.lit("evidence_promotion_eligible"), F.when(c["primary_eligible"], 0.08)),
        (F.lit("landmark_ambiguous_penalty"), F.when(c["ambiguous"], -0.08)),
        (F.lit("locality_match"), F.when(a["f_locality_name_matched"] == 1, 0.05)),
        (F.lit("pin_in_text_known"), F.when((a["f_pin_in_text"] == 1) & (a["f_pin_unknown"] == 0),
                                            0.04)),
        (F.lit("pin_unknown_penalty"), F.when(a["f_pin_unknown"] == 1, -0.05)),
        (F.lit("no_house_number"), F.when(a["f_no_digit"] == 1, -0.03)),
        (F.lit("outside_town_penalty"), F.when(a["f_outside_town"] == 1, -0.20)),
        (F.lit("text_locality_similarity"), F.round(F.lit(0.05) * a["f_sim_jaccard"], 6)),
        (F.lit("text_char_similarity"), F.round(F.lit(0.03) * a["f_sim_char3"], 6)),
        (F.concat(F.lit("arm_agreement_x"), agree.cast("string")),
         F.when(agree > 0, F.round(F.lit(0.04) * F.least(agree, F.lit(3)), 6))),
    ]


def ranked_sets(sets: DataFrame, feats: DataFrame, how: str = "left") -> DataFrame:
    """(address_id, cands) with scores, terms and features; order: score desc, candidate id.

    how: "left" keeps an address without candidates, unplaceable; "inner" ranks the given sets only.
    """
    s = feats.join(sets, "address_id", how)
    a = {c: F.col(c) for c in feats.columns}

    def termed(c):
        return F.struct(c.alias("c"), F.array(*[F.struct(n.alias("name"), val.cast("double").alias("value"))
                                                for n, val in score_terms(c, a)]).alias("terms"))

    def summed(r):
        total = F.aggregate(r["terms"], F.lit(0.0), lambda t, x: t + F.coalesce(x["value"], F.lit(0.0)))
        return F.struct(r["c"].alias("c"), r["terms"].alias("terms"), F.round(total, 6).alias("score"))

    def scored(r):
        c, score = r["c"], r["score"]
        listed = F.filter(r["terms"], lambda t: t["value"].isNotNull() & (F.abs(t["value"]) > 1e-9))
        return F.struct(
            (-score).alias("neg_score"), c["candidate_id"].alias("candidate_id"),
            score.alias("score"), listed.alias("terms"),
            F.round(geo.distance(c["x"], c["y"], F.col("tcx"), F.col("tcy")), 1)
            .alias("f_dist_to_town_centroid_m"), c.alias("c"))

    # three steps, each bound by the next one: terms and score are worked out once per candidate
    ranked = F.transform(F.transform(F.transform("cands", termed), summed), scored)
    return s.select("address_id", *[c for c in feats.columns if c != "address_id"],
                    F.coalesce(F.size("cands"), F.lit(0)).alias("f_n_candidates"),
                    F.array_sort(ranked).alias("ranked"))


def exploded(ranked: DataFrame) -> DataFrame:
    """One row per ranked candidate."""
    own = [c for c in ranked.columns if c.startswith("f_")]
    return (ranked.select("address_id", "town_id", *own, F.posexplode("ranked").alias("pos", "r"))
            .select("address_id", "town_id", *own, (F.col("pos") + 1).alias("rank"), "r.score",
                    "r.terms", "r.f_dist_to_town_centroid_m", "r.c.*")
            .withColumn("f_arm_prior", _lookup(policy.ARM_PRIOR, F.col("arm"), 0.20))
            .withColumn("f_granularity_rank",
                        _lookup(policy.GRANULARITY_RANK, F.col("granularity"), 0.25))
            .withColumn("f_baseline_stratum", F.col("stratum")))
