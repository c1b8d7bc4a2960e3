"""Histories, audits and geometry over belief versions."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from placeproof.catalog import query
from placeproof.catalog.domain import MEMBER, decided, members
from placeproof.catalog.oracle_domain import AS_OF, EARLY
from placeproof.operators.asof import known_before
from placeproof.operators.profile import union_all
from placeproof.plans import belief, decision, history, ranking

CHANGED = ("concat_ws('+', CASE WHEN b.tier IS DISTINCT FROM a.tier THEN 'tier' END, CASE WHEN b.status IS DISTINCT FROM a.status THEN 'status' END, "
           "CASE WHEN b.candidate_id IS DISTINCT FROM a.candidate_id THEN 'candidate_id' END, CASE WHEN b.radius_m IS DISTINCT FROM a.radius_m THEN 'radius_m' END)")


@query("belief_changes", f"""
SELECT address_id, {CHANGED} AS changed, b.tier AS tier_before, a.tier AS tier_after, b.radius_m AS radius_m_before, a.radius_m AS radius_m_after FROM w_belief_early b FULL JOIN w_belief a USING (address_id)
WHERE {CHANGED} <> ''""")
def belief_changes(v):
    return history.diff(belief.belief_at(v, EARLY), belief.belief_at(v, AS_OF)).select(
        "address_id", "changed", "tier_before", "tier_after", "radius_m_before", "radius_m_after")


@query("what_if_two_denials", f"""
SELECT address_id, {CHANGED} AS changed, b.status AS status_before, a.status AS status_after, a.candidate_id IS NOT DISTINCT FROM b.candidate_id AS same_candidate
FROM w_belief b FULL JOIN w_belief_whatif a USING (address_id) WHERE {CHANGED} <> ''""")
def what_if_two_denials(v):
    """Belief if two more reviewers denied every visited address: nothing may relocate."""
    ev = known_before(belief.evidence_stage(v), AS_OF)
    base = ev.select("address_id").distinct().withColumn("n", F.explode(F.array(F.lit(1), F.lit(2))))
    extra = base.select(
        (-(F.col("address_id") * 2 + F.col("n"))).alias("observation_id"), "address_id", F.concat(F.lit("R"), "n").alias("agent_id"),
        F.lit("no_such_person").alias("outcome"), F.lit("negative").alias("polarity"), F.lit(0.0).alias("weight"), F.lit("2024-01").alias("period"),
        F.lit("2024-01-07").cast("date").alias("day"), F.lit("2024-01-07 12:00:00").cast("timestamp").alias("observed_at"))
    after = belief.belief_from_log(v, ev.unionByName(extra, allowMissingColumns=True), AS_OF, "two_denials")
    return history.diff(belief.belief_at(v, AS_OF), after).select(
        "address_id", "changed", "status_before", "status_after", F.col("candidate_id_before").eqNullSafe(F.col("candidate_id_after")).alias("same_candidate"))


CHANGE_SQL = """(SELECT address_id, as_of, 'decision_changed' AS kind, pt||'/'||ps||'>'||tier||'/'||status AS detail FROM h WHERE v > 1 AND (tier <> pt OR status <> ps)
UNION ALL SELECT address_id, as_of, 'uncertainty_changed', CASE WHEN coalesce(radius_m,0) > coalesce(pr,0) THEN 'widened' ELSE 'narrowed' END FROM h WHERE v > 1 AND radius_m IS DISTINCT FROM pr
UNION ALL SELECT address_id, as_of, 'contradiction_detected', status FROM h WHERE status IN ('MOVED_SUSPECTED','CONTESTED') AND (v = 1 OR status IS DISTINCT FROM ps))"""
H = "h AS (SELECT *, lag(tier) OVER w AS pt, lag(status) OVER w AS ps, lag(radius_m) OVER w AS pr FROM w_hist WINDOW w AS (PARTITION BY address_id ORDER BY v))"


@query("version_changes", f"WITH {H} SELECT address_id, epoch_us(as_of) AS at_us, kind, detail FROM {CHANGE_SQL}")
def version_changes(v):
    return history.changes(history.versions(v, [EARLY, AS_OF])).select("address_id", F.unix_micros("as_of").alias("at_us"), "kind", "detail")


@query("audit_timeline", f"""
WITH {H} SELECT address_id, epoch_us(as_of) AS at_us, kind, detail FROM {CHANGE_SQL}
UNION ALL SELECT address_id, epoch_us(observed_at), 'field_evidence_received', outcome||'/'||polarity FROM w_evcut
UNION ALL SELECT address_id, epoch_us(raised_at), 'case_opened', task_id FROM w_task""")
def audit_timeline(v):
    ev = known_before(belief.evidence_stage(v), AS_OF).select(
        "address_id", F.unix_micros("observed_at").alias("at_us"), F.lit("field_evidence_received").alias("kind"),
        F.concat_ws("/", "outcome", "polarity").alias("detail"))
    t = decision.tasks(belief.belief_at(v, AS_OF)).select(
        "address_id", F.unix_micros("raised_at").alias("at_us"), F.lit("case_opened").alias("kind"), F.col("task_id").alias("detail"))
    return union_all([version_changes(v), ev, t])


@query("provenance_chain", f"""
SELECT h.address_id, h.v::INTEGER AS v, h.belief_version, h.candidate_id, coalesce(e.n,0) AS evidence_known, round(coalesce(e.w,0),6) AS weight_known,
 coalesce(r.n_cand,0) - 1 AS n_losers, lag(h.radius_m) OVER (PARTITION BY h.address_id ORDER BY h.v) AS previous_radius
FROM w_hist h LEFT JOIN (SELECT 1 AS v, address_id, count(*) AS n, sum(weight) AS w FROM w_evcut_early GROUP BY ALL UNION ALL SELECT 2, address_id, count(*), sum(weight) FROM w_evcut GROUP BY ALL) e
 ON e.v=h.v AND e.address_id=h.address_id LEFT JOIN (SELECT 1 AS v, address_id, count(*) AS n_cand FROM w_ranked_early GROUP BY ALL UNION ALL SELECT 2, address_id, count(*) FROM w_ranked GROUP BY ALL) r
 ON r.v=h.v AND r.address_id=h.address_id""")
def provenance_chain(v):
    """Per belief version: what was known, how many candidates lost, and the radius before."""
    parts = []
    for i, cut in enumerate([EARLY, AS_OF]):
        e = known_before(belief.evidence_stage(v), cut).groupBy("address_id").agg(
            F.count("*").alias("n"), F.sum("weight").alias("w"))
        parts.append(belief.belief_at(v, cut).join(e, "address_id", "left").select(
            "address_id", F.lit(i + 1).alias("v"), "belief_version", "candidate_id", F.coalesce("n", F.lit(0)).alias("evidence_known"),
            F.round(F.coalesce("w", F.lit(0.0)), 6).alias("weight_known"),
            (F.coalesce(F.size("ranked"), F.lit(0)).cast("long") - 1).alias("n_losers"), "radius_m"))
    w = Window.partitionBy("address_id").orderBy("v")
    return union_all(parts).withColumn("previous_radius", F.lag("radius_m").over(w)).drop("radius_m")


LOST = """CASE WHEN f_arm_prior < w_prior THEN 'lower_arm_prior' END, CASE WHEN f_granularity_rank < w_gran THEN 'coarser_granularity' END,
 CASE WHEN w_elig=1 AND NOT coalesce(primary_eligible,FALSE) THEN 'no_promotion_credit' END, CASE WHEN NOT coalesce(primary_eligible,TRUE) THEN 'single_observation_not_primary_eligible' END,
 CASE WHEN w_named=1 AND f_locality_name_matched=0 THEN 'locality_name_mismatch' END,
 CASE WHEN f_pin_unknown=1 THEN 'pin_unknown_penalty' END, CASE WHEN f_outside_town=1 THEN 'outside_town_penalty' END, CASE WHEN ambiguous THEN 'landmark_ambiguous' END,
 CASE WHEN arm='frozen_baseline' AND baseline_precision IN ('locality','pincode') THEN 'coarse_precision_penalty' END"""


@query("lost_reasons", f"""
SELECT address_id, candidate_id, round(w_score-score,6) AS margin, concat_ws('+', {LOST}) AS lost_reasons FROM (
 SELECT r.*, win, max(score) FILTER (candidate_id=win) OVER a AS w_score, max(f_arm_prior) FILTER (candidate_id=win) OVER a AS w_prior,
  max(f_granularity_rank) FILTER (candidate_id=win) OVER a AS w_gran, max(coalesce(primary_eligible,FALSE)::INTEGER) FILTER (candidate_id=win) OVER a AS w_elig,
  max(f_locality_name_matched) FILTER (candidate_id=win) OVER a AS w_named
 FROM w_ranked r JOIN (SELECT address_id, candidate_id AS win FROM w_belief WHERE candidate_id IS NOT NULL) USING (address_id) WINDOW a AS (PARTITION BY address_id))
WHERE candidate_id <> win""")
def lost_reasons(v):
    return history.lost_reasons(belief.ranked_at(v, AS_OF), belief.belief_at(v, AS_OF))


@query("decision_geometry", """
SELECT d.address_id, action='REFUSE' OR d.candidate_id IS NULL AS withheld, CASE WHEN NOT (action='REFUSE' OR d.candidate_id IS NULL) THEN n_cand END AS n_candidates,
 CASE WHEN NOT (action='REFUSE' OR d.candidate_id IS NULL) THEN coalesce(n_obs_points,0) END AS n_observations,
 CASE WHEN NOT (action='REFUSE' OR d.candidate_id IS NULL) THEN round(least(cx0, coalesce(ox0,cx0))-greatest(radius_m,150),1) END AS x_min,
 CASE WHEN NOT (action='REFUSE' OR d.candidate_id IS NULL) THEN round(greatest(cx1, coalesce(ox1,cx1))+greatest(radius_m,150),1) END AS x_max
FROM w_decision d LEFT JOIN (SELECT address_id, count(*) AS n_cand, min(x) AS cx0, max(x) AS cx1 FROM w_ranked GROUP BY 1) c USING (address_id)
LEFT JOIN (SELECT address_id, count(*) AS n_obs_points, min(x) AS ox0, max(x) AS ox1 FROM w_evcut WHERE polarity<>'negative' AND x IS NOT NULL GROUP BY 1) o USING (address_id)""")
def decision_geometry(v):
    """Point counts and padded extent per decision; nothing is published where the gate refused."""
    o = known_before(belief.evidence_stage(v), AS_OF).filter("polarity <> 'negative' and x is not null").groupBy("address_id").agg(
        F.count("*").alias("n_obs_points"), F.min("x").alias("ox0"), F.max("x").alias("ox1"))
    xs = F.transform("ranked", lambda r: r["c"]["x"])
    d = decided(v).join(o, "address_id", "left")
    withheld = (F.col("action") == "REFUSE") | F.col("candidate_id").isNull()
    pad = F.greatest("radius_m", F.lit(150.0))
    show = lambda c: F.when(~withheld, c)
    return d.select("address_id", withheld.alias("withheld"), show(F.size("ranked").cast("long")).alias("n_candidates"),
                    show(F.coalesce("n_obs_points", F.lit(0))).alias("n_observations"),
                    show(F.round(F.least(F.array_min(xs), "ox0") - pad, 1)).alias("x_min"),
                    show(F.round(F.greatest(F.array_max(xs), "ox1") + pad, 1)).alias("x_max"))


SHOWN = "(action='REFUSE' OR d.candidate_id IS NULL)"


@query("decision_frames", f"""
SELECT d.address_id, {SHOWN} AS withheld, CASE WHEN action='REFUSE' THEN 'gate_refuse' WHEN d.candidate_id IS NULL THEN 'no_candidate' END AS withheld_reason,
 CASE WHEN NOT {SHOWN} THEN d.x END AS center_x, CASE WHEN NOT {SHOWN} THEN d.y END AS center_y, CASE WHEN NOT {SHOWN} THEN radius_m END AS ring_m,
 CASE WHEN NOT {SHOWN} THEN round(least(cx0, coalesce(ox0,cx0))-greatest(radius_m,150),1) END AS x_min, CASE WHEN NOT {SHOWN} THEN round(greatest(cx1, coalesce(ox1,cx1))+greatest(radius_m,150),1) END AS x_max,
 CASE WHEN NOT {SHOWN} THEN round(least(cy0, coalesce(oy0,cy0))-greatest(radius_m,150),1) END AS y_min, CASE WHEN NOT {SHOWN} THEN round(greatest(cy1, coalesce(oy1,cy1))+greatest(radius_m,150),1) END AS y_max,
 CASE WHEN {SHOWN} THEN coalesce(n_cand,0) ELSE 0 END AS suppressed_candidates, CASE WHEN {SHOWN} THEN coalesce(n_all,0) ELSE 0 END AS suppressed_observations
FROM w_decision d LEFT JOIN (SELECT address_id, count(*) AS n_cand, min(x) AS cx0, max(x) AS cx1, min(y) AS cy0, max(y) AS cy1 FROM w_ranked GROUP BY 1) c USING (address_id)
LEFT JOIN (SELECT address_id, count(*) AS n_all, min(x) FILTER (polarity<>'negative') AS ox0, max(x) FILTER (polarity<>'negative') AS ox1, min(y) FILTER (polarity<>'negative') AS oy0, max(y) FILTER (polarity<>'negative') AS oy1 FROM w_evcut GROUP BY 1) o USING (address_id)""")
def decision_frames(v):
    """Ring and padded box of each decision; a refused or unplaceable one publishes counts of what is held back, and no position."""
    def seen(c):
        return F.when(F.col("polarity") != "negative", F.col(c))
    o = known_before(belief.evidence_stage(v), AS_OF).groupBy("address_id").agg(
        F.count("*").alias("n_all"), *[f(seen(c)).alias(f"o{c}{i}") for c in "xy" for i, f in ((0, F.min), (1, F.max))])
    at = lambda c: F.transform("ranked", lambda r: r["c"][c])
    withheld = (F.col("action") == "REFUSE") | F.col("candidate_id").isNull()
    pad = F.greatest("radius_m", F.lit(150.0))
    show = lambda c: F.when(~withheld, c)
    held = lambda c: F.when(withheld, F.coalesce(c, F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))
    box = [col for c in "xy" for col in (show(F.round(F.least(F.array_min(at(c)), F.col(f"o{c}0")) - pad, 1)).alias(f"{c}_min"), show(F.round(F.greatest(F.array_max(at(c)), F.col(f"o{c}1")) + pad, 1)).alias(f"{c}_max"))]
    return decided(v).join(o, "address_id", "left").select(
        "address_id", withheld.alias("withheld"), F.when(F.col("action") == "REFUSE", "gate_refuse").when(F.col("candidate_id").isNull(), "no_candidate").alias("withheld_reason"),
        show(F.col("x")).alias("center_x"), show(F.col("y")).alias("center_y"), show(F.col("radius_m")).alias("ring_m"), *box,
        held(F.size("ranked").cast("long")).alias("suppressed_candidates"), held(F.col("n_all")).alias("suppressed_observations"))


@query("geometry_points", """
SELECT d.address_id, 'candidate' AS kind, r.candidate_id AS id, r.x, r.y, r.arm AS source, r.granularity, CASE WHEN r.candidate_id = d.candidate_id THEN d.tier END AS status, r.candidate_id = d.candidate_id AS selected, r.score
FROM w_decision d JOIN w_ranked r USING (address_id) WHERE action <> 'REFUSE' AND d.candidate_id IS NOT NULL
UNION ALL SELECT d.address_id, 'observation', e.observation_id::VARCHAR, CASE WHEN polarity <> 'negative' THEN e.x END, CASE WHEN polarity <> 'negative' THEN e.y END, evidence_class, NULL, polarity, FALSE, weight
FROM w_decision d JOIN w_evcut e USING (address_id) WHERE action <> 'REFUSE' AND d.candidate_id IS NOT NULL""")
def geometry_points(v):
    """Markers of every published decision: its candidates, and its observations (a negative has no position)."""
    d = decided(v).filter("action <> 'REFUSE' and candidate_id is not null")
    c = d.select("address_id", "candidate_id", "tier", F.explode("ranked").alias("r"))
    won = F.col("r.candidate_id") == F.col("candidate_id")
    marks = c.select("address_id", F.lit("candidate").alias("kind"), F.col("r.candidate_id").alias("id"), "r.c.x", "r.c.y", F.col("r.c.arm").alias("source"), "r.c.granularity",
                     F.when(won, F.col("tier")).alias("status"), won.alias("selected"), "r.score")
    e = known_before(belief.evidence_stage(v), AS_OF).join(d.select("address_id"), "address_id", "left_semi")
    place = lambda x: F.when(F.col("polarity") != "negative", F.col(x)).alias(x)
    seen = e.select("address_id", F.lit("observation").alias("kind"), F.col("observation_id").cast("string").alias("id"), place("x"), place("y"), F.col("evidence_class").alias("source"),
                    F.lit(None).cast("string").alias("granularity"), F.col("polarity").alias("status"), F.lit(False).alias("selected"), F.col("weight").alias("score"))
    return marks.unionByName(seen)


@query("town_plane", """
SELECT town_id, count(*) AS n_points, count(*) FILTER (kind='landmark') AS n_landmarks, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max FROM (
 SELECT town_id, 'locality' AS kind, cx AS x, cy AS y FROM w_locality UNION ALL SELECT town_id, 'landmark', px, py FROM w_landmark
 UNION ALL SELECT town_id, 'pin', geocoder_x, geocoder_y FROM w_pin JOIN w_address USING (address_id)) GROUP BY 1""")
def town_plane(v):
    loc = v.locality().select("town_id", F.lit("locality").alias("kind"), F.col("cx").alias("x"), F.col("cy").alias("y"))
    lm = v.landmark().select("town_id", F.lit("landmark").alias("kind"), F.col("px").alias("x"), F.col("py").alias("y"))
    pin = v.pin().join(v.address().select("address_id", "town_id"), "address_id").select(
        "town_id", F.lit("pin").alias("kind"), F.col("geocoder_x").alias("x"), F.col("geocoder_y").alias("y"))
    return union_all([loc, lm, pin]).groupBy("town_id").agg(
        F.count("*").alias("n_points"), F.count_if(F.col("kind") == "landmark").alias("n_landmarks"),
        F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.min("y").alias("y_min"), F.max("y").alias("y_max"))


@query("place_history", f"""
SELECT place_id, v::INTEGER AS v, count(*) AS n_members, max(n_obs) AS most_evidence, count(*) FILTER (status IN ('CONTESTED','MOVED_SUSPECTED')) AS n_contradictions, min(tier) AS first_tier
FROM w_hist JOIN {MEMBER} USING (address_id) GROUP BY 1,2""")
def place_history(v):
    """Case snapshot: every place at every version."""
    h = history.versions(v, [EARLY, AS_OF]).join(members(v), "address_id")
    return h.groupBy("place_id", "v").agg(
        F.count("*").alias("n_members"), F.max("n_obs").alias("most_evidence"),
        F.count_if(F.col("status").isin("CONTESTED", "MOVED_SUSPECTED")).alias("n_contradictions"), F.min("tier").alias("first_tier"))


@query("task_evidence_refs", """
SELECT task_id, count(*) AS n_refs, string_agg(observation_id::VARCHAR, '|' ORDER BY observed_at, observation_id) AS refs FROM (
 SELECT task_id, observation_id, observed_at, row_number() OVER (PARTITION BY task_id ORDER BY observed_at DESC, observation_id DESC) AS rn FROM w_task t JOIN w_ev e ON e.address_id=t.address_id
  AND observed_at < raised_at AND polarity = CASE cause WHEN 'MOVED_SUSPECTED' THEN 'negative' ELSE 'positive' END) WHERE rn <= 10 GROUP BY 1""")
def task_evidence_refs(v):
    """Last ten observations of the polarity that raised the task (the cap is part of the feature)."""
    t = decision.tasks(belief.belief_at(v, AS_OF)).select("task_id", "address_id", "raised_at", F.when(
        F.col("cause") == "MOVED_SUSPECTED", "negative").otherwise("positive").alias("polarity"))
    e = belief.evidence_stage(v).select("address_id", "observation_id", "observed_at", "polarity")
    j = t.join(e, ["address_id", "polarity"]).filter("observed_at < raised_at")
    w = Window.partitionBy("task_id").orderBy(F.col("observed_at").desc(), F.col("observation_id").desc())
    return (j.withColumn("rn", F.row_number().over(w)).filter("rn <= 10").groupBy("task_id").agg(
        F.count("*").alias("n_refs"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("observed_at", "observation_id"))),
                                                               lambda s: s["observation_id"].cast("string")), "|").alias("refs")))


@query("typed_reason_codes", """
SELECT 'tier' AS kind, tier_reason AS code, count(*) AS n FROM w_belief GROUP BY 2 UNION ALL SELECT 'widen', widen_reason, count(*) FROM w_belief WHERE widen_reason IS NOT NULL GROUP BY 2
UNION ALL SELECT 'gate', reason, count(*) FROM w_decision GROUP BY 2""")
def typed_reason_codes(v):
    """Reason codes of every decision expanded to typed rows."""
    codes = F.array(F.struct(F.lit("tier").alias("kind"), F.col("tier_reason").alias("code")),
                    F.struct(F.lit("widen").alias("kind"), F.col("widen_reason").alias("code")),
                    F.struct(F.lit("gate").alias("kind"), F.col("reason").alias("code")))
    return (decided(v).select(F.explode(codes).alias("c")).select("c.*").filter("code is not null")
            .groupBy("kind", "code").agg(F.count("*").alias("n")))


@query("ranked_losers_page", """
SELECT r.address_id, r.candidate_id, r.arm, rank, r.score FROM w_ranked r JOIN w_belief b ON b.address_id=r.address_id AND b.candidate_id<>r.candidate_id
QUALIFY row_number() OVER (PARTITION BY r.address_id ORDER BY rank) <= 6""")
def ranked_losers_page(v):
    """Up to six alternatives per address with rank and score, straight from the ranked set."""
    b = belief.belief_at(v, AS_OF).select("address_id", F.col("candidate_id").alias("wid"))
    r = ranking.exploded(belief.ranked_at(v, AS_OF)).join(b, "address_id").filter("candidate_id <> wid")
    w = Window.partitionBy("address_id").orderBy("rank")
    return r.withColumn("k", F.row_number().over(w)).filter("k <= 6").select(
        "address_id", "candidate_id", "arm", F.col("rank").cast("long").alias("rank"), "score")
