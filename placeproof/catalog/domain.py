"""Candidates, ranking, evidence, belief and decision jobs over the whole book."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from placeproof import policy
from placeproof.catalog import query
from placeproof.catalog.oracle_domain import AS_OF, found_records
from placeproof.catalog.oracle_views import VIEWS, dist, toks
from placeproof.functions import text
from placeproof.operators import intervals
from placeproof.operators.asof import known_before
from placeproof.plans import belief, candidates as cand, decision, evidence, ranking, residue
from placeproof.sources.stages import stage


@query("evidence_weight", """
SELECT observation_id, address_id, weight, array_to_string(reason_codes, '|') AS reasons, period,
  day::VARCHAR AS day FROM w_ev""")
def evidence_weight(v):
    return belief.evidence_stage(v).select(
        "observation_id", "address_id", "weight", F.array_join("reason_codes", "|").alias("reasons"),
        "period", F.col("day").cast("string").alias("day"))


@query("static_and_evidence_candidates", """
SELECT address_id, candidate_id, arm, source_ref, x, y, granularity, arm_rank::INTEGER AS arm_rank, stratum,
  primary_eligible, ambiguous, agreement_arms::INTEGER AS agreement_arms FROM w_cand""")
def candidates_all(v):
    return cand.exploded(belief.bare_sets(v, AS_OF)).select(
        "address_id", "candidate_id", "arm", "source_ref", "x", "y", "granularity", "arm_rank",
        "stratum", "primary_eligible", "ambiguous", "agreement_arms")


@query("belief_table", """
SELECT address_id, town_id, belief_version, candidate_id, arm, x, y, granularity, stratum, score, tier, status, radius_m,
  widen_reason, tier_reason, negative_cap, promoted, contested, spread_m, n_obs, n_pos, n_strong, n_neg, round(positive_weight_sum, 3) AS positive_weight_sum
FROM w_belief""")
def belief_table(v):
    # the two engines break rounding ties of single weights differently, hence three digits here
    return belief.belief_at(v, AS_OF).select(*[c for c in belief.FLAT if c != "as_of"]).withColumn(
        "positive_weight_sum", F.round("positive_weight_sum", 3))


# ---- candidate arms --------------------------------------------------------------------------------
ARM_COLS = ["address_id", "source_ref", "x", "y", "granularity", "arm_rank", "stratum", "primary_eligible", "ambiguous"]


def _arm_query(arm):
    @query(f"arm_{arm}", f"""
SELECT address_id, source_ref, x, y, granularity, arm_rank::INTEGER AS arm_rank, stratum, primary_eligible, ambiguous FROM {'w_cand1' if arm == 'memory' else 'w_union'} WHERE arm='{arm}'""")
    def run(v):
        if arm == "field_evidence":
            df = cand.field_evidence(known_before(belief.evidence_stage(v), AS_OF))
        elif arm == "memory":
            df = belief.memory_arm(belief.prior_at(v, AS_OF), AS_OF)
        else:
            addr = cand.prepared_addresses(v.address())
            df = {
                "frozen_baseline": lambda: cand.frozen_baseline(v.pin()),
                "town_centroid": lambda: cand.town_centroid(addr, v.locality()),
                "official_landmark": lambda: cand.official_landmark(
                    cand.landmark_hits(addr, v.landmark()), v.landmark()),
                "address_book": lambda: cand.address_book(addr, v.pin()),
            }[arm]()
        return df.select(*ARM_COLS)


for _name in policy.ARMS:
    if _name != "locality_centroid":
        _arm_query(_name)


@query("arm_locality_centroid", """
SELECT address_id, 'locality:'||locality_id AS source_ref, cx AS x, cy AS y, 'locality' AS granularity, 1 AS arm_rank, 'locality' AS stratum, NULL::BOOLEAN AS primary_eligible, NULL::BOOLEAN AS ambiguous,
 match, round(coverage, 4) AS coverage, idf_sum, CASE WHEN match = 'pincode_match' THEN TRUE END AS ambiguous_pin, residue_score, residue_margin
FROM (SELECT *, NULL::DOUBLE AS residue_score, NULL::DOUBLE AS residue_margin FROM w_locmatch
 UNION ALL SELECT address_id, locality_id, NULL, NULL, 'residue_tfidf', score, round(score/second, 3) FROM w_residue) JOIN w_loc USING (locality_id)""")
def arm_locality_centroid(v):
    """The arm with its provenance: names, else all localities of the pin, else the residue proposal."""
    addr, loc = belief.prepared_stage(v), v.locality()
    matches = stage(v, "locality_matches", lambda: cand.locality_matches(addr, loc, "2024-02-01"))
    full = cand.with_residue(matches, residue_proposals(v))
    return cand.locality_centroid(full, loc).select(*ARM_COLS).join(cand.locality_provenance(full), ["address_id", "source_ref"])


@query("locality_match_v1", """
SELECT address_id, locality_id, score FROM (SELECT address_id, locality_id, sum(s)::BIGINT AS score, row_number() OVER (PARTITION BY address_id ORDER BY sum(s) DESC, locality_id) AS rn FROM (
 SELECT DISTINCT address_id, locality_id, 2 AS s FROM (SELECT address_id, town_id, unnest(toks) AS token FROM w_addr) JOIN (SELECT town_id, locality_id, unnest(ltoks) AS token FROM w_loc) USING (town_id, token)
 UNION ALL SELECT address_id, locality_id, 1 FROM w_addr a JOIN w_loc l ON a.town_id=l.town_id AND pin_text=pincode) GROUP BY 1,2) WHERE rn = 1""")
def locality_match_v1(v):
    return cand.locality_v1(cand.prepared_addresses(v.address()), v.locality())


@query("landmark_plausibility", "SELECT address_id, source_ref FROM w_union WHERE arm='official_landmark' AND (address_id, source_ref) NOT IN (SELECT (address_id, source_ref) FROM w_cand0)")
def landmark_plausibility(v):
    """Landmarks dropped as implausible: in the union, not in the finished sets."""
    ev = known_before(belief.evidence_stage(v), AS_OF)
    union = belief.static_stage(v).unionByName(cand.field_evidence(ev)).filter("arm = 'official_landmark'")
    kept = cand.exploded(belief.bare_sets(v, AS_OF)).filter("arm = 'official_landmark'")
    return union.select("address_id", "source_ref").join(kept.select("address_id", "source_ref"), ["address_id", "source_ref"], "left_anti")


@query("cross_arm_agreement", "SELECT candidate_id, agreement_arms::INTEGER AS agreement_arms, f_agreement_count::INTEGER AS f_agreement_count FROM w_candm")
def cross_arm_agreement(v):
    return cand.exploded(belief.full_sets(v, AS_OF)).select("candidate_id", "agreement_arms", "f_agreement_count")


def code_point_edits(a: str, b: str) -> str:
    """DuckDB's levenshtein counts bytes.  Outside ASCII each distinct character of both texts becomes one ASCII character, which keeps the distance per code point."""
    chars = "list_transform(range(1, length({0}) + 1), lambda i: substr({0}, i, 1))"
    every = f"list_distinct({chars.format(f'({a} || {b})')})"

    def coded(x: str) -> str:
        return f"array_to_string(list_transform({chars.format(x)}, lambda c: chr((33 + list_position({every}, c))::INT)), '')"
    return (f"(CASE WHEN strlen({a} || {b}) = length({a} || {b}) THEN levenshtein({a}, {b}) WHEN len({every}) > 94 THEN error('more than 94 characters') "
            f"ELSE levenshtein({coded(a)}, {coded(b)}) END)")


FEATURE_COLS = [c for c in ranking.FEATURES if c != "f_sim_ratio"]


@query("candidate_features", f"SELECT candidate_id, {', '.join(c if c not in ('f_agreement_count', 'f_n_candidates', 'f_baseline_stratum') else (c + '::INTEGER AS ' + c if c != 'f_baseline_stratum' else 'stratum AS f_baseline_stratum') for c in FEATURE_COLS)} FROM w_ranked")
def candidate_features(v):
    return ranking.exploded(belief.ranked_at(v, AS_OF)).select("candidate_id", *FEATURE_COLS)


@query("edit_similarity_feature", f"""
WITH p AS (SELECT address_id, norm, lname FROM w_addr LEFT JOIN (SELECT DISTINCT town_id, lname FROM w_loc) USING (town_id))
SELECT address_id, round(coalesce(max(CASE WHEN norm = '' OR lname IS NULL THEN 0.0 ELSE 1.0 - {code_point_edits('norm', 'lname')} / greatest(length(norm), length(lname)) END), 0), 4) AS f_sim_ratio FROM p GROUP BY address_id""")
def edit_similarity_feature(v):
    """Best edit similarity to a locality name, per code point, of every address."""
    return belief.features_stage(v).select("address_id", "f_sim_ratio")


@query("rule_scores", "SELECT candidate_id, score, rank FROM w_ranked")
def rule_scores(v):
    return ranking.exploded(belief.ranked_at(v, AS_OF)).select("candidate_id", "score", F.col("rank").cast("long").alias("rank"))


VIEWS["w_terms"] = """
SELECT candidate_id, t.name AS name, round(t.value,6) AS value FROM (SELECT candidate_id, unnest([
 {'name': 'arm_prior:'||arm, 'value': f_arm_prior}, {'name': 'granularity:'||granularity, 'value': 0.12::DOUBLE*f_granularity_rank},
 {'name': 'coarse_precision_penalty', 'value': CASE WHEN arm='frozen_baseline' AND baseline_precision IN ('locality','pincode') THEN -0.06::DOUBLE END},
 {'name': 'fine_precision_bonus', 'value': CASE WHEN arm='frozen_baseline' AND baseline_precision='rooftop' THEN 0.04::DOUBLE END},
 {'name': 'evidence_promotion_eligible', 'value': CASE WHEN primary_eligible THEN 0.08::DOUBLE END}, {'name': 'landmark_ambiguous_penalty', 'value': CASE WHEN ambiguous THEN -0.08::DOUBLE END},
 {'name': 'locality_match', 'value': CASE WHEN f_locality_name_matched=1 THEN 0.05::DOUBLE END}, {'name': 'pin_in_text_known', 'value': CASE WHEN f_pin_in_text=1 AND f_pin_unknown=0 THEN 0.04::DOUBLE END},
 {'name': 'pin_unknown_penalty', 'value': CASE WHEN f_pin_unknown=1 THEN -0.05::DOUBLE END}, {'name': 'no_house_number', 'value': CASE WHEN f_no_digit=1 THEN -0.03::DOUBLE END},
 {'name': 'outside_town_penalty', 'value': CASE WHEN f_outside_town=1 THEN -0.20::DOUBLE END}, {'name': 'text_locality_similarity', 'value': round(0.05::DOUBLE*f_sim_jaccard,6)},
 {'name': 'text_char_similarity', 'value': round(0.03::DOUBLE*f_sim_char3,6)},
 {'name': 'arm_agreement_x'||f_agreement_count, 'value': CASE WHEN f_agreement_count>0 THEN round(0.04::DOUBLE*least(f_agreement_count,3),6) END}]) AS t FROM w_ranked) WHERE t.value IS NOT NULL AND abs(t.value) > 1e-9"""


@query("score_explanations", "SELECT * FROM w_terms")
def score_explanations(v):
    """Named score terms of every ranked candidate, one row each."""
    return ranking.exploded(belief.ranked_at(v, AS_OF)).select("candidate_id", F.explode("terms").alias("t")).select(
        "candidate_id", "t.name", F.round("t.value", 6).alias("value"))


@query("score_term_codes", """
SELECT name, nullif(subject, '') AS subject, CASE WHEN effect >= 0 THEN 'positive' ELSE 'negative' END AS direction, label, count(*) AS n, round(sum(effect), 3) AS effect_sum FROM (
 SELECT name, split_part(name, ':', 2) AS subject, round(value, 4) AS effect, upper(substr(replace(replace(name, '_', ' '), ':', ' '), 1, 1)) || lower(substr(replace(replace(name, '_', ' '), ':', ' '), 2)) AS label FROM w_terms) GROUP BY ALL""")
def score_term_codes(v):
    """Score terms written as `name:subject=+value` codes and read back as typed rows."""
    t = ranking.exploded(belief.ranked_at(v, AS_OF)).select(F.explode("terms").alias("t"))
    code = decision.term_code(F.col("t.name"), F.col("t.value"))
    p = t.select(decision.parse_term(code).alias("p")).select("p.*")
    return p.groupBy("name", "subject", "direction", "label").agg(F.count("*").alias("n"), F.round(F.sum("effect"), 3).alias("effect_sum"))


@query("score_term_totals", """
SELECT 'locality_match' AS term, count(*) AS n FROM w_ranked WHERE f_locality_name_matched=1 UNION ALL SELECT 'pin_unknown_penalty', count(*) FROM w_ranked WHERE f_pin_unknown=1
UNION ALL SELECT 'landmark_ambiguous_penalty', count(*) FROM w_ranked WHERE ambiguous UNION ALL SELECT 'outside_town_penalty', count(*) FROM w_ranked WHERE f_outside_town=1
UNION ALL SELECT 'evidence_promotion_eligible', count(*) FROM w_ranked WHERE primary_eligible""")
def score_term_totals(v):
    names = ["locality_match", "pin_unknown_penalty", "landmark_ambiguous_penalty", "outside_town_penalty", "evidence_promotion_eligible"]
    t = ranking.exploded(belief.ranked_at(v, AS_OF)).select(F.explode("terms").alias("t")).select("t.name")
    one = t.agg(*[F.count_if(F.col("name") == n).alias(n) for n in names])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("term"), F.col(n).alias("n")) for n in names])).alias("r")).select("r.*")


@query("promotion_detail", "SELECT address_id, n_strong, n_collectors, n_periods, n_media, period_ok, media_ok, promoted FROM w_promo")
def promotion_detail(v):
    return evidence.promotion(belief.evidence_stage(v), ["address_id"]).select(
        "address_id", "n_strong", "n_collectors", "n_periods", "n_media", "period_ok", "media_ok", "promoted")


@query("belief_instants", """
SELECT address_id, max(epoch_us(observed_at)) + 1000000 AS instant_us, count(*) + 1 AS belief_version FROM w_evcut GROUP BY 1""")
def belief_instants(v):
    return known_before(belief.evidence_stage(v), AS_OF).groupBy("address_id").agg(
        (F.max(F.unix_micros("observed_at")) + 1000000).alias("instant_us"), (F.count("*") + 1).alias("belief_version"))


@query("radius_by_rule", """
SELECT tier, status, n_neg, stratum, radius_m, widen_reason, CASE WHEN tier <> 'UNPLACEABLE' THEN 'locality' END AS source_stratum, CASE WHEN tier <> 'UNPLACEABLE' THEN 24 END AS n_calibration,
 CASE WHEN tier <> 'UNPLACEABLE' THEN 0.792::DOUBLE END AS measured_coverage, count(*) AS n FROM w_belief GROUP BY ALL""")
def radius_by_rule(v):
    """Published radii: rule, stratum asked for and stratum used, with that one's calibration size and coverage."""
    shown = F.col("tier") != "UNPLACEABLE"
    b = belief.belief_at(v, AS_OF).withColumn("source_stratum", F.when(shown, belief.published(F.col("stratum")))).withColumn(
        "n_calibration", F.when(shown, belief.radius_entry(F.col("stratum"), 2))).withColumn("measured_coverage", F.when(shown, belief.radius_entry(F.col("stratum"), 3)))
    return b.groupBy("tier", "status", "n_neg", "stratum", "radius_m", "widen_reason", "source_stratum", "n_calibration", "measured_coverage").agg(F.count("*").alias("n"))


@query("purpose_classes", "SELECT address_id, purpose, n_met FROM w_purpose")
def purpose_classes(v):
    return _purposes(v)


def _purposes(v):
    return decision.purpose(v.address(), known_before(belief.evidence_stage(v), AS_OF))


def decided(v, request="FIELD_NAVIGATION"):
    return decision.decisions(belief.belief_at(v, AS_OF), _purposes(v), request)


@query("eligibility_navigation", "SELECT address_id, action, reason FROM w_decision")
def eligibility_navigation(v):
    return decided(v).select("address_id", "action", "reason")


@query("eligibility_notice", "SELECT address_id, action, reason FROM w_decision_strict")
def eligibility_notice(v):
    return decided(v, "NOTICE_SERVICE").select("address_id", "action", "reason")


@query("direction_cues", f"""
SELECT address_id, poi_id, (round_even(d/10.0,0)*10)::BIGINT AS distance_m, round(b,1) AS bearing_deg, ambiguous,
 poi_name||' ~'||(round_even(d/10.0,0)*10)::BIGINT||' m, bearing '||(['N','NE','E','SE','S','SW','W','NW'])[((floor((b+22.5)/45))::INTEGER % 8)+1]||', '||rel||' it' AS cue_text
FROM (SELECT h.address_id, poi_id, poi_name, rel, n_hits > 1 AS ambiguous, {dist('x','y','px','py')} AS d,
  CASE WHEN px=x AND py=y THEN 0 ELSE (degrees(atan2(px-x, py-y)) + 360.0) % 360.0 END AS b FROM w_lmhit h JOIN w_belief USING (address_id) JOIN w_landmark USING (poi_id)) WHERE d <= 1500""")
def direction_cues(v):
    hits = cand.landmark_hits(cand.prepared_addresses(v.address()), v.landmark())
    return decision.directions(belief.belief_at(v, AS_OF), hits, v.landmark())


BATCH_SQL = "(SELECT address_id AS qid, town_id, CASE address_id%5 WHEN 0 THEN '' WHEN 1 THEN 'unknown lane '||address_id ELSE address_text END AS qtext FROM w_address)"


@query("batch_resolve", f"""
SELECT qid, how, coalesce(action, CASE WHEN how='empty_text' THEN 'BAD_INPUT' ELSE 'VERIFY_FIRST' END) AS status, coalesce(reason,'unplaceable') AS reason, tier,
 CASE WHEN coalesce(action,'x') <> 'REFUSE' THEN radius_m END AS radius_m, CASE WHEN coalesce(action,'x') <> 'REFUSE' THEN x END AS x, CASE WHEN coalesce(action,'x') <> 'REFUSE' THEN y END AS y
FROM {found_records(BATCH_SQL)} f LEFT JOIN w_decision d ON d.address_id=f.address_id""")
def batch_resolve(v):
    """Typed texts to decisions; texts that name no record keep their own status."""
    k, t = F.col("address_id"), F.col("address_text")
    q = v.address().select(F.col("address_id").alias("qid"), "town_id", F.when(k % 5 == 0, "").when(
        k % 5 == 1, F.concat(F.lit("unknown lane "), k.cast("string"))).otherwise(t).alias("qtext"))
    found = decision.find_records(q, cand.prepared_addresses(v.address()), v.locality())
    d = decided(v).select("address_id", "action", "reason", "tier", "radius_m", "x", "y")
    j = found.join(d, "address_id", "left")
    refused = F.coalesce("action", F.lit("x")) == "REFUSE"
    return j.select("qid", "how", F.coalesce("action", F.when(F.col("how") == "empty_text", "BAD_INPUT").otherwise("VERIFY_FIRST")).alias("status"),
                    F.coalesce("reason", F.lit("unplaceable")).alias("reason"), "tier", F.when(~refused, F.col("radius_m")).alias("radius_m"),
                    F.when(~refused, F.col("x")).alias("x"), F.when(~refused, F.col("y")).alias("y"))


@query("batch_summary", """
SELECT count(*) AS decided, count(*) FILTER (action='SERVE') AS served, round(1 - count(*) FILTER (action='SERVE')/count(*),4) AS refusal_rate, count(*) FILTER (tier='CONFIRMED') AS confirmed,
 count(*) FILTER (tier='PROBABLE') AS probable, count(*) FILTER (radius_m < 700) AS radius_under_700, count(*) FILTER (radius_m >= 700 AND radius_m < 1000) AS radius_under_1000,
 (list_sort(list(radius_m) FILTER (radius_m IS NOT NULL)))[count(radius_m)//2+1] AS upper_median FROM w_decision""")
def batch_summary(v):
    """Counts per action, tier mix, radius histogram and upper median from radius value counts."""
    d = decided(v)
    a = d.agg(F.count("*").alias("decided"), F.count_if(F.col("action") == "SERVE").alias("served"),
              F.round(1 - F.count_if(F.col("action") == "SERVE") / F.count("*"), 4).alias("refusal_rate"),
              F.count_if(F.col("tier") == "CONFIRMED").alias("confirmed"), F.count_if(F.col("tier") == "PROBABLE").alias("probable"),
              F.count_if(F.col("radius_m") < 700).alias("radius_under_700"),
              F.count_if((F.col("radius_m") >= 700) & (F.col("radius_m") < 1000)).alias("radius_under_1000"),
              F.count("radius_m").alias("nr"))
    # a radius takes few values (tier x negatives x stale), so the ordered pass is over those
    vc = d.filter("radius_m is not null").groupBy("radius_m").agg(F.count("*").alias("c"))
    cum = vc.withColumn("cum", F.sum("c").over(Window.orderBy("radius_m")))
    med = cum.crossJoin(F.broadcast(a.select("nr"))).filter(F.col("cum") > F.floor(F.col("nr") / 2)).agg(F.min("radius_m").alias("upper_median"))
    return a.drop("nr").crossJoin(F.broadcast(med))


def members(v):
    from placeproof.catalog.joins import blocks_stage
    return v.address().select("address_id").join(blocks_stage(v).withColumnRenamed("id", "address_id"), "address_id", "left").select(
        "address_id", F.concat(F.lit("PL-"), F.coalesce("block_id", "address_id")).alias("place_id"))


MEMBER = "(SELECT address_id, 'PL-'||coalesce(block_id, address_id) AS place_id FROM w_address LEFT JOIN w_block ON id=address_id)"


@query("place_states", f"""
SELECT place_id, count(*) AS n_members, CASE WHEN bool_or(status='CONTESTED') THEN 'CONTESTED' WHEN bool_or(status='MOVED_SUSPECTED') THEN 'MOVED_SUSPECTED'
 WHEN bool_or(tier='CONFIRMED') THEN 'CONFIRMED' WHEN bool_or(tier='PROBABLE') THEN 'WARM' ELSE 'COLD' END AS state,
 coalesce(min(address_id) FILTER (tier='CONFIRMED'), min(address_id) FILTER (candidate_id IS NOT NULL)) AS anchor_id,
 count(*) FILTER (status IN ('CONTESTED','MOVED_SUSPECTED')) AS n_contradictions FROM w_belief JOIN {MEMBER} USING (address_id) GROUP BY 1""")
def place_states(v):
    return decision.place_state(belief.belief_at(v, AS_OF), members(v))


@query("place_membership", """
SELECT user_id AS address_id, arg_max(event_type, (ts, event_id)) = 'signup' AS is_member, max(event_id) FILTER (event_type='signup') AS last_link FROM events WHERE event_type IN ('signup','error') GROUP BY 1""")
def place_membership(v):
    """Membership after link (signup) and split (error) events: the latest event decides."""
    e = v.raw("events").filter(F.col("event_type").isin("signup", "error"))
    return e.groupBy(F.col("user_id").alias("address_id")).agg(
        (F.max_by("event_type", F.struct("ts", "event_id")) == "signup").alias("is_member"),
        F.max(F.when(F.col("event_type") == "signup", F.col("event_id"))).alias("last_link"))


LINKS_SQL = "(SELECT event_id, user_id AS address_id, ts, event_type = 'signup' AS opens FROM events WHERE event_type IN ('signup','error'))"


def link_events(v):
    """Link and split events of the place log: id, address, instant, kind."""
    return v.raw("events").filter(F.col("event_type").isin("signup", "error")).select(
        "event_id", F.col("user_id").alias("address_id"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_type") == "signup").alias("opens"))


@query("membership_intervals", f"""
SELECT address_id, event_id AS opened_by, epoch_us(ts) AS begin_us, closed_by, epoch_us(closed_at) AS end_us FROM (
 SELECT *, lead(event_id) OVER w AS closed_by, lead(ts) OVER w AS closed_at FROM (SELECT *, lag(opens) OVER (PARTITION BY address_id ORDER BY ts, event_id) AS was FROM {LINKS_SQL}) WHERE opens <> coalesce(was, FALSE)
 WINDOW w AS (PARTITION BY address_id ORDER BY ts, event_id)) WHERE opens""")
def membership_intervals(v):
    """Spans of membership from appended link and split events."""
    s = intervals.spans(link_events(v), ["address_id"], "at", "event_id", F.col("opens"))
    return s.select("address_id", "opened_by", F.unix_micros("begin").alias("begin_us"), "closed_by", F.unix_micros("end").alias("end_us"))


@query("members_at_instants", f"""
SELECT a.address_id, cut::VARCHAR AS cut, coalesce(arg_max(opens, (ts, event_id)), FALSE) AS is_member, arg_max(event_id, (ts, event_id)) AS since_event
FROM (SELECT DISTINCT address_id FROM {LINKS_SQL}) a CROSS JOIN (VALUES (TIMESTAMP '2024-01-05 00:00:00'), (TIMESTAMP '2024-01-20 12:00:00')) c(cut) LEFT JOIN {LINKS_SQL} e ON e.address_id = a.address_id AND ts <= cut GROUP BY 1, 2""")
def members_at_instants(v):
    """Membership of every address at two instants, by an as-of join on the link log."""
    e = link_events(v)
    cuts = F.array(*[F.lit(c).cast("timestamp") for c in ("2024-01-05 00:00:00", "2024-01-20 12:00:00")])
    points = e.select("address_id").distinct().withColumn("cut", F.explode(cuts))
    got = intervals.state_at(points, e, ["address_id"], "cut", "at", "event_id", F.col("opens"))
    return got.select("address_id", F.date_format("cut", "yyyy-MM-dd HH:mm:ss").alias("cut"), F.col("is_open").alias("is_member"), "since_event")


@query("verify_first_tasks", "SELECT task_id, address_id, town_id, cause, priority, tier, radius_m, n_neg FROM w_task")
def verify_first_tasks(v):
    return decision.tasks(belief.belief_at(v, AS_OF)).drop("raised_at")


KIND = "CASE event_type WHEN 'signup' THEN 'open' WHEN 'view' THEN 'in_progress' WHEN 'purchase' THEN 'resolved' ELSE 'reopened' END"
OPEN_STATES = ["open", "in_progress", "reopened"]


CASES_SQL = f"""(SELECT address_id, event_id, ts, lead(ts) OVER w AS closed_at, opens FROM (SELECT *, lag(opens) OVER (PARTITION BY address_id ORDER BY ts, event_id) AS was FROM (
 SELECT user_id AS address_id, event_id, ts, {KIND} <> 'resolved' AS opens FROM events)) WHERE opens <> coalesce(was, FALSE) WINDOW w AS (PARTITION BY address_id ORDER BY ts, event_id))"""


@query("open_cases_by_town", f"""
WITH s AS (SELECT town_id, ts, closed_at FROM {CASES_SQL} JOIN w_address USING (address_id) WHERE opens),
 d AS (SELECT DISTINCT ts::DATE AS day FROM events), g AS (SELECT DISTINCT town_id FROM s)
SELECT town_id, day::VARCHAR AS day, (SELECT count(*) FROM s WHERE s.town_id = g.town_id AND s.ts::DATE = day) AS opened, (SELECT count(*) FROM s WHERE s.town_id = g.town_id AND s.closed_at::DATE = day) AS closed,
 (SELECT count(*) FROM s WHERE s.town_id = g.town_id AND s.ts::DATE <= day AND (s.closed_at IS NULL OR s.closed_at::DATE > day)) AS open_at_end FROM g CROSS JOIN d""")
def open_cases_by_town(v):
    """Open cases of each town at the end of each day, swept from the events that open and close them."""
    e = task_events(v)
    s = intervals.spans(e, ["address_id"], "at", "event_id", F.col("kind") != "resolved").join(v.address().select("address_id", "town_id"), "address_id")
    out = intervals.open_over_time(s, ["town_id"], e.select(F.to_date("at").alias("day")))
    return out.withColumn("day", F.col("day").cast("string"))


def task_events(v):
    et = F.col("event_type")
    return v.raw("events").select("event_id", F.col("user_id").alias("address_id"), F.col("ts").cast("timestamp").alias("at"),
                                  F.when(et == "signup", "open").when(et == "view", "in_progress").when(et == "purchase", "resolved").otherwise("reopened").alias("kind"))


@query("task_queue_by_town", f"""
SELECT town_id, task_id, state, priority, rk FROM (SELECT *, row_number() OVER (PARTITION BY town_id ORDER BY priority DESC, address_id, task_id) AS rk FROM (
 SELECT t.*, coalesce(k, 'open') AS state FROM w_task t LEFT JOIN (SELECT user_id AS address_id, arg_max({KIND}, (ts, event_id)) AS k FROM events WHERE ts < TIMESTAMP '{AS_OF}' GROUP BY 1) USING (address_id))
 WHERE state IN ('open','in_progress','reopened') AND cause IN ('MOVED_SUSPECTED','CONTESTED')) WHERE rk <= 5""")
def task_queue_by_town(v):
    """Five most urgent unresolved tasks of each town, in the state of their latest event before the cut."""
    from placeproof.operators.windows import top_per_key
    t = decision.with_state(decision.tasks(belief.belief_at(v, AS_OF)), task_events(v), AS_OF)
    t = decision.matching(t, state=OPEN_STATES, cause=["MOVED_SUSPECTED", "CONTESTED"])
    return top_per_key(t, ["town_id"], [F.col("priority").desc(), F.col("address_id"), F.col("task_id")], 5, "rk").select(
        "town_id", "task_id", "state", "priority", F.col("rk").cast("long").alias("rk"))


@query("task_transition_violations", f"""
SELECT event_id, kind, prev FROM (SELECT event_id, {KIND} AS kind, lag({KIND}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)
WHERE NOT (prev IS NULL AND kind='open') AND NOT coalesce((prev='open' AND kind IN ('in_progress','resolved','reopened')) OR (prev='in_progress' AND kind IN ('resolved','reopened'))
 OR (prev='reopened' AND kind IN ('in_progress','resolved')) OR (prev='resolved' AND kind='reopened'), FALSE)""")
def task_transition_violations(v):
    et = F.col("event_type")
    e = v.raw("events").select("event_id", F.col("user_id").alias("task_id"), F.struct("ts", "event_id").alias("seq"),
                               F.when(et == "signup", "open").when(et == "view", "in_progress").when(et == "purchase", "resolved").otherwise("reopened").alias("kind"))
    return decision.bad_transitions(e).select("event_id", "kind", "prev")


@query("adjudications_to_log", """
SELECT conv_id AS address_id, CASE WHEN role='user' THEN 'confirm' WHEN length(text)%2=0 THEN 'deny' ELSE 'inconclusive' END AS decision,
 CASE WHEN role='user' THEN 'met_family' WHEN length(text)%2=0 THEN 'no_such_person' ELSE 'locked_premises' END AS outcome,
 CASE WHEN role='user' THEN 'positive' WHEN length(text)%2=0 THEN 'negative' ELSE 'ambiguous' END AS polarity, count(*) AS n FROM conversations GROUP BY ALL""")
def adjudications_to_log(v):
    """Reviewer decisions mapped onto the outcome table, as observations of kind `adjudication`."""
    d = F.when(F.col("role") == "user", "confirm").when(F.length("text") % 2 == 0, "deny").otherwise("inconclusive")
    mapping = v.spark.createDataFrame(list(policy.DECISION_OUTCOME.items()), "decision string, outcome string")
    o = (v.raw("conversations").select(F.col("conv_id").alias("address_id"), d.alias("decision"))
         .join(F.broadcast(mapping), "decision"))
    pol = (F.when(F.col("outcome").isin(policy.NEGATIVE_OUTCOMES), "negative").when(
        F.col("outcome").isin(policy.AMBIGUOUS_OUTCOMES), "ambiguous").otherwise("positive"))
    return o.groupBy("address_id", "decision", "outcome", pol.alias("polarity")).agg(F.count("*").alias("n"))


@query("overview", """
SELECT count(*) AS indexed, count(*) FILTER (tier='CONFIRMED') AS confirmed, count(*) FILTER (tier IN ('CONFIRMED','PROBABLE')) AS with_location, count(*) FILTER (tier='UNPLACEABLE') AS unplaceable,
 count(*) FILTER (status IN ('MOVED_SUSPECTED','CONTESTED')) AS conflicting, count(*) FILTER (n_obs > 0) AS warm, count(*) FILTER (n_obs = 0) AS cold, sum(n_obs)::BIGINT AS visits_known,
 (SELECT count(*) FROM w_evcut WHERE observed_at >= TIMESTAMP '2024-01-08' - INTERVAL 30 DAY) AS visits_30d FROM w_belief""")
def overview(v):
    b = belief.belief_at(v, AS_OF)
    ev = known_before(belief.evidence_stage(v), AS_OF)
    at = F.lit(AS_OF).cast("timestamp")
    recent = ev.agg(F.count_if(F.col("observed_at") >= at - F.expr("interval 30 days")).alias("visits_30d"))
    return b.agg(F.count("*").alias("indexed"), F.count_if(F.col("tier") == "CONFIRMED").alias("confirmed"),
                 F.count_if(F.col("tier").isin("CONFIRMED", "PROBABLE")).alias("with_location"),
                 F.count_if(F.col("tier") == "UNPLACEABLE").alias("unplaceable"),
                 F.count_if(F.col("status").isin("MOVED_SUSPECTED", "CONTESTED")).alias("conflicting"),
                 F.count_if(F.col("n_obs") > 0).alias("warm"), F.count_if(F.col("n_obs") == 0).alias("cold"),
                 F.sum("n_obs").alias("visits_known")).crossJoin(F.broadcast(recent))


@query("workload_by_cause_town", "SELECT coalesce(cause,'*') AS cause, coalesce(town_id,'*') AS town_id, count(*) AS n FROM w_task GROUP BY GROUPING SETS ((cause),(town_id))")
def workload_by_cause_town(v):
    t = decision.tasks(belief.belief_at(v, AS_OF))
    return (t.groupingSets([[F.col("cause")], [F.col("town_id")]], F.col("cause"), F.col("town_id")).agg(F.count("*").alias("n"))
            .select(F.coalesce("cause", F.lit("*")).alias("cause"), F.coalesce("town_id", F.lit("*")).alias("town_id"), "n"))


PLACES = """(SELECT b.address_id, b.town_id, tier, status, radius_m, coalesce(visits,0) AS visits, last_us, task_id IS NOT NULL AS has_task FROM w_belief b
LEFT JOIN (SELECT address_id, count(*) AS visits, max(epoch_us(observed_at)) AS last_us FROM w_evcut GROUP BY 1) USING (address_id) LEFT JOIN (SELECT address_id, task_id FROM w_task) USING (address_id)
JOIN (SELECT address_id, address_text FROM w_address) USING (address_id) WHERE tier IN ('CONFIRMED','PROBABLE','APPROXIMATE') AND contains(lower(address_text), 'cross'))"""


def places(v):
    """The place list: latest belief, activity and open task, placeable addresses whose text has a word searched for."""
    act = known_before(belief.evidence_stage(v), AS_OF).groupBy("address_id").agg(
        F.count("*").alias("visits"), F.max(F.unix_micros("observed_at")).alias("last_us"))
    b = belief.belief_at(v, AS_OF)
    t = decision.tasks(b).select("address_id", F.lit(True).alias("t"))
    j = b.join(v.address().select("address_id", "address_text"), "address_id").join(act, "address_id", "left").join(t, "address_id", "left")
    return decision.matching(j, ("address_text", "Cross"), tier=["CONFIRMED", "PROBABLE", "APPROXIMATE"]).select(
        "address_id", "town_id", "tier", "status", "radius_m", F.coalesce("visits", F.lit(0)).alias("visits"), "last_us", F.col("t").isNotNull().alias("has_task"))


@query("place_list", f"SELECT * FROM {PLACES} ORDER BY has_task DESC, last_us DESC NULLS LAST, address_id LIMIT 100 OFFSET 100")
def place_list(v):
    """Second page of the list, open tasks and newest activity first."""
    return decision.page(places(v), [F.col("has_task").desc(), F.col("last_us").desc_nulls_last(), F.col("address_id")], 2, 100)


@query("place_facets", f"""
SELECT 'tier' AS facet, tier AS value, count(*) AS n FROM {PLACES} GROUP BY ALL UNION ALL SELECT 'status', status, count(*) FROM {PLACES} GROUP BY ALL
UNION ALL SELECT 'town_id', town_id, count(*) FROM {PLACES} GROUP BY ALL UNION ALL SELECT 'has_task', has_task::VARCHAR, count(*) FROM {PLACES} GROUP BY ALL""")
def place_facets(v):
    return decision.facets(places(v), ["tier", "status", "town_id", "has_task"])


# ---- residue matchers ------------------------------------------------------------------------------
GRAMS = "list_transform(range(1, length('^'||replace({0},' ','_')||'$')-2), lambda i: substr('^'||replace({0},' ','_')||'$', i, 4))"
GENERIC_SQL = "(" + ",".join(f"'{w}'" for w in policy.RESIDUE_GENERIC_WORDS) + ")"
VIEWS["w_gidf"] = f"""
SELECT gram, df, n_docs, ln((n_docs+1)/(df+1))+1.0 AS idf FROM (SELECT gram, count(*) AS df FROM (SELECT unnest(list_distinct({GRAMS.format('norm')})) AS gram FROM (
  SELECT norm FROM w_addr UNION ALL SELECT lname FROM w_loc UNION ALL SELECT pname FROM w_lm)) GROUP BY 1),
 (SELECT (SELECT count(*) FROM w_addr) + (SELECT count(*) FROM w_loc) + (SELECT count(*) FROM w_lm) AS n_docs)"""
VIEWS["w_rtok"] = """
SELECT address_id, town_id, unnest(list_distinct(toks)) AS q FROM w_addr WHERE address_id NOT IN (SELECT address_id FROM w_locmatch)"""
VIEWS["w_ntok"] = f"""
SELECT town_id, locality_id, t, count(*) OVER (PARTITION BY locality_id) AS n_tok FROM (SELECT town_id, locality_id, unnest({toks('lname')}) AS t FROM w_loc) WHERE t NOT IN {GENERIC_SQL}"""
VIEWS["w_tvec"] = f"""
SELECT token, gram, w, sqrt(sum(w*w) OVER (PARTITION BY token)) AS nrm FROM (SELECT token, g.gram, (1.0+ln(c))*coalesce(idf, ln((SELECT max(n_docs) FROM w_gidf)+1.0)+1.0) AS w FROM (
  SELECT token, gram, count(*) AS c FROM (SELECT token, unnest({GRAMS.format('token')}) AS gram FROM (SELECT DISTINCT q AS token FROM w_rtok UNION SELECT t FROM w_ntok)) GROUP BY 1,2) g LEFT JOIN w_gidf i ON i.gram=g.gram)"""
VIEWS["w_tsim"] = """
SELECT a.token AS t, b.token AS q, round(sum(a.w*b.w)/(max(a.nrm)*max(b.nrm)),4) AS cos FROM w_tvec a JOIN w_tvec b USING (gram)
WHERE a.token IN (SELECT t FROM w_ntok) AND b.token IN (SELECT q FROM w_rtok) GROUP BY 1,2"""
VIEWS["w_rscore"] = """
SELECT address_id, locality_id, round(sum(best)/max(n_tok),4) AS score FROM (SELECT address_id, town_id, t, max(cos) AS best FROM w_rtok JOIN w_tsim USING (q) GROUP BY 1,2,3) JOIN w_ntok USING (town_id, t)
GROUP BY 1,2 HAVING round(sum(best)/max(n_tok),4) > 0"""


def _residue(v):
    addr = cand.prepared_addresses(v.address())
    loc, lm = v.locality(), v.landmark()
    res = stage(v, "residue", lambda: residue.residue_addresses(addr, cand.locality_matches(addr, loc, "2024-02-01")))
    idf = stage(v, "gram_idf", lambda: residue.gram_idf(addr, loc, lm))
    names = residue.name_tokens(loc)
    queries = res.select(F.explode("toks").alias("token"))
    sims = stage(v, "token_cosine", lambda: residue.token_cosine(names, queries, idf))
    return addr, loc, lm, res, idf, names, queries, sims


VIEWS["w_residue"] = """
SELECT address_id, locality_id, score, second FROM (SELECT *, lead(score) OVER w AS second, row_number() OVER w AS rn FROM w_rscore WINDOW w AS (PARTITION BY address_id ORDER BY score DESC, locality_id))
WHERE rn=1 AND score >= 0.35 AND (second IS NULL OR score >= 1.25*second)"""


def residue_proposals(v):
    addr, loc, lm = belief.prepared_stage(v), v.locality(), v.landmark()
    matches = stage(v, "locality_matches", lambda: cand.locality_matches(addr, loc, "2024-02-01"))
    res = stage(v, "residue", lambda: residue.residue_addresses(addr, matches))
    idf = stage(v, "gram_idf", lambda: residue.gram_idf(addr, loc, lm))
    return stage(v, "residue_proposals", lambda: residue.propose(res, residue.name_tokens(loc), idf, 0.35, 1.25))


@query("residue_tfidf", "SELECT * FROM w_residue")
def residue_tfidf(v):
    return residue_proposals(v)


@query("residue_tfidf_svd")
def residue_tfidf_svd(v):
    """Both channels: half tf-idf cosine, half cosine in the truncated SVD space."""
    addr, loc, lm, res, idf, names, queries, sims = _residue(v)
    docs = (addr.select(F.concat(F.lit("a"), "address_id").alias("doc"), "norm")
            .union(loc.select("locality_id", text.norm_text(F.col("locality_name"))))
            .union(lm.select("poi_id", text.norm_text(F.col("poi_name")))))
    load = residue.svd_loadings(docs, idf)
    both = (sims.join(residue.svd_similarity(names, queries, idf, load), ["t", "q"], "left")
            .withColumn("mix", F.round(0.5 * F.col("cos") + 0.5 * F.coalesce("svd", F.lit(0.0)), 4)))
    return residue.accept(residue.score_names(res, names, both, "mix"), 0.35, 1.25)


VIEWS["w_lslot"] = f"""
SELECT DISTINCT town_id, locality_id, slot FROM (SELECT address_id, min(locality_id) AS locality_id FROM (SELECT address_id, town_id, unnest(list_distinct(toks)) AS token FROM w_addr)
  JOIN (SELECT town_id, locality_id, unnest(ltoks) AS token FROM w_loc) USING (town_id, token) GROUP BY 1) JOIN w_slot USING (address_id)"""
VIEWS["w_slot"] = r"""
SELECT DISTINCT address_id, town_id, slot FROM (
 SELECT address_id, town_id, lower(regexp_extract(m, '([a-zA-Z]+)$', 1)) || regexp_extract(m, '^(\d{1,4})', 1) AS slot
  FROM (SELECT address_id, town_id, unnest(regexp_extract_all(norm, '(?i)\b\d{1,4}\s*(?:st|nd|rd|th)?\s*(?:cross|main|block|gali|lane|ward|sector)\b')) AS m FROM w_addr)
 UNION ALL SELECT address_id, town_id, 'house' || unnest(regexp_extract_all(norm, '(?i)\b(?:no\.?|number|h\.?\s?no\.?|house|plot|door|d\.?no|flat)\s*\.?\s*(\d{1,4})', 1)) FROM w_addr)"""
VIEWS["w_edge"] = f"""
SELECT t, q, greatest(CASE WHEN len(ga) > 0 AND len(gb) > 0 THEN len(list_intersect(ga, gb)) / sqrt(len(ga) * len(gb)) ELSE 0 END, 1.0 - {code_point_edits('t', 'q')} / greatest(length(t), length(q))) AS s
FROM (SELECT t, q, list_distinct({GRAMS.format('t')}) AS ga, list_distinct({GRAMS.format('q')}) AS gb FROM (SELECT DISTINCT t, q FROM w_rtok JOIN w_ntok USING (town_id)))"""
VIEWS["w_parser"] = """
SELECT address_id, locality_id, CASE WHEN has_slots AND slot_hit = 0 THEN round(c * 0.5 + 1e-9, 4) ELSE c END AS score, s_idf, slot_hit, has_slots FROM (
 SELECT *, round(0.5*greatest(s_text, s_idf) + 0.5*(0.5*s_idf + 0.5*slot_hit) + 1e-9, 4) AS c FROM (
  SELECT i.address_id, i.locality_id, s_idf, coalesce(r.score, 0) AS s_text, CASE WHEN h.address_id IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS slot_hit, i.address_id IN (SELECT address_id FROM w_slot) AS has_slots
  FROM (SELECT address_id, locality_id, round(sum(w*best)/sum(w) + 1e-9, 4) AS s_idf FROM (SELECT address_id, locality_id, t, coalesce(max(idf), 1.0) AS w, max(s) AS best
    FROM w_rtok JOIN (SELECT DISTINCT town_id, locality_id, t FROM w_ntok) USING (town_id) JOIN w_edge USING (t, q) LEFT JOIN w_gidf ON gram = t GROUP BY 1,2,3) GROUP BY 1,2) i
  LEFT JOIN w_rscore r USING (address_id, locality_id)
  LEFT JOIN (SELECT DISTINCT s.address_id, l.locality_id FROM w_slot s JOIN w_lslot l USING (town_id, slot)) h USING (address_id, locality_id)))"""


@query("residue_parser", """
SELECT address_id, locality_id, score, s_idf, slot_hit, has_slots, second FROM (SELECT *, lead(score) OVER w AS second, row_number() OVER w AS rn FROM w_parser WINDOW w AS (PARTITION BY address_id ORDER BY score DESC, locality_id))
WHERE rn = 1 AND score >= 0.30 AND (second IS NULL OR score >= 1.15*second) AND NOT (has_slots AND slot_hit = 0 AND second IS NULL)""")
def residue_parser(v):
    """Edit-tolerant tokens plus slot consistency; a lone slotless proposal stays silent."""
    addr, loc, _, res, idf, names, _, sims = _residue(v)
    s = residue.parser_scores(res, addr, loc, idf, residue.score_names(res, names, sims))
    best = residue.accept(s, 0.30, 1.15)
    return best.filter("not (has_slots and slot_hit = 0 and second is null)")
