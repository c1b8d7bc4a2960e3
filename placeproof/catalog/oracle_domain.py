"""Oracle views for the evidence, candidate, ranking and belief chain."""
import re

from placeproof.catalog.oracle_views import VIEWS, dist, norm, toks

AS_OF = "2024-01-08 00:00:00"

VIEWS.update({
    "w_dup": "SELECT media FROM w_obs WHERE media IS NOT NULL GROUP BY media HAVING count(*) > 1",
    "w_ev": f"""
SELECT *, CASE WHEN base = 0 THEN 0.0::DOUBLE ELSE round(
    base * f_dwell * f_long * f_gps * f_trail * f_media * f_hour, 6) END AS weight,
  strftime(observed_at, '%Y-%m') AS period, observed_at::DATE AS day,
  CASE WHEN base = 0 THEN ['outcome:'||outcome, 'negative_no_coordinate_claim'] ELSE list_sort(list_filter([
    'outcome:'||outcome,
    CASE WHEN dwell_s < 60 THEN 'dwell_short' WHEN dwell_s < 180 THEN 'dwell_brief' END,
    CASE WHEN dwell_s > 7200 THEN 'dwell_implausible' END,
    CASE WHEN gps_accuracy_m IS NULL THEN 'gps_unknown' WHEN gps_accuracy_m <= 15 THEN 'gps_fine'
      WHEN gps_accuracy_m <= 30 THEN 'gps_moderate' WHEN gps_accuracy_m <= 50 THEN 'gps_coarse'
      ELSE 'gps_very_coarse' END,
    CASE WHEN trail_agreement_m IS NULL THEN NULL WHEN trail_agreement_m <= 50 THEN 'trail_agrees'
      WHEN trail_agreement_m <= 150 THEN 'trail_loose' ELSE 'trail_disagreement' END,
    CASE WHEN media IS NULL THEN 'no_media' WHEN is_dup THEN 'duplicate_media_cluster' ELSE 'media_present' END,
    CASE WHEN f_hour = 1 THEN 'business_hours' ELSE 'off_hours' END], lambda r: r IS NOT NULL)) END AS reason_codes
FROM (SELECT *,
  CASE outcome WHEN 'met_borrower' THEN 0.95 WHEN 'met_family' THEN 0.80 WHEN 'cash_collected' THEN 1.0
    WHEN 'neighbour_says_shifted' THEN 0.35 WHEN 'locked_premises' THEN 0.45 ELSE 0.0 END::DOUBLE AS base,
  CASE WHEN dwell_s < 60 THEN 0.5 WHEN dwell_s < 180 THEN 0.8 ELSE 1.0 END::DOUBLE AS f_dwell,
  CASE WHEN dwell_s > 7200 THEN 0.7 ELSE 1.0 END::DOUBLE AS f_long,
  CASE WHEN gps_accuracy_m IS NULL THEN 0.9 WHEN gps_accuracy_m <= 15 THEN 1.0 WHEN gps_accuracy_m <= 30 THEN 0.9
    WHEN gps_accuracy_m <= 50 THEN 0.75 ELSE 0.5 END::DOUBLE AS f_gps,
  CASE WHEN trail_agreement_m IS NULL OR trail_agreement_m <= 50 THEN 1.0 WHEN trail_agreement_m <= 150 THEN 0.85
    ELSE 0.6 END::DOUBLE AS f_trail,
  CASE WHEN media IS NULL THEN 0.85 WHEN is_dup THEN 0.4 ELSE 1.0 END::DOUBLE AS f_media,
  CASE WHEN hour(observed_at + INTERVAL 330 MINUTE) BETWEEN 8 AND 18 THEN 1.0 ELSE 0.7 END::DOUBLE AS f_hour
  FROM (SELECT *, media IN (SELECT media FROM w_dup) AS is_dup FROM w_obs))""",
    "w_evcut": f"SELECT * FROM w_ev WHERE observed_at < TIMESTAMP '{AS_OF}'",
    "w_addr": f"""
SELECT *, {toks('norm')} AS toks, nullif(regexp_extract(address_text, '\\b(\\d{{6}})\\b', 1), '') AS pin_text
FROM (SELECT *, {norm('address_text')} AS norm FROM w_address)""",
    "w_loc": f"""
SELECT *, list_distinct({toks('lname')}) AS ltoks FROM (SELECT *, {norm('locality_name')} AS lname FROM w_locality)""",
    "w_idf": """
SELECT token, df, n_docs, ln((n_docs + 1) / (df + 1)) + 1.0 AS idf
FROM (SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct(toks)) AS token FROM w_addr
  WHERE added_date < DATE '2024-02-01') GROUP BY token),
 (SELECT count(*) AS n_docs FROM w_addr WHERE added_date < DATE '2024-02-01')""",
    "w_loctok": """
SELECT l.*, coalesce(df, 0) AS df,
  coalesce(idf, ln((SELECT count(*) FROM w_addr WHERE added_date < DATE '2024-02-01') + 1.0) + 1.0) AS idf,
  first_value(token) OVER (PARTITION BY locality_id ORDER BY coalesce(df,0), token) AS rare
FROM (SELECT town_id, locality_id, len(ltoks) AS n_name, unnest(ltoks) AS token FROM w_loc) l LEFT JOIN w_idf USING (token)""",
    "w_lochit": """
SELECT address_id, locality_id, n_name, round(count(*)/n_name, 6) AS coverage, round(sum(idf), 6) AS idf_sum,
  bool_or(token = rare) AS has_rare
FROM (SELECT address_id, town_id, unnest(list_distinct(toks)) AS token FROM w_addr) JOIN w_loctok USING (town_id, token)
GROUP BY address_id, locality_id, n_name HAVING count(*)/n_name >= 0.5 AND bool_or(token = rare)""",
    "w_locbest": """
SELECT address_id, locality_id, coverage, idf_sum FROM w_lochit
QUALIFY row_number() OVER (PARTITION BY address_id ORDER BY coverage DESC, idf_sum DESC, n_name DESC, locality_id) = 1""",
    "w_locmatch": """
SELECT address_id, locality_id, coverage, idf_sum, 'idf_token_match' AS match FROM w_locbest
UNION ALL
SELECT address_id, locality_id, NULL, NULL, 'pincode_match' FROM w_addr a JOIN w_loc l
  ON a.town_id = l.town_id AND pin_text = pincode
WHERE address_id NOT IN (SELECT address_id FROM w_locbest)""",
    "w_towncent": "SELECT town_id, avg(cx) AS tcx, avg(cy) AS tcy FROM w_loc GROUP BY town_id",
    "w_relpos": """
SELECT address_id, town_id, toks, min_by(struct_pack(i := i, rel := rel), i) AS m FROM (
  SELECT address_id, town_id, toks, i, CASE
    WHEN toks[i]='close' AND toks[i+1]='to' THEN 'close to' WHEN toks[i]='next' AND toks[i+1]='to' THEN 'next to'
    WHEN toks[i] IN ('opposite','opp','near','behind','beside','adjacent','ಹತ್ತಿರ') THEN toks[i] END AS rel
  FROM (SELECT *, unnest(range(1, len(toks)+1)) AS i FROM w_addr)) WHERE rel IS NOT NULL GROUP BY address_id, town_id, toks""",
    "w_relwin": """
SELECT address_id, town_id, m.rel AS rel, toks[greatest(1, m.i-3):m.i-1] AS bef,
  toks[m.i + CASE WHEN m.rel IN ('close to','next to') THEN 2 ELSE 1 END : m.i + CASE WHEN m.rel IN ('close to','next to') THEN 2 ELSE 1 END + 2] AS aft
FROM w_relpos""",
    "w_lm": f"SELECT *, list_distinct({toks('pname')}) AS ptoks FROM (SELECT *, {norm('poi_name')} AS pname FROM w_landmark)",
    "w_lmhit": """
SELECT address_id, poi_id, rel, score, count(*) OVER (PARTITION BY address_id) AS n_hits,
  row_number() OVER (PARTITION BY address_id ORDER BY poi_id) AS rn FROM (
  SELECT address_id, poi_id, rel, sum(pts)::BIGINT AS score, max(sum(pts)) OVER (PARTITION BY address_id) AS best FROM (
    SELECT address_id, town_id, rel, unnest(list_distinct(aft)) AS token, 2 AS pts FROM w_relwin
    UNION ALL SELECT address_id, town_id, rel, unnest(list_distinct(bef)), 1 FROM w_relwin)
  JOIN (SELECT town_id, poi_id, unnest(ptoks) AS token FROM w_lm) USING (town_id, token)
  GROUP BY address_id, poi_id, rel) WHERE score = best""",
    "w_book": """
SELECT a.address_id, min(b.address_id) AS other FROM w_addr a JOIN w_addr b
  ON a.town_id = b.town_id AND a.norm = b.norm AND a.address_id <> b.address_id
WHERE a.norm <> '' AND b.address_id IN (SELECT address_id FROM w_pin) GROUP BY a.address_id""",
    "w_pos": """
SELECT * FROM w_evcut WHERE polarity = 'positive' AND weight >= 0.35 AND x IS NOT NULL""",
    "w_cons": f"""
SELECT m.*, spread FROM (SELECT address_id, count(*) AS n, quantile_cont(x,0.5) AS mx, quantile_cont(y,0.5) AS my,
  quantile_cont(gps_accuracy_m,0.5) AS acc, max(observed_at) AS last_at FROM w_pos WHERE weight >= 0.5
  GROUP BY address_id HAVING count(*) >= 2) m
JOIN (SELECT p.address_id, max({dist('p.x','p.y','q.mx','q.my')}) AS spread FROM w_pos p JOIN (
  SELECT address_id, quantile_cont(x,0.5) AS mx, quantile_cont(y,0.5) AS my FROM w_pos WHERE weight >= 0.5 GROUP BY address_id) q
  USING (address_id) WHERE weight >= 0.5 GROUP BY p.address_id) USING (address_id)
WHERE spread <= 30""",
    "w_union": """
SELECT address_id, 'frozen_baseline' AS arm, 1 AS arm_index, 'baseline:'||precision AS source_ref, geocoder_x AS x,
  geocoder_y AS y, CASE precision WHEN 'pincode' THEN 'locality' ELSE precision END AS granularity, 1 AS arm_rank,
  precision AS stratum, precision AS baseline_precision, NULL::BOOLEAN AS primary_eligible, NULL::BOOLEAN AS ambiguous FROM w_pin
UNION ALL SELECT address_id, 'locality_centroid', 2, 'locality:'||locality_id, cx, cy, 'locality', 1, 'locality', NULL, NULL, NULL
  FROM w_locmatch JOIN w_loc USING (locality_id)
UNION ALL SELECT address_id, 'town_centroid', 3, 'town:'||town_id, round(tcx,3), round(tcy,3), 'town', 1, 'town', NULL, NULL, NULL
  FROM w_addr JOIN w_towncent USING (town_id)
UNION ALL SELECT address_id, 'official_landmark', 4, 'landmark:'||poi_id, px, py, 'locality', rn, 'locality', NULL, NULL, n_hits > 1
  FROM w_lmhit JOIN w_landmark USING (poi_id) WHERE rn <= 2
UNION ALL SELECT b.address_id, 'address_book', 5, 'address:'||other, geocoder_x, geocoder_y,
  CASE precision WHEN 'pincode' THEN 'locality' ELSE precision END, 1, precision, NULL, NULL, NULL
  FROM w_book b JOIN w_pin p ON p.address_id = other
UNION ALL SELECT address_id, 'field_evidence', 6, 'visit:'||observation_id, x, y, 'street', rn, 'street', NULL, FALSE, NULL
  FROM (SELECT *, row_number() OVER (PARTITION BY address_id ORDER BY weight DESC, observation_id) AS rn FROM w_pos) WHERE rn <= 3
UNION ALL SELECT address_id, 'field_evidence', 6, 'visits:median('||n||')', round(mx,3), round(my,3),
  CASE WHEN acc <= 15 THEN 'rooftop' ELSE 'street' END, 1, CASE WHEN acc <= 15 THEN 'rooftop' ELSE 'street' END, NULL, TRUE, NULL
  FROM w_cons""",
    "w_cand0": f"""
SELECT *, 'c-'||substr(sha1(arm||'|'||address_id||'|'||source_ref),1,12) AS candidate_id FROM w_union u
WHERE arm <> 'official_landmark' OR NOT EXISTS (SELECT 1 FROM w_union o WHERE o.address_id = u.address_id AND o.arm <> 'official_landmark')
  OR EXISTS (SELECT 1 FROM w_union o WHERE o.address_id = u.address_id AND o.arm <> 'official_landmark'
     AND {dist('u.x','u.y','o.x','o.y')} <= 1000)""",
    "w_namebest": """
SELECT address_id, max_by(j, (j, lname)) AS j, max_by(lname, (j, lname)) AS lname, max(ratio) AS ratio FROM (
  SELECT address_id, lname, CASE WHEN len(toks)=0 AND len(ltoks)=0 THEN 0 ELSE
    len(list_intersect(list_distinct(toks), ltoks)) / len(list_distinct(list_concat(toks, ltoks))) END AS j,
    1.0 - levenshtein(norm, lname) / greatest(length(norm), length(lname)) AS ratio
  FROM w_addr JOIN (SELECT DISTINCT town_id, lname, ltoks FROM w_loc) USING (town_id)) GROUP BY address_id""",
    "w_char": """
SELECT address_id, round(CASE WHEN lname IS NULL THEN 0 ELSE
  len(list_intersect(g1, g2)) / greatest(1, len(list_distinct(list_concat(g1, g2)))) END, 4) AS f_sim_char3
FROM (SELECT address_id, lname,
  list_distinct(list_transform(range(1, length(t)-1), lambda i: substr(t, i, 3))) AS g1,
  list_distinct(list_transform(range(1, length(u)-1), lambda i: substr(u, i, 3))) AS g2
  FROM (SELECT address_id, lname, replace(norm,' ','') AS t, replace(lname,' ','') AS u FROM w_addr LEFT JOIN w_namebest USING (address_id)))""",
    "w_afeat": """
SELECT a.address_id, a.town_id, tcx, tcy, (coalesce(j,0) > 0)::INTEGER AS f_locality_name_matched,
  (pin_text IS NOT NULL)::INTEGER AS f_pin_in_text,
  (pin_text IS NOT NULL AND NOT EXISTS (SELECT 1 FROM w_loc l WHERE l.town_id = a.town_id AND l.pincode = a.pin_text))::INTEGER AS f_pin_unknown,
  (NOT regexp_matches(address_text, '[0-9]'))::INTEGER AS f_no_digit, (NOT contains(address_text, ','))::INTEGER AS f_no_separator,
  (a.town_id = 'OUT')::INTEGER AS f_outside_town, round(coalesce(j,0),4) AS f_sim_jaccard, f_sim_char3,
  round(coalesce(ratio,0),4) AS f_sim_ratio
FROM w_addr a LEFT JOIN w_namebest USING (address_id) LEFT JOIN w_char USING (address_id) LEFT JOIN w_towncent t ON t.town_id = a.town_id""",
})


def agreement(source: str) -> str:
    """Agreement counts over a candidate relation."""
    return f"""
SELECT c.*, coalesce(agreement_arms, 0) AS agreement_arms, coalesce(n_near, 0) AS f_agreement_count,
  count(*) OVER (PARTITION BY c.address_id) AS f_n_candidates
FROM {source} c LEFT JOIN (
  SELECT a.candidate_id, count(DISTINCT b.arm) AS agreement_arms, count(*) AS n_near FROM {source} a JOIN {source} b
    ON a.address_id = b.address_id AND a.candidate_id <> b.candidate_id AND {dist('a.x','a.y','b.x','b.y')} <= 150
  GROUP BY a.candidate_id) USING (candidate_id)"""


PRIOR = """CASE arm WHEN 'field_evidence' THEN 0.62 WHEN 'memory' THEN 0.55 WHEN 'frozen_baseline' THEN 0.50
  WHEN 'official_landmark' THEN 0.45 WHEN 'address_book' THEN 0.42 WHEN 'locality_centroid' THEN 0.38 ELSE 0.15 END::DOUBLE"""
GRAN = "CASE granularity WHEN 'rooftop' THEN 1.0 WHEN 'street' THEN 0.85 WHEN 'locality' THEN 0.60 ELSE 0.25 END::DOUBLE"


def scored(source: str) -> str:
    """Rule score and rank over a candidate relation with agreement counts."""
    return f"""
SELECT *, row_number() OVER (PARTITION BY address_id ORDER BY score DESC, candidate_id) AS rank FROM (
SELECT c.*, f.* EXCLUDE (address_id), {PRIOR} AS f_arm_prior, {GRAN} AS f_granularity_rank,
  round({dist('x','y','tcx','tcy')}, 1) AS f_dist_to_town_centroid_m,
  round({PRIOR} + 0.12::DOUBLE*{GRAN}
   + CASE WHEN arm='frozen_baseline' AND baseline_precision IN ('locality','pincode') THEN -0.06 ELSE 0 END::DOUBLE
   + CASE WHEN arm='frozen_baseline' AND baseline_precision='rooftop' THEN 0.04 ELSE 0 END::DOUBLE
   + CASE WHEN primary_eligible THEN 0.08 ELSE 0 END::DOUBLE + CASE WHEN ambiguous THEN -0.08 ELSE 0 END::DOUBLE
   + CASE WHEN f_locality_name_matched=1 THEN 0.05 ELSE 0 END::DOUBLE
   + CASE WHEN f_pin_in_text=1 AND f_pin_unknown=0 THEN 0.04 ELSE 0 END::DOUBLE
   + CASE WHEN f_pin_unknown=1 THEN -0.05 ELSE 0 END::DOUBLE + CASE WHEN f_no_digit=1 THEN -0.03 ELSE 0 END::DOUBLE
   + CASE WHEN f_outside_town=1 THEN -0.20 ELSE 0 END::DOUBLE + round(0.05::DOUBLE*f_sim_jaccard,6)
   + round(0.03::DOUBLE*f_sim_char3,6) + round(0.04::DOUBLE*least(f_agreement_count,3),6), 6) AS score
FROM {source} c JOIN w_afeat f USING (address_id))"""


VIEWS["w_cand"] = agreement("w_cand0")
VIEWS["w_ranked0"] = scored("w_cand")


def belief(ranked: str) -> str:
    return f"""
SELECT *, CASE WHEN tier = 'UNPLACEABLE' THEN NULL WHEN n_neg >= 1 THEN 'negative_accumulation' WHEN stale THEN 'stale_pack' WHEN stratum <> 'locality'
   THEN 'calibration_fallback' END AS widen_reason,
  CASE WHEN tier <> 'UNPLACEABLE' THEN round(539.9::DOUBLE * ((CASE tier WHEN 'PROBABLE' THEN 1.25 WHEN 'APPROXIMATE' THEN 1.5 ELSE 1.0 END::DOUBLE)
   * CASE WHEN n_neg >= 1 THEN least(1.5::DOUBLE, 1.0 + 0.05::DOUBLE*n_neg) * CASE WHEN n_neg >= 2 THEN 1.35 ELSE 1.0 END::DOUBLE ELSE 1.0 END
   * CASE WHEN stale THEN 1.2 ELSE 1.0 END::DOUBLE), 1) END AS radius_m
FROM (SELECT *, CASE WHEN n_neg >= 2 AND tier0 IN ('CONFIRMED','PROBABLE') THEN 'APPROXIMATE' ELSE tier0 END AS tier,
  (n_neg >= 2 AND tier0 IN ('CONFIRMED','PROBABLE')) AS negative_cap,
  CASE WHEN contested THEN 'CONTESTED' WHEN n_neg >= 2 THEN 'MOVED_SUSPECTED' WHEN stale THEN 'STALE' ELSE 'STABLE' END AS status
FROM (SELECT *, CASE WHEN candidate_id IS NULL THEN 'UNPLACEABLE' WHEN contested THEN 'APPROXIMATE' WHEN promoted THEN 'CONFIRMED' WHEN n_strong_eff >= 1 THEN 'PROBABLE'
   WHEN n_weak_eff >= 2 THEN 'PROBABLE' WHEN granularity IN ('street','rooftop') AND agreement_arms > 0 THEN 'PROBABLE'
   ELSE 'APPROXIMATE' END AS tier0,
  CASE WHEN candidate_id IS NULL THEN 'no_candidate' WHEN contested THEN 'contested_supports' WHEN promoted THEN 'field_confirmed_x'||greatest(n_strong_eff, 2)
   WHEN n_strong_eff >= 1 THEN 'field_confirmed_x1' WHEN n_weak_eff >= 2 THEN 'weak_positives_x2'
   WHEN granularity IN ('street','rooftop') AND agreement_arms > 0 THEN 'fine_pin_with_cross_arm_agreement'
   WHEN granularity = 'town' THEN 'town_anchor_only' ELSE 'cold_start_no_field_evidence' END AS tier_reason,
  (NOT contested AND n_neg < 2 AND newest_pos IS NOT NULL AND epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(newest_pos) > 365*86400000000) AS stale
FROM (SELECT p.address_id, p.town_id, TIMESTAMP '{AS_OF}' AS as_of, coalesce(n_obs,0)+1 AS belief_version, candidate_id, arm, x, y, granularity,
  coalesce(stratum,'locality') AS stratum, primary_eligible, score, agreement_arms, coalesce(promoted,FALSE) AS promoted, coalesce(spread > 2*809.8::DOUBLE, FALSE) AS contested,
  round(spread,1) AS spread_m, coalesce(n_obs,0) AS n_obs, coalesce(n_pos,0) AS n_pos, coalesce(n_strong,0) AS n_strong,
  coalesce(n_neg,0) AS n_neg, coalesce(positive_weight_sum,0) AS positive_weight_sum, newest_pos,
  coalesce(n_strong_eff,0) AS n_strong_eff, coalesce(n_weak_eff,0) AS n_weak_eff
FROM (SELECT f.address_id, f.town_id, r.* EXCLUDE (address_id, town_id) FROM w_afeat f LEFT JOIN (SELECT * FROM {ranked}
  QUALIFY row_number() OVER (PARTITION BY address_id ORDER BY coalesce(primary_eligible, TRUE) DESC, rank) = 1) r USING (address_id)) p
LEFT JOIN (
 SELECT a.*, CASE WHEN n_xy = n_strong AND n_strong >= 2 THEN far END AS spread,
  n_strong >= 2 AND (n_collectors >= 2 OR n_periods >= 2 OR (first_day < DATE '2024-01-15' AND last_day >= DATE '2024-01-15')
   OR last_day - first_day >= 7) AND n_with_media = n_strong AND n_media = n_strong AS promoted
 FROM (SELECT address_id, count(*) AS n_obs, count(*) FILTER (pos) AS n_pos, count(*) FILTER (strong) AS n_strong,
   count(*) FILTER (pos AND w_eff >= 0.5) AS n_strong_eff, count(*) FILTER (pos AND w_eff >= 0.35 AND w_eff < 0.5) AS n_weak_eff,
   round(sum(w_eff) FILTER (pos), 6) AS positive_weight_sum, max(observed_at) FILTER (pos) AS newest_pos,
   count(DISTINCT agent_id||'|'||period||'|'||coalesce(media,'')) FILTER (polarity='negative') AS n_neg,
   count(DISTINCT agent_id) FILTER (strong) AS n_collectors, count(DISTINCT period) FILTER (strong) AS n_periods,
   count(DISTINCT media) FILTER (strong) AS n_media, count(media) FILTER (strong) AS n_with_media,
   min(day) FILTER (strong) AS first_day, max(day) FILTER (strong) AS last_day, count(x) FILTER (strong) AS n_xy
  FROM (SELECT e.*, polarity='positive' AND weight>=0.35 AS pos, polarity='positive' AND weight>=0.5 AS strong,
    round(weight * round(pow(0.5, ((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(observed_at))/86400e6)/30.44::DOUBLE/
     CASE coalesce(g.granularity,'locality') WHEN 'rooftop' THEN 24.0 WHEN 'street' THEN 18.0 WHEN 'locality' THEN 12.0 ELSE 6.0 END::DOUBLE),6),6) AS w_eff
    FROM w_evcut e LEFT JOIN (SELECT address_id, granularity FROM {ranked} WHERE rank = 1) g USING (address_id)) GROUP BY address_id) a
 LEFT JOIN (SELECT e.address_id, max({dist('e.x','e.y','m.mx','m.my')}) AS far FROM w_evcut e JOIN (
    SELECT address_id, quantile_cont(x,0.5) AS mx, quantile_cont(y,0.5) AS my FROM w_evcut WHERE polarity='positive' AND weight>=0.5
    GROUP BY address_id) m USING (address_id) WHERE polarity='positive' AND weight>=0.5 GROUP BY e.address_id) USING (address_id)
) s USING (address_id))))"""


VIEWS["w_prior"] = belief("w_ranked0")
VIEWS["w_cand1"] = """
SELECT * EXCLUDE (agreement_arms, f_agreement_count, f_n_candidates) FROM w_cand
UNION ALL BY NAME SELECT address_id, 'memory' AS arm, 7 AS arm_index, 'memory:'||address_id||'@v'||belief_version AS source_ref, x, y,
  granularity, 1 AS arm_rank, stratum, NULL AS baseline_precision, tier IN ('CONFIRMED','PROBABLE') AS primary_eligible, NULL AS ambiguous,
  'c-'||substr(sha1('memory|'||address_id||'|memory:'||address_id||'@v'||belief_version),1,12) AS candidate_id
FROM w_prior WHERE arm = 'field_evidence'"""
VIEWS["w_candm"] = agreement("w_cand1")
VIEWS["w_ranked"] = scored("w_candm")
VIEWS["w_belief"] = belief("w_ranked")

VIEWS["w_promo"] = """
SELECT *, n_strong >= 2 AND (n_collectors >= 2 OR period_ok) AND media_ok AS promoted FROM (SELECT *,
  n_periods >= 2 OR (first_day < DATE '2024-01-15' AND last_day >= DATE '2024-01-15') OR last_day - first_day >= 7 AS period_ok,
  n_strong >= 2 AND n_with_media = n_strong AND n_media = n_strong AS media_ok
FROM (SELECT address_id, count(*) AS n_strong, count(DISTINCT agent_id) AS n_collectors, count(DISTINCT period) AS n_periods, count(DISTINCT media) AS n_media,
 count(media) AS n_with_media, min(day) AS first_day, max(day) AS last_day FROM w_ev WHERE polarity='positive' AND weight >= 0.5 GROUP BY 1))"""
VIEWS["w_label"] = """
SELECT address_id, quantile_cont(x,0.5) AS lx, quantile_cont(y,0.5) AS ly, count(*) AS n_label FROM w_evcut WHERE polarity='positive' AND weight>=0.5 AND x IS NOT NULL
GROUP BY 1 HAVING count(*) >= 2"""

EARLY = "2024-01-03 00:00:00"
CUT_VIEWS = ["w_evcut", "w_pos", "w_cons", "w_union", "w_cand0", "w_cand", "w_ranked0", "w_prior", "w_cand1", "w_candm",
             "w_ranked", "w_belief"]


def at_cut(suffix: str, as_of: str) -> None:
    """The same chain of views at another cut, under suffixed names."""
    for name in CUT_VIEWS:
        text = VIEWS[name].replace(AS_OF, as_of)
        for other in CUT_VIEWS:
            text = re.sub(rf"\b{other}\b", other + suffix, text)
        VIEWS[name + suffix] = text


at_cut("_early", EARLY)
VIEWS["w_hist"] = "SELECT 1 AS v, * FROM w_belief_early UNION ALL BY NAME SELECT 2 AS v, * FROM w_belief"
VIEWS["w_purpose"] = """
SELECT address_id, coalesce(n_met,0) AS n_met, CASE WHEN address_type='office' THEN 'WORK_LIKE' WHEN n_met >= 2 THEN CASE WHEN coalesce(promoted,FALSE) AND dwell_ok
  AND n_weekday >= greatest(1, n_met//2) AND n_daytime >= n_met-1 THEN 'HOME_LIKE' ELSE 'UNKNOWN' END WHEN address_type='permanent_native' THEN 'OTHER' ELSE 'UNKNOWN' END AS purpose
FROM w_address LEFT JOIN (SELECT address_id, count(*) AS n_met, bool_and(coalesce(dwell_s,0) >= 180) AS dwell_ok,
  count(*) FILTER (isodow(observed_at + INTERVAL 330 MINUTE) <= 5) AS n_weekday, count(*) FILTER (hour(observed_at + INTERVAL 330 MINUTE) BETWEEN 8 AND 18) AS n_daytime
  FROM w_evcut WHERE polarity='positive' AND weight >= 0.5 GROUP BY 1) USING (address_id) LEFT JOIN (SELECT address_id,
   count(*) >= 2 AND (count(DISTINCT agent_id) >= 2 OR count(DISTINCT period) >= 2 OR (min(day) < DATE '2024-01-15' AND max(day) >= DATE '2024-01-15') OR max(day)-min(day) >= 7)
   AND count(media)=count(*) AND count(DISTINCT media)=count(*) AS promoted FROM w_evcut WHERE polarity='positive' AND weight>=0.5 GROUP BY 1) USING (address_id)"""


def decision_view(request: str) -> str:
    strict = "TRUE" if request in ("NOTICE_SERVICE", "VISIT_PLANNING") else "FALSE"
    rules = [("purpose='OTHER'", "REFUSE", "'purpose_other'"), ("purpose='WORK_LIKE'", "REFUSE", "'purpose_work_like'"),
             ("purpose='UNKNOWN' AND tier IN ('CONFIRMED','PROBABLE') AND status='STABLE' AND n_neg=0", "VERIFY_FIRST", "'purpose_unknown'"),
             (f"purpose='UNKNOWN' AND {strict}", "REFUSE", "'purpose_unknown_low_confidence'"),
             ("purpose='UNKNOWN'", "VERIFY_FIRST", "CASE WHEN tier='APPROXIMATE' THEN 'tier_approximate' ELSE 'unplaceable' END"),
             ("status IN ('CONTESTED','MOVED_SUSPECTED')", "VERIFY_FIRST", "CASE WHEN n_neg>0 THEN 'negatives_accumulated' ELSE 'status_contested' END"),
             ("tier='UNPLACEABLE'", "VERIFY_FIRST", "'unplaceable'"), ("n_neg>=2", "VERIFY_FIRST", "'negatives_accumulated'"),
             ("tier IN ('CONFIRMED','PROBABLE')", "SERVE", "CASE WHEN tier='CONFIRMED' THEN 'purpose_home_like' ELSE 'tier_probable' END")]
    act = " ".join(f"WHEN {c} THEN '{a}'" for c, a, _ in rules)
    why = " ".join(f"WHEN {c} THEN {r}" for c, _, r in rules)
    return f"SELECT *, CASE {act} ELSE 'VERIFY_FIRST' END AS action, CASE {why} ELSE 'tier_approximate' END AS reason FROM w_belief JOIN w_purpose USING (address_id)"


VIEWS["w_decision"] = decision_view("FIELD_NAVIGATION")
VIEWS["w_decision_strict"] = decision_view("NOTICE_SERVICE")
VIEWS["w_task"] = """
SELECT 'VF-'||address_id||'-'||status AS task_id, address_id, town_id, status AS cause, CASE status WHEN 'CONTESTED' THEN 0.9 ELSE 0.8 END::DOUBLE AS priority, as_of AS raised_at,
  tier, radius_m, n_neg FROM w_belief WHERE status IN ('MOVED_SUSPECTED','CONTESTED')"""

at_cut("_whatif", AS_OF)
VIEWS["w_evcut_whatif"] = """
SELECT * FROM w_evcut UNION ALL BY NAME SELECT -(address_id*2+n) AS observation_id, address_id, 'R'||n AS agent_id, 'no_such_person' AS outcome, 'negative' AS polarity, 0.0::DOUBLE AS weight,
 '2024-01' AS period, DATE '2024-01-07' AS day, TIMESTAMP '2024-01-07 12:00:00' AS observed_at FROM (SELECT DISTINCT address_id FROM w_evcut), (SELECT unnest([1,2]) AS n)"""


def found_records(queries: str) -> str:
    """Record lookup over a relation (qid, town_id, qtext)."""
    from placeproof.policy import GENERIC_WORDS
    generic = "(" + ",".join(f"'{w}'" for w in GENERIC_WORDS) + ")"
    return f"""(WITH q AS (SELECT *, list_sort(list_distinct({toks('norm')})) AS qt, nullif(regexp_extract(qtext,'\\b(\\d{{6}})\\b',1),'') AS qpin FROM (SELECT *, {norm('qtext')} AS norm FROM {queries})),
 ex AS (SELECT qid, min(a.address_id) AS hit FROM q JOIN w_addr a ON a.town_id=q.town_id AND a.norm=q.norm WHERE q.norm <> '' GROUP BY 1),
 sc AS (SELECT qid, a.address_id, len(list_intersect(qt, list_distinct(a.toks))) / len(list_distinct(list_concat(qt, a.toks))) AS j FROM q JOIN w_addr a ON a.town_id=q.town_id AND len(a.toks) > 0
   WHERE qid NOT IN (SELECT qid FROM ex) AND len(list_filter(qt, lambda t: regexp_full_match(t,'[0-9]+') AND NOT list_contains(a.toks, t))) = 0),
 fz AS (SELECT qid, address_id AS fuzzy FROM (SELECT *, row_number() OVER w AS rn, lead(j) OVER w AS j2 FROM sc WHERE j >= 0.85 WINDOW w AS (PARTITION BY qid ORDER BY j DESC, address_id)) WHERE rn=1 AND (j2 IS NULL OR j2 + 0.10::DOUBLE <= j)),
 pn AS (SELECT town_id, pincode AS qpin, min(locality_id) AS pin_loc FROM w_locality GROUP BY 1,2 HAVING count(*)=1),
 nm AS (SELECT qid, locality_id AS name_loc FROM (SELECT qid, locality_id, count(*) AS n, row_number() OVER w AS rn, lead(count(*)) OVER w AS nx FROM (SELECT qid, town_id, unnest(qt) AS token FROM q)
   JOIN (SELECT town_id, locality_id, unnest(ltoks) AS token FROM w_loc) USING (town_id, token) WHERE token NOT IN {generic} GROUP BY 1,2 WINDOW w AS (PARTITION BY qid ORDER BY count(*) DESC, locality_id)) WHERE rn=1 AND (nx IS NULL OR nx < n))
SELECT q.qid, coalesce(hit, fuzzy) AS address_id, CASE WHEN q.norm='' THEN 'empty_text' WHEN hit IS NOT NULL THEN 'exact_text_match' WHEN fuzzy IS NOT NULL THEN 'fuzzy_text_match'
 WHEN coalesce(pin_loc, name_loc) IS NOT NULL THEN 'area_context:'||coalesce(pin_loc, name_loc) ELSE 'no_match' END AS how
FROM q LEFT JOIN ex USING (qid) LEFT JOIN fz USING (qid) LEFT JOIN pn ON pn.town_id=q.town_id AND pn.qpin=q.qpin LEFT JOIN nm USING (qid))"""
