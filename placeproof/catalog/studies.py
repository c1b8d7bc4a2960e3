"""Studies over whole tables: holdouts with both lanes, routing, bounds, displacement, siblings, reviewer decisions, hierarchy checks."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from placeproof import policy
from placeproof.catalog import query
from placeproof.catalog.aggregates import MET, met, rate
from placeproof.catalog.domain import MEMBER, members
from placeproof.catalog.evaluation import CUT_POINTS, HITS, labels, surveyed_scored
from placeproof.catalog.joins import blocks_stage
from placeproof.catalog.oracle_domain import AS_OF, EARLY, VIEWS, agreement, at_cut, scored
from placeproof.catalog.oracle_views import dist
from placeproof.functions.geo import distance
from placeproof.operators import spatial
from placeproof.operators.asof import known_before
from placeproof.operators.hull import group_diameter
from placeproof.operators.leave_one_out import leave_one_out_median
from placeproof.operators.profile import union_all
from placeproof.operators.quantiles import group_quantiles
from placeproof.plans import adjudication, belief, candidates as cand, evaluation as ev, history, ranking
from placeproof.sources.stages import stage

STATIC = "('" + "','".join(policy.STATIC_ARMS) + "')"
VIEWS["w_union_cold"] = f"SELECT * FROM w_union WHERE arm IN {STATIC}"
VIEWS["w_cand0_cold"] = VIEWS["w_cand0"].replace("w_union", "w_union_cold")
VIEWS["w_cand_cold"] = agreement("w_cand0_cold")
VIEWS["w_ranked_cold"] = scored("w_cand_cold")
VIEWS["w_colderr"] = f"SELECT r.*, lx, ly, {dist('x', 'y', 'lx', 'ly')} AS err FROM w_ranked_cold r JOIN w_label USING (address_id)"
VIEWS["w_arch"] = """
SELECT address_id, CASE WHEN regexp_matches(norm,'\\b(near|opposite|behind|beside|adjacent|next to)\\b') THEN 'landmark-relation' WHEN p AND r AND h THEN 'pincode+road+house'
  WHEN p AND r THEN 'pincode+road' WHEN r THEN 'road-only' WHEN regexp_matches(address_text,'[\\x{0C01}-\\x{FFFF}]') THEN 'multi-script' ELSE 'plain' END AS archetype
FROM (SELECT *, len(list_filter(w, lambda x: regexp_full_match(x,'[0-9]{6}')))>0 AS p, len(list_intersect(w,['gali','road','cross','main','street']))>0 AS r,
  len(list_filter(w, lambda x: regexp_full_match(x,'[0-9]+')))>0 AS h FROM (SELECT *, string_split(norm,' ') AS w FROM w_addr))"""


def cold_ranked(v):
    """Ranked candidates of the static arms alone: what stands before any visit."""
    def build():
        belief.inputs(v)
        sets = cand.with_agreement(cand.candidate_sets(belief.static_stage(v)))
        return ranking.exploded(ranking.ranked_sets(sets, belief.features_stage(v)))
    return stage(v, "cold_ranked", build)


def measured(df, keys):
    """n, hits and median error per key."""
    a = df.groupBy(*keys).agg(F.count("*").alias("n"), *ev.hits())
    q = group_quantiles(df, keys, "err", {"median": 0.5}).drop("n")
    return a.join(q, keys).withColumn("median", F.round("median", 3))


MEASURED = f"count(*) AS n, {HITS}, round(quantile_cont(err,0.5),3) AS median"


def gap(a, b, c, d):
    return distance(F.col(a), F.col(b), F.col(c), F.col(d))


@query("demotion_bound", f"""
WITH f AS (SELECT address_id, x AS fx, y AS fy, err AS ferr, arm='frozen_baseline' AND baseline_precision='pincode' AS coarse FROM w_errs WHERE rank=1),
 a AS (SELECT e.address_id, min_by(e.err, e.rank) AS aerr FROM w_errs e JOIN f USING (address_id) WHERE coarse AND e.rank>1 AND e.arm<>'frozen_baseline' AND {dist('e.x','e.y','fx','fy')} <= 800 GROUP BY 1)
SELECT count(*) AS n, count(*) FILTER (coarse) AS n_coarse, count(aerr) AS n_demoted, count(*) FILTER (ferr>500 AND aerr<=500) AS n_fixed, count(*) FILTER (ferr<=500 AND aerr>500) AS n_broken, count(*) FILTER (aerr<ferr) AS n_closer,
 count(*) FILTER (aerr>ferr) AS n_farther, round(avg((ferr<=500)::INTEGER),4) AS rule_hit_500m, round(avg((coalesce(aerr,ferr)<=500)::INTEGER),4) AS demoted_hit_500m, round(avg((least(ferr,coalesce(aerr,ferr))<=500)::INTEGER),4) AS bound_hit_500m
FROM f LEFT JOIN a USING (address_id)""")
def demotion_bound(v):
    """Demotion of coarse pins: what it mends and breaks at 500 m, and what choosing always right between the two could reach."""
    s = surveyed_scored(v)
    f = s.filter("rank = 1").select("address_id", F.col("x").alias("fx"), F.col("y").alias("fy"), F.col("err").alias("ferr"),
                                    ((F.col("arm") == "frozen_baseline") & F.col("baseline_precision").eqNullSafe("pincode")).alias("coarse"))
    near = s.filter("rank > 1 and arm <> 'frozen_baseline'").join(f.filter("coarse"), "address_id").filter(gap("x", "y", "fx", "fy") <= 800)
    j = f.join(near.groupBy("address_id").agg(F.min_by("err", "rank").alias("aerr")), "address_id", "left")
    r, a = F.col("ferr"), F.col("aerr")
    share = lambda e, name: F.round(F.avg((e <= 500).cast("int")), 4).alias(name)
    return j.agg(F.count("*").alias("n"), F.count_if("coarse").alias("n_coarse"), F.count("aerr").alias("n_demoted"), F.count_if((r > 500) & (a <= 500)).alias("n_fixed"),
                 F.count_if((r <= 500) & (a > 500)).alias("n_broken"), F.count_if(a < r).alias("n_closer"), F.count_if(a > r).alias("n_farther"),
                 share(r, "rule_hit_500m"), share(F.coalesce(a, r), "demoted_hit_500m"), share(F.least(r, a), "bound_hit_500m"))


def _lanes_sql(t0):
    ev0 = "polarity='positive' AND x IS NOT NULL"
    return f"""SELECT '{t0[:10]}' AS cut, lane, {MEASURED} FROM (WITH fut AS (SELECT address_id, quantile_cont(x,0.5) AS lx, quantile_cont(y,0.5) AS ly FROM w_ev WHERE observed_at >= TIMESTAMP '{t0}' AND {ev0} AND weight>=0.5 GROUP BY 1),
 past AS (SELECT * FROM w_ev WHERE observed_at < TIMESTAMP '{t0}' AND {ev0} AND weight>=0.35),
 md AS (SELECT address_id, round(mx,3) AS mx, round(my,3) AS my FROM (SELECT address_id, count(*) AS n, quantile_cont(x,0.5) AS mx, quantile_cont(y,0.5) AS my FROM past WHERE weight>=0.5 GROUP BY 1 HAVING count(*)>=2) m JOIN past p USING (address_id) WHERE p.weight>=0.5
  GROUP BY ALL HAVING max({dist('p.x','p.y','mx','my')}) <= 30),
 sg AS (SELECT address_id, x, y FROM past QUALIFY row_number() OVER (PARTITION BY address_id ORDER BY weight DESC, observation_id) = 1),
 j AS (SELECT f.*, md.mx, md.my, sg.x AS sx, sg.y AS sy, c.x AS cx, c.y AS cy FROM fut f LEFT JOIN md USING (address_id) LEFT JOIN sg USING (address_id) LEFT JOIN (SELECT address_id, x, y FROM w_ranked_cold WHERE rank=1) c USING (address_id))
 SELECT 'cold' AS lane, {dist('cx','cy','lx','ly')} AS err FROM j WHERE cx IS NOT NULL UNION ALL SELECT 'warm', {dist('coalesce(mx,sx)','coalesce(my,sy)','lx','ly')} FROM j WHERE coalesce(mx,sx) IS NOT NULL
 UNION ALL SELECT 'product', {dist('coalesce(mx,sx,cx)','coalesce(my,sy,cy)','lx','ly')} FROM j WHERE coalesce(mx,sx,cx) IS NOT NULL UNION ALL SELECT 'promoted_only', {dist('mx','my','lx','ly')} FROM j WHERE mx IS NOT NULL) GROUP BY 1,2"""


@query("holdout_lanes", " UNION ALL ".join(_lanes_sql(t) for t in CUT_POINTS))
def holdout_lanes(v):
    """Two cuts; label: median of strong visits after the cut.  Lanes: cold (first static candidate), warm (agreeing median before the cut,
    else its heaviest visit), product (warm, else cold) and the medians alone.  Memory rests on visits before the cut, which then stand
    themselves, so it adds no lane."""
    e = belief.evidence_stage(v)
    cold = cold_ranked(v).filter("rank = 1").select("address_id", F.col("x").alias("cx"), F.col("y").alias("cy"))

    def at(cut):
        fut = (e.filter((F.col("observed_at") >= F.lit(cut).cast("timestamp")) & (F.col("polarity") == "positive") & (F.col("weight") >= 0.5) & F.col("x").isNotNull())
               .groupBy("address_id").agg(F.percentile("x", 0.5).alias("lx"), F.percentile("y", 0.5).alias("ly")))
        fe = cand.field_evidence(known_before(e, cut))
        med = fe.filter("primary_eligible").select("address_id", F.col("x").alias("mx"), F.col("y").alias("my"))
        one = fe.filter("not primary_eligible and arm_rank = 1").select("address_id", F.col("x").alias("sx"), F.col("y").alias("sy"))
        j = fut.join(med, "address_id", "left").join(one, "address_id", "left").join(cold, "address_id", "left")
        lanes = {"cold": ("cx", "cy"), "promoted_only": ("mx", "my")}
        points = [F.struct(F.lit(n).alias("lane"), F.col(a).alias("px"), F.col(b).alias("py")) for n, (a, b) in lanes.items()]
        points += [F.struct(F.lit("warm").alias("lane"), F.coalesce("mx", "sx").alias("px"), F.coalesce("my", "sy").alias("py")),
                   F.struct(F.lit("product").alias("lane"), F.coalesce("mx", "sx", "cx").alias("px"), F.coalesce("my", "sy", "cy").alias("py"))]
        rows = j.select("lx", "ly", F.explode(F.array(*points)).alias("p")).select("lx", "ly", "p.*").filter("px is not null")
        return rows.select(F.lit(cut[:10]).alias("cut"), "lane", gap("px", "py", "lx", "ly").alias("err"))
    return measured(union_all([at(t) for t in CUT_POINTS]), ["cut", "lane"])


@query("replay_steps", """
SELECT v::INTEGER AS step, count(*) AS n_addresses, count(radius_m) AS n_radius, round(quantile_cont(radius_m,0.5),3) AS median_radius, count(*) FILTER (tier='CONFIRMED') AS confirmed, count(*) FILTER (changed) AS n_changed
FROM (SELECT *, v > 1 AND (tier,status,coalesce(candidate_id,'')) IS DISTINCT FROM lag((tier,status,coalesce(candidate_id,''))) OVER (PARTITION BY address_id ORDER BY v) AS changed FROM w_hist) GROUP BY 1""")
def replay_steps(v):
    """One row per forward-only step: book size, median radius, confirmed, changes since the step before."""
    h = history.versions(v, [EARLY, AS_OF]).withColumnRenamed("v", "step")
    cur = F.struct("tier", "status", "candidate_id")
    h = h.withColumn("changed", (F.col("step") > 1) & ~cur.eqNullSafe(F.lag(cur).over(Window.partitionBy("address_id").orderBy("step"))))
    a = h.groupBy("step").agg(F.count("*").alias("n_addresses"), F.count("radius_m").alias("n_radius"), F.count_if(F.col("tier") == "CONFIRMED").alias("confirmed"), F.count_if("changed").alias("n_changed"))
    q = group_quantiles(h.filter("radius_m is not null"), ["step"], "radius_m", {"median_radius": 0.5}).drop("n")
    return a.join(q, "step", "left").withColumn("median_radius", F.round("median_radius", 3))


@query("oracle_by_group", f"""
WITH o AS (SELECT address_id, min(err) AS err FROM w_errs WHERE arm IN {STATIC} GROUP BY 1), g AS (SELECT address_id, town_id, coalesce(precision,'no_baseline_pin') AS stratum, err FROM w_surveyed JOIN w_address USING (address_id) LEFT JOIN w_pin USING (address_id) LEFT JOIN o USING (address_id)),
 d AS (SELECT 'town' AS dimension, town_id AS level, err FROM g UNION ALL SELECT 'stratum', stratum, err FROM g)
SELECT dimension, level, count(err) AS n, count(*)-count(err) AS n_unresolved, round(count(err)/count(*),4) AS resolved_share, round(quantile_cont(err,0.5),3) AS median, round(quantile_cont(err,0.8),3) AS p80,
 round(avg((err<=100)::INTEGER),4) AS hit_100m, round(avg((err<=500)::INTEGER),4) AS hit_500m, count(err)<15 AS below_n_guard FROM d GROUP BY 1,2""")
def oracle_by_group(v):
    """Best static candidate per surveyed address, by town and by precision of the pin, with the share that has any and the n guard."""
    o = surveyed_scored(v).filter(F.col("arm").isin(policy.STATIC_ARMS)).groupBy("address_id").agg(F.min("err").alias("err"))
    g = v.surveyed().select("address_id").join(v.address().select("address_id", "town_id"), "address_id").join(v.pin().select("address_id", "precision"), "address_id", "left").join(o, "address_id", "left")
    cells = F.array(F.struct(F.lit("town").alias("dimension"), F.col("town_id").alias("level")), F.struct(F.lit("stratum").alias("dimension"), F.coalesce("precision", F.lit("no_baseline_pin")).alias("level")))
    d = g.select("err", F.explode(cells).alias("c")).select("err", "c.*")
    a = d.groupBy("dimension", "level").agg(
        F.count("err").alias("n"), (F.count("*") - F.count("err")).alias("n_unresolved"), F.round(F.count("err") / F.count("*"), 4).alias("resolved_share"),
        *[h for h, t in zip(ev.hits(), (100, 250, 500)) if t != 250], (F.count("err") < 15).alias("below_n_guard"))
    q = group_quantiles(d.filter("err is not null"), ["dimension", "level"], "err", {"median": 0.5, "p80": 0.8}).drop("n")
    return a.join(q, ["dimension", "level"], "left").withColumns({c: F.round(c, 3) for c in ("median", "p80")})


@query("arm_choice_changes", """
WITH a AS (SELECT address_id, arm, min_by(source_ref, (arm_rank, candidate_id)) AS a FROM w_cand_early GROUP BY 1,2), b AS (SELECT address_id, arm, min_by(source_ref, (arm_rank, candidate_id)) AS b FROM w_candm GROUP BY 1,2)
SELECT arm, count(*) AS n, count(*) FILTER (a = b) AS n_same, count(*) FILTER (a <> b) AS n_other, count(*) FILTER (a IS NULL) AS n_new, count(*) FILTER (b IS NULL) AS n_gone FROM a FULL JOIN b USING (address_id, arm) GROUP BY 1""")
def arm_choice_changes(v):
    """Per arm: in how many addresses its first choice differs between two runs, is new, or is gone."""
    def first(sets, name):
        return cand.exploded(sets).groupBy("address_id", "arm").agg(F.min_by("source_ref", F.struct("arm_rank", "candidate_id")).alias(name))
    j = first(belief.bare_sets(v, EARLY), "a").join(first(belief.full_sets(v, AS_OF), "b"), ["address_id", "arm"], "full_outer")
    a, b = F.col("a"), F.col("b")
    return j.groupBy("arm").agg(F.count("*").alias("n"), F.count_if(a == b).alias("n_same"), F.count_if(a != b).alias("n_other"), F.count_if(a.isNull()).alias("n_new"), F.count_if(b.isNull()).alias("n_gone"))


@query("archetype_routing", f"""
WITH e AS (SELECT w.*, archetype, split FROM w_colderr w JOIN w_arch USING (address_id) JOIN w_address USING (address_id) JOIN w_split USING (account_id)),
 m AS (SELECT address_id, archetype, split, arm, list_sort(list(err))[count(*)//2+1] AS mid FROM e GROUP BY 1,2,3,4), b AS (SELECT address_id, archetype, min_by(arm,(mid,arm)) AS arm FROM m WHERE split='train' GROUP BY 1,2),
 t AS (SELECT archetype, arm AS best_arm FROM b GROUP BY 1,2 QUALIFY row_number() OVER (PARTITION BY archetype ORDER BY count(*) DESC, arm) = 1),
 p AS (SELECT archetype, best_arm, err, rank FROM e LEFT JOIN t USING (archetype) WHERE split<>'train' QUALIFY row_number() OVER (PARTITION BY address_id ORDER BY CASE WHEN arm=best_arm THEN 0 ELSE 1 END, rank) = 1),
 r AS (SELECT archetype, best_arm, err, rank FROM e LEFT JOIN t USING (archetype) WHERE split<>'train' AND rank=1)
SELECT 'routed' AS pick, archetype, coalesce(best_arm,'-') AS best_arm, {MEASURED} FROM p GROUP BY 2,3 UNION ALL SELECT 'rule', archetype, coalesce(best_arm,'-'), {MEASURED} FROM r GROUP BY 2,3""")
def archetype_routing(v):
    """Arm per address class (six), fitted on the training split: the arm whose middle error is smallest most often; on the rest, the routed
    pick (first of that arm, else the rule's) beside the rule's.  Static candidates against visit labels."""
    arch = belief.prepared_stage(v).select("address_id", "account_id", ev.archetype(F.col("norm"), F.col("address_text")).alias("archetype")).join(v.split(), "account_id")
    e = ev.with_error(cold_ranked(v), labels(v)).join(arch.drop("account_id"), "address_id")
    errs = F.sort_array(F.collect_list("err"))                                         # candidates of one arm: bounded by the arm rules
    mid = e.filter("split = 'train'").groupBy("address_id", "archetype", "arm").agg(F.get(errs, F.floor(F.count("*") / 2).cast("int")).alias("mid"))
    best = mid.groupBy("address_id", "archetype").agg(F.min_by("arm", F.struct("mid", "arm")).alias("arm")).groupBy("archetype", "arm").agg(F.count("*").alias("c"))
    t = best.groupBy("archetype").agg(F.min_by("arm", F.struct(-F.col("c"), "arm")).alias("best_arm"))
    rest = e.filter("split <> 'train'").join(t, "archetype", "left").withColumn("best_arm", F.coalesce("best_arm", F.lit("-")))
    picks = {"routed": F.struct((F.col("arm") != F.col("best_arm")).cast("int"), F.col("rank")), "rule": F.struct(F.lit(0), F.col("rank"))}
    rows = [rest.groupBy("address_id", "archetype", "best_arm").agg(F.min_by("err", o).alias("err")).withColumn("pick", F.lit(n)) for n, o in picks.items()]
    return measured(union_all(rows), ["pick", "archetype", "best_arm"])


@query("bound_by_point_kind", f"""
WITH s AS (SELECT address_id, town_id, surveyed_x AS sx, surveyed_y AS sy FROM w_surveyed JOIN w_address USING (address_id)),
 k AS (SELECT 'own_pin' AS kind, address_id, {dist('sx','sy','geocoder_x','geocoder_y')} AS err FROM s JOIN w_pin USING (address_id) UNION ALL SELECT 'town_locality', address_id, min({dist('sx','sy','cx','cy')}) FROM s JOIN w_locality USING (town_id) GROUP BY 2
  UNION ALL SELECT 'any_landmark', address_id, min({dist('sx','sy','px','py')}) FROM s, w_landmark GROUP BY 2 UNION ALL SELECT 'any_pin', s.address_id, min({dist('sx','sy','geocoder_x','geocoder_y')}) FROM s, w_pin GROUP BY 2)
SELECT kind, {MEASURED} FROM (SELECT * FROM k UNION ALL SELECT 'absolute', address_id, min(err) FROM k GROUP BY 2) GROUP BY 1""")
def bound_by_point_kind(v):
    """What choosing an official point could reach at best: own pin, locality centres of the town, any landmark, any pin, all of them."""
    s = v.surveyed().join(v.address().select("address_id", "town_id"), "address_id").select("address_id", "town_id", F.col("surveyed_x").alias("x"), F.col("surveyed_y").alias("y"))

    def found(kind, points, scope=None):
        return spatial.nearest(s, points, "address_id", "point_id", scope=scope).select(F.lit(kind).alias("kind"), "address_id", F.col("d").alias("err"))
    pins = v.pin().select(F.col("address_id").alias("point_id"), F.col("geocoder_x").alias("x2"), F.col("geocoder_y").alias("y2"))
    own = s.join(v.pin(), "address_id").select(F.lit("own_pin").alias("kind"), "address_id", gap("x", "y", "geocoder_x", "geocoder_y").alias("err"))
    loc = v.locality().select("town_id", F.col("locality_id").alias("point_id"), F.col("cx").alias("x2"), F.col("cy").alias("y2"))
    poi = v.landmark().select(F.col("poi_id").alias("point_id"), F.col("px").alias("x2"), F.col("py").alias("y2"))
    k = union_all([own, found("town_locality", loc, ["town_id"]), found("any_landmark", poi), found("any_pin", pins)])
    return measured(k.unionByName(k.groupBy("address_id").agg(F.min("err").alias("err")).withColumn("kind", F.lit("absolute"))), ["kind"])


PROMOTED = "polarity='positive' AND weight>=0.5"
T0 = CUT_POINTS[0]


def _centre_sql(x, y, where):
    return f"(SELECT address_id, quantile_cont({x},0.5) AS mx, quantile_cont({y},0.5) AS my FROM w_ev WHERE {PROMOTED} AND {x} IS NOT NULL AND {where} GROUP BY 1)"


TAIL, CHECKIN = ("x", "y", "starts_with(coord_method,'trace_tail')"), ("checkin_x", "checkin_y", "TRUE")
POST = _centre_sql(*TAIL[:2], f"{TAIL[2]} AND observed_at >= TIMESTAMP '{T0}'")


@query("coordinate_displacement", f"""
SELECT comparison, {MEASURED}, round(quantile_cont(err,0.75),3) AS p75 FROM (
 SELECT 'label_checkin_tail' AS comparison, {dist('a.mx','a.my','b.mx','b.my')} AS err FROM {_centre_sql(*CHECKIN)} a JOIN {_centre_sql(*TAIL)} b USING (address_id)
 UNION ALL SELECT 'pre_checkin_post_tail', {dist('a.mx','a.my','b.mx','b.my')} FROM {_centre_sql('checkin_x', 'checkin_y', f"observed_at < TIMESTAMP '{T0}'")} a JOIN {POST} b USING (address_id)
 UNION ALL SELECT 'pre_tail_post_tail', {dist('a.mx','a.my','b.mx','b.my')} FROM {_centre_sql('x', 'y', f"{TAIL[2]} AND observed_at < TIMESTAMP '{T0}'")} a JOIN {POST} b USING (address_id)
 UNION ALL SELECT 'cold_under_checkin', {dist('c.x','c.y','a.mx','a.my')} FROM {_centre_sql(*CHECKIN)} a JOIN w_ranked_cold c USING (address_id) WHERE rank=1
 UNION ALL SELECT 'cold_under_tail', {dist('c.x','c.y','a.mx','a.my')} FROM {_centre_sql(*TAIL)} a JOIN w_ranked_cold c USING (address_id) WHERE rank=1) GROUP BY 1""")
def coordinate_displacement(v):
    """Check-in against trace tail: shift of the label, the first static candidate under either label, and how far the median of visits
    before a cut lies from the tail median after it."""
    e = belief.evidence_stage(v).filter("polarity = 'positive' and weight >= 0.5")
    before = F.col("observed_at") < F.lit(T0).cast("timestamp")

    def centre(kind, when=None):
        x, y = ("x", "y") if kind == "tail" else ("checkin_x", "checkin_y")
        rows = e.filter(F.col(x).isNotNull() & (F.col("coord_method").startswith("trace_tail") if kind == "tail" else F.lit(True)))
        rows = rows if when is None else rows.filter(when)
        return rows.groupBy("address_id").agg(F.percentile(x, 0.5).alias("mx"), F.percentile(y, 0.5).alias("my"))

    def told(name, a, b):
        return a.toDF("address_id", "ax", "ay").join(b.toDF("address_id", "bx", "by"), "address_id").select(F.lit(name).alias("comparison"), gap("ax", "ay", "bx", "by").alias("err"))
    cold = cold_ranked(v).filter("rank = 1").select("address_id", "x", "y")
    checkin, tail, after = centre("checkin"), centre("tail"), centre("tail", ~before)
    rows = union_all([told("label_checkin_tail", checkin, tail), told("pre_checkin_post_tail", centre("checkin", before), after), told("pre_tail_post_tail", centre("tail", before), after),
                      told("cold_under_checkin", cold, checkin), told("cold_under_tail", cold, tail)])
    q = group_quantiles(rows, ["comparison"], "err", {"p75": 0.75}).drop("n")
    return measured(rows, ["comparison"]).join(q, "comparison").withColumn("p75", F.round("p75", 3))


LOCKED_DIMS = {"town": "town_id", "type": "address_type", "stratum": "coalesce(precision,'none')", "split": "split", "visited": "CASE WHEN address_id IN (SELECT address_id FROM w_visit) THEN 'yes' ELSE 'no' END"}


@query("locked_set_by_dimension", "WITH a AS MATERIALIZED (SELECT *, address_id IN (SELECT address_id FROM w_surveyed) AS s FROM w_address LEFT JOIN w_pin USING (address_id) JOIN w_split USING (account_id)), t AS (SELECT count(*) AS na, count(*) FILTER (s) AS ns FROM a) " + " UNION ALL ".join(
    f"SELECT '{n}' AS dimension, {e} AS level, count(*) FILTER (s) AS n_locked, round(count(*) FILTER (s)/any_value(ns),6) AS share_locked, round(count(*)/any_value(na),6) AS share_population FROM a, t GROUP BY 2" for n, e in LOCKED_DIMS.items()))
def locked_set_by_dimension(v):
    """Make-up of the surveyed set beside the whole book: town, type, precision, split, ever visited."""
    seen = v.visit().select("address_id").distinct().withColumn("visited", F.lit("yes"))
    a = (v.address().join(v.pin().select("address_id", "precision"), "address_id", "left").join(v.split(), "account_id").join(seen, "address_id", "left")
         .join(v.surveyed().select("address_id", F.lit(1).alias("s")), "address_id", "left"))
    own = {"town": F.col("town_id"), "type": F.col("address_type"), "stratum": F.coalesce("precision", F.lit("none")), "split": F.col("split"), "visited": F.coalesce("visited", F.lit("no"))}
    cells = F.array(*[F.struct(F.lit(n).alias("dimension"), c.alias("level")) for n, c in own.items()])
    g = a.select("s", F.explode(cells).alias("c")).groupBy("c.dimension", "c.level").agg(F.count("s").alias("n_locked"), F.count("*").alias("n"))
    t = a.agg(F.count("*").alias("na"), F.count("s").alias("ns"))
    return g.crossJoin(F.broadcast(t)).select("dimension", "level", "n_locked", F.round(F.col("n_locked") / F.col("ns"), 6).alias("share_locked"), F.round(F.col("n") / F.col("na"), 6).alias("share_population"))


ROAD = ("CASE WHEN regexp_extract(norm,'\\bgali (?:no )?([0-9]+)\\b',1)<>'' THEN 'gali '||regexp_extract(norm,'\\bgali (?:no )?([0-9]+)\\b',1) WHEN regexp_extract(norm,'\\broad ([0-9]+)\\b',1)<>'' THEN 'road '||regexp_extract(norm,'\\broad ([0-9]+)\\b',1) "
        "WHEN regexp_extract(norm,'([0-9]+)(?:st|nd|rd|th) cross\\b',1)<>'' THEN 'cross '||regexp_extract(norm,'([0-9]+)(?:st|nd|rd|th) cross\\b',1) END")


def road_key(norm):
    """Lane, road or cross with its number; null where the text has none."""
    found = [(n, F.regexp_extract(norm, p, 1)) for n, p in (("gali ", r"\bgali (?:no )?([0-9]+)\b"), ("road ", r"\broad ([0-9]+)\b"), ("cross ", r"([0-9]+)(?:st|nd|rd|th) cross\b"))]
    return F.coalesce(*[F.when(x != "", F.concat(F.lit(n), x)) for n, x in found])


@query("sibling_pins_by_key", f"""
WITH p AS MATERIALIZED (SELECT address_id, town_id||'|'||locality_id||'|'||road AS key, geocoder_x AS x, geocoder_y AS y, precision IN ('rooftop','street') AS fine, tx, ty FROM (SELECT *, {ROAD} AS road FROM w_addr WHERE added_date < DATE '2024-02-01')
  JOIN w_locbest USING (address_id) JOIN w_pin USING (address_id) JOIN w_point USING (address_id) WHERE road IS NOT NULL),
 s AS (SELECT 'any' AS pins, a.address_id, quantile_cont(b.x,0.5) AS mx, quantile_cont(b.y,0.5) AS my FROM p a JOIN p b ON a.key=b.key AND a.address_id<>b.address_id GROUP BY 2
  UNION ALL SELECT 'fine', a.address_id, quantile_cont(b.x,0.5), quantile_cont(b.y,0.5) FROM p a JOIN p b ON a.key=b.key AND a.address_id<>b.address_id AND b.fine GROUP BY 2)
SELECT pins, {MEASURED}, round(quantile_cont(own,0.5),3) AS own_median, count(*) FILTER (err < own) AS sibling_better FROM (SELECT pins, {dist('mx','my','tx','ty')} AS err, {dist('x','y','tx','ty')} AS own FROM s JOIN p USING (address_id)) GROUP BY 1""")
def sibling_pins_by_key(v):
    """Median pin of the other records on the same town, locality and road, of all pins and of the fine ones, against the own pin.

    Records without a road in the text have no siblings here.  A record that is not fine itself takes the median of all fine ones.
    """
    def located():
        addr = belief.prepared_stage(v)
        best = cand.best_locality(cand.locality_hits(addr, v.locality(), "2024-02-01")).select("address_id", "locality_id")
        return (addr.filter(F.col("added_date") < F.lit("2024-02-01").cast("date")).select("address_id", "town_id", road_key(F.col("norm")).alias("road")).filter("road is not null")
                .join(best, "address_id").join(v.pin(), "address_id").join(v.place_point(), "address_id").select(
                    "address_id", F.concat_ws("|", "town_id", "locality_id", "road").alias("key"), F.col("geocoder_x").alias("x"), F.col("geocoder_y").alias("y"),
                    F.col("precision").isin("rooftop", "street").alias("fine"), "tx", "ty"))
    p = stage(v, "located_on_roads", located)

    def others(rows):
        return leave_one_out_median(rows, "key", "address_id", "x", "mx").drop("n_others").join(leave_one_out_median(rows, "key", "address_id", "y", "my").drop("n_others"), "address_id")
    fine, coarse = p.filter("fine"), p.filter("not fine")
    whole = group_quantiles(fine, ["key"], "x", {"mx": 0.5}).drop("n").join(group_quantiles(fine, ["key"], "y", {"my": 0.5}).drop("n"), "key")
    s = union_all([others(p).withColumn("pins", F.lit("any")), others(fine).withColumn("pins", F.lit("fine")), coarse.join(whole, "key").select("address_id", "mx", "my", F.lit("fine").alias("pins"))])
    e = stage(v, "sibling_errors", lambda: s.join(p, "address_id").select("pins", gap("mx", "my", "tx", "ty").alias("err"), gap("x", "y", "tx", "ty").alias("own")))
    own = group_quantiles(e, ["pins"], "own", {"own_median": 0.5}).drop("n").withColumn("own_median", F.round("own_median", 3))
    return measured(e, ["pins"]).join(own, "pins").join(e.groupBy("pins").agg(F.count_if(F.col("err") < F.col("own")).alias("sibling_better")), "pins")


@query("resolver_cross_town", f"""
WITH n AS (SELECT name, min(locality_id) AS locality_id FROM (SELECT locality_id, list_sort(list_distinct(ltoks)) AS name FROM w_loc WHERE len(ltoks) > 0) GROUP BY 1),
 o AS (SELECT address_id, tx, ty, list_distinct(toks) AS toks FROM w_addr JOIN w_point USING (address_id) WHERE address_id NOT IN (SELECT address_id FROM w_lochit WHERE coverage >= 1)),
 h AS (SELECT address_id, tx, ty, locality_id, len(name) AS k, (SELECT round(sum(idf),6) FROM w_loctok t WHERE t.locality_id = n.locality_id) AS score FROM o JOIN n ON len(list_intersect(name, toks)) = len(name)),
 b AS (SELECT h.*, {dist('cx','cy','tx','ty')} AS err FROM h JOIN w_locality USING (locality_id) QUALIFY row_number() OVER (PARTITION BY address_id ORDER BY score DESC, k DESC, locality_id) = 1)
SELECT (SELECT count(*) FROM o) AS n_open, {MEASURED} FROM b""")
def resolver_cross_town(v):
    """Addresses whose own town has no name that stands whole in the text: the best name of any town, and how far its centre is off.

    A name that several localities bear stands for the smallest id; a whole name holds its rarest token, so only that one is joined.
    """
    addr, loc = belief.prepared_stage(v), v.locality()
    told = cand.locality_hits(addr, loc, "2024-02-01", 1.0).select("address_id").distinct()
    names = (cand.locality_tokens(loc, addr, "2024-02-01").groupBy("locality_id", "rare").agg(F.sort_array(F.collect_set("token")).alias("name"), F.round(F.sum("idf"), 6).alias("score"))
             .groupBy("name", F.col("rare").alias("token")).agg(F.min(F.struct("locality_id", "score")).alias("m")).select("name", "token", "m.*"))
    open_ = addr.select("address_id", F.array_distinct("toks").alias("toks")).join(told, "address_id", "left_anti").join(v.place_point(), "address_id")
    h = open_.withColumn("token", F.explode("toks")).join(names, "token").filter(F.size(F.array_except("name", "toks")) == 0)
    best = h.groupBy("address_id", "tx", "ty").agg(F.min(F.struct((-F.col("score")).alias("s"), (-F.size("name")).alias("k"), "locality_id")).alias("m")).select("address_id", "tx", "ty", "m.locality_id")
    err = best.join(loc.select("locality_id", "cx", "cy"), "locality_id").select(F.lit(1).alias("g"), gap("cx", "cy", "tx", "ty").alias("err"))
    return measured(err, ["g"]).drop("g").crossJoin(F.broadcast(open_.agg(F.count("*").alias("n_open"))))


WORDS = ["confirmed", "Location_Confirmed ", "denied", "not_true", "unresolved", "perhaps"]
REVIEW = f"""SELECT -(conv_id*1000+turn+1) AS review_id, conv_id AS address_id, CASE WHEN (conv_id+turn)%7<>6 THEN 'R'||(turn%3) END AS actor, [{','.join(f"'{w}'" for w in WORDS)}][(conv_id*7+turn) % 6 + 1] AS word,
 TIMESTAMP '2024-01-06 04:00:00' + turn*INTERVAL 1 HOUR AS observed_at FROM conversations"""
VIEWS["w_review"] = f"""
SELECT *, CASE trim(lower(word)) WHEN 'confirmed' THEN 'confirm' WHEN 'location_confirmed' THEN 'confirm' WHEN 'denied' THEN 'deny' WHEN 'not_true' THEN 'deny' WHEN 'unresolved' THEN 'inconclusive' END AS decision FROM ({REVIEW})"""
VIEWS["w_reviewed"] = """
SELECT review_id AS observation_id, address_id, actor AS agent_id, decision, observed_at, CASE decision WHEN 'confirm' THEN 'met_family' WHEN 'deny' THEN 'no_such_person' ELSE 'locked_premises' END AS outcome,
 CASE decision WHEN 'confirm' THEN 'positive' WHEN 'deny' THEN 'negative' ELSE 'ambiguous' END AS polarity, strftime(observed_at, '%Y-%m') AS period, observed_at::DATE AS day,
 CASE decision WHEN 'deny' THEN 0.0 ELSE round((CASE decision WHEN 'confirm' THEN 0.80 ELSE 0.45 END::DOUBLE * 0.9::DOUBLE) * 0.85::DOUBLE * CASE WHEN hour(observed_at + INTERVAL 330 MINUTE) BETWEEN 8 AND 18 THEN 1.0 ELSE 0.7 END::DOUBLE, 6) END::DOUBLE AS weight
FROM w_review WHERE decision IS NOT NULL AND actor IS NOT NULL"""
at_cut("_review", AS_OF)
VIEWS["w_evcut_review"] = f"SELECT * FROM w_evcut UNION ALL BY NAME SELECT * EXCLUDE (decision) FROM w_reviewed WHERE observed_at < TIMESTAMP '{AS_OF}'"


def reviews(v):
    """Reviewer words per address, one per turn of its conversation."""
    turn, words = F.col("turn"), F.array(*[F.lit(w) for w in WORDS])
    return v.raw("conversations").select(
        (-(F.col("conv_id") * 1000 + turn + 1)).cast("long").alias("review_id"), F.col("conv_id").cast("long").alias("address_id"), F.when((F.col("conv_id") + turn) % 7 != 6, F.concat(F.lit("R"), turn % 3)).alias("actor"),
        F.get(words, ((F.col("conv_id") * 7 + turn) % 6).cast("int")).alias("word"), (F.lit("2024-01-06 04:00:00").cast("timestamp") + F.make_dt_interval(hours=turn.cast("int"))).alias("observed_at"))


@query("reviews_in_log", """
SELECT observation_id, address_id, agent_id, 'adjudication' AS kind, decision, outcome, polarity, weight, strftime(observed_at, '%Y-%m-%d %H:%M') AS at FROM w_reviewed""")
def reviews_in_log(v):
    """Accepted decisions as scored rows of the log."""
    o = adjudication.observations(adjudication.split_decisions(reviews(v))[0])
    return o.select("observation_id", "address_id", "agent_id", "kind", "decision", "outcome", "polarity", "weight", F.date_format("observed_at", "yyyy-MM-dd HH:mm").alias("at"))


@query("reviews_refused", "SELECT CASE WHEN decision IS NULL THEN 'unknown_decision' ELSE 'no_actor' END AS reason, word, count(*) AS n FROM w_review WHERE decision IS NULL OR actor IS NULL GROUP BY 1,2")
def reviews_refused(v):
    return adjudication.split_decisions(reviews(v))[1].groupBy("reason", "word").agg(F.count("*").alias("n"))


@query("belief_after_reviews", """
SELECT a.address_id, a.tier AS tier_before, b.tier AS tier_after, a.status AS status_before, b.status AS status_after, a.n_neg AS n_neg_before, b.n_neg AS n_neg_after, b.n_obs - a.n_obs AS n_reviews, a.candidate_id IS DISTINCT FROM b.candidate_id AS relocated
FROM w_belief a JOIN w_belief_review b USING (address_id) WHERE b.n_obs > a.n_obs""")
def belief_after_reviews(v):
    """Beliefs of the reviewed addresses, before and after the decisions are appended to the log."""
    extra = adjudication.observations(adjudication.split_decisions(reviews(v))[0]).drop("decision", "kind")
    after = belief.belief_from_log(v, known_before(belief.evidence_stage(v), AS_OF).unionByName(extra, allowMissingColumns=True), AS_OF, "reviews")
    a, b = belief.belief_at(v, AS_OF).alias("a"), after.alias("b")
    j = a.join(b, F.col("a.address_id") == F.col("b.address_id")).filter("b.n_obs > a.n_obs")
    return j.select("a.address_id", *[F.col(f"{s}.{c}").alias(f"{c}_{n}") for c in ("tier", "status", "n_neg") for s, n in (("a", "before"), ("b", "after"))],
                    (F.col("b.n_obs") - F.col("a.n_obs")).alias("n_reviews"), (~F.col("a.candidate_id").eqNullSafe(F.col("b.candidate_id"))).alias("relocated"))


@query("place_versions", f"""
SELECT place_id, string_agg(v||':'||tiers, ' ' ORDER BY v) AS versions, sum(contested)::BIGINT AS n_contested, sum(moved)::BIGINT AS n_moved, coalesce(string_agg(detail, ' ' ORDER BY v), '') AS contradictions FROM (
 SELECT place_id, v, string_agg(DISTINCT tier, '+' ORDER BY tier) AS tiers, count(*) FILTER (status='CONTESTED') AS contested, count(*) FILTER (status='MOVED_SUSPECTED') AS moved,
  CASE WHEN count(*) FILTER (status IN ('CONTESTED','MOVED_SUSPECTED')) > 0 THEN v||':'||string_agg(DISTINCT status, '+' ORDER BY status) FILTER (status IN ('CONTESTED','MOVED_SUSPECTED')) END AS detail
 FROM w_hist JOIN {MEMBER} USING (address_id) GROUP BY 1,2) GROUP BY 1""")
def place_versions(v):
    """History of each place: tiers per version, and which versions hold what kind of contradiction."""
    h = history.versions(v, [EARLY, AS_OF]).join(members(v), "address_id")
    bad = F.col("status").isin("CONTESTED", "MOVED_SUSPECTED")
    g = h.groupBy("place_id", "v").agg(
        F.array_join(F.sort_array(F.collect_set("tier")), "+").alias("tiers"), F.count_if(F.col("status") == "CONTESTED").alias("contested"), F.count_if(F.col("status") == "MOVED_SUSPECTED").alias("moved"),
        F.array_join(F.sort_array(F.collect_set(F.when(bad, F.col("status")))), "+").alias("kinds"))
    line = lambda c: F.concat_ws(":", "v", c)
    # a place has one row per version here, so the lists are as short as the list of cuts
    r = g.groupBy("place_id").agg(F.sort_array(F.collect_list(F.struct("v", line("tiers").alias("t"), F.when(F.col("kinds") != "", line("kinds")).alias("d")))).alias("l"),
                                  F.sum("contested").alias("n_contested"), F.sum("moved").alias("n_moved"))
    return r.select("place_id", F.array_join("l.t", " ").alias("versions"), "n_contested", "n_moved", F.array_join("l.d", " ").alias("contradictions"))


@query("visits_by_channel", f"""
SELECT coalesce(channel,'unknown') AS channel, count(*) AS n_visits, count(DISTINCT address_id) AS n_addresses, round(avg(({MET})::INTEGER),6) AS met_rate, round(avg((outcome='address_not_traceable')::INTEGER),6) AS not_traceable_rate,
 round(quantile_cont(dwell_s,0.5),1) AS median_dwell FROM w_visit LEFT JOIN w_agent USING (agent_id) GROUP BY 1""")
def visits_by_channel(v):
    """Outcome rates by the channel of the collector."""
    j = v.visit().join(v.agent(), "agent_id", "left").withColumn("channel", F.coalesce("channel", F.lit("unknown")))
    a = j.groupBy("channel").agg(F.count("*").alias("n_visits"), rate(met(), "met_rate"), rate(F.col("outcome") == "address_not_traceable", "not_traceable_rate"))
    distinct = j.select("channel", "address_id").distinct().groupBy("channel").agg(F.count("address_id").alias("n_addresses"))
    q = group_quantiles(j.filter("dwell_s is not null"), ["channel"], "dwell_s", {"median_dwell": 0.5}).drop("n")
    return a.join(distinct, "channel").join(q, "channel", "left").withColumn("median_dwell", F.round("median_dwell", 1))


@query("hierarchy_conflicts", """
SELECT 'address_town_differs_from_account' AS rule, count(*) AS n, count(*) FILTER (town_id IS DISTINCT FROM account_town) AS n_conflicts, count(DISTINCT account_id) FILTER (town_id IS DISTINCT FROM account_town) AS n_parents FROM w_address JOIN w_account USING (account_id)
UNION ALL SELECT 'visit_town_differs_from_agent', count(*), count(*) FILTER (town_id <> home_town), count(DISTINCT agent_id) FILTER (town_id <> home_town) FROM w_visit JOIN w_address USING (address_id) JOIN w_agent USING (agent_id) WHERE home_town IS NOT NULL""")
def hierarchy_conflicts(v):
    """Child rows that contradict their parent: address against account, visit against the collector's home town (where there is one)."""
    def told(rule, rows, parent, bad):
        per = rows.groupBy(parent).agg(F.count("*").alias("n"), F.count_if(bad).alias("bad"))
        return per.agg(F.lit(rule).alias("rule"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("n_conflicts"), F.count_if(F.col("bad") > 0).alias("n_parents"))
    a = v.address().select("address_id", "account_id", "town_id")
    visits = v.visit().select("address_id", "agent_id").join(a, "address_id").join(v.agent().filter("home_town is not null"), "agent_id")
    return union_all([told("address_town_differs_from_account", a.join(v.account(), "account_id"), "account_id", ~F.col("town_id").eqNullSafe(F.col("account_town"))),
                      told("visit_town_differs_from_agent", visits, "agent_id", F.col("town_id") != F.col("home_town"))])


@query("lender_address_style", """
SELECT address_format, count(*) AS n, round(avg(regexp_matches(address_text,'[^\\x00-\\x7F]')::INTEGER),6) AS non_ascii_rate, round(avg(regexp_matches(address_text,'-\\s*\\d{6}\\s*$')::INTEGER),6) AS pin_tail_rate,
 round(avg(regexp_matches(address_text,'(?i)\\b(house|plot|door|flat|no\\.?|#)\\b')::INTEGER),6) AS house_rate, quantile_cont(length(address_text),0.5) AS median_len
FROM w_address JOIN w_account USING (account_id) JOIN w_lender USING (lender_id) GROUP BY 1""")
def lender_address_style(v):
    """Style of address texts by the format their lender asks for, through account and lender."""
    t = F.col("address_text")
    j = v.address().join(v.account(), "account_id").join(v.lender(), "lender_id")
    return j.groupBy("address_format").agg(F.count("*").alias("n"), rate(t.rlike(r"[^\x00-\x7F]"), "non_ascii_rate"), rate(t.rlike(r"-\s*\d{6}\s*$"), "pin_tail_rate"),
                                           rate(t.rlike(r"(?i)\b(house|plot|door|flat|no\.?|#)\b"), "house_rate"), F.percentile(F.length(t), 0.5).alias("median_len"))


@query("block_centres", f"""
WITH m AS MATERIALIZED (SELECT block_id, address_id, split, lx, ly, geocoder_x, geocoder_y FROM w_block JOIN w_address ON address_id = id JOIN w_split USING (account_id) LEFT JOIN w_label USING (address_id) LEFT JOIN w_pin USING (address_id))
SELECT block_id, count(*) AS size, count(DISTINCT split) AS n_splits, CASE WHEN count(lx) > 0 THEN 'evidence' WHEN count(geocoder_x) > 0 THEN 'pins' ELSE 'none' END AS source, round(coalesce(avg(lx), avg(geocoder_x)),1) AS cx, round(coalesce(avg(ly), avg(geocoder_y)),1) AS cy,
 CASE WHEN count(lx) > 0 THEN round(coalesce((SELECT max({dist('p.lx','p.ly','q.lx','q.ly')}) FROM m p JOIN m q USING (block_id) WHERE p.block_id = m.block_id), 0), 3) END AS span_m FROM m GROUP BY 1""")
def block_centres(v):
    """Blocks of addresses: size, splits met, centre and span of the evidence labels; without labels the pins' mean and no span."""
    b = blocks_stage(v).select(F.col("id").alias("address_id"), "block_id")
    m = b.join(v.address().select("address_id", "account_id"), "address_id").join(v.split(), "account_id").join(labels(v), "address_id", "left").join(v.pin(), "address_id", "left")
    a = m.groupBy("block_id").agg(
        F.count("*").alias("size"), F.size(F.collect_set("split")).cast("long").alias("n_splits"), F.when(F.count("lx") > 0, "evidence").when(F.count("geocoder_x") > 0, "pins").otherwise("none").alias("source"),
        F.round(F.coalesce(F.avg("lx"), F.avg("geocoder_x")), 1).alias("cx"), F.round(F.coalesce(F.avg("ly"), F.avg("geocoder_y")), 1).alias("cy"))
    span = group_diameter(m.filter("lx is not null").select("block_id", F.col("lx").alias("x"), F.col("ly").alias("y")), "block_id")
    return a.join(span, "block_id", "left").select("block_id", "size", "n_splits", "source", "cx", "cy", F.round("span", 3).alias("span_m"))


@query("device_day_positions", """
SELECT device_id, day, hour, n, path FROM (SELECT device_id, strftime(observed_at,'%Y-%m-%d') AS day, hour(observed_at) AS hour, count(*) AS n, sum(count(*)) OVER (PARTITION BY device_id, strftime(observed_at,'%Y-%m-%d')) AS day_n,
 string_agg(floor(x)::BIGINT||','||floor(y)::BIGINT,'|' ORDER BY observed_at, observation_id) AS path FROM w_obs WHERE x IS NOT NULL GROUP BY 1,2,3) WHERE day_n >= 2""")
def device_day_positions(v):
    """Ordered positions (whole metres) per device and day of at least two points, in hourly pieces."""
    o = v.observation().filter("x is not null").select("device_id", "observed_at", "observation_id", F.date_format("observed_at", "yyyy-MM-dd").alias("day"), F.hour("observed_at").cast("long").alias("hour"),
                                                       F.concat_ws(",", F.floor("x"), F.floor("y")).alias("at"))
    path = F.sort_array(F.collect_list(F.struct("observed_at", "observation_id", "at")))
    g = o.groupBy("device_id", "day", "hour").agg(F.count("*").alias("n"), F.array_join(F.transform(path, lambda s: s["at"]), "|").alias("path"))
    w = Window.partitionBy("device_id", "day")                                         # at most 24 pieces
    return g.withColumn("day_n", F.sum("n").over(w)).filter("day_n >= 2").drop("day_n")
