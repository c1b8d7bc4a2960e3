"""Evaluation jobs: errors, recall, nDCG, holdouts, intervals, controls."""
import re
from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from placeproof import policy
from placeproof.catalog import query
from placeproof.catalog.aggregates import PIN_ERR, pin_errors
from placeproof.catalog.oracle_domain import AS_OF, CUT_VIEWS, EARLY, VIEWS, at_cut
from placeproof.catalog.oracle_views import dist, norm
from placeproof.functions import text
from placeproof.functions.geo import distance
from placeproof.operators import bootstrap, spatial, tokenjoin
from placeproof.operators.asof import known_before
from placeproof.operators.profile import union_all
from placeproof.operators.quantiles import group_quantiles
from placeproof.plans import belief, candidates as cand, evaluation as ev, evidence, history, ranking, sweep
from placeproof.session import checkpoint
from placeproof.sources.stages import stage

VIEWS["w_err"] = f"SELECT r.*, lx, ly, {dist('x', 'y', 'lx', 'ly')} AS err FROM w_ranked r JOIN w_label USING (address_id)"
VIEWS["w_errs"] = f"SELECT r.*, surveyed_x AS lx, surveyed_y AS ly, {dist('x', 'y', 'surveyed_x', 'surveyed_y')} AS err FROM w_ranked0 r JOIN w_surveyed USING (address_id)"
HITS = "round(avg((err<=100)::INTEGER),4) AS hit_100m, round(avg((err<=250)::INTEGER),4) AS hit_250m, round(avg((err<=500)::INTEGER),4) AS hit_500m"
GRADE = "CASE WHEN err<=100 THEN 3 WHEN err<=250 THEN 2 WHEN err<=500 THEN 1 ELSE 0 END"


def labels(v):
    """Proxy labels from what the log held before the candidates' cut."""
    return evidence.proxy_label(known_before(belief.evidence_stage(v), AS_OF))


def scored(v):
    """Ranked candidates of the labelled addresses with their error against the proxy label."""
    return stage(v, "eval_scored", lambda: ev.with_error(ranking.exploded(belief.ranked_at(v, AS_OF)), labels(v)))


def surveyed_scored(v):
    s = v.surveyed().withColumnsRenamed({"surveyed_x": "lx", "surveyed_y": "ly"})
    return stage(v, "eval_surveyed", lambda: ev.with_error(ranking.exploded(belief.bare_ranked(v, AS_OF)), s))


def top(v):
    return ev.top1(scored(v), [F.col("rank")])


@query("proxy_labels", "SELECT address_id, round(lx,3) AS lx, round(ly,3) AS ly, n_label FROM w_label")
def proxy_labels(v):
    return labels(v).select("address_id", F.round("lx", 3).alias("lx"), F.round("ly", 3).alias("ly"), "n_label")


@query("arm_errors", f"""
SELECT arm, count(*) AS n, round(quantile_cont(err,0.5),1) AS median, round(quantile_cont(err,0.8),1) AS p80, round(quantile_cont(err,0.9),1) AS p90, round(max(err),1) AS worst, {HITS} FROM w_err GROUP BY 1""")
def arm_errors(v):
    s = scored(v)
    q = group_quantiles(s, ["arm"], "err", {"median": 0.5, "p80": 0.8, "p90": 0.9})
    a = s.groupBy("arm").agg(F.round(F.max("err"), 1).alias("worst"), *ev.hits())
    return q.select("arm", "n", *[F.round(c, 1).alias(c) for c in ("median", "p80", "p90")]).join(a, "arm")


@query("oracle_and_recall", """
SELECT count(*) AS n, round(avg(n_cand),4) AS mean_candidates, max(n_cand) AS max_candidates, round(quantile_cont(e,0.5),1) AS oracle_median, round(avg((e<=100)::INTEGER),4) AS recall_100,
 round(avg((e<=250)::INTEGER),4) AS recall_250, round(avg((e<=500)::INTEGER),4) AS recall_500 FROM (SELECT address_id, min(err) AS e, count(*) AS n_cand FROM w_err GROUP BY 1)""")
def oracle_and_recall(v):
    o = ev.oracle_pick(scored(v))
    q = group_quantiles(o, [], "oracle_err", {"m": 0.5})
    a = o.agg(F.count("*").alias("n"), F.round(F.avg("n_cand"), 4).alias("mean_candidates"), F.max("n_cand").alias("max_candidates"), *[
        F.round(F.avg((F.col("oracle_err") <= t).cast("int")), 4).alias(f"recall_{t}") for t in (100, 250, 500)])
    return a.crossJoin(q.select(F.round("m", 1).alias("oracle_median")))


@query("arm_contribution", """
SELECT arm, count(*) AS fires, count(*) FILTER (e <= best + 1e-9) AS supplies_best, count(*) FILTER (e <= 500 AND n_within = 1) AS only_arm_within_500 FROM (
 SELECT address_id, arm, e, min(e) OVER (PARTITION BY address_id) AS best, count(*) FILTER (e <= 500) OVER (PARTITION BY address_id) AS n_within FROM (SELECT address_id, arm, min(err) AS e FROM w_err GROUP BY 1,2)) GROUP BY 1""")
def arm_contribution(v):
    a = scored(v).groupBy("address_id", "arm").agg(F.min("err").alias("e"))
    w = Window.partitionBy("address_id")
    a = a.withColumn("best", F.min("e").over(w)).withColumn("n_within", F.count(F.when(F.col("e") <= 500, 1)).over(w))
    return a.groupBy("arm").agg(F.count("*").alias("fires"), F.count_if(F.col("e") <= F.col("best") + 1e-9).alias("supplies_best"),
                                F.count_if((F.col("e") <= 500) & (F.col("n_within") == 1)).alias("only_arm_within_500"))


KS = [1, 2, 3, 5, 8]


@query("prefix_recall", """
SELECT k, count(*) AS n, round(avg((e<=100)::INTEGER),4) AS hit_100m, round(avg((e<=500)::INTEGER),4) AS hit_500m FROM (SELECT k, address_id, min(err) AS e FROM (
 SELECT *, row_number() OVER (PARTITION BY address_id ORDER BY arm_index, arm_rank, candidate_id) AS pos FROM w_err) JOIN (SELECT unnest([1,2,3,5,8])::BIGINT AS k) ON pos <= k GROUP BY 1,2) GROUP BY 1""")
def prefix_recall(v):
    """Recall in retrieval order: running minimum once, then read at each k."""
    w = Window.partitionBy("address_id").orderBy("arm_index", "arm_rank", "candidate_id")
    s = scored(v).withColumn("pos", F.row_number().over(w))
    k = F.explode(F.filter(F.array(*[F.lit(x) for x in KS]), lambda x: x >= F.col("pos")))
    m = s.select("address_id", "err", k.alias("k")).groupBy("k", "address_id").agg(F.min("err").alias("e"))
    return m.groupBy(F.col("k").cast("long").alias("k")).agg(F.count("*").alias("n"), *[
        F.round(F.avg((F.col("e") <= t).cast("int")), 4).alias(f"hit_{t}m") for t in (100, 500)])


@query("ndcg_at_5", f"""
WITH g AS (SELECT address_id, rank, {GRADE} AS g FROM w_errs), s AS (SELECT address_id, sum((pow(2,g)-1)/log2(rank+1)) AS dcg FROM g WHERE rank<=5 GROUP BY 1),
 i AS (SELECT address_id, sum((pow(2,g)-1)/log2(rk+1)) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY address_id ORDER BY g DESC) AS rk FROM g) WHERE rk<=5 GROUP BY 1),
 i5 AS (SELECT address_id, sum((pow(2,g)-1)/log2(rk+1)) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY address_id ORDER BY g DESC) AS rk FROM g WHERE rank<=5) GROUP BY 1)
SELECT 'exclude' AS rule, count(*) AS n, round(avg(dcg/idcg),4) AS ndcg FROM s JOIN i USING (address_id) WHERE idcg > 0
UNION ALL SELECT 'one', count(*), round(avg(CASE WHEN idcg > 0 THEN dcg/idcg ELSE 1 END),4) FROM s JOIN i5 USING (address_id)""")
def ndcg_at_5(v):
    s = surveyed_scored(v)
    return union_all([ev.ndcg5(s, r).agg(F.lit(r).alias("rule"), F.count("*").alias("n"), F.round(F.avg("ndcg"), 4).alias("ndcg"))
                      for r in ("exclude", "one")])


@query("headroom", """
SELECT count(*) AS n, round(avg((t.err <= o.e + 1e-9)::INTEGER),4) AS already_best, round(avg(t.err - o.e),2) AS mean_gain FROM (SELECT address_id, err FROM w_errs WHERE rank=1) t JOIN (SELECT address_id, min(err) AS e FROM w_errs GROUP BY 1) o USING (address_id)""")
def headroom(v):
    s = surveyed_scored(v)
    j = s.groupBy("address_id").agg(F.min("err").alias("e"), F.min_by("err", "rank").alias("t"))
    return j.agg(F.count("*").alias("n"), F.round(F.avg((F.col("t") <= F.col("e") + 1e-9).cast("int")), 4).alias("already_best"),
                 F.round(F.avg(F.col("t") - F.col("e")), 2).alias("mean_gain"))


@query("bottlenecks", """
SELECT class, count(*) AS n FROM (SELECT CASE WHEN top_err <= 500 THEN 'ok' WHEN best_err <= 500 THEN 'ranker_choice' WHEN pin_precision = 'pincode' THEN 'retrieval_pincode_pin'
 WHEN best_gran IN ('locality','town') THEN 'coarse_only' ELSE 'retrieval' END AS class FROM (SELECT address_id, min_by(err,rank) AS top_err, min(err) AS best_err, min_by(granularity,(err,candidate_id)) AS best_gran,
 max(baseline_precision) AS pin_precision FROM w_errs GROUP BY 1)) GROUP BY 1""")
def bottlenecks(v):
    a = surveyed_scored(v).groupBy("address_id").agg(
        F.min_by("err", "rank").alias("top_err"), F.min("err").alias("best_err"),
        F.min_by("granularity", F.struct("err", "candidate_id")).alias("best_gran"), F.max("baseline_precision").alias("pin_precision"))
    c = (F.when(F.col("top_err") <= 500, "ok").when(F.col("best_err") <= 500, "ranker_choice")
         .when(F.col("pin_precision") == "pincode", "retrieval_pincode_pin").when(F.col("best_gran").isin("locality", "town"), "coarse_only")
         .otherwise("retrieval"))
    return a.groupBy(c.alias("class")).agg(F.count("*").alias("n"))


@query("selection_variants", f"""
WITH m AS (SELECT address_id, quantile_cont(x,0.5) AS mx, quantile_cont(y,0.5) AS my FROM w_errs e WHERE arm <> 'town_centroid' OR NOT EXISTS (SELECT 1 FROM w_errs o WHERE o.address_id=e.address_id AND o.arm<>'town_centroid') GROUP BY 1),
 md AS (SELECT address_id, err FROM w_errs JOIN m USING (address_id) QUALIFY row_number() OVER (PARTITION BY address_id ORDER BY round({dist('x','y','mx','my')} - 1e-6*score, 9), candidate_id) = 1),
 f AS (SELECT address_id, x AS fx, y AS fy, arm='frozen_baseline' AND baseline_precision='pincode' AS coarse FROM w_errs WHERE rank=1),
 dm AS (SELECT address_id, err FROM (SELECT e.*, coarse AND rank=1 AND EXISTS (SELECT 1 FROM w_errs a WHERE a.address_id=e.address_id AND a.rank>1 AND a.arm<>'frozen_baseline' AND {dist('a.x','a.y','fx','fy')} <= 800) AS demoted
   FROM w_errs e JOIN f USING (address_id)) QUALIFY row_number() OVER (PARTITION BY address_id ORDER BY demoted, rank) = 1),
 ag AS (SELECT address_id, err FROM w_errs QUALIFY row_number() OVER (PARTITION BY address_id ORDER BY agreement_arms DESC, rank) = 1)
SELECT 'rule' AS variant, count(*) AS n, {HITS} FROM w_errs WHERE rank=1 UNION ALL SELECT 'medoid', count(*), {HITS} FROM md UNION ALL SELECT 'demote_pincode', count(*), {HITS} FROM dm UNION ALL SELECT 'agreement_first', count(*), {HITS} FROM ag""")
def selection_variants(v):
    """Re-scored picks: medoid of arms, coarse-pin demotion, agreement first; all over the candidate set."""
    s = surveyed_scored(v)
    w = Window.partitionBy("address_id")
    fine = F.when(F.col("arm") != "town_centroid", F.col("x")), F.when(F.col("arm") != "town_centroid", F.col("y"))
    med = s.groupBy("address_id").agg(F.coalesce(F.percentile(fine[0], 0.5), F.percentile("x", 0.5)).alias("mx"),
                                      F.coalesce(F.percentile(fine[1], 0.5), F.percentile("y", 0.5)).alias("my"))
    first = s.filter("rank = 1").select("address_id", F.col("x").alias("fx"), F.col("y").alias("fy"),
                                        ((F.col("arm") == "frozen_baseline") & (F.col("baseline_precision") == "pincode")).alias("coarse"))
    j = s.join(med, "address_id").join(first, "address_id")
    near = (F.col("rank") > 1) & (F.col("arm") != "frozen_baseline") & (distance(F.col("x"), F.col("y"), F.col("fx"), F.col("fy")) <= 800)
    j = j.withColumn("alt", F.max(near.cast("int")).over(w)).withColumn(
        "demoted", (F.col("coarse") & (F.col("rank") == 1) & (F.col("alt") == 1)).cast("int"))
    gap = F.round(distance(F.col("x"), F.col("y"), F.col("mx"), F.col("my")) - 1e-6 * F.col("score"), 9)
    picks = {"rule": [F.col("rank")], "medoid": [gap], "demote_pincode": [F.col("demoted"), F.col("rank")],
             "agreement_first": [-F.col("agreement_arms"), F.col("rank")]}
    return union_all([ev.top1(j, o).agg(F.lit(n).alias("variant"), F.count("*").alias("n"), *ev.hits()) for n, o in picks.items()])


CUT_POINTS = ["2024-01-10 00:00:00", "2024-01-15 00:00:00"]


def _holdout_sql(t0):
    return f"""SELECT '{t0[:10]}' AS cut, * FROM (WITH fut AS (SELECT address_id, quantile_cont(x,0.5) AS lx, quantile_cont(y,0.5) AS ly FROM w_ev WHERE observed_at >= TIMESTAMP '{t0}' AND polarity='positive' AND weight>=0.5 AND x IS NOT NULL GROUP BY 1),
 past AS (SELECT * FROM w_ev WHERE observed_at < TIMESTAMP '{t0}' AND polarity='positive' AND weight>=0.35 AND x IS NOT NULL),
 md AS (SELECT m.address_id, mx, my FROM (SELECT address_id, count(*) AS n, quantile_cont(x,0.5) AS mx, quantile_cont(y,0.5) AS my FROM past WHERE weight>=0.5 GROUP BY 1 HAVING count(*)>=2) m JOIN past p ON p.address_id=m.address_id AND p.weight>=0.5
  GROUP BY ALL HAVING max({dist('p.x','p.y','mx','my')}) <= 30),
 sg AS (SELECT address_id, x, y FROM past QUALIFY row_number() OVER (PARTITION BY address_id ORDER BY weight DESC, observation_id) = 1),
 pk AS (SELECT f.address_id, lx, ly, CASE WHEN md.mx IS NOT NULL THEN 'field_median' WHEN sg.x IS NOT NULL THEN 'field_single' WHEN geocoder_x IS NOT NULL THEN 'cold_pin' ELSE 'none' END AS source,
  coalesce(round(mx,3), sg.x, geocoder_x) AS px, coalesce(round(my,3), sg.y, geocoder_y) AS py FROM fut f LEFT JOIN md USING (address_id) LEFT JOIN sg USING (address_id) LEFT JOIN w_pin USING (address_id))
SELECT source, count(*) AS n, round(quantile_cont(err,0.5),3) AS median, {HITS} FROM (SELECT *, {dist('px','py','lx','ly')} AS err FROM pk) GROUP BY 1)"""


@query("temporal_holdout", " UNION ALL ".join(_holdout_sql(t) for t in CUT_POINTS))
def temporal_holdout(v):
    """Candidates from the log before a cut, labels from it after the cut; warm first, cold pin as fallback; two cuts."""
    return union_all([_holdout(v, t).withColumn("cut", F.lit(t[:10])) for t in CUT_POINTS])


def _holdout(v, at):
    e = belief.evidence_stage(v)
    t0 = F.lit(at).cast("timestamp")
    fut = (e.filter((F.col("observed_at") >= t0) & (F.col("polarity") == "positive") & (F.col("weight") >= 0.5) & F.col("x").isNotNull())
           .groupBy("address_id").agg(F.percentile("x", 0.5).alias("lx"), F.percentile("y", 0.5).alias("ly")))
    fe = cand.field_evidence(known_before(e, at))
    med = fe.filter("primary_eligible").select("address_id", F.col("x").alias("mx"), F.col("y").alias("my"))
    one = fe.filter("not primary_eligible and arm_rank = 1").select("address_id", F.col("x").alias("sx"), F.col("y").alias("sy"))
    j = fut.join(med, "address_id", "left").join(one, "address_id", "left").join(v.pin(), "address_id", "left")
    p = j.select("address_id", F.when(F.col("mx").isNotNull(), "field_median").when(F.col("sx").isNotNull(), "field_single")
                 .when(F.col("geocoder_x").isNotNull(), "cold_pin").otherwise("none").alias("source"),
                 distance(F.coalesce("mx", "sx", "geocoder_x"), F.coalesce("my", "sy", "geocoder_y"), F.col("lx"), F.col("ly")).alias("err"))
    q = group_quantiles(p, ["source"], "err", {"median": 0.5}).drop("n")
    a = p.groupBy("source").agg(F.count("*").alias("n"), *ev.hits())
    return a.join(q, "source", "left").withColumn("median", F.round("median", 3))


@query("prequential_replay", """
SELECT v::INTEGER AS step, tier, status, count(*) AS n, count(*) FILTER (changed) AS n_changed FROM (SELECT *, v > 1 AND (tier,status,coalesce(candidate_id,'')) IS DISTINCT FROM lag((tier,status,coalesce(candidate_id,''))) OVER (PARTITION BY address_id ORDER BY v) AS changed
 FROM w_hist) GROUP BY 1,2,3""")
def prequential_replay(v):
    """Forward-only steps: tier and status counts per cut and what changed since the previous one."""
    h = history.versions(v, [EARLY, AS_OF])
    cur = F.struct("tier", "status", "candidate_id")
    w = Window.partitionBy("address_id").orderBy("v")
    h = h.withColumn("changed", (F.col("v") > 1) & ~cur.eqNullSafe(F.lag(cur).over(w)))
    return h.groupBy(F.col("v").alias("step"), "tier", "status").agg(F.count("*").alias("n"), F.count_if("changed").alias("n_changed"))


def in_blocks(v, df):
    """Rows with the group that is redrawn as a whole: the place block, else the address itself."""
    from placeproof.catalog.joins import blocks_stage
    b = blocks_stage(v).select(F.col("id").alias("address_id"), "block_id")
    return df.join(b, "address_id", "left").withColumn("group", F.coalesce(F.concat(F.lit("b"), "block_id"), F.concat(F.lit("a"), "address_id")))


@query("bootstrap_mean")
def bootstrap_mean(v):
    t = top(v).withColumn("hit", (F.col("err") <= 100).cast("double"))
    return bootstrap.grouped_mean_ci(in_blocks(v, t), "hit", "group")


@query("bootstrap_point", """
SELECT round(avg((err<=100)::INTEGER),4) AS point, count(*) AS n, count(DISTINCT coalesce('b'||block_id, 'a'||address_id)) AS n_groups, 10000 AS resamples
FROM w_err LEFT JOIN w_block ON id = address_id WHERE rank=1""")
def bootstrap_point(v):
    return bootstrap_mean(v).select("point", "n", "n_groups", F.col("resamples").cast("int").alias("resamples"))


@query("bootstrap_median")
def bootstrap_median(v):
    return bootstrap.grouped_median_ci(in_blocks(v, top(v)), "err", "group")


@query("bootstrap_paired_difference")
def bootstrap_paired_difference(v):
    """Rule pick minus oracle pick, mean and median, resampled together; resolved when the interval excludes zero."""
    j = in_blocks(v, ev.oracle_pick(scored(v)).join(top(v).select("address_id", "err"), "address_id").withColumn("d", F.col("err") - F.col("oracle_err")))
    ci = union_all([f(j, "d", "group").withColumn("statistic", F.lit(n)) for n, f in (("mean", bootstrap.grouped_mean_ci), ("median", bootstrap.grouped_median_ci))])
    return ci.withColumn("resolved", (F.col("lo") > 0) | (F.col("hi") < 0)).withColumn(
        "direction", F.when(F.col("point") > 0, "worse").when(F.col("point") < 0, "better").otherwise("equal"))


@query("placebo_points")
def placebo_points(v):
    """Count-matched random points around the town centroid, uniform over the disc area."""
    s = surveyed_scored(v).filter(F.col("arm").isin(policy.STATIC_ARMS))
    n = s.groupBy("address_id", "town_id").agg(F.count("*").alias("k"), F.first("lx").alias("lx"), F.first("ly").alias("ly"), F.min("err").alias("real_err"))
    tc = cand.town_centroids(v.locality())
    pins = v.pin().join(v.address().select("address_id", "town_id"), "address_id").join(tc, "town_id").withColumn(
        "d", distance(F.col("geocoder_x"), F.col("geocoder_y"), F.col("tcx"), F.col("tcy")))
    rad = group_quantiles(pins, ["town_id"], "d", {"r": 0.95}).drop("n")
    p = n.join(tc, "town_id").join(rad, "town_id").withColumn("i", F.explode(F.sequence(F.lit(1), F.col("k").cast("int"))))
    u = lambda salt: (F.pmod(F.xxhash64("address_id", "i", F.lit(salt)), F.lit(1000003)) / 1000003.0)
    ang, rr = u("angle") * 6.283185307179586, F.col("r") * F.sqrt(u("radius"))
    e = p.withColumn("e", distance(F.col("tcx") + rr * F.cos(ang), F.col("tcy") + rr * F.sin(ang), F.col("lx"), F.col("ly")))
    per = e.groupBy("address_id", "real_err").agg(F.min("e").alias("placebo_err"))
    return per.agg(F.count("*").alias("n"), F.round(F.avg((F.col("placebo_err") <= 500).cast("int")), 4).alias("placebo_hit_500m"),
                   F.round(F.avg((F.col("real_err") <= 500).cast("int")), 4).alias("real_hit_500m"))


@query("truth_echo", "SELECT arm, round(min(err),3) AS closest, count(*) FILTER (err<=1) AS within_1m, count(*) FILTER (err<=5) AS within_5m FROM w_errs GROUP BY 1")
def truth_echo(v):
    return surveyed_scored(v).groupBy("arm").agg(F.round(F.min("err"), 3).alias("closest"), F.count_if(F.col("err") <= 1).alias("within_1m"),
                                                 F.count_if(F.col("err") <= 5).alias("within_5m"))


@query("grouped_report", f"SELECT town_id, count(*) AS n, {HITS}, count(*) < 15 AS under_n_guard FROM w_errs WHERE rank=1 GROUP BY 1")
def grouped_report(v):
    return surveyed_scored(v).filter("rank = 1").groupBy("town_id").agg(F.count("*").alias("n"), *ev.hits(), (F.count("*") < 15).alias("under_n_guard"))


@query("run_disposition", """
SELECT coalesce(a.arms,'-') AS arms_before, coalesce(b.arms,'-') AS arms_after, count(*) AS n FROM (SELECT address_id, string_agg(DISTINCT arm, '+' ORDER BY arm) AS arms FROM w_cand_early GROUP BY 1) a
FULL JOIN (SELECT address_id, string_agg(DISTINCT arm, '+' ORDER BY arm) AS arms FROM w_candm GROUP BY 1) b USING (address_id) GROUP BY 1,2""")
def run_disposition(v):
    """Arm signature of each address in two runs."""
    def sig(sets, name):
        return cand.exploded(sets).groupBy("address_id").agg(F.array_join(F.sort_array(F.collect_set("arm")), "+").alias(name))
    a, b = sig(belief.bare_sets(v, EARLY), "x"), sig(belief.full_sets(v, AS_OF), "y")
    return a.join(b, "address_id", "full_outer").groupBy(F.coalesce("x", F.lit("-")).alias("arms_before"), F.coalesce("y", F.lit("-")).alias("arms_after")).agg(F.count("*").alias("n"))


LONG = "replace(replace(address_text,' Rd',' Road'),' Ngr',' Nagar')"


@query("normaliser_round_trip", f"SELECT count(*) AS n, count(*) FILTER ({norm('address_text')} = {norm(LONG)}) AS same FROM w_address")
def normaliser_round_trip(v):
    t = F.col("address_text")
    long = F.replace(F.replace(t, F.lit(" Rd"), F.lit(" Road")), F.lit(" Ngr"), F.lit(" Nagar"))
    return v.address().agg(F.count("*").alias("n"), F.count_if(text.norm_text(t) == text.norm_text(long)).alias("same"))


ARCH = """CASE WHEN regexp_matches(norm,'\\b(near|opposite|behind|beside|adjacent|next to)\\b') THEN 'landmark-relation' WHEN len(list_intersect(string_split(norm,' '),['gali','road','cross','main','street']))>0 THEN 'road' ELSE 'other' END"""


@query("archetype_best_arm", f"""
WITH e AS (SELECT w.*, {ARCH} AS arch, split FROM w_errs w JOIN w_addr USING (address_id) JOIN w_split USING (account_id)), b AS (SELECT address_id, arch, split, min_by(arm,(err,candidate_id)) AS arm FROM e GROUP BY 1,2,3),
 t AS (SELECT arch, arm AS best_arm FROM b WHERE split='train' GROUP BY 1,2 QUALIFY row_number() OVER (PARTITION BY arch ORDER BY count(*) DESC, arm) = 1)
SELECT arch, best_arm, count(*) AS n_other, count(*) FILTER (arm=best_arm) AS n_agree FROM b JOIN t USING (arch) WHERE split<>'train' GROUP BY 1,2""")
def archetype_best_arm(v):
    """Best arm per archetype fitted on the training split, checked on the rest."""
    nrm = text.norm_text(F.col("address_text"))
    rel = nrm.rlike(r"\b(near|opposite|behind|beside|adjacent|next to)\b")
    road = F.arrays_overlap(F.split(nrm, " "), F.array(*[F.lit(x) for x in ("gali", "road", "cross", "main", "street")]))
    a = v.address().join(v.split(), "account_id").select("address_id", "split", F.when(rel, "landmark-relation").when(road, "road").otherwise("other").alias("arch"))
    b = surveyed_scored(v).join(a, "address_id").groupBy("address_id", "arch", "split").agg(F.min_by("arm", F.struct("err", "candidate_id")).alias("arm"))
    t = b.filter("split = 'train'").groupBy("arch", "arm").agg(F.count("*").alias("c"))
    best = t.groupBy("arch").agg(F.min(F.struct((-F.col("c")).alias("o"), F.col("arm"))).alias("m")).select("arch", F.col("m.arm").alias("best_arm"))
    return b.filter("split <> 'train'").join(best, "arch").groupBy("arch", "best_arm").agg(
        F.count("*").alias("n_other"), F.count_if(F.col("arm") == F.col("best_arm")).alias("n_agree"))


@query("absolute_bound", f"""
SELECT address_id, round(min({dist('surveyed_x','surveyed_y','x','y')}),3) AS bound FROM w_surveyed JOIN w_address USING (address_id) JOIN (SELECT town_id, cx AS x, cy AS y FROM w_locality UNION ALL SELECT town_id, px, py FROM w_landmark) USING (town_id) GROUP BY 1""")
def absolute_bound(v):
    """Nearest official point of any kind in the town."""
    pts = v.locality().select("town_id", F.col("locality_id").alias("point_id"), F.col("cx").alias("x2"), F.col("cy").alias("y2")).unionByName(
        v.landmark().select("town_id", F.col("poi_id").alias("point_id"), F.col("px").alias("x2"), F.col("py").alias("y2")))
    s = v.surveyed().join(v.address().select("address_id", "town_id"), "address_id").select(
        "address_id", "town_id", F.col("surveyed_x").alias("x"), F.col("surveyed_y").alias("y"))
    return spatial.nearest(s, pts, "address_id", "point_id", 300.0, ["town_id"]).select("address_id", F.round("d", 3).alias("bound"))


POLICIES = [("base", 0.50, 30.0), ("strict", 0.60, 30.0), ("wide", 0.50, 60.0), ("loose", 0.40, 60.0)]


@query("policy_sweep", f"""
WITH p AS (SELECT * FROM (VALUES {','.join(f"('{n}',{w}::DOUBLE,{b}::DOUBLE)" for n, w, b in POLICIES)}) t(policy, wp, band)), e AS (SELECT policy, band, address_id, x, y FROM p JOIN w_evcut ON polarity='positive' AND weight>=wp AND x IS NOT NULL),
 m AS (SELECT policy, band, address_id, quantile_cont(x,0.5) AS mx, quantile_cont(y,0.5) AS my, count(*) AS n FROM e GROUP BY 1,2,3 HAVING count(*)>=2),
 k AS (SELECT m.policy, m.address_id, mx, my FROM m JOIN e USING (policy, address_id) GROUP BY ALL HAVING max({dist('e.x','e.y','mx','my')}) <= max(m.band)),
 r AS (SELECT policy, address_id, {dist('mx','my','tx','ty')} AS err FROM k JOIN w_point USING (address_id))
SELECT a.policy, count(*) AS n, round(avg(a.err),3) AS mean_err, count(b.err) AS n_paired, round(avg(a.err-b.err),3) AS mean_diff FROM r a LEFT JOIN (SELECT * FROM r WHERE policy='base') b USING (address_id) GROUP BY 1""")
def policy_sweep(v):
    """One pass over the log for every policy row, compared with the base policy on shared addresses."""
    rows = F.array(*[F.struct(F.lit(n).alias("policy"), F.lit(w).alias("wp"), F.lit(b).alias("band")) for n, w, b in POLICIES])
    e = (known_before(belief.evidence_stage(v), AS_OF).filter("polarity = 'positive' and x is not null").withColumn("p", F.explode(rows))
         .filter("weight >= p.wp").select("address_id", "x", "y", "p.policy", "p.band"))
    m = e.groupBy("policy", "band", "address_id").agg(F.percentile("x", 0.5).alias("mx"), F.percentile("y", 0.5).alias("my"), F.count("*").alias("n")).filter("n >= 2")
    far = e.join(m.select("policy", "address_id", "mx", "my"), ["policy", "address_id"]).groupBy("policy", "address_id").agg(
        F.max(distance(F.col("x"), F.col("y"), F.col("mx"), F.col("my"))).alias("far"))
    r = m.join(far, ["policy", "address_id"]).filter("far <= band").join(v.place_point(), "address_id").select(
        "policy", "address_id", distance(F.col("mx"), F.col("my"), F.col("tx"), F.col("ty")).alias("err"))
    base = r.filter("policy = 'base'").select("address_id", F.col("err").alias("base_err"))
    return r.join(base, "address_id", "left").groupBy("policy").agg(
        F.count("*").alias("n"), F.round(F.avg("err"), 3).alias("mean_err"), F.count("base_err").alias("n_paired"),
        F.round(F.avg(F.col("err") - F.col("base_err")), 3).alias("mean_diff"))


SWEEP = [policy.BASE, replace(policy.BASE, name="strict", w_promote=0.60), replace(policy.BASE, name="wide", consistency_band_m=60.0), replace(policy.BASE, name="one_single", singles_max=1)]


def policy_views(p: policy.Policy) -> str:
    """Suffix of the belief chain's views with the constants of a policy."""
    suffix = f"_{p.name}"
    at_cut(suffix, AS_OF)
    for name in CUT_VIEWS:
        t = VIEWS[name + suffix]
        t = re.sub(r"\bweight ?>= ?0\.35\b", f"weight >= {p.w_min}", re.sub(r"\bweight ?>= ?0\.5\b", f"weight >= {p.w_promote}", t))
        t = t.replace("w_eff >= 0.35 AND w_eff < 0.5", f"w_eff >= {p.w_min} AND w_eff < {p.w_promote}").replace("pos AND w_eff >= 0.5", f"pos AND w_eff >= {p.w_promote}")
        t = t.replace("WHERE spread <= 30", f"WHERE spread <= {p.consistency_band_m}").replace("WHERE rn <= 3", f"WHERE rn <= {p.singles_max}")
        VIEWS[name + suffix] = t
    return suffix


for _p in SWEEP:
    policy_views(_p)


@query("policy_sweep_beliefs", f"""
WITH e AS (SELECT b.*, {dist('x','y','tx','ty')} AS err FROM ({' UNION ALL BY NAME '.join(f"SELECT '{p.name}' AS policy, * FROM w_belief_{p.name}" for p in SWEEP)}) b LEFT JOIN w_point USING (address_id)),
 b AS (SELECT address_id, err AS base_err, tier AS base_tier FROM e WHERE policy = 'base')
SELECT policy, count(*) AS n, count(*) FILTER (tier='CONFIRMED') AS confirmed, count(*) FILTER (tier='PROBABLE') AS probable, count(*) FILTER (tier='APPROXIMATE') AS approximate, count(*) FILTER (tier='UNPLACEABLE') AS unplaceable,
 count(*) FILTER (status='CONTESTED') AS contested, count(*) FILTER (status='MOVED_SUSPECTED') AS moved_suspected, round(quantile_cont(err,0.5),3) AS median_err, round(avg(err),3) AS mean_err, round(avg((err<=100)::INTEGER),4) AS hit_100,
 count(*) FILTER (err IS NOT NULL AND base_err IS NOT NULL) AS n_paired, round(avg(err-base_err),3) AS mean_diff, count(*) FILTER (tier <> base_tier) AS tier_changes FROM e LEFT JOIN b USING (address_id) GROUP BY 1""")
def policy_sweep_beliefs(v):
    """Tiers, statuses and errors of the whole belief plan under each policy, from one run."""
    return sweep.compared(sweep.beliefs(v, SWEEP, AS_OF), v.place_point().select("address_id", "tx", "ty"))


@query("safety_invariants", """
SELECT 'negatives_never_relocate' AS rule, count(*) AS violations FROM w_belief a JOIN w_belief_whatif b USING (address_id) WHERE a.candidate_id IS DISTINCT FROM b.candidate_id AND a.arm <> 'memory' AND b.arm <> 'memory'
UNION ALL SELECT 'negatives_never_upgrade', count(*) FROM w_belief a JOIN w_belief_whatif b USING (address_id) WHERE b.tier = 'CONFIRMED' AND a.tier <> 'CONFIRMED'
UNION ALL SELECT 'no_candidate_no_coordinate', count(*) FROM w_belief WHERE candidate_id IS NULL AND x IS NOT NULL
UNION ALL SELECT 'contested_keeps_approximate', count(*) FROM w_belief WHERE contested AND tier <> 'APPROXIMATE'""")
def safety_invariants(v):
    """Counts of violations; the first three must be zero by construction."""
    ev0 = known_before(belief.evidence_stage(v), AS_OF)
    base = ev0.select("address_id").distinct().withColumn("n", F.explode(F.array(F.lit(1), F.lit(2))))
    extra = base.select(
        (-(F.col("address_id") * 2 + F.col("n"))).alias("observation_id"), "address_id", F.concat(F.lit("R"), "n").alias("agent_id"),
        F.lit("no_such_person").alias("outcome"), F.lit("negative").alias("polarity"), F.lit(0.0).alias("weight"), F.lit("2024-01").alias("period"),
        F.lit("2024-01-07").cast("date").alias("day"), F.lit("2024-01-07 12:00:00").cast("timestamp").alias("observed_at"))
    after = belief.belief_from_log(v, ev0.unionByName(extra, allowMissingColumns=True), AS_OF, "two_denials")
    b = belief.belief_at(v, AS_OF)
    j = b.select("address_id", "candidate_id", "arm", "tier").join(after.select(
        "address_id", F.col("candidate_id").alias("c2"), F.col("arm").alias("a2"), F.col("tier").alias("t2")), "address_id")
    def rule(df, name, bad):
        return df.agg(F.lit(name).alias("rule"), F.count_if(F.coalesce(bad, F.lit(False))).alias("violations"))
    return union_all([
        rule(j, "negatives_never_relocate", ~F.col("candidate_id").eqNullSafe(F.col("c2")) & (F.col("arm") != "memory") & (F.col("a2") != "memory")),
        rule(j, "negatives_never_upgrade", (F.col("t2") == "CONFIRMED") & (F.col("tier") != "CONFIRMED")),
        rule(b, "no_candidate_no_coordinate", F.col("candidate_id").isNull() & F.col("x").isNotNull()),
        rule(b, "contested_keeps_approximate", F.col("contested") & (F.col("tier") != "APPROXIMATE"))])


@query("coordinate_policy_study", f"""
SELECT coord_method, count(*) AS n, round(quantile_cont({dist('x','y','checkin_x','checkin_y')},0.5),3) AS median_shift, round(quantile_cont({dist('x','y','tx','ty')},0.5),3) AS median_err,
 round(quantile_cont({dist('checkin_x','checkin_y','tx','ty')},0.5),3) AS median_checkin_err FROM w_obs JOIN w_point USING (address_id) WHERE x IS NOT NULL GROUP BY 1""")
def coordinate_policy_study(v):
    """Trace-tail coordinate against the raw check-in: shift and error of both."""
    o = v.observation().filter("x is not null").join(v.place_point(), "address_id")
    d = lambda a, b, c, e: distance(F.col(a), F.col(b), F.col(c), F.col(e))
    o = o.select("coord_method", d("x", "y", "checkin_x", "checkin_y").alias("s"), d("x", "y", "tx", "ty").alias("e"), d("checkin_x", "checkin_y", "tx", "ty").alias("c"))
    a = group_quantiles(o, ["coord_method"], "s", {"median_shift": 0.5})
    b = group_quantiles(o, ["coord_method"], "e", {"median_err": 0.5}).drop("n")
    c = group_quantiles(o, ["coord_method"], "c", {"median_checkin_err": 0.5}).drop("n")
    return a.join(b, "coord_method").join(c, "coord_method").select("coord_method", "n", *[
        F.round(x, 3).alias(x) for x in ("median_shift", "median_err", "median_checkin_err")])


@query("evaluation_labels", "SELECT candidate_id, round(err,3) AS err_m, err<=100 AS within_100m, err<=250 AS within_250m, err = min(err) OVER (PARTITION BY address_id) AS is_best_of_set FROM w_errs")
def evaluation_labels(v):
    w = Window.partitionBy("address_id")
    return surveyed_scored(v).select("candidate_id", F.round("err", 3).alias("err_m"), (F.col("err") <= 100).alias("within_100m"),
                                     (F.col("err") <= 250).alias("within_250m"), (F.col("err") == F.min("err").over(w)).alias("is_best_of_set"))


@query("grade_pairs", f"""
SELECT count(*) AS n_addresses, sum((n*n-ss)//2)::BIGINT AS pairs_with_different_grades, round(avg(pos),4) AS positives_per_address FROM (SELECT address_id, sum(c)::BIGINT AS n, sum(c*c)::BIGINT AS ss, coalesce(sum(c) FILTER (g>0),0) AS pos FROM (
 SELECT address_id, {GRADE} AS g, count(*) AS c FROM w_errs GROUP BY 1,2) GROUP BY 1)""")
def grade_pairs(v):
    """Comparable pairs from grade counts: (n^2 - sum of squares) / 2, no pair is formed."""
    c = surveyed_scored(v).groupBy("address_id", ev.grade(F.col("err")).alias("g")).agg(F.count("*").alias("c"))
    a = c.groupBy("address_id").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("ss"), F.coalesce(F.sum(F.when(F.col("g") > 0, F.col("c"))), F.lit(0)).alias("pos"))
    return a.agg(F.count("*").alias("n_addresses"), F.sum(F.floor((F.col("n") * F.col("n") - F.col("ss")) / 2)).alias("pairs_with_different_grades"),
                 F.round(F.avg("pos"), 4).alias("positives_per_address"))


@query("empirical_centres", f"""
SELECT locality_id, count(*) AS n, round(quantile_cont(geocoder_x,0.5),6) AS mx, round(quantile_cont(geocoder_y,0.5),6) AS my, round({dist('quantile_cont(geocoder_x,0.5)','quantile_cont(geocoder_y,0.5)','any_value(cx)','any_value(cy)')},3) AS shift
FROM w_locbest JOIN w_pin USING (address_id) JOIN w_locality USING (locality_id) WHERE precision IN ('rooftop','street') GROUP BY 1""")
def empirical_centres(v):
    addr = cand.prepared_addresses(v.address())
    loc = v.locality()
    best = cand.best_locality(cand.locality_hits(addr, loc, "2024-02-01")).select("address_id", "locality_id")
    m = (best.join(v.pin().filter(F.col("precision").isin("rooftop", "street")), "address_id").groupBy("locality_id")
         .agg(F.count("*").alias("n"), F.percentile("geocoder_x", 0.5).alias("mx"), F.percentile("geocoder_y", 0.5).alias("my")))
    return m.join(loc.select("locality_id", "cx", "cy"), "locality_id").select(
        "locality_id", "n", F.round("mx", 6).alias("mx"), F.round("my", 6).alias("my"), F.round(distance(F.col("mx"), F.col("my"), F.col("cx"), F.col("cy")), 3).alias("shift"))


@query("label_permutation")
def label_permutation(v):
    """Negative control: labels permuted within each address by a keyed hash order."""
    s = surveyed_scored(v)
    by_id = s.withColumn("r", F.row_number().over(Window.partitionBy("address_id").orderBy("candidate_id")))
    h = F.xxhash64("candidate_id", F.lit(7))
    by_hash = s.withColumn("r", F.row_number().over(Window.partitionBy("address_id").orderBy(h, "candidate_id"))).select(
        "address_id", "r", F.col("err").alias("permuted_err"))
    return by_id.join(by_hash, ["address_id", "r"]).select("address_id", "candidate_id", "rank", "err", "permuted_err")


NUM = ["f_arm_prior", "f_granularity_rank", "f_locality_name_matched", "f_pin_in_text", "f_pin_unknown", "f_no_digit", "f_no_separator", "f_outside_town",
       "f_sim_jaccard", "f_sim_char3", "f_sim_ratio", "f_n_candidates", "f_agreement_count", "f_dist_to_town_centroid_m"]


def _challenger(train, test):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexerModel, VectorAssembler
    from pyspark.ml.functions import vector_to_array
    strata = StringIndexerModel.from_labels(["rooftop", "street", "locality", "pincode", "town"], inputCol="f_baseline_stratum",
                                            outputCol="si", handleInvalid="keep")
    pipe = Pipeline(stages=[strata, OneHotEncoder(inputCol="si", outputCol="oh", handleInvalid="keep"),
                            VectorAssembler(inputCols=[*NUM, "oh"], outputCol="raw", handleInvalid="keep"),
                            StandardScaler(inputCol="raw", outputCol="features", withMean=True), LogisticRegression(maxIter=30, regParam=0.01)])
    model = pipe.fit(train)
    return model.transform(test).select("address_id", "candidate_id", "arm", "err", "x", "y", "granularity", "rank",
                                        vector_to_array("probability")[1].alias("p"))


def _design(v):
    """Folds are those of the place blocks; an address without a block has a fold of its own id."""
    from placeproof.catalog.sets import folds
    d = in_blocks(v, surveyed_scored(v).withColumn("label", (F.col("err") <= 250).cast("double")).fillna(0.0, NUM)).join(folds(v), "block_id", "left")
    return d.withColumn("fold", F.coalesce("fold", F.pmod("address_id", F.lit(5))))


@query("logistic_challenger")
def logistic_challenger(v):
    """Fixed one-hot design matrix and a logistic challenger, compared with the rule on its own rows."""
    d = _design(v)
    p = _challenger(d.filter("fold <> 0"), d.filter("fold = 0"))
    a = ev.top1(p, [-F.col("p")]).agg(F.lit("logistic").alias("ranker"), F.count("*").alias("n"), *ev.hits())
    b = ev.top1(p, [F.col("rank")]).agg(F.lit("rule").alias("ranker"), F.count("*").alias("n"), *ev.hits())
    return a.unionByName(b)


@query("out_of_fold_challenger")
def out_of_fold_challenger(v):
    """Out-of-fold predictions over five folds, then the same comparison on all rows."""
    d = _design(v)
    p = union_all([_challenger(d.filter(F.col("fold") != f), d.filter(F.col("fold") == f)) for f in range(5)])
    a = ev.top1(p, [-F.col("p")]).agg(F.lit("logistic").alias("ranker"), F.count("*").alias("n"), *ev.hits())
    b = ev.top1(p, [F.col("rank")]).agg(F.lit("rule").alias("ranker"), F.count("*").alias("n"), *ev.hits())
    return a.unionByName(b)


@query("locked_set_composition", """
SELECT address_type, round(count(*) FILTER (s)/(SELECT count(*) FROM w_surveyed),6) AS share_locked, round(count(*)/(SELECT count(*) FROM w_address),6) AS share_population FROM (
 SELECT *, address_id IN (SELECT address_id FROM w_surveyed) AS s FROM w_address) GROUP BY 1""")
def locked_set_composition(v):
    a = v.address().join(v.surveyed().select("address_id", F.lit(1).alias("s")), "address_id", "left")
    t = a.agg(F.count("*").alias("na"), F.count("s").alias("ns"))
    g = a.groupBy("address_type").agg(F.count("s").alias("k"), F.count("*").alias("n"))
    return g.crossJoin(F.broadcast(t)).select("address_type", F.round(F.col("k") / F.col("ns"), 6).alias("share_locked"), F.round(F.col("n") / F.col("na"), 6).alias("share_population"))


@query("sibling_pins", f"""
WITH k AS (SELECT a.address_id, a.town_id, locality_id, regexp_extract(norm,'([0-9]+)th cross',1) AS road FROM w_addr a JOIN w_locbest USING (address_id) WHERE added_date < DATE '2024-02-01'),
 p AS (SELECT k.*, geocoder_x AS x, geocoder_y AS y FROM k JOIN w_pin USING (address_id)),
 s AS (SELECT a.address_id, quantile_cont(b.x,0.5) AS mx, quantile_cont(b.y,0.5) AS my, count(*) AS n FROM p a JOIN p b ON a.locality_id=b.locality_id AND a.road=b.road AND a.address_id<>b.address_id GROUP BY 1)
SELECT count(*) AS n_with_sibling, count(*) FILTER ({dist('mx','my','tx','ty')} < {dist('geocoder_x','geocoder_y','tx','ty')}) AS sibling_better FROM s JOIN w_pin USING (address_id) JOIN w_point USING (address_id)""")
def sibling_pins(v):
    """Median pin of the other records on the same (locality, road), against the own pin."""
    from placeproof.operators.leave_one_out import leave_one_out_median
    addr = cand.prepared_addresses(v.address())
    best = cand.best_locality(cand.locality_hits(addr, v.locality(), "2024-02-01")).select("address_id", "locality_id")
    road = F.regexp_extract("norm", "([0-9]+)th cross", 1)
    p = (addr.filter(F.col("added_date") < F.lit("2024-02-01").cast("date")).select("address_id", road.alias("road")).join(best, "address_id")
         .join(v.pin(), "address_id").withColumn("key", F.concat_ws("|", "locality_id", "road")))
    x = leave_one_out_median(p, "key", "address_id", "geocoder_x", "mx").drop("n_others")
    y = leave_one_out_median(p, "key", "address_id", "geocoder_y", "my").drop("n_others")
    j = x.join(y, "address_id").join(v.pin(), "address_id").join(v.place_point(), "address_id")
    better = distance(F.col("mx"), F.col("my"), F.col("tx"), F.col("ty")) < distance(F.col("geocoder_x"), F.col("geocoder_y"), F.col("tx"), F.col("ty"))
    return j.agg(F.count("*").alias("n_with_sibling"), F.count_if(better).alias("sibling_better"))


@query("resolver_variants", """
WITH h AS (SELECT address_id, locality_id, n_name, count(*)/n_name AS cov, bool_or(token=rare) AS has_rare FROM (SELECT address_id, town_id, unnest(list_distinct(toks)) AS token FROM w_addr) JOIN w_loctok USING (town_id, token) GROUP BY 1,2,3)
SELECT 'coverage_half_rare' AS variant, count(DISTINCT address_id) AS resolved, count(*) AS proposals FROM h WHERE cov>=0.5 AND has_rare UNION ALL SELECT 'coverage_half', count(DISTINCT address_id), count(*) FROM h WHERE cov>=0.5
UNION ALL SELECT 'all_tokens', count(DISTINCT address_id), count(*) FROM h WHERE cov>=1 UNION ALL SELECT 'any_token', count(DISTINCT address_id), count(*) FROM h""")
def resolver_variants(v):
    addr = cand.prepared_addresses(v.address())
    lt = cand.locality_tokens(v.locality(), addr, "2024-02-01")
    h = (tokenjoin.token_index(addr, "address_id", "toks", ["town_id"]).join(lt, ["town_id", "token"]).groupBy("address_id", "locality_id", "n_name")
         .agg((F.count("*") / F.col("n_name")).alias("cov"), F.bool_or(F.col("token") == F.col("rare")).alias("has_rare")))
    names = {"coverage_half_rare": (F.col("cov") >= 0.5) & F.col("has_rare"), "coverage_half": F.col("cov") >= 0.5, "all_tokens": F.col("cov") >= 1, "any_token": F.lit(True)}
    tags = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in names.items()]))
    return h.select("address_id", F.explode(tags).alias("variant")).groupBy("variant").agg(F.count_distinct("address_id").alias("resolved"), F.count("*").alias("proposals"))


@query("arm_ablation", """
SELECT removed, count(*) AS n, round(avg(e),3) AS mean_oracle, round(avg((e<=500)::INTEGER),4) AS recall_500 FROM (SELECT removed, address_id, min(err) AS e FROM w_errs JOIN (
 SELECT unnest(['frozen_baseline','locality_centroid','town_centroid','official_landmark','address_book','field_evidence','memory']) AS removed) ON arm <> removed GROUP BY 1,2) GROUP BY 1""")
def arm_ablation(v):
    """Oracle without each arm, from the per-arm minima of each address."""
    a = surveyed_scored(v).groupBy("address_id", "arm").agg(F.min("err").alias("e"))
    arms = F.array(*[F.lit(x) for x in policy.ARMS])
    r = a.select("address_id", "e", F.explode(F.array_remove(arms, F.col("arm"))).alias("removed")).groupBy("removed", "address_id").agg(F.min("e").alias("e"))
    return r.groupBy("removed").agg(F.count("*").alias("n"), F.round(F.avg("e"), 3).alias("mean_oracle"), F.round(F.avg((F.col("e") <= 500).cast("int")), 4).alias("recall_500"))


@query("error_curve", f"SELECT x, round(avg((err<=x)::INTEGER),6) AS share FROM {PIN_ERR}, (SELECT unnest([25,50,100,150,250,400,500,750,1000]) AS x) GROUP BY 1")
def error_curve(v):
    """Share within X metres over a grid of X, as conditional averages of one pass."""
    xs = [25, 50, 100, 150, 250, 400, 500, 750, 1000]
    one = pin_errors(v).agg(*[F.round(F.avg((F.col("err") <= x).cast("int")), 6).alias(f"s{x}") for x in xs])
    return one.select(F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.col(f"s{x}").alias("share")) for x in xs])).alias("r")).select("r.*")


@query("extra_generators", f"""
WITH p AS (SELECT address_id, locality_id, {'list_distinct(list_transform(range(1,length(norm)-1), lambda i: substr(norm,i,3)))'} AS g, geocoder_x AS x, geocoder_y AS y FROM w_addr JOIN w_locbest USING (address_id) JOIN w_pin USING (address_id)),
 c AS (SELECT a.address_id, b.address_id AS other, b.x, b.y, round(len(list_intersect(a.g,b.g))/len(list_distinct(list_concat(a.g,b.g))),6) AS j FROM p a JOIN p b ON a.locality_id=b.locality_id AND a.address_id<>b.address_id
  WHERE len(list_intersect(a.g,b.g))/len(list_distinct(list_concat(a.g,b.g))) >= 0.5)
SELECT address_id, other, j FROM c QUALIFY row_number() OVER (PARTITION BY address_id ORDER BY j DESC, other) = 1""")
def extra_generators(v):
    """Nearest-text pinned record in the same locality (J >= 0.5): prefix-filtered set join, best hit."""
    addr = cand.prepared_addresses(v.address())
    best = cand.best_locality(cand.locality_hits(addr, v.locality(), "2024-02-01")).select("address_id", "locality_id")
    p = addr.join(best, "address_id").join(v.pin().select("address_id"), "address_id").select(
        "address_id", "locality_id", text_grams(F.col("norm")).alias("g"))
    pairs, groups, members = tokenjoin.jaccard_pairs(p, "address_id", "g", 0.5, ["locality_id"])
    # a set's own copies count too: its two smallest members stand for the rest
    first = members.groupBy("rep").agg(F.min("address_id").alias("m1"))
    second = members.join(first, "rep").filter("address_id > m1").groupBy("rep").agg(F.min("address_id").alias("m2"))
    ends = first.join(second, "rep", "left")
    sym = pairs.select(F.col("ra").alias("rep"), F.col("rb").alias("o"), "jaccard").unionByName(
        pairs.select(F.col("rb").alias("rep"), F.col("ra").alias("o"), "jaccard"))
    near = (sym.join(ends.select(F.col("rep").alias("o"), "m1"), "o").groupBy("rep").agg(
        F.min(F.struct((-F.round("jaccard", 6)).alias("nj"), F.col("m1"))).alias("b")))
    j = members.join(ends, "rep").join(near, "rep", "left")
    twin = F.when(F.col("address_id") == F.col("m1"), F.col("m2")).otherwise(F.col("m1"))
    return j.select("address_id", F.coalesce(twin, F.col("b.m1")).alias("other"),
                    F.when(twin.isNotNull(), F.lit(1.0)).otherwise(-F.col("b.nj")).alias("j")).filter("other is not null")


NEAR_TEXTS = f"""p AS (SELECT address_id, locality_id, {'list_distinct(list_transform(range(1,length(norm)-1), lambda i: substr(norm,i,3)))'} AS g, geocoder_x AS x, geocoder_y AS y FROM w_addr JOIN w_locbest USING (address_id) JOIN w_pin USING (address_id)),
 c AS (SELECT a.address_id, b.address_id AS other, b.x, b.y, round(len(list_intersect(a.g,b.g))/len(list_distinct(list_concat(a.g,b.g))),6) AS j FROM p a JOIN p b ON a.locality_id=b.locality_id AND a.address_id<>b.address_id
  WHERE len(list_intersect(a.g,b.g))/len(list_distinct(list_concat(a.g,b.g))) >= 0.5),
 one AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY address_id ORDER BY j DESC, other) = 1),
 two AS (SELECT c.* FROM c JOIN one USING (address_id) WHERE {dist('c.x','c.y','one.x','one.y')} > 100 QUALIFY row_number() OVER (PARTITION BY address_id ORDER BY c.j DESC, c.other) = 1),
 k AS (SELECT address_id, 1 AS pick, other, j, x, y FROM one UNION ALL SELECT address_id, 2, other, j, x, y FROM two)"""


def near_text_picks(v):
    """(address_id, pick, other, j, x, y): pinned records of similar text (J >= 0.5) in the same locality, the first and the next one that is over 100 m from it.

    All members of a set of equal grams have the same list of others but for themselves, so only the first two of the list are needed for
    the first pick, and for each of these two the first two over 100 m away.  Members at one pin are folded, sets meet sets: n copies
    against m copies are not paired.
    """
    def build():
        addr = belief.prepared_stage(v)
        best = cand.best_locality(cand.locality_hits(addr, v.locality(), "2024-02-01")).select("address_id", "locality_id")
        p = checkpoint(addr.join(best, "address_id").join(v.pin().select("address_id", F.col("geocoder_x").alias("x"), F.col("geocoder_y").alias("y")), "address_id")
                       .select("address_id", "locality_id", text_grams(F.col("norm")).alias("g"), "x", "y"))
        pairs, _, members = tokenjoin.jaccard_pairs(p, "address_id", "g", 0.5, ["locality_id"])
        members = checkpoint(members.join(p.select("address_id", "x", "y"), "address_id"))
        # the two smallest members at each pin of a set: one of them is never the asking record itself
        w = Window.partitionBy("rep", "x", "y").orderBy("address_id")
        few = members.withColumn("k", F.row_number().over(w)).filter("k <= 2").select("rep", F.col("address_id").alias("other"), "x", "y")
        both = pairs.select(F.col("ra").alias("rep"), F.col("rb").alias("o"), "jaccard").unionByName(pairs.select(F.col("rb").alias("rep"), F.col("ra").alias("o"), "jaccard"))
        own = members.select("rep").distinct().select("rep", F.col("rep").alias("o"), F.lit(1.0).alias("jaccard"))
        line = checkpoint(both.unionByName(own).join(few.withColumnRenamed("rep", "o"), "o").select("rep", F.round("jaccard", 6).alias("j"), "other", "x", "y"))
        order = Window.partitionBy("rep").orderBy(F.desc("j"), "other")
        first = line.withColumn("k", F.row_number().over(order)).filter("k <= 2").select("rep", F.struct("other", "j", "x", "y").alias("f"), "k")
        apart = line.join(first, "rep").filter(distance(F.col("x"), F.col("y"), F.col("f.x"), F.col("f.y")) > 100)
        again = Window.partitionBy("rep", "k").orderBy(F.desc("j"), "other")
        second = apart.withColumn("r", F.row_number().over(again)).filter("r <= 2").groupBy("rep", "k").agg(F.sort_array(F.collect_list(F.struct("r", F.struct("other", "j", "x", "y").alias("s")))).alias("s"))
        lists = first.join(second, ["rep", "k"], "left").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("k", "f", "s"))).alias("l"))
        mine = members.select("address_id", "rep").join(lists, "rep")
        used = F.get(F.filter("l", lambda e: e["f"]["other"] != F.col("address_id")), F.lit(0))
        got = mine.withColumn("u", used).filter("u is not null")
        next_ = F.get(F.filter("u.s", lambda e: e["s"]["other"] != F.col("address_id")), F.lit(0))["s"]
        return got.select("address_id", F.posexplode(F.array(F.col("u.f"), next_)).alias("i", "c")).filter("c is not null").select("address_id", (F.col("i") + 1).alias("pick"), "c.*")
    return stage(v, "near_text_picks", build)


@query("extra_generator_picks", f"WITH {NEAR_TEXTS} SELECT address_id, pick::INTEGER AS pick, other, j FROM k")
def extra_generator_picks(v):
    return near_text_picks(v).select("address_id", "pick", "other", "j")


@query("extra_generator_report", f"""
WITH {NEAR_TEXTS}, b AS (SELECT address_id, round(min({dist('x','y','lx','ly')}),1) AS base FROM w_cand JOIN w_label USING (address_id) GROUP BY 1),
 n AS (SELECT address_id, 'near_duplicate' AS generator, round(min({dist('x','y','lx','ly')}),1) AS err FROM k JOIN w_label USING (address_id) GROUP BY 1
  UNION ALL SELECT address_id, 'pin_consistent_locality', round(min({dist('cx','cy','lx','ly')}),1) FROM w_locbest JOIN w_loc USING (locality_id) JOIN w_label USING (address_id) JOIN w_addr USING (address_id) WHERE pin_text IS NOT NULL GROUP BY 1)
SELECT generator, count(*) AS n, round(count(*)/(SELECT count(*) FROM b),4) AS coverage, round(quantile_cont(err,0.5),3) AS median_m, round(avg((err<=250)::INTEGER),4) AS hit_250, round(avg((err<=500)::INTEGER),4) AS hit_500,
 count(*) FILTER (err + 25 < base) AS beats, count(*) FILTER (err > base + 25) AS worse, count(*) FILTER (base > 500 AND err <= 500) AS rescues FROM n JOIN b USING (address_id) GROUP BY 1""")
def extra_generator_report(v):
    """What the two further generators would add to the frozen candidates, against the proxy label."""
    label = evidence.proxy_label(known_before(belief.evidence_stage(v), AS_OF)).select("address_id", "lx", "ly")
    to_label = lambda x, y: F.round(F.min(distance(F.col(x), F.col(y), F.col("lx"), F.col("ly"))), 1)
    base = cand.exploded(belief.bare_sets(v, AS_OF)).join(label, "address_id").groupBy("address_id").agg(to_label("x", "y").alias("base"))
    near = near_text_picks(v).join(label, "address_id").groupBy("address_id").agg(to_label("x", "y").alias("err")).withColumn("generator", F.lit("near_duplicate"))
    addr, loc = belief.prepared_stage(v), v.locality()
    named = cand.best_locality(cand.locality_hits(addr, loc, "2024-02-01")).join(addr.filter("pin_text is not null").select("address_id"), "address_id").join(loc.select("locality_id", "cx", "cy"), "locality_id")
    hier = named.join(label, "address_id").groupBy("address_id").agg(to_label("cx", "cy").alias("err")).withColumn("generator", F.lit("pin_consistent_locality"))
    n = base.agg(F.count("*").alias("n"))
    e, b = F.col("err"), F.col("base")
    share = lambda m: F.round(F.avg((e <= m).cast("int")), 4)
    out = near.unionByName(hier).join(base, "address_id").groupBy("generator").agg(
        F.count("*").alias("n"), F.round(F.percentile("err", 0.5), 3).alias("median_m"), share(250).alias("hit_250"), share(500).alias("hit_500"),
        F.count_if(e + 25 < b).alias("beats"), F.count_if(e > b + 25).alias("worse"), F.count_if((b > 500) & (e <= 500)).alias("rescues"))
    return out.withColumn("coverage", F.round(F.col("n") / n.scalar(), 4))


def text_grams(n):
    return F.when(F.length(n) < 3, F.array().cast("array<string>")).otherwise(F.transform(
        F.sequence(F.lit(1), F.length(n) - 2), lambda i: F.substring(n, i, F.lit(3))))
