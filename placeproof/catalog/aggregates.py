"""Aggregation jobs."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from placeproof import policy
from placeproof.catalog import query
from placeproof.catalog.joins import blocks_stage
from placeproof.catalog.oracle_views import dist
from placeproof.functions import text
from placeproof.functions.geo import distance
from placeproof.operators.hull import group_diameter
from placeproof.operators.profile import union_all
from placeproof.operators.quantiles import group_quantiles
from placeproof.operators.tokenjoin import contains_join
from placeproof.plans import candidates as cand

MET = "outcome IN ('met_borrower','met_family','cash_collected')"


def met():
    return F.col("outcome").isin(policy.POSITIVE_OUTCOMES)


def rate(c, name, digits=6):
    return F.round(F.avg(c.cast("int")), digits).alias(name)


def pin_errors(v):
    return v.pin().join(v.place_point(), "address_id").withColumn("err", distance(
        F.col("geocoder_x"), F.col("geocoder_y"), F.col("tx"), F.col("ty")))


PIN_ERR = f"(SELECT *, {dist('geocoder_x','geocoder_y','tx','ty')} AS err FROM w_pin JOIN w_point USING (address_id))"


@query("pin_error_by_precision", f"""
SELECT precision, count(*) AS n, round(quantile_cont(err,0.5),3) AS median, round(quantile_cont(err,0.75),3) AS p75, round(quantile_cont(err,0.9),3) AS p90,
  round(max(err),3) AS worst, round(avg((err<=100)::INTEGER),4) AS hit_100m, round(avg((err<=250)::INTEGER),4) AS hit_250m, round(avg((err<=500)::INTEGER),4) AS hit_500m
FROM {PIN_ERR} GROUP BY 1""")
def pin_error_by_precision(v):
    e = pin_errors(v)
    q = group_quantiles(e, ["precision"], "err", {"median": 0.5, "p75": 0.75, "p90": 0.9})
    a = e.groupBy("precision").agg(F.round(F.max("err"), 3).alias("worst"), *[
        F.round(F.avg((F.col("err") <= t).cast("int")), 4).alias(f"hit_{t}m") for t in (100, 250, 500)])
    return q.select("precision", "n", *[F.round(c, 3).alias(c) for c in ("median", "p75", "p90")]).join(a, "precision")


@query("quantile_rules", """
SELECT l_returnflag, count(*) AS n, round(quantile_cont(l_extendedprice,0.5),4) AS linear_p50, round(quantile_cont(l_extendedprice,0.9),4) AS linear_p90,
  round((list_sort(list(l_extendedprice)))[floor(0.5*(count(*)-1))::BIGINT+1],4) AS lower_p50, round((list_sort(list(l_extendedprice)))[floor(0.9*(count(*)-1))::BIGINT+1],4) AS lower_p90
FROM lineitem GROUP BY 1""")
def quantile_rules(v):
    """Both quantile rules side by side on few, very large groups."""
    li = v.raw("lineitem")
    a = group_quantiles(li, ["l_returnflag"], "l_extendedprice", {"linear_p50": 0.5, "linear_p90": 0.9})
    b = group_quantiles(li, ["l_returnflag"], "l_extendedprice", {"lower_p50": 0.5, "lower_p90": 0.9}, rule="lower")
    j = a.join(b.drop("n"), "l_returnflag")
    return j.select("l_returnflag", "n", *[F.round(c, 4).alias(c) for c in
                                           ("linear_p50", "linear_p90", "lower_p50", "lower_p90")])


@query("median_position", f"""
SELECT address_id, count(*) AS n, round(quantile_cont(checkin_x,0.5),3) AS mx, round(quantile_cont(checkin_y,0.5),3) AS my FROM w_checkin
WHERE {MET} AND checkin_x IS NOT NULL GROUP BY 1""")
def median_position(v):
    c = v.checkin().filter(met() & F.col("checkin_x").isNotNull())
    return c.groupBy("address_id").agg(F.count("*").alias("n"), F.round(F.percentile("checkin_x", 0.5), 3).alias("mx"),
                                       F.round(F.percentile("checkin_y", 0.5), 3).alias("my"))


@query("town_centroids", "SELECT town_id, round(tcx,3) AS tcx, round(tcy,3) AS tcy FROM w_towncent")
def town_centroids(v):
    return cand.town_centroids(v.locality()).select("town_id", F.round("tcx", 3).alias("tcx"), F.round("tcy", 3).alias("tcy"))


STEPS_SQL = """(SELECT *, CASE WHEN dt > 0 THEN round(3.6*step/dt,1) END AS speed FROM (SELECT *, sqrt(((dx-lag(dx) OVER w)*(dx-lag(dx) OVER w)+(dy-lag(dy) OVER w)*(dy-lag(dy) OVER w))::DOUBLE) AS step,
  (epoch_us(point_ts)-epoch_us(lag(point_ts) OVER w))/1e6 AS dt FROM w_trace WHERE dx<>0 AND dy<>0 WINDOW w AS (PARTITION BY visit_id ORDER BY seq, dx, dy, point_ts)))"""


def trace_steps(v):
    """Step length, time delta and speed between consecutive clean fixes of a visit."""
    w = Window.partitionBy("visit_id").orderBy("seq", "dx", "dy", "point_ts")
    t = v.trace().filter((F.col("dx") != 0) & (F.col("dy") != 0))
    t = (t.withColumn("step", distance(F.lag("dx").over(w), F.lag("dy").over(w), F.col("dx"), F.col("dy")))
         .withColumn("dt", (F.unix_micros("point_ts") - F.lag(F.unix_micros("point_ts")).over(w)) / 1e6))
    return t.withColumn("speed", F.when(F.col("dt") > 0, F.round(3.6 * F.col("step") / F.col("dt"), 1)))


@query("trail_features", f"""
SELECT visit_id, count(*) AS n_points, quantile_cont(accuracy_m,0.5) AS acc_med, round(quantile_cont(accuracy_m,0.9),4) AS acc_p90, round(sum(dt),3) AS span_s, round(sum(step),3) AS path_m,
  max(speed) AS speed_max, round(quantile_cont(speed,0.9),4) AS speed_p90, quantile_cont(dx,0.5) AS x_med, quantile_cont(dy,0.5) AS y_med,
  arg_min(dx,(seq,dx,dy)) AS x_first, arg_max(dx,(seq,dx,dy)) AS x_last, arg_min(dy,(seq,dx,dy)) AS y_first, arg_max(dy,(seq,dx,dy)) AS y_last,
  round(any_value({dist('cx','cy','mx','my')}),3) AS dist_checkin_to_median_m, round(any_value({dist('cx','cy','fx','fy')}),3) AS dist_start_to_checkin_m
FROM {STEPS_SQL} LEFT JOIN (SELECT c.visit_id, checkin_x - tx AS cx, checkin_y - ty AS cy FROM w_checkin c) USING (visit_id) LEFT JOIN (
 SELECT visit_id, quantile_cont(dx,0.5) AS mx, quantile_cont(dy,0.5) AS my, arg_min(dx,(seq,dx,dy)) AS fx, arg_min(dy,(seq,dx,dy)) AS fy FROM w_trace WHERE dx<>0 AND dy<>0 GROUP BY 1) USING (visit_id) GROUP BY visit_id""")
def trail_features(v):
    # accuracies, offsets and rounded speeds are small domains: the exact percentile buffers merge
    # map-side and stay small even for a visit with most of the fixes
    o = F.struct("seq", "dx", "dy")
    t = trace_steps(v).groupBy("visit_id").agg(
        F.count("*").alias("n_points"), F.percentile("accuracy_m", 0.5).alias("acc_med"),
        F.round(F.percentile("accuracy_m", 0.9), 4).alias("acc_p90"), F.round(F.sum("dt"), 3).alias("span_s"),
        F.round(F.sum("step"), 3).alias("path_m"), F.max("speed").alias("speed_max"),
        F.round(F.percentile("speed", 0.9), 4).alias("speed_p90"), F.percentile("dx", 0.5).alias("x_med"),
        F.percentile("dy", 0.5).alias("y_med"), F.min_by("dx", o).alias("x_first"), F.max_by("dx", o).alias("x_last"),
        F.min_by("dy", o).alias("y_first"), F.max_by("dy", o).alias("y_last"))
    # traces are relative to the visited place, so the check-in is brought to the same origin
    at = v.checkin().select("visit_id", (F.col("checkin_x") - F.col("tx")).alias("cx"), (F.col("checkin_y") - F.col("ty")).alias("cy"))
    return t.join(at, "visit_id", "left").withColumn(
        "dist_checkin_to_median_m", F.round(distance(F.col("cx"), F.col("cy"), F.col("x_med"), F.col("y_med")), 3)).withColumn(
        "dist_start_to_checkin_m", F.round(distance(F.col("cx"), F.col("cy"), F.col("x_first"), F.col("y_first")), 3)).drop("cx", "cy")


@query("agent_behaviour", f"""
SELECT agent_id, count(*) AS visits, count(DISTINCT address_id) AS addresses, round(avg(({MET})::INTEGER),6) AS met_rate,
  round(avg((outcome='address_not_traceable')::INTEGER),6) AS not_traceable_rate, quantile_cont(dwell_s,0.5) AS median_dwell,
  round(1 - count(DISTINCT photo_hash)/count(photo_hash),6) AS dup_photo_share, any_value(coalesce(n,0)) AS distinct_checkins FROM w_visit
 LEFT JOIN (SELECT agent_id, count(*) AS n FROM (SELECT DISTINCT agent_id, checkin_x, checkin_y FROM w_checkin WHERE checkin_x IS NOT NULL) GROUP BY 1) USING (agent_id) GROUP BY agent_id""")
def agent_behaviour(v):
    vis = v.visit()
    q = group_quantiles(vis, ["agent_id"], "dwell_s", {"median_dwell": 0.5}).drop("n")
    a = vis.groupBy("agent_id").agg(
        F.count("*").alias("visits"), F.count_distinct("address_id").alias("addresses"), rate(met(), "met_rate"),
        rate(F.col("outcome") == "address_not_traceable", "not_traceable_rate"),
        F.round(1 - F.count_distinct("photo_hash") / F.count("photo_hash"), 6).alias("dup_photo_share"))
    spots = v.checkin().filter("checkin_x is not null").select("agent_id", "checkin_x", "checkin_y").distinct().groupBy("agent_id").agg(F.count("*").alias("c"))
    return a.join(q, "agent_id").join(spots, "agent_id", "left").withColumn("distinct_checkins", F.coalesce("c", F.lit(0))).drop("c")


BAND = "CASE WHEN gps_accuracy_m IS NULL THEN 'unknown' WHEN gps_accuracy_m<=15 THEN 'fine' WHEN gps_accuracy_m<=30 THEN 'ok' ELSE 'coarse' END"
DIMS = [("agent", "agent_id"), ("accuracy", BAND), ("outcome_day", "dayname(observed_at)"), ("town", "coalesce(town_id,'unknown')"), ("type", "coalesce(address_type,'unknown')"),
        ("stratum", "coalesce(precision,'none')")]
DIM_ROWS = "(SELECT v.*, town_id, address_type, precision FROM w_visit v LEFT JOIN w_address a ON a.address_id = v.address_id LEFT JOIN w_pin p ON p.address_id = v.address_id)"


@query("outcome_rates_by_dimension", "\nUNION ALL ".join(
    f"SELECT '{n}' AS dimension, {e} AS level, count(*) AS n, round(avg(({MET})::INTEGER),6) AS met_rate, "
    f"round(avg((outcome='address_not_traceable')::INTEGER),6) AS not_traceable_rate FROM {DIM_ROWS} GROUP BY 1,2" for n, e in DIMS))
def outcome_rates_by_dimension(v):
    """All dimensions in one pass: each row is spread to its (dimension, level) cells, then combined."""
    acc = F.col("gps_accuracy_m")
    band = F.when(acc.isNull(), "unknown").when(acc <= 15, "fine").when(acc <= 30, "ok").otherwise("coarse")
    cells = F.array(F.struct(F.lit("agent").alias("dimension"), F.col("agent_id").alias("level")),
                    F.struct(F.lit("accuracy").alias("dimension"), band.alias("level")),
                    F.struct(F.lit("outcome_day").alias("dimension"), F.date_format("observed_at", "EEEE").alias("level")),
                    F.struct(F.lit("town").alias("dimension"), F.coalesce("town_id", F.lit("unknown")).alias("level")),
                    F.struct(F.lit("type").alias("dimension"), F.coalesce("address_type", F.lit("unknown")).alias("level")),
                    F.struct(F.lit("stratum").alias("dimension"), F.coalesce("precision", F.lit("none")).alias("level")))
    rows = (v.visit().join(v.address().select("address_id", "town_id", "address_type"), "address_id", "left")
            .join(v.pin().select("address_id", "precision"), "address_id", "left"))
    return (rows.select("outcome", F.explode(cells).alias("c")).groupBy("c.dimension", "c.level").agg(
        F.count("*").alias("n"), rate(met(), "met_rate"), rate(F.col("outcome") == "address_not_traceable", "not_traceable_rate")))


@query("binned_rates", f"""
SELECT 'fixed' AS rule, CASE WHEN dwell_s<=60 THEN 0 WHEN dwell_s<=180 THEN 1 WHEN dwell_s<=600 THEN 2 ELSE 3 END AS bin, count(*) AS n, round(avg(({MET})::INTEGER),6) AS met_rate
FROM w_visit WHERE dwell_s IS NOT NULL GROUP BY 1,2 UNION ALL
SELECT 'quartile', CASE WHEN dwell_s<=q1 THEN 0 WHEN dwell_s<=q2 THEN 1 WHEN dwell_s<=q3 THEN 2 ELSE 3 END, count(*), round(avg(({MET})::INTEGER),6)
FROM w_visit, (SELECT quantile_cont(dwell_s,0.25) AS q1, quantile_cont(dwell_s,0.5) AS q2, quantile_cont(dwell_s,0.75) AS q3 FROM w_visit) WHERE dwell_s IS NOT NULL GROUP BY 1,2""")
def binned_rates(v):
    d = v.visit().filter("dwell_s is not null")
    edges = group_quantiles(d, [], "dwell_s", {"q1": 0.25, "q2": 0.5, "q3": 0.75}).drop("n")
    x = F.col("dwell_s")
    fixed = F.when(x <= 60, 0).when(x <= 180, 1).when(x <= 600, 2).otherwise(3)
    quart = F.when(x <= F.col("q1"), 0).when(x <= F.col("q2"), 1).when(x <= F.col("q3"), 2).otherwise(3)
    cells = F.array(F.struct(F.lit("fixed").alias("rule"), fixed.alias("bin")), F.struct(F.lit("quartile").alias("rule"), quart.alias("bin")))
    # `edges` is one row
    return (d.crossJoin(F.broadcast(edges)).select("outcome", F.explode(cells).alias("c")).groupBy("c.rule", "c.bin")
            .agg(F.count("*").alias("n"), rate(met(), "met_rate")))


@query("length_histogram", """
SELECT 'length' AS measure, least(length(text)//500, 20) AS bin, count(*) AS n FROM documents GROUP BY 1,2
UNION ALL SELECT 'accuracy', least(floor(gps_accuracy_m/10)::BIGINT, 10), count(*) FROM w_visit WHERE gps_accuracy_m IS NOT NULL GROUP BY 1,2
UNION ALL SELECT 'radius', least(floor(radius_m/250)::BIGINT, 20), count(*) FROM w_belief WHERE radius_m IS NOT NULL GROUP BY 1,2""")
def length_histogram(v):
    """Fixed-edge histograms: text length, GPS accuracy and believed radius, the last bin open."""
    from placeproof.catalog.oracle_domain import AS_OF
    from placeproof.plans import belief
    def hist(df, name, c, width, last):
        return df.filter(c.isNotNull()).groupBy(F.least(F.floor(c / width), F.lit(last)).alias("bin")).agg(F.count("*").alias("n")).select(F.lit(name).alias("measure"), "bin", "n")
    return (hist(v.raw("documents"), "length", F.length("text"), 500, 20).unionByName(hist(v.visit(), "accuracy", F.col("gps_accuracy_m"), 10, 10))
            .unionByName(hist(belief.belief_at(v, AS_OF), "radius", F.col("radius_m"), 250, 20)))


@query("split_by_type", """
SELECT split, count(*) FILTER (address_type='office') AS office, count(*) FILTER (address_type='permanent_native') AS permanent_native,
  count(*) FILTER (address_type='current') AS current FROM w_address JOIN w_split USING (account_id) GROUP BY 1""")
def split_by_type(v):
    return (v.address().join(v.split(), "account_id").groupBy("split")
            .pivot("address_type", ["office", "permanent_native", "current"]).count().fillna(0))


@query("duplicate_text_groups", """
SELECT min(address_id) AS first_id, count(*) AS n, count(DISTINCT account_id) AS accounts, count(DISTINCT town_id) AS towns, count(DISTINCT split) AS splits
FROM w_addr JOIN w_split USING (account_id) GROUP BY norm HAVING count(*) > 1""")
def duplicate_text_groups(v):
    a = v.address().withColumn("norm", text.norm_text(F.col("address_text"))).join(v.split(), "account_id")
    return a.groupBy("norm").agg(
        F.min("address_id").alias("first_id"), F.count("*").alias("n"), F.count_distinct("account_id").alias("accounts"),
        F.count_distinct("town_id").alias("towns"), F.count_distinct("split").alias("splits")).filter("n > 1").drop("norm")


W = "list_filter(regexp_extract_all(lower(text),'[a-z]+'), lambda w: length(w) > 2)"
ALL_W = "regexp_extract_all(lower(text),'[a-z]+')"


@query("top_terms_and_bigrams", f"""
(SELECT 'term' AS kind, t AS term, count(*) AS n FROM (SELECT unnest({W}) AS t FROM documents) GROUP BY 2 ORDER BY n DESC, term LIMIT 50)
UNION ALL (SELECT 'bigram', w[i]||' '||w[i+1], count(*) FROM (SELECT w, unnest(range(1,len(w))) AS i FROM (SELECT {ALL_W} AS w FROM documents)) GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 50)
UNION ALL SELECT 'rare', 'seen once', count(*) FROM (SELECT t FROM (SELECT unnest({W}) AS t FROM documents) GROUP BY 1 HAVING count(*)=1)""")
def top_terms_and_bigrams(v):
    """Terms of three letters or more; bigrams are true neighbours, short words included."""
    d = v.raw("documents").select(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("w"))
    terms = d.select(F.explode("w").alias("term")).filter(F.length("term") > 2).groupBy("term").agg(F.count("*").alias("n"))
    pairs = F.when(F.size("w") >= 2, F.transform(F.slice("w", 1, F.size("w") - 1), lambda t, i: F.concat_ws(" ", t, F.get("w", i + 1))))
    bigrams = d.select(F.explode(pairs).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    def top(df, kind):
        return df.orderBy(F.col("n").desc(), "term").limit(50).select(F.lit(kind).alias("kind"), "term", "n")
    rare = terms.filter("n = 1").agg(F.lit("rare").alias("kind"), F.lit("seen once").alias("term"), F.count("*").alias("n"))
    return union_all([top(terms, "term"), top(bigrams, "bigram"), rare])


@query("token_idf", "SELECT token, df, round(idf,6) AS idf FROM w_idf")
def token_idf(v):
    return cand.token_idf(cand.prepared_addresses(v.address()), "2024-02-01").select("token", "df", F.round("idf", 6).alias("idf"))


@query("mention_coverage", """
SELECT count(*) AS n, count(*) FILTER (loc) AS names_locality, count(*) FILTER (pin) AS names_pin, count(*) FILTER (rel) AS names_relation, count(*) FILTER (lm) AS names_landmark, count(*) FILTER (town) AS names_town,
  count(*) FILTER (loc OR pin OR rel OR lm OR town) AS any_mention, count(*) FILTER (NOT (loc OR pin OR rel OR lm OR town)) AS no_mention
FROM (SELECT address_id IN (SELECT address_id FROM w_locbest) AS loc, pin_text IS NOT NULL AS pin, address_id IN (SELECT address_id FROM w_relwin) AS rel,
 EXISTS (SELECT 1 FROM (SELECT DISTINCT town_id, lower(poi_name) AS nm FROM w_landmark) l WHERE l.town_id = w_addr.town_id AND contains(lower(address_text), nm)) AS lm,
 EXISTS (SELECT 1 FROM w_town t WHERE t.town_id = w_addr.town_id AND contains(lower(address_text), lower(town_name))) AS town FROM w_addr)""")
def mention_coverage(v):
    a = cand.prepared_addresses(v.address())
    named = cand.locality_hits(a, v.locality(), "2024-02-01").select("address_id").distinct().withColumn("hit", F.lit(True))
    low = a.select("address_id", "town_id", F.lower("address_text").alias("low"))
    marks = v.landmark().select("town_id", F.lower("poi_name").alias("nm")).distinct()
    lm = contains_join(low, marks, "low", "nm", ["town_id"]).select("address_id").distinct().withColumn("at_lm", F.lit(True))
    j = a.join(named, "address_id", "left").join(lm, "address_id", "left").join(v.town().select("town_id", F.lower("town_name").alias("tn")), "town_id", "left")
    loc, pin, rel = F.col("hit").isNotNull(), F.col("pin_text").isNotNull(), text.relation_window(F.col("toks")).isNotNull()
    town = F.coalesce(F.contains(F.lower("address_text"), F.col("tn")), F.lit(False))
    return j.select(loc.alias("loc"), pin.alias("pin"), rel.alias("rel"), F.col("at_lm").isNotNull().alias("lm"), town.alias("town")).agg(
        F.count("*").alias("n"), F.count_if("loc").alias("names_locality"), F.count_if("pin").alias("names_pin"),
        F.count_if("rel").alias("names_relation"), F.count_if("lm").alias("names_landmark"), F.count_if("town").alias("names_town"),
        F.count_if(F.expr("loc or pin or rel or lm or town")).alias("any_mention"),
        F.count_if(F.expr("not (loc or pin or rel or lm or town)")).alias("no_mention"))


@query("radius_calibration", f"""
SELECT precision, n_train, round(p80,3) AS p80, n_eval, round(cov,4) AS coverage, n_eval >= 15 AS publishable FROM (
 SELECT precision, count(*) AS n_train, quantile_cont(err,0.8) AS p80 FROM {PIN_ERR} WHERE address_id%10=3 AND address_id//20%2=0 GROUP BY 1)
JOIN (SELECT e.precision, count(*) AS n_eval, avg((e.err<=t.p80)::INTEGER) AS cov FROM {PIN_ERR} e JOIN (SELECT precision, quantile_cont(err,0.8) AS p80 FROM {PIN_ERR}
 WHERE address_id%10=3 AND address_id//20%2=0 GROUP BY 1) t USING (precision) WHERE e.address_id%10=3 AND e.address_id//20%2=1 GROUP BY 1) USING (precision)""")
def radius_calibration(v):
    """p80 of the training half and its coverage on the other half, with the n guard."""
    e = pin_errors(v).join(v.surveyed().select("address_id"), "address_id", "left_semi")
    train = F.floor(F.col("address_id") / 20) % 2 == 0
    p80 = group_quantiles(e.filter(train), ["precision"], "err", {"p80": 0.8}).withColumnRenamed("n", "n_train")
    cov = e.filter(~train).join(p80, "precision").groupBy("precision").agg(
        F.count("*").alias("n_eval"), F.round(F.avg((F.col("err") <= F.col("p80")).cast("int")), 4).alias("coverage"))
    return p80.join(cov, "precision").select("precision", "n_train", F.round("p80", 3).alias("p80"), "n_eval", "coverage",
                                             (F.col("n_eval") >= 15).alias("publishable"))


@query("closer_to_pin", f"""
WITH j AS (SELECT outcome, {dist('checkin_x','checkin_y','c.tx','c.ty')} AS to_truth, {dist('checkin_x','checkin_y','geocoder_x','geocoder_y')} AS to_pin
 FROM w_checkin c JOIN w_pin USING (address_id) WHERE checkin_x IS NOT NULL)
SELECT outcome, count(*) AS n, round(quantile_cont(to_truth,0.5),3) AS med_truth, round(quantile_cont(to_pin,0.5),3) AS med_pin, round(avg((to_pin<to_truth)::INTEGER),6) AS closer_share FROM j GROUP BY 1
UNION ALL SELECT 'ALL met', count(*), round(quantile_cont(to_truth,0.5),3), round(quantile_cont(to_pin,0.5),3), round(avg((to_pin<to_truth)::INTEGER),6) FROM j WHERE {MET}""")
def closer_to_pin(v):
    c = v.checkin().filter("checkin_x is not null").join(v.pin(), "address_id")
    x, y = F.col("checkin_x"), F.col("checkin_y")
    j = c.select("outcome", distance(x, y, F.col("tx"), F.col("ty")).alias("to_truth"),
                 distance(x, y, F.col("geocoder_x"), F.col("geocoder_y")).alias("to_pin"))
    j = j.withColumn("g", F.explode(F.when(met(), F.array("outcome", F.lit("ALL met"))).otherwise(F.array("outcome"))))
    a = group_quantiles(j, ["g"], "to_truth", {"med_truth": 0.5})
    b = group_quantiles(j, ["g"], "to_pin", {"med_pin": 0.5}).drop("n")
    s = j.groupBy("g").agg(rate(F.col("to_pin") < F.col("to_truth"), "closer_share"))
    return a.join(b, "g").join(s, "g").select(F.col("g").alias("outcome"), "n", F.round("med_truth", 3).alias("med_truth"),
                                              F.round("med_pin", 3).alias("med_pin"), "closer_share")


@query("facet_counts", """
SELECT coalesce(outcome,'*') AS outcome, coalesce(agent_id,'*') AS agent_id, coalesce(polarity,'*') AS polarity, coalesce(evidence_class,'*') AS evidence_class, coalesce(town,'*') AS town, count(*) AS n
FROM (SELECT o.*, coalesce(town_id,'unknown') AS town FROM w_obs o LEFT JOIN (SELECT address_id, town_id FROM w_address) a ON a.address_id = o.address_id)
GROUP BY GROUPING SETS ((outcome),(agent_id),(polarity),(evidence_class),(town),())""")
def facet_counts(v):
    """One pass for all facets of the observations."""
    facets = ["outcome", "agent_id", "polarity", "evidence_class", "town"]
    o = v.observation().join(v.address().select("address_id", "town_id"), "address_id", "left").withColumn("town", F.coalesce("town_id", F.lit("unknown")))
    return (o.groupingSets([*[[F.col(f)] for f in facets], []], *[F.col(f) for f in facets])
            .agg(F.count("*").alias("n")).select(*[F.coalesce(f, F.lit("*")).alias(f) for f in facets], "n"))


@query("address_activity", f"""
SELECT address_id, count(*) AS visits, count(*) FILTER ({MET}) AS positives, max(epoch_us(observed_at)) AS last_us, arg_max(outcome,(observed_at,visit_id)) AS last_outcome FROM w_visit GROUP BY 1""")
def address_activity(v):
    return v.visit().groupBy("address_id").agg(
        F.count("*").alias("visits"), F.count_if(met()).alias("positives"), F.max(F.unix_micros("observed_at")).alias("last_us"),
        F.max_by("outcome", F.struct("observed_at", "visit_id")).alias("last_outcome"))


@query("calendar_mix", """
SELECT 'week' AS unit, strftime(date_trunc('week',observed_at),'%Y-%m-%d') AS value, count(*) AS n FROM w_visit GROUP BY 2
UNION ALL SELECT 'hour', lpad(hour(observed_at)::VARCHAR,2,'0'), count(*) FROM w_visit GROUP BY 2
UNION ALL SELECT 'weekday', (isodow(observed_at)-1)::VARCHAR, count(*) FROM w_visit GROUP BY 2""")
def calendar_mix(v):
    t = F.col("observed_at")
    cells = F.array(F.struct(F.lit("week").alias("unit"), F.date_format(F.date_trunc("week", t), "yyyy-MM-dd").alias("value")),
                    F.struct(F.lit("hour").alias("unit"), F.lpad(F.hour(t).cast("string"), 2, "0").alias("value")),
                    F.struct(F.lit("weekday").alias("unit"), F.weekday(t).cast("string").alias("value")))
    return v.visit().select(F.explode(cells).alias("c")).groupBy("c.unit", "c.value").agg(F.count("*").alias("n"))


@query("active_day_gaps", f"""
SELECT max(gap) AS longest_gap, count(*) AS active_days, (max(d)-min(d)+1) - count(*) AS days_with_none FROM (
 SELECT d, d - lag(d) OVER (ORDER BY d) AS gap FROM (SELECT DISTINCT observed_at::DATE AS d FROM w_visit))""")
def active_day_gaps(v):
    """Gaps between active days and days without any visit, over the calendar."""
    days = v.visit().select(F.to_date("observed_at").alias("d")).distinct()
    # calendar days are few by nature, so the ordered window over them is small
    g = days.withColumn("gap", F.datediff("d", F.lag("d").over(Window.orderBy("d"))))
    span = g.agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.max("gap").cast("long").alias("longest_gap"), F.count("*").alias("active_days"))
    every = span.select(F.explode(F.sequence("lo", "hi")).alias("d"))
    none = every.join(days, "d", "left_anti").agg(F.count("*").alias("days_with_none"))
    return span.select("longest_gap", "active_days").crossJoin(none)


@query("selection_exposure", f"""
SELECT visited, count(*) AS n, round(quantile_cont(proxy,0.5),3) AS median_proxy FROM (SELECT a.address_id IN (SELECT address_id FROM w_visit) AS visited,
 {dist('geocoder_x','geocoder_y','tcx','tcy')} AS proxy FROM w_address a JOIN w_pin USING (address_id) JOIN w_towncent USING (town_id)) GROUP BY 1""")
def selection_exposure(v):
    seen = v.visit().select("address_id").distinct().withColumn("seen", F.lit(True))
    j = (v.address().join(v.pin(), "address_id").join(cand.town_centroids(v.locality()), "town_id").join(seen, "address_id", "left")
         .select(F.col("seen").isNotNull().alias("visited"), distance(F.col("geocoder_x"), F.col("geocoder_y"), F.col("tcx"), F.col("tcy")).alias("proxy")))
    return group_quantiles(j, ["visited"], "proxy", {"median_proxy": 0.5}).withColumn("median_proxy", F.round("median_proxy", 3))


@query("dwell_by_outcome", """
SELECT outcome, count(dwell_s) AS n, round(sum(dwell_s)/3600.0,4) AS hours, round(quantile_cont(dwell_s,0.5),4) AS median_dwell, round(quantile_cont(dwell_s,0.9),4) AS p90_dwell FROM w_visit WHERE dwell_s IS NOT NULL GROUP BY 1""")
def dwell_by_outcome(v):
    d = v.visit().filter("dwell_s is not null")
    q = group_quantiles(d, ["outcome"], "dwell_s", {"m": 0.5, "p": 0.9})
    return d.groupBy("outcome").agg(F.count("*").alias("n"), F.round(F.sum("dwell_s") / 3600.0, 4).alias("hours")).join(q.drop("n"), "outcome").select(
        "outcome", "n", "hours", F.round("m", 4).alias("median_dwell"), F.round("p", 4).alias("p90_dwell"))


@query("field_effort", f"""
SELECT round(sum(dwell_s)/3600.0,4) AS hours, round(sum(dwell_s) FILTER (NOT {MET})/sum(dwell_s),6) AS wasted_share, round(avg(({MET})::INTEGER),6) AS productive_share,
  quantile_cont(dwell_s,0.5) FILTER ({MET}) AS median_productive, quantile_cont(dwell_s,0.5) FILTER (NOT {MET}) AS median_wasted FROM w_visit""")
def field_effort(v):
    d = v.visit().withColumn("ok", met())
    q = group_quantiles(d, ["ok"], "dwell_s", {"m": 0.5})
    medians = q.agg(F.max(F.when(F.col("ok"), F.col("m"))).alias("median_productive"), F.max(F.when(~F.col("ok"), F.col("m"))).alias("median_wasted"))
    return d.agg(F.round(F.sum("dwell_s") / 3600.0, 4).alias("hours"),
                 F.round(F.sum(F.when(~F.col("ok"), F.col("dwell_s"))) / F.sum("dwell_s"), 6).alias("wasted_share"),
                 rate(F.col("ok"), "productive_share")).crossJoin(medians)


# ---- dial attempts -------------------------------------------------------------------------------
ATT = """(SELECT event_id, user_id AS account_id, user_id||'-'||(k%3) AS phone_id, ts, k, event_type='error' AS dead, event_type='purchase' AS y, event_type='view' AS third_party,
 CASE WHEN user_id%4=0 THEN 'random_contact_point' ELSE 'policy' END AS arm, round(0.1+(user_id%7)*0.1,1) AS propensity FROM (SELECT *, (props->>'$.k')::INTEGER AS k FROM events))"""
ATT_SEQ = f"""(SELECT *, coalesce(sum(dead::INTEGER) OVER (PARTITION BY account_id, phone_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)::BIGINT AS prev_dead,
 row_number() OVER (PARTITION BY account_id, phone_id ORDER BY ts, event_id)-1 AS prev_n, row_number() OVER (PARTITION BY account_id ORDER BY ts, event_id) AS in_account FROM {ATT})"""


def attempts(v):
    k, u = F.get_json_object("props", "$.k").cast("int"), F.col("user_id")
    return v.raw("events").select(
        "event_id", u.alias("account_id"), F.concat(u, F.lit("-"), k % 3).alias("phone_id"), F.col("ts").cast("timestamp").alias("ts"), k.alias("k"),
        (F.col("event_type") == "error").alias("dead"), (F.col("event_type") == "purchase").alias("y"), (F.col("event_type") == "view").alias("third_party"),
        F.when(u % 4 == 0, "random_contact_point").otherwise("policy").alias("arm"), F.round(0.1 + (u % 7) * 0.1, 1).alias("propensity"))


def attempt_history(v):
    """Prior dead calls and attempt numbers; hot accounts are split by day."""
    from placeproof.operators.windows import running_before
    one = F.lit(1).cast("long")
    a = running_before(attempts(v), ["account_id", "phone_id"], "ts", ["event_id"],
                       {"prev_dead": F.col("dead").cast("long"), "prev_n": one}, F.date_trunc("day", "ts"))
    return running_before(a, ["account_id"], "ts", ["event_id"], {"before": one}, F.date_trunc("day", "ts")).withColumn(
        "in_account", F.col("before") + 1)


@query("attempt_history", f"SELECT event_id, prev_dead, prev_n, in_account FROM {ATT_SEQ}")
def attempt_history_query(v):
    return attempt_history(v).select("event_id", "prev_dead", "prev_n", "in_account")


RULES = [("incumbent_first_3", "in_account <= 3"), ("incumbent_all", "true"), ("drop_third_dead", "prev_dead < 3"), ("first_call_only", "prev_n = 0")]


@query("policy_baselines", "\nUNION ALL ".join(
    f"SELECT '{n}' AS policy, count(*) AS calls, round(avg(y::INTEGER),4) AS success_per_call, sum(y::INTEGER)::BIGINT AS successes, "
    f"sum(third_party::INTEGER)::BIGINT AS third_party FROM {ATT_SEQ} JOIN w_split USING (account_id) WHERE split='test' AND {c}" for n, c in RULES))
def policy_baselines(v):
    """All policies in one pass over the test split: a row counts for each rule it satisfies."""
    t = attempt_history(v).join(v.split().filter("split = 'test'"), "account_id", "left_semi")
    rules = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(n)) for n, c in RULES]))
    return t.select("y", "third_party", F.explode(rules).alias("policy")).groupBy("policy").agg(
        F.count("*").alias("calls"), F.round(F.avg(F.col("y").cast("int")), 4).alias("success_per_call"),
        F.sum(F.col("y").cast("long")).alias("successes"), F.sum(F.col("third_party").cast("long")).alias("third_party"))


@query("arm_contrast", f"""
SELECT arm, count(*) AS n, round(avg(propensity),6) AS mean_propensity, min(propensity)::DOUBLE AS min_propensity, max(propensity)::DOUBLE AS max_propensity, round(avg(y::INTEGER),6) AS success_rate FROM {ATT} GROUP BY 1""")
def arm_contrast(v):
    return attempts(v).groupBy("arm").agg(
        F.count("*").alias("n"), F.round(F.avg("propensity"), 6).alias("mean_propensity"), F.min("propensity").alias("min_propensity"),
        F.max("propensity").alias("max_propensity"), rate(F.col("y"), "success_rate"))


@query("trace_roi", f"""
SELECT o_orderpriority AS segment, count(*) AS traces, round(avg((o_orderstatus='F')::INTEGER),6) AS hit_rate, round(sum(o_totalprice)/sum((o_orderstatus='F')::INTEGER),4) AS cost_per_hit,
  (SELECT count(*) FROM {ATT} a WHERE account_id IN (SELECT o_custkey FROM orders b WHERE b.o_orderpriority=orders.o_orderpriority AND b.o_orderstatus='F')) AS attempts_on_traced FROM orders GROUP BY 1""")
def trace_roi(v):
    o = v.raw("orders")
    hit = F.col("o_orderstatus") == "F"
    a = o.groupBy(F.col("o_orderpriority").alias("segment")).agg(
        F.count("*").alias("traces"), rate(hit, "hit_rate"), F.round(F.sum("o_totalprice") / F.count_if(hit), 4).alias("cost_per_hit"))
    calls = attempts(v).groupBy(F.col("account_id").alias("o_custkey")).agg(F.count("*").alias("n"))
    on = (o.filter(hit).select(F.col("o_orderpriority").alias("segment"), "o_custkey").distinct().join(calls, "o_custkey")
          .groupBy("segment").agg(F.sum("n").alias("attempts_on_traced")))
    return a.join(on, "segment", "left").withColumn("attempts_on_traced", F.coalesce("attempts_on_traced", F.lit(0)))


BUCKETS = [("ever_success", "ok > 0"), ("never_success", "ok = 0"), ("many_attempts_no_success", "n >= 10 AND ok = 0")]


@query("identity_label_lift", "\nUNION ALL ".join(
    f"SELECT '{n}' AS bucket, count(*) AS n, round(avg(label),6) AS p_label FROM (SELECT c_custkey, (c_acctbal>0)::INTEGER AS label, coalesce(n,0) AS n, coalesce(ok,0) AS ok FROM customer "
    f"LEFT JOIN (SELECT account_id, count(*) AS n, sum(y::INTEGER) AS ok FROM {ATT} GROUP BY 1) ON account_id=c_custkey) WHERE {c} HAVING count(*) > 0" for n, c in BUCKETS))
def identity_label_lift(v):
    a = attempts(v).groupBy(F.col("account_id").alias("c_custkey")).agg(F.count("*").alias("n"), F.count_if("y").alias("ok"))
    t = v.raw("customer").select("c_custkey", (F.col("c_acctbal") > 0).cast("int").alias("label")).join(a, "c_custkey", "left").fillna({"n": 0, "ok": 0})
    masks = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(n)) for n, c in BUCKETS]))
    return t.select("label", F.explode(masks).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"), F.round(F.avg("label"), 6).alias("p_label"))


@query("block_summary", f"""
SELECT block_id, count(*) AS size, round(avg(x),1) AS cx, round(avg(y),1) AS cy, round(coalesce((SELECT max({dist('p.x','p.y','q.x','q.y')}) FROM w_block p JOIN w_block q USING (block_id) WHERE p.block_id=w_block.block_id),0),3) AS span_m
FROM w_block GROUP BY 1""")
def block_summary(v):
    p = v.point().join(blocks_stage(v), "id")
    a = p.groupBy("block_id").agg(F.count("*").alias("size"), F.round(F.avg("x"), 1).alias("cx"), F.round(F.avg("y"), 1).alias("cy"))
    return a.join(group_diameter(p, "block_id"), "block_id").select("block_id", "size", "cx", "cy", F.round("span", 3).alias("span_m"))


@query("repeated_checkins", """
SELECT agent_id, count(*) AS n_coords, sum(n)::BIGINT AS n_visits FROM (SELECT agent_id, floor(checkin_x/25) AS gx, floor(checkin_y/25) AS gy, count(*) AS n FROM w_checkin
 WHERE checkin_x IS NOT NULL GROUP BY 1,2,3 HAVING count(*)>=3) GROUP BY 1""")
def repeated_checkins(v):
    """Check-in positions (to 25 m) that one agent reports three times or more."""
    spot = [F.floor(F.col(c) / 25).alias(g) for c, g in (("checkin_x", "gx"), ("checkin_y", "gy"))]
    c = v.checkin().filter("checkin_x is not null").groupBy("agent_id", *spot).agg(F.count("*").alias("n")).filter("n >= 3")
    return c.groupBy("agent_id").agg(F.count("*").alias("n_coords"), F.sum("n").alias("n_visits"))
