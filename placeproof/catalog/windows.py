"""Window jobs."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from placeproof import policy
from placeproof.catalog import query
from placeproof.catalog.aggregates import STEPS_SQL, attempts, trace_steps
from placeproof.operators.windows import (global_rank, latest_per_key, top_per_key, trace_tail,
                                          trailing_rate)
from placeproof.plans import evidence

MET = "outcome IN ('met_borrower','met_family','cash_collected')"


@query("trace_steps", f"SELECT visit_id, seq, round(step,4) AS step, dt, speed FROM {STEPS_SQL}")
def trace_steps_query(v):
    return trace_steps(v).select("visit_id", "seq", F.round("step", 4).alias("step"), "dt", "speed")


@query("trace_tail_point", "SELECT visit_id, tail_dx, tail_dy, tail_n, 'trace_tail'||tail_n AS method FROM w_tail")
def trace_tail_point(v):
    return trace_tail(v.trace()).withColumn("method", F.concat(F.lit("trace_tail"), "tail_n"))


@query("trace_estimators", """
WITH t AS (SELECT *, row_number() OVER (PARTITION BY visit_id ORDER BY seq DESC, dx, dy) AS rn FROM w_trace), l AS (SELECT * FROM t WHERE rn <= 10),
m AS (SELECT a.visit_id, a.rn, a.dx, a.dy, sum(sqrt(((a.dx-b.dx)*(a.dx-b.dx)+(a.dy-b.dy)*(a.dy-b.dy))::DOUBLE)) AS total FROM l a JOIN l b USING (visit_id) GROUP BY 1,2,3,4),
w AS (SELECT visit_id, sum(dx/greatest(1.0,accuracy_m))/sum(1.0/greatest(1.0,accuracy_m)) AS wx, sum(dy/greatest(1.0,accuracy_m))/sum(1.0/greatest(1.0,accuracy_m)) AS wy FROM l GROUP BY 1),
k AS (SELECT visit_id, quantile_cont(dx,0.5) AS kx, quantile_cont(dy,0.5) AS ky FROM w_trace JOIN (SELECT visit_id, max(point_ts) AS last_ts FROM w_trace GROUP BY 1) USING (visit_id)
 WHERE epoch_us(last_ts)-epoch_us(point_ts) <= 120000000 GROUP BY 1)
SELECT visit_id, round(wx,6) AS weighted_x, round(wy,6) AS weighted_y, kx AS window_x, ky AS window_y, round(min(total),4) AS medoid_cost FROM m JOIN w USING (visit_id) JOIN k USING (visit_id) GROUP BY ALL""")
def trace_estimators(v):
    """Accuracy-weighted mean and medoid of the last ten fixes, and the last-two-minutes median."""
    t = v.trace()
    w = Window.partitionBy("visit_id").orderBy(F.col("seq").desc(), "dx", "dy")
    last = (t.withColumn("rn", F.row_number().over(w)).filter("rn <= 10").groupBy("visit_id")
            .agg(F.collect_list(F.struct("dx", "dy", "accuracy_m")).alias("p")))      # at most ten
    inv = lambda q: 1.0 / F.greatest(F.lit(1.0), q["accuracy_m"])
    def total(f):
        return F.aggregate(F.transform("p", f), F.lit(0.0), lambda a, b: a + b)
    cost = F.array_min(F.transform("p", lambda a: F.aggregate(F.transform("p", lambda b: F.sqrt(
        ((a["dx"] - b["dx"]) * (a["dx"] - b["dx"]) + (a["dy"] - b["dy"]) * (a["dy"] - b["dy"])).cast("double"))),
        F.lit(0.0), lambda x, y: x + y)))
    est = last.select("visit_id", F.round(total(lambda q: q["dx"] * inv(q)) / total(inv), 6).alias("weighted_x"),
                      F.round(total(lambda q: q["dy"] * inv(q)) / total(inv), 6).alias("weighted_y"),
                      F.round(cost, 4).alias("medoid_cost"))
    end = t.groupBy("visit_id").agg(F.max("point_ts").alias("last_ts"))
    near = (t.join(end, "visit_id").filter(F.unix_micros("last_ts") - F.unix_micros("point_ts") <= 120_000_000)
            .groupBy("visit_id").agg(F.percentile("dx", 0.5).alias("window_x"), F.percentile("dy", 0.5).alias("window_y")))
    return est.join(near, "visit_id")


@query("trace_medoid_point", """
WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY visit_id ORDER BY seq DESC, dx, dy) AS rn FROM w_trace) WHERE rn <= 10),
m AS (SELECT a.visit_id, a.rn, a.dx, a.dy, round(sum(sqrt(((a.dx-b.dx)*(a.dx-b.dx)+(a.dy-b.dy)*(a.dy-b.dy))::DOUBLE)),6) AS total FROM l a JOIN l b USING (visit_id) GROUP BY 1,2,3,4),
best AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY visit_id ORDER BY total, rn DESC) = 1)
SELECT l.visit_id, max(best.dx)::INTEGER AS best_x, max(best.dy)::INTEGER AS best_y, count(*) AS n_near, quantile_cont(l.dx, 0.5) AS medoid_x, quantile_cont(l.dy, 0.5) AS medoid_y
FROM l JOIN best USING (visit_id) WHERE (SELECT count(*) FROM l z WHERE z.visit_id = l.visit_id) < 3 OR sqrt(((l.dx-best.dx)*(l.dx-best.dx)+(l.dy-best.dy)*(l.dy-best.dy))::DOUBLE) <= 150 GROUP BY 1""")
def trace_medoid_point(v):
    """Medoid of the last ten fixes (the older one of equal cost), then the median of the fixes within 150 m of it; of fewer than three fixes their median."""
    w = Window.partitionBy("visit_id").orderBy(F.col("seq").desc(), "dx", "dy")
    last = (v.trace().withColumn("rn", F.row_number().over(w)).filter("rn <= 10").groupBy("visit_id").agg(F.collect_list(F.struct("dx", "dy", "rn")).alias("p")))      # at most ten
    apart = lambda a, b: F.sqrt(((a["dx"] - b["dx"]) * (a["dx"] - b["dx"]) + (a["dy"] - b["dy"]) * (a["dy"] - b["dy"])).cast("double"))
    cost = lambda a: F.round(F.aggregate(F.transform("p", lambda b: apart(a, b)), F.lit(0.0), lambda x, y: x + y), 6)
    best = last.withColumn("best", F.array_min(F.transform("p", lambda a: F.struct(cost(a).alias("cost"), (-a["rn"]).alias("o"), a["dx"].alias("dx"), a["dy"].alias("dy")))))
    near = best.withColumn("near", F.when(F.size("p") < 3, F.col("p")).otherwise(F.filter("p", lambda b: apart(b, F.col("best")) <= 150)))
    return near.select("visit_id", "best", F.explode("near").alias("n")).groupBy("visit_id").agg(
        F.max("best.dx").alias("best_x"), F.max("best.dy").alias("best_y"), F.count("*").alias("n_near"), F.percentile("n.dx", 0.5).alias("medoid_x"), F.percentile("n.dy", 0.5).alias("medoid_y"))


@query("sequence_monotone", """
SELECT NOT bad AS monotone, count(*) AS n FROM (SELECT visit_id, coalesce(bool_or(prev > point_ts), FALSE) AS bad FROM (
 SELECT visit_id, point_ts, lag(point_ts) OVER (PARTITION BY visit_id ORDER BY seq, dx, dy) AS prev FROM w_trace) GROUP BY 1) GROUP BY 1""")
def sequence_monotone(v):
    w = Window.partitionBy("visit_id").orderBy("seq", "dx", "dy")
    t = v.trace().withColumn("prev", F.lag("point_ts").over(w))
    bad = t.groupBy("visit_id").agg(F.coalesce(F.bool_or(F.col("prev") > F.col("point_ts")), F.lit(False)).alias("bad"))
    return bad.groupBy((~F.col("bad")).alias("monotone")).agg(F.count("*").alias("n"))


@query("longest_gap", """
SELECT account_id, round(max(gap)/86400e6,6) AS longest_gap_days, max(gap) > 7*86400000000 AS over_a_week FROM (
 SELECT user_id AS account_id, epoch_us(ts)-epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events) GROUP BY 1""")
def longest_gap(v):
    """Longest gap per account from per-day extremes: gaps inside a day, and between days."""
    a = attempts(v).select("account_id", F.unix_micros("ts").alias("t")).withColumn("b", F.floor(F.col("t") / 86_400_000_000))
    inside = a.withColumn("g", F.col("t") - F.lag("t").over(Window.partitionBy("account_id", "b").orderBy("t")))
    day = inside.groupBy("account_id", "b").agg(F.min("t").alias("lo"), F.max("t").alias("hi"), F.max("g").alias("g"))
    across = day.withColumn("x", F.col("lo") - F.lag("hi").over(Window.partitionBy("account_id").orderBy("b")))
    g = across.groupBy("account_id").agg(F.max(F.greatest("g", "x")).alias("gap"))
    return g.select("account_id", F.round(F.col("gap") / 86400e6, 6).alias("longest_gap_days"),
                    (F.col("gap") > 7 * 86_400_000_000).alias("over_a_week"))


@query("first_versus_later", f"""
SELECT rn = 1 AS is_first, count(*) AS n, round(avg(({MET})::INTEGER),6) AS met_rate FROM (
 SELECT *, row_number() OVER (PARTITION BY address_id ORDER BY observed_at, visit_id) AS rn FROM w_visit) GROUP BY 1""")
def first_versus_later(v):
    """First visit per address by a mergeable minimum, the rest by subtraction."""
    vis = v.visit().withColumn("ok", F.col("outcome").isin(policy.POSITIVE_OUTCOMES).cast("long"))
    per = vis.groupBy("address_id").agg(F.count("*").alias("n"), F.sum("ok").alias("s"),
                                        F.min_by("ok", F.struct("observed_at", "visit_id")).alias("f"))
    parts = per.select(F.explode(F.array(
        F.struct(F.lit(True).alias("is_first"), F.lit(1).cast("long").alias("n"), F.col("f").alias("s")),
        F.struct(F.lit(False).alias("is_first"), (F.col("n") - 1).alias("n"), (F.col("s") - F.col("f")).alias("s")))).alias("p"))
    g = parts.select("p.*").filter("n > 0").groupBy("is_first").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    return g.select("is_first", "n", F.round(F.col("s") / F.col("n"), 6).alias("met_rate"))


@query("first_visit_lag", """
SELECT address_id, (min(observed_at)::DATE - added_date)::BIGINT AS lag_days FROM w_visit JOIN w_address USING (address_id) GROUP BY address_id, added_date""")
def first_visit_lag(v):
    f = v.visit().groupBy("address_id").agg(F.min("observed_at").alias("first_at"))
    return f.join(v.address().select("address_id", "added_date"), "address_id").select(
        "address_id", F.datediff(F.to_date("first_at"), "added_date").cast("long").alias("lag_days"))


@query("latest_event_per_key", """
SELECT address_id, visit_id, outcome, agent_id FROM w_visit QUALIFY row_number() OVER (PARTITION BY address_id ORDER BY observed_at DESC, visit_id DESC) = 1""")
def latest_event_per_key(v):
    return latest_per_key(v.visit().select("address_id", "visit_id", "outcome", "agent_id", "observed_at"), ["address_id"],
                          ["observed_at", "visit_id"]).select("address_id", "visit_id", "outcome", "agent_id")


@query("agent_trailing_rate", """
SELECT visit_id, count(p) AS window_n, round(CASE WHEN count(p) >= 10 THEN sum(neg)/count(p) END, 6) AS rate FROM w_visit a LEFT JOIN (
 SELECT agent_id AS ag, epoch_us(observed_at) AS p, (outcome IN ('no_such_person','address_not_traceable'))::INTEGER AS neg FROM w_visit) b
 ON ag = agent_id AND p < epoch_us(observed_at) AND p >= epoch_us(observed_at) - 60*86400000000 GROUP BY 1""")
def agent_trailing_rate(v):
    r = trailing_rate(v.visit(), "agent_id", "observed_at", "visit_id", F.col("outcome").isin(policy.NEGATIVE_OUTCOMES))
    return r.select("visit_id", "window_n", F.round("rate", 6).alias("rate"))


@query("spatial_folds", """
SELECT block_id, zone, size, (row_number() OVER (ORDER BY zone, cx, cy, block_id)-1) % 5 AS fold FROM (
 SELECT block_id, zone, count(*) AS size, round(avg(x),2) AS cx, round(avg(y),2) AS cy FROM w_block GROUP BY 1,2)""")
def spatial_folds(v):
    from placeproof.catalog.joins import blocks_stage
    p = v.point().join(blocks_stage(v), "id")
    b = p.groupBy("block_id", "zone").agg(F.count("*").alias("size"), F.round(F.avg("x"), 2).alias("cx"), F.round(F.avg("y"), 2).alias("cy"))
    return global_rank(b, ["zone", "cx", "cy", "block_id"]).select("block_id", "zone", "size", (F.col("rank0") % 5).alias("fold"))


@query("device_day_traces", """
SELECT device_id, day, hour, n, path FROM (SELECT device_id, strftime(observed_at,'%Y-%m-%d') AS day, hour(observed_at) AS hour, count(*) AS n, sum(count(*)) OVER (PARTITION BY device_id, strftime(observed_at,'%Y-%m-%d')) AS day_n,
 string_agg(observation_id::VARCHAR,'|' ORDER BY observed_at, observation_id) AS path FROM w_obs WHERE x IS NOT NULL GROUP BY 1,2,3) WHERE day_n >= 2""")
def device_day_traces(v):
    """Ordered positions per device and day (days with at least two points), in hourly pieces so that
    a busy device-day is never one value or one task."""
    o = v.observation().filter("x is not null").select(
        "device_id", "observed_at", "observation_id", F.date_format("observed_at", "yyyy-MM-dd").alias("day"),
        F.hour("observed_at").cast("long").alias("hour"))
    g = o.groupBy("device_id", "day", "hour").agg(
        F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("observed_at", "observation_id"))),
                                                          lambda s: s["observation_id"].cast("string")), "|").alias("path"))
    w = Window.partitionBy("device_id", "day")          # at most 24 pieces
    return g.withColumn("day_n", F.sum("n").over(w)).filter("day_n >= 2").drop("day_n")


@query("independent_negatives", """
SELECT address_id, count(DISTINCT agent_id||'|'||period||'|'||coalesce(media,'')) AS n_independent, count(*) AS n_negative FROM w_ev WHERE polarity='negative' GROUP BY 1""")
def independent_negatives(v):
    from placeproof.plans import belief
    e = belief.evidence_stage(v).filter("polarity = 'negative'")
    return e.groupBy("address_id").agg(F.count_distinct(F.struct("agent_id", "period", "media")).alias("n_independent"), F.count("*").alias("n_negative"))


@query("singles_by_weight", """
SELECT address_id, observation_id, weight, rk FROM (SELECT *, row_number() OVER (PARTITION BY address_id ORDER BY weight DESC, observation_id) AS rk FROM w_ev
 WHERE polarity='positive' AND weight>=0.35 AND x IS NOT NULL) WHERE rk <= 3""")
def singles_by_weight(v):
    from placeproof.plans import belief
    e = belief.evidence_stage(v).filter("polarity = 'positive' and weight >= 0.35 and x is not null")
    return top_per_key(e, ["address_id"], [F.col("weight").desc(), F.col("observation_id")], 3, "rk").select(
        "address_id", "observation_id", "weight", F.col("rk").cast("long").alias("rk"))


@query("newest_evidence_feed", """
SELECT visit_id, address_id, outcome, epoch_us(observed_at) AS us FROM w_visit WHERE contains(remark,'town') AND outcome <> 'cash_collected'
ORDER BY observed_at DESC, visit_id DESC LIMIT 100""")
def newest_evidence_feed(v):
    return (v.visit().filter(F.contains("remark", F.lit("town")) & (F.col("outcome") != "cash_collected"))
            .orderBy(F.col("observed_at").desc(), F.col("visit_id").desc()).limit(100)
            .select("visit_id", "address_id", "outcome", F.unix_micros("observed_at").alias("us")))


@query("top_values_and_worst_agents", f"""
(SELECT 'agent' AS what, agent_id AS value, round(avg((outcome='address_not_traceable')::INTEGER),6) AS score FROM w_visit GROUP BY 2 ORDER BY score DESC, value LIMIT 3)
UNION ALL (SELECT 'remark', remark, count(*)::DOUBLE FROM w_visit GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 3)""")
def top_values_and_worst_agents(v):
    vis = v.visit()
    a = vis.groupBy(F.col("agent_id").alias("value")).agg(F.round(F.avg((F.col("outcome") == "address_not_traceable").cast("int")), 6).alias("score"))
    r = vis.groupBy(F.col("remark").alias("value")).agg(F.count("*").cast("double").alias("score"))
    def top(df, what):
        return df.orderBy(F.col("score").desc(), "value").limit(3).select(F.lit(what).alias("what"), "value", "score")
    return top(a, "agent").unionByName(top(r, "remark"))


@query("duplicate_claims", """
SELECT observation_id, min_by(other, (other_at, other)) AS duplicate_claim_of FROM (SELECT a.observation_id, b.observation_id AS other, b.observed_at AS other_at
 FROM w_obs a JOIN w_obs b ON a.address_id=b.address_id AND a.media=b.media AND a.observation_id<>b.observation_id) GROUP BY 1""")
def duplicate_claims(v):
    return evidence.duplicate_claims(v.observation())


@query("media_seen_before", """
SELECT observation_id, observed_at > min(observed_at) OVER (PARTITION BY media) AS seen_before FROM w_obs WHERE media IS NOT NULL""")
def media_seen_before(v):
    return evidence.media_seen_before(v.observation())


@query("duplicate_media_clusters", "SELECT media, count(*) AS n_rows FROM w_obs WHERE media IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def duplicate_media_clusters(v):
    return evidence.duplicate_media(v.observation())
