"""Streaming jobs, drained over all input and compared with their batch equals."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from placeproof import policy
from placeproof.catalog import query
from placeproof.catalog.oracle_domain import AS_OF, EARLY
from placeproof.plans import belief
from placeproof.session import checkpoint, work_path
from placeproof.streaming import pipeline


@query("stream_idempotent_ingest", "SELECT visit_id, address_id, outcome FROM w_visit")
def stream_idempotent_ingest(v):
    """The log written twice through the keyed sink: the second run adds nothing."""
    path = work_path(v.spark, "log")
    rows = pipeline.idempotent(pipeline.visit_stream(v)).select("visit_id", "address_id", "outcome", "observed_at")
    for run in ("first", "replay"):
        pipeline.drain(rows, f"ingest-{run}", each_batch=pipeline.keyed_append(path, "visit_id", ["observed_at"], time="observed_at"))
    return v.spark.read.parquet(path).select("visit_id", "address_id", "outcome")


@query("stream_duplicate_claims", """
SELECT visit_id, address_id, photo_hash, CASE WHEN visit_id <> first_id THEN first_id END AS duplicate_claim_of FROM (SELECT visit_id, address_id, photo_hash,
 first_value(visit_id) OVER (PARTITION BY address_id, photo_hash ORDER BY observed_at, visit_id) AS first_id FROM w_visit WHERE photo_hash IS NOT NULL)""")
def stream_duplicate_claims(v):
    return v.spark.read.parquet(pipeline.drain(pipeline.link_claims(pipeline.visit_stream(v)), "claims"))


@query("stream_scores", """
SELECT observation_id AS visit_id, CASE WHEN base = 0 THEN 0.0::DOUBLE ELSE round(base * f_dwell * f_long * f_gps * f_trail * f_media * f_hour * CASE WHEN rate > 0.4 THEN 0.9 ELSE 1.0 END::DOUBLE, 6) END AS weight
FROM w_ev JOIN (SELECT visit_id AS observation_id, CASE WHEN count(p) >= 10 THEN sum(neg)/count(p) END AS rate FROM w_visit a LEFT JOIN (
  SELECT agent_id AS ag, epoch_us(observed_at) AS p, (outcome IN ('no_such_person','address_not_traceable'))::INTEGER AS neg FROM w_visit) b
  ON ag = agent_id AND p < epoch_us(observed_at) AND p >= epoch_us(observed_at) - 60*86400000000 GROUP BY 1) USING (observation_id)""")
def stream_scores(v):
    """Scores on arrival, trail and trailing collector rate included."""
    vis = v.visit()
    dup = vis.filter("photo_hash is not null").groupBy(F.col("photo_hash").alias("media")).agg(F.count("*").alias("c")).filter("c > 1").select("media")
    scorer = pipeline.ArrivalScorer(v, dup, work_path(v.spark, "scores"))
    pipeline.drain(pipeline.visit_stream(v), "scores", each_batch=scorer)
    return v.spark.read.parquet(scorer.scores.path).select("visit_id", "weight")


_RUNS: dict[tuple, pipeline.BeliefUpdater] = {}


def _updates(v):
    """Scored observations in three arrivals, each drained by a stream that goes on where the last one stopped; once per session."""
    at = (v.spark.sparkContext.applicationId, v.sf_dir)
    if at not in _RUNS:
        root, src, state = work_path(v.spark, "updates"), work_path(v.spark, "scored"), work_path(v.spark, "updates-state")
        rows = belief.evidence_stage(v).withColumn("_part", F.pmod(F.xxhash64("observation_id"), F.lit(3)))
        up = pipeline.BeliefUpdater(v, AS_OF, root)
        for i in range(3):
            rows.filter(F.col("_part") == i).drop("_part").write.mode("append").parquet(src)
            stream = v.spark.readStream.schema(belief.evidence_stage(v).schema).parquet(src)
            pipeline.drain(stream, "beliefs", each_batch=up, state=state)
        _RUNS[at] = up
    return _RUNS[at]


@query("stream_belief_updates", "SELECT address_id, tier, status, candidate_id, radius_m, arm FROM w_belief WHERE address_id IN (SELECT address_id FROM w_ev)")
def stream_belief_updates(v):
    """Newest stored belief of every address with an observation: memory arm included, equal to the batch job's."""
    return _updates(v).latest().select("address_id", "tier", "status", "candidate_id", "radius_m", "arm")


@query("stream_tasks", "SELECT 'VF-'||address_id||'-'||status AS task_id FROM w_belief WHERE status IN ('MOVED_SUSPECTED','CONTESTED')")
def stream_tasks(v):
    """Tasks raised so far whose cause the newest belief of the address still has."""
    up = _updates(v)
    now = up.latest().select("address_id", F.col("status").alias("cause"))
    return v.spark.read.parquet(up.tasks.path).join(now, ["address_id", "cause"], "left_semi").select("task_id")


@query("stored_memory_arm", """
WITH s AS (SELECT * FROM w_belief_early WHERE n_obs > 0),
m AS (SELECT address_id, candidate_id, arm, x, y, granularity, stratum, tier, belief_version FROM s WHERE candidate_id IS NOT NULL
 UNION ALL SELECT address_id, candidate_id, arm, x, y, granularity, stratum, tier, belief_version FROM w_prior WHERE address_id NOT IN (SELECT address_id FROM s WHERE candidate_id IS NOT NULL))
SELECT address_id, 'memory:'||address_id||'@v'||belief_version AS source_ref, x, y, granularity, stratum, tier IN ('CONFIRMED','PROBABLE') AS primary_eligible FROM m WHERE arm = 'field_evidence'""")
def stored_memory_arm(v):
    """Memory from stored versions: beliefs of an early cut, versions of superseded rules (ignored), the prior pass where none is stored."""
    early = belief.belief_at(v, EARLY).filter("n_obs > 0").drop("ranked")
    old = early.withColumn("arm", F.lit("field_evidence")).withColumn("x", F.lit(0.0)).withColumn("as_of", F.expr("as_of + interval 1 day"))
    versions = early.withColumn("rules_version", F.lit(policy.RULES_VERSION)).unionByName(old.withColumn("rules_version", F.lit("rules-0")))
    prior = belief.prior_at(v, AS_OF)
    points = prior.select("address_id", F.lit(AS_OF).cast("timestamp").alias("as_of"))
    return belief.stored_memory(points, versions, prior).select("address_id", "source_ref", "x", "y", "granularity", "stratum", "primary_eligible")


DEVICE = "agent_id||'-'||(address_id % 64)"


@query("stream_held_rows", f"""
SELECT device, seq, 'in_order' AS release FROM (SELECT {DEVICE} AS device, row_number() OVER (PARTITION BY {DEVICE} ORDER BY observed_at, visit_id)-1 AS seq FROM w_visit)""")
def stream_held_rows(v):
    """Device backlogs that reach the server days late: every row is released once, in sequence.

    The backlog is written as four arrivals (up to four days of delay per row), then drained.
    """
    dev = F.concat_ws("-", "agent_id", (F.col("address_id") % 64).cast("string"))
    w = Window.partitionBy("device").orderBy("observed_at", "visit_id")
    late = F.floor((F.dayofmonth("observed_at") + (F.col("visit_id") % 3) * 2) / 9).cast("int")
    rows = checkpoint(v.visit().withColumn("device", dev).select(
        "device", (F.row_number().over(w) - 1).cast("long").alias("seq"), "observed_at", late.alias("arrival")))
    src = work_path(v.spark, "backlog")
    for i in range(4):
        rows.filter(F.col("arrival") == i).drop("arrival").coalesce(4).write.mode("append").parquet(src)
    s = (v.spark.readStream.schema(rows.drop("arrival").schema).option("maxFilesPerTrigger", 4).parquet(src)
         .withWatermark("observed_at", pipeline.WATERMARK))
    return v.spark.read.parquet(pipeline.drain(pipeline.hold_out_of_order(s), "held")).select("device", "seq", "release")


@query("stream_backlog_order", f"""
SELECT device, row_number() OVER (PARTITION BY device ORDER BY observed_at, visit_id)-1 AS position, visit_id AS local_seq FROM (SELECT {DEVICE} AS device, observed_at, visit_id FROM w_visit)
WHERE observed_at < (SELECT max(date_trunc('milliseconds', observed_at)) FROM w_visit) - INTERVAL 7 DAY""")
def stream_backlog_order(v):
    """Four arrivals of device backlogs, late by up to four days, put back in (time, local_seq) order as far as the watermark has come."""
    dev = F.concat_ws("-", "agent_id", (F.col("address_id") % 64).cast("string"))
    late = F.floor((F.datediff("observed_at", F.lit("2024-01-01")) + (F.col("visit_id") % 3) * 2) / 9)
    rows = checkpoint(v.visit().select(dev.alias("device"), F.col("visit_id").alias("local_seq"), "observed_at", late.alias("arrival")))
    ends = rows.agg(F.min("arrival"), F.max("arrival")).first()
    src, state, sink = work_path(v.spark, "late"), work_path(v.spark, "late-state"), work_path(v.spark, "late-out")
    for i in range(ends[0], ends[1] + 1):
        rows.filter(F.col("arrival") == i).drop("arrival").write.mode("append").parquet(src)
        s = v.spark.readStream.schema(rows.drop("arrival").schema).parquet(src).withWatermark("observed_at", pipeline.WATERMARK)
        pipeline.drain(pipeline.drain_backlog(s), "late", sink=sink, state=state)
    return v.spark.read.parquet(sink).select("device", "position", "local_seq")


@query("stream_backfill_counts", "SELECT outcome, count(*) AS n FROM w_visit GROUP BY 1")
def stream_backfill_counts(v):
    """Whole history through the live mapping, then counted."""
    path = pipeline.drain(pipeline.visit_stream(v).select("visit_id", "outcome"), "backfill")
    return v.spark.read.parquet(path).groupBy("outcome").agg(F.count("*").alias("n"))


@query("stream_activity_windows", """
SELECT epoch_us(ws) AS start_us, outcome, count(*) AS n FROM (SELECT outcome, unnest(generate_series(date_trunc('day',observed_at) - INTERVAL 29 DAY, date_trunc('day',observed_at), INTERVAL 1 DAY)) AS ws FROM w_visit)
WHERE ws + INTERVAL 30 DAY <= (SELECT max(observed_at) FROM w_visit) - INTERVAL 7 DAY GROUP BY 1,2""")
def stream_activity_windows(v):
    path = pipeline.drain(pipeline.activity(pipeline.visit_stream(v)), "activity")
    return v.spark.read.parquet(path).select(F.unix_micros("window_start").alias("start_us"), "outcome", "n")
