"""The observation log as a stream: idempotent ingest, claims, scoring, belief updates, held rows.

Stateful steps are processors with typed state and event-time timers (RocksDB state, so state need not fit in memory).
"""
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from placeproof import policy
from placeproof.operators.asof import known_before
from placeproof.operators.windows import trailing_rate
from placeproof.plans import belief, decision, evidence, history
from placeproof.policy import BASE, RULES_VERSION
from placeproof.session import checkpoint, work_path
from placeproof.sources.keyed_log import KeyedLog

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WATERMARK = "7 days"      # devices may come back late by days; event time is kept


def event_stream(v) -> DataFrame:
    """Raw events as a file stream."""
    schema = v.raw("events").schema
    return (v.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
            .parquet(v.sf_dir))


def visit_stream(v) -> DataFrame:
    """Visits in event time, with the watermark every stateful step shares."""
    return v.visit(event_stream(v)).withWatermark("observed_at", WATERMARK)


def drain(df: DataFrame, name: str, sink: str | None = None, each_batch=None, mode: str = "append",
          state: str | None = None) -> str:
    """Run a stream over everything there is (backfill) and stop; returns the sink path.

    With the `state` folder of an earlier run the stream goes on where that run stopped.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    path = sink or work_path(spark, name)
    w = (df.writeStream.outputMode(mode).trigger(availableNow=True)
         .option("checkpointLocation", state or work_path(spark, f"{name}-state")))
    w = w.foreachBatch(each_batch) if each_batch else w.format("parquet").option("path", path)
    q = w.start()
    try:
        q.awaitTermination()
    finally:
        if q.isActive:
            q.stop()
    return path


def idempotent(visits: DataFrame) -> DataFrame:
    """First write wins within the watermark; later replays meet the keyed append."""
    return visits.dropDuplicatesWithinWatermark(["visit_id"])


def keyed_append(path: str, key: str, order: list[str], **layout):
    """foreachBatch sink: rows whose key is stored already are ignored; a batch reads only the folders it can touch (see `KeyedLog`)."""
    def write(batch: DataFrame, _epoch: int) -> None:
        KeyedLog(batch.sparkSession, path, key, order, **layout).append(batch)
    return write


def _millis(times: pd.Series) -> pd.Series:
    return times.astype("datetime64[ms]").astype("int64")


class ClaimLinker(StatefulProcessor):
    """First visit of each media hash of the owners in a bucket; it leaves the state when the watermark passes its time by the horizon."""

    def __init__(self, horizon_days: int):
        self.horizon = horizon_days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.firsts = handle.getListState("firsts", "claim string, first long, at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True).sort_values(["observed_at", "visit_id"]).drop_duplicates(["owner", "visit_id"])
        claim = frame["owner"] + "|" + frame["photo_hash"]
        firsts = {c: first for c, first, _ in self.firsts.get()}
        new = ~claim.duplicated() & ~claim.isin(firsts)
        if new.any():
            fresh = [(c, int(i), int(t)) for c, i, t in zip(claim[new], frame["visit_id"][new], _millis(frame["observed_at"][new]))]
            self.firsts.appendList(fresh)
            self.handle.registerTimer(min(t for _, _, t in fresh) + self.horizon)
            firsts.update((c, i) for c, i, _ in fresh)
        first = claim.map(firsts)
        yield pd.DataFrame({"visit_id": frame["visit_id"], "owner": frame["owner"], "photo_hash": frame["photo_hash"],
                            "duplicate_claim_of": first.astype("Int64").mask(first == frame["visit_id"])})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        kept = [f for f in self.firsts.get() if f[2] + self.horizon > timerValues.getCurrentWatermarkInMs()]
        if kept:
            self.firsts.put(kept)
            self.handle.registerTimer(min(f[2] for f in kept) + self.horizon)
        else:
            self.firsts.clear()
        return iter([])

    def close(self) -> None:
        pass


def link_claims(visits: DataFrame, horizon_days: int = 90, buckets: int = 16384) -> DataFrame:
    """Same media hash at the same address: later arrivals point at the first one, for `horizon_days` after it (the batch job
    `evidence.duplicate_claims` has no horizon).

    An owner is an address and one of eight lanes of its hashes, so a busy address is spread; repeats of a visit in one batch count once.
    Owners share the keys of the state by hash, since every key costs a call and several messages whatever it holds.

    buckets: to be set by the remembered visits (a batch reads the buckets it touches), and then kept.
    """
    lane = F.pmod(F.xxhash64("photo_hash"), F.lit(8)).cast("string")
    owned = visits.filter("photo_hash is not null").select(
        "visit_id", F.concat(F.coalesce(F.col("address_id").cast("string"), F.lit("")), F.lit("/"), lane).alias("owner"), "photo_hash", "observed_at")
    linked = owned.withColumn("bucket", F.pmod(F.xxhash64("owner"), F.lit(buckets))).groupBy("bucket").transformWithStateInPandas(
        ClaimLinker(horizon_days), "visit_id long, owner string, photo_hash string, duplicate_claim_of long", "Append", "EventTime")
    address = F.nullif(F.substring_index("owner", "/", 1), F.lit("")).cast("long").alias("address_id")
    return linked.select("visit_id", address, "photo_hash", "duplicate_claim_of")


class ArrivalScorer:
    """foreachBatch step: score the batch's visits as the batch job does, trail included, with the collector's rate of the 60 days
    before each visit.

    The rate reads the collector's stored visits of those days only (the log is laid out by collector and day); duplicate hashes come
    from a snapshot, as the bulk rule does.
    """

    def __init__(self, v, dup_media: DataFrame, root: str, days: int = 60):
        self.v, self.dup, self.days = v, dup_media, days
        self.log = KeyedLog(v.spark, f"{root}/visits", "visit_id", ["observed_at"], bucket_by="agent_id", time="observed_at")
        self.scores = KeyedLog(v.spark, f"{root}/scores", "visit_id", ["observed_at"], time="observed_at")

    def __call__(self, batch: DataFrame, _epoch: int) -> None:
        rows = checkpoint(batch)
        begin = rows.agg(F.min("observed_at")).first()[0]
        if begin is None:
            return
        self.log.append(rows.select("visit_id", "agent_id", "observed_at", "outcome"))
        like = rows.select("visit_id", "agent_id", "observed_at", "outcome")
        known = self.log.read(rows.select("agent_id"), like, since=begin - pd.Timedelta(days=self.days))
        rate = trailing_rate(known, "agent_id", "observed_at", "visit_id", F.col("outcome").isin(policy.NEGATIVE_OUTCOMES), days=self.days)
        seen = (self.v.observation(rows).join(self.dup.withColumn("media_dup", F.lit(True)), "media", "left")
                .join(rate.select(F.col("visit_id").alias("observation_id"), "rate"), "observation_id", "left"))
        scored = evidence.score_columns(seen, with_rate=True).withColumnRenamed("observation_id", "visit_id")
        self.scores.append(scored.select("visit_id", "observed_at", "weight", "reason_codes"))


def release(nxt: int, floor: int, gaps: np.ndarray, seq: np.ndarray, us: np.ndarray, mark: int, horizon: int):
    """((seq, us, kind) released, kept (seq, us), new (nxt, floor, gaps)) of one device.

    nxt: the smallest number not passed yet.  gaps: rows (low, high, opened) of numbers that were passed over; they are remembered for a
    horizon.  Below floor a forgotten gap may lie: such a number is released as late and may be a repeat.  A row whose time is a horizon
    before the watermark takes all held rows with smaller numbers along.
    """
    order = np.lexsort((us, seq))
    seq, us = seq[order], us[order]
    once = np.ones(len(seq), bool)
    once[1:] = seq[1:] != seq[:-1]
    seq, us = seq[once], us[once]
    low = seq < nxt
    s, at = seq[low], np.searchsorted(gaps[:, 0], seq[low], "right") - 1
    inside = (at >= 0) & (s < gaps[np.maximum(at, 0), 1]) if len(gaps) else np.zeros(len(s), bool)
    late = ~inside & (s < floor)
    out = [(s[inside], us[low][inside], "in_order"), (s[late], us[low][late], "late")]
    if inside.any():                                    # take the numbers out of their gaps: begins and ends pair up in order
        begin = np.sort(np.concatenate([gaps[:, 0], s[inside] + 1]))
        end = np.sort(np.concatenate([gaps[:, 1], s[inside]]))
        opened = gaps[np.searchsorted(gaps[:, 0], begin, "right") - 1, 2]
        gaps = np.stack([begin, end, opened], axis=1)[begin < end]
    s, u = seq[~low], us[~low]
    old = np.flatnonzero(u // 1000 + horizon <= mark)
    gone = int(old[-1]) + 1 if len(old) else 0
    plain = s == nxt + np.arange(len(s))                # the run from nxt on
    run = int(np.argmin(plain)) if not plain.all() else len(s)
    gone = max(gone, run)
    if gone:
        kind = np.arange(gone) < run
        out += [(s[:gone][kind], u[:gone][kind], "in_order"), (s[:gone][~kind], u[:gone][~kind], "expired")]
        before = np.concatenate([[nxt], s[:gone - 1] + 1])
        holes = before < s[:gone]
        gaps = np.concatenate([gaps, np.stack([before[holes], s[:gone][holes], np.full(holes.sum(), mark)], axis=1)])
        nxt = int(s[gone - 1]) + 1
        s, u = s[gone:], u[gone:]
        follow = s == nxt + np.arange(len(s))
        more = int(np.argmin(follow)) if not follow.all() else len(s)
        out.append((s[:more], u[:more], "in_order"))
        nxt, s, u = nxt + more, s[more:], u[more:]
    forgotten = gaps[:, 2] + horizon <= mark
    floor = max(floor, int(gaps[forgotten, 1].max(initial=0)))
    return out, (s, u), (nxt, floor, gaps[~forgotten])


class SequenceHolder(StatefulProcessor):
    """Held rows and gaps of one device (see `release`)."""

    def __init__(self, days: int):
        self.horizon = days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.progress = handle.getValueState("progress", "nxt long, floor long")
        self.held = handle.getListState("held", "seq long, us long")
        self.gaps = handle.getListState("gaps", "low long, high long, opened long")

    def _step(self, key, seq: np.ndarray, us: np.ndarray, mark: int) -> Iterator[pd.DataFrame]:
        held = np.array([tuple(r) for r in self.held.get()], np.int64).reshape(-1, 2)
        gaps = np.array([tuple(r) for r in self.gaps.get()], np.int64).reshape(-1, 3)
        nxt, floor = self.progress.get() or (0, 0)
        out, (s, u), (nxt, floor, gaps) = release(nxt, floor, gaps, np.concatenate([held[:, 0], seq]), np.concatenate([held[:, 1], us]), mark, self.horizon)
        self.progress.update((nxt, floor))
        for state, rows in ((self.held, np.stack([s, u], axis=1)), (self.gaps, gaps)):
            state.put([tuple(int(x) for x in r) for r in rows]) if len(rows) else state.clear()
        ends = [*(u // 1000 + self.horizon), *(gaps[:, 2] + self.horizon)]
        if ends:
            self.handle.registerTimer(max(int(min(ends)), mark + 1))
        frame = pd.concat([pd.DataFrame({"device": key[0], "seq": a, "observed_at": pd.to_datetime(b, unit="us"), "release": kind}) for a, b, kind in out], ignore_index=True)
        if len(frame):
            yield frame.sort_values(["observed_at", "seq"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True)
        return self._step(key, frame["seq"].to_numpy(np.int64), frame["observed_at"].astype("datetime64[us]").astype("int64").to_numpy(), timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self._step(key, np.zeros(0, np.int64), np.zeros(0, np.int64), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def hold_out_of_order(visits: DataFrame, days: int = 7) -> DataFrame:
    """Per device: hold a row until every smaller sequence number has come or `days` have passed in event time; each number is
    released once, in (observed_at, seq) order.

    Numbers that were passed over when a later row expired are remembered for as many days: such a row is still released when it comes,
    any other number that was released before is a repeat and is dropped.  After that it is released as `late`, and the keyed append
    behind it tells repeats.
    """
    return visits.select("device", "seq", "observed_at").groupBy("device").transformWithStateInPandas(
        SequenceHolder(days), "device string, seq long, observed_at timestamp, release string", "Append", "EventTime")


class BacklogSorter(StatefulProcessor):
    """Rows of one device, kept until the watermark has passed their time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, local_seq long")
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows), ignore_index=True)
        us = frame["observed_at"].astype("datetime64[us]").astype("int64")
        self.waiting.appendList([(int(u), int(s)) for u, s in zip(us, frame["local_seq"])])
        self.handle.registerTimer(int(us.min()) // 1000 + 1)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        rows = np.array([tuple(r) for r in self.waiting.get()], np.int64).reshape(-1, 2)
        due = rows[:, 0] < mark
        out = np.unique(rows[due], axis=0)              # in order of time and number, a repeat once
        if due.all():
            self.waiting.clear()
        else:
            self.waiting.put([(int(u), int(s)) for u, s in rows[~due]])
            self.handle.registerTimer(int(rows[~due, 0].min()) // 1000 + 1)
        if len(out):
            n = (self.count.get() or (0,))[0]
            self.count.update((n + len(out),))
            yield pd.DataFrame({"device": key[0], "position": n + np.arange(len(out)), "local_seq": out[:, 1], "observed_at": pd.to_datetime(out[:, 0], unit="us")})

    def close(self) -> None:
        pass


def drain_backlog(visits: DataFrame) -> DataFrame:
    """Device backlogs that come late by up to the watermark, put back in order: (device, position, local_seq, observed_at).

    A row is released once the watermark has passed its event time, so none that is still to come can belong before it; rows of a device
    are numbered in (observed_at, local_seq) order, across batches and restarts.  local_seq is the number in the visit's id.
    """
    return visits.select("device", "local_seq", "observed_at").groupBy("device").transformWithStateInPandas(
        BacklogSorter(), "device string, position long, local_seq long, observed_at timestamp", "Append", "EventTime")


def activity(visits: DataFrame) -> DataFrame:
    """30-day sliding activity per outcome, one window per day (append when the watermark passes)."""
    return visits.groupBy(F.window("observed_at", "30 days", "1 day"), "outcome").agg(
        F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "outcome", "n")


class BeliefUpdater:
    """foreachBatch step: append the rows, recompute the touched addresses in two passes, emit versions, diffs and tasks.

    The log and the stored beliefs are laid out by address, so a batch reads only the buckets of its addresses.  The first pass has no
    memory; the second has the memory arm, from the newest stored version strictly before the instant under the current rules, else from
    the first pass.  Appends are keyed, so a replayed batch changes nothing.

    as_of: the instant of every batch, or a function that gives it for a batch of observations.
    """

    def __init__(self, v, as_of: str | Callable[[DataFrame], str], root: str, rules: str = RULES_VERSION):
        self.v, self.rules = v, rules
        self.as_of = as_of if callable(as_of) else lambda _batch: as_of
        by_address = lambda name, key, order: KeyedLog(v.spark, f"{root}/{name}", key, order, bucket_by="address_id")
        self.log, self.beliefs = by_address("log", "observation_id", ["observed_at"]), by_address("beliefs", "belief_key", ["as_of"])
        self.tasks, self.diffs = by_address("tasks", "task_id", ["raised_at"]), by_address("diffs", "diff_key", ["epoch"])

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        from placeproof.plans import candidates as cand, ranking
        rows = checkpoint(batch)
        if rows.isEmpty():
            return
        at = self.as_of(rows)
        self.log.append(rows)
        touched = checkpoint(rows.select("address_id").distinct())
        known = checkpoint(known_before(self.log.read(touched, rows), at))
        static, feats = (x.join(touched, "address_id", "left_semi") for x in (belief.static_stage(self.v), belief.features_stage(self.v)))
        sets = checkpoint(cand.with_agreement(cand.candidate_sets(static.unionByName(cand.field_evidence(known)))))
        feats = checkpoint(feats)
        prior = checkpoint(belief.decide(checkpoint(ranking.ranked_sets(sets, feats)), known, at, BASE).drop("ranked"))
        keyed = lambda d: d.withColumn("rules_version", F.lit(self.rules)).withColumn("belief_key", F.concat_ws("@", "address_id", "as_of", "belief_version", "rules_version"))
        stored = checkpoint(self.beliefs.read(touched, keyed(prior)))
        memory = belief.stored_memory(touched.withColumn("as_of", F.lit(at).cast("timestamp")), stored, prior, self.rules)
        full = checkpoint(ranking.ranked_sets(belief.add_arm(sets, memory), feats))
        now = checkpoint(keyed(belief.decide(full, known, at, BASE).drop("ranked")))
        before = stored.groupBy("address_id").agg(F.max_by(F.struct("tier", "status", "candidate_id", "radius_m"), F.struct("as_of", "belief_version")).alias("b")).select("address_id", "b.*")
        changed = history.diff(before, now).withColumn("epoch", F.lit(epoch)).withColumn("diff_key", F.concat_ws("@", "address_id", "epoch"))
        self.diffs.append(changed)
        self.tasks.append(decision.tasks(now))
        self.beliefs.append(now)

    def latest(self) -> DataFrame:
        """The newest stored version of each address."""
        every = self.v.spark.read.parquet(self.beliefs.path).filter(F.col("rules_version") == self.rules)
        rest = [c for c in every.columns if c != "address_id"]
        return every.groupBy("address_id").agg(F.max_by(F.struct(*rest), F.struct("as_of", "belief_version")).alias("b")).select("address_id", "b.*")
