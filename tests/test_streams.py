"""Stateful steps and the keyed log: state leaves, restarts go on, replays add nothing, a batch reads only what it can touch."""
import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from placeproof.plans import belief
from placeproof.sources.keyed_log import KeyedLog
from placeproof.sources.tables import Views
from placeproof.streaming import pipeline

T0 = dt.datetime(2024, 1, 1)
DAY = 86_400_000


def run(spark, src, sink, state, rows, schema, step):
    """One more arrival, drained with the state of the earlier ones."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).parquet(src).withWatermark("observed_at", pipeline.WATERMARK)
    pipeline.drain(step(stream), "test", sink=sink, state=state)
    return spark.read.parquet(sink).collect()


def state_rows(spark, state):
    """Remembered first visits."""
    return spark.read.format("statestore").option("path", state).option("stateVarName", "firsts").load().count()


def test_claims_link_across_restarts_and_leave_the_state(spark, tmp_path):
    src, sink, state = (str(tmp_path / n) for n in ("src", "sink", "state"))
    schema = "visit_id long, address_id long, photo_hash string, observed_at timestamp"
    step = lambda s: pipeline.link_claims(s, horizon_days=10)
    at = lambda d: T0 + dt.timedelta(days=d)
    got = run(spark, src, sink, state, [(2, 1, "a", at(0.2)), (1, 1, "a", at(0.1)), (3, 1, "b", at(0)), (4, 2, "a", at(0)), (5, 1, None, at(0)), (2, 1, "a", at(0.2))], schema, step)
    assert {r.visit_id: r.duplicate_claim_of for r in got} == {1: None, 2: 1, 3: None, 4: None} and len(got) == 4
    got = run(spark, src, sink, state, [(6, 1, "a", at(3)), (7, 1, "c", at(3))], schema, step)
    assert {r.visit_id: r.duplicate_claim_of for r in got if r.visit_id > 5} == {6: 1, 7: None}
    assert state_rows(spark, state) == 4
    run(spark, src, sink, state, [(8, 9, "z", at(60))], schema, step)                # the watermark passes every horizon
    assert state_rows(spark, state) == 1
    got = run(spark, src, sink, state, [(9, 1, "a", at(59))], schema, step)
    assert {r.visit_id: r.duplicate_claim_of for r in got}[9] is None


def test_claims_of_many_addresses_share_few_keys(spark, tmp_path):
    """Every key costs a call to Python and several messages, so their number does not grow with the addresses."""
    src, sink, state = (str(tmp_path / n) for n in ("src", "sink", "state"))
    rnd = random.Random(11)
    row = lambda i: (i, rnd.choice([None, *range(300)]), f"h{rnd.randint(0, 9)}", T0 + dt.timedelta(minutes=rnd.randint(0, 9999)))
    arrivals = [[row(i) for i in range(1500)], [row(i) for i in range(1500, 2000)]]
    schema = "visit_id long, address_id long, photo_hash string, observed_at timestamp"
    for rows in arrivals:
        got = run(spark, src, sink, state, rows, schema, lambda s: pipeline.link_claims(s, buckets=6))
    firsts, want = {}, set()
    for rows in arrivals:
        for visit, address, photo, _ in sorted(rows, key=lambda r: (r[3], r[0])):
            first = firsts.setdefault((address, photo), visit)
            want.add((visit, address, photo, first if first != visit else None))
    assert len(got) == 2000 and {tuple(r) for r in got} == want
    keys = spark.read.format("statestore").option("path", state).option("stateVarName", "firsts").load().select("key").distinct().count()
    assert keys <= 6 and state_rows(spark, state) == len(firsts)


def by_hand(arrivals, horizon):
    """The same rules one number at a time."""
    nxt, floor, gaps, held, out = 0, 0, {}, {}, []
    for mark, rows in arrivals:
        for s, u in sorted(rows):
            if s < nxt:
                if s in gaps:
                    out.append((s, "in_order"))
                    del gaps[s]
                elif s < floor:
                    out.append((s, "late"))
            else:
                held[s] = min(u, held.get(s, u))
        while True:
            if nxt in held:
                out.append((nxt, "in_order"))
                held.pop(nxt)
                nxt += 1
                continue
            old = [s for s, u in held.items() if u // 1000 + horizon <= mark]
            if not old:
                break
            last = max(old)
            for s in range(nxt, last + 1):
                if s in held:
                    out.append((s, "expired"))
                    held.pop(s)
                else:
                    gaps[s] = mark
            nxt = last + 1
        gone = [s for s, m in gaps.items() if m + horizon <= mark]
        floor = max([floor, *[s + 1 for s in gone]])
        for s in gone:
            del gaps[s]
    return out, nxt, held


@pytest.mark.parametrize("seed", range(30))
def test_release_rules_match_one_at_a_time(seed):
    rng = random.Random(seed)
    horizon, nxt, floor, gaps = 7 * DAY, 0, 0, np.zeros((0, 3), np.int64)
    held = np.zeros((0, 2), np.int64)
    arrivals, got = [], []
    for step in range(14):
        mark = step * 2 * DAY
        rows = [(rng.randint(0, 12 + 6 * step), (mark + rng.randint(-3, 9) * DAY) * 1000) for _ in range(rng.randint(0, 6))]
        rows = list({s: (s, u) for s, u in rows}.values())
        arrivals.append((mark, rows))
        a = np.array(rows, np.int64).reshape(-1, 2)
        out, kept, (nxt, floor, gaps) = pipeline.release(nxt, floor, gaps, np.concatenate([held[:, 0], a[:, 0]]), np.concatenate([held[:, 1], a[:, 1]]), mark, horizon)
        held = np.stack(kept, axis=1)
        got += [(int(s), k) for seqs, _, k in out for s in seqs]
    want, end, left = by_hand(arrivals, horizon)
    kinds = lambda rows: sorted((s, "late" if k == "late" else "out") for s, k in rows)
    assert (nxt, sorted(held[:, 0].tolist())) == (end, sorted(left)) and kinds(got) == kinds(want)


def test_gaps_are_forgotten_after_the_horizon():
    gaps = np.array([[3, 9, 0]], np.int64)
    out, _, (nxt, floor, gaps) = pipeline.release(10, 0, gaps, np.array([4], np.int64), np.array([0], np.int64), 8 * DAY, 7 * DAY)
    assert [(s.tolist(), k) for s, _, k in out if len(s)] == [([4], "in_order")] and len(gaps) == 0 and (nxt, floor) == (10, 9)
    out, _, _ = pipeline.release(nxt, floor, gaps, np.array([5, 9], np.int64), np.array([0, 0], np.int64), 8 * DAY, 7 * DAY)
    assert [(s.tolist(), k) for s, _, k in out if len(s)] == [([5], "late")]


def test_backlog_comes_out_in_order_across_restarts(spark, tmp_path):
    src, sink, state = (str(tmp_path / n) for n in ("src", "sink", "state"))
    rng = random.Random(3)
    rows = [("ab"[i % 2], i, T0 + dt.timedelta(hours=rng.randint(0, 24 * 40))) for i in range(200)]
    rows += [("a", 900, rows[0][2]), ("a", 901, rows[0][2])]
    arrivals = sorted(rows, key=lambda r: r[2] + dt.timedelta(days=r[1] % 5))
    for part in (arrivals[:70], arrivals[70:140], arrivals[140:] + arrivals[-3:]):
        got = run(spark, src, sink, state, part, "device string, local_seq long, observed_at timestamp", pipeline.drain_backlog)
    mark = max(r[2] for r in rows) - dt.timedelta(days=7)
    for device in "ab":
        want = [s for _, s, t in sorted((r for r in rows if r[0] == device and r[2] < mark), key=lambda r: (r[2], r[1]))]
        assert [r.local_seq for r in sorted((g for g in got if g.device == device), key=lambda r: r.position)] == want
        assert sorted(r.position for r in got if r.device == device) == list(range(len(want)))


def test_a_batch_reads_only_its_folders(spark, tmp_path):
    make = lambda lo, hi, day: spark.range(lo, hi).select("id", (F.lit(T0).cast("timestamp") + F.make_dt_interval(F.lit(day))).alias("t"), F.lit("x").alias("v"))
    log = KeyedLog(spark, str(tmp_path / "days"), "id", ["t"], buckets=4, time="t")
    for day in range(8):
        log.append(make(day * 1000, day * 1000 + 1000, day))
    files = len(spark.read.parquet(log.path).inputFiles())
    late = make(3000, 3500, 3)
    touched = log.touched(late)
    assert files == 32 and len(touched) == 4 and all("_day=2024-01-04" in f for f in touched)
    log.append(late.union(make(50_000, 50_010, 3)))
    assert spark.read.parquet(log.path).count() == 8_010
    wide = KeyedLog(spark, str(tmp_path / "keys"), "id", ["t"], buckets=32)
    wide.append(make(0, 5000, 0))
    one = make(7, 8, 5)
    assert len(wide.touched(one)) == 1 and wide.read(one, one).count() == 1
    wide.append(one)                                                       # the key again, with another time
    assert [r.t for r in wide.read(one, one).collect()] == [T0]
    nulls = spark.createDataFrame([(1, None, "x"), (1, None, "x")], "id long, t timestamp, v string")
    empty = KeyedLog(spark, str(tmp_path / "nulls"), "id", ["t"], time="t")
    empty.append(nulls)
    empty.append(nulls)
    empty.append(nulls.limit(0))
    assert spark.read.parquet(empty.path).count() == 1 and empty.read(nulls, nulls, since=T0).count() == 0


def test_updates_equal_the_batch_job_and_a_replay_adds_nothing(spark, tmp_path):
    v = Views(spark, "/root/testdata/sf0.001")
    cut = "2024-01-08 00:00:00"
    up = pipeline.BeliefUpdater(v, cut, str(tmp_path))
    rows = belief.evidence_stage(v)
    parts = [rows.filter(F.pmod(F.xxhash64("observation_id"), F.lit(2)) == i) for i in (0, 1)]
    for i, p in enumerate(parts):
        up(p, i)
    fields = ["address_id", "tier", "status", "candidate_id", "radius_m", "arm"]
    seen = rows.select("address_id").distinct()
    want = sorted(map(str, belief.belief_at(v, cut).join(seen, "address_id", "left_semi").select(*fields).collect()))
    assert sorted(map(str, up.latest().select(*fields).collect())) == want
    sizes = lambda: [spark.read.parquet(x.path).count() for x in (up.log, up.beliefs, up.tasks, up.diffs)]
    before = sizes()
    up(parts[0], 0)
    assert sizes() == before


def test_memory_comes_from_stored_versions_of_the_current_rules(spark):
    fields = "address_id long, candidate_id string, arm string, x double, y double, granularity string, stratum string, tier string, belief_version long"
    prior = spark.createDataFrame([(i, f"p{i}", "field_evidence", 9.0, 9.0, "street", "street", "PROBABLE", 50) for i in range(1, 7)], fields)
    at = lambda d: T0 + dt.timedelta(days=d)
    rows = [(1, "c1", "field_evidence", 1.0, 1.0, "street", "street", "CONFIRMED", 2, at(1), "rules-1"), (1, "c2", "field_evidence", 2.0, 1.0, "street", "street", "APPROXIMATE", 3, at(2), "rules-1"),
            (1, "c3", "field_evidence", 3.0, 1.0, "street", "street", "CONFIRMED", 4, at(5), "rules-1"),        # at the instant: not before it
            (2, "c4", "frozen_baseline", 4.0, 1.0, "street", "street", "PROBABLE", 2, at(1), "rules-1"),        # rests on a static arm: no memory
            (3, "c5", "field_evidence", 5.0, 1.0, "street", "street", "CONFIRMED", 2, at(1), "rules-0"),        # superseded rules: the prior pass
            (4, None, None, None, None, None, "locality", "UNPLACEABLE", 2, at(1), "rules-1")]                  # no candidate: the prior pass
    versions = spark.createDataFrame(rows, fields + ", as_of timestamp, rules_version string")
    points = spark.createDataFrame([(i, at(5)) for i in range(1, 6)] + [(1, at(1.5))], "address_id long, as_of timestamp")
    got = sorted((r.address_id, r.source_ref, r.x, r.primary_eligible) for r in belief.stored_memory(points, versions, prior).collect())
    assert got == [(1, "memory:1@v2", 1.0, True), (1, "memory:1@v3", 2.0, False), (3, "memory:3@v50", 9.0, True), (4, "memory:4@v50", 9.0, True), (5, "memory:5@v50", 9.0, True)]
