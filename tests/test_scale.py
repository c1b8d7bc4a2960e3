"""Shared steps of the belief, on rows that would cost much if they were met one by one."""
import random
import statistics

from pyspark.sql import functions as F

from placeproof.functions import text
from placeproof.operators import nearest_name
from placeproof.operators.asof import known_before
from placeproof.operators.windows import trace_medians, trace_tail
from placeproof.plans import belief
from placeproof.plans import candidates as cand
from placeproof.plans import ranking
from placeproof.sources.tables import Views


def test_names_are_worked_out_once_per_name(spark):
    """Text work on localities and landmarks stands above a stage, not below their grouping in the scan of parts."""
    v = Views(spark, "/root/testdata/sf0.001")
    for df, c in ((v.locality(), "locality_name"), (v.landmark(), "poi_name")):
        plan = df.select(F.explode(text.tokens(text.norm_text(F.col(c)))))._jdf.queryExecution().optimizedPlan().toString()
        assert "parquet" not in plan and "Aggregate" not in plan


def test_parts_are_not_sent_through_the_driver(spark):
    """However small the part file is beside its rows, addresses, pins and surveyed points meet it without a broadcast."""
    v = Views(spark, "/root/testdata/sf0.001")
    views = [v.surveyed().select("address_id"), v.address().select("address_id", "town_id"), v.pin().select("address_id", "precision")]
    for df in views:
        plan = df._jdf.queryExecution().sparkPlan().toString().split("\n")
        met = [line for line in plan if "Join" in line and "p_partkey" in line]
        assert len(met) == 1 and "SortMergeJoin" in met[0]


def test_trace_medians_match_brute_force(spark):
    rng = random.Random(3)
    value = lambda: None if rng.random() < 0.1 else rng.randint(-15, 15)
    rows = [(v, rng.randint(0, 5), value(), value()) for v in range(40) for _ in range(rng.choice((1, 2, 3, 4, 9)))] + [(99, 1, None, None)]
    t = spark.createDataFrame(rows, "visit_id long, seq long, dx int, dy int")
    got = {r.visit_id: r for r in trace_medians(t).collect()}
    first = lambda x: (x is not None, x or 0)
    mid = lambda xs: statistics.median([x for x in xs if x is not None]) if any(x is not None for x in xs) else None
    assert got.keys() == {r[0] for r in rows}
    for visit, r in got.items():
        own = [x for x in rows if x[0] == visit]
        last = sorted(own, key=lambda x: (-x[1], first(x[2]), first(x[3])))[:3]
        assert (r.med_dx, r.med_dy, r.trail_points) == (mid([x[2] for x in own]), mid([x[3] for x in own]), len(own))
        assert (r.tail_dx, r.tail_dy, r.tail_n) == (mid([x[2] for x in last]), mid([x[3] for x in last]), len(last))
    assert {r.visit_id: (r.tail_dx, r.tail_dy, r.tail_n) for r in trace_tail(t).collect()} == {k: (r.tail_dx, r.tail_dy, r.tail_n) for k, r in got.items()}
    plan = trace_medians(t)._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and plan.count("Exchange hashpartitioning(visit_id") == 1


def test_landmark_scores_are_dealt_out_by_number(spark):
    """Sets of window tokens are few bytes with much work each: they are numbered and dealt to as many tasks as asked for."""
    addr = spark.createDataFrame([(1, "T1", ["near", "promo", "brand", "14"]), (2, "T1", ["near", "promo", "brand", "15"])], "address_id long, town_id string, toks array<string>")
    lm = spark.createDataFrame([("P1", "T1", "PROMO Brand#14"), ("P2", "T1", "PROMO Brand#15")], "poi_id string, town_id string, poi_name string")
    hits = cand.landmark_hits(addr, lm, most=2)
    assert {(r.address_id, r.poi_id, r.n_hits) for r in hits.collect()} == {(1, "P1", 1), (2, "P2", 1)}
    assert "REPARTITION_BY_NUM" in hits._jdf.queryExecution().executedPlan().toString()


def test_landmark_hits_match_brute_force(spark):
    v = Views(spark, "/root/testdata/sf0.001")
    addr, lm = cand.prepared_addresses(v.address()), v.landmark()
    win = addr.withColumn("win", text.relation_window(F.col("toks"))).filter("win is not null").select("address_id", "town_id", "win.*").collect()
    marks = lm.select("town_id", "poi_id", text.tokens(text.norm_text(F.col("poi_name"))).alias("t")).collect()
    want = set()
    for a in win:
        score = {m.poi_id: sum(2 * (t in a.after) + (t in a.before) for t in set(m.t)) for m in marks if m.town_id == a.town_id}
        best = sorted(p for p, s in score.items() if s and s == max(score.values()))
        want |= {(a.address_id, p, a.rel, len(best), i) for i, p in enumerate(best, 1)}
    rows = lambda **k: {(r.address_id, r.poi_id, r.rel, r.n_hits, r.rn) for r in cand.landmark_hits(addr, lm, **k).collect()}
    assert rows() == want and want and rows(most=2) == {r for r in want if r[4] <= 2}


def test_letter_masks_only_loosen_the_bound(spark):
    """Letters that one text has and the other lacks, by masks, are never more than by counting; equal texts lack none."""
    from collections import Counter
    rng = random.Random(4)
    texts = ["", "a", "𝒳y ಜಯ 𝒳", *["".join(rng.choice("abc 12ಜ") for _ in range(rng.randint(1, 60))) for _ in range(40)]]
    masks = {r.t: r.m for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", nearest_name.letter_mask("t").alias("m")).collect()}
    for a in texts:
        for b in texts:
            lacks = sum(((x & ~y) & (2**64 - 1)).bit_count() for x, y in zip(masks[a], masks[b]))
            assert lacks <= sum((Counter(a) - Counter(b)).values())


def test_char_grams_equal_the_plain_rule(spark):
    v = Views(spark, "/root/testdata/sf0.001")
    feats = ranking.address_features(cand.prepared_addresses(v.address()), v.locality())
    addr = {r.address_id: r for r in cand.prepared_addresses(v.address()).select("address_id", "town_id", "norm").collect()}
    names = {}
    for r in v.locality().select("town_id", text.norm_text(F.col("locality_name")).alias("n")).collect():
        names.setdefault(r.town_id, set()).add(r.n)
    grams = lambda s: {s[i:i + 3] for i in range(len(s) - 2)}
    for r in feats.collect():
        own = addr[r.address_id]
        toks = set(own.norm.split())
        best = max(((len(toks & set(n.split())) / len(toks | set(n.split())), n) for n in names.get(own.town_id, ())), default=None)
        a, b = (grams(own.norm.replace(" ", "")), grams(best[1].replace(" ", ""))) if best else (set(), set())
        assert r.f_sim_char3 == round(len(a & b) / len(a | b), 4) if a | b else r.f_sim_char3 == 0


def test_second_pass_ranks_only_what_memory_changes(spark):
    """The pass with memory takes the addresses that get a memory candidate, and the belief is that of ranking and deciding all of them again."""
    v, at = Views(spark, "/root/testdata/sf0.001"), "2024-01-08 00:00:00"
    prior = belief.prior_at(v, at)
    moved = {r.address_id for r in prior.filter("arm = 'field_evidence'").collect()}
    assert 0 < len(moved) < prior.count()
    assert sorted(r.address_id for r in belief.ranked_again(v, at).collect()) == sorted(moved)
    every = ranking.ranked_sets(belief.full_sets(v, at), belief.features_stage(v))
    whole = belief.decide(every, known_before(belief.evidence_stage(v), at), at)
    rows = lambda d: {r.address_id: r for r in d.collect()}
    assert rows(belief.ranked_at(v, at)) == rows(every)
    assert rows(belief.belief_at(v, at)) == rows(whole)
