"""Policy sweep: beliefs under many policies in one run of the plan, the policy being part of the key.

Every (address, policy) is one key `address_id * n + i`; constants that differ are column expressions of the key, so one evidence scan, one
set of joins and one belief pass serve all policies.  Candidates keep the names they have in a run of their own.
"""
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeproof.operators.asof import known_before
from placeproof.plans import belief, candidates as cand, ranking
from placeproof.policy import BASE, Policy
from placeproof.session import checkpoint


def beliefs(v, policies: list[Policy], as_of: str) -> DataFrame:
    """Belief rows of every address under every policy, with the policy's name in `policy`."""
    n = len(policies)
    at = (F.pmod(F.col("address_id"), F.lit(n)) + 1).cast("int")
    own = F.floor(F.col("address_id") / n).cast("long")

    def of_key(values: list):
        return F.element_at(F.array(*[F.lit(x) for x in values]), at)
    varied = [f for f in Policy.__dataclass_fields__ if f != "name" and len({getattr(p, f) for p in policies}) > 1]
    p = replace(policies[0], **{f: of_key([getattr(q, f) for q in policies]) for f in varied})

    def spread(rows: DataFrame) -> DataFrame:
        return rows.withColumn("address_id", F.explode(F.array(*[F.col("address_id") * n + i for i in range(n)])))
    belief.inputs(v)
    known = checkpoint(spread(known_before(belief.evidence_stage(v), as_of)))
    feats = checkpoint(spread(belief.features_stage(v)))
    sets = checkpoint(cand.with_agreement(cand.candidate_sets(spread(belief.static_stage(v)).unionByName(cand.field_evidence(known, p)), p, own), p))
    prior = checkpoint(belief.decide(checkpoint(ranking.ranked_sets(sets, feats)), known, as_of, p).drop("ranked"))
    full = checkpoint(ranking.ranked_sets(belief.add_arm(sets, belief.memory_arm(prior, as_of, own), p, own), feats))
    out = belief.decide(full, known, as_of, p).drop("ranked")
    return out.withColumn("policy", of_key([q.name for q in policies])).withColumn("address_id", own)


def compared(rows: DataFrame, truth: DataFrame, base: str = BASE.name) -> DataFrame:
    """One row per policy: tiers, statuses, error against truth (address_id, tx, ty), and the paired difference from the base policy."""
    err = F.sqrt(F.pow(F.col("x") - F.col("tx"), 2) + F.pow(F.col("y") - F.col("ty"), 2))
    e = rows.join(truth, "address_id", "left").withColumn("err", err)
    b = e.filter(F.col("policy") == base).select("address_id", F.col("err").alias("base_err"), F.col("tier").alias("base_tier"))
    j = e.join(b, "address_id", "left")
    both = F.col("err").isNotNull() & F.col("base_err").isNotNull()
    return j.groupBy("policy").agg(
        F.count("*").alias("n"), *[F.count_if(F.col("tier") == t).alias(t.lower()) for t in ("CONFIRMED", "PROBABLE", "APPROXIMATE", "UNPLACEABLE")],
        F.count_if(F.col("status") == "CONTESTED").alias("contested"), F.count_if(F.col("status") == "MOVED_SUSPECTED").alias("moved_suspected"),
        F.round(F.percentile("err", 0.5), 3).alias("median_err"), F.round(F.avg("err"), 3).alias("mean_err"), F.round(F.avg((F.col("err") <= 100).cast("int")), 4).alias("hit_100"),
        F.count_if(both).alias("n_paired"), F.round(F.avg(F.col("err") - F.col("base_err")), 3).alias("mean_diff"), F.count_if(F.col("tier") != F.col("base_tier")).alias("tier_changes"))
