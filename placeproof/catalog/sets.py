"""Set-operation jobs."""
from pyspark.sql import functions as F

from placeproof.catalog import query
from placeproof.catalog.oracle_domain import AS_OF
from placeproof.functions import digest
from placeproof.plans import belief, candidates as cand, evidence


@query("candidate_union", "SELECT address_id, arm, source_ref, arm_rank::INTEGER AS arm_rank FROM w_cand1")
def candidate_union(v):
    """The whole union after de-duplication by (arm, source), memory included."""
    return cand.exploded(belief.full_sets(v, AS_OF)).select("address_id", "arm", "source_ref", "arm_rank")


FIREWALL = """(SELECT address_id, account_id, address_id IN (SELECT address_id FROM w_surveyed) AS s, account_id IN (SELECT address_id//2 FROM w_surveyed) AS a,
  b.block_id IS NOT NULL AND b.block_id IN (SELECT block_id FROM w_block WHERE id IN (SELECT address_id FROM w_surveyed)) AS k FROM w_address LEFT JOIN w_block b ON b.id = address_id)"""


def firewall(v):
    """Surveyed addresses, their accounts and their blocks, with the reasons."""
    from placeproof.catalog.joins import blocks_stage
    a = v.address().select("address_id", "account_id").join(
        blocks_stage(v).withColumnRenamed("id", "address_id"), "address_id", "left")
    s = a.join(v.surveyed().select("address_id"), "address_id", "left_semi")
    own = s.select("address_id").withColumn("s", F.lit("surveyed"))
    acc = s.select("account_id").distinct().withColumn("a", F.lit("account_of_surveyed"))
    blk = s.filter("block_id is not null").select("block_id").distinct().withColumn("k", F.lit("block_of_surveyed"))
    return (a.join(own, "address_id", "left").join(acc, "account_id", "left").join(blk, "block_id", "left")
            .withColumn("exclusion_reason", F.concat_ws("+", "s", "a", "k")))


@query("supervision_firewall", f"""
SELECT address_id, concat_ws('+', CASE WHEN s THEN 'surveyed' END, CASE WHEN a THEN 'account_of_surveyed' END, CASE WHEN k THEN 'block_of_surveyed' END) AS exclusion_reason
FROM {FIREWALL} WHERE s OR a OR k""")
def supervision_firewall(v):
    return firewall(v).filter("exclusion_reason <> ''").select("address_id", "exclusion_reason")


def folds(v):
    from placeproof.catalog.windows import spatial_folds
    return spatial_folds(v).select("block_id", "fold")


SPLITS = f"""(SELECT address_id, account_id, CASE WHEN s THEN 'S-EVAL' WHEN s OR a OR k THEN 'EXCLUDED' WHEN address_id NOT IN (SELECT address_id FROM w_promo WHERE promoted) THEN 'POOL_UNSUPERVISED'
 WHEN inner_fold = outer_fold THEN 'S-VAL' ELSE 'S-TRAIN' END AS split, outer_fold, inner_fold FROM (SELECT f.*, coalesce(fold, address_id % 5) AS outer_fold,
  list_sum(list_transform(string_split(sha1(account_id::VARCHAR),''), lambda c: instr('0123456789abcdef', c)-1))::BIGINT % 5 AS inner_fold FROM {FIREWALL} f LEFT JOIN w_block ON id = address_id LEFT JOIN w_fold USING (block_id)))"""


@query("split_manifest", f"SELECT address_id, split, outer_fold, inner_fold FROM {SPLITS}")
def split_manifest(v):
    """S-EVAL / EXCLUDED / POOL / S-VAL / S-TRAIN in rule order."""
    promo = evidence.promotion(belief.evidence_stage(v), ["address_id"]).filter("promoted").select("address_id").withColumn("eligible", F.lit(True))
    # The outer fold is the block's, so neighbours never sit on both sides; addresses without a point are in no block.
    f = firewall(v).join(promo, "address_id", "left").join(folds(v), "block_id", "left").withColumn("outer_fold", F.coalesce("fold", F.col("address_id") % 5)).withColumn(
        "inner_fold", digest.sha1_mod5(F.col("account_id")).cast("long"))
    split = (F.when(F.col("s").isNotNull(), "S-EVAL").when(F.col("exclusion_reason") != "", "EXCLUDED")
             .when(F.col("eligible").isNull(), "POOL_UNSUPERVISED").when(F.col("inner_fold") == F.col("outer_fold"), "S-VAL")
             .otherwise("S-TRAIN"))
    return f.select("address_id", split.alias("split"), "outer_fold", "inner_fold")


@query("new_coordinates", """
SELECT address_id, x, y FROM w_candm EXCEPT SELECT address_id, x, y FROM w_cand""")
def new_coordinates(v):
    """Coordinates the full run has and the run without memory lacks: must be none."""
    a, b = (cand.exploded(s).select("address_id", "x", "y") for s in (belief.full_sets(v, AS_OF), belief.bare_sets(v, AS_OF)))
    return a.subtract(b)


@query("arm_ladder", """
SELECT rung, count(*) AS n_candidates, count(DISTINCT address_id) AS n_addresses FROM w_candm JOIN (SELECT unnest(range(1,8)) AS rung) ON arm_index <= rung GROUP BY 1""")
def arm_ladder(v):
    """Cumulative union of the arms, one row per rung, from one count per (address, arm)."""
    c = cand.exploded(belief.full_sets(v, AS_OF)).groupBy("address_id", "arm_index").agg(F.count("*").alias("n"))
    r = c.withColumn("rung", F.explode(F.sequence("arm_index", F.lit(7)))).groupBy("rung", "address_id").agg(F.sum("n").alias("n"))
    return r.groupBy(F.col("rung").cast("long").alias("rung")).agg(F.sum("n").alias("n_candidates"), F.count("*").alias("n_addresses"))


@query("paired_population", """
SELECT a.arm AS arm_before, b.arm AS arm_after, count(*) AS n FROM w_prior a JOIN w_belief b USING (address_id) WHERE a.candidate_id IS NOT NULL AND b.candidate_id IS NOT NULL GROUP BY 1,2""")
def paired_population(v):
    a = belief.prior_at(v, AS_OF).filter("candidate_id is not null").select("address_id", F.col("arm").alias("arm_before"))
    b = belief.belief_at(v, AS_OF).filter("candidate_id is not null").select("address_id", F.col("arm").alias("arm_after"))
    return a.join(b, "address_id").groupBy("arm_before", "arm_after").agg(F.count("*").alias("n"))
