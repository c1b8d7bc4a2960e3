"""Digest, attestation and bundle jobs."""
from pyspark.sql import functions as F

from placeproof.catalog import query
from placeproof.functions import digest
from placeproof.sources import sinks

JSON_ROW = """'{"n_name":"'||n_name||'","n_nationkey":'||n_nationkey||',"n_regionkey":'||n_regionkey||'}'"""
ORDER_JSON = """'{"o_custkey":'||o_custkey||',"o_orderdate":"'||strftime(o_orderdate,'%Y-%m-%d %H:%M:%S')||'","o_orderkey":'||o_orderkey||',"o_orderpriority":"'||o_orderpriority||'","o_orderstatus":"'||o_orderstatus||'","o_totalprice":"'||o_totalprice::DECIMAL(20,4)::VARCHAR||'"}'"""
ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def _orders(v):
    """All columns, prices and dates as fixed text so that a digest does not depend on an engine's number format."""
    return v.raw("orders").withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(20,4)").cast("string")).withColumn(
        "o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).select(*ORDER_COLUMNS)


WORDS = ",'-',".join(f"((sum(('0x'||substr(h,{1 + 15 * i},15))::UBIGINT::HUGEINT)) % 1152921504606846976)::VARCHAR" for i in range(4))


@query("row_digests", f"SELECT o_orderkey, sha256({ORDER_JSON}) AS h FROM orders")
def row_digests(v):
    return _orders(v).select("o_orderkey", digest.row_digest(ORDER_COLUMNS).alias("h"))


@query("table_attestation", f"SELECT count(*) AS n_rows, sha256(concat({WORDS})) AS table_digest FROM (SELECT sha256({ORDER_JSON}) AS h FROM orders)")
def table_attestation(v):
    return digest.attestation(_orders(v).select(digest.row_digest(ORDER_COLUMNS).alias("h")), "h")


@query("candidate_fingerprint", f"""
SELECT count(*) AS n_rows, sha256(concat({WORDS})) AS table_digest FROM (SELECT sha256(candidate_id||'|'||arm||'|'||source_ref||'|'||granularity||'|'||floor(x*1000)::BIGINT||'|'||floor(y*1000)::BIGINT) AS h FROM w_cand)""")
def candidate_fingerprint(v):
    from placeproof.catalog.oracle_domain import AS_OF
    from placeproof.plans import belief, candidates
    c = candidates.exploded(belief.bare_sets(v, AS_OF))
    return digest.attestation(c.select(F.sha2(F.concat_ws("|", "candidate_id", "arm", "source_ref", "granularity", F.floor(F.col("x") * 1000), F.floor(F.col("y") * 1000)), 256).alias("h")), "h")


@query("rebuild_check", f"""
SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 400000""")
def rebuild_check(v):
    """Two manifests of one table, the second after a change of status: the changed keys are listed."""
    o = _orders(v)
    changed = o.withColumn("o_orderstatus", F.when((F.col("o_orderstatus") == "P") & (F.col("o_totalprice").cast("double") > 400000), "X")
                           .otherwise(F.col("o_orderstatus")))
    a, b = (d.select("o_orderkey", digest.row_digest(ORDER_COLUMNS).alias("digest")) for d in (o, changed))
    return sinks.rebuild_mismatches(a, b, "o_orderkey").select("o_orderkey")


@query("town_bundles", """
SELECT a.town_id, a.address_id, count(arm) AS n_candidates, DATE '2024-01-15' AS valid_until FROM w_address a LEFT JOIN (SELECT * FROM w_union WHERE arm_index <= 5) USING (address_id) GROUP BY 1,2""")
def town_bundles(v):
    from placeproof.plans import belief
    b = sinks.town_bundles(v.address(), belief.static_stage(v), "2024-01-08", 7)
    # a left row without candidates holds one all-null entry
    n = F.size(F.filter("candidates", lambda c: c["arm"].isNotNull())).cast("long")
    return b.select("town_id", "address_id", n.alias("n_candidates"), "valid_until")


BUNDLE_DAYS = ["2024-01-08", "2024-02-05"]


def bundles(v, built):
    """The whole bundle of every town, as built on a day; the second build covers towns with an odd number only."""
    from placeproof import policy
    from placeproof.plans import belief
    keep = F.lit(True) if built == BUNDLE_DAYS[0] else F.regexp_extract("town_id", r"(\d+)$", 1).try_cast("int") % 2 == 1
    radius = [dict(zip(("stratum", "radius_m", "n_calibration", "measured_coverage", "publishable"), r)) for r in policy.RADIUS_TABLE]
    a = sinks.town_bundles(v.address().filter(keep), belief.static_stage(v), built)
    return sinks.bundle_parts(a, v.locality().filter(keep), v.landmark().filter(keep), radius, built)


@query("bundle_contents", """
SELECT town_id, 'address' AS part, count(*) AS n FROM w_address GROUP BY ALL UNION ALL SELECT town_id, 'locality', count(*) FROM w_locality GROUP BY ALL
UNION ALL SELECT town_id, 'landmark', count(*) FROM w_landmark GROUP BY ALL UNION ALL SELECT DISTINCT town_id, 'radius', 4::BIGINT FROM w_address""")
def bundle_contents(v):
    return bundles(v, BUNDLE_DAYS[0]).groupBy("town_id", "part").agg(F.count("*").alias("n"))


@query("bundle_staleness", """
SELECT town_id AS town, built, DATE '2024-02-10' - built AS age_days, built + 7 < DATE '2024-02-10' AS expired FROM (
 SELECT town_id, CASE WHEN try_cast(regexp_extract(town_id, '(\\d+)$', 1) AS INTEGER) % 2 = 1 THEN DATE '2024-02-05' ELSE DATE '2024-01-08' END AS built FROM (
  SELECT town_id FROM w_address UNION SELECT town_id FROM w_locality UNION SELECT town_id FROM w_landmark))""")
def bundle_staleness(v):
    """Bundles are written on two days and read back: age and expiry of each town's newest one."""
    from placeproof.session import work_path
    path = work_path(v.spark, "bundles")
    for built in BUNDLE_DAYS:
        sinks.write_bundles(bundles(v, built), path)
    at = F.lit("2024-02-10").cast("date")
    n = v.spark.read.parquet(path).groupBy("town_id").agg(F.max_by(F.struct("built", "valid_until"), "built").alias("b"))
    return n.select(F.col("town_id").alias("town"), F.col("b.built").alias("built"), F.datediff(at, "b.built").cast("long").alias("age_days"), (F.col("b.valid_until") < at).alias("expired"))
