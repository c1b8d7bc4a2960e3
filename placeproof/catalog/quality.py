"""Sources, profiling and data quality jobs."""
from pyspark.sql import functions as F

from placeproof import policy
from placeproof.catalog import query
from placeproof.functions import text
from placeproof.operators import profile
from placeproof.operators.tokenjoin import contains_join
from placeproof.operators.profile import union_all

TABLE_KEYS = {"region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"],
              "supplier": ["s_suppkey"], "part": ["p_partkey"], "orders": ["o_orderkey"],
              "lineitem": ["l_orderkey", "l_linenumber"], "labels": ["doc_id"],
              "benchmark": ["item_id"], "conversations": ["conv_id", "turn"],
              "pages": ["page_id"], "documents": ["doc_id"], "events": ["event_id"], "embeddings": ["vec_id"]}
COLUMNS = {
    "region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate",
               "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                 "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
                 "l_shipdate"],
    "labels": ["doc_id", "quality", "toxic"], "benchmark": ["item_id", "text"],
    "conversations": ["conv_id", "turn", "role", "text"], "pages": ["page_id", "url", "html"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "embeddings": ["vec_id", "embedding", "label"]}


@query("source_address", "SELECT address_id, account_id, town_id, address_type, added_date::VARCHAR AS added_date, address_text FROM w_address")
def source_address(v):
    return v.address().withColumn("added_date", F.col("added_date").cast("string"))


@query("source_locality", "SELECT * FROM w_locality")
def source_locality(v):
    return v.locality()


@query("source_landmark", "SELECT * FROM w_landmark")
def source_landmark(v):
    return v.landmark()


@query("source_pin", "SELECT * FROM w_pin")
def source_pin(v):
    return v.pin()


@query("source_town", "SELECT * FROM w_town")
def source_town(v):
    return v.town()


@query("source_visit", """
SELECT visit_id, address_id, account_id, agent_id, epoch_us(start_ts) AS start_us, epoch_us(observed_at) AS observed_us,
  gps_accuracy_m, dwell_s, outcome, photo_hash, remark FROM w_visit""")
def source_visit(v):
    return v.visit().select(
        "visit_id", "address_id", "account_id", "agent_id",
        F.unix_micros("start_ts").alias("start_us"),
        F.unix_micros("observed_at").alias("observed_us"), "gps_accuracy_m", "dwell_s", "outcome",
        "photo_hash", "remark")


@query("source_surveyed_split", """
SELECT address_id, surveyed_x, surveyed_y, split FROM w_surveyed JOIN w_split ON account_id = address_id//2""")
def source_surveyed_split(v):
    s = v.surveyed().withColumn("account_id", F.floor(F.col("address_id") / 2))
    return s.join(v.split(), "account_id").drop("account_id")


@query("source_key_violations", """
SELECT 'address' AS table_name, count(*) AS n_keys FROM (SELECT address_id FROM w_address GROUP BY 1 HAVING count(*)>1)
UNION ALL SELECT 'trace', count(*) FROM (SELECT visit_id, raw_seq FROM w_trace GROUP BY 1,2 HAVING count(*)>1)""")
def source_key_violations(v):
    from placeproof.sources.tables import duplicate_keys
    return union_all([
        duplicate_keys(df, keys).agg(F.lit(n).alias("table_name"), F.count("*").alias("n_keys"))
        for n, df, keys in (("address", v.address(), ["address_id"]),
                            ("trace", v.trace(), ["visit_id", "raw_seq"]))])


@query("trace_arrays", """
SELECT visit_id, raw_seq // 10000 AS chunk, count(*) AS n_fixes,
  string_agg(seq||':'||dx||':'||dy, '|' ORDER BY seq, dx, dy) AS fixes FROM w_trace GROUP BY 1, 2""")
def trace_arrays(v):
    """Ordered fixes per visit, cut into chunks of sequence numbers so an array stays bounded."""
    t = v.trace().withColumn("chunk", F.floor(F.col("raw_seq") / 10000))
    return t.groupBy("visit_id", "chunk").agg(
        F.count("*").alias("n_fixes"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "dx", "dy"))),
                                 lambda p: F.concat_ws(":", p["seq"], p["dx"], p["dy"])), "|")
        .alias("fixes"))


@query("trace_arrays_hardened", """
WITH r AS (SELECT visit_id, CASE WHEN visit_id % 17 = 3 THEN 'n/a' ELSE seq::VARCHAR END AS seq, CASE WHEN (visit_id + raw_seq) % 13 = 5 THEN '' ELSE dx::VARCHAR END AS x,
  dy::VARCHAR || CASE WHEN (visit_id + raw_seq) % 19 = 2 THEN 'm' ELSE '' END AS y, CASE WHEN raw_seq % 3 = 2 THEN 'unknown' ELSE accuracy_m::VARCHAR END AS acc, raw_seq FROM w_trace),
c AS (SELECT visit_id, try_cast(seq AS BIGINT) AS seq, try_cast(x AS DOUBLE) AS x, try_cast(y AS DOUBLE) AS y, try_cast(acc AS DOUBLE) AS acc FROM r)
SELECT visit_id, count(*) AS n_fixes, count(acc) AS n_accuracy, string_agg(seq||':'||x::BIGINT||':'||y::BIGINT||':'||coalesce((acc::BIGINT)::VARCHAR, '-'), '|' ORDER BY seq, x, y, acc NULLS FIRST) AS fixes
FROM c WHERE seq IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL GROUP BY 1""")
def trace_arrays_hardened(v):
    """Traces from text cells, some of them damaged: bad numbers drop the fix, a bad accuracy only itself."""
    from placeproof.sources.tables import hardened_fixes
    t, k, s = v.trace(), F.col("visit_id"), F.col("raw_seq")
    raw = t.select("visit_id", F.when(k % 17 == 3, "n/a").otherwise(F.col("seq").cast("string")).alias("seq"), F.when((k + s) % 13 == 5, "").otherwise(F.col("dx").cast("string")).alias("x"),
                   F.concat(F.col("dy").cast("string"), F.when((k + s) % 19 == 2, "m").otherwise("")).alias("y"), F.when(s % 3 == 2, "unknown").otherwise(F.col("accuracy_m").cast("string")).alias("accuracy_m"))
    p = F.sort_array(F.collect_list(F.struct("seq", "x", "y", "accuracy_m")))
    show = lambda q: F.concat_ws(":", q["seq"], q["x"].cast("long"), q["y"].cast("long"), F.coalesce(q["accuracy_m"].cast("long").cast("string"), F.lit("-")))
    return hardened_fixes(raw).groupBy("visit_id").agg(F.count("*").alias("n_fixes"), F.count("accuracy_m").alias("n_accuracy"), F.array_join(F.transform(p, show), "|").alias("fixes"))


@query("snapshot_counts", "\nUNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in TABLE_KEYS))
def snapshot_counts(v):
    return union_all([v.raw(t).agg(F.lit(t).alias("table_name"), F.count("*").alias("n_rows"))
                      for t in TABLE_KEYS])


def _table_profile_sql(t, keys):
    cols = COLUMNS[t]
    nulls = "+".join(f"({c} IS NULL)::INTEGER" for c in cols)
    return (f"SELECT '{t}' AS table_name, count(*) AS n_rows, {len(cols)}::BIGINT AS n_cols, "
            f"count(*) = (SELECT count(*) FROM (SELECT DISTINCT {','.join(keys)} FROM {t})) AS key_unique, "
            f"count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {t})) AS full_duplicates, "
            f"round(100.0*sum({nulls})/(count(*)*{len(cols)}),3) AS null_pct FROM {t}")


PROFILED = list(TABLE_KEYS)


@query("table_profile", "\nUNION ALL ".join(_table_profile_sql(t, TABLE_KEYS[t]) for t in PROFILED))
def table_profile(v):
    return union_all([profile.table_profile(v.raw(t), t, TABLE_KEYS[t]) for t in PROFILED])


TEXTS = {"r_name", "n_name", "c_name", "c_mktsegment", "s_name", "p_name", "p_brand", "p_type", "o_orderstatus", "o_orderpriority", "l_returnflag", "l_linestatus",
         "text", "role", "url", "html", "lang", "source", "event_type", "props"}
DOUBLES = {"c_acctbal", "s_acctbal", "p_retailprice", "o_totalprice", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "value"}
TIMES = {"o_orderdate", "l_shipdate", "ts"}


def _column_profile_sql(t):
    parts = []
    for c in COLUMNS[t]:
        s = (f"{c}::DECIMAL(20,4)::VARCHAR" if c in DOUBLES else f"strftime({c}, '%Y-%m-%d %H:%M:%S')" if c in TIMES
             else f"len({c})||' values'" if c == "embedding" else f"left({c}::VARCHAR, 40)")
        d = "NULL::DOUBLE" if c in TEXTS | TIMES | {"embedding"} else f"{c}::DOUBLE"
        parts.append(
            f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS n_rows, count(*)-count({c}) AS n_null, "
            f"count(DISTINCT {c}) AS n_distinct, min({d}) AS min_value, max({d}) AS max_value, round(avg({d}),3) AS mean_value, "
            f"(SELECT string_agg(val||':'||n, '|' ORDER BY n DESC, val) FROM (SELECT {s} AS val, n FROM (SELECT {c}, count(*) AS n FROM {t} WHERE {c} IS NOT NULL "
            f"GROUP BY 1) ORDER BY n DESC, val LIMIT 3)) AS top_values, round(100.0*count(DISTINCT {c})/count(*),3) AS pct_unique FROM {t}")
    return "\nUNION ALL ".join(parts)


COLUMN_SQL = "\nUNION ALL ".join(_column_profile_sql(t) for t in PROFILED)


def _columns(v):
    return union_all([profile.column_profile(v.raw(t)).withColumn("table_name", F.lit(t)) for t in PROFILED])


@query("column_profile", COLUMN_SQL)
def column_profile(v):
    return _columns(v)


@query("constant_columns", f"""
SELECT table_name, column_name, n_distinct <= 1 AS is_constant,
  try_cast(regexp_extract(top_values, '(?s)^.{{0,60}}?:(\\d+)(\\||$)', 1) AS BIGINT) / n_rows >= 0.99 AS is_near_constant, pct_unique >= 90 AS is_id_like
FROM ({COLUMN_SQL})""")
def constant_columns(v):
    return union_all([profile.constant_flags(profile.column_profile(v.raw(t)))
                      .withColumn("table_name", F.lit(t)) for t in PROFILED])


LINKS = [("visit->address", "events", "user_id", "customer", "c_custkey"),
         ("trace->visit", "lineitem", "l_orderkey", "events", "event_id"),
         ("order->customer", "orders", "o_custkey", "customer", "c_custkey"),
         ("address->town", "customer", "c_nationkey", "nation", "n_nationkey"),
         ("label->document", "labels", "doc_id", "documents", "doc_id")]


def _link_sql(n, c, cc, p, pc):
    return (f"SELECT '{n}' AS relation, count(*) FILTER (np IS NULL) AS orphan_child_keys, "
            f"coalesce(sum(nc) FILTER (np IS NULL),0)::BIGINT AS orphan_child_rows, "
            f"count(*) FILTER (nc IS NULL) AS parents_without_child, "
            f"count(*) FILTER (np IS NOT NULL AND nc > 1) AS parents_with_many, "
            f"max(nc) FILTER (np IS NOT NULL) AS max_per_parent FROM (SELECT {cc} AS k, count(*) AS nc FROM {c} "
            f"WHERE {cc} IS NOT NULL GROUP BY 1) a FULL JOIN (SELECT {pc} AS k, count(*) AS np FROM {p} GROUP BY 1) b USING (k)")


@query("foreign_key_orphans", "\nUNION ALL ".join(_link_sql(*x) for x in LINKS))
def foreign_key_orphans(v):
    """Orphans both ways plus the coverage counts (none, many, most per parent)."""
    return union_all([profile.key_links(v.raw(c), cc, v.raw(p), pc, n) for n, c, cc, p, pc in LINKS])


@query("coverage_by_parent", """
SELECT count(*) FILTER (n = 0) AS without_visit, count(*) FILTER (n = 1) AS with_one, count(*) FILTER (n > 1) AS with_many,
  max(n) AS most FROM (SELECT c_custkey, count(user_id) AS n FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY 1)""")
def coverage_by_parent(v):
    n = v.raw("events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.count("*").alias("n"))
    j = v.raw("customer").select("c_custkey").join(n, "c_custkey", "left").withColumn(
        "n", F.coalesce("n", F.lit(0)))
    return j.agg(F.count_if(F.col("n") == 0).alias("without_visit"),
                 F.count_if(F.col("n") == 1).alias("with_one"),
                 F.count_if(F.col("n") > 1).alias("with_many"), F.max("n").alias("most"))


@query("composite_key_duplicates", """
SELECT n AS rows_per_key, count(*) AS n_keys FROM (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1,2)
WHERE n > 1 GROUP BY 1""")
def composite_key_duplicates(v):
    return (v.raw("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
            .filter("n > 1").groupBy(F.col("n").alias("rows_per_key"))
            .agg(F.count("*").alias("n_keys")))


COORDS = [("pin", "geocoder_x", "geocoder_y"), ("locality", "cx", "cy"), ("landmark", "px", "py"),
          ("trace", "dx", "dy")]


@query("coordinate_ranges", "\nUNION ALL ".join(
    f"SELECT '{t}' AS table_name, min({x})::DOUBLE AS x_min, max({x})::DOUBLE AS x_max, min({y})::DOUBLE AS y_min, "
    f"max({y})::DOUBLE AS y_max, count(*) FILTER ({x} = 0 OR {y} = 0) AS n_zero, count(*) FILTER ({x} IS NULL OR {y} IS NULL) AS n_null "
    f"FROM w_{t}" for t, x, y in COORDS))
def coordinate_ranges(v):
    return union_all([getattr(v, t)().agg(
        F.lit(t).alias("table_name"), F.min(x).cast("double").alias("x_min"),
        F.max(x).cast("double").alias("x_max"), F.min(y).cast("double").alias("y_min"),
        F.max(y).cast("double").alias("y_max"),
        F.count_if((F.col(x) == 0) | (F.col(y) == 0)).alias("n_zero"),
        F.count_if(F.col(x).isNull() | F.col(y).isNull()).alias("n_null")) for t, x, y in COORDS])


DIGITS = [(t, c) for t, x, y in COORDS if t != "trace" for c in (x, y)]


@query("decimal_precision", f"""
WITH d AS ({' UNION ALL '.join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, length(rtrim(split_part({c}::DECIMAL(20,6)::VARCHAR,'.',2),'0')) AS digits FROM w_{t} WHERE {c} IS NOT NULL" for t, c in DIGITS)})
SELECT table_name, column_name, digits, count(*) AS n, any_value(m) AS median_digits FROM d JOIN (SELECT table_name, column_name, quantile_cont(digits, 0.5)::DOUBLE AS m FROM d GROUP BY ALL) USING (table_name, column_name) GROUP BY 1,2,3""")
def decimal_precision(v):
    """Decimal digits of each coordinate column: counts per number of digits, and their median."""
    def one(t, c):
        s = F.col(c).cast("decimal(20,6)").cast("string")
        d = F.length(F.rtrim(F.split_part(s, F.lit("."), F.lit(2)), F.lit("0"))).cast("long")
        return getattr(v, t)().filter(F.col(c).isNotNull()).groupBy(d.alias("digits")).agg(F.count("*").alias("n")).select(
            F.lit(t).alias("table_name"), F.lit(c).alias("column_name"), "digits", "n")
    counts = union_all([one(t, c) for t, c in DIGITS])
    # at most seven rows per column from here
    m = counts.groupBy("table_name", "column_name").agg(F.percentile("digits", 0.5, F.col("n")).alias("median_digits"))
    return counts.join(m, ["table_name", "column_name"])


@query("duplicate_point_piles", """
SELECT count(*) AS n_points, max(n) AS largest_pile, count(*) FILTER (n >= 10) AS piles_ge_10,
  round(sum(n) FILTER (n > 1) / sum(n), 6) AS share_in_piles FROM (SELECT dx, dy, count(*) AS n FROM w_trace GROUP BY 1,2)""")
def duplicate_point_piles(v):
    n = v.trace().groupBy("dx", "dy").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("n_points"), F.max("n").alias("largest_pile"),
                 F.count_if(F.col("n") >= 10).alias("piles_ge_10"),
                 F.round(F.sum(F.when(F.col("n") > 1, F.col("n"))) / F.sum("n"), 6)
                 .alias("share_in_piles"))


RULES = [("dwell_under_60s", "dwell_s < 60", "flag"), ("dwell_over_2h", "dwell_s > 7200", "flag"),
         ("accuracy_over_50m", "gps_accuracy_m > 50", "down-weight"),
         ("accuracy_missing", "gps_accuracy_m IS NULL", "down-weight"),
         ("negative_travel", "start_ts > observed_at", "flag"),
         ("no_photo", "photo_hash IS NULL", "keep"), ("empty_remark", "remark = ''", "keep")]


@query("outlier_rules", "\nUNION ALL ".join(
    f"SELECT '{n}' AS rule, count(*) FILTER ({c}) AS n_rows, '{d}' AS disposition FROM w_visit"
    for n, c, d in RULES))
def outlier_rules(v):
    """All rules in one pass: the counts are one aggregate row, unpivoted afterwards."""
    one = v.visit().agg(*[F.count_if(F.expr(c)).alias(n) for n, c, _ in RULES])
    return one.select(F.explode(F.array(*[F.struct(
        F.lit(n).alias("rule"), F.col(n).alias("n_rows"), F.lit(d).alias("disposition"))
        for n, _, d in RULES])).alias("r")).select("r.*")


MISSING = [("photo_hash", "not_captured"), ("gps_accuracy_m", "device_gap"),
           ("dwell_s", "device_gap"), ("remark", "structural"), ("start_ts", "device_gap"), ("outcome", "required"),
           ("agent_id", "required"), ("address_id", "required"), ("observed_at", "required")]


@query("missingness_by_class", "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{k}' AS missing_class, round(avg(({c} IS NULL)::INTEGER),6) AS null_rate FROM w_visit"
    for c, k in MISSING))
def missingness_by_class(v):
    rates = v.visit().agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c, _ in MISSING])
    long = rates.select(F.explode(F.array(*[F.struct(
        F.lit(c).alias("column_name"), F.round(F.col(c), 6).alias("null_rate"))
        for c, _ in MISSING])).alias("r")).select("r.*")
    classes = v.spark.createDataFrame(MISSING, "column_name string, missing_class string")
    return long.join(F.broadcast(classes), "column_name", "left").select(
        "column_name", "missing_class", "null_rate")


@query("parent_child_conflicts", """
SELECT count(*) AS n_addresses, count(*) FILTER (a.town_id IS DISTINCT FROM b.town_id) AS town_differs_from_first
FROM w_address a JOIN (SELECT account_id, min_by(town_id, address_id) AS town_id FROM w_address GROUP BY 1) b USING (account_id)""")
def parent_child_conflicts(v):
    a = v.address()
    parent = a.groupBy("account_id").agg(F.min_by("town_id", "address_id").alias("account_town"))
    return a.join(parent, "account_id").agg(
        F.count("*").alias("n_addresses"),
        F.count_if(~F.col("town_id").eqNullSafe(F.col("account_town")))
        .alias("town_differs_from_first"))


@query("cleaning_log", """
SELECT 'trace' AS table_name, 'drop_axis_artefacts' AS rule, count(*) AS rows_in, count(*) FILTER (dx<>0 AND dy<>0) AS rows_out,
  count(*) FILTER (dx=0 OR dy=0) AS dropped FROM w_trace
UNION ALL SELECT 'address', 'drop_empty_text', count(*), count(*) FILTER (norm <> ''), count(*) FILTER (norm = '') FROM w_addr
UNION ALL SELECT 'address', 'normalise_text', count(*), count(*) FILTER (norm = address_text), count(*) FILTER (norm <> address_text) FROM w_addr
UNION ALL SELECT 'visit', 'drop_without_position', count(*), count(*) FILTER (checkin_x IS NOT NULL AND checkin_y IS NOT NULL), count(*) FILTER (checkin_x IS NULL OR checkin_y IS NULL) FROM w_checkin""")
def cleaning_log(v):
    """Per rule: rows in, out (unchanged) and dropped (or changed), each from one counting pass."""
    def log(df, table, rule, keep):
        return df.agg(F.lit(table).alias("table_name"), F.lit(rule).alias("rule"),
                      F.count("*").alias("rows_in"), F.count_if(keep).alias("rows_out"),
                      F.count_if(~keep).alias("dropped"))
    addr = v.address().withColumn("norm", text.norm_text(F.col("address_text")))
    return union_all([
        log(v.trace(), "trace", "drop_axis_artefacts", (F.col("dx") != 0) & (F.col("dy") != 0)),
        log(addr, "address", "drop_empty_text", F.col("norm") != ""),
        log(addr, "address", "normalise_text", F.col("norm") == F.col("address_text")),
        log(v.checkin(), "visit", "drop_without_position", F.col("checkin_x").isNotNull() & F.col("checkin_y").isNotNull())])


@query("contract_violations", """
SELECT 'as_of_valid_iff_evidence' AS rule, count(*) FILTER ((arm IN ('field_evidence','memory')) <> (valid IS NOT NULL)) AS violations FROM (SELECT c.arm, coalesce(p.observed_at, k.last_at) AS valid
 FROM w_cand c LEFT JOIN w_pos p ON p.address_id = c.address_id AND c.source_ref = 'visit:'||p.observation_id LEFT JOIN w_cons k ON k.address_id = c.address_id AND c.source_ref = 'visits:median('||k.n||')') UNION ALL
SELECT 'arm_vocabulary', count(*) FILTER (arm NOT IN ('frozen_baseline','locality_centroid','town_centroid','official_landmark','address_book','field_evidence','memory')) FROM w_cand UNION ALL
SELECT 'granularity_vocabulary', count(*) FILTER (granularity NOT IN ('rooftop','street','locality','town')) FROM w_cand UNION ALL
SELECT 'weight_in_unit_interval', count(*) FILTER (weight < 0 OR weight > 1) FROM w_ev UNION ALL
SELECT 'negatives_have_zero_weight', count(*) FILTER (polarity = 'negative' AND weight <> 0) FROM w_ev""")
def contract_violations(v):
    """Data-contract assertions; every count must be zero."""
    from placeproof.catalog.oracle_domain import AS_OF
    from placeproof.plans import belief, candidates
    c = candidates.exploded(belief.bare_sets(v, AS_OF))
    e = belief.evidence_stage(v)
    ev_arm = F.col("arm").isin(policy.EVIDENCE_ARMS)
    def rule(df, name, bad):
        return df.agg(F.lit(name).alias("rule"), F.count_if(bad).alias("violations"))
    return union_all([
        rule(c, "as_of_valid_iff_evidence", ev_arm != F.col("as_of_valid").isNotNull()),
        rule(c, "arm_vocabulary", ~F.col("arm").isin(policy.ARMS)),
        rule(c, "granularity_vocabulary", ~F.col("granularity").isin(list(policy.GRANULARITY_RANK))),
        rule(e, "weight_in_unit_interval", (F.col("weight") < 0) | (F.col("weight") > 1)),
        rule(e, "negatives_have_zero_weight", (F.col("polarity") == "negative") & (F.col("weight") != 0))])


LATE = ["outcome", "dwell_s", "gps_accuracy_m", "photo_hash", "remark", "address_text", "address_type", "town_id", "precision", "geocoder_x"]
LATE_TIERS = "('outcome','T3'),('dwell_s','T2'),('gps_accuracy_m','T2'),('photo_hash','T2'),('remark','T3'),('address_text','T0'),('address_type','T0'),('town_id','T0'),('precision','T0'),('geocoder_x','T0')"


@query("late_columns", f"""
SELECT column_name, n_rows, tier, tier NOT IN ('T0','T1') AS rejected FROM (VALUES {LATE_TIERS}) t(column_name, tier) JOIN (
 {' UNION ALL '.join(f"SELECT '{c}' AS column_name, count({c}) AS n_rows FROM w_visit JOIN (SELECT address_id, address_text, address_type, town_id FROM w_address) USING (address_id) LEFT JOIN (SELECT address_id, precision, geocoder_x FROM w_pin) USING (address_id)" for c in LATE)}) USING (column_name)""")
def late_columns(v):
    """Columns of the joined visit table, filled rows, and whether they come too late for a decision
    (tier above T1 or unknown).  Names are the schema's; the rows are read once, for the counts."""
    used = (v.visit().join(v.address().select("address_id", "address_text", "address_type", "town_id"), "address_id")
            .join(v.pin().select("address_id", "precision", "geocoder_x"), "address_id", "left").select(*LATE))
    counts = used.agg(*[F.count(c).alias(c) for c in used.columns])
    tier = F.create_map(*[F.lit(x) for pair in policy.COLUMN_TIERS.items() for x in pair])
    rows = counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_rows")) for c in used.columns])).alias("r")).select("r.*")
    return rows.withColumn("tier", tier[F.col("column_name")]).withColumn("rejected", ~F.coalesce(F.col("tier").isin("T0", "T1"), F.lit(False)))


@query("quality_scorecard", f"""
SELECT table_name, n_rows, null_pct, full_duplicates, CASE WHEN NOT key_unique THEN 'review' WHEN full_duplicates > 0 THEN 'dedupe' ELSE 'ok' END AS verdict
FROM ({chr(10).join(['']) + ' UNION ALL '.join(_table_profile_sql(t, TABLE_KEYS[t]) for t in PROFILED)})""")
def quality_scorecard(v):
    p = table_profile(v)
    return p.select("table_name", "n_rows", "null_pct", "full_duplicates",
                    F.when(~F.col("key_unique"), "review").when(F.col("full_duplicates") > 0, "dedupe")
                    .otherwise("ok").alias("verdict"))


@query("remark_profile", """
SELECT outcome, count(*) AS n, avg((trim(remark)='')::INTEGER) AS empty_rate, round(avg(regexp_matches(remark,'[0-9]')::INTEGER),6) AS digit_rate,
  round(avg(regexp_matches(remark,'[\\x{0900}-\\x{0D7F}]')::INTEGER),6) AS indic_rate,
  round(avg(regexp_matches(lower(remark),'shift|moved|kalla|badal')::INTEGER),6) AS relocation_rate,
  round(avg(names_place::INTEGER),6) AS place_rate
FROM (SELECT v.*, EXISTS (SELECT 1 FROM (SELECT DISTINCT lower(p_name) AS nm FROM part UNION SELECT DISTINCT lower(p_type||' '||p_brand) FROM part)
   WHERE contains(lower(remark), nm)) AS names_place FROM w_visit v) GROUP BY outcome""")
def remark_profile(v):
    """Remarks are folded to distinct texts before any containment test."""
    p = v.raw("part")
    names = (p.select(F.lower("p_name").alias("nm")).union(
        p.select(F.lower(F.concat_ws(" ", "p_type", "p_brand")).alias("nm"))).distinct())
    r = v.visit().groupBy("outcome", "remark").agg(F.count("*").alias("n"))
    texts = r.select("remark").distinct()
    named = (contains_join(texts.withColumn("low", F.lower("remark")), names, "low", "nm")
             .select("remark").distinct().withColumn("named", F.lit(1)))
    low = F.lower("remark")
    t = r.join(named, "remark", "left").withColumn("named", F.coalesce("named", F.lit(0)))
    def rate(c):
        return F.round(F.sum(c.cast("int") * F.col("n")) / F.sum("n"), 6)
    return t.groupBy("outcome").agg(
        F.sum("n").alias("n"),
        (F.sum((F.trim("remark") == "").cast("int") * F.col("n")) / F.sum("n")).alias("empty_rate"),
        rate(F.col("remark").rlike("[0-9]")).alias("digit_rate"),
        rate(F.col("remark").rlike(r"[\x{0900}-\x{0D7F}]")).alias("indic_rate"),
        rate(low.rlike("shift|moved|kalla|badal")).alias("relocation_rate"),
        rate(F.col("named") == 1).alias("place_rate"))


@query("lender_style", """
SELECT CASE WHEN address_id%3=0 THEN 'structured' WHEN address_id%3=1 THEN 'free' ELSE 'legacy' END AS style, count(*) AS n,
  round(avg(regexp_matches(address_text,'[^\\x00-\\x7F]')::INTEGER),6) AS non_ascii_rate,
  round(avg(regexp_matches(address_text,'-\\s*\\d{6}\\s*$')::INTEGER),6) AS pin_tail_rate,
  round(avg(regexp_matches(address_text,'(?i)\\b(house|plot|door|flat|no\\.?|#)\\b')::INTEGER),6) AS house_rate,
  quantile_cont(length(address_text),0.5) AS median_len FROM w_address GROUP BY 1""")
def lender_style(v):
    k, t = F.col("address_id"), F.col("address_text")
    style = F.when(k % 3 == 0, "structured").when(k % 3 == 1, "free").otherwise("legacy")
    return v.address().groupBy(style.alias("style")).agg(
        F.count("*").alias("n"),
        F.round(F.avg(t.rlike(r"[^\x00-\x7F]").cast("int")), 6).alias("non_ascii_rate"),
        F.round(F.avg(t.rlike(r"-\s*\d{6}\s*$").cast("int")), 6).alias("pin_tail_rate"),
        F.round(F.avg(t.rlike(r"(?i)\b(house|plot|door|flat|no\.?|#)\b").cast("int")), 6)
        .alias("house_rate"),
        # text length is a small integer domain, so the exact percentile buffer stays tiny
        F.percentile(F.length(t), 0.5).alias("median_len"))
