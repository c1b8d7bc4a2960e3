"""Join jobs: equi, as-of, interval, distance, token and containment joins."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from placeproof import policy
from placeproof.catalog import query
from placeproof.catalog.oracle_domain import found_records
from placeproof.catalog.oracle_views import dist
from placeproof.functions import text
from placeproof.functions.geo import distance
from placeproof.operators import asof, pyramid, spatial, tokenjoin
from placeproof.operators.graph import place_blocks
from placeproof.plans import belief, candidates as cand
from placeproof.sources.stages import stage


@query("address_pin_town_chain", f"""
SELECT a.town_id, precision, count(*) AS n, round(avg({dist('geocoder_x','geocoder_y','tcx','tcy')}),2) AS mean_dist_to_town
FROM w_address a LEFT JOIN w_pin USING (address_id) LEFT JOIN w_towncent t ON t.town_id = a.town_id GROUP BY 1,2""")
def address_pin_town_chain(v):
    j = (v.address().select("address_id", "town_id").join(v.pin(), "address_id", "left")
         .join(cand.town_centroids(v.locality()), "town_id", "left"))
    return j.groupBy("town_id", "precision").agg(F.count("*").alias("n"), F.round(F.avg(
        distance(F.col("geocoder_x"), F.col("geocoder_y"), F.col("tcx"), F.col("tcy"))), 2)
        .alias("mean_dist_to_town"))


@query("surveyed_pin_inner", f"""
SELECT address_id, precision, address_type, round({dist('geocoder_x','geocoder_y','surveyed_x','surveyed_y')},2) AS err
FROM w_surveyed JOIN w_pin USING (address_id) JOIN w_address USING (address_id)""")
def surveyed_pin_inner(v):
    return (v.surveyed().join(v.pin(), "address_id")
            .join(v.address().select("address_id", "address_type"), "address_id")
            .select("address_id", "precision", "address_type", F.round(distance(
                F.col("geocoder_x"), F.col("geocoder_y"), F.col("surveyed_x"), F.col("surveyed_y")), 2).alias("err")))


@query("membership", """
SELECT count(*) FILTER (address_id IN (SELECT address_id FROM w_visit)) AS visited,
  count(*) FILTER (address_id NOT IN (SELECT address_id FROM w_visit)) AS never_visited,
  count(*) FILTER (address_id NOT IN (SELECT address_id FROM w_pin)) AS without_pin FROM w_address""")
def membership(v):
    a = v.address().select("address_id")
    seen = v.visit().select("address_id").distinct()
    def n(df, name):
        return df.agg(F.count("*").alias(name))
    semi, anti = a.join(seen, "address_id", "left_semi"), a.join(seen, "address_id", "left_anti")
    nopin = a.join(v.pin(), "address_id", "left_anti")
    return n(semi, "visited").crossJoin(n(anti, "never_visited")).crossJoin(n(nopin, "without_pin"))


CUTS = ["2024-01-05 00:00:00", "2024-01-12 00:00:00", "2024-01-20 00:00:00"]
CUT_SQL = "(VALUES " + ",".join(f"(TIMESTAMP '{c}')" for c in CUTS) + ") cuts(cut)"


@query("known_before_cuts", f"""
SELECT cut::VARCHAR AS cut, count(*) AS n, count(*) FILTER (outcome='met_family') AS met_family, max(epoch_us(observed_at)) AS newest_us
FROM w_visit JOIN {CUT_SQL} ON observed_at < cut GROUP BY 1""")
def known_before_cuts(v):
    met = (F.col("outcome") == "met_family").cast("long")
    got = asof.known_totals(v.visit(), asof.cut_table(v.spark, CUTS), {"n": F.lit(1).cast("long"), "met_family": met}, {"newest_us": F.unix_micros("observed_at")})
    return got.withColumn("cut", F.date_format("cut", "yyyy-MM-dd HH:mm:ss"))


def _asof_sql(op):
    return f"""
SELECT v.visit_id, p.visit_id AS prev_visit, p.outcome AS prev_outcome FROM w_visit v LEFT JOIN w_visit p ON p.address_id = v.address_id
 AND p.observed_at {op} v.observed_at AND p.outcome IN ('met_borrower','met_family','cash_collected')
QUALIFY row_number() OVER (PARTITION BY v.visit_id ORDER BY p.observed_at DESC NULLS LAST, p.visit_id DESC) = 1"""


def _asof(v, inclusive):
    log = v.visit().filter(F.col("outcome").isin(policy.POSITIVE_OUTCOMES)).select("address_id", "observed_at", F.col("visit_id").alias("prev_visit"),
                           F.col("outcome").alias("prev_outcome"))
    pts = v.visit().select("address_id", F.col("observed_at").alias("at"), "visit_id")
    return asof.latest_before(pts, log, ["address_id"], "at", "observed_at",
                              ["prev_visit", "prev_outcome"], ["prev_visit"], inclusive).select(
        "visit_id", "prev_visit", "prev_outcome")


@query("asof_latest_strictly_before", _asof_sql("<"))
def asof_strict(v):
    return _asof(v, False)


@query("asof_latest_inclusive", _asof_sql("<="))
def asof_inclusive(v):
    return _asof(v, True)


@query("close_pairs_30m", "SELECT zone, a, b, round(d,3) AS d FROM w_link")
def close_pairs_30m(v):
    return spatial.close_pairs(v.point(), "id", 30.0, ["zone"]).select(
        "zone", "a", "b", F.round("d", 3).alias("d"))


def blocks_stage(v):
    return stage(v, "place_blocks", lambda: place_blocks(v.point(), "id", 30.0, ["zone"]))


@query("radius_anchors", f"""
SELECT a.id, count(*) FILTER (b.id <> a.id) AS n_other, count(*) FILTER (b.block_id <> a.block_id) AS n_other_block
FROM w_block a JOIN w_block b ON a.zone=b.zone AND {dist('a.x','a.y','b.x','b.y')} <= 100 GROUP BY 1""")
def radius_anchors(v):
    """Anchors within 100 m: self excluded, and with the own block left out; counted, never paired."""
    p = v.point().join(blocks_stage(v), "id").select("zone", "id", "x", "y", "block_id")
    every = pyramid.count_within(p, p, 100.0, ["zone"])
    block = pyramid.count_within(p, p, 100.0, ["zone", "block_id"]).select("id", F.col("n").alias("own"))
    return every.join(block, "id").select("id", (F.col("n") - 1).alias("n_other"), (F.col("n") - F.col("own")).alias("n_other_block"))


@query("nearest_locality", f"""
SELECT address_id, locality_id, round({dist('geocoder_x','geocoder_y','cx','cy')},3) AS d FROM w_pin JOIN w_address USING (address_id) JOIN w_locality USING (town_id)
QUALIFY row_number() OVER (PARTITION BY address_id ORDER BY {dist('geocoder_x','geocoder_y','cx','cy')}, locality_id) = 1""")
def nearest_locality(v):
    left = v.pin().join(v.address().select("address_id", "town_id"), "address_id").select(
        "address_id", "town_id", F.col("geocoder_x").alias("x"), F.col("geocoder_y").alias("y"))
    right = v.locality().select("town_id", "locality_id", F.col("cx").alias("x2"), F.col("cy").alias("y2"))
    return spatial.nearest(left, right, "address_id", "locality_id", 600.0, ["town_id"]).select(
        "address_id", "locality_id", F.round("d", 3).alias("d"))


@query("split_proximity_leak", f"""
SELECT count(*) AS n_test, count(*) FILTER (d <= 30) AS within_30, count(*) FILTER (d <= 100) AS within_100 FROM (
 SELECT t.id, min({dist('t.x','t.y','r.x','r.y')}) AS d FROM w_xy t LEFT JOIN w_xy r ON r.zone=t.zone AND r.id%10 < 7 WHERE t.id%10 >= 8 GROUP BY 1)""")
def split_proximity_leak(v):
    p = v.point()
    test, train = p.filter("id % 10 >= 8"), p.filter("id % 10 < 7")
    hit = [pyramid.any_within(test, train, d, ["zone"]).select("id", F.lit(True).alias(f"w{int(d)}")) for d in (30.0, 100.0)]
    return test.select("id").join(hit[0], "id", "left").join(hit[1], "id", "left").agg(
        F.count("*").alias("n_test"), F.count("w30").alias("within_30"), F.count("w100").alias("within_100"))


@query("token_overlap", """
SELECT address_id, locality_id, count(*) AS shared FROM (SELECT address_id, town_id, unnest(list_distinct(toks)) AS token FROM w_addr)
JOIN (SELECT town_id, locality_id, unnest(ltoks) AS token FROM w_loc) USING (town_id, token) GROUP BY 1,2""")
def token_overlap(v):
    a = cand.prepared_addresses(v.address())
    loc = v.locality().withColumn("nt", text.tokens(text.norm_text(F.col("locality_name"))))
    return tokenjoin.overlap(
        tokenjoin.token_index(a, "address_id", "toks", ["town_id"]),
        tokenjoin.token_index(loc, "locality_id", "nt", ["town_id"]),
        "address_id", "locality_id", ["town_id"]).drop("town_id")


@query("name_containment", """
SELECT address_id, count(*) AS n_names, min(nm) AS first_name FROM w_address JOIN (
  SELECT DISTINCT town_id, regexp_replace(locality_name,' (nagar|colony)$','') AS nm FROM w_locality) USING (town_id)
WHERE contains(lower(address_text), nm) GROUP BY 1""")
def name_containment(v):
    names = v.locality().select("town_id", F.regexp_replace("locality_name", " (nagar|colony)$", "").alias("nm")).distinct()
    t = v.address().select("address_id", "town_id", F.lower("address_text").alias("low"))
    return tokenjoin.contains_join(t, names, "low", "nm", ["town_id"]).groupBy("address_id").agg(
        F.count("*").alias("n_names"), F.min("nm").alias("first_name"))


@query("address_book_match", "SELECT address_id, other FROM w_book")
def address_book_match(v):
    return cand.address_book_matches(cand.prepared_addresses(v.address()), v.pin())


DOC_SETS = """(SELECT s, min(doc_id) AS rep, count(*) AS copies FROM (SELECT doc_id, list_sort(list_distinct(string_split(
 trim(regexp_replace(regexp_replace(lower(text), '\\s*-\\s*\\d{6}\\s*$', ''), '[^0-9a-z\\x{0900}-\\x{0D7F}]+', ' ', 'g')),' '))) AS s FROM documents
 WHERE trim(regexp_replace(regexp_replace(lower(text), '\\s*-\\s*\\d{6}\\s*$', ''), '[^0-9a-z\\x{0900}-\\x{0D7F}]+', ' ', 'g')) <> '') GROUP BY s)"""


@query("near_duplicate_texts", f"""
SELECT a.rep AS rep_a, b.rep AS rep_b, a.copies AS copies_a, b.copies AS copies_b, len(list_intersect(a.s,b.s)) AS inter,
  round(len(list_intersect(a.s,b.s))/(len(a.s)+len(b.s)-len(list_intersect(a.s,b.s))),6) AS jaccard
FROM {DOC_SETS} a JOIN {DOC_SETS} b ON a.rep < b.rep AND len(a.s) >= 0.8*len(b.s) AND len(b.s) >= 0.8*len(a.s)
WHERE len(list_intersect(a.s,b.s))/(len(a.s)+len(b.s)-len(list_intersect(a.s,b.s))) >= 0.8
UNION ALL SELECT rep, rep, copies, copies, len(s), 1.0 FROM {DOC_SETS} WHERE copies > 1""")
def near_duplicate_texts(v):
    """Token-set near duplicates of whole texts.  A row relates two distinct token sets (or one set
    with itself when it has copies) and says how many texts carry each."""
    d = v.raw("documents").select("doc_id", F.filter(F.split(text.norm_scope(F.col("text")), " "),
                                                     lambda t: t != "").alias("toks"))
    pairs, groups, _ = tokenjoin.jaccard_pairs(d, "doc_id", "toks", 0.8)
    g = groups.select(F.col("rep"), "copies")
    across = (pairs.join(g.withColumnsRenamed({"rep": "ra", "copies": "copies_a"}), "ra")
              .join(g.withColumnsRenamed({"rep": "rb", "copies": "copies_b"}), "rb")
              .select(F.col("ra").alias("rep_a"), F.col("rb").alias("rep_b"), "copies_a", "copies_b",
                      F.col("inter").cast("long").alias("inter"), F.round("jaccard", 6).alias("jaccard")))
    same = groups.filter("copies > 1").select(
        F.col("rep").alias("rep_a"), F.col("rep").alias("rep_b"), F.col("copies").alias("copies_a"),
        F.col("copies").alias("copies_b"), F.col("n_tokens").cast("long").alias("inter"), F.lit(1.0).alias("jaccard"))
    return across.unionByName(same)


G3 = "list_sort(list_distinct(list_transform(range(1,length(norm)-1), lambda i: substr(norm,i,3))))"
C3_SETS = f"""(SELECT blk, g, min(address_id) AS rep, count(*) AS copies FROM (SELECT address_id,
 array_to_string(list_slice(string_split(norm,' '),1,3),' ') AS blk, {G3} AS g FROM w_addr) WHERE len(g) > 0 GROUP BY 1,2)"""


@query("near_duplicate_blocked", f"""
SELECT a.rep AS rep_a, b.rep AS rep_b, a.copies AS copies_a, b.copies AS copies_b, round(len(list_intersect(a.g,b.g))/len(list_distinct(list_concat(a.g,b.g))),6) AS jaccard,
 ta.town_id = tb.town_id AS same_town, regexp_replace(ta.norm,'[0-9]+','#','g') = regexp_replace(tb.norm,'[0-9]+','#','g') AS same_template
FROM {C3_SETS} a JOIN {C3_SETS} b ON a.blk=b.blk AND a.rep<b.rep JOIN w_addr ta ON ta.address_id=a.rep JOIN w_addr tb ON tb.address_id=b.rep
WHERE len(list_intersect(a.g,b.g))/len(list_distinct(list_concat(a.g,b.g))) >= 0.8""")
def near_duplicate_blocked(v):
    """3-gram near duplicates sharing the first three tokens; blocks of any size, no pair skipped."""
    a = v.address().withColumn("norm", text.norm_text(F.col("address_text")))
    grams = F.when(F.length("norm") < 3, F.array().cast("array<string>")).otherwise(F.transform(
        F.sequence(F.lit(1), F.length("norm") - 2), lambda i: F.substring("norm", i, F.lit(3))))
    d = a.select("address_id", F.array_join(F.slice(F.split("norm", " "), 1, 3), " ").alias("blk"),
                 grams.alias("g"))
    t = a.select("address_id", "town_id", F.regexp_replace("norm", "[0-9]+", "#").alias("tpl"))
    pairs, _, _ = tokenjoin.jaccard_pairs(d, "address_id", "g", 0.8, ["blk"], along=128, ends=t)
    return pairs.select(F.col("ra").alias("rep_a"), F.col("rb").alias("rep_b"), F.col("a_copies").alias("copies_a"), F.col("b_copies").alias("copies_b"),
                        F.round("jaccard", 6).alias("jaccard"), (F.col("a_town_id") == F.col("b_town_id")).alias("same_town"),
                        (F.col("a_tpl") == F.col("b_tpl")).alias("same_template"))


@query("payment_after_contact", """
SELECT c.account_id, count(*) AS n_pairs, round(sum(epoch_us(p.ts)-epoch_us(c.ts))/86400e6,4) AS gap_days, min(epoch_us(p.ts)-epoch_us(c.ts)) AS shortest_us
FROM (SELECT user_id AS account_id, ts FROM events WHERE event_type='click') c JOIN (SELECT user_id AS account_id, ts FROM events WHERE event_type='purchase') p
 USING (account_id) WHERE epoch_us(p.ts)-epoch_us(c.ts) BETWEEN 0 AND 7*86400000000 GROUP BY 1""")
def payment_after_contact(v):
    """Payments 0..7 days after a contact, summed per account without forming the pairs.

    Contacts are folded into running (count, sum, latest) on one time line; every payment reads them
    at its own instant and at instant - 7 d, each account being split by day.
    """
    e = v.raw("events").select(F.col("user_id").alias("account_id"), "event_id", "event_type",
                               F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    week, day = 7 * 86_400_000_000, 86_400_000_000
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    c = e.filter("event_type = 'click'").select(
        "account_id", "t", F.lit(0).alias("kind"), F.lit(1).cast("long").alias("n"),
        F.col("t").cast("decimal(30,0)").alias("s"), F.col("t").alias("last"), none.alias("pay"))
    p = e.filter("event_type = 'purchase'")
    z = zero.cast("decimal(30,0)")
    at = p.select("account_id", "t", F.lit(1).alias("kind"), zero.alias("n"), z.alias("s"), none.alias("last"), F.col("t").alias("pay"))
    ago = p.select("account_id", (F.col("t") - week).alias("t"), F.lit(-1).alias("kind"), zero.alias("n"), z.alias("s"), none.alias("last"), F.col("t").alias("pay"))
    line = c.unionByName(at).unionByName(ago).withColumn("b", F.floor(F.col("t") / day))
    tot = line.groupBy("account_id", "b").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max("last").alias("last"))
    wk = Window.partitionBy("account_id").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    prev = tot.select("account_id", "b", F.coalesce(F.sum("n").over(wk), zero).alias("pn"),
                      F.coalesce(F.sum("s").over(wk), z).alias("ps"), F.max("last").over(wk).alias("pl"))
    wb = Window.partitionBy("account_id", "b").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    q = (line.withColumn("cn", F.sum("n").over(wb)).withColumn("cs", F.sum("s").over(wb)).withColumn("cl", F.max("last").over(wb))
         .filter("kind <> 0").join(prev, ["account_id", "b"]))
    sign = F.col("kind")
    n = sign * (F.col("cn") + F.col("pn"))
    s = sign * (F.col("cs") + F.col("ps"))
    latest = F.when(F.col("kind") == 1, F.greatest("cl", "pl"))
    gap = F.when(F.col("pay") - latest <= week, F.col("pay") - latest)
    return (q.groupBy("account_id").agg(
        F.sum(n).alias("n_pairs"),
        F.round(F.sum(n * F.col("pay").cast("decimal(30,0)") - s).cast("double") / 86400e6, 4).alias("gap_days"),
        F.min(gap).alias("shortest_us")).filter("n_pairs > 0"))


QUERY_SQL = """(SELECT address_id AS qid, town_id, CASE address_id%4 WHEN 0 THEN address_text WHEN 1 THEN replace(address_text, ', ', ' ')
  WHEN 2 THEN address_text||' extra' ELSE 'somewhere in '||regexp_extract(address_text,'[a-z]+ [a-z]+') END AS qtext FROM w_address)"""


@query("record_lookup", f"SELECT * FROM {found_records(QUERY_SQL)}")
def record_lookup(v):
    """Typed text to record: exact form, else strong unambiguous token match, else area context."""
    from placeproof.plans.decision import find_records
    k, t = F.col("address_id"), F.col("address_text")
    q = v.address().select(
        F.col("address_id").alias("qid"), "town_id",
        F.when(k % 4 == 0, t).when(k % 4 == 1, F.replace(t, F.lit(", "), F.lit(" ")))
        .when(k % 4 == 2, F.concat(t, F.lit(" extra")))
        .otherwise(F.concat(F.lit("somewhere in "), F.regexp_extract(t, "[a-z]+ [a-z]+", 0))).alias("qtext"))
    return find_records(q, cand.prepared_addresses(v.address()), v.locality())


@query("block_neighbours_median", """
SELECT a.id, round(quantile_cont(b.x,0.5),3) AS mx, round(quantile_cont(b.y,0.5),3) AS my, count(*) AS n_others
FROM w_block a JOIN w_block b ON a.block_id=b.block_id AND a.id<>b.id GROUP BY 1""")
def block_neighbours_median(v):
    """Median point of the other block members, from order statistics of the whole block."""
    from placeproof.operators.leave_one_out import leave_one_out_median
    p = v.point().join(blocks_stage(v), "id").select("id", "block_id", "x", "y")
    x = leave_one_out_median(p, "block_id", "id", "x", "mx")
    y = leave_one_out_median(p, "block_id", "id", "y", "my").select("id", "my")
    return x.join(y, "id").select("id", F.round("mx", 3).alias("mx"), F.round("my", 3).alias("my"), "n_others")


@query("script_lexicon", """
SELECT town_id, foreign_token, latin_token, n, rk FROM (SELECT town_id, f AS foreign_token, l AS latin_token, count(*) AS n,
  row_number() OVER (PARTITION BY town_id, f ORDER BY count(*) DESC, l) AS rk FROM (
  SELECT address_id, town_id, f, unnest(list_filter(w, lambda t: regexp_matches(t,'^[a-z0-9]+$') AND NOT regexp_matches(t,'^[0-9]+$') AND length(t)>2)) AS l
  FROM (SELECT address_id, town_id, w, unnest(list_filter(w, lambda t: NOT regexp_matches(t,'^[a-z0-9]+$'))) AS f FROM (SELECT *, string_split(norm,' ') AS w FROM w_addr)))
 GROUP BY 1,2,3) WHERE rk <= 2""")
def script_lexicon(v):
    """Foreign-script token -> Latin tokens written beside it in the same town, top two."""
    w = F.split(text.norm_text(F.col("address_text")), " ")
    a = v.address().select("town_id", w.alias("w"))
    latin = F.filter("w", lambda t: t.rlike("^[a-z0-9]+$") & ~t.rlike("^[0-9]+$") & (F.length(t) > 2))
    other = F.filter("w", lambda t: ~t.rlike("^[a-z0-9]+$") & (t != ""))
    pairs = (a.select("town_id", F.explode(other).alias("foreign_token"), latin.alias("l"))
             .select("town_id", "foreign_token", F.explode("l").alias("latin_token"))
             .groupBy("town_id", "foreign_token", "latin_token").agg(F.count("*").alias("n")))
    rk = F.row_number().over(Window.partitionBy("town_id", "foreign_token").orderBy(F.col("n").desc(), "latin_token"))
    return pairs.withColumn("rk", rk.cast("long")).filter("rk <= 2")


@query("join_fanout", """
SELECT (SELECT count(*) FROM w_visit) AS rows_before, count(*) AS rows_after, count(*)/(SELECT count(*) FROM w_visit)::DOUBLE > 1 AS inflates
FROM w_visit LEFT JOIN w_trace USING (visit_id)""")
def join_fanout(v):
    """Row inflation of a naive join, from per-key counts (the join itself is never run)."""
    a = v.visit().groupBy("visit_id").agg(F.count("*").alias("na"))
    b = v.trace().groupBy("visit_id").agg(F.count("*").alias("nb"))
    j = a.join(b, "visit_id", "left")
    return j.agg(F.sum("na").alias("rows_before"),
                 F.sum(F.col("na") * F.coalesce("nb", F.lit(1))).alias("rows_after")).withColumn(
        "inflates", F.col("rows_after") > F.col("rows_before"))


@query("shared_key_exposure", """
SELECT n_accounts > 1 AS shared, count(*) AS n, round(avg((outcome IN ('met_borrower','met_family','cash_collected'))::INTEGER),6) AS met_rate FROM w_visit
JOIN (SELECT photo_hash, count(DISTINCT account_id) AS n_accounts FROM w_visit WHERE photo_hash IS NOT NULL GROUP BY 1) USING (photo_hash) GROUP BY 1""")
def shared_key_exposure(v):
    vis = v.visit().filter("photo_hash is not null")
    n = vis.groupBy("photo_hash").agg(F.count_distinct("account_id").alias("n_accounts"))
    return (vis.join(n, "photo_hash").groupBy((F.col("n_accounts") > 1).alias("shared")).agg(
        F.count("*").alias("n"), F.round(F.avg(F.col("outcome").isin(policy.POSITIVE_OUTCOMES).cast("int")), 6).alias("met_rate")))


@query("place_blocks", "SELECT id, block_id FROM w_block")
def place_blocks_query(v):
    return blocks_stage(v)


@query("same_account_distances", f"""
SELECT a.account_id, a.address_id AS a, b.address_id AS b, round({dist('a.geocoder_x','a.geocoder_y','b.geocoder_x','b.geocoder_y')},2) AS d
FROM (SELECT address_id//2 AS account_id, * FROM w_pin) a JOIN (SELECT address_id//2 AS account_id, * FROM w_pin) b
 ON a.account_id=b.account_id AND a.address_id<b.address_id""")
def same_account_distances(v):
    p = v.pin().withColumn("account_id", F.floor(F.col("address_id") / 2))
    a = p.select("account_id", F.col("address_id").alias("a"), "geocoder_x", "geocoder_y")
    b = p.select("account_id", F.col("address_id").alias("b"), F.col("geocoder_x").alias("x2"), F.col("geocoder_y").alias("y2"))
    return a.join(b, "account_id").filter("a < b").select("account_id", "a", "b", F.round(distance(
        F.col("geocoder_x"), F.col("geocoder_y"), F.col("x2"), F.col("y2")), 2).alias("d"))
