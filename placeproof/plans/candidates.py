"""Candidate positions: one union of arms for all addresses, then set-level annotation.

Every arm is keyed by address, so one shuffle by address_id gathers the (small) candidate set; the
plausibility, agreement, feature and rank steps are array expressions on that set.
"""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeproof import policy
from placeproof.functions import geo, text
from placeproof.functions.digest import candidate_id
from placeproof.operators.tokenjoin import overlap, token_index
from placeproof.plans import evidence
from placeproof.policy import BASE, Policy
from placeproof.session import checkpoint

COLUMNS = ["address_id", "arm", "source_ref", "x", "y", "granularity", "arm_rank", "stratum",
           "baseline_precision", "primary_eligible", "ambiguous", "as_of_valid"]


def _arm(df: DataFrame, arm: str, source_ref: Column, x: Column, y: Column, granularity: Column,
         stratum: Column, arm_rank: Column | None = None, precision: Column | None = None,
         eligible: Column | None = None, ambiguous: Column | None = None,
         valid: Column | None = None) -> DataFrame:
    return df.select(
        "address_id", F.lit(arm).alias("arm"), source_ref.alias("source_ref"),
        F.round(x, 3).alias("x"), F.round(y, 3).alias("y"), granularity.alias("granularity"),
        (F.lit(1) if arm_rank is None else arm_rank).cast("int").alias("arm_rank"),
        stratum.alias("stratum"),
        (F.lit(None) if precision is None else precision).cast("string")
        .alias("baseline_precision"),
        (F.lit(None) if eligible is None else eligible).cast("boolean").alias("primary_eligible"),
        (F.lit(None) if ambiguous is None else ambiguous).cast("boolean").alias("ambiguous"),
        (F.lit(None) if valid is None else valid).cast("timestamp").alias("as_of_valid"))


def precision_to_granularity(precision: Column) -> Column:
    out = F.lit("locality")
    for k, g in policy.PRECISION_TO_GRANULARITY.items():
        out = F.when(precision == k, F.lit(g)).otherwise(out)
    return out


def prepared_addresses(address: DataFrame) -> DataFrame:
    """Adds normal form, tokens and pin once, for every arm."""
    return (address.withColumn("norm", text.norm_text(F.col("address_text")))
            .withColumn("toks", text.tokens(F.col("norm")))
            .withColumn("pin_text", text.pin_in_text(F.col("address_text"))))


def frozen_baseline(pin: DataFrame) -> DataFrame:
    p = F.col("precision")
    return _arm(pin, "frozen_baseline", F.concat(F.lit("baseline:"), p), F.col("geocoder_x"),
                F.col("geocoder_y"), precision_to_granularity(p), p, precision=p)


def token_idf(addr: DataFrame, added_before: str | None) -> DataFrame:
    """token -> document frequency and smoothed idf over records added before the cut."""
    docs = addr if added_before is None else addr.filter(
        F.col("added_date") < F.lit(added_before).cast("date"))
    n = docs.agg(F.count("*").alias("n_docs"))
    df = (docs.select(F.explode(F.array_distinct("toks")).alias("token"))
          .groupBy("token").agg(F.count("*").alias("df")))
    return df.withColumn("n_docs", n.scalar()).select(
        "token", "df", "n_docs", (F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1.0)
        .alias("idf"))


def locality_tokens(loc: DataFrame, addr: DataFrame, added_before: str | None) -> DataFrame:
    """Per locality name token: idf, size of the name and the name's rarest token."""
    lt = (loc.withColumn("ntoks", F.array_distinct(
        text.tokens(text.norm_text(F.col("locality_name")))))
          .filter(F.size("ntoks") > 0)
          .select("town_id", "locality_id", F.size("ntoks").alias("n_name"),
                  F.explode("ntoks").alias("token")))
    idf = token_idf(addr, added_before)
    n = idf.agg(F.max("n_docs").alias("nd"))
    unseen = F.log(F.coalesce(n.scalar(), F.lit(0)) + 1.0) + 1.0
    w = Window.partitionBy("locality_id")
    return (lt.join(idf.select("token", "df", "idf"), "token", "left")
            .withColumn("df", F.coalesce("df", F.lit(0)))
            .withColumn("idf", F.coalesce("idf", unseen))
            .withColumn("rare", F.min(F.struct("df", "token")).over(w)["token"]))


def locality_hits(addr: DataFrame, loc: DataFrame, added_before: str | None,
                  coverage: float = 0.5) -> DataFrame:
    """All (address, locality) name matches that pass coverage and hold the rarest token.

    A match holds the name's rarest token, so only that one is joined; coverage is then counted on the
    few tokens of the name, without a second shuffle.
    """
    names = (locality_tokens(loc, addr, added_before).groupBy("town_id", "locality_id", "n_name", "rare")
             .agg(F.sort_array(F.collect_list(F.struct("token", "idf"))).alias("name")))
    at = token_index(addr, "address_id", "toks", ["town_id", "toks"])
    met = at.join(names.withColumnRenamed("rare", "token"), ["town_id", "token"])
    held = F.filter("name", lambda t: F.array_contains("toks", t["token"]))
    return (met.withColumn("held", held).select(
        "address_id", "locality_id", "n_name", F.size("held").cast("long").alias("shared"),
        F.round(F.aggregate("held", F.lit(0.0), lambda a, t: a + t["idf"]), 6).alias("idf_sum"))
        .withColumn("coverage", F.round(F.col("shared") / F.col("n_name"), 6))
        .filter(F.col("shared") / F.col("n_name") >= coverage))


def best_locality(hits: DataFrame) -> DataFrame:
    """Top locality per address as a mergeable maximum (coverage, idf, name length, then id)."""
    order = F.struct((-F.col("coverage")).alias("o1"), (-F.col("idf_sum")).alias("o2"),
                     (-F.col("n_name")).alias("o3"), F.col("locality_id"))
    return hits.groupBy("address_id").agg(F.min(order).alias("m")).select(
        "address_id", F.col("m.locality_id").alias("locality_id"),
        (-F.col("m.o1")).alias("coverage"), (-F.col("m.o2")).alias("idf_sum"))


def locality_matches(addr: DataFrame, loc: DataFrame, added_before: str | None) -> DataFrame:
    """Name match where one exists, else every locality of the pin in the text."""
    named = best_locality(locality_hits(addr, loc, added_before)).withColumn(
        "match", F.lit("idf_token_match"))
    by_pin = (addr.filter("pin_text is not null").select("address_id", "town_id", "pin_text")
              .join(named.select("address_id"), "address_id", "left_anti")
              .join(loc.select("town_id", F.col("pincode").alias("pin_text"), "locality_id"),
                    ["town_id", "pin_text"])
              .select("address_id", "locality_id", F.lit(None).cast("double").alias("coverage"),
                      F.lit(None).cast("double").alias("idf_sum"),
                      F.lit("pincode_match").alias("match")))
    return named.unionByName(by_pin)


def with_residue(matches: DataFrame, proposals: DataFrame) -> DataFrame:
    """Matches and the accepted residue proposals (of addresses in which no name and no pin could be read)."""
    rows = proposals.join(matches.select("address_id").distinct(), "address_id", "left_anti").select(
        "address_id", "locality_id", F.lit("residue_tfidf").alias("match"), F.col("score").alias("residue_score"),
        F.round(F.col("score") / F.col("second"), 3).alias("residue_margin"))
    return matches.unionByName(rows, allowMissingColumns=True)


def locality_centroid(matches: DataFrame, loc: DataFrame) -> DataFrame:
    df = matches.join(loc.select("locality_id", "cx", "cy"), "locality_id")
    return _arm(df, "locality_centroid", F.concat(F.lit("locality:"), "locality_id"), F.col("cx"),
                F.col("cy"), F.lit("locality"), F.lit("locality"))


PROVENANCE = ["match", "coverage", "idf_sum", "ambiguous_pin", "residue_score", "residue_margin"]


def locality_provenance(matches: DataFrame) -> DataFrame:
    """(address_id, source_ref, ...) of each row of the arm: how the locality was read; all localities of a pin are marked ambiguous."""
    own = [F.col(c) if c in matches.columns else F.lit(None).cast("double").alias(c) for c in ("residue_score", "residue_margin")]
    return matches.select("address_id", F.concat(F.lit("locality:"), "locality_id").alias("source_ref"), "match", F.round("coverage", 4).alias("coverage"), "idf_sum",
                          F.when(F.col("match") == "pincode_match", True).alias("ambiguous_pin"), *own)


def locality_v1(addr: DataFrame, loc: DataFrame) -> DataFrame:
    """Comparator: any shared token counts 2, pin counts 1; best score, then id."""
    lt = token_index(loc.withColumn("nt", text.tokens(text.norm_text(F.col("locality_name")))),
                     "locality_id", "nt", ["town_id"])
    tok = (overlap(token_index(addr, "address_id", "toks", ["town_id"]), lt, "address_id",
                   "locality_id", ["town_id"]).select("address_id", "locality_id",
                                                      F.lit(2).alias("s")))
    pin = (addr.filter("pin_text is not null").select("address_id", "town_id", "pin_text")
           .join(loc.select("town_id", F.col("pincode").alias("pin_text"), "locality_id"),
                 ["town_id", "pin_text"]).select("address_id", "locality_id", F.lit(1).alias("s")))
    total = tok.unionByName(pin).groupBy("address_id", "locality_id").agg(F.sum("s").alias("score"))
    return total.groupBy("address_id").agg(
        F.min(F.struct((-F.col("score")).alias("o"), F.col("locality_id"))).alias("m")).select(
        "address_id", F.col("m.locality_id").alias("locality_id"), (-F.col("m.o")).alias("score"))


def town_centroids(loc: DataFrame) -> DataFrame:
    return loc.groupBy("town_id").agg(F.avg("cx").alias("tcx"), F.avg("cy").alias("tcy"))


def town_centroid(addr: DataFrame, loc: DataFrame) -> DataFrame:
    df = addr.select("address_id", "town_id").join(town_centroids(loc), "town_id")
    return _arm(df, "town_centroid", F.concat(F.lit("town:"), "town_id"), F.col("tcx"),
                F.col("tcy"), F.lit("town"), F.lit("town"))


def landmark_hits(addr: DataFrame, lm: DataFrame, most: int | None = None) -> DataFrame:
    """Landmarks whose name shares tokens with the relation window, best score only: all ties, or the first `most` (n_hits counts all).

    What a window scores depends only on its tokens that some landmark of the town has, so windows with the same ones (`sig`) are scored
    once: a token that all landmarks share meets them once per such set, not once per address.
    """
    win = (addr.withColumn("win", text.relation_window(F.col("toks")))
           .filter("win is not null and (size(win.before) > 0 or size(win.after) > 0)")
           .select("address_id", "town_id", F.col("win.rel").alias("rel"),
                   F.array_distinct("win.before").alias("bef"),
                   F.array_distinct("win.after").alias("aft")))
    side = win.select("address_id", "town_id", "rel", F.explode(F.concat(
        F.transform("aft", lambda t: F.struct(t.alias("token"), F.lit(2).alias("pts"))),
        F.transform("bef", lambda t: F.struct(t.alias("token"), F.lit(1).alias("pts")))))
        .alias("s")).select("address_id", "town_id", "rel", "s.token", "s.pts")
    lt = token_index(lm.withColumn("nt", text.tokens(text.norm_text(F.col("poi_name")))),
                     "poi_id", "nt", ["town_id"])
    known = checkpoint(side.join(lt.select("town_id", "token").distinct(), ["town_id", "token"]).groupBy("address_id", "town_id", "rel")
                       .agg(F.sort_array(F.collect_list(F.struct("token", "pts"))).alias("sig")))
    # a number for each, stored: what follows is sorted by a long; few bytes, much work per row, so they are dealt out by number
    sigs = checkpoint(known.select("town_id", "sig").distinct().withColumn("sid", F.monotonically_increasing_id()))
    parts = int(addr.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    scored = (sigs.repartition(parts, "sid").withColumn("s", F.explode("sig")).select("town_id", "sid", "s.token", "s.pts").join(lt, ["town_id", "token"])
              .groupBy("sid", "poi_id").agg(F.sum("pts").alias("score")))
    w = Window.partitionBy("sid")
    best = (scored.withColumn("best", F.max("score").over(w)).filter("score = best")
            .withColumn("n_hits", F.count("*").over(w))
            .withColumn("rn", F.row_number().over(w.orderBy("poi_id"))))
    if most is not None:
        best = best.filter(F.col("rn") <= most)
    return known.join(sigs, ["town_id", "sig"]).join(best, "sid").select("address_id", "poi_id", "rel", "score", "best", "n_hits", "rn")


def official_landmark(hits: DataFrame, lm: DataFrame) -> DataFrame:
    df = hits.filter("rn <= 2").join(lm.select("poi_id", "px", "py"), "poi_id")
    return _arm(df, "official_landmark", F.concat(F.lit("landmark:"), "poi_id"), F.col("px"),
                F.col("py"), F.lit("locality"), F.lit("locality"), arm_rank=F.col("rn"),
                ambiguous=F.col("n_hits") > 1)


def address_book_matches(addr: DataFrame, pin: DataFrame) -> DataFrame:
    """For each record the smallest other pinned record with the same town and normal form.

    Only the two smallest pinned ids of a text group are ever needed, so the group is aggregated to
    those two and joined back: a text shared by a third of all rows costs no pairs.
    """
    key = ["town_id", "norm"]
    book = addr.filter("norm <> ''").select(*key, "address_id").join(
        pin.select("address_id"), "address_id", "left_semi")
    first = book.groupBy(*key).agg(F.min("address_id").alias("m1"))
    second = (book.join(first, key).filter("address_id > m1").groupBy(*key)
              .agg(F.min("address_id").alias("m2")))
    both = first.join(second, key, "left")
    return (addr.select("address_id", *key).join(both, key)
            .withColumn("other", F.when(F.col("address_id") == F.col("m1"), F.col("m2"))
                        .otherwise(F.col("m1"))).filter("other is not null")
            .select("address_id", "other"))


def address_book(addr: DataFrame, pin: DataFrame) -> DataFrame:
    m = address_book_matches(addr, pin)
    df = m.join(pin.withColumnRenamed("address_id", "other"), "other")
    return _arm(df, "address_book", F.concat(F.lit("address:"), "other"), F.col("geocoder_x"),
                F.col("geocoder_y"), precision_to_granularity(F.col("precision")),
                F.col("precision"))


def field_evidence(ev: DataFrame, p: Policy = BASE) -> DataFrame:
    """Up to three single check-ins, and the median of agreeing strong ones (listed first)."""
    pos = ev.filter((F.col("polarity") == "positive") & (F.col("weight") >= p.w_min)
                    & F.col("x").isNotNull())
    w = Window.partitionBy("address_id").orderBy(F.col("weight").desc(), "observation_id")
    singles = pos.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= p.singles_max)
    one = _arm(singles, "field_evidence", F.concat(F.lit("visit:"), "observation_id"), F.col("x"),
               F.col("y"), F.lit("street"), F.lit("street"), arm_rank=F.col("rn"),
               eligible=F.lit(False), valid=F.col("observed_at"))
    strong = pos.filter(F.col("weight") >= p.w_promote)
    med = strong.groupBy("address_id").agg(
        F.count("*").alias("n"), F.percentile("x", 0.5).alias("mx"),
        F.percentile("y", 0.5).alias("my"), F.percentile("gps_accuracy_m", 0.5).alias("acc"),
        F.max("observed_at").alias("last_at")).filter("n >= 2")
    spread = (strong.join(med.select("address_id", "mx", "my"), "address_id")
              .groupBy("address_id").agg(F.max(geo.distance(
                  F.col("x"), F.col("y"), F.col("mx"), F.col("my"))).alias("spread")))
    cons = med.join(spread, "address_id").filter(F.col("spread") <= p.consistency_band_m)
    gran = F.when(F.col("acc") <= 15.0, "rooftop").otherwise("street")
    return one.unionByName(_arm(
        cons, "field_evidence", F.concat(F.lit("visits:median("), "n", F.lit(")")), F.col("mx"),
        F.col("my"), gran, gran, eligible=F.lit(True), valid=F.col("last_at")))


def static_union(v, added_before: str | None = "2024-02-01", addr: DataFrame | None = None) -> DataFrame:
    addr = prepared_addresses(v.address()) if addr is None else addr
    loc, lm, pin = v.locality(), v.landmark(), v.pin()
    return (frozen_baseline(pin)
            .unionByName(locality_centroid(locality_matches(addr, loc, added_before), loc))
            .unionByName(town_centroid(addr, loc))
            .unionByName(official_landmark(landmark_hits(addr, lm, most=2), lm))
            .unionByName(address_book(addr, pin)))


def arm_index(arm: Column) -> Column:
    return F.array_position(F.array(*[F.lit(a) for a in policy.ARMS]), arm).cast("int")


def candidate_sets(union: DataFrame, p: Policy = BASE, own: Column | None = None) -> DataFrame:
    """(address_id, cands): de-duplicated, plausible candidates in registry order.

    own: the id that candidates are named by, where `address_id` stands for more than the address (see `plans.sweep`).  A candidate set is bounded by the arm rules (and by the localities that share one pin), so it is
    gathered as an array; the later set-level steps need no further shuffle.
    """
    c = union.withColumn("candidate_id", candidate_id(F.col("arm"), F.col("address_id") if own is None else own,
                                                      F.col("source_ref"))) \
        .withColumn("arm_index", arm_index(F.col("arm")))
    fields = ["arm_index", "arm_rank", "candidate_id", "arm", "source_ref", "x", "y",
              "granularity", "stratum", "baseline_precision", "primary_eligible", "ambiguous",
              "as_of_valid"]
    g = c.groupBy("address_id").agg(F.sort_array(F.collect_set(F.struct(*fields))).alias("raw"))
    others = F.filter("raw", lambda c: c["arm"] != "official_landmark")

    def plausible(c):
        return (c["arm"] != "official_landmark") | (F.size("others") == 0) | F.exists(
            "others", lambda o: geo.distance(c["x"], c["y"], o["x"], o["y"]) <= p.landmark_max_m)

    g = g.withColumn("others", others)
    return g.select("address_id", F.filter("raw", plausible).alias("cands"))


def agreement(p: Policy = BASE) -> Column:
    """`cands` with, per candidate: distinct other arms within the band, and how many candidates are there."""
    def near(c):
        return F.filter("cands", lambda o: (o["candidate_id"] != c["candidate_id"]) & (
            geo.distance(o["x"], o["y"], c["x"], c["y"]) <= p.agreement_m))

    return F.transform("cands", lambda c: c.withField(
        "agreement_arms", F.size(F.array_distinct(F.transform(near(c), lambda o: o["arm"]))))
        .withField("f_agreement_count", F.size(near(c))))


def with_agreement(sets: DataFrame, p: Policy = BASE) -> DataFrame:
    return sets.select("address_id", agreement(p).alias("cands"))


def exploded(sets: DataFrame) -> DataFrame:
    return sets.select("address_id", F.posexplode("cands").alias("pos", "c")).select(
        "address_id", (F.col("pos") + 1).alias("retrieval_rank"), "c.*")
