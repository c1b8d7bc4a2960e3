"""Record lookup, purpose, eligibility gate, directions, tasks and places."""
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placeproof import policy
from placeproof.functions import geo, text, times
from placeproof.operators.tokenjoin import jaccard_lookup


def find_records(queries: DataFrame, addr: DataFrame, loc: DataFrame) -> DataFrame:
    """(qid, address_id, how): exact normal form; strong unambiguous token match; area context."""
    q = (queries.withColumn("norm", text.norm_text(F.col("qtext")))
         .withColumn("toks", F.array_sort(F.array_distinct(text.tokens(F.col("norm")))))
         .withColumn("pin_text", text.pin_in_text(F.col("qtext"))))
    exact = q.join(addr.groupBy("town_id", "norm").agg(F.min("address_id").alias("hit")),
                   ["town_id", "norm"]).filter("norm <> ''").select("qid", "hit")
    rest = q.join(exact, "qid", "left_anti")
    records = addr.select("town_id", F.col("address_id").alias("rid"),
                          F.array_sort(F.array_distinct("toks")).alias("toks")).filter("size(toks) > 0")
    pairs = jaccard_lookup(rest.select("qid", "town_id", "toks"), records, 0.85, ["town_id"])
    numbers_ok = F.forall("_q", lambda t: ~t.rlike("^[0-9]+$") | F.array_contains("_r", t))
    pairs = pairs.filter(numbers_ok)
    w = Window.partitionBy("qid").orderBy(F.col("jaccard").desc(), "rid")
    two = pairs.withColumn("rn", F.row_number().over(w)).filter("rn <= 2")
    top = two.groupBy("qid").agg(
        F.max(F.when(F.col("rn") == 1, F.col("jaccard"))).alias("j1"),
        F.max(F.when(F.col("rn") == 2, F.col("jaccard"))).alias("j2"),
        F.max(F.when(F.col("rn") == 1, F.col("copies"))).alias("c1"),
        F.max(F.when(F.col("rn") == 1, F.col("rid"))).alias("fuzzy"))
    sure = top.filter("c1 = 1 and (j2 is null or j2 + 0.10 <= j1)").select("qid", "fuzzy")
    by_pin = (loc.groupBy("town_id", F.col("pincode").alias("pin_text"))
              .agg(F.count("*").alias("n"), F.min("locality_id").alias("pin_loc")).filter("n = 1").drop("n"))
    lt = loc.select("town_id", "locality_id", F.explode(F.array_distinct(
        text.tokens(text.norm_text(F.col("locality_name"))))).alias("token")).filter(
        ~F.col("token").isin(policy.GENERIC_WORDS))
    score = (rest.select("qid", "town_id", F.explode("toks").alias("token")).join(lt, ["town_id", "token"])
             .groupBy("qid", "locality_id").agg(F.count("*").alias("n")))
    wl = Window.partitionBy("qid").orderBy(F.col("n").desc(), "locality_id")
    named = (score.withColumn("nx", F.lead("n").over(wl)).withColumn("rn", F.row_number().over(wl))
             .filter("rn = 1 and (nx is null or nx < n)").select("qid", F.col("locality_id").alias("name_loc")))
    area = F.coalesce("pin_loc", "name_loc")
    return (q.join(exact, "qid", "left").join(sure, "qid", "left").join(by_pin, ["town_id", "pin_text"], "left")
            .join(named, "qid", "left").select(
        "qid", F.coalesce("hit", "fuzzy").alias("address_id"),
        F.when(F.col("norm") == "", "empty_text").when(F.col("hit").isNotNull(), "exact_text_match")
        .when(F.col("fuzzy").isNotNull(), "fuzzy_text_match")
        .when(area.isNotNull(), F.concat(F.lit("area_context:"), area)).otherwise("no_match").alias("how")))


def purpose(address: DataFrame, ev: DataFrame) -> DataFrame:
    """(address_id, purpose, basis) in rule order; needs promotion columns from `evidence.promotion`."""
    from placeproof.plans.evidence import promotion
    strong = ev.filter((F.col("polarity") == "positive") & (F.col("weight") >= 0.5))
    hour, day = times.local_hour(F.col("observed_at")), times.local_weekday(F.col("observed_at"))
    agg = strong.groupBy("address_id").agg(
        F.count("*").alias("n_met"),
        F.bool_and(F.coalesce("dwell_s", F.lit(0)) >= 180).alias("dwell_ok"),
        F.count_if(day < 5).alias("n_weekday"),
        F.count_if((hour >= 8) & (hour < 19)).alias("n_daytime"))
    promo = promotion(ev, ["address_id"]).select("address_id", "promoted")
    j = address.select("address_id", "address_type").join(agg, "address_id", "left").join(
        promo, "address_id", "left")
    home = (F.col("promoted") & F.col("dwell_ok")
            & (F.col("n_weekday") >= F.greatest(F.lit(1), F.floor(F.col("n_met") / 2)))
            & (F.col("n_daytime") >= F.col("n_met") - 1))
    cls = (F.when(F.col("address_type") == "office", "WORK_LIKE")
           .when(F.col("n_met") >= 2, F.when(home, "HOME_LIKE").otherwise("UNKNOWN"))
           .when(F.col("address_type") == "permanent_native", "OTHER").otherwise("UNKNOWN"))
    return j.select("address_id", cls.alias("purpose"), F.coalesce("n_met", F.lit(0)).alias("n_met"))


def gate(purpose: Column, tier: Column, status: Column, n_neg: Column, radius: Column,
         request: Column, band: Column | None = None) -> tuple[Column, Column]:
    """(action, reason) of the ordered eligibility rules."""
    known = purpose == "UNKNOWN"
    good = tier.isin("CONFIRMED", "PROBABLE")
    strict = request.isin(policy.STRICT_PURPOSES)
    beyond = F.lit(False) if band is None else F.coalesce(radius > band, F.lit(False))
    rules = [
        (purpose == "OTHER", "REFUSE", F.lit("purpose_other")),
        (purpose == "WORK_LIKE", "REFUSE", F.lit("purpose_work_like")),
        (known & good & (status == "STABLE") & (n_neg == 0), "VERIFY_FIRST", F.lit("purpose_unknown")),
        (known & strict, "REFUSE", F.lit("purpose_unknown_low_confidence")),
        (known, "VERIFY_FIRST", F.when(tier == "APPROXIMATE", "tier_approximate").otherwise("unplaceable")),
        (status.isin("CONTESTED", "MOVED_SUSPECTED"), "VERIFY_FIRST",
         F.when(n_neg > 0, "negatives_accumulated").otherwise("status_contested")),
        (tier == "UNPLACEABLE", "VERIFY_FIRST", F.lit("unplaceable")),
        (n_neg >= 2, "VERIFY_FIRST", F.lit("negatives_accumulated")),
        (good & beyond, "VERIFY_FIRST", F.lit("radius_beyond_band")),
        (good, "SERVE", F.when(tier == "CONFIRMED", "purpose_home_like").otherwise("tier_probable")),
    ]
    action, reason = F.lit("VERIFY_FIRST"), F.lit("tier_approximate")
    for cond, a, r in reversed(rules):
        action = F.when(cond, F.lit(a)).otherwise(action)
        reason = F.when(cond, r).otherwise(reason)
    return action, reason


# Fixed value: how a score term is written as a reason code.
TERM_CODE = r"^([A-Za-z_][A-Za-z0-9_]*)(?::([A-Za-z0-9_\-]+))?=([+-]?[0-9.]+)$"


def term_code(name: Column, value: Column) -> Column:
    return F.concat(name, F.lit("="), F.format_string("%+.4f", value))


def parse_term(code: Column) -> Column:
    """struct(name, subject, effect, direction, label) of a reason code; one that is no score term has only its name, is neutral and keeps its label."""
    part = lambda i: F.nullif(F.regexp_extract(code, TERM_CODE, i), F.lit(""))
    effect = part(3).cast("double")
    words = F.regexp_replace(F.split_part(code, F.lit("="), F.lit(1)), "[_:]", " ")
    label = F.concat(F.upper(F.substring(words, 1, 1)), F.lower(F.substring(words, 2, 1 << 20)))
    return F.struct(F.when(part(1).isNull(), code).otherwise(F.concat_ws(":", part(1), part(2))).alias("name"), part(2).alias("subject"), effect.alias("effect"),
                    F.when(effect.isNull(), "neutral").when(effect >= 0, "positive").otherwise("negative").alias("direction"), F.trim(label).alias("label"))


def decisions(belief: DataFrame, purposes: DataFrame, request: str) -> DataFrame:
    a, r = gate(F.col("purpose"), F.col("tier"), F.col("status"), F.col("n_neg"), F.col("radius_m"), F.lit(request))
    return belief.join(purposes.select("address_id", "purpose"), "address_id").withColumn(
        "action", a).withColumn("reason", r)


def directions(belief: DataFrame, landmark_hits: DataFrame, lm: DataFrame, max_m: float = 1500.0) -> DataFrame:
    """Advisory cues: every landmark tied for best in the relation window, within range."""
    j = (landmark_hits.select("address_id", "poi_id", "rel", "n_hits")
         .join(belief.filter("candidate_id is not null").select("address_id", "x", "y"), "address_id")
         .join(lm.select("poi_id", "poi_name", "px", "py"), "poi_id")
         .withColumn("d", geo.distance(F.col("x"), F.col("y"), F.col("px"), F.col("py")))
         .filter(F.col("d") <= max_m)
         .withColumn("b", geo.bearing(F.col("x"), F.col("y"), F.col("px"), F.col("py"))))
    return j.select(
        "address_id", "poi_id", geo.round10(F.col("d")).alias("distance_m"), F.round("b", 1).alias("bearing_deg"),
        (F.col("n_hits") > 1).alias("ambiguous"),
        F.concat("poi_name", F.lit(" ~"), geo.round10(F.col("d")), F.lit(" m, bearing "),
                 geo.compass(F.col("b")), F.lit(", "), "rel", F.lit(" it")).alias("cue_text"))


def tasks(belief: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Verify-first tasks with idempotent ids; ids already present are not raised again."""
    cause = F.when(F.col("status").isin("MOVED_SUSPECTED", "CONTESTED"), F.col("status")).otherwise("low_confidence")
    t = belief.filter(F.col("status").isin("MOVED_SUSPECTED", "CONTESTED")).select(
        F.concat(F.lit("VF-"), "address_id", F.lit("-"), cause).alias("task_id"), "address_id", "town_id",
        cause.alias("cause"), F.when(F.col("status") == "CONTESTED", 0.9).when(
            F.col("status") == "MOVED_SUSPECTED", 0.8).otherwise(0.5).alias("priority"),
        F.col("as_of").alias("raised_at"), "tier", "radius_m", "n_neg")
    return t if existing is None else t.join(existing.select("task_id"), "task_id", "left_anti")


def with_state(tasks_: DataFrame, events: DataFrame, as_of: str) -> DataFrame:
    """Tasks with the state their latest event before the cut left them in (`open` without any)."""
    last = (events.filter(F.col("at") < F.lit(as_of).cast("timestamp")).groupBy("address_id")
            .agg(F.max_by("kind", F.struct("at", "event_id")).alias("state")))
    return tasks_.join(last, "address_id", "left").withColumn("state", F.coalesce("state", F.lit("open")))


def matching(rows: DataFrame, search: tuple[str, str] | None = None, **accepted) -> DataFrame:
    """List filter: each keyword names a column and its accepted values (None: any); search is (column, text)."""
    for column, values in accepted.items():
        if values is not None:
            rows = rows.filter(F.col(column).isin(list(values)))
    return rows if search is None else rows.filter(F.contains(F.lower(search[0]), F.lit(search[1].lower())))


def page(rows: DataFrame, order: list[Column], number: int = 1, size: int = 50) -> DataFrame:
    """One page of a list in a total order."""
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def facets(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, value, n) of a filtered list, all facets in one pass."""
    cells = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])
    return rows.select(F.explode(cells).alias("c")).groupBy("c.facet", "c.value").agg(F.count("*").alias("n"))


def bad_transitions(events: DataFrame) -> DataFrame:
    """Task events whose move is not in the state table (the first event must be `open`)."""
    spark = events.sparkSession
    allowed = spark.createDataFrame(policy.TASK_TRANSITIONS, "prev string, kind string")
    w = Window.partitionBy("task_id").orderBy("seq")
    e = events.withColumn("prev", F.lag("kind").over(w))
    first_ok = F.col("prev").isNull() & (F.col("kind") == "open")
    return e.filter(~first_ok).join(F.broadcast(allowed), ["prev", "kind"], "left_anti")


def place_state(belief: DataFrame, member: DataFrame) -> DataFrame:
    """State of each place over its members, with the anchor member."""
    b = belief.join(member, "address_id")
    return b.groupBy("place_id").agg(
        F.count("*").alias("n_members"),
        F.when(F.bool_or(F.col("status") == "CONTESTED"), "CONTESTED")
        .when(F.bool_or(F.col("status") == "MOVED_SUSPECTED"), "MOVED_SUSPECTED")
        .when(F.bool_or(F.col("tier") == "CONFIRMED"), "CONFIRMED")
        .when(F.bool_or(F.col("tier") == "PROBABLE"), "WARM").otherwise("COLD").alias("state"),
        F.coalesce(F.min(F.when(F.col("tier") == "CONFIRMED", F.col("address_id"))),
                   F.min(F.when(F.col("candidate_id").isNotNull(), F.col("address_id")))).alias("anchor_id"),
        F.count_if(F.col("status").isin("CONTESTED", "MOVED_SUSPECTED")).alias("n_contradictions"))
