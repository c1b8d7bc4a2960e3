"""Projections, flags and column functions over whole tables."""
from pyspark.sql import functions as F

from placeproof.catalog import query
from placeproof.catalog.oracle_views import dist, norm, toks
from placeproof.functions import digest, geo, text, times
from placeproof.operators.profile import union_all
from placeproof.plans import evidence


@query("normal_forms", f"SELECT address_id, {norm('address_text')} AS norm, lower(address_text) AS raw_norm FROM w_address")
def normal_forms(v):
    t = F.col("address_text")
    return v.address().select("address_id", text.norm_text(t).alias("norm"),
                              text.norm_raw(t).alias("raw_norm"))


WIDE = "\uff10\uff11\uff12\uff13\uff14\uff15\uff16\uff17\uff18\uff19"


@query("normal_forms_folded", f"SELECT address_id, {norm('address_text')} AS norm, address_id % 3 = 0 AND regexp_matches(address_text, '[0-9]') AS was_wide FROM w_address")
def normal_forms_folded(v):
    """Texts with full-width digits (every third address) come to the same normal form through the compatibility fold."""
    raw = F.when(F.col("address_id") % 3 == 0, F.translate("address_text", "0123456789", WIDE)).otherwise(F.col("address_text"))
    a = v.address().select("address_id", raw.alias("raw"))
    return a.select("address_id", text.norm_text(F.col("raw"), fold=True).alias("norm"), F.col("raw").rlike(f"[{WIDE}]").alias("was_wide"))


@query("raw_ring_relation", """
SELECT address_id, rel, array_to_string(list_slice(regexp_extract_all(substr(low,1,pos-1), '[0-9A-Za-z\\x{0C80}-\\x{0CFF}]+'), -3, -1), ' ') AS before,
  array_to_string(list_slice(regexp_extract_all(substr(low,pos+length(rel)), '[0-9A-Za-z\\x{0C80}-\\x{0CFF}]+'), 1, 3), ' ') AS after
FROM (SELECT *, instr(low, rel) AS pos FROM (SELECT address_id, lower(address_text) AS low,
 CASE WHEN contains(low,'close to') THEN 'close to' WHEN contains(low,'next to') THEN 'next to' WHEN contains(low,'opposite') THEN 'opposite'
  WHEN contains(low,'opp') THEN 'opp' WHEN contains(low,'near') THEN 'near' WHEN contains(low,'behind') THEN 'behind'
  WHEN contains(low,'beside') THEN 'beside' WHEN contains(low,'adjacent') THEN 'adjacent' WHEN contains(low,'ಹತ್ತಿರ') THEN 'ಹತ್ತಿರ' END AS rel
 FROM w_address) WHERE rel IS NOT NULL)""")
def raw_ring_relation(v):
    w = v.address().withColumn("w", text.raw_relation_window(F.col("address_text")))
    return w.filter("w is not null").select(
        "address_id", "w.rel", F.array_join("w.before", " ").alias("before"),
        F.array_join("w.after", " ").alias("after"))


@query("scope_normal_form", """
SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '\\s*-\\s*\\d{6}\\s*$', ''), '[^0-9a-z\\x{0900}-\\x{0D7F}]+', ' ', 'g'))) AS h FROM documents""")
def scope_normal_form(v):
    return v.raw("documents").select("doc_id", F.md5(text.norm_scope(F.col("text"))).alias("h"))


@query("address_flags", """
SELECT address_id, NOT regexp_matches(address_text,'[0-9]') AS no_digit, NOT regexp_matches(address_text,'[,/\\-]') AS no_separator,
  pin_text IS NOT NULL AS has_pin, pin_text IS NOT NULL AND pin_text NOT IN (SELECT pincode FROM w_locality) AS pin_unknown,
  town_id = 'OUT' AS outside_town, count(*) OVER (PARTITION BY norm) > 1 AS dup_text FROM w_addr""")
def address_flags(v):
    from placeproof.plans.candidates import prepared_addresses
    a = prepared_addresses(v.address())
    known = v.locality().select(F.col("pincode").alias("pin_text"), F.lit(True).alias("known")).distinct()
    dups = a.groupBy("norm").agg((F.count("*") > 1).alias("dup_text"))
    t = F.col("address_text")
    return (a.join(known, "pin_text", "left").join(dups, "norm").select(
        "address_id", (~t.rlike("[0-9]")).alias("no_digit"), (~t.rlike(r"[,/\-]")).alias("no_separator"),
        F.col("pin_text").isNotNull().alias("has_pin"),
        (F.col("pin_text").isNotNull() & F.col("known").isNull()).alias("pin_unknown"),
        (F.col("town_id") == "OUT").alias("outside_town"), "dup_text"))


# Span markers.
MARKERS = {"lane": r"\b(gali|galli|lane|ln)\b", "block": r"\b(block|blk|sector|sec|ward)\b",
           "cross": r"\b(cross|main|marg)\b", "house": r"\b(house|h|plot|door|d\.?no|flat)\b",
           "relation": r"\b(near|opposite|behind|beside|adjacent|next to)\b"}


@query("span_markers", "SELECT address_id, " + ", ".join(
    f"regexp_matches(norm, '{rx}') AS span_{k}" for k, rx in MARKERS.items()) + """,
  len(list_intersect(string_split(norm,' '), (SELECT list(DISTINCT w) FROM (SELECT unnest(string_split(lower(locality_name),' ')) AS w FROM w_locality
   UNION ALL SELECT unnest(string_split(lower(town_name),' ')) FROM w_town)))) > 0 AS span_gazetteer FROM w_addr""")
def span_markers(v):
    """Marker flags, and a gazetteer-word hit through a semi-join on words."""
    a = v.address().withColumn("norm", text.norm_text(F.col("address_text")))
    words = (v.locality().select(F.explode(F.split(F.lower("locality_name"), " ")).alias("w"))
             .union(v.town().select(F.explode(F.split(F.lower("town_name"), " ")).alias("w"))).distinct())
    hit = (a.select("address_id", F.explode(F.split("norm", " ")).alias("w"))
           .join(words, "w", "left_semi").select("address_id").distinct()
           .withColumn("span_gazetteer", F.lit(True)))
    return a.join(hit, "address_id", "left").select(
        "address_id", *[F.col("norm").rlike(rx).alias(f"span_{k}") for k, rx in MARKERS.items()],
        F.coalesce("span_gazetteer", F.lit(False)).alias("span_gazetteer"))


@query("outcome_dimensions", """
SELECT outcome, CASE WHEN outcome IN ('met_borrower','met_family','cash_collected') THEN 'place_positive'
  WHEN outcome IN ('locked_premises','neighbour_says_shifted','no_such_person') THEN 'place_weak_positive'
  WHEN outcome='address_not_traceable' THEN 'place_indeterminate' ELSE 'unknown' END AS place_flag,
 CASE WHEN outcome IN ('met_borrower','cash_collected') THEN 'person_positive' WHEN outcome IN ('no_such_person','neighbour_says_shifted')
  THEN 'person_negative' ELSE 'person_indeterminate' END AS person_flag, count(*) AS n FROM w_visit GROUP BY 1,2,3""")
def outcome_dimensions(v):
    o = F.col("outcome")
    place = (F.when(o.isin("met_borrower", "met_family", "cash_collected"), "place_positive")
             .when(o.isin("locked_premises", "neighbour_says_shifted", "no_such_person"), "place_weak_positive")
             .when(o == "address_not_traceable", "place_indeterminate").otherwise("unknown"))
    person = (F.when(o.isin("met_borrower", "cash_collected"), "person_positive")
              .when(o.isin("no_such_person", "neighbour_says_shifted"), "person_negative")
              .otherwise("person_indeterminate"))
    return (v.visit().select("outcome", place.alias("place_flag"), person.alias("person_flag"))
            .groupBy("outcome", "place_flag", "person_flag").agg(F.count("*").alias("n")))


@query("visit_flags", """
SELECT visit_id, round((epoch_us(observed_at)-epoch_us(start_ts))/1e6, 3) AS travel_s, start_ts > observed_at AS negative_travel,
  dwell_s < 60 AS short_dwell, dwell_s > 43200 AS implausible_dwell, outcome='address_not_traceable' AS negative_outcome FROM w_visit""")
def visit_flags(v):
    travel = (F.unix_micros("observed_at") - F.unix_micros("start_ts")) / 1e6
    return v.visit().select(
        "visit_id", F.round(travel, 3).alias("travel_s"), (travel < 0).alias("negative_travel"),
        (F.col("dwell_s") < 60).alias("short_dwell"),
        (F.col("dwell_s") > 12 * 3600).alias("implausible_dwell"),
        (F.col("outcome") == "address_not_traceable").alias("negative_outcome"))


@query("axis_artefacts_dropped", "SELECT visit_id, count(*) AS kept FROM w_trace WHERE dx <> 0 AND dy <> 0 GROUP BY 1")
def axis_artefacts_dropped(v):
    return (v.trace().filter((F.col("dx") != 0) & (F.col("dy") != 0)).groupBy("visit_id")
            .agg(F.count("*").alias("kept")))


def _count_sql(rx):
    return f"len(regexp_extract_all(text, '{rx}'))"


@query("text_shape", f"""
SELECT doc_id, length(text) AS n_chars, {_count_sql('[^ \\t\\n\\r\\f]+')} AS n_tokens, {_count_sql('[0-9]')} AS n_digits, {_count_sql('[A-Za-z]')} AS n_letters,
  {_count_sql(',')} AS n_commas, {_count_sql('/')} AS n_slashes, {_count_sql('-')} AS n_hyphens, {_count_sql('[.]')} AS n_dots, {_count_sql('[A-Z]')} AS n_upper,
  regexp_matches(text,'[^\\x00-\\x7F]') AS non_ascii, CASE WHEN regexp_matches(text,'[\\x{{0C80}}-\\x{{0CFF}}]') THEN 'kannada'
   WHEN regexp_matches(text,'[\\x{{0900}}-\\x{{097F}}]') THEN 'devanagari' ELSE 'latin' END AS script FROM documents""")
def text_shape(v):
    t = F.col("text")
    def n(rx):
        return F.regexp_count(t, F.lit(rx)).cast("long")
    return v.raw("documents").select(
        "doc_id", F.length(t).cast("long").alias("n_chars"), n(r"[^ \t\n\r\f]+").alias("n_tokens"),
        n("[0-9]").alias("n_digits"), n("[A-Za-z]").alias("n_letters"), n(",").alias("n_commas"),
        n("/").alias("n_slashes"), n("-").alias("n_hyphens"), n("[.]").alias("n_dots"),
        n("[A-Z]").alias("n_upper"), t.rlike(r"[^\x00-\x7F]").alias("non_ascii"),
        text.script_class(t).alias("script"))


# Fixed value: what stands before a house number.
HOUSE_MARK = r"(?i)(?:\bh\.?\s*no\.?|\bhouse(?:\s*no\.?)?|\bplot|\bdoor|\bd\.?\s*no\.?|\bno\.?|\bflat|#)\s*[:\-]?\s*\d"


@query("house_numbers", f"""
SELECT address_type, count(*) AS n, count(*) FILTER (regexp_matches(address_text,'{HOUSE_MARK}') OR regexp_matches(address_text,'\\b\\d{{1,4}}\\s*/\\s*\\d{{1,3}}\\b')) AS anchored,
  count(*) FILTER (regexp_matches(address_text,'\\b\\d+\\b')) AS any_number FROM w_address GROUP BY 1""")
def house_numbers(v):
    t = F.col("address_text")
    return v.address().groupBy("address_type").agg(
        F.count("*").alias("n"),
        F.count_if(t.rlike(HOUSE_MARK) | t.rlike(r"\b\d{1,4}\s*/\s*\d{1,3}\b")).alias("anchored"),
        F.count_if(t.rlike(r"\b\d+\b")).alias("any_number"))


@query("text_templates", """
SELECT substr(regexp_replace(regexp_replace(address_text,'[0-9]+','#','g'),'[a-z]+','w','g'),1,40) AS template, count(*) AS n FROM w_address GROUP BY 1""")
def text_templates(v):
    t = F.regexp_replace(F.regexp_replace("address_text", "[0-9]+", "#"), "[a-z]+", "w")
    return v.address().groupBy(F.substring(t, 1, 40).alias("template")).agg(F.count("*").alias("n"))


@query("numeric_slots", """
SELECT address_id, array_to_string(list_concat(
  list_transform(regexp_extract_all(norm, '(?i)\\b\\d{1,4}\\s*(?:st|nd|rd|th)?\\s*(?:cross|main|block|gali|lane|ward|sector)\\b'),
   lambda s: lower(regexp_extract(s,'(?i)(cross|main|block|gali|lane|ward|sector)$',1))||regexp_extract(s,'^\\d+')),
  list_transform(regexp_extract_all(norm,'(?i)\\b(?:no\\.?|number|h\\.?\\s?no\\.?|house|plot|door|d\\.?no|flat)\\s*\\.?\\s*\\d{1,4}'), lambda s: 'house'||regexp_extract(s,'(\\d+)$',1))), '|') AS slots
FROM w_addr""")
def numeric_slots(v):
    a = v.address().withColumn("norm", text.norm_text(F.col("address_text")))
    return a.select("address_id", F.array_join(text.numeric_slots(F.col("norm")), "|").alias("slots"))


@query("address_archetype", """
SELECT archetype, count(*) AS n FROM (SELECT CASE
  WHEN regexp_matches(norm,'\\b(near|opposite|behind|beside|adjacent|next to)\\b') THEN 'landmark-relation'
  WHEN p AND r AND h THEN 'pincode+road+house' WHEN p AND r THEN 'pincode+road' WHEN r THEN 'road-only'
  WHEN regexp_matches(address_text,'[\\x{0C01}-\\x{FFFF}]') THEN 'multi-script' ELSE 'plain' END AS archetype
 FROM (SELECT *, len(list_filter(w, lambda x: regexp_full_match(x,'[0-9]{6}')))>0 AS p, len(list_intersect(w,['gali','road','cross','main','street']))>0 AS r,
   len(list_filter(w, lambda x: regexp_full_match(x,'[0-9]+')))>0 AS h FROM (SELECT *, string_split(norm,' ') AS w FROM w_addr))) GROUP BY 1""")
def address_archetype(v):
    from placeproof.plans.evaluation import archetype
    a = v.address().withColumn("norm", text.norm_text(F.col("address_text")))
    return a.groupBy(archetype(F.col("norm"), F.col("address_text")).alias("archetype")).agg(
        F.count("*").alias("n"))


@query("amount_from_remark", """
SELECT outcome, count(amt) AS n_parsed, sum(amt) AS total FROM (SELECT outcome,
  try_cast(replace(regexp_extract(remark,'([0-9,]{3,})',1),',','') AS DOUBLE) AS amt FROM w_visit) GROUP BY 1""")
def amount_from_remark(v):
    amt = F.expr("try_cast(replace(regexp_extract(remark, '([0-9,]{3,})', 1), ',', '') as double)")
    return v.visit().select("outcome", amt.alias("amt")).groupBy("outcome").agg(
        F.count("amt").alias("n_parsed"), F.sum("amt").alias("total"))


@query("observation_mapping", """
SELECT observation_id, address_id, agent_id, device_id, outcome, evidence_class, polarity, x, y, coord_method, trail_agreement_m, gps_accuracy_m,
  dwell_s, epoch_us(observed_at) AS observed_us, media, checkin_x, checkin_y FROM w_obs""")
def observation_mapping(v):
    return v.observation().select(
        "observation_id", "address_id", "agent_id", "device_id", "outcome", "evidence_class",
        "polarity", "x", "y", "coord_method", "trail_agreement_m", "gps_accuracy_m", "dwell_s",
        F.unix_micros("observed_at").alias("observed_us"), "media", "checkin_x", "checkin_y")


@query("observation_validation", """
SELECT coalesce(reason,'accepted') AS result, CASE WHEN reason IS NULL THEN polarity END AS polarity, count(*) AS n FROM (SELECT *, CASE
  WHEN kind IS NULL THEN 'missing_kind' WHEN agent IS NULL THEN 'missing_agent_id' WHEN outcome = 'other' THEN 'unknown_outcome'
  WHEN kind = 'call' THEN 'unknown_kind' WHEN tm IS NULL THEN 'missing_timestamp'
  WHEN outcome IN ('no_such_person','address_not_traceable') AND claim THEN 'negative_coordinate_claim' END AS reason,
  CASE WHEN outcome IN ('no_such_person','address_not_traceable') THEN 'negative' WHEN outcome IN ('neighbour_says_shifted','locked_premises') THEN 'ambiguous'
   ELSE 'positive' END AS polarity
 FROM (SELECT CASE WHEN visit_id%19=0 THEN NULL WHEN visit_id%23=0 THEN 'call' ELSE 'visit' END AS kind, CASE WHEN visit_id%29<>0 THEN agent_id END AS agent,
  CASE WHEN visit_id%31=0 THEN 'other' ELSE outcome END AS outcome,
  CASE WHEN visit_id%37<>0 THEN observed_at WHEN visit_id%2=0 THEN start_ts END AS tm, visit_id%5=0 AS claim FROM w_visit)) GROUP BY 1,2""")
def observation_validation(v):
    k = F.col("visit_id")
    raw = v.visit().select(
        "address_id",
        F.when(k % 19 == 0, None).when(k % 23 == 0, "call").otherwise("visit").alias("kind"),
        F.when(k % 29 != 0, F.col("agent_id")).alias("agent_id"),
        F.when(k % 31 == 0, "other").otherwise(F.col("outcome")).alias("outcome"),
        F.when(k % 37 != 0, F.col("observed_at")).alias("observed_at"),
        F.when((k % 37 == 0) & (k % 2 == 0), F.col("start_ts")).alias("checkin_ts"),
        F.lit(None).cast("timestamp").alias("captured_at_device"), F.lit(1.0).alias("x"),
        (k % 5 == 0).alias("coordinate_claim"))
    good, bad = evidence.validate(raw)
    return union_all([
        good.groupBy(F.lit("accepted").alias("result"), "polarity").agg(F.count("*").alias("n")),
        bad.groupBy(F.col("reject_reason").alias("result"), F.lit(None).cast("string").alias("polarity"))
        .agg(F.count("*").alias("n"))])


@query("tokens_pin_relation", """
SELECT a.address_id, array_to_string(toks,' ') AS toks, pin_text, rel, array_to_string(bef,' ') AS before, array_to_string(aft,' ') AS after
FROM w_addr a LEFT JOIN w_relwin USING (address_id)""")
def tokens_pin_relation(v):
    from placeproof.plans.candidates import prepared_addresses
    a = prepared_addresses(v.address()).withColumn("w", text.relation_window(F.col("toks")))
    return a.select("address_id", F.array_join("toks", " ").alias("toks"), "pin_text", "w.rel",
                    F.array_join("w.before", " ").alias("before"), F.array_join("w.after", " ").alias("after"))


@query("name_similarity", """
SELECT p_partkey, round(1.0 - levenshtein(a,b)/greatest(length(a),length(b)),6) AS edit_sim,
  round(len(list_intersect(ga,gb))/len(list_distinct(list_concat(ga,gb))),6) AS char3_jaccard, array_to_string(gp,'|') AS padded4
FROM (SELECT p_partkey, a, b, list_distinct(list_transform(range(1,length(replace(a,' ',''))-1), lambda i: substr(replace(a,' ',''),i,3))) AS ga,
  list_distinct(list_transform(range(1,length(replace(b,' ',''))-1), lambda i: substr(replace(b,' ',''),i,3))) AS gb,
  list_transform(range(1,length(a)+2-2), lambda i: substr('^'||replace(a,' ','_')||'$',i,4)) AS gp
 FROM (SELECT p_partkey, p_name AS a, lower(p_type)||' '||lower(p_name) AS b FROM part))""")
def name_similarity(v):
    a, b = F.col("p_name"), F.concat_ws(" ", F.lower("p_type"), F.lower("p_name"))
    return v.raw("part").select(
        "p_partkey", F.round(text.edit_similarity(a, b), 6).alias("edit_sim"),
        F.round(text.set_jaccard(text.char_ngrams(a), text.char_ngrams(b)), 6).alias("char3_jaccard"),
        F.array_join(text.padded_ngrams(a), "|").alias("padded4"))


@query("distance_bearing_compass", f"""
SELECT address_id, round(d,3) AS d, round(b,3) AS bearing, (['N','NE','E','SE','S','SW','W','NW'])[((floor((b+22.5)/45))::INTEGER % 8)+1] AS compass,
  (round_even(d/10.0,0)*10)::BIGINT AS d10
FROM (SELECT address_id, {dist('geocoder_x','geocoder_y','tx','ty')} AS d, CASE WHEN tx=geocoder_x AND ty=geocoder_y THEN 0 ELSE
  (degrees(atan2(tx-geocoder_x, ty-geocoder_y)) + 360.0) % 360.0 END AS b FROM w_pin JOIN w_point USING (address_id))""")
def distance_bearing_compass(v):
    j = v.pin().join(v.place_point(), "address_id")
    a = (F.col("geocoder_x"), F.col("geocoder_y"), F.col("tx"), F.col("ty"))
    return (j.withColumn("dd", geo.distance(*a)).withColumn("bb", geo.bearing(*a)).select(
        "address_id", F.round("dd", 3).alias("d"), F.round("bb", 3).alias("bearing"),
        geo.compass(F.col("bb")).alias("compass"), geo.round10(F.col("dd")).alias("d10")))


@query("timestamp_forms", """
SELECT o_orderkey, CASE o_orderkey%5 WHEN 0 THEN epoch_us(d)-19800000000 WHEN 1 THEN epoch_us(d) WHEN 2 THEN epoch_us(d)-19800000000
  WHEN 3 THEN epoch_us(date_trunc('day',d))-19800000000 ELSE epoch_us(date_trunc('day',d))-19800000000 END AS us
FROM (SELECT o_orderkey, o_orderdate + (o_orderkey%86400)*INTERVAL 1 SECOND AS d FROM orders)""")
def timestamp_forms(v):
    """Five written forms of an instant: local, Z, offset, date only, and an unparsable tail."""
    k = F.col("o_orderkey")
    d = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(
        secs=(k % 86400).cast("decimal(18,6)"))
    plain, iso = F.date_format(d, "yyyy-MM-dd HH:mm:ss"), F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss")
    form = (F.when(k % 5 == 0, plain).when(k % 5 == 1, F.concat(iso, F.lit("Z")))
            .when(k % 5 == 2, F.concat(iso, F.lit("+05:30")))
            .when(k % 5 == 3, F.date_format(d, "yyyy-MM-dd"))
            .otherwise(F.concat(F.date_format(d, "yyyy-MM-dd"), F.lit(" about noon"))))
    return v.raw("orders").select("o_orderkey", F.unix_micros(times.parse_ts(form)).alias("us"))


@query("local_clock_and_recency", """
SELECT visit_id, hour(observed_at + INTERVAL 330 MINUTE) AS local_hour, isodow(observed_at + INTERVAL 330 MINUTE)-1 AS local_weekday,
  round(greatest(0,(epoch_us(TIMESTAMP '2024-02-01')-epoch_us(observed_at))/86400e6),6) AS age_days,
  round(pow(0.5, greatest(0,(epoch_us(TIMESTAMP '2024-02-01')-epoch_us(observed_at))/86400e6)/30.44::DOUBLE/18.0::DOUBLE),6) AS recency FROM w_visit""")
def local_clock_and_recency(v):
    at = F.lit("2024-02-01 00:00:00").cast("timestamp")
    t = F.col("observed_at")
    return v.visit().select(
        "visit_id", times.local_hour(t).cast("long").alias("local_hour"),
        times.local_weekday(t).cast("long").alias("local_weekday"),
        F.round(times.age_days(t, at), 6).alias("age_days"),
        times.recency_factor(t, at, F.lit("street")).alias("recency"))


@query("hash_keys", """
SELECT address_id, 'c-'||substr(sha1('frozen_baseline|'||address_id||'|baseline:x'),1,12) AS candidate_id,
  (list_sum(list_transform(string_split(sha1(account_id::VARCHAR),''), lambda c: instr('0123456789abcdef', c)-1))::BIGINT % 5)::INTEGER AS inner_fold
FROM w_address""")
def hash_keys(v):
    return v.address().select(
        "address_id",
        digest.candidate_id(F.lit("frozen_baseline"), F.col("address_id"), F.lit("baseline:x")).alias("candidate_id"),
        digest.sha1_mod5(F.col("account_id")).alias("inner_fold"))


@query("json_payload", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json_payload(v):
    return v.raw("events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("reason_terms", """
SELECT reason, count(*) AS n FROM (SELECT unnest(reason_codes) AS reason FROM w_ev) GROUP BY 1""")
def reason_terms(v):
    from placeproof.plans import belief
    return (belief.evidence_stage(v).select(F.explode("reason_codes").alias("reason"))
            .groupBy("reason").agg(F.count("*").alias("n")))


@query("script_mix", """
SELECT script, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(address_text,'[\\x{0C80}-\\x{0CFF}]') THEN 'kannada'
  WHEN regexp_matches(address_text,'[\\x{0900}-\\x{097F}]') THEN 'devanagari' ELSE 'latin' END AS script FROM w_address) GROUP BY 1""")
def script_mix(v):
    return v.address().groupBy(text.script_class(F.col("address_text")).alias("script")).agg(
        F.count("*").alias("n"))
