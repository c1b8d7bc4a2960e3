"""Typed reads and the logical tables every job works on.

`Views` binds the logical tables (address, locality, landmark, pin, visit, trace, observation ...) to
the parquet tables at hand.  Each method declares a DataFrame; but for localities and landmarks, which are stages, nothing is read
until an action runs, so column pruning and filters reach the scans.
"""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeproof.functions import geo
from placeproof.sources.stages import stage

FACTS = {"customer", "events", "lineitem", "documents"}
KAN_NEAR = "ಹತ್ತಿರ"   # "near", written after the noun

# Explicit CSV schemas of the reference tables (header row, all typed at the scan).
CSV_SCHEMAS = {
    "towns": "town_id string, town_name string, address_style string, approx_radius_m int",
    "localities": "locality_id string, town_id string, locality_name string, pincode string, "
                  "centroid_x double, centroid_y double",
    "landmarks_poi": "poi_id string, town_id string, landmark_type string, name string, "
                     "x double, y double",
    "agents": "agent_id string, channel string, language_team string, town_id string, "
              "tenure_months double, shift string",
    "lenders": "lender_id string, lender_name string, lender_type string, "
               "kyc_address_format string",
    "surveyed_addresses": "address_id string, surveyed_x double, surveyed_y double",
    "addresses": "address_id string, account_id string, address_type string, source string, "
                 "added_date date, town_id string, address_text string",
    "baseline_geocodes": "address_id string, geocoder_x double, geocoder_y double, "
                         "precision string",
    "field_visits": "visit_id string, account_id string, address_id string, agent_id string, "
                    "visit_date date, start_ts timestamp, checkin_ts timestamp, checkin_x double, "
                    "checkin_y double, gps_accuracy_m double, dwell_s int, outcome string, "
                    "ptp_id string, remark string, photo_hash string",
    "visit_gps_points": "visit_id string, seq int, point_ts timestamp, x int, y int, "
                        "accuracy_m int",
    "accounts": "account_id string, lender_id string, portfolio string, income_type string, "
                "town_id string, preferred_language string, bucket_start string, dpd_start int, "
                "emi_amount double, overdue_start double, outstanding double, "
                "salary_credit_day int, bureau_score_band string, other_active_loans int, "
                "paid_other_lenders_30d boolean, last_bounce_reason string, "
                "ability_to_pay_estimate double, prev_ptp_count int, prev_ptp_broken int, "
                "dialling_arm string",
    "splits": "account_id string, split string",
}
UNIQUE_KEYS = {"towns": ["town_id"], "localities": ["locality_id"], "landmarks_poi": ["poi_id"],
               "agents": ["agent_id"], "lenders": ["lender_id"], "addresses": ["address_id"],
               "baseline_geocodes": ["address_id"], "field_visits": ["visit_id"],
               "visit_gps_points": ["visit_id", "seq"], "accounts": ["account_id"],
               "splits": ["account_id"], "surveyed_addresses": ["address_id"]}


def read_csv(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Read one reference CSV with its declared schema; malformed cells become null."""
    return (spark.read.schema(CSV_SCHEMAS[table]).option("header", True)
            .option("mode", "PERMISSIVE").csv(path))


def hardened_fixes(raw: DataFrame) -> DataFrame:
    """GPS fixes from text cells (visit_id, seq, x, y, accuracy_m): a row whose seq, x or y is no number leaves, a bad accuracy becomes null."""
    num = lambda c, kind: F.expr(f"try_cast({c} as {kind})")
    cast = raw.select("visit_id", num("seq", "bigint").alias("seq"), num("x", "double").alias("x"), num("y", "double").alias("y"), num("accuracy_m", "double").alias("accuracy_m"))
    real = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))
    return cast.filter(F.col("seq").isNotNull() & real("x") & real("y")).withColumn("accuracy_m", F.when(real("accuracy_m"), F.col("accuracy_m")))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that violate a declared key (empty when the key holds)."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def _cell_x(name):
    return (F.ascii(name) + F.ascii(F.substring(name, 2, 1))) % 9


def _cell_y(name):
    return (F.length(name) * 3 + F.ascii(F.substring(name, -1, 1))) % 9


def _town_x(town_no):
    return (town_no % 50) * 20000.0


def _town_y(town_no):
    return F.floor(town_no / 50) * 20000.0


def _pincode(town_no, name):
    return F.concat(F.lit("5"), F.lpad(
        ((town_no % 6000) * 16 + (_cell_x(name) * 9 + _cell_y(name)) % 16).cast("string"), 5, "0"))


class Views:
    """Logical tables over one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def raw(self, table: str) -> DataFrame:
        """Scan of one table.

        A fact table that arrives as fewer splits than there are cores (one small file, say) is spread
        once, so the text and scoring work above it is not tied to one core.  With as many splits as
        cores, the normal case on a cluster, nothing is added to the plan.
        """
        df = self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet")
        if table in FACTS:
            cores = self.spark.sparkContext.defaultParallelism
            if df._jdf.rdd().getNumPartitions() < cores:
                df = df.repartition(cores)
        return df

    # ---- reference tables --------------------------------------------------------------------
    def town(self) -> DataFrame:
        n, r = self.raw("nation"), self.raw("region")
        return (n.join(r, n.n_regionkey == r.r_regionkey)
                .select(F.concat(F.lit("T"), "n_nationkey").alias("town_id"),
                        F.col("n_name").alias("town_name"), F.col("r_name").alias("region_name")))

    def _named_parts(self) -> DataFrame:
        return self.raw("part").select(
            "p_partkey", F.col("p_name").alias("name"), "p_type", "p_brand",
            (F.col("p_partkey") % 25 + 25 * F.floor(F.col("p_partkey") / 66667)).alias("town_no"))

    def locality(self) -> DataFrame:
        """One row per (town, place name), as a stage.

        Text work on names would else be pushed below the grouping and run once per part instead of once per name.
        """
        return stage(self, "localities", self._localities)

    def _localities(self) -> DataFrame:
        t, n = F.col("town_no"), F.col("name")
        cell = _cell_x(n) * 9 + _cell_y(n)
        return (self._named_parts().groupBy("town_no", "name").agg(F.count("*").alias("n_parts"))
                .select(
            F.concat(F.lit("L"), t, F.lit("-"), F.replace(n, F.lit(" "), F.lit("_")))
            .alias("locality_id"),
            F.concat(F.lit("T"), t).alias("town_id"),
            F.concat(n, F.when(cell % 2 == 0, F.lit(" nagar")).otherwise(F.lit(" colony")))
            .alias("locality_name"),
            _pincode(t, n).alias("pincode"),
            (_town_x(t) + _cell_x(n) * 400.0 + 200.0 + (t % 7) * 11.0).alias("cx"),
            (_town_y(t) + _cell_y(n) * 400.0 + 200.0 + (t % 5) * 13.0).alias("cy")))

    def landmark(self) -> DataFrame:
        """One row per (town, type, brand), as a stage for the reason given in `locality`."""
        return stage(self, "landmarks", self._landmarks)

    def _landmarks(self) -> DataFrame:
        t = F.col("town_no")
        return (self._named_parts().groupBy("town_no", "p_type", "p_brand")
                .agg(F.min("p_partkey").alias("lo"), F.max("p_partkey").alias("hi"))
                .select(
            F.concat(F.lit("P"), t, F.lit("-"), "p_type", F.lit("-"), "p_brand").alias("poi_id"),
            F.concat(F.lit("T"), t).alias("town_id"), F.col("p_type").alias("landmark_type"),
            F.concat_ws(" ", "p_type", "p_brand").alias("poi_name"),
            (_town_x(t) + F.floor(F.col("lo") / 25) * 131 % 3600).alias("px"),
            (_town_y(t) + F.floor(F.col("hi") / 25) * 57 % 3600).alias("py")))

    def _address_base(self) -> DataFrame:
        """Customers with the part of their number.

        Both sides grow, and a part file of a few MB is millions of rows: by the size of the file alone the keys of all parts would be
        sent through the driver, once for every use of the addresses in a query.  So the two are merged.
        """
        c = self.raw("customer").select("c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal")
        p = self.raw("part").select("p_partkey", "p_name", "p_type", "p_brand")
        k = F.col("c_custkey")
        return c.join(p.hint("merge"), k == p.p_partkey, "left").withColumn(
            "town_no", F.col("c_nationkey") + 25 * F.floor(k / 50000))

    def address(self) -> DataFrame:
        k, name, t = F.col("c_custkey"), F.col("p_name"), F.col("town_no")
        lm = F.concat_ws(" ", "p_type", "p_brand")
        house = F.when(k % 6 == 5, "").otherwise(F.concat(F.lit("H.No "), k % 40, F.lit(", ")))
        cross = F.when(k % 4 == 0, "").otherwise(F.concat(k % 12, F.lit("th Cross ")))
        place = F.when(k % 8 == 7, "Post Box").otherwise(F.concat(
            name, F.when(k % 3 == 0, " Ngr").when(k % 3 == 1, " Rd").otherwise("")))
        relation = (F.when(k % 5 == 0, F.concat(F.lit(" near "), lm))
                    .when(k % 5 == 1, F.concat(F.lit(", opp "), lm))
                    .when(k % 5 == 2, F.concat(F.lit(" "), lm, F.lit(" " + KAN_NEAR)))
                    .otherwise(""))
        pin = (F.when(k % 7 == 0, "").when(k % 7 == 1, " 999999")
               .otherwise(F.concat(F.lit(" - "), _pincode(t, name))))
        text = F.when((k % 10).isin(3, 4), F.concat(F.lit("Main Bazaar, "), name)).otherwise(
            F.concat(house, cross, place, relation, pin))
        return self._address_base().select(
            k.alias("address_id"), F.floor(k / 2).alias("account_id"),
            F.when(k % 97 == 96, "OUT").otherwise(F.concat(F.lit("T"), t)).alias("town_id"),
            F.when(F.col("c_mktsegment") == "MACHINERY", "office")
            .when(F.col("c_mktsegment") == "HOUSEHOLD", "permanent_native")
            .otherwise("current").alias("address_type"),
            F.date_add(F.lit("2023-10-01").cast("date"), (k * 7 % 120).cast("int"))
            .alias("added_date"),
            text.alias("address_text"))

    def place_point(self) -> DataFrame:
        """The true point of each address; used for check-ins and as evaluation truth only."""
        e = self.raw("embeddings").select(
            "vec_id", F.get("embedding", F.lit(0)).cast("double").alias("e0"),
            F.get("embedding", F.lit(1)).cast("double").alias("e1"))
        k, t, n = F.col("c_custkey"), F.col("town_no"), F.col("p_name")
        return (self._address_base().join(e, k == e.vec_id, "left").select(
            k.alias("address_id"),
            F.round(_town_x(t) + _cell_x(n) * 400.0 + 200.0
                    + F.coalesce(F.col("e0") * 1000.0, (k * 37 % 300 - 150).cast("double")), 3)
            .alias("tx"),
            F.round(_town_y(t) + _cell_y(n) * 400.0 + 200.0
                    + F.coalesce(F.col("e1") * 1000.0, (k * 91 % 300 - 150).cast("double")), 3)
            .alias("ty")))

    def pin(self) -> DataFrame:
        """Baseline geocodes with a stated precision."""
        k = F.col("address_id")
        r = F.when(k % 4 == 0, 10).when(k % 4 == 1, 60).when(k % 4 == 2, 200).otherwise(600)
        return (self.place_point().filter(k % 13 != 0).select(
            "address_id",
            F.round(F.col("tx") + k * 53 % (2 * r + 1) - r, 3).alias("geocoder_x"),
            F.round(F.col("ty") + k * 29 % (2 * r + 1) - r, 3).alias("geocoder_y"),
            F.when(k % 4 == 0, "rooftop").when(k % 4 == 1, "street").when(k % 4 == 2, "locality")
            .otherwise("pincode").alias("precision")))

    def surveyed(self) -> DataFrame:
        return (self.place_point().filter("address_id % 10 = 3")
                .select("address_id", F.col("tx").alias("surveyed_x"),
                        F.col("ty").alias("surveyed_y")))

    def split(self) -> DataFrame:
        return (self.raw("customer").select(F.floor(F.col("c_custkey") / 2).alias("account_id"))
                .distinct()
                .withColumn("split", F.when(F.col("account_id") * 7 % 20 < 14, "train")
                            .when(F.col("account_id") * 7 % 20 < 17, "validation")
                            .otherwise("test")))

    def account(self) -> DataFrame:
        """Accounts with their lender and home town (those of the account's first record)."""
        first = self.raw("customer").groupBy(F.floor(F.col("c_custkey") / 2).alias("account_id")).agg(
            F.min_by(F.struct("c_nationkey", "c_custkey"), "c_custkey").alias("m"))
        return first.select("account_id", F.col("m.c_nationkey").alias("lender_id"),
                            F.concat(F.lit("T"), F.col("m.c_nationkey") + 25 * F.floor(F.col("m.c_custkey") / 50000)).alias("account_town"))

    def lender(self) -> DataFrame:
        """Lenders and the address format each asks for."""
        r = self.raw("region").select("r_regionkey", F.lower("r_name").alias("address_format"))
        n = self.raw("nation").select(F.col("n_nationkey").alias("lender_id"), "n_regionkey")
        return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("lender_id", "address_format")

    def agent(self) -> DataFrame:
        """Collectors: channel, and a home town for those in the field."""
        k = F.col("s_suppkey")
        field = k % 3 != 0
        return self.raw("supplier").filter(k.between(1, 8)).select(
            F.concat(F.lit("A"), k).alias("agent_id"), F.when(field, "field").otherwise("tele").alias("channel"),
            F.when(field, F.concat(F.lit("T"), "s_nationkey")).alias("home_town"))

    def point(self) -> DataFrame:
        """Zoned points; the plane grows with the ids, so density does not."""
        tile = F.floor(F.col("vec_id") / 4096) * 10000
        return self.raw("embeddings").select(
            F.col("vec_id").alias("id"), F.concat(F.lit("G"), "label").alias("zone"),
            F.round(F.get("embedding", F.lit(0)).cast("double") * 1000 + tile, 3).alias("x"),
            F.round(F.get("embedding", F.lit(1)).cast("double") * 1000 + tile, 3).alias("y"))

    # ---- event tables ------------------------------------------------------------------------
    def visit(self, events: DataFrame | None = None) -> DataFrame:
        """Field visits without coordinates (one row per event, batch or stream)."""
        e = self.raw("events") if events is None else events
        e = e.withColumn("ts", F.col("ts").cast("timestamp"))
        k = F.get_json_object("props", "$.k").cast("int")
        et, v = F.col("event_type"), F.col("value")
        e = e.withColumn("k", k)
        k = F.col("k")
        return e.select(
            F.col("event_id").alias("visit_id"), F.col("user_id").alias("address_id"),
            F.floor(F.col("user_id") / 2).alias("account_id"),
            F.concat(F.lit("A"), k % 9).alias("agent_id"),
            (F.col("ts") - F.make_dt_interval(
                secs=(k * 13 % 1800 - 20).cast("decimal(18,6)"))).alias("start_ts"),
            F.col("ts").alias("observed_at"),
            F.when(k % 13 != 0, (F.floor(v * 7) % 60 + 1).cast("double")).alias("gps_accuracy_m"),
            F.when(k % 11 != 0, F.floor(v * 20)).alias("dwell_s"),
            F.when(et == "purchase", F.when(k % 2 == 0, "met_borrower").otherwise("cash_collected"))
            .when(et == "click", "met_family").when(et == "view", "locked_premises")
            .when(et == "signup", "neighbour_says_shifted")
            .otherwise(F.when(k % 2 == 0, "address_not_traceable").otherwise("no_such_person"))
            .alias("outcome"),
            F.when(k % 10 == 1, F.concat(F.lit("dup"), k))
            .when(k % 10 != 0, F.concat(F.lit("m"), F.col("event_id"))).alias("photo_hash"),
            F.when(k % 6 == 0, F.concat(F.lit("collected Rs "), F.format_number(k * 150 + 500, 0)))
            .when(k % 6 == 1, "house locked near red plate")
            .when(k % 6 == 2, "shifted to other town").when(k % 6 == 3, "")
            .when(k % 6 == 4, "ಮನೆ ಮುಚ್ಚಿದೆ").otherwise("met at ECONOMY Brand#1").alias("remark"),
            "k")

    def trace(self) -> DataFrame:
        """GPS points of a visit, relative to the visited place, in metres."""
        return self.raw("lineitem").select(
            F.col("l_orderkey").alias("visit_id"),
            (F.col("l_linenumber") * 100000 + F.col("l_partkey") % 100000).alias("seq"),
            F.col("l_linenumber").alias("raw_seq"),
            (F.col("l_shipdate").cast("timestamp")
             + F.make_dt_interval(secs=(F.col("l_linenumber") * 37).cast("decimal(18,6)")))
            .alias("point_ts"),
            (F.col("l_partkey") % 31 - 15).cast("int").alias("dx"),
            (F.col("l_suppkey") * 7 % 31 - 15).cast("int").alias("dy"),
            F.col("l_quantity").cast("int").alias("accuracy_m"))

    def trace_summary(self, visits: DataFrame | None = None) -> DataFrame:
        """Per visit (of the given ones): tail point (median of the last three fixes) and whole-trace median."""
        from placeproof.operators.windows import trace_medians
        t = self.trace()
        if visits is not None:
            t = t.join(visits.select("visit_id").distinct(), "visit_id", "left_semi")
        return trace_medians(t)

    def checkin(self, visits: DataFrame | None = None) -> DataFrame:
        """Visits (all, or the given ones) with their raw check-in sample."""
        v, p = self.visit() if visits is None else visits, self.place_point()
        k = F.col("visit_id")
        far = F.when(k % 29 == 0, 300.0).otherwise(0.0)
        known = k % 53 != 0
        # a few visits happened at quite another place
        p = p.withColumnRenamed("tx", "px").withColumnRenamed("ty", "py")
        return (v.join(p, "address_id")
                .withColumn("tx", F.col("px") + F.when(k % 83 == 0, 4000.0).otherwise(0.0))
                .withColumn("ty", F.col("py"))
                .withColumn("checkin_x", F.when(known, F.round(
                    F.col("tx") + (k * 17 % 41 - 20) * 0.7 + far, 3)))
                .withColumn("checkin_y", F.when(known, F.round(
                    F.col("ty") + (k * 23 % 41 - 20) * 0.7, 3))))

    def observation(self, visits: DataFrame | None = None) -> DataFrame:
        """Visits (all, or the given ones) mapped to observations: tail coordinate where a trace exists, else check-in."""
        c = self.checkin(visits).join(self.trace_summary(visits), "visit_id", "left")
        neg = F.col("outcome").isin("no_such_person", "address_not_traceable")
        amb = F.col("outcome").isin("neighbour_says_shifted", "locked_premises")
        tail = F.col("tail_n").isNotNull() & F.col("checkin_x").isNotNull()
        return c.select(
            F.col("visit_id").alias("observation_id"), "address_id", "account_id", "agent_id",
            F.concat(F.lit("device-"), "agent_id").alias("device_id"), "outcome",
            F.when(neg, "process").when(amb, "ambiguous").otherwise("positive")
            .alias("evidence_class"),
            F.when(neg, "negative").when(amb, "ambiguous").otherwise("positive").alias("polarity"),
            F.when(tail, F.round(F.col("tx") + F.col("tail_dx"), 3))
            .otherwise(F.col("checkin_x")).alias("x"),
            F.when(tail, F.round(F.col("ty") + F.col("tail_dy"), 3))
            .otherwise(F.col("checkin_y")).alias("y"),
            F.when(tail, F.concat(F.lit("trace_tail"), "tail_n")).otherwise("checkin")
            .alias("coord_method"),
            F.round(geo.distance(F.col("checkin_x"), F.col("checkin_y"),
                                 F.col("tx") + F.col("med_dx"), F.col("ty") + F.col("med_dy")), 3)
            .alias("trail_agreement_m"),
            "gps_accuracy_m", "dwell_s", "observed_at", F.col("photo_hash").alias("media"),
            "remark", "checkin_x", "checkin_y")
