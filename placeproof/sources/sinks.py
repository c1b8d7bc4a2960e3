"""Sinks: fixed-order writes, idempotent keyed appends and per-town bundles."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeproof.functions.digest import row_digest
from placeproof.sources.keyed_log import KeyedLog


def write_fixed(df: DataFrame, columns: list[str], path: str, fmt: str = "parquet") -> None:
    """Write exactly these columns in this order; extra columns are ignored."""
    out = df.select(*columns)
    writer = out.write.mode("overwrite")
    (writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path))


def append_keyed(rows: DataFrame, path: str, key: str, order: list[str]) -> None:
    """Append-only keyed insert: keys already stored are ignored, so a replay changes nothing (see `KeyedLog`)."""
    KeyedLog(rows.sparkSession, path, key, order).append(rows)


def town_bundles(addr: DataFrame, cands: DataFrame, as_of: str, valid_days: int = 7) -> DataFrame:
    """One row per (town, address): the bundle content, with validity and a digest per row.

    A bundle is a partition of files (`write_bundles`), not one nested value, so a town of any size is
    written by many tasks.
    """
    until = F.date_add(F.lit(as_of).cast("date"), valid_days)
    j = addr.select("address_id", "town_id", "address_text").join(cands, "address_id", "left")
    rows = j.groupBy("town_id", "address_id", "address_text").agg(F.sort_array(F.collect_list(F.struct(
        "arm", "source_ref", "x", "y", "granularity"))).alias("candidates")).withColumn("valid_until", until)
    return rows.withColumn("digest", row_digest(["address_id", "town_id", "candidates", "valid_until"]))


def bundle_parts(rows: DataFrame, localities: DataFrame, landmarks: DataFrame, radius_map: list[dict], built: str, valid_days: int = 7) -> DataFrame:
    """(town_id, part, content, built, valid_until, digest): everything a town's bundle holds, one JSON row per entry.

    Addresses with their candidates, the town's localities and landmarks, and the radius map in every town.
    """
    def part(df: DataFrame, name: str, town, cols: list[str]) -> DataFrame:
        return df.select(town.alias("town_id"), F.lit(name).alias("part"), F.to_json(F.struct(*[F.col(c) for c in sorted(cols)]), {"ignoreNullFields": "false"}).alias("content"))
    own = F.col("town_id")
    strata = F.array(*[F.struct(*[F.lit(x).alias(c) for c, x in r.items()]) for r in radius_map])
    towns = rows.select("town_id").distinct().select("town_id", F.explode(strata).alias("r")).select("town_id", "r.*")
    out = (part(rows, "address", own, ["address_id", "address_text", "candidates"]).unionByName(part(localities, "locality", own, ["locality_id", "locality_name", "pincode", "cx", "cy"]))
           .unionByName(part(landmarks, "landmark", own, ["poi_id", "poi_name", "px", "py"])).unionByName(part(towns, "radius", own, list(radius_map[0]))))
    return out.withColumn("built", F.lit(built).cast("date")).withColumn("valid_until", F.date_add(F.lit(built).cast("date"), valid_days)).withColumn(
        "digest", F.sha2(F.concat_ws("|", "town_id", "part", "content", "valid_until"), 256))


def write_bundles(bundle: DataFrame, path: str) -> None:
    """One folder per town, appended, so that an older bundle of a town stays readable beside the newer."""
    bundle.write.mode("append").partitionBy("town_id").parquet(path)


def rebuild_mismatches(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys whose digest differs between two manifests, or that one of them lacks."""
    a = old.select(key, F.col("digest").alias("old_digest"))
    b = new.select(key, F.col("digest").alias("new_digest"))
    return a.join(b, key, "full_outer").filter(~F.col("old_digest").eqNullSafe(F.col("new_digest")))
