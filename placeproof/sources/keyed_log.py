"""An append-only keyed table in hash buckets, so that a small batch reads and joins only the part of the log it can touch."""
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placeproof.session import stored

MOST_FOLDERS = 512
NO_DAY = "0001-01-01"


class KeyedLog:
    """First write of a key wins; a replay changes nothing.

    Layout: `path/_bucket=b/` (with `time`: `path/_bucket=b/_day=d/`), and `path/_manifest`, which lists for every append the (bucket, day)
    folders it was going to write, with rows and time range; it is written first, so a folder it names may be missing but none is unknown.  `spark.read.parquet(path)` reads the whole log.

    key: the identity of a row.  order: which of several rows of one key in a batch is the first.  bucket_by: the column whose hash gives
    the bucket; it must be fixed by the key (the key itself, or what the rows are looked up by, such as the address).  time: a timestamp
    that is fixed by the key as well; then a batch reads only the days it has.  Without it a key may come again with another time.

    buckets: to be set by the size of the log (of one of its days, with `time`), and then kept; every append writes a file per folder it touches.

    One writer at a time: two appends that run at once could both add a key.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, order: list[str], bucket_by: str | None = None, buckets: int | None = None, time: str | None = None):
        self.spark, self.path, self.key, self.order = spark, path, key, order
        self.bucket_by, self.buckets, self.time = bucket_by or key, buckets or (4 if time else 16), time

    def _folders(self) -> list[str]:
        return ["_bucket", "_day"] if self.time else ["_bucket"]

    def _placed(self, rows: DataFrame) -> DataFrame:
        out = rows.withColumn("_bucket", F.pmod(F.xxhash64(self.bucket_by), F.lit(self.buckets)).cast("int"))
        return out.withColumn("_day", F.coalesce(F.to_date(self.time), F.lit(NO_DAY).cast("date"))) if self.time else out

    def _held(self) -> DataFrame | None:
        path = f"{self.path}/_manifest"
        return self.spark.read.parquet(path).groupBy(*self._folders()).agg(F.sum("rows").alias("rows")) if stored(self.spark, path) else None

    def _read(self, asked: DataFrame, since: Column | None = None) -> DataFrame | None:
        """The stored rows of the folders that hold any of the asked (bucket[, day]) rows; None where nothing is stored there."""
        held = self._held()
        if held is None:
            return None
        on = [c for c in self._folders() if c in asked.columns]
        hit = held.join(asked.select(*on).distinct(), on, "left_semi").select(*self._folders())
        found = (hit if since is None else hit.filter(since)).limit(MOST_FOLDERS + 1).collect()
        if not found:
            return None
        if len(found) > MOST_FOLDERS:                   # too many single folders: their buckets, at most `buckets` of them
            found = hit.select("_bucket").distinct().collect()
        paths = [p for p in ("/".join([self.path, *[f"{c}={r[c]}" for c in r.asDict()]]) for r in found) if stored(self.spark, p)]
        return self.spark.read.option("basePath", self.path).parquet(*sorted(paths)) if paths else None

    def read(self, keys: DataFrame, like: DataFrame, since=None) -> DataFrame:
        """The stored rows of the given values of `bucket_by`; since: only days from that instant on (with `time`).

        like: a frame with the columns of the log, for the case that nothing is stored yet."""
        late = F.col("_day") >= F.to_date(F.lit(since)) if since is not None and self.time else None
        asked = keys.select(self.bucket_by).distinct()
        rows = self._read(asked.select(F.pmod(F.xxhash64(self.bucket_by), F.lit(self.buckets)).cast("int").alias("_bucket")), late)
        return like.limit(0) if rows is None else rows.join(asked, self.bucket_by, "left_semi").select(*like.columns)

    def touched(self, rows: DataFrame) -> list[str]:
        """The stored files that an append of these rows would read."""
        old = self._read(self._placed(rows))
        return [] if old is None else old.inputFiles()

    def append(self, rows: DataFrame) -> None:
        """Add the rows whose key is new."""
        rest = [c for c in rows.columns if c != self.key]
        first = rows.groupBy(self.key).agg(F.min_by(F.struct(*rest), F.struct(*self.order)).alias("r")).select(self.key, "r.*").select(*rows.columns)
        placed = self._placed(first)
        old = self._read(placed)
        fresh = placed if old is None else placed.join(old.select(self.key), self.key, "left_anti")
        at = F.col(self.time) if self.time else F.lit(None).cast("timestamp")
        listed = placed.groupBy(*self._folders()).agg(F.count("*").alias("rows"), F.min(at).alias("first"), F.max(at).alias("last"))
        listed.coalesce(1).write.mode("append").parquet(f"{self.path}/_manifest")   # at most a row per folder
        fresh.repartition(*self._folders()).write.mode("append").partitionBy(*self._folders()).parquet(self.path)
