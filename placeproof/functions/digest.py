"""Row and table digests."""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_digest(cols: list[str]) -> Column:
    """sha256 of the canonical (name-sorted) JSON of a row."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(cols)]),
                            {"ignoreNullFields": "false"}), 256)


def candidate_id(arm: Column, address_id: Column, source_ref: Column) -> Column:
    return F.concat(F.lit("c-"), F.substring(
        F.sha1(F.concat_ws("|", arm, address_id.cast("string"), source_ref)), 1, 12))


def sha1_mod5(key: Column) -> Column:
    """sha1(key) as an integer mod 5: 16 = 1 (mod 5), so the digit sum decides."""
    digits = F.split(F.sha1(key.cast("string")), "")
    return F.aggregate(
        F.transform(F.filter(digits, lambda d: d != ""), lambda d: F.conv(d, 16, 10).cast("int")),
        F.lit(0), lambda a, d: a + d) % 5


def attestation(df: DataFrame, digest_col: str) -> DataFrame:
    """Row count and order-independent table digest.

    Each sha256 is cut into four 60-bit words which are summed modulo 2^60: the sums merge map-side
    in constant memory, do not depend on row order, and unlike xor they see repeated rows.
    """
    words = [F.sum(F.conv(F.substring(digest_col, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)"))
             for i in range(4)]
    modulus = F.lit(1 << 60).cast("decimal(38,0)")
    return df.agg(
        F.count("*").alias("n_rows"),
        F.sha2(F.concat_ws("-", *[(F.coalesce(w, F.lit(0).cast("decimal(38,0)")) % modulus)
                                  .cast("decimal(38,0)").cast("string") for w in words]), 256)
        .alias("table_digest"))
