"""Mixing sources to target weights, with DataFrame operations only.

Documents fall by a hash of their id into blocks of their source; a source has as many blocks as its share of `blocks`.  The blocks of
a source are permuted once per pass, and its draws are the prefix whose words reach the target; the last draw stops inside its block at
one cut document.  A splitting tree deals the draw counts to the output shards: each node splits its vector of source counts by one
multivariate hypergeometric draw, so every shard gets an exact quota per source, and the quotas of all shards add up.  Shards take
disjoint runs of the permuted draws and order their rows by a hash.

What the driver sees is one row per source and the shard quotas; everything else is joins and sums over (source, block) rows, of which
there are at most `blocks` plus one per source.
"""
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placeproof.llm.base import WORD, stage, word_count

#: Small sides up to this many rows are broadcast (about 20 MB); beyond it they are joined by shuffle.
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Mix:
    weights: tuple[float, ...] = (3, 1, 2)
    share: float = 1.5                                  # of all words
    most: int = 2                                       # passes over a source at most
    blocks: int = 16384
    shard_words: int = 4_000_000
    seed: int = 17


def targets(sizes: list[int], mix: Mix) -> list[float]:
    """Words per source, in source order.  A target stops at `most` times its size; the excess is dealt anew by weight."""
    weight = [float(mix.weights[i % len(mix.weights)]) for i in range(len(sizes))]
    cap = [float(mix.most * s) for s in sizes]
    out, free, left = [0.0] * len(sizes), list(range(len(sizes))), mix.share * sum(sizes)
    while free:
        whole = sum(weight[i] for i in free)
        over = [i for i in free if left * weight[i] / whole > cap[i]]
        if not over:
            for i in free:
                out[i] = left * weight[i] / whole
            break
        for i in over:
            out[i] = cap[i]
        left -= sum(cap[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return out


def shard_quotas(draws: list[int], shards: int, seed: int) -> list[tuple[int, int, int, int]]:
    """(source, first draw, end, shard): the leaves of the splitting tree as runs of each source's draws."""
    found: list[tuple[int, int, int, int]] = []
    at = [0] * len(draws)
    todo = [(np.array(draws, np.int64), 0, shards)]
    while todo:                                         # depth first, left child first: leaves come in shard order
        have, lo, hi = todo.pop()
        if hi - lo == 1:
            for i, n in enumerate(have):
                if n:
                    found.append((i, at[i], at[i] + int(n), lo))
                    at[i] += int(n)
            continue
        mid = (lo + hi) // 2
        left = int(have.sum()) * (mid - lo) // (hi - lo)
        x = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(have, left, method="marginals")
        todo += [(have - x, mid, hi), (x, lo, mid)]
    return found


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _key(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("-"))


def plan(docs: DataFrame, mix: Mix, id_col: str = "doc_id", source: str = "source", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sizes, sources, draws).

    sizes: one row per document with its block; sources: mkey, source_size, target, n_blocks; draws: one row per drawn block and pass
    with shard, words, and for the cut one the last key (`cut_key`) and what each row of that key gives (`cut_words`).
    """
    spark = docs.sparkSession
    sizes = stage(docs.select(F.col(id_col).alias("id"), _key(source).alias("mkey"), word_count(F.col(text)).alias("size")), "mix-sizes")
    found = sorted(sizes.groupBy("mkey").agg(F.sum("size").alias("n")).collect(), key=lambda r: (r["mkey"] == "-", r["mkey"]))
    goal = targets([r["n"] for r in found], mix)
    words = max(1, -(-sum(r["n"] for r in found) // mix.blocks))
    schema = "mkey string, source_size long, target double, goal long, n_blocks long"
    sources = spark.createDataFrame([(r["mkey"], r["n"], t, round(t), max(1, -(-r["n"] // words))) for r, t in zip(found, goal)], schema)
    small = _small(sources, len(found))
    placed = sizes.join(small, "mkey").withColumn("block", _block(mix))
    blocks = placed.groupBy("mkey", "block").agg(F.sum("size").alias("words"), F.first("goal").alias("goal")).filter("words > 0")
    order = W.partitionBy("mkey").orderBy("epoch", F.xxhash64("mkey", "block", "epoch", F.lit(mix.seed)), "block")
    drawn = stage(blocks.select("*", F.explode(F.sequence(F.lit(0), F.lit(mix.most - 1))).alias("epoch"))
                  .withColumn("before", F.sum("words").over(order) - F.col("words")).filter("before < goal")
                  .withColumn("draw", F.row_number().over(order).cast("long") - 1)
                  .select("mkey", "block", "epoch", "draw", F.col("words").alias("block_words"), F.least("words", F.col("goal") - F.col("before")).alias("words")), "mix-draws")
    count = {r["mkey"]: r["n"] for r in drawn.groupBy("mkey").agg(F.count("*").alias("n")).collect()}
    total = sum(round(t) for t in goal)
    shards = max(1, min(-(-total // mix.shard_words), sum(count.values()) // 16))
    runs = shard_quotas([count.get(r["mkey"], 0) for r in found], shards, mix.seed)
    quota = spark.createDataFrame([(found[i]["mkey"], a, b, s) for i, a, b, s in runs], "mkey string, a long, b long, shard int").select(
        "mkey", "shard", F.explode(F.sequence("a", F.col("b") - 1)).alias("draw"))
    # The cut: documents of the one partly drawn block of a source, in hash order, up to the words that are left.
    part = drawn.filter("words < block_words").select("mkey", "block", F.col("words").alias("left_words"), F.col("draw").alias("cut_draw"))
    groups = (placed.join(_small(part, len(found)), ["mkey", "block"]).groupBy("mkey", "cut_draw", "left_words", _place(mix).alias("key"))
              .agg(F.sum("size").alias("n"), F.count("*").alias("rows")))
    run = W.partitionBy("mkey").orderBy("key")
    cut = (groups.withColumn("before", F.sum("n").over(run) - F.col("n")).filter("before < left_words and before + n >= left_words")
           .select("mkey", F.col("cut_draw").alias("draw"), F.col("key").alias("cut_key"), F.floor((F.col("left_words") - F.col("before")) / F.col("rows")).alias("cut_words")))
    return sizes, small, drawn.join(quota, ["mkey", "draw"]).join(cut, ["mkey", "draw"], "left")


def _block(mix: Mix) -> Column:
    return F.pmod(F.xxhash64("id", F.lit(mix.seed)), F.col("n_blocks"))


def _place(mix: Mix) -> Column:
    return F.xxhash64("id", F.lit(mix.seed + 1))


def _taken(mix: Mix) -> Column:
    """Words that one draw takes of a document of its block."""
    place = _place(mix)
    return (F.when(F.col("cut_key").isNull() | (place < F.col("cut_key")), F.col("size"))
            .when(place == F.col("cut_key"), F.least("cut_words", "size")).otherwise(F.lit(0)).cast("long"))


def taken_words(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(id, size, source_size, target, taken) of every row.

    Null and empty texts have size 0 and give nothing; rows with a null source are a source of their own, null ids share a block;
    repeated rows are dealt alike; an empty table gives an empty one.
    """
    sizes, sources, draws = plan(docs, mix, id_col, source, text)
    per_block = draws.groupBy("mkey", "block").agg(F.count(F.when(F.col("cut_key").isNull(), 1)).alias("passes"), F.max("cut_key").alias("cut_key"), F.max("cut_words").alias("cut_words"))
    placed = sizes.join(sources, "mkey").withColumn("block", _block(mix)).join(_small(per_block, mix.blocks), ["mkey", "block"], "left")
    cut = F.when(F.col("cut_key").isNull(), 0).otherwise(_taken(mix))
    return placed.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.coalesce("passes", F.lit(0)) * F.col("size") + cut).alias("taken"))


def mix_rows(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mixed corpus: a row per drawn document and pass, all columns of `docs`, the text of a cut document shortened to its words.

    Rows are dealt to their shards and ordered by hash inside them.  Documents without words are in no draw and leave the mix.
    """
    _, sources, draws = plan(docs, mix, id_col, source, text)
    inner = F.struct(*docs.columns).alias("row")        # own names beside those of the plan
    placed = (docs.select(inner, F.col(id_col).alias("id"), _key(source).alias("mkey"), word_count(F.col(text)).alias("size")).join(sources, "mkey")
              .withColumn("block", _block(mix)).join(_small(draws.select("mkey", "block", "epoch", "shard", "cut_key", "cut_words"), mix.blocks * mix.most), ["mkey", "block"])
              .withColumn("taken", _taken(mix)).filter("taken > 0"))
    body = F.col(f"row.`{text}`")
    short = F.array_join(F.slice(F.regexp_extract_all(body, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), F.lit(1), F.col("taken").cast("int")), "")
    return (placed.repartition("shard").sortWithinPartitions("shard", F.xxhash64("id", "epoch", F.lit(mix.seed)))
            .select(*[(F.when(F.col("taken") < F.col("size"), short).otherwise(body) if c == text else F.col(f"row.`{c}`")).alias(c) for c in docs.columns]))
