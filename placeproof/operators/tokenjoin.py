"""Token-overlap joins through an inverted index."""
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeproof.session import checkpoint

SLOTS = 1 << 20                                         # counters of tokens by hash, whatever the vocabulary
DIGEST = 8                                              # longs of a set's parity digest


def token_index(df: DataFrame, id_col: str, toks: str, keep: list[str]) -> DataFrame:
    """One row per (id, distinct token)."""
    return df.select(id_col, *keep, F.explode(F.array_distinct(F.col(toks))).alias("token"))


def overlap(left: DataFrame, right: DataFrame, left_id: str, right_id: str,
            scope: list[str]) -> DataFrame:
    """Number of shared tokens per (left, right) pair in the same scope."""
    return (left.join(right, [*scope, "token"])
            .groupBy(*scope, left_id, right_id).agg(F.count("*").alias("shared")))


def _slot_counts(sets: DataFrame) -> np.ndarray:
    """How many tokens of all sets (_s) fall into each of SLOTS slots."""
    found = (sets.select(F.explode("_s").alias("token")).groupBy(F.pmod("token", F.lit(SLOTS)).cast("int").alias("slot"))
             .agg(F.count("*").alias("n")).toArrow())
    out = np.zeros(SLOTS, np.int64)
    out[found["slot"].to_numpy()] = found["n"].to_numpy()
    return np.minimum(out, np.iinfo(np.int32).max).astype(np.int32)


def _sorted(part: pa.RecordBatch, counts: np.ndarray, threshold: float) -> tuple[np.ndarray, ...]:
    """Of the sets (_s) of a batch: n of each; row, pos and token of every token, rarest slots first; whether it is one of the first n - ceil(t * n) + 1 and may meet another."""
    token = part["_s"].flatten().to_numpy()
    n = part["_s"].value_lengths().to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    pos = np.arange(len(token)) - np.repeat(np.cumsum(n) - n, n)
    df = counts[token % SLOTS]
    order = np.lexsort((token, df, row))
    most = n - np.ceil(n * threshold - 1e-9).astype(np.int64) + 1
    keep = (pos < most[row]) & (df[order] > 1)             # a token that is alone in its slot meets none
    return n, row, pos, token[order], keep


def _prefixes(sets: DataFrame, counts: Broadcast, threshold: float) -> DataFrame:
    """(node, n, pos, token, prior) of the first n - ceil(t * n) + 1 tokens of each set (node, _s), rarest slots first; prior is the token before."""
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n, row, pos, token, keep = _sorted(part, counts.value, threshold)
                out = row[keep]
                prior = pa.array(np.roll(token, 1)[keep], mask=pos[keep] == 0)
                yield pa.RecordBatch.from_arrays([part["node"].take(pa.array(out)), pa.array(n[out].astype(np.int32)), pa.array(pos[keep].astype(np.int32)),
                                                  pa.array(token[keep]), prior], ["node", "n", "pos", "token", "prior"])
    return sets.select("node", "_s").mapInArrow(first, "node long, n int, pos int, token long, prior long")


def _along(sets: DataFrame, counts: Broadcast, threshold: float) -> DataFrame:
    """The same prefixes as (token, pos) beside all columns of their set; its tokens (_s) are in the order of the positions."""
    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, row, pos, token, keep = _sorted(batch, counts.value, threshold)
            ends = lambda sizes: np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            kept = pa.ListArray.from_arrays(ends(np.bincount(row[keep], minlength=len(n))), pos[keep].astype(np.int32))
            rest = [batch[c] for c in batch.schema.names if c != "_s"]
            yield pa.RecordBatch.from_arrays([*rest, pa.ListArray.from_arrays(ends(n), token), kept], [*(c for c in batch.schema.names if c != "_s"), "_s", "_kept"])
    rest = [f for f in sets.schema if f.name != "_s"]
    out = sets.mapInArrow(ordered, T.StructType([*rest, sets.schema["_s"], T.StructField("_kept", T.ArrayType(T.IntegerType()))]))
    return out.withColumn("pos", F.explode("_kept")).drop("_kept").withColumn("token", F.get("_s", F.col("pos")))


def _digest(tokens: str) -> list[Column]:
    """Parity digest of a set as DIGEST longs: each token flips one bit."""
    def word(i: int) -> Column:
        own = F.filter(tokens, lambda t: F.shiftright(t, 6).bitwiseAND(DIGEST - 1) == i)
        return F.aggregate(own, F.lit(0).cast("long"), lambda g, t: g.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), t.bitwiseAND(63).cast("int"))))
    return [word(i).alias(f"g{i}") for i in range(DIGEST)]


def _possible(x: str, y: str, threshold: float) -> Column:
    """Whether two sets, by their prefixed digest columns, may reach the threshold: digests differ in at most as many bits as the sets do in tokens."""
    apart = reduce(add, [F.bit_count(F.col(f"{x}g{i}").bitwiseXOR(F.col(f"{y}g{i}"))) for i in range(DIGEST)])
    return apart * (1 + threshold) <= (F.col(f"{x}n") + F.col(f"{y}n")) * (1 - threshold) + 1e-6


def _pairs_apart(base: DataFrame, groups: DataFrame, counts: Broadcast, threshold: float, along: int) -> DataFrame:
    """Pairs (ra, rb, their nodes, inter, union, jaccard) with a set of more than `along` tokens: prefixes meet, digests thin the pairs out, then the sets are joined to them."""
    base = base.filter(F.size("_s") >= (along + 1) * threshold - 1e-9)
    # copies draw the same prefix; they fall together where the tokens meet, so their sets need no shuffle to be folded
    pre = _prefixes(base.select(F.col("_h1").alias("node"), "_s"), counts, threshold).repartition("token").dropDuplicates(["token", "node"])
    a, b = (pre.select("token", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "pos", "prior")]) for x in "ab")
    na, nb = F.col("n_a"), F.col("n_b")
    left = F.least(na - F.col("pos_a"), nb - F.col("pos_b"))
    met_before = F.coalesce(F.col("prior_a") == F.col("prior_b"), F.lit(False))        # that token has given the pair already
    cand = (a.join(b, "token")
            .filter((F.col("node_a") < F.col("node_b")) & (F.greatest(na, nb) > along) & (na >= nb * threshold - 1e-9) & (nb >= na * threshold - 1e-9)
                    & (left * (1 + threshold) >= (na + nb) * threshold - 1e-9) & ~met_before)
            .select("node_a", "node_b").distinct())
    cand = checkpoint(cand, release=True)
    digests = checkpoint(base.select("_h1", "_h2", F.size("_s").alias("n"), *_digest("_s")).dropDuplicates(["_h1", "_h2"])
                         .join(groups.select("_h1", "_h2", "rep"), ["_h1", "_h2"]).drop("_h2"), release=True)
    for x in "ab":
        cand = cand.join(digests.select([F.col(c).alias(f"node_{x}" if c == "_h1" else f"{x}_{c}") for c in digests.columns]), f"node_{x}")
    ends = [f([F.struct(F.col(f"{x}_rep").alias("id"), F.col(f"node_{x}").alias("node")) for x in "ab"]) for f in (lambda c: F.least(*c), lambda c: F.greatest(*c))]
    cand = checkpoint(cand.filter(_possible("a_", "b_", threshold) & (F.col("a_rep") != F.col("b_rep")))
                      .select(ends[0]["id"].alias("ra"), ends[0]["node"].alias("_na"), ends[1]["id"].alias("rb"), ends[1]["node"].alias("_nb")), release=True)
    return (cand.join(base.select(F.col("_id").alias("ra"), F.col("_h1").alias("_na"), F.col("_s").alias("sa")), ["ra", "_na"])
            .join(base.select(F.col("_id").alias("rb"), F.col("_h1").alias("_nb"), F.col("_s").alias("sb")), ["rb", "_nb"])
            .withColumn("inter", F.size(F.array_intersect("sa", "sb")))
            .withColumn("union", F.size("sa") + F.size("sb") - F.col("inter"))
            .withColumn("jaccard", F.col("inter") / F.col("union"))
            .filter(F.col("jaccard") >= threshold)
            .select("ra", "rb", *(["_na", "_nb"] if along else []), "inter", "union", "jaccard").distinct())


def _pairs_along(sets: DataFrame, counts: Broadcast, threshold: float) -> DataFrame:
    """Pairs (ra < rb) of sets (rep, _s, digest, others) that reach the threshold, each compared at the first prefix token that both have: no pair is shuffled."""
    pre = _along(sets, counts, threshold).repartition("token")
    a, b = (pre.select("token", *[F.col(c).alias(f"{x}_{c}") for c in pre.columns if c != "token"]) for x in "ab")
    a, b = (d.withColumn(f"{x}_n", F.size(f"{x}__s")) for d, x in ((a, "a"), (b, "b")))
    na, nb = F.col("a_n"), F.col("b_n")
    left = F.least(na - F.col("a_pos"), nb - F.col("b_pos"))
    before = lambda x: F.get(f"{x}__s", F.col(f"{x}_pos") - 1)
    inter = F.size(F.array_intersect("a__s", "b__s"))
    passed = lambda x: F.slice(f"{x}__s", F.lit(1), F.col(f"{x}_pos"))
    # from cheap to dear: what stands first keeps most pairs from what follows
    met = (a.join(b, "token")
           .filter((F.col("a_rep") < F.col("b_rep")) & (na >= nb * threshold - 1e-9) & (nb >= na * threshold - 1e-9)
                   & (left * (1 + threshold) >= (na + nb) * threshold - 1e-9) & ~F.coalesce(before("a") == before("b"), F.lit(False))
                   & _possible("a_", "b_", threshold) & (inter / (na + nb - inter) >= threshold) & ~F.arrays_overlap(passed("a"), passed("b"))))
    others = [c for c in sets.columns if c not in {"rep", "_s", *(f"g{i}" for i in range(DIGEST))}]
    return met.withColumn("inter", inter).select(
        F.col("a_rep").alias("ra"), F.col("b_rep").alias("rb"), "inter", (na + nb - F.col("inter")).alias("union"),
        (F.col("inter") / (na + nb - F.col("inter"))).alias("jaccard"), *[f"{x}_{c}" for c in others for x in "ab"])


def jaccard_pairs(docs: DataFrame, id_col: str, toks: str, threshold: float,
                  scope: list[str] | None = None, along: int = 0, ends: DataFrame | None = None) -> DataFrame:
    """Exact pairs of distinct token sets with Jaccard >= threshold, and the set groups.

    Returns (pairs, groups, members).  `groups` holds one row per distinct set with its smallest id
    (`rep`) and number of copies; `pairs` relates representatives (ra < rb), so n copies against m
    copies is one row instead of n*m, and nothing is lost: `members` maps every id to its `rep`.

    Tokens are carried as 64-bit hashes, the scope among what is hashed, so sets of different scopes share
    none.  Prefix filtering: with tokens in one global order (rarest first), two sets that reach the
    threshold must share one of their first |s| - ceil(t*|s|) + 1 tokens, and at the first one they share
    enough tokens must be left on both sides (a condition of the join).  So frequent tokens hardly ever
    meet; nothing is capped and no pair is lost.  The order is by counters of a fixed number of slots, so
    whole sets are sorted where they lie and only prefixes are shuffled; the sets themselves are joined to
    the pairs only that small parity digests leave.

    along: sets of up to so many tokens travel with each of their prefix tokens instead, and a pair of such
    sets is compared where they first meet.  That takes disk in proportion to the sets, whatever the number
    of pairs, and is worth it for short sets that stand in many pairs.  The pairs then also have a_copies and
    b_copies, and of `ends` (rows with the id column) the columns of both ends, a_ and b_ before their names.
    """
    scope = scope or []
    ids = F.array_sort(F.array_distinct(F.transform(F.col(toks), lambda t: F.xxhash64(*scope, t))))
    base = docs.select(*scope, F.col(id_col).alias("_id"), ids.alias("_s"))
    key = [*scope, "_h1", "_h2"]
    # the filter stands behind the checkpoint: before it, the optimizer would work out the sets twice
    base = checkpoint(base.withColumn("_h1", F.xxhash64("_s")).withColumn("_h2", F.xxhash64(F.lit(7), "_s"))).filter(F.size("_s") > 0)
    groups = base.groupBy(*key).agg(F.min("_id").alias("rep"), F.count("*").alias("copies"), F.max(F.size("_s")).alias("n_tokens"))
    groups = checkpoint(groups)
    members = base.join(groups.select(*key, "rep"), key).select(F.col("_id").alias(id_col), "rep")
    counts = base.sparkSession.sparkContext.broadcast(_slot_counts(base))
    about = groups.select("_h1", "_h2", "rep", "copies")
    if ends is not None:
        about = about.join(ends.withColumnRenamed(id_col, "rep"), "rep")
    found = []
    if along:
        sets = base.filter(F.size("_s") <= along).groupBy("_h1", "_h2").agg(F.any_value("_s").alias("_s"))
        found.append(_pairs_along(sets.join(about, ["_h1", "_h2"]).drop("_h1", "_h2").withColumns({f"g{i}": g for i, g in enumerate(_digest("_s"))}), counts, threshold))
    if not along or (groups.agg(F.max("n_tokens")).first()[0] or 0) > along:
        pairs = _pairs_apart(base, groups, counts, threshold, along)
        if along:
            for x in "ab":
                sides = about.drop("_h2").select([F.col(c).alias({"rep": f"r{x}", "_h1": f"_n{x}"}.get(c, f"{x}_{c}")) for c in about.columns if c != "_h2"])
                pairs = pairs.join(sides, [f"r{x}", f"_n{x}"])
        found.append(pairs.drop("_na", "_nb"))
    return reduce(DataFrame.unionByName, found), groups.select(*scope, "rep", "copies", "n_tokens"), members


def contains_join(texts: DataFrame, names: DataFrame, text_col: str, name_col: str,
                  scope: list[str] | None = None, n: int = 3) -> DataFrame:
    """Rows of `texts` x `names` where the text contains the name, without a nested-loop join.

    A name occurs in a text only if the name's first n characters do, so both sides meet in an
    equi-join on distinct n-grams and the exact test filters.  A name shorter than n is itself a gram
    of its length, so it meets the texts' grams of that length.  Empty names match nothing.
    """
    scope = scope or []

    def meet(size: int, own: DataFrame) -> DataFrame:
        grams = F.array_distinct(F.transform(
            F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text_col) - (size - 1))),
            lambda i: F.substring(text_col, i, F.lit(size))))
        t = texts.withColumn("_g", F.explode(grams))
        m = own.withColumn("_g", F.substring(name_col, 1, size))
        return t.join(m, [*scope, "_g"]).filter(F.contains(F.col(text_col), F.col(name_col))).drop("_g")
    out = meet(n, names.filter(F.length(name_col) >= n))
    for size in range(1, n):
        out = out.unionByName(meet(size, names.filter(F.length(name_col) == size)))
    return out


def jaccard_lookup(queries: DataFrame, records: DataFrame, threshold: float, scope: list[str],
                   qid: str = "qid", rid: str = "rid") -> DataFrame:
    """Pairs (query, record) in one scope with token-set Jaccard >= threshold.

    Both sides carry `toks` (distinct, sorted).  Record texts are folded before the join, so copies
    of one record cost one row; the smallest id stands for them.
    """
    r = records.groupBy(*scope, "toks").agg(F.min(rid).alias(rid), F.count("*").alias("copies"))
    freq = (r.select(*scope, F.explode("toks").alias("token")).groupBy(*scope, "token")
            .agg(F.count("*").alias("_df")))

    def prefix(df, key):
        long = df.select(*scope, key, F.size("toks").alias("_n"), F.explode("toks").alias("token"))
        ranked = long.join(freq, [*scope, "token"], "left").groupBy(*scope, key, "_n").agg(
            F.sort_array(F.collect_list(F.struct(F.coalesce("_df", F.lit(0)).alias("_df"), "token"))).alias("_o"))
        keep = (F.col("_n") - F.ceil(F.col("_n") * threshold - 1e-9) + 1).cast("int")
        return ranked.select(*scope, key, F.explode(F.slice("_o", 1, keep)).alias("_p")).select(
            *scope, key, F.col("_p.token").alias("token"))

    pairs = prefix(queries, qid).join(prefix(r, rid), [*scope, "token"]).select(qid, rid).distinct()
    j = (pairs.join(queries.select(qid, F.col("toks").alias("_q")), qid)
         .join(r.select(rid, "copies", F.col("toks").alias("_r")), rid))
    inter = F.size(F.array_intersect("_q", "_r"))
    return (j.withColumn("jaccard", inter / (F.size("_q") + F.size("_r") - inter))
            .filter(F.col("jaccard") >= threshold))
