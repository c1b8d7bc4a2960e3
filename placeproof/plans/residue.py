"""Residue matchers: name a locality from text in which no whole name token was found."""
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placeproof import policy
from placeproof.functions import text
from placeproof.operators.cosine import cosine_of, cosine_pairs
from placeproof.session import checkpoint

NGRAM = 4
TIE = 1e-9                                              # sums that stand on a rounding tie go up, whatever the order of summation


def residue_addresses(addr: DataFrame, matches: DataFrame) -> DataFrame:
    return addr.join(matches.select("address_id").distinct(), "address_id", "left_anti")


def gram_idf(addr: DataFrame, loc: DataFrame, lm: DataFrame) -> DataFrame:
    """gram -> smoothed idf over address texts, locality names and landmark names."""
    docs = (addr.select("norm").unionAll(loc.select(text.norm_text(F.col("locality_name"))))
            .unionAll(lm.select(text.norm_text(F.col("poi_name")))))
    n = docs.agg(F.count("*").alias("n_docs"))
    df = (docs.select(F.explode(F.array_distinct(text.padded_ngrams(F.col("norm"), NGRAM))).alias("gram"))
          .groupBy("gram").agg(F.count("*").alias("df")))
    return df.withColumn("n_docs", n.scalar()).select(
        "gram", "df", "n_docs", (F.log((F.col("n_docs") + 1) / (F.col("df") + 1)) + 1.0).alias("idf"))


def token_vectors(tokens: DataFrame, idf: DataFrame) -> DataFrame:
    """(token, gram, w, norm): sublinear tf-idf weights of each distinct token's padded grams."""
    tf = (tokens.select("token").distinct().select("token", F.explode(text.padded_ngrams(F.col("token"), NGRAM)).alias("gram"))
          .groupBy("token", "gram").agg(F.count("*").alias("c")))
    nd = idf.agg(F.max("n_docs").alias("nd"))
    v = (tf.join(idf.select("gram", "idf"), "gram", "left")
         .withColumn("w", (1.0 + F.log("c")) * F.coalesce("idf", F.log(nd.scalar() + 1.0) + 1.0)))
    return v.withColumn("norm", F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("token")))).select("token", "gram", "w", "norm")


def name_tokens(loc: DataFrame) -> DataFrame:
    """Distinctive name tokens per locality (generic words removed), with repeats kept as written."""
    t = F.filter(text.tokens(text.norm_text(F.col("locality_name"))), lambda x: ~x.isin(policy.RESIDUE_GENERIC_WORDS))
    return (loc.withColumn("d", t).filter(F.size("d") > 0)
            .select("town_id", "locality_id", F.size("d").alias("n_tok"), F.explode("d").alias("token")))


def token_cosine(a: DataFrame, b: DataFrame, idf: DataFrame) -> DataFrame:
    """(t, q, cos) of name tokens against query tokens: an equi-join on shared grams."""
    va = token_vectors(a, idf).withColumnsRenamed({"token": "t", "w": "wa", "norm": "na"})
    vb = token_vectors(b, idf).withColumnsRenamed({"token": "q", "w": "wb", "norm": "nb"})
    return (va.join(vb, "gram").groupBy("t", "q").agg(
        F.sum(F.col("wa") * F.col("wb")).alias("dot"), F.max("na").alias("na"), F.max("nb").alias("nb"))
        .select("t", "q", F.round(F.col("dot") / (F.col("na") * F.col("nb")), 4).alias("cos")))


def score_names(res: DataFrame, names: DataFrame, sims: DataFrame, sim: str = "cos") -> DataFrame:
    """(address_id, locality_id, score): mean over the name's tokens of the best similarity."""
    q = res.select("address_id", "town_id", F.explode(F.array_distinct("toks")).alias("q"))
    best = (q.join(sims, "q").groupBy("address_id", "town_id", "t").agg(F.max(sim).alias("best")))
    return (best.join(names.withColumnRenamed("token", "t"), ["town_id", "t"])
            .groupBy("address_id", "locality_id", "n_tok").agg(F.sum("best").alias("s"))
            .select("address_id", "locality_id", F.round(F.col("s") / F.col("n_tok"), 4).alias("score")).filter("score > 0"))


def accept(scored: DataFrame, min_score: float, min_margin: float) -> DataFrame:
    """Best proposal per address where it clears the score and the ratio over the runner-up."""
    w = Window.partitionBy("address_id").orderBy(F.col("score").desc(), "locality_id")
    two = scored.withColumn("second", F.lead("score").over(w)).withColumn("rn", F.row_number().over(w)).filter("rn = 1")
    return two.filter((F.col("score") >= min_score) & (F.col("second").isNull() | (
        F.col("score") >= min_margin * F.col("second")))).drop("rn")


def propose(res: DataFrame, names: DataFrame, idf: DataFrame, min_score: float, min_margin: float) -> DataFrame:
    """(address_id, locality_id, score, second) of the accepted proposals, as `accept` over all names would give them.

    A runner-up under min_score / min_margin rejects nothing, and a name that scores as much has a token with at least that cosine.  So
    only token pairs that reach it are looked for, names without such a pair are never scored, and the rest of a name's tokens is
    scored for names that have one.  The runner-up of an accepted address is then looked up among all its names.
    """
    floor = min_score / min_margin
    asked = res.select("address_id", "town_id", F.explode(F.array_distinct("toks")).alias("q"))
    vt = checkpoint(token_vectors(names, idf).select(F.col("token").alias("key"), F.col("gram").alias("term"), "w", "norm"))
    vq = checkpoint(token_vectors(asked.select(F.col("q").alias("token")), idf).select(F.col("token").alias("key"), F.col("gram").alias("term"), "w", "norm"))
    near = cosine_pairs(vt, vq, round(floor, 4) - 1e-4).select(F.col("a").alias("t"), F.col("b").alias("q"))
    own = names.withColumnRenamed("token", "t")
    hit = checkpoint(asked.join(near, "q").select("address_id", "town_id", "t").distinct().join(own, ["town_id", "t"]).select("address_id", "locality_id").distinct())
    wanted = hit.join(own, "locality_id").select("address_id", "t").distinct().join(asked, "address_id").select("address_id", "t", "q")
    sims = cosine_of(wanted.select(F.col("t").alias("a"), F.col("q").alias("b")).distinct(), vt, vq).select(F.col("a").alias("t"), F.col("b").alias("q"), "cos")
    best = wanted.join(sims, ["t", "q"]).groupBy("address_id", "t").agg(F.max("cos").alias("best"))
    scored = (hit.join(own, "locality_id").join(best, ["address_id", "t"]).groupBy("address_id", "locality_id", "n_tok").agg(F.sum("best").alias("s"))
              .select("address_id", "locality_id", F.round(F.col("s") / F.col("n_tok"), 4).alias("score")).filter(F.col("score") >= floor - 1e-9))
    won = checkpoint(accept(scored, min_score, min_margin).select("address_id", "locality_id", "score"))
    mine = res.join(won.select("address_id"), "address_id", "left_semi")
    every = score_names(mine, names, token_cosine(names, mine.select(F.explode("toks").alias("token")), idf))
    second = (every.join(won.withColumnsRenamed({"locality_id": "best_id", "score": "best"}), "address_id").filter("locality_id <> best_id")
              .groupBy("address_id").agg(F.max("score").alias("second")))
    return won.join(second, "address_id", "left")


def svd_loadings(docs: DataFrame, idf: DataFrame, top_terms: int = 1200, k: int = 16) -> DataFrame:
    """(gram, loading array): truncated SVD of the row-normalised document matrix over the densest
    grams.  The documents stay distributed; only the top_terms x k loadings are local."""
    from pyspark.mllib.linalg import Vectors as OldVectors
    from pyspark.mllib.linalg.distributed import RowMatrix
    spark = docs.sparkSession
    vocab = sorted(r["gram"] for r in idf.orderBy(F.col("df").desc(), "gram").limit(top_terms).select("gram").collect())
    index = spark.createDataFrame([(g, i) for i, g in enumerate(vocab)], "gram string, idx int")
    n = len(vocab)
    tf = (docs.select("doc", F.explode(text.padded_ngrams(F.col("norm"), NGRAM)).alias("gram"))
          .groupBy("doc", "gram").agg(F.count("*").alias("c"))
          .join(F.broadcast(index), "gram").join(idf.select("gram", "idf"), "gram")
          .withColumn("w", (1.0 + F.log("c")) * F.col("idf")))
    rows = tf.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("idx", "w"))).alias("e"))

    def vec(r):
        s = math.sqrt(sum(x["w"] ** 2 for x in r["e"])) or 1.0
        return OldVectors.sparse(n, [(x["idx"], x["w"] / s) for x in r["e"]])

    # one pass over the documents gives the top_terms x top_terms Gram matrix; its eigenvectors are V
    gram = RowMatrix(rows.rdd.map(vec), numCols=n).computeGramianMatrix().toArray()
    vals, vecs = np.linalg.eigh(gram)
    V = vecs[:, np.argsort(-vals)[:k]].copy()
    for j in range(V.shape[1]):              # sign rule: the largest loading of a component is positive
        if V[abs(V[:, j]).argmax(), j] < 0:
            V[:, j] = -V[:, j]
    return spark.createDataFrame([(g, [round(float(x), 6) for x in V[i]]) for i, g in enumerate(vocab)],
                                 "gram string, loading array<double>")


def svd_similarity(names: DataFrame, queries: DataFrame, idf: DataFrame, loadings: DataFrame) -> DataFrame:
    """(t, q, svd): inner product of the projected unit vectors of two tokens."""
    k = 16

    def project(tokens, name):
        v = token_vectors(tokens, idf).join(loadings, "gram")
        unit = F.sqrt(F.sum(F.col("w") * F.col("w")))
        return v.groupBy(F.col("token").alias(name)).agg(
            F.array(*[F.sum(F.col("w") * F.coalesce(F.get("loading", F.lit(i)), F.lit(0.0))) / unit for i in range(k)]).alias(f"p_{name}"))

    pairs = (token_vectors(names, idf).select(F.col("token").alias("t"), "gram")
             .join(token_vectors(queries, idf).select(F.col("token").alias("q"), "gram"), "gram").select("t", "q").distinct())
    dot = F.aggregate(F.zip_with("p_t", "p_q", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return pairs.join(project(names, "t"), "t").join(project(queries, "q"), "q").select("t", "q", F.round(dot, 4).alias("svd"))


def parser_scores(res: DataFrame, addr: DataFrame, loc: DataFrame, idf: DataFrame, text_score: DataFrame) -> DataFrame:
    """Edit-tolerant token evidence and numeric-slot consistency per (address, locality)."""
    names = name_tokens(loc)
    qt = res.select("address_id", "town_id", F.explode(F.array_distinct("toks")).alias("q"))
    pairs = qt.select("town_id", "q").distinct().join(
        names.select("town_id", F.col("token").alias("t")).distinct(), "town_id").select("t", "q").distinct()
    ga, gb = (F.array_distinct(text.padded_ngrams(F.col(c), NGRAM)) for c in ("t", "q"))
    cosine = F.when((F.size(ga) > 0) & (F.size(gb) > 0), F.size(F.array_intersect(ga, gb)) / F.sqrt(F.size(ga) * F.size(gb))).otherwise(0.0)
    sims = pairs.withColumn("s", F.greatest(cosine, text.edit_similarity(F.col("t"), F.col("q"))))
    best = qt.join(sims, "q").join(names.select("town_id", F.col("token").alias("t"), "locality_id").distinct(), ["town_id", "t"]) \
        .groupBy("address_id", "locality_id", "t").agg(F.max("s").alias("best"))
    w = best.join(idf.select(F.col("gram").alias("t"), "idf"), "t", "left").withColumn("w", F.coalesce("idf", F.lit(1.0)))
    s_idf = w.groupBy("address_id", "locality_id").agg(F.round(F.sum(F.col("w") * F.col("best")) / F.sum("w") + TIE, 4).alias("s_idf"))
    # a locality's slots come from the addresses whose text shares a name token (first such locality)
    lt = loc.select("town_id", "locality_id", F.explode(F.array_distinct(text.tokens(text.norm_text(F.col("locality_name"))))).alias("token"))
    member = (addr.select("address_id", "town_id", F.explode(F.array_distinct("toks")).alias("token")).join(lt, ["town_id", "token"])
              .groupBy("address_id").agg(F.min("locality_id").alias("locality_id")))
    slots = addr.select("address_id", "town_id", F.explode(text.numeric_slots(F.col("norm"))).alias("slot")).distinct()
    loc_slots = slots.join(member, "address_id").select("town_id", "locality_id", "slot").distinct()
    mine = slots.join(res.select("address_id"), "address_id", "left_semi")
    hit = mine.join(loc_slots, ["town_id", "slot"]).select("address_id", "locality_id").distinct().withColumn("slot_hit", F.lit(1.0))
    has = mine.select("address_id").distinct().withColumn("has_slots", F.lit(True))
    j = (s_idf.join(text_score.withColumnRenamed("score", "s_text"), ["address_id", "locality_id"], "left")
         .join(hit, ["address_id", "locality_id"], "left").join(has, "address_id", "left")
         .fillna({"s_text": 0.0, "slot_hit": 0.0}))
    c = F.round(0.5 * F.greatest("s_text", "s_idf") + 0.5 * (0.5 * F.col("s_idf") + 0.5 * F.col("slot_hit")) + TIE, 4)
    j = j.withColumn("c", c)
    return j.select("address_id", "locality_id", F.when(F.col("has_slots") & (F.col("slot_hit") == 0), F.round(F.col("c") * 0.5 + TIE, 4))
                    .otherwise(F.col("c")).alias("score"), "s_idf", "slot_hit", F.coalesce("has_slots", F.lit(False)).alias("has_slots"))
