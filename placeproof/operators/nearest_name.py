"""Best name per text inside a scope: by token Jaccard and by edit similarity, without meeting every name of the scope."""
import struct
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeproof.functions import text
from placeproof.session import checkpoint


def best_by_tokens(texts: DataFrame, names: DataFrame, scope: str = "town_id") -> DataFrame:
    """(scope, text, j, name): the largest (token Jaccard, name) over the names of the scope; texts and names are distinct
    (scope, text, toks) and (scope, name, toks) rows with distinct tokens.

    A name that shares one token with the text has j = 1 / (|text| + |name| - 1), so of all names of a scope that hold a token only the
    last one of each size matters: a token that a third of all names share is a few rows.  Names that share two tokens or more meet on
    pairs of tokens and are compared exactly; they only win with a larger j than the summary gives them.  Texts that share no token
    get the last name of the scope with j = 0.
    """
    held = names.withColumn("n", F.size("toks"))
    single = (held.select(scope, "name", "n", F.explode("toks").alias("token")).groupBy(scope, "token", "n").agg(F.max("name").alias("name"))
              .groupBy(scope, "token").agg(F.collect_list(F.struct("n", "name")).alias("ends")))
    words = texts.select(scope, "text", F.size("toks").alias("m"), F.explode("toks").alias("token")).join(single, [scope, "token"])
    by_one = F.array_max(F.transform("ends", lambda e: F.struct((1 / (F.col("m") + e["n"] - 1)).alias("j"), e["name"].alias("name"))))
    known = words.groupBy(scope, "text", "m").agg(F.max(by_one).alias("b"), F.sort_array(F.collect_list("token")).alias("known"))

    def pairs(c: str):
        return F.flatten(F.transform(c, lambda x, i: F.transform(F.slice(c, i + 2, F.size(c)), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    left = known.filter(F.size("known") > 1).select(scope, "text", "m", "known", F.explode(pairs("known")).alias("p"))
    right = held.filter("n > 1").withColumn("toks", F.sort_array("toks")).select(scope, "name", "n", "toks", F.explode(pairs("toks")).alias("p"))
    common = F.size(F.array_intersect("known", "toks"))
    by_two = (left.join(right, [scope, "p"]).select(scope, "text", F.struct((common / (F.col("m") + F.col("n") - common)).alias("j"), "name").alias("b"))
              .groupBy(scope, "text").agg(F.max("b").alias("b")))
    last = names.groupBy(scope).agg(F.max("name").alias("name")).select(scope, F.struct(F.lit(0.0).alias("j"), "name").alias("b"))
    none = texts.select(scope, "text").join(last, scope)
    found = known.select(scope, "text", "b").unionByName(by_two).unionByName(none)
    return found.groupBy(scope, "text").agg(F.max("b").alias("b")).select(scope, "text", "b.j", "b.name")


@F.pandas_udf(T.ArrayType(T.LongType()))
def letter_mask(s: pd.Series) -> pd.Series:
    """The letters of a text as a fixed mask of 4 longs: one of 256 bits per (letter, how many of it stand before)."""
    def mask(t: str | None) -> list[int] | None:
        if t is None:
            return None
        seen, bits = {}, 0
        for c in t:
            i = seen[c] = seen.get(c, -1) + 1
            bits |= 1 << ((ord(c) * 37 + i * 101) & 255)
        return list(struct.unpack("<4q", bits.to_bytes(32, "little")))
    return s.map(mask)


WORD = 64                                               # letters of the shorter side that one machine word holds


def _codes(texts: list[str]) -> np.ndarray:
    """Code points of texts, padded with zeros to one width."""
    cells = np.array(texts, dtype=str)
    return cells.view(np.uint32).reshape(len(texts), -1) if cells.dtype.itemsize else np.zeros((len(texts), 1), np.uint32)


def distances(a: list[str], b: list[str]) -> np.ndarray:
    """Edit distance per code point of each pair, all pairs of a block at once: a column of the table is one word per pair (Myers).

    The shorter side holds at most WORD code points.  Pairs go in order of the longer side, so those that are over leave at the end.
    """
    swap = np.array([len(x) > len(y) for x, y in zip(a, b)], bool)
    short, long = [y if f else x for x, y, f in zip(a, b, swap)], [x if f else y for x, y, f in zip(a, b, swap)]
    sizes = np.array([len(x) for x in long], np.int64)
    order = np.argsort(-sizes, kind="stable")
    short, long, sizes = [short[i] for i in order], [long[i] for i in order], sizes[order]
    own, other = _codes(short), _codes(long)
    n = np.array([len(x) for x in short], np.int64)
    seen = np.zeros(int(max(own.max(), other.max())) + 1, bool)
    seen[own], seen[other] = True, True
    number = np.cumsum(seen) - 1
    own, other = number[own], np.ascontiguousarray(number[other].T)
    out = np.empty(len(order), np.int64)
    step = max(64, min(len(order), (1 << 22) // int(seen.sum())))
    one = np.uint64(1)
    for lo in range(0, len(order), step):
        c, m, size = own[lo:lo + step], n[lo:lo + step], sizes[lo:lo + step]
        row = np.arange(len(m))
        at = np.zeros((len(m), int(seen.sum())), np.uint64)
        for j in range(int(m.max())):
            held = row[m > j]
            at[held, c[held, j]] |= one << np.uint64(j)
        last = np.where(m > 0, one << np.maximum(m - 1, 0).astype(np.uint64), np.uint64(0))
        up, down, score = np.full(len(m), ~np.uint64(0)), np.zeros(len(m), np.uint64), m.copy()
        for t in range(int(size[0])):
            k = int(np.searchsorted(-size, -t, side="left"))       # pairs whose longer side goes on
            eq = at[row[:k], other[t, lo:lo + k]]
            p, q = up[:k], down[:k]
            v = eq | q
            h = (((eq & p) + p) ^ p) | eq
            plus, minus = q | ~(h | p), p & h
            score[:k] += (plus & last[:k]) != 0
            score[:k] -= (minus & last[:k]) != 0
            plus, minus = (plus << one) | one, minus << one
            up[:k], down[:k] = minus | ~(v | plus), plus & v
        out[order[lo:lo + step]] = np.where(m > 0, score, size)
    return out


@F.pandas_udf(T.IntegerType())
def word_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edit distance of pairs whose shorter side fits one word, null for the others."""
    out = pd.Series(np.nan, index=a.index)
    fit = np.flatnonzero([min(len(x), len(y)) <= WORD for x, y in zip(a, b)])
    if len(fit):
        out.iloc[fit] = distances(a.iloc[fit].tolist(), b.iloc[fit].tolist())
    return out.astype("Int32")


def best_by_edits(texts: DataFrame, names: DataFrame, scope: str = "town_id") -> DataFrame:
    """(scope, text, ratio): the largest edit similarity 1 - d / max(length) to a name of the scope, per code point.

    texts holds distinct (scope, text, guess) rows, guess being any name of the scope (null: none); names distinct (scope, name) rows.
    The guess gives a first ratio; the lengths alone bound the ratio of another name by the shorter over the longer, so only names of
    the lengths that can beat the guess are met, by an equi-join on (scope, length).  Letters that one side has and the other lacks
    bound it further, by masks whose collisions only loosen the bound.  The pairs that are left are measured in blocks, one word per pair;
    where both sides are longer than a word, one by one, given up where the distance passes the one of the guess.
    """
    # the exchange keeps the guess's distance a column: it would else be worked out again wherever it is used
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    low = F.coalesce(text.edit_similarity(F.col("text"), F.col("guess")), F.lit(0.0))
    first = texts.select(scope, "text", F.length("text").alias("m"), low.alias("low"), letter_mask("text").alias("tm")).repartition(parts, scope, "text")
    size = checkpoint(names.select(scope, "name", F.length("name").alias("n"), letter_mask("name").alias("nm")))
    spread = size.groupBy(scope).agg(F.sort_array(F.collect_set("n")).alias("sizes"))
    beats = lambda common, longest: common > F.col("low") * longest + 1e-9
    can = F.filter("sizes", lambda n: beats(F.least(n, F.col("m")), F.greatest(n, F.col("m"))))
    asked = first.join(spread, scope).filter("m > 0").withColumn("n", F.explode(can))
    lacks = lambda x, y: reduce(add, [F.bit_count(F.get(x, F.lit(k)).bitwiseAND(F.bitwise_not(F.get(y, F.lit(k))))) for k in range(4)])
    common = F.least(F.col("n") - lacks("nm", "tm"), F.col("m") - lacks("tm", "nm"))
    met = (asked.join(size.filter("n > 0"), [scope, "n"]).filter(beats(common, F.greatest("m", "n")))
           .withColumn("most", F.ceil((1 - F.col("low")) * F.greatest("m", "n")).cast("int")))
    far = F.pmod(F.expr("levenshtein(text, name, most)"), F.lit(1 << 30))   # given up: -1, then out of any reach
    d = F.when(F.least("m", "n") <= WORD, word_distance("text", "name")).otherwise(far)
    ratio = met.groupBy(scope, "text").agg(F.max(1.0 - d / F.greatest("m", "n")).alias("r"))
    return first.join(ratio, [scope, "text"], "left").select(scope, "text", F.greatest(F.col("low"), F.coalesce("r", F.lit(0.0))).alias("ratio"))
