"""Cosine joins and best names against brute force."""
import math
import random

import pytest
from pyspark.sql import functions as F

from placeproof.operators import cosine, nearest_name
from placeproof.plans import residue


def weights(rng, n, name, terms=30):
    out = []
    for k in range(n):
        own = {f"t{min(rng.randrange(terms), rng.randrange(terms))}": rng.random() * 3 + 0.1 for _ in range(rng.randint(1, 6))}
        norm = math.sqrt(sum(w * w for w in own.values()))
        out += [(f"{name}{k}", t, w, norm) for t, w in own.items()]
    return out


@pytest.mark.parametrize("threshold", [0.3, 0.7, 0.95])
def test_cosine_pairs_lose_none(spark, threshold):
    rng = random.Random(4)
    a, b = weights(rng, 150, "a"), weights(rng, 200, "b")
    b += [("copy", t, w, n) for k, t, w, n in a if k == "a0"]
    frame = lambda rows: spark.createDataFrame(rows, "key string, term string, w double, norm double")
    got = {(r.a, r.b): r.cos for r in cosine.cosine_pairs(frame(a), frame(b), threshold).collect()}
    sides = [{k: {t: w / n for q, t, w, n in rows if q == k} for k in {r[0] for r in rows}} for rows in (a, b)]
    want = {}
    for x, u in sides[0].items():
        for y, v in sides[1].items():
            c = round(sum(w * v.get(t, 0) for t, w in u.items()), 4)
            if c >= threshold:
                want[x, y] = c
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1.5e-4 for k in want) and ("a0", "copy") in got


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_best_names_match_brute_force(spark):
    rng = random.Random(5)
    words = ["nagar", "colony", "red", "blue", "hill", "old", "new", "ಜಯನಗರ", "east", "x"]
    names = sorted({(t, " ".join(rng.choice(words) for _ in range(rng.randint(1, 4)))) for t in ("T1", "T2") for _ in range(60)})
    texts = sorted({(t, " ".join(rng.choice(words + ["cross", "12", "near"]) for _ in range(rng.randint(0, 7)))) for t in ("T1", "T2", "T9") for _ in range(80)})
    toks = lambda s: sorted(set(s.split()))
    name_rows = spark.createDataFrame([(t, n, toks(n)) for t, n in names], "town_id string, name string, toks array<string>")
    text_rows = spark.createDataFrame([(t, x, toks(x)) for t, x in texts], "town_id string, text string, toks array<string>")
    best = nearest_name.best_by_tokens(text_rows, name_rows)
    got = {(r.town_id, r.text): (r.j, r.name) for r in best.collect()}
    jaccard = lambda x, n: len(set(toks(x)) & set(toks(n))) / len(set(toks(x)) | set(toks(n)))
    assert got == {(t, x): max((jaccard(x, n), n) for u, n in names if u == t) for t, x in texts if t != "T9"}
    for guess in (F.col("name"), F.lit(None).cast("string"), F.lit("zzzz")):
        edit = nearest_name.best_by_edits(best.select("town_id", "text", guess.alias("guess")) if guess is not None else best, name_rows.select("town_id", "name").union(
            spark.createDataFrame([("T1", "zzzz"), ("T2", "zzzz")], "town_id string, name string")))
        found = {(r.town_id, r.text): r.ratio for r in edit.collect()}
        want = {(t, x): max((1 - edits(x, n) / max(len(x), len(n)) if x else 0.0) for n in [m for u, m in names if u == t] + ["zzzz"]) for t, x in texts if t != "T9"}
        assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-12 for k in want)


def test_pairs_are_measured_in_blocks(spark):
    """One word per pair: every script, empty and full words; a side over one word goes through the engine's own function."""
    rng = random.Random(8)
    draw = lambda k: "".join(rng.choice(al) for _ in range(k))
    a, b = [], []
    for al in ("ab", "abcdefgh ", "ಮನೆಮುಚ್ಚಿದೆ\U0001F600x"):
        a += [draw(k) for k in (0, 1, 5, 20, 63, 64, 65, 130) for _ in range(6)]
        b += [draw(k) for _ in range(8) for k in (0, 1, 7, 33, 63, 64)]
    assert nearest_name.distances(a, b).tolist() == [edits(x, y) for x, y in zip(a, b)]
    al = "abc "
    names = ["abc", *[draw(k) for k in (40, 64, 65, 80)]]
    texts = sorted({draw(k) for k in (3, 50, 64, 66, 90) for _ in range(4)})
    rows = lambda xs, c: spark.createDataFrame([("T1", x) for x in xs], f"town_id string, {c} string")
    found = nearest_name.best_by_edits(rows(texts, "text").withColumn("guess", F.lit("abc")), rows(names, "name"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "word_distance" in plan
    want = {x: max(1 - edits(x, n) / max(len(x), len(n)) for n in names) for x in texts}
    assert all(abs(r.ratio - want[r.text]) < 1e-12 for r in found.collect())


def test_proposals_equal_full_scoring(spark):
    rng = random.Random(6)
    part = lambda: "".join(rng.choice("abcdeop") for _ in range(rng.randint(4, 8)))
    names = [(f"L{i}", f"T{i % 2}", f"{part()} {part()}") for i in range(40)]
    spoil = lambda w: w[:2] + rng.choice("xyz") + w[3:] if rng.random() < 0.4 else w
    rows = [(i, f"T{i % 2}", [spoil(w) for w in rng.choice([n for n in names if n[1] == f"T{i % 2}"])[2].split()] + ["12", part()]) for i in range(60)]
    loc = spark.createDataFrame(names, "locality_id string, town_id string, locality_name string")
    res = spark.createDataFrame(rows, "address_id long, town_id string, toks array<string>")
    docs = loc.select(F.col("locality_name").alias("norm"))
    idf = residue.gram_idf(docs, loc, loc.select(F.col("locality_name").alias("poi_name")))
    own = residue.name_tokens(loc)
    full = residue.accept(residue.score_names(res, own, residue.token_cosine(own, res.select(F.explode("toks").alias("token")), idf)), 0.35, 1.25)
    got = residue.propose(res, own, idf, 0.35, 1.25)
    key = lambda d: sorted((r.address_id, r.locality_id, r.score, r.second) for r in d.collect())
    assert key(got) == key(full) and len(key(got)) > 5
