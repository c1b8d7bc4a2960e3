import random

from pyspark.sql import functions as F

from placeproof.llm import linededup


def test_pairs_are_verified_by_generated_code(spark):
    """The set functions stand on columns, not inside a lambda, which is interpreted; the pairs are those of a plain loop."""
    rng, n = random.Random(5), linededup.SHINGLE
    base = ["".join(rng.choice("abcd ") for _ in range(60)) for _ in range(3)]
    lines = ["ab", "abc", ""] + [b[:i] + c + b[i + 1:] for b in base for i in (0, 3, 30, 59) for c in "xy"] + base
    texts = spark.createDataFrame(list(enumerate(lines)), "k1 long, line string")
    pairs = texts.select(F.col("k1").alias("a")).join(texts.select(F.col("k1").alias("b")), F.col("a") < F.col("b"))
    near = linededup._verified(pairs, texts, 0.8)
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" in plan and "exists(" not in plan
    grams = lambda s: {s[i:i + n] for i in range(max(len(s) - n + 1, 1))}
    alike = lambda x, y: len(x & y) >= 0.8 * len(x | y)
    assert {(r.a, r.b) for r in near.collect()} == {(i, j) for j in range(len(lines)) for i in range(j) if alike(grams(lines[i]), grams(lines[j]))}
