"""Distance questions without pairs: equal to all pairs, and few pairs formed in one dense cell."""
import math
import random

import pytest
from pyspark.sql import functions as F

from placeproof.operators import bootstrap, graph, pyramid

SCHEMA = "id long, zone string, x double, y double"


def cloud(seed, n, spread):
    rng = random.Random(seed)
    rows = [(i, rng.choice("pq"), round(rng.gauss(0, spread), 3), round(rng.gauss(0, spread), 3)) for i in range(n)]
    rows += [(n + i, "p", rows[0][2], rows[0][3]) for i in range(5)]                      # a pile
    rows += [(n + 10, "p", 0.0, 0.0), (n + 11, "p", 30.0, 0.0), (n + 12, "p", 0.0, -30.0), (n + 13, "q", 60.0, 80.0), (n + 14, "q", 60.0, 50.0)]  # exactly r apart, cell corners
    return rows + [(n + 20, "p", None, 1.0), (n + 21, "lone", 5.0, 5.0)]


@pytest.mark.parametrize("few", [1, 256])
@pytest.mark.parametrize("spread", [5.0, 40.0, 400.0])
def test_counts_links_and_existence_equal_all_pairs(spark, monkeypatch, few, spread):
    monkeypatch.setattr(pyramid, "FEW", few)
    rows = cloud(int(spread), 130, spread)
    points = spark.createDataFrame(rows, SCHEMA)
    placed = [r for r in rows if r[2] is not None]
    near = lambda a, b: a[1] == b[1] and math.hypot(a[2] - b[2], a[3] - b[3]) <= 30.0
    got = {r.id: r.n for r in pyramid.count_within(points, points, 30.0, ["zone"]).collect()}
    assert got == {a[0]: sum(near(a, b) for b in placed) for a in placed}
    left, right = points.filter("id % 3 = 0"), points.filter("id % 3 = 1")
    hit = sorted(r.id for r in pyramid.any_within(left, right, 30.0, ["zone"]).collect())
    assert hit == sorted(a[0] for a in placed if a[0] % 3 == 0 and any(near(a, b) for b in placed if b[0] % 3 == 1))
    root = {a[0]: a[0] for a in placed}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a in placed:
        for b in placed:
            if near(a, b) and (a[2], a[3]) != (b[2], b[3]):
                x, y = sorted((find(a[0]), find(b[0])))
                root[y] = x
    blocks = {r.id: r.block_id for r in graph.place_blocks(points.filter("x is not null"), "id", 30.0, ["zone"]).collect()}
    assert blocks == {a[0]: find(a[0]) for a in placed}


def test_one_dense_cell_forms_few_pairs(spark):
    n = 20_000
    points = spark.range(n).select("id", F.lit("z").alias("zone"), (F.rand(1) * 20).alias("x"), (F.rand(2) * 20).alias("y"))
    points.write.mode("overwrite").parquet(path := f"/tmp/spark-dense-{random.random()}")
    points = spark.read.parquet(path)
    sure, close = pyramid.descend(points, points, 30.0, ["zone"])
    assert sure.agg(F.sum(F.col("na") * F.col("nb"))).first()[0] + close.count() == points.alias("a").join(points.alias("b"), F.col("a.zone") == F.col("b.zone")).filter(
        "sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) <= 30").count()
    assert sure.count() + close.count() < 20 * n
    assert pyramid.links_within(points, 30.0, ["zone"]).count() < 3 * n
    assert {r.block_id for r in graph.place_blocks(points, "id", 30.0, ["zone"]).collect()} == {0}


def test_bootstrap_vectors_are_summed_as_a_stream():
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(1)
    keys = sorted((int(rng.integers(0, 3)), int(rng.integers(0, 200))) for _ in range(3000))
    rows = pd.DataFrame({"chunk": [k[0] for k in keys], "cell": [k[1] for k in keys], "w": list(rng.random((3000, 4)))})
    got = pd.concat(list(bootstrap.summed(iter([rows[:17], rows[17:1000], rows[1000:]]))))
    want = {}
    for c, e, w in zip(rows["chunk"], rows["cell"], rows["w"]):
        want[c, e] = want.get((c, e), 0) + w
    assert len(got) == len(want) and all(np.allclose(w, want[c, e]) for c, e, w in zip(got["chunk"], got["cell"], got["w"]))
