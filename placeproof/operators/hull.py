"""Largest pairwise distance per group without forming pairs."""
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _hull(pts: np.ndarray) -> np.ndarray:
    """Convex hull vertices (monotone chain); the farthest pair is always among them."""
    pts = np.unique(pts, axis=0)
    if len(pts) < 3:
        return pts

    def half(seq):
        out = []
        for p in seq:
            while len(out) >= 2 and ((out[-1][0] - out[-2][0]) * (p[1] - out[-2][1])
                                     - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0])) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def group_diameter(df: DataFrame, key: str) -> DataFrame:
    """(key, span): each batch is reduced to hull vertices per key before the shuffle, so the rows
    that reach a group's task are hull vertices only, however many points the group has."""
    def reduce_batch(batches):
        for pdf in batches:
            parts = []
            for k, g in pdf.groupby(key, sort=False):
                h = _hull(g[["x", "y"]].to_numpy(float))
                parts.append(pd.DataFrame({key: k, "x": h[:, 0], "y": h[:, 1]}))
            yield pd.concat(parts) if parts else pdf.iloc[:0][[key, "x", "y"]]

    def finish(pdf):
        h = _hull(pdf[["x", "y"]].to_numpy(float))
        best = 0.0
        for i in range(len(h) - 1):     # one row of distances at a time
            best = max(best, float(np.sqrt(((h[i + 1:] - h[i]) ** 2).sum(axis=1)).max()))
        return pd.DataFrame({key: [pdf[key].iloc[0]], "span": [best]})

    t = dict(df.dtypes)[key]
    small = df.select(key, "x", "y").mapInPandas(reduce_batch, f"{key} {t}, x double, y double")
    return small.groupBy(key).applyInPandas(finish, f"{key} {t}, span double")
