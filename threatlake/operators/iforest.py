"""Isolation forest as a Spark job (Liu, Ting & Zhou 2008).

Every tree sees a small subsample, so trees are built independently, one group per tree; the
model is a table of at most trees x 511 nodes. Scores agree with the published method, not bit
for bit with any other implementation: the random draws differ.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODES = "tree int, node int, feature int, threshold double, left int, right int, size int, depth int"


@dataclass(frozen=True)
class IsolationForest:
    features: tuple[str, ...]
    nodes: pd.DataFrame  # bounded: trees x (2 * subsample - 1)
    subsample: int
    offset: float  # score_samples value below which a row is an outlier
    low: float  # extremes of the raw training scores
    high: float


def _matrix(features) -> list[Column]:
    return [F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features]


def _path_correction(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    out = np.where(n == 2, 1.0, 0.0)
    big = n > 2
    m = np.where(big, n, 3.0)
    return np.where(big, 2.0 * (np.log(m - 1.0) + np.euler_gamma) - 2.0 * (m - 1.0) / m, out)


def _assign(df: DataFrame, features, row_id: str, trees: int, subsample: int, seed: int, rows: int) -> DataFrame:
    """Rows with the tree they train: about 1.5 subsamples per tree, cut to one by hash order."""
    lottery = lambda *c: F.pmod(F.xxhash64(F.lit(seed), F.col(row_id), *c), F.lit(1_000_000)) / F.lit(1e6)
    base = df.select(F.col(row_id), *_matrix(features))
    share = 1.5 * trees * subsample / max(rows, 1)
    copies = math.ceil(share)  # chances of a row to be drawn, one where rows abound
    chance = base.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).where(lottery(F.col("_copy")) < share / copies)
    tree = F.pmod(F.xxhash64(F.lit(seed + 1), F.col(row_id), F.col("_copy")), F.lit(trees)).cast("int")
    return chance.withColumn("tree", tree).drop("_copy").dropDuplicates(["tree", row_id])


def fit(df: DataFrame, features: list[str], row_id: str, trees: int = 200, subsample: int = 256, contamination: float = 0.05, seed: int = 42) -> IsolationForest:
    """Train on ``df``. Deterministic for a given set of rows, however they are partitioned."""
    rows = df.count()
    subsample = min(subsample, max(rows, 2))
    limit = math.ceil(math.log2(subsample))
    names = list(features)

    def grow(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_draw", row_id]).head(subsample)
        data, rng, out = group[names].to_numpy(), np.random.default_rng([seed, int(key[0])]), []
        stack = [(np.arange(len(data)), 0, -1, False)]
        while stack:
            members, depth, parent, is_right = stack.pop()
            node = len(out)
            if parent >= 0:
                out[parent][4 if is_right else 3] = node
            spread = np.flatnonzero(data[members].max(axis=0) > data[members].min(axis=0)) if len(members) > 1 else []
            if depth >= limit or len(spread) == 0:
                out.append([node, -1, 0.0, -1, -1, len(members), depth])
                continue
            feature = int(rng.choice(spread))
            values = data[members, feature]
            cut = float(rng.uniform(values.min(), values.max()))
            out.append([node, feature, cut, -1, -1, len(members), depth])
            stack.append((members[values > cut], depth + 1, node, True))
            stack.append((members[values <= cut], depth + 1, node, False))
        made = pd.DataFrame(out, columns=["node", "feature", "threshold", "left", "right", "size", "depth"])
        made.insert(0, "tree", int(key[0]))
        return made

    drawn = _assign(df, names, row_id, trees, subsample, seed, rows).withColumn("_draw", F.xxhash64(F.lit(seed), F.col(row_id), F.col("tree")))
    nodes = drawn.groupBy("tree").applyInPandas(grow, NODES).toPandas().sort_values(["tree", "node"]).reset_index(drop=True)
    draft = IsolationForest(tuple(names), nodes, subsample, 0.0, 0.0, 0.0)
    stats = df.select(raw_score(draft).alias("s")).agg(
        F.percentile_approx("s", contamination, 10_000).alias("o"), F.min("s").alias("a"), F.max("s").alias("b")).first()
    return IsolationForest(tuple(names), nodes, subsample, stats.o, stats.a - stats.o, stats.b - stats.o)


def raw_score(model: IsolationForest) -> Column:
    """Decision value per row: negative for outliers. One vectorised pass per Arrow batch."""
    groups = []
    for _, g in model.nodes.groupby("tree"):
        leaf_length = g["depth"].to_numpy() + _path_correction(g["size"].to_numpy())
        groups.append(tuple(g[c].to_numpy() for c in ("feature", "threshold", "left", "right")) + (leaf_length, int(g["depth"].max())))
    norm, offset = float(_path_correction(np.array([model.subsample]))[0]) or 1.0, model.offset

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        data = np.column_stack([c.to_numpy(dtype=float) for c in columns])
        total, rows = np.zeros(len(data)), np.arange(len(data))
        for feature, cut, left, right, length, depth in groups:
            at = np.zeros(len(data), dtype=int)
            for _ in range(depth):
                f = feature[at]
                goes_left = data[rows, np.maximum(f, 0)] <= cut[at]
                at = np.where(f < 0, at, np.where(goes_left, left[at], right[at]))
            total += length[at]
        return pd.Series(-np.exp2(-total / len(groups) / norm) - offset)

    return score(*_matrix(model.features))
