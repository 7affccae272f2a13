"""One-class SVM with an RBF kernel as a distributed primal problem.

The kernel is replaced by random Fourier features (Rahimi & Recht 2007) and the nu-one-class
objective is minimised by subgradient steps. Each step is one pass in which every task returns
one partial sum, so only vectors of the feature dimension travel. An approximation of the exact
kernel machine, close in ranking, not equal in value.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class OneClassSVM:
    features: tuple[str, ...]
    gamma: float
    dimension: int
    seed: int
    weights: tuple[float, ...]
    rho: float
    low: float
    high: float


def _matrix(features) -> list[Column]:
    return [F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features]


def _basis(features: int, dimension: int, gamma: float, seed: int):
    rng = np.random.default_rng(seed)
    return rng.normal(0.0, np.sqrt(2.0 * gamma), (features, dimension)), rng.uniform(0.0, 2.0 * np.pi, dimension)


def _lift(data: np.ndarray, basis) -> np.ndarray:
    directions, phases = basis
    return np.sqrt(2.0 / len(phases)) * np.cos(data @ directions + phases)


def fit(df: DataFrame, features: list[str], row_id: str, nu: float = 0.05, cap: int | None = 50_000, dimension: int = 128, steps: int = 12, seed: int = 42) -> OneClassSVM:
    """Train on normal rows. ``cap`` limits the training rows by hash; ``None`` uses them all."""
    names = list(features)
    data = df.select(F.col(row_id), *_matrix(names))
    rows = data.count()
    if cap is not None and rows > cap:
        data = data.where(F.pmod(F.xxhash64(F.lit(seed), F.col(row_id)), F.lit(1_000_000)) < int(1_000_000 * cap / rows))
    data = data.drop(row_id).persist()
    try:
        cells = F.array(*names)
        moments = data.select(F.aggregate(cells, F.lit(0.0), lambda a, v: a + v).alias("s"), F.aggregate(cells, F.lit(0.0), lambda a, v: a + v * v).alias("q")).agg(
            F.count("*").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).first()
        total = moments.n * len(names)
        variance = max(moments.q / total - (moments.s / total) ** 2, 1e-12)
        gamma = 1.0 / (len(names) * variance)
        basis = _basis(len(names), dimension, gamma, seed)
        weights, rho, n = np.zeros(dimension), 0.0, moments.n
        for step in range(1, steps + 1):
            gradient = _partial_sums(data, names, basis, weights, rho, first=step == 1)
            rate = 1.0 / step
            # the first pass averages all rows, a feasible start of length about one
            pull = gradient / (n if step == 1 else nu * n)
            weights = weights + rate * (pull - weights)
            rho = _quantile(data, names, basis, weights, nu)
        draft = OneClassSVM(tuple(names), gamma, dimension, seed, tuple(weights.tolist()), rho, 0.0, 0.0)
        ends = data.select(raw_score(draft).alias("s")).agg(F.min("s").alias("a"), F.max("s").alias("b")).first()
        return OneClassSVM(draft.features, gamma, dimension, seed, draft.weights, rho, ends.a, ends.b)
    finally:
        data.unpersist()


def _partial_sums(data: DataFrame, names, basis, weights, rho, first: bool):
    """Sum of the lifted rows below the margin: partial per task, added by Spark."""

    def partial(batches):
        total = np.zeros(len(weights))
        for batch in batches:
            lifted = _lift(batch[names].to_numpy(), basis)
            chosen = np.ones(len(lifted), dtype=bool) if first else lifted @ weights <= rho
            total += lifted[chosen].sum(axis=0)
        yield pd.DataFrame({"position": np.arange(len(total)), "amount": total})

    sums = data.mapInPandas(partial, "position int, amount double").groupBy("position").agg(F.sum("amount").alias("amount")).orderBy("position").toPandas()
    return sums["amount"].to_numpy()


def _quantile(data: DataFrame, names, basis, weights, nu: float) -> float:
    """The margin that leaves a share ``nu`` of the rows below it."""

    @F.pandas_udf("double")
    def project(*columns: pd.Series) -> pd.Series:
        return pd.Series(_lift(np.column_stack([c.to_numpy(dtype=float) for c in columns]), basis) @ weights)

    return data.select(project(*names).alias("s")).agg(F.percentile_approx("s", nu, 10_000)).first()[0]


def raw_score(model: OneClassSVM) -> Column:
    """Decision value per row: negative for outliers."""
    basis = _basis(len(model.features), model.dimension, model.gamma, model.seed)
    weights, rho = np.array(model.weights), model.rho

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        return pd.Series(_lift(np.column_stack([c.to_numpy(dtype=float) for c in columns]), basis) @ weights - rho)

    return score(*_matrix(model.features))
