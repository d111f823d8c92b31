"""Regressions with cluster-robust errors. Spark sums products; the driver solves k by k systems."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import DEFAULT
from .cuts import written
from .stats import normal_tail


#: How the terms of fixed effects begin.
EFFECT = "fixed:"
#: Values that a column of fixed effects may have.
MOST_EFFECTS = 500


@dataclass(frozen=True)
class Fit:
    """Coefficients by name with cluster-robust errors (STA-21)."""

    names: list[str]
    coef: np.ndarray
    se: np.ndarray
    n: int
    clusters: int
    r2: float | None = None

    def table(self, spark, alpha: float = DEFAULT.alpha) -> DataFrame:
        """Terms with intervals, p, whether that is under ``alpha``, and whether the term is a predictor: neither the constant nor a
        model's effect."""
        rows = []
        for name, b, s in zip(self.names, self.coef.tolist(), self.se.tolist(), strict=True):
            p = 2 * normal_tail(abs(b / s)) if s else None
            rows.append((name, b, s, b - 1.959963984540054 * s, b + 1.959963984540054 * s, p, None if p is None else p < alpha, name != "const" and not name.startswith(EFFECT)))
        return spark.createDataFrame(rows, "term string, coef double, se double, ci_low double, ci_high double, p double, significant boolean, is_linguistic boolean")


def standardised(rows: DataFrame, columns: list[str]) -> DataFrame:
    """z-scores by population standard deviation; 0 where that is next to 0 (PRJ-08). Means and deviations are one row."""
    stats = rows.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    out = rows.crossJoin(F.broadcast(stats))
    z = {c: F.when(F.col(f"_s_{c}") > 1e-12, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(F.lit(0.0)) for c in columns}
    return out.withColumns(z).drop(*[f"_m_{c}" for c in columns], *[f"_s_{c}" for c in columns])


def with_effects(rows: DataFrame, column: str, most: int = MOST_EFFECTS) -> tuple[DataFrame, list[str]]:
    """Rows with an indicator of each of a column's values but the first in order, and the indicators' names: fixed effects (STA-18).
    Null is no value. A column of more than ``most`` values is no fixed effect."""
    found = [r[0] for r in rows.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} values")
    values = sorted(found)[1:]
    names = [f"{EFFECT}{column}={v}" for v in values]
    return rows.where(F.col(column).isNotNull()).withColumns({n: (F.col(column) == F.lit(v)).cast("double") for n, v in zip(names, values, strict=True)}), names


def _design(columns: list[str]) -> list[tuple[str, Column]]:
    return [("const", F.lit(1.0)), *[(c, F.col(f"`{c}`").cast("double")) for c in columns]]


def gram(rows: DataFrame, y: Column, columns: list[str], weight: Column | None = None) -> tuple[np.ndarray, np.ndarray, float, float, int]:
    """X'WX, X'Wy, y'Wy, sum of Wy and n, in one aggregation with partial sums."""
    xs = [x for _, x in _design(columns)]
    w = F.lit(1.0) if weight is None else weight
    k = len(xs)
    sums = [F.sum(w * xs[i] * xs[j]) for i in range(k) for j in range(i, k)] + [F.sum(w * x * y) for x in xs] + [F.sum(w * y * y), F.sum(w * y), F.count("*")]
    got = list(rows.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first())
    xx = np.zeros((k, k))
    at = iter(got)
    for i in range(k):
        for j in range(i, k):
            xx[i, j] = xx[j, i] = next(at) or 0.0
    xy = np.array([next(at) or 0.0 for _ in xs])
    return xx, xy, float(next(at) or 0), float(next(at) or 0), int(next(at))


def _sandwich(rows: DataFrame, columns: list[str], residual: Column, cluster: str, bread: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    """Errors from the sums of scores within clusters, with the factor G/(G-1) (N-1)/(N-K)."""
    xs = [x for _, x in _design(columns)]
    k = len(xs)
    scores = rows.groupBy(cluster).agg(*[F.sum(residual * x).alias(f"u{i}") for i, x in enumerate(xs)])
    sums = [F.sum(F.col(f"u{i}") * F.col(f"u{j}")).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]
    got = scores.agg(*sums, F.count("*").alias("g")).first()
    meat, at = np.zeros((k, k)), iter(got)
    for i in range(k):
        for j in range(i, k):
            meat[i, j] = meat[j, i] = next(at)
    g = int(got["g"])
    factor = g / max(1, g - 1) * (n - 1) / max(1, n - k)
    return np.sqrt(np.maximum(np.diag(factor * bread @ meat @ bread), 0)), g


def _linear(columns: list[str], coef: np.ndarray) -> Column:
    out = F.lit(0.0)
    for (_, x), b in zip(_design(columns), coef.tolist(), strict=True):
        out = out + F.lit(b) * x
    return out


def _used(rows: DataFrame, y: str, columns: list[str], cluster: str) -> DataFrame:
    """The columns of a fit, without rows null in any."""
    used = rows.select(F.col(y).cast("double").alias(y), *[F.col(f"`{c}`").cast("double").alias(c) for c in columns if c != y], *([cluster] if cluster not in (y, *columns) else []))
    whole = [F.col(f"`{c}`").isNotNull() & ~F.isnan(f"`{c}`") for c in dict.fromkeys([y, *columns])]
    return used.where(reduce(lambda p, q: p & q, [*whole, F.col(cluster).isNotNull()]))


def ols(rows: DataFrame, y: str, columns: list[str], cluster: str) -> Fit:
    """Least squares with cluster-robust errors (STA-19). Rows null in any of its columns are left out."""
    with written(_used(rows, y, columns, cluster)) as used:
        xx, xy, yy, sy, n = gram(used, F.col(y), columns)
        bread = np.linalg.pinv(xx)
        coef = bread @ xy
        se, g = _sandwich(used, columns, F.col(y) - _linear(columns, coef), cluster, bread, n)
    whole = yy - sy * sy / n
    return Fit(["const", *columns], coef, se, n, g, 1 - (yy - float(coef @ xy)) / whole if whole > 0 else None)


def logit(rows: DataFrame, y: str, columns: list[str], cluster: str, steps: int = 25) -> Fit:
    """Logistic regression by reweighted least squares, with cluster-robust errors (STA-18). Its few columns are written once; a step
    is one aggregation over them."""
    with written(_used(rows, y, columns, cluster)) as used:
        coef, target = np.zeros(len(columns) + 1), F.col(y)
        for _ in range(steps):
            eta = _linear(columns, coef)
            p = 1 / (1 + F.exp(-eta))
            w = F.greatest(p * (1 - p), F.lit(1e-10))
            xx, xz, _, _, n = gram(used, eta + (target - p) / w, columns, w)
            new = np.linalg.pinv(xx) @ xz
            moved, coef = float(np.abs(new - coef).max()), new
            if moved < 1e-10:
                break
        p = 1 / (1 + F.exp(-_linear(columns, coef)))
        xx = gram(used, target, columns, p * (1 - p))[0]
        bread = np.linalg.pinv(xx)
        se, g = _sandwich(used, columns, target - p, cluster, bread, n)
    return Fit(["const", *columns], coef, se, n, g)


def collinearity(rows: DataFrame, columns: list[str]) -> dict:
    """Rank, condition numbers and variance inflation of predictors (STA-22)."""
    xx, _, _, _, n = gram(rows.dropna(subset=columns), F.lit(0.0), columns)
    mean = xx[0, 1:] / n
    cov = xx[1:, 1:] / n - np.outer(mean, mean)
    sd = np.sqrt(np.maximum(np.diag(cov), 0))
    corr = cov / np.where(np.outer(sd, sd) > 0, np.outer(sd, sd), 1)
    inverse = np.linalg.pinv(corr)
    raw = np.linalg.svd(xx, compute_uv=False)
    return {"rank": int(np.linalg.matrix_rank(xx)), "condition": float(math.sqrt(raw[0] / max(raw[-1], 1e-300))), "condition_scaled": float(np.linalg.cond(corr)) ** 0.5, "vif": dict(zip(columns, np.diag(inverse).tolist(), strict=True))}


def cohen_f2(r2_full: float, r2_reduced: float) -> float:
    """(R2 - R2 without the predictors) / (1 - R2) (STA-24)."""
    return (r2_full - r2_reduced) / (1 - r2_full)


def usable_predictors(rows: DataFrame, columns: list[str], coverage: float = 0.8) -> list[str]:
    """Columns that are filled in more than ``coverage`` of rows, less those equal to an earlier one everywhere (FLT-15)."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    got = rows.agg(F.count("*").alias("n"), *[F.count(c).alias(f"c_{c}") for c in columns], *[F.count_if(~F.col(a).eqNullSafe(F.col(b))).alias(f"d_{i}") for i, (a, b) in enumerate(pairs)]).first()
    filled = [c for c in columns if got["n"] and got[f"c_{c}"] / got["n"] > coverage]
    alias = {b for i, (a, b) in enumerate(pairs) if got[f"d_{i}"] == 0 and a in filled}
    return [c for c in filled if c not in alias]


def type_shares(rows: DataFrame, instance: list[str], kind: str, values: list[str], prefix: str = "share_") -> DataFrame:
    """Per instance the share of its rows of each kind (AGG-13)."""
    n = F.count("*")
    return rows.groupBy(*instance).agg(n.alias("n"), *[(F.count_if(F.col(kind) == v) / n).alias(f"{prefix}{v}") for v in values])
