"""A linear model with a random intercept a group, by profiled likelihood (STA-20), and its R2 (STA-24).

With t the intercepts' variance over the residual one, a group of n rows weighs t / (1 + n t): all that the likelihood needs of a group
are the sums of its rows, and of the whole the products of columns. Groups are added up once, and those of one size again; a step weighs
these sums, for a list of t at a time.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cuts import written
from .regress import Fit, gram

#: Ratios of variances that a step tries.
RATIOS = 16
#: Different sizes of groups that are summed up on the driver; more are a table, a step an aggregation over it.
MOST_SIZES = 50_000


@dataclass(frozen=True)
class MixedFit:
    """Fixed effects with their errors, variances of intercepts and residuals, the log likelihood, and both R2."""

    fixed: Fit
    group_variance: float
    residual_variance: float
    log_likelihood: float
    r2_marginal: float
    r2_conditional: float


def random_intercept(rows: DataFrame, y: str, columns: list[str], group: str, reml: bool = False, rounds: int = 6) -> MixedFit:
    """Fixed effects of ``columns`` and a constant, a random intercept a ``group``, by maximum (or restricted) likelihood. Rows null in
    any of its columns are left out; groups may be of any size and number."""
    names = ["const", *columns]
    k = len(names)
    with written(rows.select(F.col(group).alias("_g"), F.col(y).cast("double").alias("_y"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns, 1)]).dropna()) as used:
        xs = [f"_x{i}" for i in range(1, k)]
        mean = used.agg(F.count("*").alias("n"), F.avg("_y").alias("m")).first()
        n = int(mean.n)
        if n <= k:
            raise ValueError("fewer rows than coefficients")
        # centred, so that sums of squares keep their digits
        moved = used.withColumn("_y", F.col("_y") - F.lit(float(mean.m)))
        xx, xy, yy, _, _ = gram(moved, F.col("_y"), xs)
        sums = moved.groupBy("_g").agg(F.count("*").cast("double").alias("s0"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(xs, 1)], F.sum("_y").alias("sy"))
        cells = [f"s{i}" for i in range(k)] + ["sy"]
        pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
        # groups of one size weigh the same: a row a size, of which n rows have fewer than the root of 2 n
        sizes = sums.groupBy("s0").agg(F.count("*").alias("groups"), *[F.sum(F.col(cells[i]) * F.col(cells[j])).alias(f"p{at}") for at, (i, j) in enumerate(pairs)])
        with written(sizes.withColumnRenamed("s0", "size")) as by_size:
            n_groups = int(by_size.agg(F.sum("groups")).first()[0])
            few = by_size.limit(MOST_SIZES + 1).toPandas()
            held = few if len(few) <= MOST_SIZES else None

            def weighed(part: pd.DataFrame, ratios: list[float]) -> np.ndarray:
                """(ratios, 1 + products): sums of log(1 + n t) over groups and of weighted products."""
                size, products = part["size"].to_numpy(), part[[f"p{at}" for at in range(len(pairs))]].to_numpy()
                t = np.array(ratios)[:, None]
                return np.column_stack(((part["groups"].to_numpy() * np.log1p(size * t)).sum(1), (t / (1 + size * t)) @ products))

            def at(ratios: list[float]) -> list[tuple]:
                """(log likelihood, coefficients, residual variance, bread) of each ratio."""
                if held is not None:
                    got = weighed(held, ratios)
                else:
                    add = lambda batches: (pd.DataFrame({"sums": [weighed(b, ratios).ravel()]}) for b in batches if len(b))
                    parts = by_size.mapInPandas(add, "sums array<double>")
                    width = len(ratios) * (1 + len(pairs))
                    got = np.array(parts.agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(width)])).first()[0]).reshape(len(ratios), -1)
                out = []
                for r in range(len(ratios)):
                    m = np.zeros((k + 1, k + 1))
                    for (i, j), v in zip(pairs, got[r, 1:].tolist(), strict=True):
                        m[i, j] = m[j, i] = v
                    a, c = xx - m[:k, :k], xy - m[:k, k]
                    bread = np.linalg.pinv(a)
                    coef = bread @ c
                    rest = yy - m[k, k] - coef @ c
                    df = n - k if reml else n
                    variance = max(rest / df, 1e-300)
                    value = -0.5 * (df * (math.log(2 * math.pi * variance) + 1) + got[r, 0])
                    if reml:
                        value -= 0.5 * np.linalg.slogdet(a)[1]
                    out.append((value, coef, variance, bread))
                return out

            low, high = -12.0, 8.0
            best = (at([0.0])[0], 0.0)
            for _ in range(rounds):
                line = np.linspace(low, high, RATIOS)
                made = at([math.exp(v) for v in line.tolist()])
                top = int(np.argmax([m[0] for m in made]))
                if made[top][0] > best[0][0]:
                    best = (made[top], math.exp(line[top]))
                low, high = line[max(0, top - 1)], line[min(RATIOS - 1, top + 1)]
            (value, coef, variance, bread), ratio = best
        # the variance of what the fixed effects tell
        mean_x = xx[0] / n
        spread = xx / n - np.outer(mean_x, mean_x)
        fixed = float(coef @ spread @ coef)
    coef = coef.copy()
    coef[0] += float(mean.m)
    se = np.sqrt(np.maximum(np.diag(bread) * variance, 0))
    own = ratio * variance
    total = fixed + own + variance
    return MixedFit(Fit(names, coef, se, n, n_groups), own, variance, value, fixed / total, (fixed + own) / total)
