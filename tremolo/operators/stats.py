"""Paired and unpaired rank tests, correlations, intervals and multiplicity control.

Sums are taken in Spark; tails of distributions are of a row a test, by ``normal_tail`` and ``chi2_tail``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import DEFAULT, Params
from .cuts import kept
from .running import WINDOW_ROWS, running
from .selective import distinct_ranks, with_ranks


def log10_normal_tail(z: float) -> float:
    """log10 of P(Z > z), also where the tail is too small for a double (MTH-03)."""
    p = 0.5 * math.erfc(z / math.sqrt(2))
    if p > 1e-290:
        return math.log10(p)
    square = z * z
    series = 1 - 1 / square + 3 / square**2 - 15 / square**3
    return (-square / 2 - math.log(z) - 0.5 * math.log(2 * math.pi) + math.log(series)) / math.log(10)


def normal_tail(z: float) -> float:
    """P(Z > z)."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def chi2_tail(x: float, df: int) -> float:
    """P(X > x) for chi squared with df degrees of freedom, by the series of the incomplete gamma function or its fraction."""
    if x <= 0:
        return 1.0
    a, h = df / 2, x / 2
    scale = math.exp(-h + a * math.log(h) - math.lgamma(a))
    if h < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= h / k
            total += term
        return max(0.0, 1 - total * scale)
    b, c = h + 1 - a, 1e300
    d = 1 / b
    out = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        out *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return out * scale


def paired(rows: DataFrame, by: list[str], key: list[str], group: str, first: str, second: str, value: str) -> DataFrame:
    """Self join of two groups' values by key; rows null on either side drop (JOI-04)."""
    own = lambda name, to: rows.where(F.col(group) == name).select(*by, *key, F.col(value).alias(to)).where(F.col(to).isNotNull())
    return own(first, "x").join(own(second, "y"), [*by, *key]).withColumn("d", F.col("x") - F.col("y"))


def signed_ranks(pairs: DataFrame, by: list[str], d: str = "d") -> DataFrame:
    """Wilcoxon's sums of paired differences without zeros: T+, T-, rank-biserial r, z with tie correction (STA-01, STA-02)."""
    used = pairs.where(F.col(d) != 0).withColumn("_a", F.abs(d))
    at = distinct_ranks(used, by, "_a", {"_up": F.count_if(F.col(d) > 0), "_down": F.count_if(F.col(d) < 0)})
    r, t = F.col("_rank"), F.col("_n").cast("double")
    made = at.groupBy(*by).agg(F.sum("_n").alias("n_used"), F.sum(F.col("_up") * r).alias("t_plus"), F.sum(F.col("_down") * r).alias("t_minus"), F.sum(t * (t * t - 1)).alias("_ties"))
    n = F.col("n_used").cast("double")
    variance = n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48
    return made.select(*by, "n_used", "t_plus", "t_minus", ((F.col("t_plus") - F.col("t_minus")) / (F.col("t_plus") + F.col("t_minus"))).alias("rank_biserial"), F.try_divide(F.col("t_plus") - n * (n + 1) / 4, F.sqrt(variance)).alias("z"))


def mann_whitney(rows: DataFrame, by: list[str], value: str, is_first: str) -> DataFrame:
    """U of the first sample, z with tie and continuity correction, and 1 - 2U/(n1 n2) (STA-03, STA-29)."""
    first = F.col(is_first).cast("boolean")
    at = distinct_ranks(rows.where(F.col(value).isNotNull()), by, value, {"_n1": F.count_if(first), "_n2": F.count_if(~first)})
    t = F.col("_n").cast("double")
    made = at.groupBy(*by).agg(F.sum("_n1").alias("n1"), F.sum("_n2").alias("n2"), F.sum(F.col("_n1") * F.col("_rank")).alias("_sum"), F.sum(t * (t * t - 1)).alias("_ties"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    made = made.withColumn("u", F.col("_sum") - n1 * (n1 + 1) / 2)
    sd = F.sqrt(n1 * n2 / 12 * (n + 1 - F.try_divide(F.col("_ties"), n * (n - 1))))
    return made.select(*by, "n1", "n2", "u", F.try_divide(F.col("u") - n1 * n2 / 2 + F.lit(0.5), sd).alias("z_less"), (1 - F.try_divide(2 * F.col("u"), n1 * n2)).alias("effect"))


def kruskal(rows: DataFrame, by: list[str], group: str, value: str) -> DataFrame:
    """H with tie correction, and its degrees of freedom (STA-16)."""
    each = rows.where(F.col(value).isNotNull()).groupBy(*by, group, value).agg(F.count("*").alias("_k"))
    ranks = distinct_ranks(each, by, value, {"_n": F.sum("_k")}).withColumnRenamed(value, "_value")
    joined = each.alias("e").join(ranks.alias("r"), [F.col(f"e.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by] + [F.col(f"e.{value}") == F.col("r._value")])
    sums = joined.groupBy(*[F.col(f"e.{c}").alias(c) for c in by], F.col(f"e.{group}").alias(group)).agg(F.sum(F.col("_k") * F.col("_rank")).alias("_s"), F.sum("_k").alias("_m"))
    t = F.col("_n").cast("double")
    ties = ranks.groupBy(*by).agg(F.sum(t * (t * t - 1)).alias("_ties"))
    made = sums.groupBy(*by).agg(F.sum("_m").alias("n"), F.count("*").alias("k"), F.sum(F.col("_s") * F.col("_s") / F.col("_m")).alias("_q"))
    made = made.join(ties, by) if by else made.crossJoin(F.broadcast(ties))
    n = F.col("n").cast("double")
    h = (12 / (n * (n + 1)) * F.col("_q") - 3 * (n + 1)) / (1 - F.col("_ties") / (n * n * n - n))
    return made.select(*by, "n", "k", h.alias("h"), (F.col("k") - 1).alias("df"))


def pearson_of(x: Column, y: Column) -> Column:
    """Pearson's r, centred as it is summed; null where either is constant to a part in 10^12 (STA-06, trap 10)."""
    both = x.isNotNull() & y.isNotNull()
    x, y = (F.when(both, v.cast("double")) for v in (x, y))
    varies = lambda v: F.var_pop(v) > F.lit(1e-24) * F.avg(v) * F.avg(v)
    return F.when(varies(x) & varies(y), F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def pearson(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    used = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return used.groupBy(*by).agg(F.count("*").alias("n"), pearson_of(F.col(x).cast("double"), F.col(y).cast("double")).alias("r"))


def spearman(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Pearson's r of average ranks (STA-04)."""
    used, _ = kept(rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*dict.fromkeys([*by, x, y])))
    return with_ranks(used, by, {"_x": x, "_y": y}).groupBy(*by).agg(F.count("*").alias("n"), pearson_of(F.col("_x"), F.col("_y")).alias("rho"))


def fisher_interval(r: Column, n: Column, least: int = 10) -> tuple[Column, Column]:
    """95 % interval by Fisher's z; null under ``least`` rows (STA-05)."""
    half = F.lit(1.959963984540054) / F.sqrt(n - 3)
    inside = F.greatest(F.lit(-0.999999999999), F.least(F.lit(0.999999999999), r))
    return tuple(F.when(n >= least, F.tanh(F.atanh(inside) + sign * half)) for sign in (-1, 1))


def fisher_pooled(rows: DataFrame, by: list[str], r: str, n: str) -> DataFrame:
    """Correlations pooled by Fisher's z, weighted by n - 3, and unweighted (STA-07)."""
    z, w = F.atanh(F.col(r)), F.col(n) - 3
    return rows.where(F.col(r).isNotNull() & (F.abs(r) < 1) & (F.col(n) > 3)).groupBy(*by).agg(F.count("*").alias("k"), F.tanh(F.sum(z * w) / F.sum(w)).alias("pooled"), F.tanh(F.avg(z)).alias("pooled_unweighted"))


def wilson(hits: Column, n: Column) -> tuple[Column, Column]:
    """95 % Wilson interval of a share (STA-08)."""
    z = F.lit(1.959963984540054)
    p, m = hits / n, n.cast("double")
    middle, half, whole = p + z * z / (2 * m), z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m)), 1 + z * z / m
    return (middle - half) / whole, (middle + half) / whole


def newcombe(hits1: Column, n1: Column, hits2: Column, n2: Column) -> tuple[Column, Column]:
    """95 % interval of a difference of shares from their Wilson intervals (STA-08)."""
    (l1, u1), (l2, u2) = wilson(hits1, n1), wilson(hits2, n2)
    p1, p2 = hits1 / n1, hits2 / n2
    return p1 - p2 - F.sqrt((p1 - l1) ** 2 + (u2 - p2) ** 2), p1 - p2 + F.sqrt((u1 - p1) ** 2 + (p2 - l2) ** 2)


def holm(rows: DataFrame, by: list[str], p: str, order: str) -> DataFrame:
    """Holm's adjusted p, within families (STA-09). Rows without p aren't tests."""
    window = Window.partitionBy(*by)
    used = rows.where(F.col(p).isNotNull()).withColumns({"_k": F.row_number().over(window.orderBy(p, order)), "_n": F.count("*").over(window)})
    upto = window.orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    return used.withColumn("p_holm", F.least(F.lit(1.0), F.max((F.col("_n") - F.col("_k") + 1) * F.col(p)).over(upto))).drop("_k", "_n")


def benjamini_hochberg(rows: DataFrame, by: list[str], p: str, order: str) -> DataFrame:
    """Benjamini and Hochberg's adjusted p, within families (STA-10)."""
    window = Window.partitionBy(*by)
    used = rows.where(F.col(p).isNotNull()).withColumns({"_k": F.row_number().over(window.orderBy(p, order)), "_n": F.count("*").over(window)})
    down = window.orderBy(F.col("_k").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return used.withColumn("p_bh", F.least(F.lit(1.0), F.min(F.col(p) * F.col("_n") / F.col("_k")).over(down))).drop("_k", "_n")


def bootstrap_p(replicates: DataFrame, by: list[str], value: str) -> DataFrame:
    """min(1, 2 (min(#r >= 0, #r <= 0) + 1) / (B + 1)) (STA-13)."""
    r = F.col(value)
    made = replicates.groupBy(*by).agg(F.count(r).alias("b"), F.count_if(r >= 0).alias("_up"), F.count_if(r <= 0).alias("_down"))
    return made.select(*by, "b", F.least(F.lit(1.0), 2.0 * (F.least("_up", "_down") + 1) / (F.col("b") + 1)).alias("p_boot"))


def holm_outcome(p: Column, delta: Column, alpha: float = DEFAULT.alpha) -> Column:
    """Better, worse or undecided (STA-14)."""
    return F.when((p < alpha) & (delta < 0), "better").when((p < alpha) & (delta > 0), "worse").otherwise("undecided")


def interpretation(effect: Column, p: Column, params: Params = DEFAULT) -> Column:
    """What a pair's effect and adjusted p mean together (STA-15)."""
    large = F.abs(effect) >= params.rank_biserial_gate
    return (
        F.when(effect.isNull() | p.isNull(), "not tested")
        .when(~large, "negligible effect")
        .when(p >= params.alpha, "not significant")
        .when(effect < 0, "first more stable")
        .otherwise("second more stable")
    )


#: Rows of a range of ranks, at least; a cell has at most RANGES of them.
RANGE_ROWS, RANGES = 100_000, 1000


def kendall(rows: DataFrame, by: list[str], x: str, y: str, range_rows: int = RANGE_ROWS, ranges: int = RANGES, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """Kendall's tau-b of each group, of any size, in n log n (STA-17).

    Ordered by (x, y) rows have places u, by (y, x) places v: discordant pairs are the inversions of v in order of u. Places are cut
    into ranges. Pairs within a range of u, and within one of v, are counted in a task each, those within both once less; pairs that lie
    in different ranges both ways are told by the numbers of rows in each pair of ranges.
    """
    used, _ = kept(rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).withColumn("_id", F.monotonically_increasing_id()))
    keys = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in used.select(*by).schema)
    keys = f"{keys}, " if keys else ""
    order = lambda rows, a, b, name: running(rows, by, [F.col(a).asc(), F.col(b).asc(), F.col("_id").asc()], {name: F.lit(1)}, window_rows).drop(f"_all_{name}")
    placed = running(order(used, "_x", "_y", "_u"), by, [F.col("_y").asc(), F.col("_x").asc(), F.col("_id").asc()], {"_v": F.lit(1)}, window_rows).withColumnRenamed("_all__v", "_n")
    width = F.greatest(F.lit(range_rows), F.ceil(F.col("_n") / ranges))
    placed, _ = kept(placed.select(*by, "_u", "_v", *[F.floor((F.col(c) - 1) / width).cast("int").alias(f"_r{c}") for c in ("_u", "_v")]))

    def swaps(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        v = group.sort_values("_u")["_v"].to_numpy()
        return pd.DataFrame([(*key[:-1], inversions(v))])

    def swaps_but_shared(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_u", ignore_index=True)
        v = group["_v"].to_numpy()
        # ranges of v in their order: what inversions are left lie within one of them
        return pd.DataFrame([(*key[:-1], inversions(v) - inversions(v[np.argsort(group["_r_v"].to_numpy(), kind="stable")]))])

    def apart(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros((int(group["_r_u"].max()) + 1, int(group["_r_v"].max()) + 1), np.int64)
        grid[group["_r_u"], group["_r_v"]] = group["k"]
        before = np.cumsum(grid, axis=0) - grid
        above = np.cumsum(before[:, ::-1], axis=1)[:, ::-1] - before
        return pd.DataFrame([(*key, int((above * grid).sum()))])

    schema = f"{keys}swaps long"
    parts = placed.groupBy(*by, "_r_u").applyInPandas(swaps_but_shared, schema)
    parts = parts.unionByName(placed.groupBy(*by, "_r_v").applyInPandas(swaps, schema))
    # a row a pair of ranges
    grid = placed.groupBy(*by, "_r_u", "_r_v").agg(F.count("*").alias("k"))
    parts = parts.unionByName(grid.groupBy(*by).applyInPandas(apart, schema))
    ties = lambda *c: used.groupBy(*by, *c).agg(F.count("*").alias("_k")).groupBy(*by).agg(F.sum(F.col("_k") * (F.col("_k") - 1) / 2).alias("t" + "".join(c)), F.sum("_k").alias("n" + "".join(c)))
    out = parts.groupBy(*by).agg(F.sum("swaps").alias("_swaps"))
    for table in (ties("_x"), ties("_y"), ties("_x", "_y")):
        named = table.select(*[F.col(c).alias(f"_of_{c}") if c in by else F.col(c) for c in table.columns])
        out = out.join(named, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by] or F.lit(True)).drop(*[f"_of_{c}" for c in by])
    n = F.col("n_x").cast("double")
    whole, tx, ty, both = n * (n - 1) / 2, F.col("t_x"), F.col("t_y"), F.col("t_x_y")
    tau = (whole - tx - ty + both - 2 * F.col("_swaps")) / F.sqrt((whole - tx) * (whole - ty))
    return out.select(*by, F.col("n_x").alias("n"), F.when((whole != tx) & (whole != ty), tau).alias("tau"))


def inversions(v: np.ndarray) -> int:
    """Pairs of different numbers that stand the wrong way round, by merging."""
    n, swaps, width, now = len(v), 0, 1, v.copy()
    while width < n:
        for at in range(0, n, 2 * width):
            left, right = now[at : at + width], now[at + width : at + 2 * width]
            swaps += int((len(left) - np.searchsorted(left, right, "right")).sum())
            now[at : at + 2 * width] = np.sort(now[at : at + 2 * width], kind="stable")
        width *= 2
    return swaps
