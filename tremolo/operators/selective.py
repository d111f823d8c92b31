"""Selective prediction: coverage, risk, areas under risk curves, and the signals that order predictions.

The best predictions of a cell come first. Ties keep the order column, so every result has one value; scores are doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import DEFAULT, Params
from .cuts import kept
from .lookups import looked_up
from .running import WINDOW_ROWS, running


def grid(spark, params: Params = DEFAULT) -> DataFrame:
    """Coverages 1.00, 0.95 ... 0.10 (SEL-01)."""
    step = F.lit(params.grid_step).cast("double")
    return spark.range(params.grid_steps).select(F.bround(F.lit(1.0).cast("double") - step * F.col("id"), 2).alias("coverage"))


def ranked(rows: DataFrame, cell: list[str], score: str | list[Column], correct: str = "correct", order: str = "_ord", window_rows: int = WINDOW_ROWS) -> DataFrame:
    """Rows numbered from the best (rn of n_total), with the right ones so far (hits); ``score`` is a column to sort up, or sort
    expressions (WIN-03, WIN-04). Cells may be of any size."""
    if isinstance(score, str):
        rows, score = rows.select(*dict.fromkeys([*cell, score, order, correct])), [F.col(score).asc()]
    made = running(rows, cell, [*score, F.col(order).asc()], {"rn": F.lit(1), "hits": F.col(correct).cast("double")}, window_rows)
    return made.withColumnRenamed("_all_rn", "n_total").drop("_all_hits")


def risk_coverage(rows: DataFrame, cell: list[str], score: str | list[Column], correct: str = "correct", order: str = "_ord", params: Params = DEFAULT, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """Per cell and coverage the accuracy of the best share (SEL-01, WIN-06). k = max(1, ceil(coverage * n)) in double arithmetic.

    Prefix sums are joined with the grid's few depths by equality, so a row meets at most the depths it stands at.
    """
    at = ranked(rows, cell, score, correct, order, window_rows).select(*cell, "rn", "n_total", "hits")
    depth = F.greatest(F.lit(1), F.ceil(F.col("coverage") * F.col("n_total")).cast("int"))
    ends = at.where("rn = 1").select(*[F.col(c).alias(f"_of_{c}") for c in cell], "n_total").crossJoin(F.broadcast(grid(rows.sparkSession, params)))
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in cell]
    joined = ends.withColumn("n_keep", depth).join(at.drop("n_total"), [*same, F.col("n_keep") == F.col("rn")])
    accuracy = F.col("hits") / F.col("n_keep")
    return joined.select(*cell, "coverage", "n_keep", "n_total", accuracy.alias("selective_accuracy"), (1 - accuracy).alias("risk"))


def aurc(curve: DataFrame, cell: list[str]) -> DataFrame:
    """Area under the risk curve by trapezoids over its coverages, not divided by their width (SEL-02, WIN-13)."""
    window = Window.partitionBy(*cell).orderBy("coverage")
    before = lambda c: F.lag(c).over(window)
    part = (F.col("coverage") - before("coverage")) * (F.col("risk") + before("risk")) / 2
    return curve.withColumn("_part", part).groupBy(*cell).agg(F.sum("_part").alias("aurc"))


def aurc_prefix_mean(rows: DataFrame, cell: list[str], score: str | list[Column], correct: str = "correct", order: str = "_ord", window_rows: int = WINDOW_ROWS) -> DataFrame:
    """Mean of the risks of all prefixes: another area, kept apart (SEL-03, WIN-05)."""
    made = ranked(rows, cell, score, correct, order, window_rows)
    return made.groupBy(*cell).agg(F.avg(1 - F.col("hits") / F.col("rn")).alias("aurc_prefix_mean"))


def operating_points(curve: DataFrame, cell: list[str], points: tuple[float, ...] = (0.90, 0.75, 0.50)) -> DataFrame:
    """Risk at some coverages, side by side (SEL-07)."""
    return curve.groupBy(*cell).agg(*[F.max(F.when(F.col("coverage") == F.lit(p), F.col("risk"))).alias(f"risk_at_{round(p * 100)}") for p in points])


def average_rank(value: Column, cell: list[str], descending: bool = False) -> Column:
    """Average rank within a cell, ties sharing theirs (trap 12)."""
    key = value.desc() if descending else value.asc()
    # the frame of rank() is ordered, that of the ties is the value's own partition
    return F.rank().over(Window.partitionBy(*cell).orderBy(key)) + (F.count("*").over(Window.partitionBy(*cell, value)) - 1) / F.lit(2.0)


def distinct_ranks(rows: DataFrame, cell: list[str], value: str, counts: dict[str, Column], window_rows: int = WINDOW_ROWS) -> DataFrame:
    """(cell, value, counts, _n, _rank): a row a different value, with the average rank of its _n rows.

    ``counts`` are aggregates of a value's rows; _n, if they don't give it, is their number. Rows are added up before the shuffle, so
    that the ordered pass is over different values, of which a cell may have any number.
    """
    counts = counts if "_n" in counts else {**counts, "_n": F.count("*")}
    each = rows.groupBy(*cell, value).agg(*[c.alias(n) for n, c in counts.items()])
    made = running(each, cell, [F.col(value).asc()], {"_upto": F.col("_n")}, window_rows)
    return made.withColumn("_rank", F.col("_upto") - (F.col("_n") - 1) / F.lit(2.0)).drop("_upto", "_all__upto")


def with_ranks(rows: DataFrame, cell: list[str], ranks: dict[str, str], window_rows: int = WINDOW_ROWS) -> DataFrame:
    """Rows with the average ranks of some columns (new name: column) and, as ``_size``, the rows of their cell. ``rows`` is read more
    than once, so it should be a table; of one with more than ``window_rows``, each value's rank is taken once and joined back."""
    if rows.count() <= window_rows:
        return rows.withColumns({**{name: average_rank(F.col(c), cell) for name, c in ranks.items()}, "_size": F.count("*").over(Window.partitionBy(*cell))})
    sizes, _ = kept(rows.groupBy(*cell).agg(F.count("*").alias("_size")))
    out = looked_up(rows, sizes, cell, ["_size"], "_size")
    for name, column in ranks.items():
        # a value that most rows have, as zero entropy is, fills no task
        at, _ = kept(distinct_ranks(rows, cell, column, {}, window_rows).select(*cell, column, "_n", F.col("_rank").alias(name)))
        out = looked_up(out, at, [*cell, column], [name], "_n")
    return out


def rank_share(value: Column, cell: list[str], inverted: bool = False) -> Column:
    """Average rank over the cell's size; inverted, one less that (WIN-02). As one expression: a cell must fit a task; ``with_ranks`` asks no such thing."""
    share = average_rank(value, cell) / F.count("*").over(Window.partitionBy(*cell))
    return 1 - share if inverted else share


def combined_ranks(rows: DataFrame, cell: list[str], entropy: str, confidence: str, margin: str, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """Mean of three rank shares, small for predictions to keep (SEL-05). The rows are written once, as they are read for each."""
    held, _ = kept(rows)
    made = with_ranks(held, cell, {"_re": entropy, "_rc": confidence, "_rm": margin}, window_rows)
    share = lambda c: F.col(c) / F.col("_size")
    made = made.withColumns({"r_entropy": share("_re"), "r_confidence": 1 - share("_rc"), "r_margin": 1 - share("_rm")}).drop("_re", "_rc", "_rm", "_size")
    return made.withColumn("combined_3", (F.col("r_entropy") + F.col("r_confidence") + F.col("r_margin")) / 3)


def best_single(areas: DataFrame, cell: list[str], signals: list[str], combined: str, slack: float = 1e-15) -> DataFrame:
    """The best of single signals, the first of equals, and whether the combined one is strictly better (SEL-06)."""
    best = F.least(*signals)
    name = F.coalesce(*[F.when(F.col(s) == best, s) for s in signals])
    return areas.select(*cell, *signals, combined, name.alias("best_single"), best.alias("best_single_value"), (F.col(combined) < best - slack).alias("combined_wins"))


def expected_random_aurc(rows: DataFrame, cell: list[str], correct: str = "correct", params: Params = DEFAULT) -> DataFrame:
    """The area that random order has on average: the error rate times the grid's width (SEL-04)."""
    width = params.grid_step * (params.grid_steps - 1)
    return rows.groupBy(*cell).agg((1 - F.avg(F.col(correct).cast("double"))).alias("error_rate")).withColumn("aurc_random", F.col("error_rate") * F.lit(width))


def auroc(rows: DataFrame, cell: list[str], score: str, positive: str) -> DataFrame:
    """Chance that a positive row has the larger score, ties counting half: from rank sums (SEL-08). Null without both kinds."""
    yes = F.col(positive).cast("boolean")
    at = distinct_ranks(rows.where(F.col(score).isNotNull()), cell, score, {"_yes": F.count_if(yes), "_no": F.count_if(~yes), "_n": F.count("*")})
    made = at.groupBy(*cell).agg(F.sum(F.col("_yes") * F.col("_rank")).alias("_sum"), F.sum("_yes").alias("n1"), F.sum("_no").alias("n0"))
    n1, n0 = F.col("n1"), F.col("n0")
    return made.select(*cell, "n1", "n0", F.when((n1 > 0) & (n0 > 0), (F.col("_sum") - n1 * (n1 + 1) / 2) / (n1 * n0)).alias("auroc"))
