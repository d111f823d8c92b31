"""Running sums in the order of a cell's rows, for cells that no task could hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cuts import delete, kept

#: Rows up to which a cell is one window; more are dealt by ranges of their order.
WINDOW_ROWS = 2_000_000


def running(rows: DataFrame, cell: list[str], keys: list[Column], sums: dict[str, Column], window_rows: int = WINDOW_ROWS) -> DataFrame:
    """Rows with sums of values from the first of their cell to themselves, and ``_all_<name>``, those over the cell.

    ``keys`` must order a cell's rows totally. Rows are written once. Many are then dealt by ranges of (cell, keys), so that a cell may
    lie in any number of tasks; a range adds up its own rows after what the ranges before it hold, one row a cell and range. Sums of
    whole numbers are the same either way.
    """
    adds = {n: f"_add_{n}" for n in sums}
    made = rows.select("*", *[c.alias(adds[n]) for n, c in sums.items()])
    upto = lambda by: Window.partitionBy(*by).orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    over = lambda by: {n: F.sum(a).over(upto(by)) for n, a in adds.items()}
    whole = Window.partitionBy(*cell)
    held, where = kept(made)
    if held.count() <= window_rows:
        return held.withColumns({**over(cell), **{f"_all_{n}": F.sum(a).over(whole) for n, a in adds.items()}}).drop(*adds.values())
    dealt, _ = kept(held.repartitionByRange(*[F.col(c) for c in cell], *keys).withColumn("_range", F.spark_partition_id()))
    delete(rows.sparkSession, where)
    each = dealt.groupBy(*cell, "_range").agg(*[F.sum(a).alias(a) for a in adds.values()])
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = each.select(
        *[F.col(c).alias(f"_of_{c}") for c in cell],
        F.col("_range").alias("_of__range"),
        *[F.coalesce(F.sum(a).over(before), F.lit(0)).alias(f"_before_{n}") for n, a in adds.items()],
        *[F.sum(a).over(whole).alias(f"_all_{n}") for n, a in adds.items()],
    )
    at = dealt.withColumns(over([*cell, "_range"])).join(ranges, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in [*cell, "_range"]])
    return at.withColumns({n: F.col(n) + F.col(f"_before_{n}") for n in sums}).drop("_range", *adds.values(), *[f"_of_{c}" for c in [*cell, "_range"]], *[f"_before_{n}" for n in sums])
