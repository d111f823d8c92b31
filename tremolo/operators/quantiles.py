"""Exact quantiles of groups of any size, by selection.

Each wanted rank is first bracketed by Spark's mergeable sketch, then the rows within the brackets are counted by value, narrower and
narrower while there are many. A task holds sketches and the few different values within a bracket, never a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cuts import kept

#: Precision of the sketch: a bracket has some 4 / ACCURACY of its group's rows.
ACCURACY = 2000
#: Rows within a bracket at which its values are put in order.
FEW_ROWS = 100_000
#: Groups times ranks that are broadcast.
BROADCAST_RANKS = 100_000


def _null_safe(rows: DataFrame, by: list[str], other: DataFrame) -> DataFrame:
    named = other.select(*[F.col(c).alias(f"_of_{c}") if c in by else F.col(c) for c in other.columns])
    return rows.join(named, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by] or F.lit(True)).drop(*[f"_of_{c}" for c in by])


def _bounded(ranks: DataFrame) -> DataFrame:
    """A written table of brackets, broadcast if it is small."""
    made, _ = kept(ranks)
    return F.broadcast(made) if made.limit(BROADCAST_RANKS + 1).count() <= BROADCAST_RANKS else made


def order_statistics(rows: DataFrame, by: list[str], value: str, ranks: DataFrame, few_rows: int = FEW_ROWS, accuracy: int = ACCURACY) -> DataFrame:
    """(by, _rank, value): of each group the value at some ranks, from 0. ``ranks`` has (by, _rank, _n), _n the group's rows; ``rows`` is
    read several times, so it should be a table, without nulls or NaN."""
    state = ranks.select(*by, "_rank", F.col("_rank").alias("_left"), F.col("_n").alias("_within"), F.lit(None).cast("double").alias("_lo"), F.lit(None).cast("double").alias("_hi"), F.lit(False).alias("_ties"))
    own = rows.select(*by, F.col(value).cast("double").alias("_v"))
    inside = (F.col("_lo").isNull() | (F.col("_v") >= F.col("_lo"))) & (F.col("_hi").isNull() | (F.col("_v") <= F.col("_hi")))
    done = None
    while True:
        held = _bounded(state)
        ready = (F.col("_within") <= few_rows) | F.col("_ties")
        small = held.where(ready)
        counted = _null_safe(own, by, small).where(inside).groupBy(*by, "_rank", "_left", "_v").agg(F.count("*").alias("_k"))
        upto = Window.partitionBy(*by, "_rank").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
        found = counted.withColumn("_upto", F.sum("_k").over(upto)).where((F.col("_left") < F.col("_upto")) & (F.col("_left") >= F.col("_upto") - F.col("_k"))).select(*by, "_rank", F.col("_v").alias("value"))
        found, _ = kept(found)
        done = found if done is None else done.unionByName(found)
        rest = held.where(~ready)
        if not rest.limit(1).count():
            return done
        # a sketch of what lies within each bracket, just left and right of the wanted rank
        within = _null_safe(own, by, rest).where(inside)
        steps = accuracy // 2
        sketch = F.percentile_approx("_v", [i / steps for i in range(steps + 1)], accuracy)
        sketched = within.groupBy(*by, "_rank").agg(sketch.alias("_p"), F.min("_v").alias("_a"), F.max("_v").alias("_z"), F.floor((F.min("_left") + 0.5) / F.min("_within") * steps).cast("int").alias("_at"))
        low = F.when(F.col("_at") < 2, F.col("_a")).otherwise(F.get("_p", F.col("_at") - 1))
        high = F.when(F.col("_at") + 2 > steps, F.col("_z")).otherwise(F.get("_p", F.col("_at") + 2))
        narrower, _ = kept(sketched.select(*by, "_rank", low.alias("_lo"), high.alias("_hi")))
        old = rest.withColumnsRenamed({"_lo": "_plo", "_hi": "_phi"}).drop("_ties")
        both = _bounded(_null_safe(old, [*by, "_rank"], narrower))
        was = (F.col("_plo").isNull() | (F.col("_v") >= F.col("_plo"))) & (F.col("_phi").isNull() | (F.col("_v") <= F.col("_phi")))
        counts = _null_safe(own, by, both).where(was).groupBy(*by, "_rank", "_left", "_within", "_lo", "_hi", "_plo", "_phi").agg(F.count_if(F.col("_v") < F.col("_lo")).alias("_below"), F.count_if((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))).alias("_in"))
        hit = (F.col("_left") >= F.col("_below")) & (F.col("_left") < F.col("_below") + F.col("_in"))
        # had a sketch told wrong, the bracket would be what it was
        state = counts.select(
            *by, "_rank",
            F.when(hit, F.col("_left") - F.col("_below")).otherwise(F.col("_left")).alias("_left"),
            F.when(hit, F.col("_in")).otherwise(F.col("_within")).alias("_within"),
            F.when(hit, F.col("_lo")).otherwise(F.col("_plo")).alias("_lo"), F.when(hit, F.col("_hi")).otherwise(F.col("_phi")).alias("_hi"),
            # half the rows or more in so narrow a bracket are ties: few different values
            (~hit | (2 * F.col("_in") > F.col("_within"))).alias("_ties"),
        )


def quantiles(rows: DataFrame, by: list[str], value: str, shares: list[float], few_rows: int = FEW_ROWS, accuracy: int = ACCURACY) -> DataFrame:
    """(by, n, q): per group its rows and the list of its exact quantiles at ``shares``, linear between neighbours (AGG-19, AGG-20).
    Nulls and NaN don't count; a group of them alone isn't there."""
    held, _ = kept(rows.select(*by, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v")))
    sizes, _ = kept(held.groupBy(*by).agg(F.count("*").alias("_n")))
    places = F.array(*[F.lit(float(s)) for s in shares])
    at = sizes.withColumn("_at", F.transform(places, lambda s: s * (F.col("_n") - 1)))
    wanted = at.select(*by, "_n", F.explode(F.array_distinct(F.flatten(F.transform("_at", lambda x: F.array(F.floor(x), F.ceil(x)))))).alias("_rank"))
    found = order_statistics(held, by, "_v", wanted, few_rows, accuracy)
    # a group has two rows a share at most
    listed = found.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "value"))).alias("_m"))
    pick = lambda x: F.element_at("_m", F.floor(x)) + (x - F.floor(x)) * (F.element_at("_m", F.ceil(x)) - F.element_at("_m", F.floor(x)))
    return _null_safe(at, by, listed).select(*by, F.col("_n").alias("n"), F.transform("_at", pick).alias("q"))


def binned(rows: DataFrame, by: list[str], value: str, shares: list[float], **how) -> DataFrame:
    """Rows with ``bin``, from 1: one more than the quantile edges below the value; ties stay in one bin (WIN-07, WIN-08)."""
    held, _ = kept(rows)
    edges = _bounded(quantiles(held, by, value, shares, **how).select(*by, "q"))
    return _null_safe(held, by, edges).withColumn("bin", 1 + F.size(F.filter("q", lambda e: e < F.col(value)))).drop("q")
