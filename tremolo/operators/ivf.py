"""Inverted-file index over vectors (VEC-04): k-means cells, queries against their nearest cells, and an exact completion.

Cells are fitted on a bounded sample; every form is assigned. A form f of a cell with centre m and radius r (its farthest member) has
q.f <= q.m + |q| r, so after a search it is known which cells could still hold a better form: ``search(..., exact=True)`` looks them up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cuts import kept
from .retrieval import SCORED, best, top_of_block, topk

#: Rows that the cells are fitted on, at most: those with the smallest hashes of their form_ids. Every row is indexed.
SAMPLE_ROWS = 65_536
#: Cells, at most; each has its centre on the driver and in the workers. Sample rows a cell, at least.
MOST_CELLS, ROWS_A_CELL = 4096, 16
#: Cells that a query is held against.
PROBES = 64
#: Forms, and queries, that meet in a task; larger cells are dealt out in parts.
PART_ROWS, PART_QUERIES = 20_000, 5_000


@dataclass(frozen=True)
class Index:
    """Centres (cells, d), the farthest member's distance of each, its rows, and the forms as a table (cell, form_id, vector)."""

    centres: np.ndarray
    radius: np.ndarray
    rows: np.ndarray
    table: DataFrame


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x @ centres.T - (centres**2).sum(1) / 2).argmax(1)


def fit_cells(x: np.ndarray, cells: int, rounds: int = 10, seed: int = 42) -> np.ndarray:
    """k-means of a sample; a cell that loses its members takes the row farthest from its centre."""
    draw = np.random.default_rng(seed)
    centres = x[draw.choice(len(x), cells, replace=False)].copy()
    for _ in range(rounds):
        cell = np.concatenate([nearest_centre(x[at : at + 4096], centres) for at in range(0, len(x), 4096)])
        n = np.bincount(cell, minlength=cells)
        order = np.argsort(cell, kind="stable")
        held = np.flatnonzero(n)
        sums = np.add.reduceat(x[order], (np.cumsum(n) - n)[held], axis=0)
        centres[held] = sums / n[held, None]
        empty = np.flatnonzero(n == 0)
        if empty.size:
            far = ((x - centres[cell]) ** 2).sum(1)
            centres[empty] = x[np.argsort(-far, kind="stable")[: empty.size]]
    return centres


def build(forms: DataFrame, cells: int | None = None, sample_rows: int = SAMPLE_ROWS, seed: int = 42) -> Index:
    """The index of (form_id, vector). ``cells`` is the square root of the number of rows unless given."""
    n = forms.count()
    if not n:
        raise ValueError("an index needs a row")
    share = min(1.0, 1.2 * sample_rows / n)
    some = forms.where(F.pmod(F.xxhash64("form_id"), F.lit(1 << 30)) < int(share * (1 << 30))) if n > sample_rows else forms
    sample = some.orderBy(F.xxhash64("form_id"), "form_id").limit(sample_rows).select("vector").collect()
    x = np.array([r[0] for r in sample], np.float64)
    cells = max(1, min(cells or int(np.sqrt(n)), MOST_CELLS, len(x) if cells else max(1, len(x) // ROWS_A_CELL)))
    centres = fit_cells(x, cells, seed=seed)
    sent = forms.sparkSession.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                own = np.stack(batch["vector"].to_numpy()).astype(np.float64)
                cell = nearest_centre(own, sent.value)
                yield batch.assign(cell=cell, distance=np.sqrt(((own - sent.value[cell]) ** 2).sum(1)))

    table, _ = kept(forms.select("form_id", "vector").mapInPandas(assign, f"form_id long, vector {dict(forms.dtypes)['vector']}, cell long, distance double"))
    radius, rows = np.zeros(cells), np.zeros(cells, np.int64)
    for r in table.groupBy("cell").agg(F.max("distance").alias("radius"), F.count("*").alias("n")).collect():
        radius[r.cell], rows[r.cell] = r.radius, r.n
    return Index(centres, radius, rows, table.drop("distance"))


def probes(index: Index, queries: DataFrame, n: int) -> DataFrame:
    """(query_id, vector, cell): each query with the n cells whose centres it likes best."""
    sent = queries.sparkSession.sparkContext.broadcast((index.centres, index.rows))

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres, rows = sent.value
        for batch in batches:
            if len(batch):
                likes = np.stack(batch["vector"].to_numpy()).astype(np.float64) @ centres.T
                likes[:, rows == 0] = -np.inf
                cells = np.argsort(-likes, axis=1, kind="stable")[:, : min(n, int((rows > 0).sum()))]
                yield batch.assign(cell=list(cells)).explode("cell").astype({"cell": "int64"})

    return queries.select("query_id", "vector").mapInPandas(pick, f"query_id long, vector {dict(queries.dtypes)['vector']}, cell long")


def open_cells(index: Index, queries: DataFrame, n: int) -> DataFrame:
    """(query_id, vector, cell) of the cells beyond the first n that may hold a form as good as ``least``, a column of ``queries``."""
    sent = queries.sparkSession.sparkContext.broadcast((index.centres, index.radius, index.rows))

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres, radius, rows = sent.value
        for batch in batches:
            if len(batch):
                q = np.stack(batch["vector"].to_numpy()).astype(np.float64)
                likes = q @ centres.T
                likes[:, rows == 0] = -np.inf
                most = likes + np.sqrt((q**2).sum(1))[:, None] * radius
                least = batch["least"].to_numpy()[:, None]
                may = most >= least - 1e-9 * np.maximum(1, np.abs(least))
                np.put_along_axis(may, np.argsort(-likes, axis=1, kind="stable")[:, :n], False, axis=1)
                may[:, rows == 0] = False
                at, cell = np.nonzero(may)
                yield batch.iloc[at][["query_id", "vector"]].assign(cell=cell)

    return queries.mapInPandas(pick, f"query_id long, vector {dict(queries.dtypes)['vector']}, cell long")


def probes_for(index: Index, queries: DataFrame, k: int, recall: float = 0.95, sample: int = 64) -> int:
    """The cells to ask for so that ``recall`` of the k best are in them, measured on at most ``sample`` queries (those of the smallest
    hashes) against a scan of all forms. Where neighbours lie in many cells, as in noise, that is most of the index."""
    some = queries.select("query_id", "vector").orderBy(F.xxhash64("query_id"), "query_id").limit(sample)
    asked = {r.query_id: r.vector for r in some.collect()}
    if not asked:
        return PROBES
    exact = topk(some, index.table.select("form_id", "vector"), k).select("query_id", "form_id")
    # k rows a sampled query
    pairs = exact.join(index.table.select("form_id", "cell"), "form_id").select("query_id", "cell").collect()
    names = list(asked)
    likes = np.array([asked[n] for n in names], np.float64) @ index.centres.T
    likes[:, index.rows == 0] = -np.inf
    place = np.empty(likes.shape, np.int64)
    np.put_along_axis(place, np.argsort(-likes, axis=1, kind="stable"), np.broadcast_to(np.arange(likes.shape[1]), likes.shape), axis=1)
    at = {n: i for i, n in enumerate(names)}
    needed = np.sort([place[at[r.query_id], r.cell] + 1 for r in pairs])
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])


def within(index: Index, asked: DataFrame, k: int, part_rows: int = PART_ROWS, part_queries: int = PART_QUERIES) -> DataFrame:
    """(query_id, form_id, score): the k best of each asked cell's parts. A cell of many forms or queries is a grid of parts, a pair
    of parts a task, so that none grows with the hottest cell."""
    spark = asked.sparkSession
    held, _ = kept(asked)
    n_asked = {r.cell: r["count"] for r in held.groupBy("cell").count().collect()}
    if not n_asked:
        return spark.createDataFrame([], SCORED)
    parts = [(c, max(1, -(-int(index.rows[c]) // part_rows)), -(-n // part_queries)) for c, n in n_asked.items()]
    grid = F.broadcast(spark.createDataFrame(parts, "cell long, _fs int, _qs int"))
    deal = lambda rows, key, own, n, other, m: rows.join(grid, "cell").select("cell", key, "vector", F.pmod(F.xxhash64(key), F.col(n)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.col(m) - 1)).alias(other))
    left, right = deal(held, "query_id", "_q", "_qs", "_f", "_fs"), deal(index.table, "form_id", "_f", "_fs", "_q", "_qs")

    def pair(q: pd.DataFrame, f: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(f):
            return pd.DataFrame({"query_id": [], "form_id": [], "score": []})
        return top_of_block(q["query_id"].to_numpy(), np.stack(q["vector"].to_numpy()).astype(np.float64), f, k)

    by = ["cell", "_q", "_f"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(pair, SCORED)


def search(index: Index, queries: DataFrame, k: int, n: int = PROBES, exact: bool = False) -> DataFrame:
    """(query_id, form_id, score, rank) of (query_id, vector) in the n nearest cells; with ``exact``, also in every cell that may hold
    one of the k best, so that the result is that of a scan of all forms."""
    first, _ = kept(best(within(index, probes(index, queries, n), k), k))
    if not exact:
        return first
    least = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(float("-inf"))).alias("least"))
    rest = queries.select("query_id", "vector").join(least, "query_id", "left").fillna(float("-inf"), ["least"])
    more = within(index, open_cells(index, rest, n), k)
    return best(first.drop("rank").unionByName(more), k)
