"""Question answering: answer clusters, scores and summaries."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import contains_gold, exact_match, is_empty_answer, token_f1
from ..params import DEFAULT
from ..providers import Nli


def cluster_answers(answers: list[str], nli: Nli, least: float = DEFAULT.entailment) -> list[int]:
    """Cluster of each answer: equal but for case and outer blanks, or entailed both ways, and so on from there; blank with blank alone.
    Numbered as first seen."""
    top = list(range(len(answers)))

    def find(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    answers = [a or "" for a in answers]
    texts = [a.strip().lower() for a in answers]
    for i in range(len(texts)):
        for j in range(i):
            if find(i) == find(j):
                continue
            same = texts[i] == texts[j] or (texts[i] and texts[j] and min(nli.entailment([answers[i], answers[j]], [answers[j], answers[i]])) >= least)
            if same:
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    names: dict[int, int] = {}
    return [names.setdefault(find(i), len(names)) for i in range(len(texts))]


#: Pairs of answers that a provider is asked for at a time.
PAIRS = 4096


def forest(answers: list[str], nli: Nli, pairs: int = PAIRS) -> list[tuple[float, int, int]]:
    """(weight, i, j), heaviest first: a maximum spanning forest of different answers, weighed by the lesser entailment of both ways.

    Answers that are equal but for case and outer blanks weigh infinity, blank ones with others nothing. Those linked at any threshold
    are those linked by edges of the forest that reach it; a forest has fewer edges than answers, and only pairs of one batch are held
    beside it.
    """
    texts = [a.strip().lower() for a in answers]
    first: dict[str, int] = {}
    edges = [(math.inf, first[t], i) for i, t in enumerate(texts) if first.setdefault(t, i) != i]
    batch: list[tuple[int, int]] = []

    def add() -> None:
        nonlocal edges
        left, right = [answers[i] for i, _ in batch], [answers[j] for _, j in batch]
        told = list(nli.entailment([*left, *right], [*right, *left]))
        edges += [(min(told[k], told[k + len(batch)]), i, j) for k, (i, j) in enumerate(batch)]
        edges = _spanning(len(answers), edges)
        batch.clear()

    for j in range(len(answers)):
        for i in range(j):
            if texts[i] and texts[j] and texts[i] != texts[j]:
                batch.append((i, j))
                if len(batch) == pairs:
                    add()
    if batch:
        add()
    return _spanning(len(answers), edges)


def _spanning(n: int, edges: list[tuple[float, int, int]]) -> list[tuple[float, int, int]]:
    top = list(range(n))
    kept = []
    for w, i, j in sorted(edges, key=lambda e: (-e[0], e[1], e[2])):
        a, b = _root(top, i), _root(top, j)
        if a != b:
            top[max(a, b)] = min(a, b)
            kept.append((w, i, j))
    return kept


def _root(top: list[int], i: int) -> int:
    while top[i] != i:
        top[i] = top[top[i]]
        i = top[i]
    return i


def _different(rows: DataFrame, cell: list[str], answer: str, order: str) -> DataFrame:
    """The different answers of each cell and where each comes first; null is blank."""
    return rows.select(*cell, F.coalesce(answer, F.lit("")).alias("_answer"), order).groupBy(*cell, "_answer").agg(F.min(order).alias("_first"))


def answer_clusters(rows: DataFrame, cell: list[str], answer: str, nli: Nli, order: str = "_ord", least: float = DEFAULT.entailment) -> DataFrame:
    """The rows with their cluster, numbered as first seen (CLU-01). A cell's different answers, an instance's few, go to a worker; rows
    find their cluster by their answer."""
    types = dict(rows.dtypes)

    def one(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_first", "_answer"], ignore_index=True)
        top = list(range(len(group)))
        for w, i, j in forest(group["_answer"].tolist(), nli):
            if w >= least:
                a, b = _root(top, i), _root(top, j)
                top[max(a, b)] = min(a, b)
        names: dict[int, int] = {}
        group["cluster"] = [names.setdefault(_root(top, i), len(names)) for i in range(len(group))]
        return group.drop(columns="_first")

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in cell), "_answer string, cluster long"])
    found = _different(rows, cell, answer, order).groupBy(*cell).applyInPandas(one, schema)
    found = found.select(*[F.col(c).alias(f"_of_{c}") for c in cell], "_answer", "cluster")
    same = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in cell] + [F.coalesce(answer, F.lit("")) == F.col("_answer")]
    return rows.select(*cell, order, answer).join(found, same).select(*cell, order, answer, "cluster")


def threshold_sweep(rows: DataFrame, cell: list[str], answer: str, nli: Nli, thresholds: list[float], order: str = "_ord") -> DataFrame:
    """Number of clusters of each cell at each threshold (STA-28): pairs are scored once, and one pass over a cell's forest tells all."""
    types = dict(rows.dtypes)

    def one(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        weights = [w for w, _, _ in forest(group["_answer"].tolist(), nli)]
        return pd.DataFrame([(*key, t, len(group) - sum(w >= t for w in weights)) for t in thresholds])

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in cell), "threshold double", "n_clusters long"])
    return _different(rows, cell, answer, order).groupBy(*cell).applyInPandas(one, schema)


def scored(rows: DataFrame, key: list[str], pred: str, golds: str, unanswerable: str | None = None, contained: bool = False) -> DataFrame:
    """(key, em, f1, contained, correct): the best over the gold answers of a row (STR-05, STR-06).

    Of an unanswerable question all tell whether the answer is empty; an empty answer to another that has golds is wrong. Correct is
    an exact match, or with ``contained`` (the other corpus' rule, which knows no empty answers) that a gold equals the answer or
    stands in it. Stays within the row: no shuffle.
    """
    p, gs = F.col(pred), F.coalesce(F.col(golds), F.array().cast("array<string>"))
    one = lambda hit: F.coalesce(hit, F.lit(False))
    equal, inside = one(F.exists(gs, lambda g: exact_match(p, g))), one(F.exists(gs, lambda g: contains_gold(p, g)))
    best = F.coalesce(F.array_max(F.transform(gs, lambda g: token_f1(p, g))), F.lit(0.0))
    if contained:
        ok = equal | inside
        return rows.select(*key, ok.cast("int").alias("em"), ok.cast("double").alias("f1"), inside.cast("int").alias("contained"), ok.cast("int").alias("correct"))
    empty = one(is_empty_answer(p))
    un = F.coalesce(F.col(unanswerable), F.lit(False)) if unanswerable else F.lit(False)
    wrong = empty & (F.size(gs) > 0)
    em = F.when(un, empty).otherwise(~wrong & equal).cast("int")
    f1 = F.when(un, empty.cast("double")).when(wrong, F.lit(0.0)).otherwise(best)
    return rows.select(*key, em.alias("em"), f1.alias("f1"), (~wrong & inside).cast("int").alias("contained"), em.alias("correct"))
