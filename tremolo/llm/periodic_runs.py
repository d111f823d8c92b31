"""Operator 11: periodic runs of words, by divide and conquer over interned word ids.

The texts of a batch lie one after the other in one array of word ids, with numbers of their own between them. Level by level the
array is halved: a run inside a segment either lies in one of its halves or crosses its midpoint. Of a run that repeats its period
four times or more, one side of the midpoint holds two periods at least, so the Z-function of that side (from the midpoint outwards)
tells every period that can cross it. What it tells is extended over the midpoint; a run that goes on beyond its segment belongs to a
larger one. Equal intervals are one run, of the smallest period.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_WORDS, MIN_EXPONENT = 6, 4
#: Words that a period is held against for all midpoints of a level at once, before its Z value is taken.
LOOK = 16
RUN = "array<struct<start:long,length:long,period:long>>"
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def same_ahead(x: np.ndarray, a: int, b: int, most: int) -> int:
    """How many words from a and from b on are the same, ``most`` at most."""
    k, step = 0, 32
    while k < most:
        n = min(step, most - k)
        differ = x[a + k : a + k + n] != x[b + k : b + k + n]
        i = int(differ.argmax())
        if differ[i]:
            return k + i
        k, step = k + n, min(4 * step, 1 << 16)
    return most


def hopeful(x: np.ndarray, half: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(midpoint, period) of a level, by midpoint and period: those where the first min(LOOK, period) words after the midpoint come
    again a period later."""
    side = x.reshape(-1, 2 * half)[:, half : half + reach]
    row, q = np.nonzero(side[:, 1 : reach // 2 + 1] == side[:, :1])
    m, q = row * (2 * half) + half, q + 1
    told = []
    for k in range(1, LOOK):
        short = q <= k
        told.append((m[short], q[short]))
        m, q = m[~short], q[~short]
        same = x[m + q + k] == x[m + k]
        m, q = m[same], q[same]
    told.append((m, q))
    m, q = (np.concatenate(part) for part in zip(*told, strict=True))
    order = np.lexsort((q, m))
    return m[order], q[order]


def squares(x: np.ndarray, m: int, reach: int, periods: np.ndarray) -> list[tuple[int, int]]:
    """(q, end): the words from m on have period q up to m + end, two periods at least; multiples of a smaller one are left out.

    The Z-function at the hopeful periods: what lies in the farthest match so far is known from its beginning. All others agree with
    the beginning in fewer than LOOK words.
    """
    known: dict[int, int] = {}
    found: list[tuple[int, int]] = []
    left = right = 0
    while periods.size:
        q = int(periods[0])
        periods = periods[1:]
        z = min(q, LOOK)
        if q < right:
            back = q - left
            before = known.get(back)
            if before is None:
                before = next((end - back for p, end in found if back % p == 0 and 2 * back <= end), 0)
            z = max(z, min(before, right - q))
        z += same_ahead(x, m + q + z, m + z, reach - q - z)
        known[q] = z
        if q + z > right:
            left, right = q, q + z
        if z >= q:
            found.append((q, q + z))
            periods = periods[(periods % q != 0) | (2 * periods > q + z)]
    return found


def outward(x: np.ndarray, longest: int, min_words: int, min_exponent: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of the runs that have two periods right of the midpoint of the smallest segment around them."""
    n, back = len(x), x[::-1]
    half = 4
    while 2 * half <= n:
        reach = min(half, longest)
        ms, qs = hopeful(x, half, reach)
        cuts = np.flatnonzero(np.diff(ms)) + 1
        for m, periods in zip(ms[np.r_[:1, cuts]] if ms.size else [], np.split(qs, cuts), strict=False):
            m = int(m)
            for q, end in squares(x, m, reach, periods):
                start, end = m - same_ahead(back, n - m, n - m - q, half), m + end
                further = (start == m - half and start and x[start - 1] == x[start - 1 + q]) or (end < n and x[end] == x[end - q])
                if not further and end - start >= max(min_words, min_exponent * q):
                    yield start, end, q
        half *= 2


def runs_of(x: np.ndarray, longest: int, min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, end, period) of all runs of the array, by start and period; none is longer than ``longest``.

    ``x`` has a power of two of numbers. ``min_exponent`` is 4 or more.
    """
    n, found = len(x), {}
    for s, e, q in outward(x, longest, min_words, min_exponent):
        found[s, e] = min(q, found.get((s, e), q))
    for s, e, q in outward(x[::-1].copy(), longest, min_words, min_exponent):
        found[n - e, n - s] = min(q, found.get((n - e, n - s), q))
    return sorted((s, e, q) for (s, e), q in found.items())


def laid_out(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' word ids in one array of a power of two of numbers, no two apart from them equal, and where each text begins."""
    ids: dict[bytes, int] = defaultdict()
    ids.default_factory = ids.__len__
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    size = 8
    while size < begins[-1]:
        size *= 2
    x = -1 - np.arange(size, dtype=np.int64)
    for begin, words in zip(begins, texts, strict=False):
        x[begin : begin + len(words)] = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
    return x.astype(np.int32) if size < 1 << 31 else x, begins


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words, joined by one space, without those that a run contains after its first period."""
    if runs:
        keep = np.ones(len(words), bool)
        for s, e, q in runs:
            keep[s + q : e] = False
        words = list(compress(words, keep.tolist()))
    return b" ".join(words)


def collapse(docs: DataFrame, min_words: int = MIN_WORDS, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, any more): doc_id, n_words, runs and the text without its repetitions.

    A run is a stretch of consecutive words of smallest period q and at least max(min_words, min_exponent * q) words that no
    neighbouring word extends; ``runs`` has (start, length, period) by start and period, ``text`` the words that no run contains
    after its first q, with one space between. Words are what ASCII white space parts. Null, empty and white texts have no words and
    no runs. Very long texts are read whole, n log n steps for n words whatever they repeat. Repeated rows come out each, equal texts
    with equal runs; null doc_ids stay null. An empty table gives none; other columns, whatever their names, aren't read.
    """
    if min_exponent < 4:
        raise ValueError("min_exponent must be 4 or more: one side of a midpoint has to hold two periods")
    common.bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode().split() if t else [] for t in batch.column("text").to_pylist()]
            x, begins = laid_out(texts)
            of: list[list[tuple[int, int, int]]] = [[] for _ in texts]
            found = runs_of(x, max(map(len, texts), default=0), min_words, min_exponent)
            for (s, e, q), k in zip(found, np.searchsorted(begins, [s for s, _, _ in found], "right") - 1, strict=True):
                of[k].append((s - int(begins[k]), e - int(begins[k]), q))
            rows = [[{"start": s, "length": e - s, "period": q} for s, e, q in runs] for runs in of]
            short = [collapsed(words, runs).decode() for words, runs in zip(texts, of, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, texts), pa.int64()), pa.array(rows, RUNS), pa.array(short, pa.string())], ["doc_id", "n_words", "runs", "text"])
        common.release()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, n_words long, runs {RUN}, text string")


def looped(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of the query's texts: with h = crc32(doc_id) and g = h div 10, where h mod 10 is 0 and the text has n words, each
    word from number a = g mod n on is the original word a + (i - a) mod p, p = 1 + (n - a) div (3 + g mod 8)."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all(F.col("text"), F.lit(common.NOT_SPACE), F.lit(0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), h.alias("h"))
    rows = rows.withColumn("words", F.when(F.col("h") % 10 == 0, words)).withColumns({"n": F.size("words"), "g": F.expr("h div 10")})
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n"))).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    made = F.concat(F.expr("slice(words, 1, cast(a as int))"), F.transform(F.expr("sequence(a, n - 1)"), lambda i: F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(made, " ")).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """The query's columns from the operator's: the run of the greatest exact exponent (the first of equal ones), and hashes."""
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    better = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    best = F.aggregate("runs", none, lambda held, r: F.when(better(held, r), r).otherwise(held))
    line: Column = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"], F.lit(None).cast("string"))), "\n")
    every = F.when(F.size("runs") > 0, F.concat(line, F.lit("\n"))).otherwise("")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(F.encode(every, "UTF-8"), 256).alias("runs_sha256"), F.sha2(F.encode("text", "UTF-8"), 256).alias("collapsed_sha256"),
    )


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``, a tenth of them made periodic from some word on."""
    return digests(collapse(looped(common.table(spark, sf_dir, "documents"))))
