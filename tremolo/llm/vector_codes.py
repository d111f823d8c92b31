"""Operator 12: vectors as codes of 16 parts, each the number of its nearest codebook entry, found by a VA file of the entries.

Components become integers. The codebook of each part position starts from the smallest ids and is refined by rounds of nearest
entries and their means. A search quantises the entries' coordinates into cells of few bits; a query's distances to the ends of the
cells, one small table a coordinate, add up to bounds of its distance to each entry, and only entries whose lower bound doesn't exceed
the least upper bound are measured, in integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .exact_dedup import BROADCAST_NAMES, attached

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: A component x is floor(SCALE * x).
SCALE = 256
#: Integers beyond this, of either sign, count as this: sums of squares of 1,024 differences fit a long.
LIMIT = 1 << 25
#: Bits of a cell number: an entry's coordinate lies in one of 2 ** BITS cells.
BITS = 3
#: Rows of an Arrow batch, and of a block of queries within it.
ROWS = 4096


class EntryFile:
    """The VA file of one part position: entries (n, d), their cells by coordinate, and the cells' ends."""

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        self.entries = entries
        n, d = entries.shape
        cells = min(1 << bits, n)
        self.cell, self.low, self.high = np.zeros((n, d), np.int64), np.zeros((d, cells), np.int64), np.zeros((d, cells), np.int64)
        for k in range(d):
            # cells of about equally many different values; equal values share one
            values, at = np.unique(entries[:, k], return_inverse=True)
            of_value = np.arange(len(values)) * cells // len(values)
            self.cell[:, k] = of_value[at]
            for c in range(cells):
                within = values[of_value == c]
                # an empty cell is nobody's
                self.low[k, c], self.high[k, c] = (within[0], within[-1]) if within.size else (values[0], values[0])

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distances of queries (b, d) to all entries: (b, n) each."""
        low = np.zeros((len(x), len(self.entries)), np.int64)
        high = np.zeros_like(low)
        for k in range(x.shape[1]):
            below, above = self.low[k] - x[:, k, None], x[:, k, None] - self.high[k]
            table = np.maximum(np.maximum(below, above), 0) ** 2
            low += np.take(table, self.cell[:, k], axis=1)
            # the farther end of the cell
            table = np.maximum(-below, -above) ** 2
            high += np.take(table, self.cell[:, k], axis=1)
        return low, high

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The nearest entry of each query, the first of equally near ones, its squared distance, and how many were measured."""
        entry, distance, measured = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64), 0
        for at in range(0, len(x), ROWS):
            part = x[at : at + ROWS]
            low, high = self.bounds(part)
            q, e = np.nonzero(low <= high.min(axis=1, keepdims=True))
            exact = np.full(low.shape, np.iinfo(np.int64).max)
            exact[q, e] = ((part[q] - self.entries[e]) ** 2).sum(axis=1)
            best = exact.argmin(axis=1)
            entry[at : at + ROWS], distance[at : at + ROWS] = best, exact[np.arange(len(part)), best]
            measured += len(q)
        return entry, distance, measured


def whole_numbers(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Components as integers, rounded down, within LIMIT."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(vectors.astype(np.float64) * scale), -LIMIT, LIMIT).astype(np.int64)


def usable(rows: DataFrame, parts: int) -> tuple[DataFrame, int]:
    """(vec_id, vector, label) of the rows that are coded, and the vectors' length: that of the smallest vec_id which ``parts``
    divides; 0 of none."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    kept = rows.where(F.col("vector").isNotNull()).where(F.forall("vector", finite)).where((F.size("vector") > 0) & (F.size("vector") % parts == 0))
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select(F.size("vector")).first()
    return (kept.where(F.size("vector") == first[0]), first[0]) if first else (kept.limit(0), 0)


def matrix(batch: pa.RecordBatch, length: int) -> np.ndarray:
    """The batch's vectors, (rows, length); all are of that length and whole."""
    return whole_numbers(batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, length))


def refined(kept: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks (parts, entries, d) with each entry replaced by the mean, rounded down, of the parts nearest to it.

    A task adds up its own rows, so what is shuffled and collected is a row an entry and coordinate, whatever the input.
    """
    parts, entries, d = books.shape
    sent = kept.sparkSession.sparkContext.broadcast(books)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = [EntryFile(book) for book in sent.value]
        sums, counts = np.zeros((parts, entries, d), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            x = matrix(batch, parts * d).reshape(-1, parts, d)
            for p, file in enumerate(files):
                entry, _, _ = file.nearest(x[:, p])
                np.add.at(sums[p], entry, x[:, p])
                counts[p] += np.bincount(entry, minlength=entries)
        p, e = np.nonzero(counts)
        if p.size:
            place = np.repeat(p * entries + e, d) * d + np.tile(np.arange(d), len(p))
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(sums[p, e].ravel()), pa.array(np.repeat(counts[p, e], d))], ["place", "total", "n"])
        common.release()

    added = kept.select("vector").mapInArrow(add_up, "place long, total long, n long").groupBy("place").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    out = books.reshape(-1).copy()
    for r in added.collect():
        out[r.place] = r.total // r.n
    return out.reshape(books.shape)


def coded(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """``kept`` with its codes (an entry number a part) and error, for its vector."""
    parts, _, d = books.shape
    sent = kept.sparkSession.sparkContext.broadcast(books)
    others = [c for c in kept.columns if c != "vector"]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = [EntryFile(book) for book in sent.value]
        for batch in batches:
            x = matrix(batch, parts * d).reshape(-1, parts, d)
            codes, error = np.zeros((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p, file in enumerate(files):
                codes[:, p], distance, _ = file.nearest(x[:, p])
                error += distance
            code = pa.array([c.tobytes() for c in codes], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), code, pa.array(error)], [*others, "code", "error"])
        common.release()

    types = dict(kept.dtypes)
    return kept.select(*others, "vector").mapInArrow(assign, ", ".join([*(f"{c} {types[c]}" for c in others), "code binary", "error long"]))


def fit(kept: DataFrame, length: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts, entries, d) from the vectors of the smallest vec_ids, refined ``rounds`` times over all rows."""
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    books = whole_numbers(np.array([r.vector for r in first])).reshape(len(first), parts, length // parts).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        books = refined(kept, books)
    return books


@common.tidy
def compress(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """Per row of ``embeddings`` (vec_id, embedding, label, any more) with a whole vector: vec_id, label, code, error, label_error;
    and the codebooks, (parts, entries, coordinates of a part).

    ``code`` has a byte a part, ``error`` the squared distance of the integer vector to its entries, ``label_error`` the errors added
    up over rows of an equal label, nulls together. Rows whose vector is null or has a null, NaN or infinite component are left out,
    and so are empty vectors, those that can't be cut into ``parts`` equal parts, and those of another length than the smallest vec_id
    among the others. Components beyond 131,072 count as that. Ties go to the first entry; rows of equal vec_ids are ordered by their
    vectors, null vec_ids last. Repeated rows come out each. Fewer rows than ``entries`` make fewer entries. An empty table gives none
    and codebooks without entries; other columns, whatever their names, aren't read. A part of ``entries`` numbers, 256 at most.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has a byte a part: 1 to 256 entries")
    common.bounded_batches(embeddings.sparkSession, ROWS)
    kept, length = usable(embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"), "label"), parts)
    if not length:
        books = np.zeros((parts, 0, 0), np.int64)
        return kept.select("vec_id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error")), books
    books = fit(kept, length, parts, entries, rounds)
    rows = common.cut(coded(kept, books), keep=True)
    # a row a label: broadcast, or joined by a shuffle in which no label has many rows
    labels = common.cut(rows.groupBy("label").agg(F.count("*").alias("times"), F.sum("error").alias("label_error")), keep=True)
    if labels.count() <= BROADCAST_NAMES:
        told = F.broadcast(labels.select(F.col("label").alias("of_label"), "label_error"))
        return rows.join(told, F.col("label").eqNullSafe(F.col("of_label"))).select("vec_id", "label", "code", "error", "label_error"), books
    named = rows.withColumn("row", F.monotonically_increasing_id())
    some, none = named.where("label is not null"), named.where("label is null")
    of_nulls = labels.where("label is null").agg(F.max("label_error")).first()[0]
    both = attached(some, labels.where("label is not null"), ["label"], ["label_error"], "row").unionByName(none.withColumn("label_error", F.lit(of_nulls).cast("long")))
    return both.select("vec_id", "label", "code", "error", "label_error"), books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' integers by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``embeddings``."""
    codes, books = compress(common.table(spark, sf_dir, "embeddings"))
    return codes.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _rounds() -> str:
    """A CTE a round: distances of all parts to all entries, the nearest, and the means."""
    down = "(sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*)"
    out = ""
    for k in range(ROUNDS + 1):
        out += f"""
a{k} as (select row, part, min_by(entry, (dist, entry)) as entry, min(dist) as dist from (
  select c.row, c.part, b.entry, sum((c.x - b.x) * (c.x - b.x))::bigint as dist from parts c join b{k} b on c.part = b.part and c.k = b.k group by all) group by row, part),"""
        if k < ROUNDS:
            out += f"""
b{k + 1} as (select b.part, b.entry, b.k, coalesce(m.x, b.x) as x from b{k} b left join (
  select part, entry, k, ({down})::bigint as x from parts join a{k} using (row, part) group by all) m using (part, entry, k)),"""
    return out


#: The same rows in SQL.
ORACLE = f"""
with kept as (select vec_id, label, embedding, row_number() over (order by vec_id nulls last, embedding) - 1 as row, len(embedding) // {PARTS} as d from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(embedding) > 0),
parts as (select row, (i - 1) // d as part, (i - 1) % d as k, floor({SCALE} * embedding[i]::double)::bigint as x from (select row, d, embedding, unnest(range(1, len(embedding) + 1)) as i from kept)),
b0 as (select part, row as entry, k, x from parts where row < {ENTRIES}),{_rounds()}
told as (select row, string_agg(printf('%02x', entry), '' order by part) as code, sum(dist)::bigint as error from a{ROUNDS} group by row),
book as (select sha256(string_agg(x::varchar, ',' order by part, entry, k)) as codebooks_sha256 from b{ROUNDS})
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from kept join told using (row) cross join book
"""
