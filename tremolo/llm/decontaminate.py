"""Operator 6: benchmark decontamination with one Aho-Corasick automaton over normalised windows of the test items.

Texts are normalised byte by byte in UTF-8 (A-Z to lower case, every ASCII byte that is no digit or letter to a space), scanned
once as `` word word ... ``, and matches are mapped back to word numbers and to offsets in the original text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 10
#: Characters of benchmark text in one automaton (some 5 million nodes); more items are taken in blocks of about that size.
BLOCK_CHARS = 500_000
#: Characters of texts that a task holds against block after block, where there are several.
PART_CHARS = 16_000_000

#: A-Z to a-z, other ASCII bytes that are no part of a word to a space, bytes of other characters as they are.
TABLE = bytes((b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20) for b in range(256))

RESULT = "doc_id long, n_words long, n_hit long, n_items long, items array<string>, spans array<struct<first_byte:long,end_byte:long>>"


def words_of(text: str | None) -> list[bytes]:
    """The words of a text; null has none."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(TABLE).split()


def windows_of(words: list[bytes], width: int = WINDOW) -> list[bytes]:
    """All windows of ``width`` words; an item of fewer, but not none, is one."""
    return [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []


class Windows:
    """The automaton of some items' windows. An item without an id is told by its text."""

    def __init__(self, items: list[tuple[str | None, str]], width: int = WINDOW):
        import ahocorasick

        owners: dict[bytes, set[tuple[bool, str]]] = {}
        for item, text in items:
            named = (True, item) if item is not None else (False, xxhash.xxh3_128_hexdigest(text.encode("utf-8", "surrogatepass")))
            for window in windows_of(words_of(text), width):
                owners.setdefault(window, set()).add(named)
        self.automaton = ahocorasick.Automaton()
        for window, who in owners.items():
            self.automaton.add_word(f" {window.decode('latin-1')} ", (window.count(b" ") + 1, len(window), sorted(who)))
        if owners:
            self.automaton.make_automaton()
        self.empty = not owners

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[tuple[bool, str]]]:
        """Merged (first, end) runs of hit words, and the items whose windows occur."""
        if self.empty or not words:
            return [], set()
        line = f" {b' '.join(words).decode('latin-1')} "
        found, items = [], set()
        for end, (n, size, who) in self.automaton.iter(line):
            found.append((end - size - 1, n))
            items.update(who)
        if not found:
            return [], items
        # a match begins at the space before its first word: number that space
        found = sorted(set(found))
        runs, at, number = [], 0, 0
        for start, n in found:
            number += line.count(" ", at, start)
            at = start
            if runs and number <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], number + n)
            else:
                runs.append([number, number + n])
        return [tuple(r) for r in runs], items


def byte_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The UTF-8 offsets in the original text of runs of words."""
    data = text.encode("utf-8", "surrogatepass").translate(TABLE)
    edges, at = [], 0
    for word in data.split():
        at = data.index(word, at)
        edges.append((at, at + len(word)))
        at += len(word)
    return [(edges[a][0], edges[b - 1][1]) for a, b in runs]


@lru_cache(maxsize=1)
def automaton(where: str, block: int, width: int) -> Windows:
    """The automaton of a block of items, read from the shared folder once a worker."""
    fs, folder = common.file_system(f"{where}/block={block}")
    rows = pq.read_table(folder, filesystem=fs, columns=["item_id", "text"]).to_pylist()
    return Windows([(r["item_id"], r["text"]) for r in rows], width)


def _blocks(benchmark: DataFrame, block_chars: int) -> tuple[str, int]:
    """The folder of the items with a text, in blocks of about so many characters, and the number of blocks.

    All rows of an item are in one block. No item goes through the driver.
    """
    tests = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    chars = tests.agg(F.sum(F.char_length("text"))).first()[0] or 0
    n = -(-chars // block_chars)
    where = common.work_dir(benchmark.sparkSession, "items")
    if n:
        key = F.xxhash64(F.coalesce(F.concat(F.lit("i"), "item_id"), F.concat(F.lit("t"), "text")))
        tests = tests.withColumn("block", F.pmod(key, F.lit(n)).cast("int"))
        tests.repartition(n, "block").write.partitionBy("block").parquet(where)
    # a block can be empty: no key fell there
    return where, n


def _present(spark: SparkSession, where: str, n: int) -> list[int]:
    return sorted(r["block"] for r in spark.read.parquet(where).select("block").distinct().toLocalIterator()) if n else []


def find_overlaps(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, any more): doc_id, n_words, n_hit, n_items, items (sorted ids), spans of hit passages (UTF-8
    offsets).

    Null texts, on either side, have no words. An empty benchmark hits nothing, an empty table of documents gives none. Items without
    an id hit and count, each text as one, but can't be listed. Repeated documents, and those of one doc_id, are scanned each; repeated
    items count once. Very long texts are scanned whole. Windows that overlap or touch are one passage. Other columns of ``docs``,
    whatever their names, aren't read. A benchmark of more than about ``block_chars`` characters is taken in blocks, each with an
    automaton of its own; texts are read once, a task holding some of them against each block in turn.
    """
    common.bounded_batches(docs.sparkSession)
    where, n = _blocks(benchmark, block_chars)
    blocks = _present(docs.sparkSession, where, n)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _parts(batches, len(blocks)):
            out = []
            for text, (n_words, runs, who) in zip(part["text"], _overlaps(part["text"].tolist(), where, blocks, width), strict=True):
                spans = byte_spans(text, runs) if runs else []
                out.append((n_words, sum(b - a for a, b in runs), len(who), sorted(i for known, i in who if known), [{"first_byte": a, "end_byte": b} for a, b in spans]))
            frame = pd.DataFrame(out, columns=["n_words", "n_hit", "n_items", "items", "spans"])
            frame.insert(0, "doc_id", part["doc_id"].astype("Int64").to_numpy())
            yield frame.astype({"doc_id": "Int64"})

    return rows.mapInPandas(scan, RESULT)


def _parts(batches: Iterator[pd.DataFrame], blocks: int) -> Iterator[pd.DataFrame]:
    """Batches one by one, or, for several blocks, together up to PART_CHARS, so that an automaton is made for many texts."""
    held, chars = [], 0
    for batch in batches:
        held.append(batch)
        chars += int(batch["text"].str.len().fillna(0).sum()) if len(batch) else 0
        if blocks <= 1 or chars >= PART_CHARS:
            yield pd.concat(held, ignore_index=True)
            held, chars = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def _overlaps(texts: list[str | None], where: str, blocks: list[int], width: int) -> list[tuple[int, list[tuple[int, int]], set]]:
    """(words, runs of hit words, items) of each text over all blocks; runs that overlap or touch are one. Words are made anew for each
    block, so that of many texts only the texts are held."""
    out: list[tuple[int, list[tuple[int, int]], set]] = []
    for k, block in enumerate(blocks or [-1]):
        windows = automaton(where, block, width) if block >= 0 else Windows([], width)
        for at, text in enumerate(texts):
            words = words_of(text)
            runs, who = windows.scan(words)
            if k == 0:
                out.append((len(words), runs, who))
            elif who:
                n, before, others = out[at]
                out[at] = n, _merged([*before, *runs]), others | who
    return out


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs, with its columns, whatever their names.

    Null and empty texts stay, repeated rows stay or go each; an empty benchmark keeps all, an empty table gives none. Nulls, very
    long texts and blocks are taken as by find_overlaps().
    """
    common.bounded_batches(docs.sparkSession)
    where, n = _blocks(benchmark, block_chars)
    blocks = _present(docs.sparkSession, where, n)

    def hit(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([bool(who) for *_, who in _overlaps(batch.tolist(), where, blocks, width)], dtype=bool)

    return docs.where(~F.pandas_udf(hit, "boolean")(F.col("text").cast("string"))) if blocks else docs


def digest(found: DataFrame) -> DataFrame:
    """The query's columns from find_overlaps()'s."""
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` against all of ``benchmark``."""
    return digest(find_overlaps(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark")))
