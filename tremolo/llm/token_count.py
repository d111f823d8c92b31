"""Operator 10: token counts, huge documents by overlapping chunks that are spliced at proven common boundaries.

A boundary between two characters is proven when no piece of the vocabulary holds the two side by side: no merge can then
reach across, whatever stands around, so the encodings left and right of it are independent. Two overlapping chunks are spliced
at such a place where both also show a token boundary and the same tokens next to it; if the overlap has none, it is widened.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Characters of a chunk and of the first overlap tried. Shorter texts are encoded whole.
CHUNK = 60_000
OVERLAP = 256
LIMIT = 4096

RESULT = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, n_chunks int, n_widened int"

SPACE_MARK = "▁"


class PieceCounter:
    """Counts of a sentencepiece model's tokens, without added tokens."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.chunk, self.overlap = max(4, chunk), max(2, overlap)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size()) if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i))]
        self.inside = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}

    def proven(self, text: str, i: int) -> bool:
        """No piece can hold text[i - 1] and text[i] side by side. The model writes a space as its mark."""
        pair = text[i - 1 : i + 1].replace(" ", SPACE_MARK)
        return len(pair) == 2 and pair not in self.inside

    def tokens(self, text: str) -> tuple[np.ndarray, list[int]]:
        """The byte offset at which each token ends, and the ids."""
        pieces = self.model.encode(text, return_type="proto").pieces
        return np.array([p.end for p in pieces], np.int64), [p.id for p in pieces]

    def count(self, text: str) -> tuple[int, int, int]:
        """Tokens of a text, the chunks encoded for it, and how often an overlap was widened."""
        if len(text) <= self.chunk:
            return len(self.model.encode(text, num_threads=1)), 1, 0
        total, chunks, widened = 0, 1, 0
        begin, end = 0, self.chunk
        ends, ids = self.tokens(text[begin:end])
        counted = 0  # tokens of this chunk before its splice with the last one
        while end < len(text):
            overlap = self.overlap
            while True:
                start = max(begin, end - overlap)
                stop = min(len(text), start + self.chunk)
                nxt, nxt_ids = self.tokens(text[start:stop])
                chunks += 1
                found = self.splice(text, begin, start, end, ends, ids, nxt, nxt_ids, counted)
                if found or start == begin:
                    break
                overlap, widened = overlap * 2, widened + 1
            if not found:
                # nothing in this chunk can be proven: grow it
                end = min(len(text), end + self.chunk)
                ends, ids = self.tokens(text[begin:end])
                chunks, widened = chunks + 1, widened + 1
                continue
            k, j = found
            total += k - counted
            begin, end, ends, ids, counted = start, stop, nxt, nxt_ids, j
        return total + len(ends) - counted, chunks, widened

    def splice(self, text: str, begin: int, start: int, end: int, ends: np.ndarray, ids: list[int], nxt: np.ndarray, nxt_ids: list[int], counted: int) -> tuple[int, int] | None:
        """Tokens of the earlier and of the later chunk before the last common proven boundary of their overlap."""
        zone = text[start:end]
        at = np.cumsum([0, *(len(c.encode("utf-8", "surrogatepass")) for c in zone)])
        shift = len(text[begin:start].encode("utf-8", "surrogatepass"))
        for i in range(len(zone) - 1, 0, -1):
            if not self.proven(zone, i):
                continue
            k = int(np.searchsorted(ends, shift + at[i], "right"))
            j = int(np.searchsorted(nxt, at[i], "right"))
            if k <= counted or j == 0 or ends[k - 1] != shift + at[i] or nxt[j - 1] != at[i] or ids[k - 1] != nxt_ids[j - 1] and j > 2:
                continue
            return k, j
        return None


@lru_cache(maxsize=2)
def counter(path: str, chunk: int, overlap: int) -> PieceCounter:
    """One counter a worker."""
    return PieceCounter(path, chunk, overlap)


def count_tokens(docs: DataFrame, model_path: str, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, any more): doc_id, n_bytes, n_tokens, over_limit, and the chunks and widenings it took.

    Null texts count as empty: no bytes, no tokens. Very long texts are taken in chunks of ``chunk`` characters, with the same count as
    the whole text has; texts of fewer are one chunk. Repeated rows and null doc_ids come out as they come in. An empty table gives
    none; other columns, whatever their names, aren't read.
    """
    common.bounded_batches(docs.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = counter(model_path, chunk, overlap)
        for batch in batches:
            texts = batch["text"].tolist()
            n = [made.count(t) if len(t) > made.chunk else None for t in texts]
            short = iter(made.model.encode([t for t, x in zip(texts, n, strict=True) if x is None], num_threads=1, return_type="numpy"))
            n = [(len(next(short)), 1, 0) if x is None else x for x in n]
            frame = pd.DataFrame(n, columns=["n_tokens", "n_chunks", "n_widened"])
            frame["doc_id"], frame["n_bytes"] = batch["doc_id"].astype("Int64"), batch["n_bytes"]
            frame["over_limit"] = frame["n_tokens"] > limit
            yield frame

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    return rows.mapInPandas(count, RESULT)


def op10_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` under piece_bpe_32k.model."""
    import public_tokenizers

    return count_tokens(common.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
