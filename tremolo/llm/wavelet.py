"""Operator 1: token ids in a wavelet matrix per shard, one compressed file each.

A shard holds the ids of consecutive documents in ascending ``doc_id`` order. Its bit planes (most significant first) are stored
in blocks of ``BLOCK_BITS`` bits, each compressed on its own, with the count of ones before each block; so access, rank and
select read a few blocks of one file, and a full decode reads each block once.
"""

from __future__ import annotations

import json
import os
import re
import struct
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

MAGIC = b"TWM1"
BLOCK_BITS = 1 << 19
#: Ids of a shard, but for a longer single document; a writer holds about 20 bytes an id.
SHARD_TOKENS = 4_000_000
#: Chunks of text that a worker remembers at a time: long or odd ones (some 200 bytes each), and words (some 50 bytes each).
CACHE_WORDS, TABLE_WORDS = 40_000, 1 << 20
#: Characters that are looked up at once; no more words than TABLE_WORDS.
BATCH_CHARS = 1 << 19
LONG_WORD = 64
#: Tasks that read shards, at most.
READERS = 20_000

#: The normaliser and splitter of the tokenizer whose words are remembered, as its file has them.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}

MANIFEST = "shard string, part int, seq int, n_docs long, n_tokens long, n_bytes long"
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long, shard string"


class WaveletMatrix:
    """Rank, select, access and decode over a sequence of unsigned integers below 2**levels."""

    def __init__(self, n: int, levels: int, zeros: list[int], ranks: list[np.ndarray], blocks: list[list[bytes]]):
        self.n, self.levels, self.zeros, self.ranks, self.blocks = n, levels, zeros, ranks, blocks
        self._words: dict[tuple[int, int], np.ndarray] = {}

    @classmethod
    def build(cls, values: np.ndarray, levels: int) -> WaveletMatrix:
        kind = np.uint16 if levels <= 16 else np.uint32
        current = np.ascontiguousarray(values, dtype=kind)
        pack = zstandard.ZstdCompressor(level=1)
        zeros, ranks, blocks = [], [], []
        for bit in range(levels - 1, -1, -1):
            ones = (current & kind(1 << bit)) != 0
            plane = np.packbits(ones, bitorder="little")
            step = BLOCK_BITS // 8
            cuts = [plane[i : i + step] for i in range(0, plane.size, step)]
            counts = np.array([int(np.bitwise_count(c).sum()) for c in cuts], dtype=np.int64)
            ranks.append(np.concatenate(([0], np.cumsum(counts))).astype(np.int64))
            blocks.append([pack.compress(c.tobytes()) for c in cuts])
            low = np.compress(~ones, current)
            zeros.append(int(low.size))
            current = np.concatenate((low, np.compress(ones, current)))
        return cls(int(values.size), levels, zeros, ranks, blocks)

    def _block(self, level: int, k: int) -> np.ndarray:
        if (level, k) not in self._words:
            self._words[level, k] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.blocks[level][k], max_output_size=BLOCK_BITS // 8), np.uint8)
        return self._words[level, k]

    def _bit(self, level: int, i: int) -> int:
        k, at = divmod(i, BLOCK_BITS)
        return int(self._block(level, k)[at >> 3] >> (at & 7)) & 1

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        k, at = divmod(i, BLOCK_BITS)
        if at == 0:
            return int(self.ranks[level][k])
        block = self._block(level, k)
        total = int(self.ranks[level][k]) + int(np.bitwise_count(block[: at >> 3]).sum())
        return total + (int(block[at >> 3] & ((1 << (at & 7)) - 1)).bit_count() if at & 7 else 0)

    def _find(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) such bit of a plane."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            ones = self._ones(level, mid + 1)
            if (ones if bit else mid + 1 - ones) > k:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.levels):
            bit = self._bit(level, i)
            value = value << 1 | bit
            ones = self._ones(level, i)
            i = self.zeros[level] + ones if bit else i - ones
        return value

    def _range(self, value: int, lo: int, hi: int) -> tuple[int, int]:
        for level in range(self.levels):
            a, b = self._ones(level, lo), self._ones(level, hi)
            if value >> (self.levels - 1 - level) & 1:
                lo, hi = self.zeros[level] + a, self.zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return lo, hi

    def count(self, value: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of a value in [lo, hi)."""
        hi = self.n if hi is None else min(hi, self.n)
        if value >> self.levels or max(lo, 0) >= hi:
            return 0
        a, b = self._range(value, max(lo, 0), hi)
        return b - a

    def select(self, value: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of a value."""
        if k < 0 or k >= self.count(value):
            raise IndexError(k)
        i = self._range(value, 0, self.n)[0] + k
        for level in range(self.levels - 1, -1, -1):
            bit = value >> (self.levels - 1 - level) & 1
            i = self._find(level, bit, i - self.zeros[level] if bit else i)
        return i

    def decode(self) -> np.ndarray:
        kind = np.uint16 if self.levels <= 16 else np.uint32
        values = np.zeros(self.n, kind)
        unpack = zstandard.ZstdDecompressor()
        for level in range(self.levels - 1, -1, -1):
            plane = np.frombuffer(b"".join(unpack.decompress(b, max_output_size=BLOCK_BITS // 8) for b in self.blocks[level]), np.uint8)
            ones = np.unpackbits(plane, count=self.n, bitorder="little").view(bool)
            above = np.empty(self.n, kind)
            z = self.zeros[level]
            above[np.flatnonzero(~ones)] = values[:z]
            above[np.flatnonzero(ones)] = values[z:] | kind(1 << (self.levels - 1 - level))
            values = above
        return values


def shard_bytes(matrix: WaveletMatrix, doc_ids: list[int | None], lengths: list[int]) -> list[bytes]:
    """The parts of a shard's file: magic, header, document table, ranks, blocks level by level."""
    pack = zstandard.ZstdCompressor(level=1)
    ids = np.array([0 if d is None else d for d in doc_ids], "<i8")
    null = np.packbits(np.array([d is None for d in doc_ids], bool))
    docs = pack.compress(ids.tobytes() + np.array(lengths, "<i8").tobytes() + null.tobytes())
    ranks = pack.compress(b"".join(r.astype("<i8").tobytes() for r in matrix.ranks))
    head = json.dumps({"n": matrix.n, "levels": matrix.levels, "zeros": matrix.zeros, "n_docs": len(doc_ids), "docs": len(docs), "ranks": len(ranks), "blocks": [[len(b) for b in level] for level in matrix.blocks]}).encode()
    return [MAGIC, struct.pack("<I", len(head)), head, docs, ranks, *(b for level in matrix.blocks for b in level)]


def open_shard(data: bytes) -> tuple[WaveletMatrix, list[int | None], np.ndarray]:
    """The matrix, document ids and lengths of a shard's file."""
    if data[:4] != MAGIC:
        raise ValueError("not a token shard")
    size = struct.unpack_from("<I", data, 4)[0]
    head = json.loads(data[8 : 8 + size])
    at = 8 + size
    unpack, k = zstandard.ZstdDecompressor(), head["n_docs"]
    docs = unpack.decompress(data[at : at + head["docs"]], max_output_size=17 * k + 16)
    at += head["docs"]
    n_blocks = -(-head["n"] // BLOCK_BITS)
    ranks = np.frombuffer(unpack.decompress(data[at : at + head["ranks"]], max_output_size=8 * head["levels"] * (n_blocks + 1) + 16), "<i8").reshape(head["levels"], -1)
    at += head["ranks"]
    blocks = []
    for level in head["blocks"]:
        blocks.append([])
        for size in level:
            blocks[-1].append(data[at : at + size])
            at += size
    null = np.unpackbits(np.frombuffer(docs[16 * k :], np.uint8), count=k).astype(bool)
    ids = [None if z else int(d) for d, z in zip(np.frombuffer(docs, "<i8", k), null, strict=True)]
    return WaveletMatrix(head["n"], head["levels"], head["zeros"], list(ranks), blocks), ids, np.frombuffer(docs, "<i8", k, 8 * k)


class Remembered(dict):
    """The ids of pieces of text, made when first asked for; forgets all when it holds too many."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, piece: str) -> bytes:
        ids = self.make(piece)
        if len(piece) <= LONG_WORD:
            if len(self) >= self.most:
                self.clear()
            self[piece] = ids
        return ids


class WordTable:
    """The ids of words of up to 15 bytes, looked up for a whole text at once: open addressing over arrays.

    A word's key is its bytes and their number in two integers, so no two words share one. Forgets all when it holds too many.
    """

    BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
    #: The first k bytes of eight.
    FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

    def __init__(self, make, make_long, kind: np.dtype, most: int = TABLE_WORDS):
        self.make, self.make_long, self.kind, self.most = make, make_long, kind, most
        self.bits = int(2 * most - 1).bit_length()
        self.clear()

    def clear(self) -> None:
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.low, self.high = np.zeros(self.most, np.uint64), np.zeros(self.most, np.uint64)
        self.at, self.n = np.zeros(self.most, np.int64), np.zeros(self.most, np.int64)
        self.ids, self.words, self.filled = np.empty(4 * self.most, self.kind), 0, 0

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        x = (low ^ (high * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        return (((x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The number of each word, -1 of those that aren't held."""
        slot = self._slot(low, high)
        out = self.slots[slot]
        left = np.flatnonzero((out >= 0) & ((self.low[out] != low) | (self.high[out] != high)))
        while left.size:
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            here = self.slots[slot[left]]
            out[left] = here
            left = left[(here >= 0) & ((self.low[here] != low[left]) | (self.high[here] != high[left]))]
        return out

    def _add(self, low: np.ndarray, high: np.ndarray, made: list[bytes]) -> None:
        """Words that aren't held, each once."""
        new = np.arange(self.words, self.words + low.size, dtype=np.int32)
        n = np.array([len(m) // self.kind.itemsize for m in made], np.int64)
        while self.filled + int(n.sum()) > self.ids.size:
            self.ids = np.concatenate((self.ids, np.empty_like(self.ids)))
        self.low[new], self.high[new], self.n[new] = low, high, n
        self.at[new] = self.filled + np.cumsum(n) - n
        self.ids[self.filled : self.filled + int(n.sum())] = np.frombuffer(b"".join(made), self.kind)
        self.words, self.filled = self.words + low.size, self.filled + int(n.sum())
        slot = self._slot(low, high)
        while new.size:
            free = self.slots[slot] < 0
            self.slots[slot[free]] = new[free]
            # of words that want one slot, one has it; the others go on
            on = self.slots[slot] != new
            new, slot = new[on], (slot[on] + 1) & ((1 << self.bits) - 1)

    def encode(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(where each word begins, its number of ids, all ids) of a text in UTF-8."""
        text = np.frombuffer(data + b" " * 24, np.uint8)
        blank = self.BLANK[text[: len(data) + 1]]
        edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        if data and not blank[0]:
            edges = np.concatenate(([0], edges))
        starts, size = edges[::2], edges[1::2] - edges[::2]
        eight = np.ndarray((text.size - 7,), "<u8", text, strides=(1,))
        low = eight[starts] & self.FIRST[np.minimum(size, 8)]
        high = (eight[starts + 8] & self.FIRST[np.clip(size - 8, 0, 7)]) | (np.minimum(size, 255).astype(np.uint64) << np.uint64(56))
        short = size < 16
        word = np.full(starts.size, -1, np.int64)
        word[short] = self.find(low[short], high[short])
        none = np.flatnonzero(short & (word < 0))
        if none.size:
            if self.words + none.size > self.most:
                self.clear()
                none = np.flatnonzero(short)
            first = none[np.unique(np.stack((low[none], high[none]), axis=1).view("V16").ravel(), return_index=True)[1]]
            self._add(low[first], high[first], [self.make(data[s : s + k].decode()) for s, k in zip(starts[first].tolist(), size[first].tolist(), strict=True)])
            word[none] = self.find(low[none], high[none])
        long = np.flatnonzero(~short)
        own = [self.make_long(data[s : s + k].decode()) for s, k in zip(starts[long].tolist(), size[long].tolist(), strict=True)]
        n = np.where(short, self.n[word], 0)
        n[long] = [len(x) // self.kind.itemsize for x in own]
        ends = np.cumsum(n)
        ids = np.empty(int(ends[-1]) if n.size else 0, self.kind)
        held = np.where(short, n, 0)
        into = np.repeat(ends - n, held) + (np.arange(int(held.sum())) - np.repeat(np.cumsum(held) - held, held))
        ids[into] = self.ids[np.repeat(self.at[word] - (ends - n), held) + into]
        for k, x in zip(long.tolist(), own, strict=True):
            ids[ends[k] - n[k] : ends[k]] = np.frombuffer(x, self.kind)
        return starts, n, ids


class WordEncoder:
    """The library's ids of whole texts, with the ids of frequent words remembered.

    The tokenizer's normaliser and splitter never join what white space separates, so a text's ids are those of its chunks in
    order. A chunk of Latin letters and then punctuation is split between the two, and the letters, in lower case and in the
    byte alphabet, are given to the library's model; other chunks to the whole library. Texts that hold a special token's string,
    in any case, or separators that Python and the tokenizer judge differently, are given to the library whole.
    """

    ODD = re.compile("[\x1c-\x1f]")
    #: Letters that stand alone under NFC and have one lower case; then punctuation that begins no contraction.
    PLAIN = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u024F]+)([!-&(-/:-@\[-_{-~]*)")

    #: Beyond these characters, lower case may depend on what stands around; two of them are blanks of more than a byte.
    BEYOND = re.compile("[^\x00-\x84\x86-\x9f\xa1-\u012F\u0131-\u024F]")

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.levels = max(1, (size - 1).bit_length())
        self.kind = np.dtype("<u2" if self.levels <= 16 else "<u4")
        self.code = "H" if self.levels <= 16 else "I"
        self.swapped = sys.byteorder == "big" or array(self.code).itemsize != self.kind.itemsize
        # what this class rewrites is what the file says; any other tokenizer is asked for whole texts
        parts = json.loads(self.library.to_str())
        self.known = (parts["normalizer"], parts["pre_tokenizer"]) == (NORMALIZER, PRE_TOKENIZER) and parts["model"]["type"] == "BPE" and not any(parts["model"].get(k) for k in ("dropout", "byte_fallback", "fuse_unk"))
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        # a character of each that has no case
        self.marks = {next((c for c in s if c.lower() == c.upper()), "") for s in self.special}
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in shown]
        self.alphabet = {b: 256 + k for k, b in enumerate(hidden)}
        self.rest = Remembered(lambda x: self._library([x])[0], CACHE_WORDS)
        self.chunks = Remembered(self._chunk, CACHE_WORDS)
        self.table = WordTable(self._chunk, self.chunks.__getitem__, self.kind)

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, letters: str) -> bytes:
        known = letters if letters.isascii() else letters.encode().decode("latin-1").translate(self.alphabet)
        return np.array([t.id for t in self.model.tokenize(known)], self.kind).tobytes() if self.swapped else array(self.code, [t.id for t in self.model.tokenize(known)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if chunk.isascii() and chunk.isalpha():
            return self._word(chunk.lower())
        plain = self.PLAIN.fullmatch(chunk)
        if plain is None:
            return self.rest[chunk]
        letters = plain[1].lower()
        return self.chunks[letters] + self.rest[plain[2]] if plain[2] else self._word(letters)

    def _special(self, text: str) -> bool:
        """Whether a special token's string is in the text in any case: lower case must not make one of what is none."""
        if not any(m in text for m in self.marks):
            return False
        low = text.lower()
        return any(s.lower() in low for s in self.special)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian integers of ``kind``."""
        out: list[bytes] = [b""] * len(texts)
        held: list[tuple[int, bytes]] = []
        room = BATCH_CHARS

        def flush() -> None:
            starts, n, ids = self.table.encode(b" ".join(t for _, t in held))
            begin = np.cumsum([0, *(len(t) + 1 for _, t in held)])
            upto = np.concatenate(([0], np.cumsum(n)))[np.searchsorted(starts, begin)]
            for k, (i, _) in enumerate(held):
                out[i] = ids[upto[k] : upto[k + 1]].tobytes()
            held.clear()

        for i, text in enumerate(texts):
            if not self.known or self.ODD.search(text) or self._special(text):
                out[i] = self._library([text])[0]
            elif self.BEYOND.search(text):
                out[i] = b"".join(map(self.chunks.__getitem__, text.split()))
            else:
                held.append((i, text.lower().encode()))
                room -= len(text)
                # one text of any length is looked up part by part
                if len(text) > BATCH_CHARS:
                    i, whole = held.pop()
                    out[i] = b"".join(self.table.encode(part)[2].tobytes() for part in parts(whole))
                elif room <= 0:
                    flush()
                    room = BATCH_CHARS
        if held:
            flush()
        return out


def parts(data: bytes) -> Iterator[bytes]:
    """The same bytes in parts of about BATCH_CHARS that end at a blank, or where the text does."""
    at = 0
    while at < len(data):
        end = at + BATCH_CHARS
        end = len(data) if end >= len(data) else (data.find(b" ", end) + 1 or len(data))
        yield data[at:end]
        at = end


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder a worker."""
    return WordEncoder(path)


def write_shards(docs: DataFrame, out_dir: str, tokenizer_path: str, end_id: int = 1, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encode ``docs`` (doc_id, text, any more) into shards below ``out_dir``, in ascending doc_id order; the manifest, a row a shard.

    Null texts count as empty. Null doc_ids come first; rows of one doc_id stand in order of their texts' hashes, and may lie in any
    number of tasks. Repeated rows are written as often as they come. Very long texts are encoded whole, a shard of their own if they
    have more ids than a shard should. An empty table gives no shard; other columns, whatever their names, aren't read.
    """
    spark = docs.sparkSession
    common.bounded_batches(spark)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seq, made = TaskContext.get().partitionId(), 0, encoder(tokenizer_path)
        end = np.array([end_id], made.kind).tobytes()
        held: list[bytes] = []
        doc_ids: list[int | None] = []
        lengths: list[int] = []
        total = 0

        def flush() -> pd.DataFrame:
            matrix = WaveletMatrix.build(np.frombuffer(b"".join(held), made.kind), made.levels)
            name = f"shard-{part:06d}-{seq:05d}.twm"
            size = common.put_file(out_dir, name, shard_bytes(matrix, doc_ids, lengths))
            return pd.DataFrame([(name, part, seq, len(doc_ids), total, size)], columns=["shard", "part", "seq", "n_docs", "n_tokens", "n_bytes"])

        for batch in batches:
            for doc_id, ids in zip(batch["doc_id"], made.encode(batch["text"].tolist()), strict=True):
                n = len(ids) // made.kind.itemsize + 1
                if doc_ids and total + n > shard_tokens:
                    yield flush()
                    seq, total = seq + 1, 0
                    held.clear(), doc_ids.clear(), lengths.clear()
                held += (ids, end)
                doc_ids.append(None if pd.isna(doc_id) else int(doc_id))
                lengths.append(n)
                total += n
        if doc_ids:
            yield flush()
        held.clear()
        common.release()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"))
    # rows of one doc_id, or without any, are dealt on by their texts, and equal ones by their number
    keys = [F.col("doc_id").asc_nulls_first(), F.col("hash").asc(), F.col("row").asc()]
    rows = rows.withColumns({"hash": F.xxhash64("text"), "row": F.monotonically_increasing_id()}).repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    rows.mapInPandas(write, MANIFEST).write.parquet(f"{out_dir}/manifest")
    return spark.read.parquet(f"{out_dir}/manifest")


def read_shards(spark: SparkSession, out_dir: str) -> DataFrame:
    """Per document of the shards below ``out_dir``: doc_id, start, n_tokens, ids_crc32, shard."""
    manifest = spark.read.parquet(f"{out_dir}/manifest")
    # a row a shard of millions of ids: the one ordered pass over them is small at any size
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    starts = manifest.select("shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    starts = starts.repartition(max(1, min(manifest.count(), READERS)))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, folder = common.file_system(out_dir)
        for batch in batches:
            for name, base in zip(batch["shard"], batch["base"], strict=True):
                with fs.open_input_file(f"{folder}/{name}") as f:
                    matrix, doc_ids, lengths = open_shard(f.read())
                ids, ends = matrix.decode(), np.cumsum(lengths)
                crc = [zlib.crc32(ids[e - n : e].astype("<u4")) for e, n in zip(ends, lengths, strict=True)]
                yield pd.DataFrame({"doc_id": pd.array(doc_ids, "Int64"), "start": base + ends - lengths, "n_tokens": lengths, "ids_crc32": crc, "shard": name})
        common.release()

    return starts.mapInPandas(read, RESULT)


def op1_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` through the shard files and back."""
    import public_tokenizers

    where = common.work_dir(spark, "op1")
    write_shards(common.table(spark, sf_dir, "documents"), where, public_tokenizers.path("word_bpe_49k.json"))
    return read_shards(spark, where)
