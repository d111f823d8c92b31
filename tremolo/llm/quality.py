"""Operator 3: a quality classifier by the perplexity of an interpolated modified Kneser-Ney n-gram model.

The model is of characters as written, ORDER of them a gram, so it needs no word list and knows every script; a text begins after
ORDER - 1 start marks. It is trained on all trusted text: counts, counts of continuations and sums of contexts are tables sharded by
gram, which grow with the corpus and are joined level by level.

A gram's cost is that of its shorter ones plus a term of its own (or of its context, if it is unknown), so a text's cost is a sum
over its grams and contexts. The commonest, of bounded numbers, are sent to the workers; the others that texts ask for are joined
with the sharded table. A document is rejected if its perplexity is beyond a quantile of its language's trusted documents that the
model has not seen; the quantiles of a language with few of them are drawn towards those of all languages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Characters of a gram.
ORDER = 5
#: Bytes of a symbol (a code point and one; a start mark is 0) in a gram, and the symbols that there are.
WIDTH, ALPHABET = 3, 0x110000
#: Of trusted documents, the share that may lie above and below the limits of their language.
UPPER, LOWER = 0.995, 0.002
#: Nats that a document must lie beyond a quantile to be rejected.
SLACK = 0.05
#: Characters at the language's mean that are added to each document, so that short texts aren't judged by chance.
PRIOR = 200.0
#: Unseen trusted documents of all languages that weigh with a language's own.
PRIOR_DOCS = 50.0
#: Trusted documents with this remainder of crc32(doc_id) mod 4 aren't trained on; the quantiles are theirs.
UNSEEN = 3
#: Bins of a thousandth of a nat, in which scores are counted.
BINS = 1000
#: Ids or grams up to which a table of them is broadcast (some 50 bytes each); more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Languages up to which their table is broadcast.
BROADCAST_LANGUAGES = 100_000
#: Characters that a worker takes at a time; longer texts are taken in parts, each after the characters before it.
BATCH_CHARS = 200_000
#: Grams of the full order, and shorter ones with their terms, that are sent to the workers (16 and 24 bytes each).
HEAD = 200_000
#: Discounts of counts of one, two and more, where the counts of counts give none.
FALLBACK = (0.5, 1.0, 1.5)
#: A discounted share or a weight is no less.
TINY = 1e-12

ODD = np.uint64(0x9E3779B97F4A7C15)
SCORED = "row long, doc_id long, text_hash long, lang string, n_chars long, nats double, gram binary, as_gram long, as_context long"


class Symbols:
    """Texts (each with the characters before it, if it is a part) as one array of symbols, all after ORDER - 1 marks or characters."""

    def __init__(self, texts: list[str], before: list[str]):
        pad = ORDER - 1
        self.lengths = np.array([len(t) for t in texts], np.int64)
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        self.marked = np.zeros(codes.size + pad * len(texts), np.uint32)
        #: Where each character stands.
        self.place = np.arange(codes.size) + np.repeat(pad * np.arange(1, len(texts) + 1), self.lengths)
        self.marked[self.place] = codes + 1
        starts = np.cumsum(self.lengths + pad) - self.lengths
        for start, head in zip(starts.tolist(), before, strict=True):
            if head:
                self.marked[start - len(head) : start] = [ord(c) + 1 for c in head]

    def hashes(self) -> list[np.ndarray]:
        """A hash of the 1 to ORDER symbols that end at each place; those before ORDER - 1 aren't asked for."""
        own = (self.marked.astype(np.uint64) + np.uint64(1)) * ODD
        own = (own ^ (own >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        own ^= own >> np.uint64(32)
        out = [own]
        for _ in range(ORDER - 1):
            longer = own.copy()
            longer[1:] += out[-1][:-1] * ODD
            out.append(longer)
        return out

    def packed(self, at: np.ndarray, k: int) -> list[bytes]:
        """The k symbols that end at each place, as bytes."""
        if not at.size:
            return []
        symbols = self.marked[at[:, None] - np.arange(k - 1, -1, -1)].astype(">u4")
        return np.ascontiguousarray(symbols.view(np.uint8).reshape(at.size, k, 4)[:, :, 4 - WIDTH :]).reshape(at.size, -1).view(f"V{k * WIDTH}").ravel().tolist()


def hash_packed(grams: list[bytes]) -> np.ndarray:
    """The hashes that Symbols gives to grams."""
    out = np.zeros(len(grams), np.uint64)
    lengths = np.array([len(g) for g in grams], np.int64)
    for size in np.unique(lengths):
        at = np.flatnonzero(lengths == size)
        symbols = np.frombuffer(b"".join(grams[i] for i in at), np.uint8).reshape(at.size, -1, WIDTH).astype(np.uint64)
        value = np.zeros(symbols.shape[:2], np.uint64)
        for b in range(WIDTH):
            value = value << np.uint64(8) | symbols[:, :, b]
        own = (value + np.uint64(1)) * ODD
        own = (own ^ (own >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        own ^= own >> np.uint64(32)
        made = own[:, 0]
        for k in range(1, own.shape[1]):
            made = made * ODD + own[:, k]
        out[at] = made
    return out


class Lookup:
    """Rows of given 64-bit keys, by open addressing over whole arrays."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(2 * keys.size - 1).bit_length()) if keys.size else 4
        self.shift = np.uint64(64 - bits)
        slot = self._slot(keys)
        order = np.argsort(slot, kind="stable")
        # each key at its slot or the next that is free
        at = np.maximum.accumulate(slot[order] - np.arange(keys.size)) + np.arange(keys.size)
        self.reach = int((at - slot[order]).max(initial=0)) + 1
        self.keys = np.zeros((1 << bits) + keys.size + 1, np.uint64)
        self.rows = np.full(self.keys.size, -1, np.int32)
        self.keys[at], self.rows[at] = keys[order], order

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0xD1B54A32D192ED03)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, -1 for others."""
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.rows[slot], -1)
        left = np.flatnonzero((out < 0) & (self.rows[slot] >= 0))
        for step in range(1, self.reach):
            if not left.size:
                break
            at = slot[left] + step
            here = self.rows[at]
            hit = (here >= 0) & (self.keys[at] == keys[left])
            out[left[hit]] = here[hit]
            left = left[~hit & (here >= 0)]
        return out


class Model:
    """What workers hold: costs of the commonest grams of the full order, terms of the commonest shorter ones.

    ``whole[k]``: all grams of k symbols that there are, are here, so that others are known to be none.
    """

    def __init__(self, base: float, grams: np.ndarray, costs: np.ndarray, keys: np.ndarray, terms: np.ndarray, contexts: np.ndarray, whole: list[bool]):
        self.base, self.grams, self.costs, self.keys, self.terms, self.contexts, self.whole = base, grams, costs, keys, terms, contexts, whole
        self.tables: tuple[Lookup, Lookup] | None = None

    def score(self, symbols: Symbols) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, int, bool]]]:
        """The cost of each character as far as it is known here, and what else there might be: (which characters, places at which the
        grams end, their length, whether they are asked for as contexts)."""
        if self.tables is None:
            self.tables = (Lookup(self.grams), Lookup(self.keys))
        full, short = self.tables
        h, place = symbols.hashes(), symbols.place
        at = full.find(h[-1][place])
        cost = np.append(self.costs, 0.0)[at]
        miss = np.flatnonzero(at < 0)
        ends, asked = place[miss], []
        if not miss.size:
            return cost, asked
        each = np.full(miss.size, self.base)
        none_before = {}
        for as_context in (False, True):
            where = ends - 1 if as_context else ends
            values = np.append(self.contexts if as_context else self.terms, 0.0)
            none = np.zeros(miss.size, bool)
            for k in range(1, ORDER):
                found = short.find(h[k - 1][where])
                each += values[found]
                unknown = (found < 0) & ~none
                # a gram that isn't there is part of none that is
                if self.whole[k]:
                    none |= unknown
                elif unknown.any():
                    asked.append((miss[unknown], where[unknown], k, as_context))
            none_before[as_context] = none
        maybe = ~none_before[False] & ~none_before[True]
        if not self.whole[ORDER] and maybe.any():
            asked.append((miss[maybe], ends[maybe], ORDER, False))
        cost[miss] = each
        return cost, asked


def parts(texts: list[str]) -> Iterator[tuple[list[int], list[str], list[str]]]:
    """(numbers of texts, texts or parts of them, the characters before) of at most about BATCH_CHARS characters."""
    which, bodies, before, size = [], [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text)), BATCH_CHARS):
            body = text[at : at + BATCH_CHARS]
            if size and size + len(body) > BATCH_CHARS:
                yield which, bodies, before
                which, bodies, before, size = [], [], [], 0
            which.append(i)
            bodies.append(body)
            before.append(text[max(0, at - ORDER + 1) : at])
            size += len(body)
    if which:
        yield which, bodies, before


def gram_counts(docs: DataFrame) -> DataFrame:
    """(gram, count) of the texts' grams of the full order."""
    common.bounded_batches(docs.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for texts in gathered(batches):
            for _, bodies, before in parts(texts):
                symbols = Symbols(bodies, before)
                _, first, n = np.unique(symbols.hashes()[-1][symbols.place], return_index=True, return_counts=True)
                if n.size:
                    yield pd.DataFrame({"gram": symbols.packed(symbols.place[first], ORDER), "count": n})
        common.release()

    return docs.select(common.text_of().alias("text")).mapInPandas(count, "gram binary, count long").groupBy("gram").agg(F.sum("count").alias("count"))


def gathered(batches: Iterator[pd.DataFrame]) -> Iterator[list[str]]:
    """The texts of several batches, until they have BATCH_CHARS characters."""
    held, size = [], 0
    for batch in batches:
        held += batch["text"].tolist()
        size += int(batch["text"].str.len().sum())
        if size >= BATCH_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def first_symbols(gram: str, n: int) -> Column:
    return F.substring(F.col(gram), 1, WIDTH * n)


def without_first(gram: str) -> Column:
    return F.substring(F.col(gram), WIDTH + 1, WIDTH * ORDER)


def offs(counts: DataFrame) -> Column:
    """The discount of each count, of modified Kneser-Ney; FALLBACK where a count of counts that it is made from is nought."""
    t = [F.sum(F.when(F.col("count") == k, 1).otherwise(0)).alias(f"t{k}") for k in (1, 2, 3, 4)]
    t = [float(x or 0) for x in counts.agg(*t).first()]
    off = FALLBACK
    if all(t):
        y = t[0] / (t[0] + 2 * t[1])
        off = [min(max(k - (k + 1) * y * t[k] / t[k - 1], 0.0), float(k)) for k in (1, 2, 3)]
    return F.when(F.col("count") == 1, off[0]).when(F.col("count") == 2, off[1]).otherwise(off[2])


def train(docs: DataFrame) -> tuple[DataFrame, float]:
    """(gram, k, count, cost, term, context_term) of all grams of 1 to ORDER symbols, also as contexts, and the cost of an unknown symbol.

    ``cost`` is the negative log probability of a gram's last symbol after the others. A character's cost is that of an unknown
    symbol, the terms of the grams that end there and the context terms of those that end before it.
    """
    counts = {ORDER: common.cut(gram_counts(docs))}
    for k in range(ORDER - 1, 0, -1):
        # lower orders count the different symbols before a gram; what stands at a text's beginning is counted as it is
        short = without_first("gram")
        begins = F.substring(short, 1, WIDTH) == F.lit(bytes(WIDTH))
        counts[k] = common.cut(counts[k + 1].groupBy(short.alias("gram")).agg(F.when(F.first(begins), F.sum("count")).otherwise(F.count("*")).alias("count")))
    nats = lambda p: -F.log(F.greatest(p, F.lit(TINY * TINY)))
    off = offs(counts[1])
    whole, taken = counts[1].agg(F.sum("count"), F.sum(off)).first()
    if not whole:
        return docs.sparkSession.createDataFrame([], "gram binary, k int, count long, cost double, term double, context_term double"), 0.0
    weight = max(taken / whole, TINY)
    base = float(np.log(ALPHABET) - np.log(weight))
    below = common.cut(counts[1].select("gram", "count", nats((F.col("count") - off) / F.lit(float(whole)) + F.lit(weight / ALPHABET)).alias("cost")))
    none = F.lit(None).cast("double")
    made = [below.select("gram", "count", "cost", (F.col("cost") - F.lit(base)).alias("term"), none.alias("context_term"))]
    for k in range(2, ORDER + 1):
        kept = counts[k].select("gram", "count", first_symbols("gram", k - 1).alias("context"), without_first("gram").alias("shorter"), offs(counts[k]).alias("off"))
        sums = common.cut(kept.groupBy("context").agg(F.sum("count").alias("whole"), F.greatest(F.sum("off") / F.sum("count"), F.lit(TINY)).alias("weight")))
        less = below.select(F.col("gram").alias("shorter"), F.col("cost").alias("less"))
        own = nats((F.col("count") - F.col("off")) / F.col("whole") + F.col("weight") * F.exp(-F.col("less")))
        joined = kept.join(sums, "context").join(less, "shorter").select("gram", "count", own.alias("cost"), (own - F.col("less") + F.log("weight")).alias("term"))
        below = common.cut(joined)
        made.append(below.select("gram", "count", "cost", "term", none.alias("context_term")))
        made.append(sums.select(F.col("context").alias("gram"), F.col("whole").alias("count"), none.alias("cost"), none.alias("term"), (-F.log("weight")).alias("context_term")))
    every = made[0]
    for one in made[1:]:
        every = every.unionByName(one)
    # contexts of start marks alone are no grams
    every = every.groupBy("gram").agg(F.max("count").alias("count"), F.max("cost").alias("cost"), *[F.coalesce(F.max(c), F.lit(0.0)).alias(c) for c in ("term", "context_term")])
    return common.cut(every.withColumn("k", (F.octet_length("gram") / WIDTH).cast("int"))), base


def split_terms(terms: DataFrame, base: float, most: int = HEAD) -> tuple[Model, DataFrame | None]:
    """The model of the commonest grams, at most so many of the full order and of all others together; and all other terms, if any."""
    counted = terms.groupBy("k", F.least("count", F.lit(100_000)).alias("count")).agg(F.count("*").alias("n")).toPandas()
    near, whole, room = F.lit(False), [True] + [False] * ORDER, most
    for k in range(1, ORDER + 1):
        sizes = counted[counted["k"] == k].sort_values("count", ascending=False)
        fit = sizes[sizes["n"].cumsum() <= (most if k == ORDER else room)]
        whole[k] = len(fit) == len(sizes)
        if len(fit):
            near = near | ((F.col("k") == k) & (F.col("count") >= F.lit(int(fit["count"].min()))))
            room -= int(fit["n"].sum()) if k < ORDER else 0

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(key=hash_packed(batch["gram"].tolist()).view(np.int64)).drop(columns="gram")

    # numbers alone go to the driver, 40 bytes a gram
    head = terms.where(near).select("gram", "k", "cost", "term", "context_term").mapInPandas(hashed, "key long, k int, cost double, term double, context_term double").toArrow()
    column = lambda c: head.column(c).to_numpy()
    keys, full = column("key").view(np.uint64), column("k") == ORDER
    model = Model(base, keys[full], column("cost")[full], keys[~full], column("term")[~full], column("context_term")[~full], whole)
    return model, None if all(whole) else terms.where(~near).select("gram", "term", "context_term")


def scores(docs: DataFrame, terms: DataFrame, base: float, most: int = HEAD) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, lang): doc_id, text_hash, lang, n_chars, nats (their sum)."""
    common.bounded_batches(docs.sparkSession)
    model, tail = split_terms(terms, base, most)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            nats, rows = np.zeros(len(texts)), batch["row"].to_numpy(np.int64)
            for which, bodies, before in parts(texts):
                symbols = Symbols(bodies, before)
                number = np.repeat(np.array(which, np.int64), symbols.lengths)
                cost, asked = sent.value.score(symbols)
                nats += np.bincount(number, cost, minlength=len(texts))
                if asked:
                    yield questions(symbols, number, rows, asked)
            yield pd.DataFrame({"row": rows, "doc_id": batch["doc_id"].astype("Int64"), "text_hash": batch["text_hash"].astype("Int64"), "lang": batch["lang"], "n_chars": pd.array([len(t) for t in texts], "Int64"), "nats": nats, "gram": None, "as_gram": pd.array([None] * len(texts), "Int64"), "as_context": pd.array([None] * len(texts), "Int64")})
        common.release()

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(common.text_of()).alias("text_hash"), F.col("lang").cast("string").alias("lang"), common.text_of().alias("text"))
    made = rows.mapInPandas(score, SCORED)
    if tail is None:
        return made.select("doc_id", "text_hash", "lang", "n_chars", "nats")
    # a row's own lines and its questions are written at once, so that they agree on its number
    made = common.cut(made)
    asked = made.where("gram is not null").select("row", "gram", "as_gram", "as_context")
    # the different questions first: most grams are unknown, and a gram that many texts ask for is one row
    known = common.cut(asked.select("gram").distinct().join(tail, "gram"))
    known = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known
    more = asked.join(known, "gram").groupBy("row").agg(F.sum(F.col("as_gram") * F.col("term") + F.col("as_context") * F.col("context_term")).alias("more"))
    own = made.where("gram is null")
    return own.join(more, "row", "left").select("doc_id", "text_hash", "lang", "n_chars", (F.col("nats") + F.coalesce("more", F.lit(0.0))).alias("nats"))


def questions(symbols: Symbols, number: np.ndarray, rows: np.ndarray, asked: list[tuple[np.ndarray, np.ndarray, int, bool]]) -> pd.DataFrame:
    """(row, gram, as_gram, as_context): how often each text asks for a gram, and for a context."""
    frames = []
    for which, ends, k, as_context in asked:
        frame = pd.DataFrame({"row": rows[number[which]], "gram": symbols.packed(ends, k)}).value_counts(sort=False).reset_index(name="n")
        frames.append(pd.DataFrame({"row": frame["row"], "gram": frame["gram"], "as_gram": 0 if as_context else frame["n"], "as_context": frame["n"] if as_context else 0}))
    out = pd.concat(frames, ignore_index=True)
    none = pd.array([None] * len(out), "Int64")
    return pd.DataFrame({"row": out["row"], "doc_id": none, "text_hash": none, "lang": None, "n_chars": none, "nats": np.nan, "gram": out["gram"], "as_gram": out["as_gram"].astype("Int64"), "as_context": out["as_context"].astype("Int64")})


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The doc_ids that are labelled of good quality, with a hint to broadcast them if they are few enough."""
    ids = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("trusted_id")).distinct()
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def unseen() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 4 == UNSEEN


def shrunk(mean: Column) -> Column:
    """Nats a character, with PRIOR characters at the mean."""
    return (F.col("nats") + PRIOR * mean) / (F.col("n_chars") + PRIOR)


def quantiles(known: DataFrame, key: list[str]) -> DataFrame:
    """(key, low, high) of the rows' shrunk scores, by counts of bins: a few thousand bins a language."""
    binned = known.withColumn("bin", F.floor(shrunk(F.col("mean")) * BINS)).groupBy(*key, "bin").count()
    ranked = binned.withColumns({"upto": F.sum("count").over(Window.partitionBy(*key).orderBy("bin")), "n": F.sum("count").over(Window.partitionBy(*key))})
    at = lambda share: F.min(F.when(F.col("upto") >= share * F.col("n"), F.col("bin")))
    return ranked.groupBy(*key).agg((at(LOWER) / BINS).alias("low"), ((at(UPPER) + 1) / BINS).alias("high"))


def limits(scored: DataFrame) -> tuple[DataFrame, dict[str, float] | None]:
    """(of, low, high, mean) per language, and those of all, from the trusted documents that the model hasn't seen.

    A language of n documents has n parts of its own values and PRIOR_DOCS parts of all languages'.
    """
    known = scored.where("trusted and unseen and n_chars > 0").select(F.coalesce("lang", F.lit("")).alias("of"), "nats", "n_chars")
    whole = known.agg((F.sum("nats") / F.sum("n_chars")).alias("mean")).first()["mean"]
    if whole is None:
        return known.select("of", F.lit(0.0).alias("low"), F.lit(0.0).alias("high"), F.lit(0.0).alias("mean")).limit(0), None
    every = quantiles(known.withColumn("mean", F.lit(float(whole))), []).first()
    every = {"mean": float(whole), "low": every["low"] - SLACK, "high": every["high"] + SLACK}
    drawn = lambda own, all_of: (F.col("n") * own + F.lit(PRIOR_DOCS * all_of)) / (F.col("n") + PRIOR_DOCS)
    means = known.groupBy("of").agg(F.count("*").alias("n"), (F.sum("nats") / F.sum("n_chars")).alias("own")).select("of", "n", drawn(F.col("own"), every["mean"]).alias("mean"))
    means = common.cut(means)
    own = quantiles(known.join(_bounded(means), "of"), ["of"]).join(means, "of")
    return common.cut(own.select("of", drawn(F.col("low") - SLACK, every["low"]).alias("low"), drawn(F.col("high") + SLACK, every["high"]).alias("high"), "mean"), keep=True), every


def _bounded(languages: DataFrame) -> DataFrame:
    """A written table, a row a language; broadcast if it is small. ``lang`` is free text."""
    return F.broadcast(languages) if languages.limit(BROADCAST_LANGUAGES + 1).count() <= BROADCAST_LANGUAGES else languages


@common.tidy
def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, lang, any more): doc_id, text_hash, lang, n_chars, score, perplexity, low, high, keep.

    score is the shrunk mean of nats a character; perplexity is that of the text alone. Null texts count as empty; an empty text
    has no perplexity and is kept. Very long texts are taken in parts that overlap by ORDER - 1 characters, with the same cost.
    Null languages are a language; a language without unseen trusted documents has the limits of all. Scores that equal a limit
    are kept. Repeated rows come out each. Without trusted text, or with none that training leaves out, all rows are kept. An
    empty table gives none.
    """
    ids = trusted_ids(labels)
    marked = docs.select("doc_id", "text", "lang").join(ids, docs["doc_id"].cast("long") == ids["trusted_id"], "left")
    scored = scores(docs, *train(marked.where(F.col("trusted_id").isNotNull() & ~unseen())))
    scored = common.cut(scored.join(ids, scored["doc_id"] == ids["trusted_id"], "left").select("doc_id", "text_hash", "lang", "n_chars", "nats", F.col("trusted_id").isNotNull().alias("trusted"), F.coalesce(unseen(), F.lit(False)).alias("unseen")), keep=True)
    table, every = limits(scored)
    own = lambda c: F.coalesce(F.col(f"own.{c}"), F.lit(every[c] if every else None).cast("double"))
    joined = scored.alias("s").join(_bounded(table).alias("own"), F.coalesce("s.lang", F.lit("")) == F.col("own.of"), "left").select("s.*", own("low").alias("low"), own("high").alias("high"), own("mean").alias("mean"))
    joined = joined.withColumns({"score": shrunk(F.col("mean")), "perplexity": F.when(F.col("n_chars") > 0, F.exp(F.col("nats") / F.col("n_chars")))})
    keep = F.coalesce((F.col("n_chars") == 0) | F.col("score").between(F.col("low"), F.col("high")), F.lit(True))
    return joined.select("doc_id", "text_hash", "lang", "n_chars", "score", "perplexity", "low", "high", keep.alias("keep"))


@common.tidy
def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that judge() keeps, with its columns: empty and null texts too, repeated rows each, whatever the doc_ids."""
    gone = common.cut(judge(docs, labels).where("not keep").select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct(), keep=True)
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone["gone_id"]) & (F.xxhash64(common.text_of()) == gone["gone_hash"]), "left_anti")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``; trusted are those that ``labels`` calls good."""
    return judge(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")).drop("text_hash")
