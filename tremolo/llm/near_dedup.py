"""Operator 7: near-duplicate classes by BagMinHash signatures, banding and exact verification of multiset overlap.

A document is the multiset of its five-word shingles. A shingle of weight w owns the part [0, w) of a line that is covered by
the blocks [0, 1), [1, 2), [2, 4), [4, 8) ...; each block has a Poisson process of its length's rate, whose points carry a time,
a slot of the signature and a place in the block. A whole block is taken by its one process; of a block that w cuts, the points
beyond w are passed over. A slot keeps its earliest time, so two documents agree in a slot with the probability of their weighted
Jaccard similarity. Points come in order of time, and an element stops once it is later than all slots.

Signatures are banded; documents that share a band are compared with its first member. Where a bucket still holds several classes,
members with too many shingles of their own to be near any other are set aside, and the others are compared with a few that have
fewest of their own, and then with all members of the bucket's smaller classes, so that no pair across its classes is left untested.
A bucket of n members of one class costs n comparisons, and no pair of a bucket is given up.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .decontaminate import words_of

SHINGLE = 5
SIMILARITY = 0.8
#: With 40 bands of 6 slots, two texts of similarity 0.8 share no band with a probability of 5e-6.
BANDS, ROWS = 40, 6
SLOTS = BANDS * ROWS
#: Estimates so many standard deviations below the similarity asked for are not verified: of pairs of similarity 0.8, of which 5 in a
#: million share no band, 1 in 100 million more are lost so (a binomial share of 240 slots).
DEVIATIONS = 6
#: Shingles that a worker takes at a time (but for one longer document), and words whose hashes it remembers.
BATCH_SHINGLES = 100_000
CACHE_WORDS = 120_000
#: Keys up to which a table of them (some 50 bytes a key) is broadcast; more are joined by a shuffle.
BROADCAST_KEYS = 500_000
#: Members of a bucket that are compared with all others after its first member.
PIVOTS = 4
#: Members of a bucket that are compared at a time (about 550 bytes each).
CHUNK = 256
#: Pairs of chunks in an Arrow batch.
CHUNK_ROWS = 16
#: Chunks of either side whose pairs go to one task.
SQUARE = 16

FEATURES = "doc_id long, text_hash long, node binary, size long, signature binary"
LIKELY = "a binary, b binary, key_a struct<doc_id:long,text_hash:long>, key_b struct<doc_id:long,text_hash:long>"
#: Ticks of a unit of a Poisson process' time, and a time that no point has.
TICKS, NEVER = float(1 << 40), np.int64((1 << 62) - 1)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Hashes of words; forgets all when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(words: list[bytes], known: dict[bytes, int]) -> np.ndarray:
    """Hashes of all runs of five words; a text of fewer, but not none, is one."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(SHINGLE, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = out * GOLDEN + h[k : k + n]
    return mixed(out)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], slots: int = SLOTS) -> np.ndarray:
    """The BagMinHash signature (a row of times) of each (elements, weights); an empty bag's times are NEVER.

    Times are whole numbers, so that they don't depend on how many points are added up at once.
    """
    times = np.full((len(bags), slots), NEVER)
    flat = times.ravel()
    doc = np.repeat(np.arange(len(bags)), [b[0].size for b in bags])
    element = np.concatenate([b[0] for b in bags]) if bags else np.empty(0, np.uint64)
    weight = np.concatenate([b[1] for b in bags]).astype(np.float64) if bags else np.empty(0)
    parts, k, low = [], 0, 0.0
    at = np.arange(doc.size)
    while at.size:
        high = 1.0 if k == 0 else low * 2
        parts.append((at, np.full(at.size, k, np.uint64), np.full(at.size, low), np.full(at.size, high - low)))
        at = at[weight[at] > high]
        k, low = k + 1, high
    if not parts:
        return times
    at, level, low, rate = (np.concatenate(x) for x in zip(*parts, strict=True))
    doc, limit = doc[at], (weight[at] - low) / rate
    seed = mixed(element[at] + level * np.uint64(0xD1B54A32D192ED03))
    time, active, drawn, many = np.zeros(at.size, np.int64), np.arange(at.size), 0, 1
    while active.size:
        steps = np.arange(drawn + 1, drawn + many + 1, dtype=np.uint64) * GOLDEN
        a = mixed(seed[active][:, None] + steps)
        gap = -np.log1p(-(a >> np.uint64(11)).astype(np.float64) * 2.0**-53)
        when = time[active][:, None] + np.cumsum((gap * TICKS / rate[active][:, None]).astype(np.int64), axis=1)
        b = mixed(a + np.uint64(0xA0761D6478BD642F))
        slot = ((b >> np.uint64(32)) * np.uint64(slots)) >> np.uint64(32)
        cell = doc[active][:, None] * slots + slot.astype(np.int64)
        inside = (b & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 < limit[active][:, None]
        np.minimum.at(flat, cell[inside], when[inside])
        time[active] = when[:, -1]
        there = np.unique(doc[active])
        latest = np.zeros(len(bags), np.int64)
        latest[there] = times[there].max(axis=1)
        drawn += many
        active = active[time[active] < latest[doc[active]]]
        many = int(min(max(1, 200_000 // max(1, active.size)), many * 2, 256))
    return times


def packed(times: np.ndarray) -> np.ndarray:
    """16 bits a slot."""
    return (mixed(times.view(np.uint64)) >> np.uint64(48)).astype("<u2")


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, node, size, signature): node is a 128-bit name of the multiset of shingles, all zero without words."""
    common.bounded_batches(docs.sparkSession)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = WordHashes()
        held: list[tuple] = []
        size = 0

        def flush() -> pd.DataFrame:
            rows = packed(signatures([h[2] for h in held]))
            return pd.DataFrame({"doc_id": pd.array([h[0] for h in held], "Int64"), "text_hash": [h[1] for h in held], "node": [h[3] for h in held], "size": [int(h[2][1].sum()) for h in held], "signature": [r.tobytes() for r in rows]})

        for batch in batches:
            ids = [None if pd.isna(d) else int(d) for d in batch["doc_id"]]
            for doc_id, text_hash, text in zip(ids, batch["text_hash"], batch["text"], strict=True):
                bag = np.unique(shingles(words_of(text), known), return_counts=True)
                node = xxhash.xxh3_128_digest(bag[0].tobytes() + bag[1].tobytes()) if bag[0].size else bytes(16)
                held.append((doc_id, text_hash, bag, node))
                size += bag[0].size
                if size >= BATCH_SHINGLES or len(held) >= 4096:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()
        known.clear(), held.clear()
        common.release()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(common.text_of()).alias("text_hash"), common.text_of().alias("text"))
    return rows.mapInPandas(sign, FEATURES)


def bag_similarity(a: str | None, b: str | None) -> float:
    """Weighted Jaccard similarity of two texts' shingles, counted exactly."""
    x, y = _bag(words_of(a)), _bag(words_of(b))
    return _overlap(x, y)


def _bag(words: list[bytes]) -> Counter:
    width = min(SHINGLE, len(words))
    return Counter(zip(*(words[k : len(words) - width + 1 + k] for k in range(width)), strict=True))


def _overlap(x: Counter, y: Counter) -> float:
    if len(x) > len(y):
        x, y = y, x
    both = sum(min(n, y[s]) for s, n in x.items() if s in y)
    whole = x.total() + y.total() - both
    return both / whole if whole else 1.0


def _small(df: DataFrame) -> DataFrame:
    """A table of keys with a hint to broadcast it, if it is small enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_KEYS else df


def least_estimate(similarity: float) -> float:
    """The share of agreeing slots under which no link is looked for."""
    return similarity - DEVIATIONS * (similarity * (1 - similarity) / SLOTS) ** 0.5


class Texts:
    """The texts of nodes, and which pairs of nodes are links: by an estimate from signatures, then by the texts themselves."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, similarity: float):
        text = common.text_of()
        self.docs = docs.select(F.col("doc_id").cast("long").alias("of_doc"), F.xxhash64(text).alias("of_hash"), text.alias("text"))
        self.nodes, self.similarity = nodes, similarity

    def of(self, wanted: DataFrame) -> DataFrame:
        """(node, text) of (node, doc_id, text_hash)."""
        small = _small(wanted)
        return self.docs.join(small, self.docs["of_doc"].eqNullSafe(small["doc_id"]) & (self.docs["of_hash"] == small["text_hash"])).select("node", "text")

    def likely(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` (a, b) whose signatures don't rule a link out, with the keys of their texts."""
        side = lambda x: self.nodes.select(F.col("node").alias(x), F.col("signature").alias(f"sign_{x}"), F.struct("doc_id", "text_hash").alias(f"key_{x}"))
        least = least_estimate(self.similarity)

        def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch):
                    x, y = (np.frombuffer(b"".join(batch[c]), "<u2").reshape(len(batch), SLOTS) for c in ("sign_a", "sign_b"))
                    yield batch.loc[(x == y).mean(axis=1) >= least].drop(columns=["sign_a", "sign_b"])

        return common.cut(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "key_a", "key_b", "sign_a", "sign_b").mapInPandas(near, LIKELY))

    def likely_across(self, members: DataFrame, pivots: DataFrame) -> DataFrame:
        """The same for pairs of a bucket's members and pivots (bucket, n rows, others, node, size, shared, class, signature, key) of
        two classes; ``others``: rows of the other side in the bucket.

        Members and pivots come in chunks of bounded size, which are compared as matrices: a row is a pair of chunks, and only
        likely pairs become rows. A pair is taken in the first band that it shares. Pairs of chunks are dealt by bucket and by
        squares of SQUARE x SQUARE, so that a hot bucket is work for many tasks.
        """
        similarity, least = self.similarity, least_estimate(self.similarity)
        entry = F.struct("node", "size", "shared", "class", "signature", "key")

        def chunked(rows: DataFrame, most: int, other: int, name: str, own_side: str, other_side: str) -> DataFrame:
            chunk = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / most).cast("long"))
            made = rows.groupBy("bucket", chunk.alias("_c")).agg(F.collect_list(entry).alias(name), F.max(F.ceil(F.col("others") / (other * SQUARE))).alias("_m"))
            return made.select("bucket", F.floor(F.col("_c") / SQUARE).alias(own_side), F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("_m").cast("long"), F.lit(1)) - 1)).alias(other_side), name)

        def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for bucket, xs, ys in zip(batch["bucket"], batch["xs"], batch["ys"], strict=True):
                    x, y = (np.frombuffer(b"".join(e["signature"] for e in es), "<u2").reshape(len(es), SLOTS) for es in (xs, ys))
                    column = lambda es, c: np.array([e[c] for e in es])
                    sizes = column(xs, "size")[:, None] + column(ys, "size")
                    shared = np.minimum(column(xs, "shared")[:, None], column(ys, "shared"))
                    kind = {c: i for i, c in enumerate({e["class"] for e in [*xs, *ys]})}
                    other = np.array([kind[e["class"]] for e in xs])[:, None] != np.array([kind[e["class"]] for e in ys])
                    band = int(bucket["band"])
                    out = []
                    for i, j in np.argwhere(other & (shared * (1 + similarity) >= similarity * sizes - 1e-9)):
                        same = x[i] == y[j]
                        if same.mean() >= least and int(same.reshape(BANDS, ROWS).all(axis=1).argmax()) == band:
                            a, b = (xs[i], ys[j]) if xs[i]["node"] < ys[j]["node"] else (ys[j], xs[i])
                            out.append((a["node"], b["node"], a["key"], b["key"]))
                    yield pd.DataFrame(out, columns=["a", "b", "key_a", "key_b"])

        few = CHUNK // 4
        pairs = chunked(members, CHUNK, few, "xs", "_i", "_j").join(chunked(pivots, few, CHUNK, "ys", "_j", "_i"), ["bucket", "_i", "_j"])
        # a row holds hundreds of members: few rows are one batch
        common.bounded_batches(self.docs.sparkSession, CHUNK_ROWS)
        try:
            return common.cut(pairs.mapInPandas(near, LIKELY).dropDuplicates(["a", "b"]))
        finally:
            common.bounded_batches(self.docs.sparkSession)

    def links(self, likely: DataFrame) -> DataFrame:
        """Those of likely pairs that are similar."""
        side = lambda x: likely.select(F.col(x).alias("node"), f"key_{x}.doc_id", f"key_{x}.text_hash")
        texts = self.of(common.cut(side("a").union(side("b")).distinct()))
        similarity = self.similarity

        def same(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            last, bag = None, Counter()
            for batch in batches:
                keep = []
                for a, x, y in zip(batch["a"], batch["text_a"], batch["text_b"], strict=True):
                    if a != last:
                        last, bag = a, _bag(words_of(x))
                    keep.append(_overlap(bag, _bag(words_of(y))) >= similarity)
                yield batch.loc[keep, ["a", "b"]]

        left = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
        right = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
        return common.cut(likely.select("a", "b").join(left, "b").join(right, "a").select("a", "b", "text_a", "text_b").mapInPandas(same, "a binary, b binary"))

    def own_weight(self, wanted: DataFrame) -> DataFrame:
        """(node, own): the weight of a node's shingles that no other of these nodes has."""

        def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known = WordHashes()
            for batch in batches:
                for node, text in zip(batch["node"], batch["text"], strict=True):
                    names, counts = np.unique(shingles(words_of(text), known), return_counts=True)
                    yield pd.DataFrame({"node": node, "shingle": names.view(np.int64), "weight": counts})

        rows = self.of(wanted.join(self.nodes.select("node", "doc_id", "text_hash"), "node")).mapInPandas(cut_up, "node binary, shingle long, weight long")
        # with one row a node and shingle, the only row's weight and node are its sum and first
        alone = rows.groupBy("shingle").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"), F.min("node").alias("node")).where("n = 1")
        return alone.groupBy("node").agg(F.sum("weight").alias("own"))


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(node, class) for all nodes of ``links`` (a, b): the smallest node that links lead to. Rounds grow with the logarithm of
    the longest chain. ``known`` classes, if any, are joined with."""
    edges = links.select(F.col("a").alias("one"), F.col("b").alias("two"))
    if known is not None:
        edges = edges.union(known.where("node != class").select("node", "class"))
    edges = common.cut(edges.union(edges.select("two", "one")).distinct())
    labels = common.cut(edges.groupBy(F.col("one").alias("node")).agg(F.min("two").alias("low")).select("node", F.least("node", "low").alias("class")))
    while True:
        told = edges.join(labels.withColumnRenamed("node", "two"), "two").groupBy(F.col("one").alias("node")).agg(F.min("class").alias("low"))
        lower = labels.join(told, "node").select("node", F.least("class", "low").alias("class"), F.col("class").alias("was"))
        # the class of one's class halves the way to the smallest
        top = labels.select(F.col("node").alias("class"), F.col("class").alias("top"))
        jumped = common.cut(lower.join(top, "class").select("node", F.least("class", "top").alias("class"), "was"))
        labels = jumped.select("node", "class")
        if not jumped.where("class != was").limit(1).count():
            return labels


def node_classes(docs: DataFrame, found: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(node, class) of nodes that are linked, from the ``features`` of ``docs``."""
    nodes = found.groupBy("node").agg(F.first("signature").alias("signature"), F.first("size").alias("size"), F.min(F.struct("doc_id", "text_hash")).alias("key")).where(F.col("node") != F.lit(bytes(16)))
    nodes = common.cut(nodes.select("node", "signature", "size", "key.doc_id", "key.text_hash"))
    band = lambda i: F.struct(i.alias("band"), F.xxhash64(F.substring(F.col("signature"), i * 2 * ROWS + 1, F.lit(2 * ROWS))).alias("hash"))
    member = nodes.select("node", "size", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), band)).alias("bucket"))
    buckets = common.cut(member.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("first"), F.max("node").alias("last")).where("n > 1"))
    large = buckets.where("n > 2").select("bucket", "first")
    members = common.cut(member.join(_small(large), "bucket"))
    pairs = buckets.where("n = 2").select(F.col("first").alias("a"), F.col("last").alias("b")).union(members.where("node != first").select("first", "node")).distinct()
    texts = Texts(docs, nodes, similarity)
    classes = components(texts.links(texts.likely(pairs)))
    members = linkable(unsettled(members.select("bucket", "node", "size"), classes), texts, similarity)
    # an original stands between its copies: first those that share most of their weight are compared with all others
    entry = F.struct((F.col("size") - F.col("shared")).alias("own"), *[c for c in members.columns if c != "bucket"])
    central = members.groupBy("bucket", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(PIVOTS)).alias("salt")).agg(F.min(entry).alias("pivot"))
    pivots = central.select("bucket", "pivot.*").drop("own").withColumns({"others": F.col("n"), "n": F.lit(PIVOTS).cast("long")})
    classes = joined(texts, members.withColumn("others", F.lit(PIVOTS)), common.cut(pivots), classes)
    # then all that aren't of their bucket's largest class, so that each pair of two classes is compared
    members = unsettled(members, classes)
    smaller = F.col("n") - F.col("n_main")
    return joined(texts, members.withColumn("others", smaller), common.cut(members.where("class != main").withColumns({"others": F.col("n"), "n": smaller})), classes)


def unsettled(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Members of buckets that hold several classes, with their class, and of their bucket: n rows, n_main of them of its largest
    class ``main``, and its smallest size ``least``."""
    ruled = members.drop("class", "n", "n_main", "main", "least").join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
    each = ruled.groupBy("bucket", "class").agg(F.count("*").alias("k"), F.min("size").alias("least"))
    of = each.groupBy("bucket").agg(F.count("*").alias("classes"), F.sum("k").alias("n"), F.min("least").alias("least"), F.max(F.struct("k", "class")).alias("most"))
    of = of.where("classes > 1").select("bucket", "n", "least", F.col("most.k").alias("n_main"), F.col("most.class").alias("main"))
    return common.cut(ruled.join(_small(common.cut(of)), "bucket"))


def joined(texts: Texts, members: DataFrame, pivots: DataFrame, classes: DataFrame) -> DataFrame:
    """The classes after members and pivots of the same buckets are compared."""
    if not pivots.limit(1).count():
        return classes
    likely = texts.likely_across(members, pivots)
    if not likely.limit(1).count():
        return classes
    links = texts.links(likely)
    return components(links, classes) if links.limit(1).count() else classes


def linkable(members: DataFrame, texts: Texts, similarity: float) -> DataFrame:
    """Members of unsettled buckets that can have a link there at all, with ``shared``: the weight of what another may share.

    The partners of a node are in its buckets, so shingles that no other node of unsettled buckets has can't be shared. With c the
    weight of the others, and partners no smaller than the bucket's smallest member, no similarity is over c / (size + partner - c).
    """
    own = texts.own_weight(members.select("node").distinct())
    signed = texts.nodes.select("node", "signature", F.struct("doc_id", "text_hash").alias("key"))
    left = members.join(own, "node", "left").withColumn("shared", F.col("size") - F.coalesce("own", F.lit(0))).drop("own")
    most = F.col("shared") / (F.col("size") + F.greatest("least", "shared") - F.col("shared"))
    return common.cut(left.where(most >= similarity - 1e-9).join(signed, "node"))


@common.tidy
def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, any more): doc_id, text_hash, class_id, class_size, kept.

    A class is what links of a weighted Jaccard similarity of ``similarity`` or more join; class_id is its smallest doc_id, whose
    row stays (``kept``). Null texts count as empty; texts without words are copies of one another. Null doc_ids are larger than
    others. Rows repeated with the same doc_id and text come out each; they are all kept or all dropped. Very long texts are taken
    whole; similarities that equal ``similarity`` are links. An empty table gives none; other columns aren't read.
    """
    found = common.cut(features(docs))
    classes = node_classes(docs, found, similarity)
    ruled = common.cut(found.select("doc_id", "text_hash", "node").join(classes, "node", "left").select("doc_id", "text_hash", F.coalesce("class", "node").alias("class")), keep=True)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("text_hash").alias("c")))
    heads = common.cut(ruled.groupBy("class").agg(first.alias("first"), F.count("*").alias("class_size")), keep=True)
    kept = F.col("doc_id").eqNullSafe(F.col("first.b")) & (F.col("text_hash") == F.col("first.c"))
    return ruled.join(heads, "class").select("doc_id", "text_hash", F.col("first.b").alias("class_id"), "class_size", kept.alias("kept"))


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class, with the columns of ``docs``, whatever their names.

    Null and empty texts are one class, of which one row stays; so does one of rows repeated with the same doc_id and text. Ties,
    very long texts and empty tables are taken as by near_duplicates().
    """
    gone = near_duplicates(docs, similarity)
    gone = common.cut(gone, keep=True)
    dropped = _small(gone.where("not kept").select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct())
    rows = docs.join(dropped, docs["doc_id"].cast("long").eqNullSafe(dropped["gone_id"]) & (F.xxhash64(common.text_of()) == dropped["gone_hash"]), "left_anti")
    again = gone.where("kept").groupBy("doc_id", "text_hash").count().where("count > 1")
    if not again.limit(1).count():
        return rows
    # repeated rows of one doc_id and text: one of them stays
    again = _small(again.select(F.col("doc_id").alias("again_id"), F.col("text_hash").alias("again_hash")))
    same = rows["doc_id"].cast("long").eqNullSafe(again["again_id"]) & (F.xxhash64(common.text_of()) == again["again_hash"])
    of = "hash"
    while of in rows.columns:
        of = f"_{of}"
    once = rows.join(again, same, "left_semi").withColumn(of, F.xxhash64(common.text_of())).dropDuplicates(["doc_id", of]).drop(of)
    return rows.join(again, same, "left_anti").unionByName(once)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` at five words and a similarity of 0.8."""
    return near_duplicates(common.table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")
