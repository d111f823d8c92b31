"""Operator 4: a toxicity classifier with counterfactual regularisation.

A text is the set of its words. A logistic model of all words of a bounded sample of labelled rows is fitted, with an L1 penalty that
is the larger the less a word tells of the labels; of each labelled text that names a group, the copy with the identity terms swapped
is taken too, and the squared change of the score's log odds is penalised, so that naming a group weighs nothing by itself. All texts
are then scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .decontaminate import words_of

#: Labelled rows of either kind that the model is fitted on, at most: those with the smallest hashes of their doc_ids.
TOXIC_ROWS, OTHER_ROWS = 6_000, 10_000
#: A word's L1 penalty is PENALTY * (1 + (EVIDENCE / its log likelihood ratio) ** 4); EVIDENCE is beyond chance among a million words.
PENALTY, EVIDENCE, COUNTERFACTUAL = 1e-4, 8.0, 1.0
STEPS, RATE = 400, 0.5
#: Words in more sampled texts than this tell no copies.
RARE_DOCS = 40
THRESHOLD = 0.3
#: Rows with this remainder of crc32(doc_id) mod 4 are held out.
HELD_OUT = 2

#: Identity terms in pairs that are swapped for each other, by language.
PAIRS = (
    # English
    ("women", "men"), ("woman", "man"), ("girl", "boy"), ("female", "male"), ("she", "he"), ("her", "his"), ("mother", "father"), ("wife", "husband"), ("gay", "straight"), ("lesbian", "heterosexual"),
    ("transgender", "cisgender"), ("muslim", "christian"), ("muslims", "christians"), ("jewish", "catholic"), ("jews", "catholics"), ("hindu", "buddhist"), ("black", "white"), ("african", "european"), ("asian", "american"),
    ("mexican", "canadian"), ("immigrant", "citizen"), ("immigrants", "citizens"), ("deaf", "hearing"), ("blind", "sighted"), ("disabled", "abled"), ("old", "young"),
    # German
    ("frauen", "männer"), ("frau", "mann"), ("mädchen", "junge"), ("mutter", "vater"), ("schwul", "hetero"), ("muslime", "christen"), ("muslimisch", "christlich"), ("juden", "katholiken"), ("jüdisch", "katholisch"),
    ("schwarze", "weiße"), ("türken", "deutsche"), ("ausländer", "inländer"), ("alte", "junge"), ("behindert", "gesund"),
    # French
    ("femmes", "hommes"), ("femme", "homme"), ("fille", "garçon"), ("mère", "père"), ("homosexuel", "hétérosexuel"), ("musulmans", "chrétiens"), ("musulman", "chrétien"), ("juifs", "catholiques"), ("juif", "catholique"),
    ("noirs", "blancs"), ("noir", "blanc"), ("arabes", "français"), ("immigrés", "citoyens"), ("vieux", "jeunes"), ("handicapé", "valide"),
    # Spanish
    ("mujeres", "hombres"), ("mujer", "hombre"), ("niña", "niño"), ("madre", "padre"), ("homosexual", "heterosexual"), ("musulmanes", "cristianos"), ("musulmán", "cristiano"), ("judíos", "católicos"), ("judío", "católico"),
    ("negros", "blancos"), ("negro", "blanco"), ("gitanos", "payos"), ("inmigrantes", "ciudadanos"), ("viejos", "jóvenes"), ("discapacitado", "capaz"),
)

RESULT = "doc_id long, held_out boolean, score double, predicted int, n_words long"


def swaps(pairs: tuple[tuple[str, str], ...] = PAIRS) -> dict[bytes, bytes]:
    """Each term's counterpart; the first pair that has a term counts."""
    out: dict[bytes, bytes] = {}
    for a, b in pairs:
        out.setdefault(a.encode(), b.encode())
        out.setdefault(b.encode(), a.encode())
    return out


def held_out() -> F.Column:
    """False for null doc_ids, which can't be labelled."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == HELD_OUT, F.lit(False))


def swapped(words: set[bytes], other: dict[bytes, bytes]) -> set[bytes] | None:
    """The words with identity terms swapped; None without such terms. Where both of a pair are named, so that a swap is no change,
    one of them is left out instead: naming two groups must weigh what naming one does."""
    if words.isdisjoint(other):
        return None
    turned = {other.get(w, w) for w in words}
    return turned if turned != words else {w for w in words if not (w in other and other[w] in words and other[w] < w)}


def keys(words: set[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def sample(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, other_rows: int = OTHER_ROWS) -> DataFrame:
    """(doc_id, toxic, words, swapped): the sampled labelled texts as hashes of their words, and of those with terms swapped."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    few = known.where("toxic = 1").orderBy(*order).limit(toxic_rows).union(known.where("toxic = 0").orderBy(*order).limit(other_rows))
    few = F.broadcast(common.cut(few).withColumnRenamed("doc_id", "of_doc"))
    docs = docs.select("doc_id", "text")
    rows = docs.join(few, docs["doc_id"].cast("long") == few["of_doc"]).select(F.col("of_doc").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"), common.text_of().alias("text"))
    other = swaps()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = [set(words_of(t)) for t in batch["text"]]
            turned = [swapped(ws, other) for ws in words]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "toxic": batch["toxic"], "words": [keys(w).tobytes() for w in words], "swapped": [None if w is None else keys(w).tobytes() for w in turned]})

    return rows.mapInPandas(read, "doc_id long, toxic int, words binary, swapped binary")


class Model:
    """Weights of words, by hash."""

    def __init__(self, bias: float, names: np.ndarray, weights: np.ndarray):
        self.bias, self.weights = bias, dict(zip(names.tolist(), weights.tolist(), strict=True))


class Scorer(dict):
    """Scores of texts; remembers the weights of words."""

    def __init__(self, model: Model, most: int = 1_000_000):
        super().__init__()
        self.model, self.most = model, most

    def __missing__(self, word: bytes) -> float:
        if len(self) >= self.most:
            self.clear()
        weight = self[word] = self.model.weights.get(xxhash.xxh3_64_intdigest(word), 0.0)
        return weight

    def score(self, words: set[bytes]) -> float:
        """In one order of the words, whatever the set's."""
        z = self.model.bias + sum(sorted(filter(None, map(self.__getitem__, words))))
        return float(1 / (1 + np.exp(-z)))


def copies(row: np.ndarray, column: np.ndarray, names: np.ndarray, n: int) -> np.ndarray:
    """For each of n texts, how many are copies or near copies of it, itself too: those that agree in two neighbouring ones of
    the smallest values of four orders of their rare words, and so on from these."""
    common_in = np.bincount(column, minlength=names.size)
    rare = (common_in[column] >= 2) & (common_in[column] <= RARE_DOCS)
    row, value = row[rare], names[column[rare]]
    none = np.iinfo(np.uint64).max
    least = np.full((4, n), none, np.uint64)
    for k, odd in enumerate((1, 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0xA0761D6478BD642F)):
        np.minimum.at(least[k], row, value * np.uint64(odd))
    upper = list(range(n))

    def top(i: int) -> int:
        while upper[i] != i:
            upper[i] = upper[upper[i]]
            i = upper[i]
        return i

    for k in range(4):
        first: dict[tuple[int, int], int] = {}
        for i, pair in enumerate(zip(least[k].tolist(), least[(k + 1) % 4].tolist(), strict=True)):
            if int(none) not in pair:
                a, b = top(first.setdefault(pair, i)), top(i)
                upper[max(a, b)] = min(a, b)
    of = np.array([top(i) for i in range(n)], np.int64)
    return np.bincount(of, minlength=n)[of]


def fit(rows: pd.DataFrame, counterfactual: float = COUNTERFACTUAL, steps: int = STEPS) -> Model:
    """The model of sampled rows (toxic, words, swapped). Rows of one kind only give their share as every score.

    Minimised are the balanced log loss, the mean squared change of log odds under swaps and the words' L1 penalties, by proximal
    steps from nought. A word whose texts together can't outweigh its penalty stays at nought whatever the others are, so it is left
    out beforehand: no word is passed over that could weigh anything.
    """
    label = rows["toxic"].to_numpy(np.float64)
    mean = (label.sum() + 0.5) / (label.size + 1.0)
    base = float(np.log(mean / (1 - mean)))
    if label.size == 0 or label.min() == label.max():
        return Model(base, np.empty(0, np.uint64), np.empty(0))
    sets = [np.frombuffer(b, np.uint64) for b in rows["words"]]
    row = np.repeat(np.arange(len(sets)), [s.size for s in sets])
    name, column = np.unique(np.concatenate(sets), return_inverse=True)
    # copies count as one text together
    share = 1.0 / copies(row, column, name, label.size)
    n = np.bincount(column, weights=share[row], minlength=name.size)
    x = np.bincount(column, weights=(share * label)[row], minlength=name.size)
    rate, y = float((share * label).sum() / share.sum()), n - x
    # how much a word tells: the log likelihood ratio of its share among toxic texts
    with np.errstate(divide="ignore", invalid="ignore"):
        told = np.where(x > 1e-12, x * np.log(x / (n * rate)), 0) + np.where(y > 1e-12, y * np.log(y / (n * (1 - rate))), 0)
    penalty = PENALTY * (1 + (EVIDENCE / np.maximum(told, 1e-9)) ** 4)
    balance = share * np.where(label == 1, 0.5 / rate, 0.5 / (1 - rate)) / share.sum()
    most = [np.bincount(column, weights=(balance * kind)[row], minlength=name.size) for kind in (label, 1 - label)]
    able = np.maximum(*most) > penalty
    if not able.any():
        return Model(base, np.empty(0, np.uint64), np.empty(0))
    names, penalty = name[able], penalty[able]
    turned = [np.frombuffer(b, np.uint64) if b is not None else None for b in rows["swapped"]]

    def matrix(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        r, c = np.repeat(np.arange(len(parts)), [p.size for p in parts]), np.concatenate(parts) if parts else np.empty(0, np.uint64)
        at = np.minimum(np.searchsorted(names, c), names.size - 1)
        hit = names[at] == c
        return r[hit], at[hit]

    r, c = matrix(sets)
    pairs = [k for k, t in enumerate(turned) if t is not None]
    ra, ca = matrix([sets[k] for k in pairs])
    rb, cb = matrix([turned[k] for k in pairs])
    w, b = np.zeros(names.size), base
    speed, speed_b = np.full(names.size, 1e-8), 1e-8
    for _ in range(steps):
        z = b + np.bincount(r, weights=w[c], minlength=label.size)
        off = balance * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - label)
        slope = np.bincount(c, weights=off[r], minlength=names.size)
        if pairs:
            change = np.bincount(ra, weights=w[ca], minlength=len(pairs)) - np.bincount(rb, weights=w[cb], minlength=len(pairs))
            slope += counterfactual * 2 / len(pairs) * (np.bincount(ca, weights=change[ra], minlength=names.size) - np.bincount(cb, weights=change[rb], minlength=names.size))
        speed += slope * slope
        speed_b += off.sum() ** 2
        step = RATE / np.sqrt(speed)
        w -= step * slope
        w = np.sign(w) * np.maximum(np.abs(w) - step * penalty, 0)
        b -= RATE / np.sqrt(speed_b) * off.sum()
    keep = w != 0
    return Model(float(b), names[keep], w[keep])


def score_texts(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted, n_words."""
    common.bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(sent.value)
        for batch in batches:
            out = [(scorer.score(set(words)), len(words)) for words in map(words_of, batch["text"])]
            frame = pd.DataFrame(out, columns=["score", "n_words"])
            frame["doc_id"], frame["held_out"] = batch["doc_id"].astype("Int64"), batch["held_out"]
            frame["predicted"] = (frame["score"] >= threshold).astype("int32")
            yield frame

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text")).withColumn("held_out", held_out())
    return rows.mapInPandas(score, RESULT)


@common.tidy
def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, any more): doc_id, held_out, score, predicted, n_words.

    Null texts count as empty and get the score of a text without words. Null doc_ids are not held out, and never learnt from.
    A doc_id that is labelled more than once is toxic if any of its labels says so. Repeated rows come out each. Without labels,
    or with labels of one kind, all rows get the same score. Very long texts are read whole; equal texts get equal scores. An empty
    table gives none; other columns, whatever their names, aren't read.
    """
    return score_texts(docs, fit(sample(docs, labels).toPandas().sort_values("doc_id", ignore_index=True)))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``, after the labels of three quarters of them."""
    return classify(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
