"""Perturbations by rule, gates over them, and which attempts stay."""

from __future__ import annotations

import difflib
import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from ..functions import scalar
from ..params import UNASSIGNED


def n_words(x: Column) -> Column:
    return F.when(scalar.is_blank(x), 0).otherwise(F.size(F.split(scalar.squeeze(x), " ")))


def reordered(x: Column) -> Column:
    """Syntactic variants, distinct, in this order: the second part before a first one of up to 12 words, at commas; two halves of 3
    to 18 words changed around ``and``; the reason first; and the text on one line (PRT-02)."""
    text = scalar.strip(F.coalesce(x, F.lit("")))
    parts = F.filter(F.transform(F.split(text, ","), scalar.strip), lambda p: p != "")
    part = lambda ps, i: F.coalesce(F.try_element_at(ps, F.lit(i)), F.lit(""))
    stop = F.when(F.endswith(text, F.lit(".")), "").otherwise(".")
    comma = F.when(F.contains(text, F.lit(",")) & (F.size(parts) >= 2) & (n_words(part(parts, 1)) <= 12), F.concat(part(parts, 2), F.lit(", "), part(parts, 1), stop))
    halves, why = F.split(text, " and "), F.split(text, " because ")
    and_ = F.when((F.size(halves) == 2) & F.forall(halves, lambda p: n_words(p).between(3, 18)), F.concat(scalar.strip(part(halves, 2)), F.lit(" and "), scalar.strip(part(halves, 1))))
    because = F.when(F.size(why) == 2, F.concat(F.lit("Because "), scalar.strip(part(why, 2)), F.lit(", "), scalar.strip(part(why, 1))))
    line = F.regexp_replace(text, r"(?U)\s+", " ")
    return F.array_distinct(F.filter(F.array_compact(F.array(comma, and_, because, line)), lambda v: v != ""))


#: Words that are too telling to be replaced.
KEPT_WORDS = ("patient", "patients", "clinical", "medical", "disease", "disorder", "syndrome", "cancer", "tumor", "tumour", "diabetes", "hypertension", "infection")


def synonym_variants(rows: DataFrame, key: list[str], text: str, mention: str, lexicon: DataFrame, most: int = 4) -> DataFrame:
    """(key, variant): the text's tokens with one replaced by each of its first ``most`` synonyms (PRT-01).

    lexicon: (word, synonym), in lower case on the left; of a word's synonyms those of more than two letters, without others, are
    taken by length and letters. Negations, words of KEPT_WORDS and words of the mention stay.
    """
    known = lexicon.where(F.lower("synonym") != F.lower("word")).where(F.col("synonym").rlike(r"^\p{L}{3,}$") & ~F.lower("synonym").isin(*scalar.NEGATIONS))
    known = known.groupBy(F.lower("word").alias("_w")).agg(F.slice(F.array_sort(F.collect_set(F.struct(F.char_length("synonym").alias("n"), F.col("synonym").alias("s")))), 1, most).alias("_s"))
    tokens = rows.select(*key, F.col(text).alias("_text"), scalar.words(F.lower(F.col(mention))).alias("_m"), scalar.tokens(F.col(text)).alias("_t"))
    each = tokens.select(*key, "_text", "_m", "_t", F.posexplode("_t").alias("_i", "_token")).withColumn("_w", F.lower("_token"))
    each = each.where(F.col("_token").rlike(r"^\p{L}+$") & ~F.col("_w").isin(*KEPT_WORDS, *scalar.NEGATIONS) & ~F.array_contains("_m", F.col("_w")))
    made = each.join(known, "_w").select(*key, "_text", "_t", "_i", F.explode("_s.s").alias("_syn"))
    variant = F.concat_ws(" ", F.transform("_t", lambda t, i: F.when(i == F.col("_i"), F.col("_syn")).otherwise(t)))
    return made.select(*key, "_text", variant.alias("variant")).where("variant != _text").select(*key, "variant").distinct()


#: What a paraphrase without a model substitutes, as text and as words; and what a translation without one changes.
PARAPHRASE_TEXTS = ((" is ", " remains "), (" was ", " remained "))
PARAPHRASE_WORDS = (("shows", "demonstrates"), ("with", "accompanied by"))
TRANSLATION_TEXTS = ((";", "."),)
TRANSLATION_WORDS = (("which", "that"),)


def _substituted(text: Column, texts: tuple[tuple[str, str], ...], words: tuple[tuple[str, str], ...]) -> list[Column]:
    """The text with each substitution alone."""
    return [*(F.replace(text, F.lit(a), F.lit(b)) for a, b in texts), *(F.regexp_replace(text, rf"(?U)\b{a}\b", b) for a, b in words)]


def template_paraphrase(x: Column) -> Column:
    """The variants without a model: up to three by fixed substitutions, or the text itself (PRT-03)."""
    text = scalar.strip(F.coalesce(x, F.lit("")))
    made = F.array(*_substituted(text, PARAPHRASE_TEXTS, PARAPHRASE_WORDS))
    other = F.slice(F.filter(F.array_distinct(made), lambda v: (v != "") & (v != text)), 1, 3)
    return F.when(F.size(other) > 0, other).otherwise(F.array(text))


def back_translated(x: Column, translated: Column | None = None) -> Column:
    """(variants, fallback): a translation there and back where a model gives one; else small changes, marked as fallback (PRT-04)."""
    text = scalar.strip(F.coalesce(x, F.lit("")))
    small = F.array(F.regexp_replace(text, r"(?U)\s+", " "), *_substituted(text, TRANSLATION_TEXTS, TRANSLATION_WORDS))
    back = F.coalesce(scalar.strip(translated), F.lit("")) if translated is not None else F.lit("")
    variants = F.when(back != "", F.array(back)).otherwise(F.array_distinct(F.filter(small, lambda v: v != "")))
    return F.struct(variants.alias("variants"), (back == "").alias("fallback"))


def no_op(text: Column, variant: Column, fallback: Column) -> Column:
    """A fallback that changed nothing: it is rejected whatever the gates say (GAT-7)."""
    return F.coalesce(fallback, F.lit(False)) & (scalar.strip(variant) == scalar.strip(text))


def accepted_final(gates: list[Column], noop: Column) -> Column:
    """All gates pass, an unknown one doesn't, and it is no no-op (GAT-7)."""
    out = ~F.coalesce(noop, F.lit(True))
    for gate in gates:
        out = out & F.coalesce(gate, F.lit(False))
    return out


def tfidf_cosine_of(a: str | None, b: str | None) -> float:
    """Cosine of two texts' words and pairs of words, TF-IDF over the two alone, smoothed."""
    counts = []
    for text in (a, b):
        own = re.findall(r"\b\w\w+\b", (text or "").lower())
        counts.append(Counter(own) + Counter(zip(own, own[1:], strict=False)))
    weight = lambda t: math.log(3 / (1 + sum(t in c for c in counts))) + 1
    x, y = ({t: n * weight(t) for t, n in c.items()} for c in counts)
    norm = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
    return sum(v * y[t] for t, v in x.items() if t in y) / norm if norm else 0.0


@F.pandas_udf(DoubleType())
def tfidf_cosine(a: pd.Series, b: pd.Series) -> pd.Series:
    """tfidf_cosine_of() of columns: the similarity gate without an embedder (GAT-1c)."""
    return pd.Series([tfidf_cosine_of(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


def chosen(variants: Column, key: Column, attempt: Column, seed: int) -> Column:
    """One of the variants, by a hash of seed, key and attempt; null of none."""
    return F.when(F.size(variants) > 0, F.element_at(variants, (F.pmod(F.xxhash64(F.lit(seed), key, attempt), F.greatest(F.size(variants), F.lit(1))) + 1).cast("int")))


def kept_attempts(attempts: DataFrame, slot: list[str], attempt: str = "attempt", accepted: str = "accepted") -> DataFrame:
    """Of a slot's attempts the first accepted, else the last (PRT-05)."""
    ok = F.col(accepted)
    order = F.when(ok, F.col(attempt)).otherwise(1_000_000 - F.col(attempt))
    window = Window.partitionBy(*slot).orderBy(F.when(ok, 0).otherwise(1), order)
    return attempts.withColumn("_k", F.row_number().over(window)).where("_k = 1").drop("_k")


def gate_summary(rows: DataFrame, gates: list[str]) -> DataFrame:
    """Passes, failures and failure rate of each gate (AGG-17)."""
    long = rows.select(*[F.col(g).cast("int").alias(g) for g in gates]).unpivot([], gates, "gate", "passed")
    made = long.groupBy("gate").agg(F.sum("passed").alias("n_pass"), F.count_if(F.col("passed") == 0).alias("n_fail"))
    return made.withColumn("fail_rate", F.try_divide("n_fail", F.col("n_pass") + F.col("n_fail")))


def rescued(rows: DataFrame, kind: str, accepted: str, score: str, order: str, by: list[str] | None = None) -> DataFrame:
    """The best row of each type of which none is accepted (SRT-04), within ``by`` (a corpus or shard)."""
    keys = [*(by or []), kind]
    none = rows.groupBy(*keys).agg(F.max(F.col(accepted).cast("int")).alias("_a")).where("_a = 0").drop("_a")
    return rows.join(none, keys, "left_semi").groupBy(*keys).agg(F.max_by(order, F.struct(F.col(score), -F.col(order))).alias(order), F.max(score).alias(score))


def sparse_removed(rows: DataFrame, by: list[str], instance: str, least: int = 3) -> DataFrame:
    """Rows without those of groups with fewer instances (FLT-14)."""
    few = rows.groupBy(*by).agg(F.count_distinct(instance).alias("_n")).where(F.col("_n") < least).select(*by)
    return rows.join(few, by, "left_anti")


def changed_of(a: str | None, b: str | None) -> list[str]:
    """The different words of b that an edit from a to b replaced or put in, as they come."""
    x, y = (re.findall(r"\b\w+\b", (t or "").lower()) for t in (a, b))
    return list(dict.fromkeys(w for tag, _, _, i, j in difflib.SequenceMatcher(None, x, y).get_opcodes() if tag != "equal" for w in y[i:j]))


@F.pandas_udf(ArrayType(StringType()))
def changed_words(a: pd.Series, b: pd.Series) -> pd.Series:
    """changed_of() of columns (STR-13)."""
    return pd.Series([changed_of(x, y) for x, y in zip(a, b, strict=True)])


def context_of(text: str | None, mention: str | None, start: int | None = None, end: int | None = None, width: int = 40) -> str:
    """The sentence at the span, else the first that holds the mention, else ``width`` tokens either side of its tokens, else of the middle."""
    text, mention = text or "", (mention or "").strip()
    sentences = [p.strip() for p in re.split(r"(?<=[.!?])\s+", text.strip()) if p.strip()]
    if start is not None and end is not None and 0 <= start < len(text):
        at = 0
        for sentence in sentences:
            first = text.find(sentence, at)
            if first <= start < first + len(sentence):
                return sentence
            at = max(at, first + len(sentence))
    if mention:
        for sentence in sentences:
            if mention.lower() in sentence.lower():
                return sentence
    tokens, own = text.split(), mention.lower().split()
    if not tokens:
        return text
    low = [t.lower() for t in tokens]
    places = [i for i in range(len(tokens) - len(own) + 1) if low[i : i + len(own)] == own] if own else []
    first, last = (places[0], places[0] + len(own)) if places else (len(tokens) // 2,) * 2
    return " ".join(tokens[max(0, first - width) : last + width])


@F.pandas_udf(StringType())
def mention_context(text: pd.Series, mention: pd.Series, start: pd.Series, end: pd.Series) -> pd.Series:
    """context_of() of columns (STR-11)."""
    whole = lambda x: None if pd.isna(x) else int(x)
    return pd.Series([context_of(t, m, whole(a), whole(b)) for t, m, a, b in zip(text, mention, start, end, strict=True)])


def collisions(rows: DataFrame, changed: DataFrame, cell: list[str], variant: str, label: str) -> DataFrame:
    """Changed rows whose new label a sibling variant already has (COL-01)."""
    siblings = rows.select(*cell, F.col(variant).alias("_v"), F.col(label).alias("_l"))
    joined = changed.join(siblings, cell).where((F.col("_v") != F.col(variant)) & (F.col("_l") == F.col(f"new_{label}")))
    hit = joined.select(*cell, variant).distinct().withColumn("collides", F.lit(True))
    return changed.join(hit, [*cell, variant], "left").withColumn("collides", F.coalesce("collides", F.lit(False)))


def collision_effect(rows: DataFrame, cell: list[str], variant: str, before: str, after: str) -> DataFrame:
    """(any_collision, direction, n): how many cells' entropy went up, down or lost its value, by whether a changed variant's new label
    was already among its siblings' labels (COL-01). ``rows`` has each variant once, with both labels. All six rows are there."""
    from .cuts import kept
    from .entropy import label_entropy

    clean = lambda c: F.when(scalar.is_blank(F.col(c)) | (scalar.strip(F.col(c)) == "nan"), UNASSIGNED).otherwise(scalar.strip(F.col(c)))
    held, _ = kept(rows.select(*cell, F.col(variant).alias("_ord"), clean(before).alias("_b"), clean(after).alias("_a")))
    h = [label_entropy(held, cell, label).select(*cell, F.col("normalised_entropy").alias(name)) for label, name in (("_b", "_hb"), ("_a", "_ha"))]
    same = (F.coalesce("_hb", F.lit(-1.0)) - F.coalesce("_ha", F.lit(-1.0))).between(-1e-8, 1e-8)
    direction = F.when(F.col("_ha") > F.col("_hb"), "up").when(F.col("_ha") < F.col("_hb"), "down").otherwise("undefined")
    moved = h[0].join(h[1], cell).where(~same).select(*cell, direction.alias("direction"))
    # a label that a sibling had before: it is there at all and the variant's own was another
    labels = held.groupBy(*cell, "_b").agg(F.lit(True).alias("_there")).withColumnRenamed("_b", "_l")
    changed = held.where(F.col("_b") != F.col("_a")).withColumnRenamed("_a", "_l")
    hit = changed.join(labels, [*cell, "_l"]).select(*cell).distinct().withColumn("any_collision", F.lit(True))
    counted = moved.join(hit, cell, "left").groupBy(F.coalesce("any_collision", F.lit(False)).alias("any_collision"), "direction").agg(F.count("*").alias("n"))
    cells = rows.sparkSession.createDataFrame([(a, d) for a in (False, True) for d in ("up", "down", "undefined")], "any_collision boolean, direction string")
    return cells.join(F.broadcast(counted), ["any_collision", "direction"], "left").select("any_collision", "direction", F.coalesce("n", F.lit(0)).alias("n"))
