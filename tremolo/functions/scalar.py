"""Scalar expressions: identifiers, text, gates. All stay in the JVM but for casefold()."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..params import DEFAULT, UNASSIGNED

#: Tokens by which the concept lane and the QA lane recognise negation.
NEGATIONS = ("no", "not", "never", "without", "absent", "denies", "denied")
QA_NEGATIONS = ("not", "no", "never", "none", "neither", "nor", "without", "cannot", "can't", "won't", "don't")
#: Answers that stand for no answer.
EMPTY_ANSWERS = ("", "unanswerable", "no answer", "none", "n/a", "unknown", "cannot answer")
#: Marks that a chat model leaves in its output, and what it says before a concept.
CHAT_MARKS = ("[/INST]", "</s>", "<s>", "<|eot_id|>")
CONCEPT_CHAT_MARKS = ("[/INST]", "</s>", "<s>")
CONCEPT_LEADS = ("Answer:", "Concept:", "The primary medical concept is")
CONCEPT_SENTENCE = r"(?is)^.*?the primary medical concepts?\b.*?\b(?:is|are)\b\s*:?\s*"
#: Tokens that stand for a missing value in label columns.
NA_LABELS = ("nan", "na", "none", "")
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def strip(x: Column) -> Column:
    """Without white space of any kind at either end (STR, trap 8)."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def squeeze(x: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return strip(F.regexp_replace(x, r"(?U)\s+", " "))


def is_blank(x: Column) -> Column:
    """Null, empty or white space alone (FLT-12)."""
    return F.coalesce(x, F.lit("")).rlike(r"(?U)^\s*$")


@F.pandas_udf(StringType())
def casefold(x: pd.Series) -> pd.Series:
    """Unicode case folding, which lower() isn't (trap 6)."""
    return x.map(lambda v: None if v is None else v.casefold())


def norm_concept(x: Column) -> Column:
    """A canonical concept id: without the UMLS prefix; missing tokens are UNASSIGNED (PRJ-01)."""
    bare = F.regexp_replace(strip(x), "^UMLS:", "")
    return F.when(x.isNull() | bare.isin("", "NA", "nan", "None"), UNASSIGNED).otherwise(bare)


def is_direct_concept(x: Column) -> Column:
    """The text is itself a concept id (PRJ-02)."""
    return F.coalesce(strip(x).rlike(r"(?i)^(UMLS:)?C\d+$"), F.lit(False))


def variant_id(instance: Column, k: Column) -> Column:
    """<instance>_pNN, or <instance>_orig where k is null (PRJ-03)."""
    return F.when(k.isNull(), F.concat(instance, F.lit("_orig"))).otherwise(F.format_string("%s_p%02d", instance, k.cast("int")))


def as_flag(x: Column) -> Column:
    """True for true, "True", "1" (PRJ-14)."""
    return F.coalesce(F.lower(x.cast("string")).isin("true", "1"), F.lit(False))


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def logit(p: Column, margin: float = 1e-4) -> Column:
    """ln(p / (1 - p)) of p squeezed into [margin, 1 - margin] (PRJ-09)."""
    q = clip(p, margin, 1 - margin)
    return F.ln(q / (1 - q))


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance over the longer length; 0 for two empty texts (STR-01)."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, F.lit(0.0)).otherwise(F.levenshtein(a, b) / longest)


def squad_normalise(x: Column) -> Column:
    """Lower case, no punctuation, no articles, single blanks (STR-02)."""
    bare = F.translate(F.lower(F.coalesce(x, F.lit(""))), PUNCTUATION, "")
    return squeeze(F.regexp_replace(bare, r"(?U)\b(a|an|the)\b", " "))


def is_empty_answer(x: Column) -> Column:
    """One of the texts that stand for no answer (STR-03)."""
    return squad_normalise(x).isin(*EMPTY_ANSWERS)


def words(x: Column) -> Column:
    """Unicode words (STR-09)."""
    return F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"(?U)\b\w+\b"), 0)


def tokens(x: Column) -> Column:
    """Words and single marks (STR-09)."""
    return F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"(?U)\w+|[^\w\s]"), 0)


def sentences(x: Column) -> Column:
    """Split after . ! ? and white space (STR-10)."""
    return F.split(F.coalesce(x, F.lit("")), r"(?<=[.!?])\s+")


def token_overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two token arrays (SET-05)."""
    times = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda n, x: n + F.least(times(a, x), times(b, x)))


def token_f1(pred: Column, gold: Column) -> Column:
    """F1 of the normalised texts' tokens; two empty texts agree (STR-04)."""
    cut = lambda x: F.filter(F.split(squad_normalise(x), " "), lambda t: t != "")

    def score(both: Column) -> Column:
        p, g = both["p"], both["g"]
        shared = token_overlap(p, g)
        return F.when((F.size(p) == 0) | (F.size(g) == 0), (F.size(p) == F.size(g)).cast("double")).otherwise(2.0 * shared / (F.size(p) + F.size(g)))

    # bound by a lambda, so that texts are normalised once and not for each token
    return F.element_at(F.transform(F.array(F.struct(cut(pred).alias("p"), cut(gold).alias("g"))), score), 1)


def exact_match(pred: Column, gold: Column) -> Column:
    """The normalised texts are equal (STR-05)."""
    return squad_normalise(pred) == squad_normalise(gold)


def contains_gold(pred: Column, gold: Column) -> Column:
    """A gold answer, not empty, stands in the prediction (STR-06)."""
    g = squad_normalise(gold)
    return (g != "") & F.contains(squad_normalise(pred), g)


def _without(x: Column, marks: tuple[str, ...]) -> Column:
    for mark in marks:
        x = F.replace(x, F.lit(mark), F.lit(" "))
    return x


def _after(x: Column, mark: str) -> Column:
    """What stands after the last such mark, or all."""
    return F.element_at(F.split(x, re.escape(mark)), -1)


def _trimmed(x: Column, marks: str) -> Column:
    """Without any of these characters at either end."""
    return F.trim(x, F.lit(marks))


def clean_answer(x: Column, most: int = 300) -> Column:
    """Without chat marks, what stands after the last ``Answer:``, on one line, without quotes around, cut to ``most`` characters (STR-07)."""
    text = _after(_without(strip(F.coalesce(x, F.lit(""))), CHAT_MARKS), "Answer:")
    return F.left(_trimmed(squeeze(text), " \"'`"), F.lit(most))


def clean_concept(x: Column, most: int = 200) -> Column:
    """A model's concept: without chat marks, leads, quotes and full stops around, on one line, cut to ``most`` characters (STR-08)."""
    text = _without(strip(F.coalesce(x, F.lit(""))), CONCEPT_CHAT_MARKS)
    for lead in CONCEPT_LEADS:
        text = _after(text, lead)
    text = _trimmed(F.regexp_replace(text, CONCEPT_SENTENCE, ""), " \"'`.")
    return F.left(squeeze(text), F.lit(most))


def unreadable_share(x: Column) -> Column:
    """Share of control characters, but tabs and line ends, and of characters beyond ``~``; 1 of an empty text (FLT-01, STR-15)."""
    text = F.coalesce(x, F.lit(""))
    return F.when(text == "", F.lit(1.0)).otherwise(F.regexp_count(text, F.lit(r"[^\t\n\r\x20-\x7E]")) / F.char_length(text))


def readable(x: Column, most: float = 0.20) -> Column:
    """Two characters or more, a letter of a-z among them, and hardly any that are unreadable (FLT-01)."""
    text = F.coalesce(x, F.lit(""))
    return (F.char_length(strip(text)) >= 2) & text.rlike("[A-Za-z]") & (unreadable_share(text) <= most)


def has_negation(x: Column) -> Column:
    return F.arrays_overlap(words(F.lower(x)), F.array(*map(F.lit, NEGATIONS)))


def negation_gate(a: Column, b: Column) -> Column:
    """Both texts have a negation, or neither has (GAT-3c)."""
    return has_negation(a).eqNullSafe(has_negation(b))


def negation_set_gate(a: Column, b: Column) -> Column:
    """Both texts have the same negations (GAT-3q)."""
    held = lambda x: F.array_sort(F.array_intersect(F.split(F.lower(squeeze(F.coalesce(x, F.lit("")))), " "), F.array(*map(F.lit, QA_NEGATIONS))))
    return held(a) == held(b)


def edit_gate(a: Column, b: Column, low: float = DEFAULT.edit_low, high: float = DEFAULT.edit_high) -> Column:
    """The texts differ enough, and not too much (GAT-5). Lengths that lie too far apart decide it without a distance, and a distance
    is no further looked for than ``high`` of the longer length."""
    longest, apart = F.greatest(F.char_length(a), F.char_length(b)), F.abs(F.char_length(a) - F.char_length(b))
    near = F.call_function("levenshtein", a, b, F.floor(longest * F.lit(high)).cast("int") + 1)
    share = F.when(longest == 0, F.lit(0.0)).when(near >= 0, near / longest).otherwise(F.lit(2.0))
    # bound by a lambda, so that the distance is taken once for both limits
    inside = F.exists(F.array(share), lambda d: d.between(low, high))
    return F.when(F.try_divide(apart, longest) > high, F.lit(False)).otherwise(inside)


def grammar_score(errors: Column, n_tokens: Column) -> Column:
    """1 - errors / tokens, not below 0 (GAT-4)."""
    return F.greatest(F.lit(0.0), 1 - errors / F.greatest(n_tokens, F.lit(1)))


def is_malformed(x: Column) -> Column:
    """Fewer than two words, under a fifth letters, or more than 0.55 marks (GAT-4)."""
    n = F.greatest(F.char_length(x), F.lit(1))
    return ~x.rlike(r"(?U)\S\s+\S") | (F.regexp_count(x, F.lit(r"\p{L}")) / n < 0.20) | (F.regexp_count(x, F.lit(r"[.,;:!?()\[\]{}\-]")) / n > 0.55)


def entity_mode(text: Column, mention: Column, similarity: Column | None = None, least: float = DEFAULT.entity_gate) -> Column:
    """How the mention is kept: mention_exact, mention_token_cover, high_similarity_proxy, or unverified (GAT-6)."""
    low, own = F.lower(text), F.coalesce(strip(F.lower(mention)), F.lit(""))
    long = F.filter(words(own), lambda t: F.char_length(t) > 2)
    mode = F.when((own != "") & F.contains(low, own), "mention_exact").when((F.size(long) > 0) & F.forall(long, lambda t: F.contains(low, t)), "mention_token_cover")
    if similarity is not None:
        mode = mode.when((own != "") & (similarity >= least), "high_similarity_proxy")
    return mode.otherwise("unverified")


def concept_gate(entail_ab: Column, contra_ab: Column, entail_ba: Column, contra_ba: Column, cosine: Column) -> Column:
    """Mean over both directions of the larger of entailment less half of contradiction, and 0.85 of the cosine (GAT-2c)."""
    one = lambda e, c: F.greatest(F.greatest(F.lit(0.0), e - 0.5 * c), 0.85 * cosine)
    return (one(entail_ab, contra_ab) + one(entail_ba, contra_ba)) / 2


def contradiction_gate(contradiction: Column, most: float = DEFAULT.contradiction_gate) -> Column:
    """Not contradicted; an unknown probability rejects (GAT-2q)."""
    return F.coalesce(contradiction < most, F.lit(False))
