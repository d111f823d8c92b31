"""Models are providers that are handed in; those here need no weights and serve tests and dry runs."""

from __future__ import annotations

import hashlib
import math
import re
from typing import Protocol


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Nli(Protocol):
    def entailment(self, premises: list[str], hypotheses: list[str]) -> list[float]: ...

    def contradiction(self, premises: list[str], hypotheses: list[str]) -> list[float]: ...


class GrammarChecker(Protocol):
    def errors(self, texts: list[str]) -> list[int]: ...


class PosTagger(Protocol):
    def tag(self, tokens: list[str]) -> list[str]: ...


class Generator(Protocol):
    def generate(self, prompts: list[str]) -> list[str]: ...


class HashEmbedder:
    """Unit vectors from hashed character trigrams."""

    def __init__(self, size: int = 64):
        self.size = size

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.size
            padded = f"  {text.lower()} "
            for i in range(len(padded) - 2):
                h = int.from_bytes(hashlib.blake2b(padded[i : i + 3].encode(), digest_size=8).digest(), "little")
                v[h % self.size] += 1.0 if h >> 63 else -1.0
            norm = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / norm for x in v])
        return out


class LexicalNli:
    """Entailment as the share of the hypothesis' words in the premise; a negation on one side alone contradicts."""

    def __init__(self, same: tuple[frozenset[str], ...] = ()):
        self.same = same

    def entailment(self, premises: list[str], hypotheses: list[str]) -> list[float]:
        out = []
        for p, h in zip(premises, hypotheses, strict=True):
            if any(p in s and h in s for s in self.same):
                out.append(1.0)
                continue
            a, b = set(re.findall(r"\w+", p.lower())), set(re.findall(r"\w+", h.lower()))
            out.append(len(a & b) / len(b) if b else 0.0)
        return out

    def contradiction(self, premises: list[str], hypotheses: list[str]) -> list[float]:
        no = {"no", "not", "never", "without"}
        return [float(bool(no & set(p.lower().split())) != bool(no & set(h.lower().split()))) for p, h in zip(premises, hypotheses, strict=True)]


class SuffixTagger:
    """Parts of speech by ending (STR-14)."""

    #: Endings and their tags, the first that fits counts; other words are nouns.
    ENDINGS = ((("ing", "ed"), "VERB"), (("ly",), "ADV"), (("al", "ive", "ous", "ic", "ary"), "ADJ"))

    def tag(self, tokens: list[str]) -> list[str]:
        return [next((tag for ends, tag in self.ENDINGS if t.lower().endswith(ends)), "NOUN") for t in tokens]


#: The category of each part of speech.
CATEGORIES = {"NOUN": "noun", "PROPN": "noun", "VERB": "verb", "AUX": "verb", "ADJ": "modifier", "ADV": "modifier", "DET": "function_word", "ADP": "function_word", "CCONJ": "function_word", "SCONJ": "function_word", "PART": "function_word", "PRON": "function_word"}


def linguistic_category(tags: list[str]) -> str:
    """The one category that the tags have, mixed of several, unknown of none (STR-14)."""
    found = {CATEGORIES[t] for t in tags if t in CATEGORIES}
    return found.pop() if len(found) == 1 else "mixed" if found else "unknown"


class RepeatChecker:
    """Grammar errors: words that stand twice in a row."""

    def errors(self, texts: list[str]) -> list[int]:
        return [len(re.findall(r"\b(\w+)\s+\1\b", t.lower())) for t in texts]
