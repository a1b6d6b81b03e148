"""Words of a keyword index: accents off, stop words out, endings off by Porter's published rules (1980)."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: The endings of the steps, each with what takes its place. The longest one that a word has is tried.
STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]


def _vowels(word: str) -> list[bool]:
    """Whether each letter is a vowel; y is one after a consonant."""
    out: list[bool] = []
    for c in word:
        out.append(c in "aeiou" or (c == "y" and bool(out) and not out[-1]))
    return out


def _measure(stem: str) -> int:
    """How often a vowel is followed by a consonant."""
    v = _vowels(stem)
    return sum(a and not b for a, b in zip(v, v[1:]))


def _short_end(stem: str) -> bool:
    """Whether it ends in consonant, vowel, consonant, the last not w, x or y."""
    v = _vowels(stem)[-3:]
    return v == [False, True, False] and stem[-1] not in "wxy"


def _replaced(word: str, endings: dict[str, str]) -> str:
    for size in range(7, 1, -1):
        if len(word) > size - 1 and (ending := word[-size:]) in endings:
            return word[:-size] + endings[ending] if _measure(word[:-size]) > 0 else word
    return word


@lru_cache(maxsize=200_000)
def stemmed(word: str) -> str:
    """The stem of a lower-case word of ASCII letters."""
    if len(word) < 3:
        return word
    # Plurals.
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    # Past tenses and participles.
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        ending = next((e for e in ("ed", "ing") if word.endswith(e)), "")
        if ending and any(_vowels(word[: -len(ending)])):
            word = word[: -len(ending)]
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif len(word) > 1 and word[-1] == word[-2] and not _vowels(word)[-1] and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _short_end(word):
                word += "e"
    if word.endswith("y") and any(_vowels(word[:-1])):
        word = word[:-1] + "i"
    word = _replaced(_replaced(word, STEP_2), STEP_3)
    ending = max((e for e in STEP_4 if word.endswith(e)), key=len, default="")
    if ending:
        stem = word[: -len(ending)]
        if _measure(stem) > 1 and (ending != "ion" or stem.endswith(("s", "t"))):
            word = stem
    if word.endswith("e"):
        m = _measure(word[:-1])
        if m > 1 or (m == 1 and not _short_end(word[:-1])):
            word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


def _accents() -> tuple[str, str]:
    """Latin letters with marks, and the letters without."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250) if len(unicodedata.normalize("NFD", chr(c))) > 1]
    pairs = [(a, b) for a, b in pairs if b.isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


@F.arrow_udf(ArrayType(StringType()))
def stem_words(words: pa.Array) -> pa.Array:
    """The stems of the words of each text."""
    one = words.flatten().dictionary_encode()
    stems = pa.array([None if w is None else stemmed(w) for w in one.dictionary.to_pylist()], pa.string()).take(one.indices)
    sizes = np.asarray(pc.fill_null(pc.list_value_length(words), 0), dtype=np.int32)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), stems)


@dataclass(frozen=True)
class Analysis:
    """How texts and queries become terms. Stop words are a parameter: a list of them is the caller's to choose."""

    stem: bool = False
    accents_off: bool = False
    stop_words: frozenset[str] = frozenset()

    @staticmethod
    def english(stop_words: Iterable[str] = ()) -> Analysis:
        return Analysis(True, True, frozenset(stop_words))

    def text(self, column: Column) -> Column:
        low = F.lower(column)
        return F.translate(low, *_accents()) if self.accents_off else low

    def terms(self, query: str) -> list[str]:
        low = query.lower()
        if self.accents_off:
            low = low.translate(str.maketrans(*_accents()))
        words = "".join(c if "a" <= c <= "z" else " " for c in low).split()
        words = [w for w in words if w not in self.stop_words]
        return sorted({stemmed(w) if self.stem else w for w in words})
