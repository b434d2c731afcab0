"""Porter stemming of single words (M. F. Porter, 1980), and its column forms."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Suffix rules as published. Step 2 and 3 apply when the stem
# before the suffix has measure > 0, step 4 when it has measure > 1.
STEP_1A = [("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")]
STEP_2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"),
    ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"),
    ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"),
    ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP_4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou",
    "ism", "ate", "iti", "ous", "ive", "ize",
]

# Words a task remembers, and the letters of the longest of them. Texts that are stemmed at once.
KNOWN_WORDS = 300_000
KNOWN_LETTERS = 40
TEXTS_AT_ONCE = 256


# Longer suffixes are tried first.
_PLURALS, _DOUBLES, _ENDINGS = (sorted(r, key=lambda p: -len(p[0])) for r in (STEP_1A, STEP_2, STEP_3))
_LAST = sorted(STEP_4, key=len, reverse=True)


def _marks(word: str) -> str:
    """'v' or 'c' per letter; y is a vowel after a consonant."""
    shape = re.sub("[aeiou]", "v", re.sub("[^aeiouy]", "c", word))
    while "y" in shape:
        at = shape.index("y")
        shape = shape[:at] + ("v" if shape[at - 1 : at] == "c" else "c") + shape[at + 1 :]
    return shape


def _measure(word: str) -> int:
    return _marks(word).count("vc")


def _ends_cvc(word: str) -> bool:
    return _marks(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _ends_double(word: str) -> bool:
    return word[-1:] == word[-2:-1] and _marks(word)[-2:] == "cc"


def _swap(word: str, rules, least: int) -> str:
    """Apply the longest matching suffix rule if its stem is long enough."""
    for suffix, new in rules:
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            return stem + new if least == 0 or _measure(stem) >= least else word
    return word


def _past_forms(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    cut = next((n for end, n in (("ed", 2), ("ing", 3)) if word.endswith(end)), 0)
    if not cut or "v" not in _marks(word[:-cut]):
        return word
    word = word[:-cut]
    if word.endswith(("at", "bl", "iz")):
        return word + "e"
    if _ends_double(word) and word[-1] not in "lsz":
        return word[:-1]
    return word + "e" if _measure(word) == 1 and _ends_cvc(word) else word


def _last_suffix(word: str) -> str:
    for suffix in _LAST:
        if word.endswith(suffix):
            stem = word[: -len(suffix)]
            fits = _measure(stem) > 1 and (suffix != "ion" or stem[-1:] in ("s", "t"))
            return stem if fits else word
    return word


def _tidy(word: str) -> str:
    if word.endswith("e"):
        stem = word[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _ends_cvc(stem)):
            word = stem
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


def stem_word(word: str) -> str:
    """Stem of a lower-case word; words of one or two letters stay."""
    if len(word) < 3:
        return word
    word = _past_forms(_swap(word, _PLURALS, 0))
    if word.endswith("y") and "v" in _marks(word[:-1]):
        word = word[:-1] + "i"
    word = _swap(_swap(word, _DOUBLES, 1), _ENDINGS, 1)
    return _tidy(_last_suffix(word))


class _Known(dict):
    """Stems worked out so far in one task, in two halves: what is asked for again outlives a full half, what is not goes with it."""

    def __init__(self):
        super().__init__()
        self.old: dict[str, str] = {}

    def __missing__(self, word: str) -> str:
        if len(word) > KNOWN_LETTERS:
            return stem_word(word)
        if len(self) >= KNOWN_WORDS // 2:
            self.old = dict(self)
            self.clear()
        stem = self.old.get(word)
        self[word] = stem = stem_word(word) if stem is None else stem
        return stem


@F.pandas_udf(T.StringType())
def stem_token(tokens: pd.Series) -> pd.Series:
    return tokens.map(stem_word, na_action="ignore")


def _stemmed(text: str | None, known: _Known) -> str | None:
    return None if text is None else " ".join([known[w] for w in text.split(" ")])


@F.arrow_udf(T.StringType())
def stem_text(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Stem each blank-separated token; a word is worked out once while it is remembered, and only some texts of a batch are Python strings."""
    known = _Known()
    for batch in texts:
        pieces = (batch.slice(i, TEXTS_AT_ONCE).to_pylist() for i in range(0, len(batch), TEXTS_AT_ONCE))
        made = [pa.array([_stemmed(t, known) for t in piece], batch.type) for piece in pieces]
        yield pa.concat_arrays(made) if made else batch


# Executors need no copy of this package: what the functions use goes along.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
