"""Porter's stemmer for English terms (1980), in Arrow batches; off by default everywhere."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes of steps 2 to 4 and what replaces them.
DOUBLE = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
SINGLE = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
LAST = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _shape(word: str) -> str:
    """A letter a place: v for vowels (y after a consonant is one), c for consonants."""
    out: list[str] = []
    for ch in word:
        out.append("v" if ch in "aeiou" or (ch == "y" and out[-1:] == ["c"]) else "c")
    return "".join(out)


def _measure(stem: str) -> int:
    return _shape(stem).count("vc")


def _short_end(word: str) -> bool:
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _replaced(word: str, table: dict[str, str]) -> str:
    for suffix in sorted(table, key=len, reverse=True):
        if word.endswith(suffix):
            base = word[: -len(suffix)]
            return base + table[suffix] if _measure(base) > 0 else word
    return word


def stem(word: str) -> str:
    """Stem of a lower-case word; words of two letters or with other signs stay."""
    if len(word) < 3 or not word.isalpha() or not word.isascii():
        return word
    # 1a: plurals.
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    # 1b: past and progressive forms.
    if word.endswith("eed"):
        if _measure(word[:-3]) > 0:
            word = word[:-1]
    else:
        for suffix in ("ed", "ing"):
            base = word[: -len(suffix)]
            if word.endswith(suffix) and "v" in _shape(base):
                if base.endswith(("at", "bl", "iz")):
                    base += "e"
                elif len(base) > 1 and base[-1] == base[-2] and base[-1] not in "lsz" and _shape(base)[-1] == "c":
                    base = base[:-1]
                elif _measure(base) == 1 and _short_end(base):
                    base += "e"
                word = base
                break
    # 1c
    if word.endswith("y") and "v" in _shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replaced(_replaced(word, DOUBLE), SINGLE)
    # 4: suffixes that go behind a long stem.
    for suffix in sorted(LAST, key=len, reverse=True):
        if word.endswith(suffix):
            base = word[: -len(suffix)]
            if _measure(base) > 1 and (suffix != "ion" or base.endswith(("s", "t"))):
                word = base
            break
    # 5: final e and double l.
    if word.endswith("e"):
        base = word[:-1]
        if _measure(base) > 1 or (_measure(base) == 1 and not _short_end(base)):
            word = base
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


def stemmed(tokens: Column) -> Column:
    """Tokens with their stems in place."""

    @F.pandas_udf("array<string>")
    def run(batch: pd.Series) -> pd.Series:
        known: dict[str, str] = {}
        for w in {w for ts in batch if ts is not None for w in ts}:
            known[w] = stem(w)
        return batch.map(lambda ts: None if ts is None else [known[t] for t in ts])

    return run(tokens)
