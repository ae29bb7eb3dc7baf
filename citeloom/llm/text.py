"""Word normalisation shared by the text operators (runs in Arrow batches on the executors)."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

URL = regex.compile(r"(?:https?://|www\.)\S+", regex.I)
HANDLE = regex.compile(r"(?<![\p{L}\p{N}_.])@[\p{L}\p{N}_]+")
WORD = regex.compile(r"[\p{L}\p{N}]+")
MARKS = regex.compile(r"[\p{Mn}\p{Me}\p{Cf}]+")
ASCII = regex.compile(r"[\x00-\x7f]*")


def fold(text: str) -> str:
    """Case, accents, compatibility forms and invisible characters removed."""
    if ASCII.fullmatch(text):
        return text.lower()
    return MARKS.sub("", unicodedata.normalize("NFKD", text)).casefold()


def words(text: str | None) -> list[str]:
    """Words of a text without case, punctuation, emoji, links, @handles, # signs, entities and letter forms; null: none."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if "://" in text or "www." in text.lower():
        text = URL.sub(" ", text)
    if "@" in text:
        text = HANDLE.sub(" ", text)
    return WORD.findall(fold(text))


def plain_words(text: str | None) -> list[str]:
    """As ``words``, but links and handles stay (their letters and digits count)."""
    return WORD.findall(fold(html.unescape(text))) if text else []


def normalised(column: str | Column) -> Column:
    """The words of a text joined by single blanks, as a column; empty for null and wordless texts."""

    @F.pandas_udf("string")
    def join(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: " ".join(words(t)), na_action=None)

    return join(F.col(column) if isinstance(column, str) else column)
