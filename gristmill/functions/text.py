"""Scalar text functions: built-in expressions, and Arrow UDFs where Spark has none (HTML, NFC, Unicode punctuation).

Python's ``\\w``, ``\\d`` and ``\\s`` are Unicode classes, hence ``(?U)``; its ``.`` and ``$`` know one line end, hence ``(?d)``.
A null text gives null everywhere.
"""

from __future__ import annotations

import unicodedata
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed patterns: e-mail addresses, and Korean mobile numbers with optional separators.
EMAIL = r"(?U)[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}"
MOBILE = r"(?U)(?<!\d)01[016789][- .]?\d{3,4}[- .]?\d{4}(?!\d)"
#: Code points of a shingle.
SHINGLE = 5

_BREAK_BEFORE, _BREAK_AFTER, _SILENT = {"p", "div", "br", "li"}, {"p", "div", "li"}, {"script", "style"}


class _Prose(HTMLParser):
    """Text of a page: a line break for every block, nothing of scripts and styles."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []
        self.silence = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.silence += tag in _SILENT
        if tag in _BREAK_BEFORE and self.silence == 0:
            self.pieces.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in _SILENT and self.silence:
            self.silence -= 1
        if tag in _BREAK_AFTER and self.silence == 0:
            self.pieces.append("\n")

    def handle_data(self, data: str) -> None:
        if self.silence == 0:
            self.pieces.append(data)


def prose_of(page: str) -> str:
    reader = _Prose()
    reader.feed(page)
    reader.close()
    return "".join(reader.pieces)


@F.pandas_udf(T.StringType())
def html_to_text(pages: pd.Series) -> pd.Series:
    """HTML pages as text."""
    return pages.map(prose_of, na_action="ignore")


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Unicode NFC, which Spark does not have."""
    return texts.map(lambda t: t if t.isascii() else unicodedata.normalize("NFC", t), na_action="ignore")


def plain_newlines(text: Column) -> Column:
    """CRLF and CR as LF. Texts without a CR skip the pattern."""
    return F.when(text.contains("\r"), F.regexp_replace(text, r"\r\n?", "\n")).otherwise(text)


def redacted_contacts(text: Column) -> Column:
    """E-mail addresses and mobile numbers as [EMAIL] and [PHONE]. Without an @ there is no address, and the pattern, which tries every
    run of letters, is skipped."""
    mailless = F.when(text.contains("@"), F.regexp_replace(text, EMAIL, "[EMAIL]")).otherwise(text)
    return F.regexp_replace(mailless, MOBILE, "[PHONE]")


def contact_counts(text: Column) -> tuple[Column, Column]:
    """(e-mail addresses, mobile numbers) that ``redacted_contacts`` replaces."""
    return F.regexp_count(text, F.lit(EMAIL)), F.regexp_count(F.regexp_replace(text, EMAIL, "[EMAIL]"), F.lit(MOBILE))


def canonical_text(text: str) -> str:
    """``canonical`` of one text."""
    return " ".join((text if text.isascii() else unicodedata.normalize("NFC", text)).split())


@F.pandas_udf(T.StringType())
def _canonical(texts: pd.Series) -> pd.Series:
    return texts.map(canonical_text, na_action="ignore")


def canonical(text: Column) -> Column:
    """Key under which texts are the same: NFC, runs of white space as one space, none at either end. The text itself stays as it is."""
    return _canonical(text)


def digest(canonical_text: Column) -> Column:
    """SHA-256 in hex."""
    return F.sha2(canonical_text, 256)


def shingles(canonical_text: Column, size: int = SHINGLE) -> Column:
    """Distinct substrings of ``size`` code points; a shorter text is its own. One character is consumed a step, so the cost is
    linear and no surrogate pair is cut."""
    whole = F.array(canonical_text)
    windows = F.array_distinct(F.regexp_extract_all(canonical_text, F.lit(rf"(?s)(?=(.{{{size}}})).")))
    return F.when(F.length(canonical_text) < size, whole).otherwise(windows)


def minhash(shingle_array: Column, hashes: int = 8) -> Column:
    """One minimum a seed over 64-bit hashes."""

    def least(seed: int) -> Column:  # a second argument of the function would be the place in the array
        return F.array_min(F.transform(shingle_array, lambda s: F.xxhash64(F.lit(seed), s)))

    return F.array(*[least(seed) for seed in range(hashes)])


def folded_answer(text: Column) -> Column:
    """Answer as compared: NFC, lower case, neither white space nor punctuation."""
    return F.regexp_replace(F.lower(nfc(text)), r"(?U)[\s\x1c-\x1f\p{P}]", "")


def repetition(text: Column, n: int = 4) -> Column:
    """1 - distinct / all of the n-grams of code points; 0 for a text shorter than n."""
    if n < 1:
        raise ValueError("n must be positive")
    grams = F.regexp_extract_all(text, F.lit(rf"(?s)(?=(.{{{n}}}))."))
    return F.when(F.length(text) < n, F.lit(0.0)).otherwise(1 - F.size(F.array_distinct(grams)) / F.size(grams))
