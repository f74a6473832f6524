"""Text matching expressions: whitespace, anchored dates, search tokens."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How a document may write a date, as patterns of ``date_format``.
DATE_PATTERNS = ("MM/dd/yyyy", "M/d/yyyy", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy")
TOKEN = r"[\p{L}\p{N}\p{Co}]+"


def normalize_space(text: Column) -> Column:
    """Runs of Unicode white space (no-break spaces too) become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def date_spellings(iso: Column) -> Column:
    """The ways a document may write a calendar date, as given first; null when it is none."""
    date = F.try_to_date(iso, "yyyy-M-d")
    return F.when(date.isNotNull(), F.array(iso, *(F.date_format(date, pattern) for pattern in DATE_PATTERNS)))


def contains_anchored(text: Column, needle: Column) -> Column:
    """Whether ``needle`` occurs with no ASCII digit right before or after it."""
    return F.rlike(
        text, F.concat(F.lit(r"(?<![0-9])\Q"), F.replace(needle, F.lit(r"\E"), F.lit("")), F.lit(r"\E(?![0-9])")))


def any_anchored(text: Column, needles: Column) -> Column:
    return F.exists(needles, lambda n: contains_anchored(text, n))


def _folding() -> tuple[str, str]:
    """Accented Latin letters and their base letters, by canonical decomposition.

    Only letters with exactly one mark fold; free-standing marks are deleted.
    """
    letters, bases = [], []
    for point in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base, *marks = unicodedata.normalize("NFD", chr(point))
        if len(marks) == 1 and unicodedata.combining(marks[0]):
            letters.append(chr(point))
            bases.append(base)
    marks = [chr(p) for p in range(0x300, 0x370)]
    return "".join(letters + marks), "".join(bases)


_LETTERS, _BASES = _folding()


def fold(text: Column) -> Column:
    """Lower case without diacritics."""
    return F.lower(F.translate(text, _LETTERS, _BASES))


def fold_text(text: str) -> str:
    """The same folding for a query term."""
    return text.translate(str.maketrans(
        dict(zip(_LETTERS, _BASES)) | {c: None for c in _LETTERS[len(_BASES):]})).lower()


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(fold(text), F.lit(TOKEN), F.lit(0))
