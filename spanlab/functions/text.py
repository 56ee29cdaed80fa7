"""Text normalisation, answer clean-up, phrase matching."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

PUNCTUATION = r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""


_SEVERAL = "".join(c for c in map(chr, range(0x10000)) if len(c.upper()) > 1)  # letters whose capital is several letters
_HELD = "".join(chr(0xE000 + k) for k in range(len(_SEVERAL)))
_SINGLE = "".join("\u1e9e" if c == "\u00df" else c.title() if len(c.title()) == 1 else c for c in _SEVERAL)


def upper_each(text: Column) -> Column:
    """Upper case letter by letter: a letter whose capital is several letters takes its single capital, or stays."""
    special = text.rlike(f"[{_SEVERAL}]")
    return F.when(special, F.translate(F.upper(F.translate(text, _SEVERAL, _HELD)), _HELD, _SINGLE)).otherwise(F.upper(text))


def words_only(text: Column) -> Column:
    """Lower case, every run of other characters one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def collapsed(text: Column) -> Column:
    """White space collapsed, closing dots off, lower case."""
    return F.lower(F.regexp_replace(F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " ")), r"\.+$", ""))


def unpunctuated(text: Column) -> Column:
    """ASCII punctuation deleted, lower case, trimmed."""
    return F.trim(F.lower(F.translate(text, PUNCTUATION, "")))


def finalized(text: Column, default: str) -> Column:
    """One line, first letter upper, never empty."""
    line = F.trim(F.regexp_replace(text, r"[ \t\r\n]+", " "))
    return F.coalesce(F.nullif(F.concat(F.upper(F.substring(line, 1, 1)), F.substring(line, 2, 1 << 30)), F.lit("")), F.lit(default))


# How a model's refusal begins, and the labels it may put before an answer.
REFUSALS = ("i'm", "i am", "i can", "i cannot", "i can't", "i do", "i don't", "i do not", "i would", "i could", "as an ai", "sorry", "unable to", "it is not possible", "there is not enough", "unfortunately")
LABELS = ("answer", "response", "a")


def sanitized(text: Column, words: int = 24) -> Column:
    """First non-blank line without an answer label or quotes, white space squeezed, at most ``words`` words; a refusal gives null."""
    line = F.get(F.filter(F.split(text, r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"), lambda x: F.regexp_replace(x, r"\s+", "") != ""), F.lit(0))
    trim = lambda c, what: F.regexp_replace(c, rf"^{what}+|{what}+$", "")
    line = trim(F.regexp_replace(trim(line, r"\s"), rf"^(?i:{'|'.join(LABELS)})\s*[:-]\s*", ""), r"\s")
    line = F.regexp_replace(trim(trim(trim(line, '"'), "'"), r"\s"), r"\s+", " ")
    return F.when((line != "") & ~F.lower(line).rlike(rf"^({'|'.join(REFUSALS)})\b"), F.array_join(F.slice(F.split(line, " "), 1, words), " "))


def matched_phrases(text: Column, phrases: Sequence[str]) -> Column:
    """Leftmost, non-overlapping phrases of a normalised text, longer ones first."""
    ordered = sorted(phrases, key=lambda p: (-len(p), p))
    return F.regexp_extract_all(text, F.lit(rf"\b({'|'.join(map(re.escape, ordered))})\b"), F.lit(1))
