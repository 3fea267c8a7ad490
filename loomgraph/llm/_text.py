"""Column expressions on texts, made of searches for single characters, which Spark does on bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space between words: space and 0x09 to 0x0D.
BLANKS = " \t\n\x0b\x0c\r"


def without(text: Column, characters: str) -> Column:
    """Text without any of the (ASCII) characters."""
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def spaced(text: Column) -> Column:
    """Words with one space between them; null is empty."""
    text = F.coalesce(text, F.lit(""))
    for c in BLANKS[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.trim(F.when(F.contains(text, F.lit("  ")), F.regexp_replace(text, " {2,}", " ")).otherwise(text))


def n_words_spaced(flat: Column) -> Column:
    """Number of words of a text from :func:`spaced`."""
    size = F.octet_length(flat)
    return (size - F.octet_length(without(flat, " ")) + (size > 0).cast("int")).cast("long")


def n_words(text: Column) -> Column:
    """Number of maximal runs of characters other than space and 0x09 to 0x0D."""
    return n_words_spaced(spaced(text))
