"""Words as all operators of this subpackage see them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Blanks are space and U+0009 to U+000D; everything else belongs to a word.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def whole(text: Column) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """All words in order, repeats kept."""
    return F.array_remove(F.split(whole(text), BLANK_RUN), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("bigint")
