"""Word splitting shared by the text operators.

A word is a maximal run of characters other than the six ASCII blanks
(space, tab, line feed, vertical tab, form feed, carriage return).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: the blanks that separate words ----------------------------
BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    """Array of the words of ``text`` (null or blank text: empty array)."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.filter(F.split(bare, BLANK_RUN), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words of ``text`` (null: 0) as bigint."""
    return F.size(words(text)).cast("bigint")
