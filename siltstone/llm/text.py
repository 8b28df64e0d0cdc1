"""Tokens and words as the tables' description defines them, for workers and for Spark SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token is a longest run of characters other than these six (no other character ends a token).
TOKEN = re.compile(r"[^ \t\n\r\v\f]+")
TOKEN_SQL = r"[^ \t\n\r\x0B\f]+"
#: A word is a longest run of letters or digits of any script, lower-cased.
WORD = re.compile(r"[^\W_]+")


def token_count(text: Column) -> Column:
    """Number of tokens; 0 for null, empty and blank text. Runs in the JVM."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN_SQL)), F.lit(0))


def words(text: str) -> list[str]:
    """The words of ``text`` in order."""
    low = text.lower()
    return WORD.findall(low) if len(low) == len(text) else [w.lower() for w in WORD.findall(text)]
