"""What several operators share: the word pattern, row-wise bindings and stored tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spotgrid.plans.session import shared_folder

#: White space between words, as a Java pattern and as characters.
SPACES = r"[ \x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: A word, as a pattern of Java and of Python's ``re``.
WORD = r"[^\x20\x09-\x0D]+"


class Cache:
    """Two generations of entries: what is used stays, the rest goes when a generation is full."""

    def __init__(self, most: int) -> None:
        self.most, self.young, self.old = most, {}, {}

    def missing(self, keys: set) -> list:
        """Keys that neither generation holds; all others are in the young one after this."""
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young
        wanted = keys.difference(self.young)
        kept, new = [], []
        for k in wanted:
            (kept if k in self.old else new).append(k)
        self.young.update((k, self.old[k]) for k in kept)
        return new

def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once per row, also where lambdas in ``body`` use it."""
    return F.transform(F.array(value), body)[0]


def text_or_empty(name: str = "text") -> Column:
    """The column, with nulls as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    """Words in order; an empty array for a text without words."""
    bare = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACES))


def word_count(text: Column) -> Column:
    """Number of words as a long."""
    return F.size(words_of(text)).cast("long")


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the shared folder and read it back: worked out once, safe when executors are lost."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
