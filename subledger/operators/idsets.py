"""Exact sets of integer ids as bitmaps, for distinct counts that merge.

An id lies in the word ``id >> 6`` at bit ``id & 63``.  A set is one row per word
that holds any of its ids, so a table of sets is built by one ``bit_or`` aggregation
with map-side combine: what is shuffled are words, never ids.  Dense ids (contract
numbers) take two bits each, words included; ids that are far apart take one
word each, 16 bytes, so sparse ids cost at most twice what shuffling them would.
Longer bitmaps would be smaller still for dense ids but grow with the gaps of
sparse ones.

Sets of one table share their words, so "ids that have rows of kind A and rows of
kind B" is ``A & B`` per word.  Tables of sets of different layers, extracts or days
merge by the same ``bit_or`` (:func:`merge_id_sets`), without the rows they came from.

NULL ids are in no set; negative ids count like others; an empty input has empty sets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Column that numbers the words of a table of sets.
WORD = "__word"
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _word_and_bit(df: DataFrame, key: str) -> tuple[Column, Column]:
    """Number of the word that holds an id, and the word with only that id's bit."""
    dtype = df.select(key).schema[0].dataType
    if not isinstance(dtype, _INTEGRAL):
        raise TypeError(f"id sets need integers, {key} is {dtype.simpleString()}")
    k = F.col(key).cast("long")
    # called by name since the length of the shift is a column
    return F.shiftright(k, 6), F.call_function("shiftleft", F.lit(1).cast("long"), k.bitwiseAND(F.lit(63).cast("long")).cast("int"))


def id_sets(df: DataFrame, key: str, sets: Mapping[str, Column | None], by: Sequence[Column] = ()) -> DataFrame:
    """(by..., word, one bitmap per name): the ids of ``key`` with any row that meets the name's condition.

    A condition of ``None`` takes every row; one that is NULL counts as not met.
    """
    word, bit = _word_and_bit(df, key)
    words = [F.bit_or(bit if cond is None else F.when(cond, bit).otherwise(F.lit(0).cast("long"))).alias(name) for name, cond in sets.items()]
    return df.where(F.col(key).isNotNull()).groupBy(*by, word.alias(WORD)).agg(*words)


def merge_id_sets(first: DataFrame, *others: DataFrame, names: Sequence[str]) -> DataFrame:
    """The unions, name by name, of tables of sets with the same columns."""
    for other in others:
        first = first.unionByName(other)
    by = [c for c in first.columns if c not in names]
    return first.groupBy(*by).agg(*[F.bit_or(n).alias(n) for n in names])


def count_ids(sets: DataFrame, counts: Mapping[str, Column | str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., counts): number of ids of each bitmap, which may combine others by ``bitwiseAND`` and the like."""
    aggs = [
        F.coalesce(F.sum(F.bit_count(F.col(c) if isinstance(c, str) else c)), F.lit(0)).cast("long").alias(name)
        for name, c in counts.items()
    ]
    return sets.groupBy(*by).agg(*aggs) if by else sets.agg(*aggs)


def distinct_ids(df: DataFrame, key: str, out: str, by: Column | None = None) -> DataFrame:
    """``count(DISTINCT key)`` as ``out``, over all rows or for each value of ``by`` (a named column)."""
    if by is None:
        return count_ids(id_sets(df, key, {"__ids": None}), {out: "__ids"})
    # NULL ids stay, as a word without ids: a group of nothing else counts 0
    word, bit = _word_and_bit(df, key)
    name = df.select(by).columns[0]
    sets = df.groupBy(by.alias("__by"), word.alias(WORD)).agg(F.bit_or(bit).alias("__ids"))
    return count_ids(sets, {out: "__ids"}, by=["__by"]).withColumnRenamed("__by", name)
