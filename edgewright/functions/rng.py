"""A counter-based random generator: the same numbers whatever the partitioning, and in any SQL engine with md5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def u52(*key: Column | int | str) -> Column:
    """A whole number from 0 to 2**52 - 1 for a key."""
    parts = [(k if isinstance(k, Column) else F.lit(k)).cast("string") for k in key]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("bigint")


def index(n: Column, *key: Column | int | str) -> Column:
    """A whole number from 0 to n - 1."""
    return u52(*key) % n


def sign(*key: Column | int | str) -> Column:
    """1 or -1."""
    return F.when(u52(*key) % 2 == 0, 1.0).otherwise(-1.0)


def uniform(*key: Column | int | str) -> Column:
    """A double in [0, 1)."""
    return u52(*key) / F.lit(float(2**52))


#: Rounds of a permutation, and times that it is applied until the result is in range; each misses with at most one chance
#: in the square root of the range, and never more often than that root itself.
ROUNDS, WALKS = 4, 16


def permuted(x: Column, m: Column, *key: Column | int | str) -> Column:
    """Where a random permutation of 0 to m - 1 puts ``x``: so the first k of it are k different random numbers, at the cost
    of k. A number is a place in a grid of about m cells; rounds shift its row by a random function of its column and its
    column by one of its row, and what falls outside the m cells goes on."""
    a = F.ceil(F.sqrt(m.cast("double"))).cast("bigint")
    b = F.ceil(m / a).cast("bigint")

    def round_(s: Column, j: Column) -> Column:
        column = s % b
        row = ((s - column) / b).cast("bigint")
        return F.when(j % 2 == 1, (row + u52(*key, j, column)) % a * b + column).otherwise(row * b + (column + u52(*key, j, row)) % b)

    once = lambda s: F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), s, round_)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS - 1)), once(x.cast("bigint")), lambda s, i: F.when(s >= m, once(s)).otherwise(s))
    return F.when(walked < m, walked).otherwise(F.raise_error(F.lit("a permutation did not come back into its range")).cast("bigint"))
