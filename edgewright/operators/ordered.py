"""Running sums, extremes, positions and ranks in two levels: no group, nor a whole table, is one task's window.

Rows are dealt into ranges of (group, order), so a long group is many ranges; each range runs by itself, and a table of
one row for each group and range carries what came before. Ties of the first order column part by the others. Where the
largest group has at most ``WINDOW_ROWS`` rows, which is counted first, a window of that size does the same in one step.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgewright.tables import written

#: Rows of a group that one task may put in order.
WINDOW_ROWS = 250_000
_UP_TO = (Window.unboundedPreceding, Window.currentRow)
_PART = "_part"


def joined(df: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join where null keys meet; the keys come once. Without keys ``other`` is one row."""
    if not keys:
        return df.join(F.broadcast(other), how="cross" if how == "inner" else how)
    renamed = other.withColumnsRenamed({k: f"_on_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_on_{k}")) for k in keys]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    return df.join(renamed, condition, how).drop(*(f"_on_{k}" for k in keys))


def small(df: DataFrame, by: list[str]) -> bool:
    """Whether no group has more rows than one task may put in order."""
    return ((df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0) if by else df.count()) <= WINDOW_ROWS


def running(df: DataFrame, by: list[str], order: list[str], sums: dict[str, Column], *, high: dict[str, str] | None = None, low: dict[str, str] | None = None) -> DataFrame:
    """``df`` with running sums (name to what adds up; null adds nothing) in the order of each group's rows, and the highest
    or lowest value so far (name to the sum it watches) of such sums. ``order`` must tell a group's rows apart."""
    high, low = high or {}, low or {}
    kept = [c for c in df.columns if c not in (*sums, *high, *low)]
    if small(df, by):
        whole = Window.partitionBy(*by).orderBy(*order).rowsBetween(*_UP_TO)
        one = df.select(*(F.col(f"`{c}`") for c in kept), *(F.sum(F.coalesce(c.cast("double"), F.lit(0.0))).over(whole).alias(n) for n, c in sums.items()))
        return one.select("*", *(F.max(of).over(whole).alias(n) for n, of in high.items()), *(F.min(of).over(whole).alias(n) for n, of in low.items()))
    ranged = written(df.withColumns({f"_v_{n}": F.coalesce(c.cast("double"), F.lit(0.0)) for n, c in sums.items()}).repartitionByRange(*by, *order).withColumn(_PART, F.spark_partition_id()), "ranged")
    inside = Window.partitionBy(*by, _PART).orderBy(*order).rowsBetween(*_UP_TO)
    own = ranged.withColumns({f"_s_{n}": F.sum(f"_v_{n}").over(inside) for n in sums})
    own = own.withColumns({f"_h_{n}": F.max(f"_s_{of}").over(inside) for n, of in high.items()} | {f"_l_{n}": F.min(f"_s_{of}").over(inside) for n, of in low.items()}) if high or low else own
    keys = [*by, _PART]
    tops = [F.max(f"_h_{n}").alias(f"_top_{n}") for n in high] + [F.min(f"_l_{n}").alias(f"_top_{n}") for n in low]
    ends = ranged.groupBy(*keys).agg(*(F.sum(f"_v_{n}").alias(f"_all_{n}") for n in sums))
    if tops:
        ends = joined(ends, own.groupBy(*keys).agg(*tops), keys)
    before = Window.partitionBy(*by).orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumns({f"_off_{n}": F.coalesce(F.sum(f"_all_{n}").over(before), F.lit(0.0)) for n in sums})
    ends = ends.withColumns({f"_far_{n}": F.max(F.col(f"_top_{n}") + F.col(f"_off_{of}")).over(before) for n, of in high.items()} | {f"_far_{n}": F.min(F.col(f"_top_{n}") + F.col(f"_off_{of}")).over(before) for n, of in low.items()}) if tops else ends
    both = joined(own, ends.select(*keys, *(f"_off_{n}" for n in sums), *(f"_far_{n}" for n in (*high, *low))), keys)
    out = {n: F.col(f"_s_{n}") + F.col(f"_off_{n}") for n in sums}
    out |= {n: F.greatest(F.col(f"_far_{n}"), F.col(f"_h_{n}") + F.col(f"_off_{of}")) for n, of in high.items()}
    out |= {n: F.least(F.col(f"_far_{n}"), F.col(f"_l_{n}") + F.col(f"_off_{of}")) for n, of in low.items()}
    return both.select(*(F.col(f"`{c}`") for c in kept), *(c.alias(n) for n, c in out.items()))


def placed(df: DataFrame, by: list[str], order: list[str], name: str = "_i") -> DataFrame:
    """``df`` with each row's place in its group's order, from 0."""
    return running(df, by, order, {name: F.lit(1)}).withColumn(name, (F.col(name) - 1).cast("bigint"))


def value_ranks(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """(by, value, name): the average rank of each distinct value in its group. Equal values are counted before anything
    is put in order, so ties are one row, however many they are."""
    counted = df.groupBy(*by, value).agg(F.count("*").alias("_k"))
    ran = running(counted, by, [value], {"_upto": F.col("_k")})
    return ran.select(*by, value, (F.col("_upto") - (F.col("_k") - 1) / 2).alias(name))


def average_rank(value: str, by: list[str]) -> Column:
    """The same as a window over a group, for groups that are ``small``."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(w.partitionBy(*by, value)) - 1) / 2


#: Parts that the rows of one frequent value are dealt into, bounds of a group at most, and how well they are placed.
SALTS, MOST_BOUNDS, ACCURACY = 32, 5000, 10_000


def bucketed(rows: DataFrame, by: list[str], values: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows in buckets of their groups' values, so that a group in order is many tasks: the groups (by, _c), the rows (_c and
    all columns, and for each value its bucket _k_value), and how many rows of a group are in a bucket and before it (_c,
    _value, _k, _in, _before).

    Bounds are approximate quantiles, and any bounds give the same ranks. A value that is a bound has a bucket of its own,
    which is odd, and nothing in it to be put in order; a value that more rows have than a bucket holds is one."""
    width = max(1, WINDOW_ROWS // 2)
    groups = written(rows.groupBy(*by).agg(F.count("*").alias("_n")).withColumn("_c", F.monotonically_increasing_id()), "groups")
    most = math.ceil((groups.agg(F.max("_n")).first()[0] or 0) / width)
    bounds = min(most, MOST_BOUNDS) - 1
    inside = groups
    if bounds > 0:
        shares = [(i + 1) / (bounds + 1) for i in range(bounds)]
        large = joined(rows, groups.where(F.col("_n") > width), by)
        found = large.groupBy("_c").agg(*(F.percentile_approx(v, shares, ACCURACY).alias(f"_q_{v}") for v in values))
        step = F.greatest(F.lit(1), F.floor((bounds + 1) * width / F.col("_n"))).cast("int")  # shorter groups need fewer
        found = groups.join(found, "_c", "left").withColumn("_step", step)
        inside = written(found.select(*groups.columns, *(F.array_sort(F.array_distinct(F.filter(f"_q_{v}", lambda x, i: i % F.col("_step") == 0))).alias(f"_q_{v}") for v in values)), "bounds")
    halves = F.array(*(F.lit(1 << i) for i in reversed(range(max(1, bounds).bit_length()))))

    def bucket(v: str) -> Column:
        """Twice the bounds below a value, found by halves, and one more if it is one."""
        if bounds <= 0:
            return F.lit(0)
        at = F.col(f"_q_{v}")
        below = F.aggregate(halves, F.lit(0), lambda low, s: F.when(F.get(at, low + s - 1) < F.col(v), low + s).otherwise(low))
        return F.when(at.isNull(), 0).otherwise(2 * below + F.when(F.get(at, below) == F.col(v), 1).otherwise(0))

    others = [c for c in rows.columns if c not in by]
    dealt = joined(rows, inside, by).select("_c", *others, *(bucket(v).cast("int").alias(f"_k_{v}") for v in values))
    each = dealt.select("_c", F.explode(F.array(*(F.struct(F.lit(v).alias("_value"), F.col(f"_k_{v}").alias("_k")) for v in values))).alias("x"))
    before = Window.partitionBy("_c", "_value").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    counts = each.groupBy("_c", "x._value", "x._k").agg(F.count("*").alias("_in"))
    return groups, dealt, written(counts.withColumn("_before", F.coalesce(F.sum("_in").over(before), F.lit(0))), "buckets")


def bucket_ranks(dealt: DataFrame, counts: DataFrame, value: str, name: str, keep: list[str]) -> DataFrame:
    """(_c, keep, name): the average rank of ``value`` in its group, of rows and counts that ``bucketed`` made. One shuffle
    of the rows; those of a value that is a bound are dealt over parts, as their counts are all they need."""
    k = F.col(f"_k_{value}")
    salt = F.when(k % 2 == 1, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(0)
    parts = dealt.select("_c", (k * SALTS + salt).cast("int").alias(_PART), value, *(c for c in keep if c != value))
    own = Window.partitionBy("_c", _PART)
    inside = F.rank().over(own.orderBy(value)) + (F.count(F.lit(1)).over(own.partitionBy("_c", _PART, value)) - 1) / 2
    ranked = parts.select("_c", *keep, F.floor(F.col(_PART) / SALTS).cast("int").alias("_k"), inside.alias("_inside"))
    ranked = ranked.join(counts.where(F.col("_value") == value).drop("_value"), ["_c", "_k"])
    return ranked.select("_c", *keep, (F.col("_before") + F.when(F.col("_k") % 2 == 1, (F.col("_in") + 1) / 2).otherwise(F.col("_inside"))).alias(name))
