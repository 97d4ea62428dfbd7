"""Shapes of the data: validation at plan time, positions, and missing values as NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEQ = "trade_seq"
OPTIONAL = {"mfe": "double", "mae": "double", "bars_held": "int", "prob": "double", "entry_date": "timestamp", "exit_date": "timestamp"}
OHLC = ("open", "high", "low", "close")


def clean(c: Column | str) -> Column:
    """A double whose NaN is NULL: Spark would compare NaN as the largest number."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c.cast("double")), c.cast("double"))


def finite(c: Column | str) -> Column:
    """A double whose NaN and infinities are NULL."""
    c = clean(c)
    return F.when(F.abs(c) < float("inf"), c)


def with_seq(df: DataFrame, order: list[str] | None = None, name: str = SEQ, by: list[str] | None = None) -> DataFrame:
    """``df`` with a position from 0: an existing one stays; else by the ``order`` columns, within ``by`` if given.

    Frames have no row order here, so order has to be named; without it the reading order of the files counts.
    """
    if name in df.columns:
        return df
    if not order:
        return df.withColumn(name, F.monotonically_increasing_id())
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*(by or [])).orderBy(*order)) - 1).cast("bigint"))


def trade_log(df: DataFrame) -> DataFrame:
    """``df`` checked as a trade log: ``r`` must be there; known optional columns get their types, others stay."""
    if "r" not in df.columns:
        raise ValueError(f"a trade log needs a column 'r' (result in R); found {sorted(df.columns)}: rename yours with from_frame(df, r_col=...)")
    casts = {"r": "double"} | {c: t for c, t in OPTIONAL.items() if c in df.columns}
    return with_seq(df.withColumns({c: F.col(c).cast(t) for c, t in casts.items()}))


def from_frame(df: DataFrame, *, r_col: str | None = None, mapping: dict[str, str] | None = None) -> DataFrame:
    """A trade log from a frame with other names; ``r_col`` counts only if the mapping names no ``r`` itself."""
    names = dict(mapping or {})
    if r_col and "r" not in names.values():
        names[r_col] = "r"
    return trade_log(df.withColumnsRenamed(names))


def from_arrays(spark, r, **columns) -> DataFrame:
    """A trade log from sequences on the driver, in their order; only those given become columns."""
    given = {"r": [float(x) for x in r]} | {k: list(v) for k, v in columns.items() if v is not None}
    if unknown := set(given) - {"r", *OPTIONAL}:
        raise ValueError(f"not columns of a trade log: {sorted(unknown)}")
    types = {"double": T.DoubleType(), "int": T.IntegerType(), "timestamp": T.TimestampType()}
    fields = [T.StructField(SEQ, T.LongType())] + [T.StructField(c, T.DoubleType() if c == "r" else types[OPTIONAL[c]]) for c in given]
    return spark.createDataFrame([(i, *row) for i, row in enumerate(zip(*given.values(), strict=True))], T.StructType(fields))


def column(df: DataFrame, name: str) -> Column | None:
    """The column, or None where an optional one is missing."""
    return F.col(name) if name in df.columns else None


def ohlc(df: DataFrame) -> DataFrame:
    """``df`` checked as a price frame: symbol, bar_seq, open, high, low, close."""
    if missing := [c for c in OHLC if c not in df.columns]:
        raise ValueError(f"a price frame needs columns {list(OHLC)}; missing {missing}")
    if "symbol" not in df.columns:
        df = df.withColumn("symbol", F.lit(""))
    return df.withColumns({c: F.col(c).cast("double") for c in OHLC})
