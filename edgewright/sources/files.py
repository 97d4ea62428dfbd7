"""Readers and writers: trade logs from vendor CSV, price frames, records as JSON, pages as HTML."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from edgewright.schema import from_frame, ohlc, with_seq


def read_vendor_csv(spark: SparkSession, path: str, *, return_col: str, risk: float, mapping: dict[str, str] | None = None, schema: str | None = None) -> DataFrame:
    """A trade log from a CSV with results in percent: ``risk`` is one R in percent; ``mapping`` renames other columns."""
    raw = spark.read.csv(path, header=True, schema=schema)
    r = F.try_divide(F.regexp_replace(F.col(return_col).cast("string"), r"[%\s]", "").try_cast("double"), F.lit(float(risk)))
    return from_frame(raw.withColumn("r", r).drop(return_col) if return_col != "r" else raw.withColumn("r", r), mapping=mapping)


def read_prices(spark: SparkSession, path: str, fmt: str = "parquet", symbol: str = "symbol", time: str = "ts", **options) -> DataFrame:
    """A price frame with bar positions by time; header names in any case, rows without prices left out."""
    raw = spark.read.format(fmt).options(**options).load(path)
    named = ohlc(raw.withColumnsRenamed({c: c.lower() for c in raw.columns}).dropna(subset=[c for c in raw.columns if c.lower() in ("open", "high", "low", "close")]))
    return with_seq(named, [time], "bar_seq", [symbol])


def to_json(df: DataFrame) -> DataFrame:
    """(json) of each row."""
    return df.select(F.to_json(F.struct("*")).alias("json"))


def write_page(text: str, path: str | None = None) -> str:
    """The document, also written to a file of the driver if a path is given."""
    if path:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(text, encoding="utf-8")
    return text


def small(df: DataFrame, most: int = 10_000) -> list:
    """The rows of a panel's table, which has to be small."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a panel of more than {most} rows; aggregate first")
    return rows


Renderer = Callable[[DataFrame], str]
