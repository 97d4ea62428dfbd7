"""Helpers that the training-text operators share."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space of the word pattern ``[^\x20\x09-\x0D]+``; ``bytes.split()`` splits at just these.
WHITE = " \t\n\x0b\x0c\r"
#: The same pattern for Spark's and DuckDB's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    lean(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one only where that is unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = getattr(spark.sparkContext, "_edgewright_dir", None) or tempfile.mkdtemp(prefix="edgewright-")
        spark.sparkContext._edgewright_dir = found
    return found


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def stored(df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
    """``df`` written once to the shared folder, in folders by the column ``by`` if given, and read again: it cuts the
    lineage and outlives lost executors. It goes when the application ends, if nothing drops it before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/edgewright/{tag}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    passing(spark, path)
    found = spark.read.schema(df.schema).parquet(path)
    found._stored = path
    _tables.append(path)
    return found


def passing(spark: SparkSession, path: str) -> None:
    """What is written to ``path`` goes when the application ends."""
    files, place = _place(spark, path)
    files.deleteOnExit(place)


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder that this application has written."""
    files, place = _place(spark, path)
    files.delete(place, True)


#: Tables that ``stored`` has written and nothing has dropped yet.
_tables: list[str] = []


def dropped(*tables: DataFrame | str | None) -> None:
    """Delete tables that ``stored`` has written and nothing needs any more; others stay."""
    spark = SparkSession.getActiveSession()
    for found in tables:
        path = found if isinstance(found, str) else getattr(found, "_stored", None)
        if path in _tables:
            _tables.remove(path)
            removed(spark, path)


@contextlib.contextmanager
def scratch(keep: Callable[[], DataFrame | None]) -> Iterator[None]:
    """What is stored inside goes at the end, however it ends, but for what ``keep`` returns then."""
    before = {*_tables}
    try:
        yield
    finally:
        kept = getattr(keep(), "_stored", None)
        dropped(*(path for path in [*_tables] if path not in before and path != kept))


def lean(spark: SparkSession) -> None:
    """Few rows in each batch that Parquet readers and Python workers get, as texts may be long: thousands of them are
    arrays of tens of MB. Batches for workers are bounded by bytes too. Numbers that the session's owner chose stay."""
    for name, usual, fewer in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"),
        ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4800000"),
        ("spark.sql.parquet.columnarReaderBatchSize", "4096", "512"),
    ):
        if spark.conf.get(name, usual) == usual:
            spark.conf.set(name, fewer)


def parts(batch: pa.RecordBatch, rows: int, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of at most ``rows`` rows and about ``most`` bytes of text; a longer text has its own."""
    weight = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_binary(column.type) or pa.types.is_string(column.type):
            weight += np.diff(np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset))
    begin = held = 0
    for i, n in enumerate(weight.tolist()):
        if i > begin and (i - begin == rows or held + n > most):
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if begin < batch.num_rows:
        yield batch.slice(begin)


def arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, rows: int = 512) -> DataFrame:
    """``fn`` on each ``rows`` rows of ``df`` as an Arrow batch; fewer where texts are long."""
    lean(df.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun(fn.__module__)
        for batch in batches:
            for part in parts(batch, rows):
                yield fn(part)
        released()

    return df.mapInArrow(each, schema)


def split_words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of the texts (binary; null: none), the place among these of each word in order, and how many words
    each text has; ``lower``: with ASCII capitals lowered."""
    text = pc.ascii_trim_whitespace(pc.fill_null(texts, b"").view(pa.string()))
    lists = pc.ascii_split_whitespace(pc.ascii_lower(text) if lower else text)
    flat = lists.flatten()
    empty = pc.equal(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
    if empty.any():
        flat = flat.filter(pc.not_equal(flat, ""))
    coded = flat.dictionary_encode()
    return coded.dictionary.view(pa.binary()), coded.indices.to_numpy(), np.where(empty, 0, pc.list_value_length(lists).to_numpy())


def gathered(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Array]:
    """The first column of a task's batches, about ``size`` bytes at a time."""
    held, total = [], 0
    for batch in batches:
        held.append(batch.column(0))
        total += batch.column(0).nbytes
        if total >= size:
            yield pa.concat_arrays(held)
            held, total = [], 0
    if sum(map(len, held)):
        yield pa.concat_arrays(held)


def most_frequent(counted: DataFrame, n: str, most: int) -> DataFrame:
    """The rows of ``counted`` with the largest ``n``, at most ``most``: all at or above a step of its logarithm.

    Only the number of rows at each step comes to the driver, so the task count does not matter as in a limit.
    """
    step = F.floor(16 * F.log2(F.col(n).cast("double")))
    total, least = 0, None
    for r in sorted(counted.groupBy(step.alias("step")).agg(F.count("*").alias("rows")).collect(), reverse=True):
        if (total := total + r["rows"]) > most:
            break
        least = r.step
    return counted.where(step >= least if least is not None else F.lit(False))


def crc_mod(column: str, n: int):
    """crc32 of the column as text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


#: A memo keeps no longer key.
LONG = 64
_memos: list[weakref.ref] = []
_loaded: list[tuple[str, Callable]] = []
_owner = ""


class Memo(dict):
    """A dict that fills itself by ``make``; beyond ``most`` entries (``trim`` between batches) it starts anew from the
    last ones, of which those that are asked for again stay.

    Keys longer than ``LONG`` are made each time and not kept, so its size is bounded. Python workers outlive tasks and
    a query's stages: what is cheap to make (``brief``) goes when a task ends, and what an operator (``owner``) has
    kept goes when another one begins.
    """

    def __init__(self, make: Callable, most: int = 150_000, owner: str = "", brief: bool = False):
        super().__init__()
        self.make, self.most, self.owner, self.brief, self.last = make, most, owner, brief, {}
        _memos.append(weakref.ref(self))

    def __missing__(self, key):
        value = self.last.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONG:
            self[key] = value
        return value

    def trim(self) -> None:
        if len(self) > self.most:
            self.last = self.copy()
            self.clear()

    def forget(self) -> None:
        self.clear()
        self.last = {}


def begun(owner: str) -> None:
    """Called where an operator's work begins in a worker: empties what the others have kept."""
    global _owner
    if owner != _owner:
        _owner = owner
        for memo in [m for ref in _memos if (m := ref()) is not None and m.owner != owner]:
            memo.forget()
        for other, forget in _loaded:
            if other != owner:
                forget()
        released()


def released() -> None:
    """Called where a task's work ends in a worker: what is free goes back to the system, as idle workers stay."""
    for memo in [m for ref in _memos if (m := ref()) is not None and m.brief]:
        memo.forget()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def loaded_once(most: int) -> Callable:
    """As ``lru_cache``, for what workers load; it goes, as memos do, when another operator begins."""

    def wrap(fn: Callable) -> Callable:
        found = functools.lru_cache(most)(fn)
        _loaded.append((fn.__module__, found.cache_clear))
        return found

    return wrap


def unused(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it until ``df`` has no such column."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name
