"""Tests that price a search: sign permutations, corrections for many variants, and the ledger of what was tried."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgewright.functions import rng
from edgewright.operators import resample
from edgewright.operators.ordered import placed
from edgewright.operators.resample import book
from edgewright.schema import SEQ, clean

N_PERM, SEED = 5000, 42
#: Rows of a book whose signs are drawn from one array that every task gets; the rows of a longer one draw their own.
SIGNED_BOOK = 100_000


def sign_permutation(trades: DataFrame, *, n_perm: int = N_PERM, seed: int = SEED) -> DataFrame:
    """(n, observed, p_value): how often random signs do as well as the signs observed."""
    if trades.count() <= min(SIGNED_BOOK, resample.LARGEST_BOOK):
        books = book(trades).select("n", "rs", F.when(F.col("n") > 0, F.aggregate("rs", F.lit(0.0), lambda a, x: a + x) / F.col("n")).alias("observed"))
        each = trades.sparkSession.range(n_perm).withColumnRenamed("id", "draw").join(F.broadcast(books.where("n > 0")))
        means = each.select("draw", (F.aggregate(F.transform("rs", lambda x, i: F.abs(x) * rng.sign(seed, F.col("draw"), i)), F.lit(0.0), lambda a, x: a + x) / F.col("n")).alias("mean"))
    else:  # each row takes its own signs, and tasks add up by draw before anything is shuffled
        rows = placed(trades.select(SEQ, clean("r").alias("r")).where("r is not null"), [], [SEQ], "i")
        books = rows.agg(F.count("*").alias("n"), F.avg("r").alias("observed"))
        each = rows.select("i", "r", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_perm - 1).cast("bigint"))).alias("draw"))
        means = each.groupBy("draw").agg(F.avg(F.abs("r") * rng.sign(seed, F.col("draw"), F.col("i"))).alias("mean"))
    hits = means.join(F.broadcast(books.select("observed"))).agg(F.sum((F.col("mean") >= F.col("observed") - 1e-12).cast("int")).alias("hits"))
    return books.join(F.broadcast(hits)).select("n", "observed", F.coalesce((F.col("hits") + 1) / F.lit(n_perm + 1), F.lit(1.0)).alias("p_value"))


def variant_count(x) -> int:
    """A number of variants, or that of a ledger's session."""
    return int(x.session_n_variants if hasattr(x, "session_n_variants") else x)


def sidak(p: float, n: int) -> float:
    """The chance that the best of n such tests does as well."""
    if n < 1:
        raise ValueError(f"the number of variants must be at least 1, not {n}")
    return 1 - (1 - min(max(p, 0.0), 1.0)) ** n


def _best_means(kept: DataFrame, variants: DataFrame, scale: str | None, n_perm: int, seed: int) -> DataFrame:
    """(draw, best): the largest mean (over ``scale``) of any variant under independent random signs.

    Series that are few rows together are sent to every task as arrays; beyond that each row takes its own signs, and
    tasks add up by variant and draw before anything is shuffled."""
    keys = ["variant", "variant_ord", *([scale] if scale else [])]
    rows = variants.join(kept, "variant")
    if rows.count() <= resample.LARGEST_BOOK:
        books = rows.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("obs_seq", "r"))), lambda x: F.abs(x["r"])).alias("rs"))
        each = variants.sparkSession.range(n_perm).withColumnRenamed("id", "draw").join(F.broadcast(books))
        mean = F.aggregate(F.transform("rs", lambda x, i: x * rng.sign(seed, F.col("draw"), F.col("variant_ord"), i)), F.lit(0.0), lambda a, x: a + x) / F.size("rs")
        means = each.select("draw", (mean / F.col(scale) if scale else mean).alias("m"))
    else:
        each = placed(rows, keys, ["obs_seq"], "i").select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_perm - 1).cast("bigint"))).alias("draw"))
        mean = F.avg(F.abs("r") * rng.sign(seed, F.col("draw"), F.col("variant_ord"), F.col("i")))
        means = each.groupBy(*keys, "draw").agg((mean / F.col(scale) if scale else mean).alias("m"))
    return means.groupBy("draw").agg(F.max("m").alias("best"))


def _cleaned(variants: DataFrame) -> DataFrame:
    return variants.select("variant", "variant_ord", "obs_seq", clean("r").alias("r")).where("r is not null")


def whites_reality_check(variants: DataFrame, *, n_perm: int = N_PERM, seed: int = SEED) -> DataFrame:
    """(best_variant, best_mean, p_value, n_variants) of (variant, variant_ord, obs_seq, r); ties go to the first listed."""
    rows = _cleaned(variants)
    means = rows.groupBy("variant", "variant_ord").agg(F.avg("r").alias("mean"))
    best = means.agg(F.max(F.struct("mean", (-F.col("variant_ord")).alias("o"), "variant")).alias("b"), F.count("*").alias("n")).select(F.col("b.variant").alias("best_variant"), F.col("b.mean").alias("best_mean"), F.col("n").alias("n_variants"))
    null = _best_means(means.select("variant"), rows, None, n_perm, seed)
    hits = null.join(F.broadcast(best)).agg(F.sum((F.col("best") >= F.col("best_mean") - 1e-12).cast("int")).alias("hits"))
    return best.join(F.broadcast(hits)).select("best_variant", "best_mean", F.coalesce((F.col("hits") + 1) / F.lit(n_perm + 1), F.lit(1.0)).alias("p_value"), "n_variants")


def spa_test(variants: DataFrame, *, n_perm: int = N_PERM, seed: int = SEED) -> DataFrame:
    """The same on means over standard errors, after hopeless variants are left out before any permutation."""
    rows = _cleaned(variants)
    n = F.col("n").cast("double")
    stats = rows.groupBy("variant", "variant_ord").agg(F.count("*").alias("n"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"))
    stats = stats.where("n >= 2 and sd > 0").withColumn("se", F.col("sd") / F.sqrt(n)).withColumn("t", F.col("mean") / F.col("se"))
    floor = -F.sqrt(2 * F.log(F.log(F.greatest(n, F.lit(3.0)))))
    marked = stats.withColumn("kept", F.col("t") >= floor)
    total = marked.agg(F.count("*").alias("n_variants"), F.sum(F.col("kept").cast("int")).cast("bigint").alias("n_kept"))
    best = marked.where("kept").agg(F.max(F.struct("t", (-F.col("variant_ord")).alias("o"), "variant")).alias("b")).select(F.col("b.variant").alias("best_variant"), F.col("b.t").alias("best_t"))
    null = _best_means(marked.where("kept").select("variant", "se"), rows, "se", n_perm, seed)
    hits = null.join(F.broadcast(best)).agg(F.sum((F.col("best") >= F.col("best_t") - 1e-12).cast("int")).alias("hits"))
    return best.join(F.broadcast(total)).join(F.broadcast(hits)).select("best_variant", "best_t", F.coalesce((F.col("hits") + 1) / F.lit(n_perm + 1), F.lit(1.0)).alias("p_value"), "n_variants", F.coalesce("n_kept", F.lit(0)).cast("bigint").alias("n_kept"))


STATUSES = ("tried", "discarded", "selected")
LEDGER = "scope string, ts timestamp, event string, params string, score double, status string, extra map<string,string>, session_id string, n long"


class Ledger:
    """An append-only record of what a search tried, as JSON lines that Spark writes and reads.

    A selection is an event of its own: it marks the latest entry with the same parameters and does not count as a
    further variant unless there was none.
    """

    def __init__(self, spark: SparkSession, path: str, scope: str):
        self.spark, self.path, self.scope, self.session = spark, path, scope, uuid.uuid4().hex
        self.n = 0

    def _append(self, event: str, params: dict, score: float | None, status: str, extra: dict) -> None:
        self.n += 1
        row = [(self.scope, event, json.dumps(params, sort_keys=True, default=str), None if score is None else float(score), status, {k: str(v) for k, v in extra.items()}, self.session, self.n)]
        df = self.spark.createDataFrame(row, "scope string, event string, params string, score double, status string, extra map<string,string>, session_id string, n long")
        df.withColumn("ts", F.current_timestamp()).coalesce(1).write.mode("append").json(self.path)

    def record(self, params: dict, score: float | None = None, status: str = "tried", **extra) -> None:
        if status not in STATUSES:
            raise ValueError(f"status must be one of {STATUSES}, not {status!r}")
        self._append("entry", params, score, status, extra)

    def mark_selected(self, params: dict, score: float | None = None, **extra) -> None:
        text = json.dumps(params, sort_keys=True, default=str)
        known = not self.entries().where((F.col("params") == text) & (F.col("status") != "selected")).isEmpty()
        self._append("select" if known else "entry", params, score, "selected", extra)

    def events(self) -> DataFrame:
        return self.spark.read.schema(LEDGER).json(self.path).where(F.col("scope") == self.scope)

    def entries(self) -> DataFrame:
        """Current entries: those whose parameters were selected later carry that status on the latest of them."""
        return current_entries(self.events())

    @property
    def n_variants(self) -> int:
        return self.events().where("event = 'entry'").count()

    @property
    def session_n_variants(self) -> int:
        return self.events().where((F.col("event") == "entry") & (F.col("session_id") == self.session)).count()

    def scores(self) -> DataFrame:
        return self.entries().where("score is not null").select("params", "score")

    def best(self) -> DataFrame:
        """The entry with the best score, the first on a tie; no row without scores."""
        return best_entry(self.entries())


def current_entries(events: DataFrame) -> DataFrame:
    later = events.where("event = 'select'").groupBy("params").agg(F.count("*").alias("times"))
    entries = events.where("event = 'entry'").withColumn("back", F.row_number().over(Window.partitionBy("params").orderBy(F.desc("ts"), F.desc("n"))))
    joined = entries.join(later, "params", "left")
    return joined.withColumn("status", F.when(F.col("back") <= F.coalesce("times", F.lit(0)), "selected").otherwise(F.col("status"))).drop("back", "times")


def best_entry(entries: DataFrame) -> DataFrame:
    scored = entries.where("score is not null")
    return scored.orderBy(F.desc("score"), "ts", "n").limit(1)
