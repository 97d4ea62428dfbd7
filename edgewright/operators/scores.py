"""Quality of scores and redundancy of features; effective breadth of return streams."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgewright.operators.ordered import average_rank, bucket_ranks, bucketed, joined, placed, small
from edgewright.schema import finite
from edgewright.tables import written


def correlation(a: str, b: str) -> Column:
    """Pearson's, NULL where either is constant."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def rank_correlation(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, c): Pearson's correlation of the average ranks of ``a`` and ``b`` in each group, NULL where one is constant;
    neither they nor ``by`` are missing. Rows of large groups are shuffled twice, by buckets of one value and then of the
    other, with the rank that they have; a value that most rows have doesn't gather them (``bucketed``). Average ranks have
    the mean (n + 1) / 2, so one pass adds up all there is."""
    keys = by
    if small(rows, by):
        cells = rows.select(*by, F.lit(1).alias("k"), average_rank("a", by).alias("ra"), average_rank("b", by).alias("rb"))
    else:
        groups, dealt, counts = bucketed(rows.select(*by, "a", "b"), by, ["a", "b"])
        first = bucket_ranks(dealt, counts, "a", "ra", ["b", "_k_b"])
        cells = bucket_ranks(first, counts, "b", "rb", ["ra"]).withColumn("k", F.lit(1))
        keys = ["_c"]
    k, a, b = F.col("k"), (2 * F.col("ra")).cast("bigint"), (2 * F.col("rb")).cast("bigint")  # twice a rank is whole, and so are exact sums
    total = lambda x: (F.sum(F.shiftright(x, 32)) * float(2**32) + F.sum(x.bitwiseAND(F.lit(2**32 - 1)))) / 4
    sums = cells.groupBy(*keys).agg(F.sum(k).alias("n"), total(k * a * b).alias("ab"), total(k * a * a).alias("aa"), total(k * b * b).alias("bb"))
    if keys != by:
        sums = sums.join(groups, "_c")
    mean = F.col("n") * F.pow((F.col("n") + 1) / 2, F.lit(2.0))
    ab, aa, bb = (F.col(c) - mean for c in ("ab", "aa", "bb"))
    varied = (aa > 1e-12 * mean) & (bb > 1e-12 * mean)
    return sums.select(*by, "n", F.when(varied, ab / F.sqrt(aa * bb)).alias("c"))


def information_coefficient(preds: DataFrame, *, score: str = "score", label: str = "label", by: list[str] | None = None) -> DataFrame:
    """(n, ic): the correlation of average ranks; 0 for a missing column, under 5 rows or a constant side."""
    by = by or []
    if not {score, label} <= set(preds.columns):
        return preds.groupBy(*by).agg(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("ic"))
    rows = preds.select(*by, finite(score).alias("a"), finite(label).alias("b")).where("a is not null and b is not null")
    for c in by:  # a null group is a group
        rows = rows.withColumn(f"_{c}", F.struct(c)).drop(c)
    found = rank_correlation(rows, [f"_{c}" for c in by])
    found = found.select(*(F.col(f"_{c}.{c}").alias(c) for c in by), "n", "c")
    return found.select(*by, "n", F.when(F.col("n") >= 5, F.coalesce("c", F.lit(0.0))).otherwise(0.0).alias("ic"))


def alpha_gate(ic: float, min_ic: float) -> float:
    if ic < min_ic:
        raise ValueError(f"information coefficient {ic:.4f} is below the gate of {min_ic:.4f}")
    return ic


def quantile_decay(preds: DataFrame, q: int = 5, *, score: str = "score", label: str = "label", order: str = "row_seq") -> DataFrame:
    """(bucket, win_rate, avg_score, n) of equal counts by score, ties by position; buckets from 1, low to high. Fewer
    rows than buckets are an error."""
    if missing := [c for c in (score, label) if c not in preds.columns]:
        raise ValueError(f"missing columns: {missing}")
    rows = preds.select(finite(score).alias("score"), finite(label).alias("label"), order).where("score is not null and label is not null")
    if rows.limit(q).count() < q:
        raise ValueError(f"{q} buckets need {q} rows with both score and label")
    ranked = placed(rows, [], ["score", order], "i").join(F.broadcast(rows.agg(F.count("*").alias("n"))))
    bucket = F.greatest(F.lit(1), F.ceil(F.col("i") * q / F.greatest(F.col("n") - 1, F.lit(1)))).cast("int")
    return ranked.groupBy(bucket.alias("bucket")).agg(F.avg((F.col("label") > 0).cast("double")).alias("win_rate"), F.avg("score").alias("avg_score"), F.count("*").alias("n"))


def decay_summary(table: DataFrame) -> DataFrame:
    """(spread, monotonic): last less first win rate, and whether it never falls."""
    before = F.lag("win_rate").over(Window.orderBy("bucket"))
    return table.withColumn("falls", F.coalesce(F.col("win_rate") < before, F.lit(False))).agg((F.max_by("win_rate", "bucket") - F.min_by("win_rate", "bucket")).alias("spread"), (~F.bool_or("falls")).alias("monotonic"))


def cramers_v(rows: DataFrame, a: str, b: str) -> DataFrame:
    """(v): association of two columns from their counts; 0 where one is constant. Empty cells count what they miss."""
    cells = rows.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null").groupBy("a", "b").agg(F.count("*").alias("o"))
    total = cells.agg(F.sum("o").alias("n"), F.countDistinct("a").alias("r"), F.countDistinct("b").alias("c"))
    left, right = cells.groupBy("a").agg(F.sum("o").alias("na")), cells.groupBy("b").agg(F.sum("o").alias("nb"))
    # chi2 = n * (sum of o^2 / (na nb) - 1): empty cells need not exist for it
    share = cells.join(left, "a").join(right, "b").agg(F.sum(F.col("o") * F.col("o") / (F.col("na") * F.col("nb"))).alias("t"))
    low = F.least("r", "c")
    return total.join(F.broadcast(share)).select(F.when((low < 2) | F.col("n").isNull(), 0.0).otherwise(F.sqrt(F.greatest(F.lit(0.0), F.col("t") - 1) / F.greatest(low - 1, F.lit(1)))).alias("v"))


def long_panel(panel: DataFrame, features: list[str], target: str, group: str, order: str) -> DataFrame:
    return panel.select(F.col(group).alias("grp"), F.col(order).alias("row_seq"), finite(target).alias("target"), *(finite(f).alias(f) for f in features)).unpivot(["grp", "row_seq", "target"], features, "feature", "value")


def folded(rows: DataFrame, group: str, order: str, n_splits: int, min_test: int, min_group: int) -> DataFrame:
    """``rows`` with ``fold``: equal runs of each group's rows, in order; groups and folds with too few rows are left out.

    A fold begins at a value of ``order``, which is found from that column alone; the rows look their fold up in a few
    bounds and stay where they are. Only if rows on both sides of a bound are tied does every row take its place."""
    sizes = rows.groupBy(group).agg(F.count("*").alias("_n")).where(F.col("_n") >= min_group)
    fold_at = lambda i: F.floor(((i + 1) * n_splits - 1) / F.col("_n")).cast("int")
    i, fold = F.col("_i"), F.col("fold")
    places = placed(rows.select(group, order), [group], [order], "_i").join(sizes, group).withColumn("fold", fold_at(i))
    first = (i == 0) | (fold_at(i - 1) != fold)
    edges = written(places.where(first | (fold_at(i + 1) != fold)).withColumn("_first", first), "edges")
    if not edges.groupBy(group, order).count().where("count > 1").isEmpty():
        rows = placed(rows, [group], [order], "_i").join(sizes, group).withColumn("fold", fold_at(i))
        sizes = rows.groupBy(group, "fold").agg(F.count("*").alias("_rows")).where(F.col("_rows") >= min_test)
        return rows.join(sizes, [group, "fold"])
    bounds = edges.where("_first").groupBy(group, "_n").agg(F.sort_array(F.collect_list(F.struct(fold, F.col(order).alias("at"), "_i"))).alias("_folds"))
    at = lambda k: F.get("_folds", F.lit(k))
    place = F.lit(0)
    for k in range(1, n_splits):
        place = F.when(at(k)["at"] <= F.col(order), k).otherwise(place)
    rows = rows.join(bounds, group).withColumn("_place", place)
    begin, end = F.get("_folds", F.col("_place")), F.get("_folds", F.col("_place") + 1)
    kept = F.coalesce(end["_i"], F.col("_n")) - begin["_i"] >= min_test
    return rows.where(kept).withColumn("fold", F.get("_folds", F.col("_place"))["fold"]).drop("_folds", "_place", "_n")


def fold_ic(panel: DataFrame, features: list[str], target: str, *, group: str, order: str, n_splits: int = 5, min_test: int = 10, min_group: int = 40) -> DataFrame:
    """(feature, mean_ic, abs_ic, std_ic, ratio, n_folds): rank correlations in folds of each group's rows, in order."""
    rows = folded(panel.where(F.col(group).isNotNull()).select(group, order, target, *features), group, order, n_splits, min_test, min_group)
    cells = rows.select(F.col(group).alias("grp"), "fold", finite(target).alias("target"), *(finite(f).alias(f) for f in features)).unpivot(["grp", "fold", "target"], features, "feature", "a")
    by = ["grp", "fold", "feature"]
    ics = rank_correlation(cells.where("a is not null and target is not null").select(*by, "a", F.col("target").alias("b")), by).select(*by, F.col("c").alias("ic")).where("ic is not null")
    found = ics.groupBy("feature").agg(F.avg("ic").alias("mean_ic"), F.abs(F.avg("ic")).alias("abs_ic"), F.stddev_pop("ic").alias("std_ic"), F.count("*").alias("n_folds"))
    return found.withColumn("ratio", F.try_divide("mean_ic", "std_ic")).orderBy(F.desc_nulls_last("abs_ic"), "feature")


def feature_kinds(panel: DataFrame, features: list[str], max_card: int = 3) -> tuple[list[str], list[str]]:
    """Features with few distinct values, and the others."""

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a task's values of each feature, one more than ``max_card`` at most: all of few, or enough to know of many."""
        seen: list[set] = [set() for _ in features]
        for batch in batches:
            for own, column in zip(seen, batch.columns, strict=True):
                if len(own) <= max_card:
                    own.update(x + 0.0 for x in column.unique().drop_null().slice(0, 2 * max_card + 2).to_pylist())
        rows = [(i, x) for i, own in enumerate(seen) for x in sorted(own)[: max_card + 1]]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.float64())], ["i", "x"])

    values = panel.select(*(finite(f).alias(f"_{i}") for i, f in enumerate(features))).mapInArrow(some, "i int, x double")
    number = {r.i: r.n for r in values.groupBy("i").agg(F.countDistinct("x").alias("n")).collect()}
    found = {f: number.get(i, 0) for i, f in enumerate(features)}
    return [f for f in features if found[f] <= max_card], [f for f in features if found[f] > max_card]


def gram(rows: DataFrame, vectors: str, width: int) -> DataFrame:
    """(i, j, n, rho) of places i < j of arrays of doubles: Pearson's correlation over the rows where both are there, NULL
    where one is constant. Tasks add up products of all pairs as matrices; what they send is one row for each pair."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        total = np.zeros((6, width, width))
        for batch in batches:
            flat = pa.compute.list_flatten(batch.column(0)).to_numpy(zero_copy_only=False).astype(float)
            x = flat.reshape(-1, width)
            there = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x)
            total += np.stack([there.T @ there, x.T @ there, there.T @ x, x.T @ x, (x * x).T @ there, there.T @ (x * x)])
        i, j = np.triu_indices(width, 1)
        names = ("n", "a", "b", "ab", "aa", "bb")
        yield pa.RecordBatch.from_arrays([pa.array(i.astype("int32")), pa.array(j.astype("int32")), *(pa.array(t[i, j]) for t in total)], names=["i", "j", *names])

    found = rows.select(vectors).mapInArrow(sums, "i int, j int, n double, a double, b double, ab double, aa double, bb double")
    found = found.groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in ("n", "a", "b", "ab", "aa", "bb")))
    spread = lambda s, ss: F.greatest(F.lit(0.0), F.col(ss) - F.col(s) * F.col(s) / F.col("n"))
    flat = (spread("a", "aa") <= 1e-12 * F.col("aa")) | (spread("b", "bb") <= 1e-12 * F.col("bb"))
    rho = (F.col("ab") - F.col("a") * F.col("b") / F.col("n")) / F.sqrt(spread("a", "aa") * spread("b", "bb"))
    return found.select("i", "j", F.col("n").cast("bigint").alias("n"), F.when((F.col("n") > 0) & ~flat, rho).alias("rho"))


def rank_vectors(panel: DataFrame, features: list[str], order: str) -> DataFrame:
    """(ranks) of every row: each feature's average rank in its column less the middle one, NULL where it is missing."""
    cells = panel.select(F.col(order).alias("_row"), *(finite(f).alias(f) for f in features)).unpivot(["_row"], features, "feature", "value").where("value is not null")
    groups, dealt, counts = bucketed(cells, ["feature"], ["value"])
    ranked = bucket_ranks(dealt, counts, "value", "rank", ["_row"])
    ranked = ranked.join(groups, "_c").select("_row", "feature", (F.col("rank") - (F.col("_n") + 1) / 2).alias("x"))
    wide = ranked.groupBy("_row").agg(*(F.max(F.when(F.col("feature") == f, F.col("x"))).alias(f"_x{i}") for i, f in enumerate(features)))
    return wide.select(F.array(*(f"_x{i}" for i in range(len(features)))).alias("ranks"))


def cramers_of_pairs(panel: DataFrame, features: list[str]) -> DataFrame:
    """(a, b, v) of all pairs of few-valued features in order, missing values as 0, from the counts of all pairs at once."""
    values = F.array(*(F.coalesce(finite(f), F.lit(0.0)) for f in features))
    last = F.lit(len(features) - 1)
    pair = lambda i, j: F.struct(i.alias("i"), j.alias("j"), F.get("x", i).alias("p"), F.get("x", j).alias("q"))
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), last - 1), lambda i: F.transform(F.sequence(i + 1, last), lambda j: pair(i, j))))
    cells = panel.select(values.alias("x")).select(F.explode(pairs).alias("c")).groupBy("c.i", "c.j", "c.p", "c.q").agg(F.count("*").alias("o"))
    left, right = cells.groupBy("i", "j", "p").agg(F.sum("o").alias("np")), cells.groupBy("i", "j", "q").agg(F.sum("o").alias("nq"))
    sums = cells.join(left, ["i", "j", "p"]).join(right, ["i", "j", "q"]).groupBy("i", "j").agg(F.sum(F.col("o") * F.col("o") / (F.col("np") * F.col("nq"))).alias("t"), F.countDistinct("p").alias("r"), F.countDistinct("q").alias("c"))
    low = F.least("r", "c")
    v = F.when(low < 2, 0.0).otherwise(F.sqrt(F.greatest(F.lit(0.0), F.col("t") - 1) / F.greatest(low - 1, F.lit(1))))
    names = F.array(*map(F.lit, features))
    return sums.select(F.get(names, "i").alias("a"), F.get(names, "j").alias("b"), v.alias("v"))


def redundancy_edges(panel: DataFrame, features: list[str], *, order: str, corr: float = 0.85, v: float = 0.80, max_card: int = 3) -> DataFrame:
    """(a, b, kind, strength) of pairs of features (a < b) that say the same: rank correlation, or Cramér's V of few-valued ones.

    Ranks are taken in each column before pairs drop their missing rows. Neither the plan nor a task grows with the pairs
    of rows; all pairs of features come from one pass each.
    """
    few, many = map(sorted, feature_kinds(panel, features, max_card))
    out = panel.sparkSession.createDataFrame([], "a string, b string, kind string, strength double")
    if len(many) > 1:
        names = F.array(*map(F.lit, many))
        pairs = gram(rank_vectors(panel, many, order), "ranks", len(many))
        out = out.union(pairs.where(F.abs("rho") >= corr).select(F.get(names, "i"), F.get(names, "j"), F.lit("rank"), F.abs("rho")))
    if len(few) > 1:
        out = out.union(cramers_of_pairs(panel, few).where(F.col("v") >= v).select("a", "b", F.lit("cramer"), "v"))
    return out


def feature_components(edges: list[tuple[str, str]]) -> list[list[str]]:
    """Groups of linked names, sorted; of features there are few, so this is the driver's."""
    near: dict[str, set[str]] = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    groups = []
    while near:
        group, edge = set(), {next(iter(near))}
        while edge:  # a wave of neighbours at a time
            group |= edge
            edge = set().union(*(near[x] for x in edge)) - group
        for x in group:
            del near[x]
        groups.append(sorted(group))
    return sorted(g for g in groups if len(g) > 1)


def droplist(panel: DataFrame, features: list[str], target: str, *, group: str, order: str, corr: float = 0.85, v: float = 0.80, **folds) -> DataFrame:
    """(component, feature, abs_ic, action): of each group of redundant features the best by IC is kept."""
    ics = {r.feature: round(r.abs_ic, 4) if r.abs_ic is not None else None for r in fold_ic(panel, features, target, group=group, order=order, **folds).collect()}
    groups = feature_components([(r.a, r.b) for r in redundancy_edges(panel, features, order=order, corr=corr, v=v).collect()])
    rows = []
    for i, names in enumerate(groups):
        best = max(names, key=lambda f: ics.get(f) if ics.get(f) is not None else -1.0)
        rows += [(i, f, ics.get(f), "KEEP" if f == best else "DROP") for f in names]
    return panel.sparkSession.createDataFrame(rows, "component int, feature string, abs_ic double, action string")


def complete_panel(panel: DataFrame, min_obs: int = 30) -> DataFrame:
    """(ts, asset, ret) without missing values, thin assets, and then dates that lack an asset."""
    rows = panel.select("ts", "asset", finite("ret").alias("ret")).where("ret is not null")
    thick = rows.groupBy("asset").count().where(F.col("count") >= min_obs).select("asset")
    rows = rows.join(thick, "asset")
    width = thick.agg(F.count("*").alias("w"))
    full = rows.groupBy("ts").agg(F.count("*").alias("k")).join(F.broadcast(width)).where("k = w").select("ts")
    return rows.join(full, "ts")


#: Assets of a panel at most, as all their pairs meet in each task and, for components, on the driver.
MOST_ASSETS = 4000


def correlations(panel: DataFrame, min_obs: int = 30) -> DataFrame:
    """(a, b, rho) of all pairs of assets, either way round and with themselves, over the complete dates. A date is one
    array of its assets' returns, so no date is joined with itself."""
    rows = written(complete_panel(panel, min_obs), "complete")
    names = sorted(r.asset for r in rows.select("asset").distinct().limit(MOST_ASSETS + 1).collect())
    if len(names) > MOST_ASSETS:
        raise ValueError(f"there are more than {MOST_ASSETS} assets with {min_obs} dates: correlate groups of them")
    dates = rows.groupBy("ts").agg(F.transform(F.sort_array(F.collect_list(F.struct("asset", "ret"))), lambda x: x["ret"]).alias("x"))
    name = F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
    pairs = gram(dates, "x", len(names)).select(F.get(name, "i").alias("a"), F.get(name, "j").alias("b"), "rho")
    own = rows.groupBy("asset").agg(F.when(F.stddev_pop("ret") > 0, 1.0).alias("rho")).select(F.col("asset").alias("a"), F.col("asset").alias("b"), "rho")
    return pairs.union(pairs.select("b", "a", "rho")).union(own)


def effective_n(panel: DataFrame, min_obs: int = 30) -> DataFrame:
    """(n_assets, n_eff, redundancy). A correlation matrix's squared entries add up to its squared eigenvalues, so none are solved for."""
    found = correlations(panel, min_obs).agg(F.countDistinct("a").alias("n_assets"), F.sum(F.col("rho") * F.col("rho")).alias("s"))
    n = F.col("n_assets").cast("double")
    return found.select("n_assets", F.try_divide(n * n, F.col("s")).alias("n_eff"), F.try_divide(F.col("s"), n).alias("redundancy"))


def principal_components(panel: DataFrame, min_obs: int = 30):
    """Eigenvalues (descending) and loadings by asset of the correlation matrix, which is small: the driver's numpy."""
    import numpy as np

    rows = correlations(panel, min_obs).collect()
    names = sorted({r.a for r in rows})
    if len(names) < 2:
        raise ValueError("at least 2 assets with complete dates are needed")
    at = {n: i for i, n in enumerate(names)}
    m = np.eye(len(names))
    for r in rows:
        m[at[r.a], at[r.b]] = r.rho if r.rho is not None else np.nan
    values, vectors = np.linalg.eigh(m)
    order = np.argsort(-values)
    return values[order], {n: vectors[i, order].tolist() for n, i in at.items()}
