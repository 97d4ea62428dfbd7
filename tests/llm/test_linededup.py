"""Line dedup against SQL and brute force, and on awkward rows."""

import hashlib
import random

import duckdb
import pytest

pytest.importorskip("edgewright.llm")

from pyspark.sql import functions as F  # noqa: E402

from edgewright.llm import linededup  # noqa: E402

DOCS = "doc_id long, text string"


def key(line):
    return "".join(c.lower() if c.isascii() else c for c in line.strip(" \t\n\x0b\x0c\r"))


def brute(rows):
    holds = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                holds.setdefault(key(line), set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holds.get(key(x), ())) < 3 or i == max(holds[key(x)], key=lambda d: (d is not None, d or 0))]
        out.append((str(i), len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def ours(df):
    return sorted((str(r.doc_id), r.n_lines, r.n_dropped, hashlib.sha256(r.kept.encode()).hexdigest()) for r in df.collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    pool = [f"Line Number {i} of a Pool that repeats" for i in range(60)] + ["short", "", " \t ", "Ünïcode ÄÖÜ line, LONG enough to count", "x" * 19, "y" * 20, "  Y" + "y" * 19 + "\x0b"]
    texts = []
    for _ in range(300):
        lines = [rng.choice(pool) if rng.random() < 0.5 else f"own {rng.random()} of its own" for _ in range(rng.randrange(8))]
        texts.append("\n".join(rng.choice((x, x.upper(), f" {x}\r")) if x.isascii() else x for x in lines))
    found = list(enumerate(texts)) + [(1000, None), (1001, ""), (1002, "\n\n"), (1003, "A line that one document repeats\n" * 5)]
    found += [(5, "another text of one id\n" + texts[7]), (6, texts[6]), (None, texts[9]), (None, "A line that only nulls and two others have"), (-4, "A LINE that only nulls and two others have"), (2**40, "a line that only nulls and two others have ")]
    found.append((1004, "\n".join(["very long document of lines " + str(i % 50) for i in range(30_000)])))
    return found + [(1005 + i, f"very long document of lines {i}") for i in range(3)] + [(2000 + i, "very long document of lines 1\nDer Text ÄNDERT sich nicht, oder DOCH") for i in range(3)]


def test_query_equals_brute_force_and_sql(spark, rows, tmp_path):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, DOCS).withColumns({"key": F.lit(1), "place": F.lit(2), "batch": F.lit(3), "last": F.lit("x")}).repartition(3).write.parquet(path)
    want = brute(rows)
    found = linededup.query(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256) for r in found) == want
    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    assert sorted((str(r[0]), *r[1:]) for r in duckdb.sql(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({linededup.SQL})").fetchall()) == want


@pytest.mark.parametrize("batches", [1, 2, 21])
def test_any_number_of_batches_gives_the_same(spark, rows, batches):
    df = spark.createDataFrame(rows, "name long, body string")
    found = linededup.deduplicated(df, id_col="name", text_col="body", batches=batches).withColumnRenamed("name", "doc_id")
    assert ours(found) == brute(rows)


def test_runs_are_few_sorted_and_hold_no_settled_key_twice(spark):
    runs = linededup.Runs(spark, 4)
    for b in range(6):
        ids = spark.range(100 * (6 - b), 100 * (7 - b)).withColumnRenamed("id", "doc_id")
        common, rare = ids.select(F.lit("common").alias("key"), "doc_id"), ids.limit(1).select(F.concat(F.lit("rare"), F.lit(b % 2)).alias("key"), "doc_id")
        runs.add(common.union(rare).select(linededup.key_hash(F.col("key")).alias("key"), "doc_id"))
    assert [len(level) for level in runs.levels] == [2, 1]  # four runs are one of the next level
    entries = [(bytes(r.key), r.docs) for n in runs.names() for r in spark.table(n).collect()]
    assert [n for _, n in entries].count(100) == 1 and len(entries) == 5
    joined = spark.table(runs.levels[0][0]).hint("merge").join(spark.table(runs.levels[1][0]), "key", "left_anti")
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    assert {r["last"] for r in runs.repeated().collect()} == {699, 600, 500}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("edgewright_run")]


def test_empty_table(spark):
    assert linededup.deduplicated(spark.createDataFrame([], DOCS)).count() == 0


def test_no_python_on_the_main_path(spark, sf_dir):
    plan = linededup.query(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
