"""What round 3's finding on repeated passages asked for: runs that repeat nothing stay out of the sort."""

import random
from collections import Counter

import duckdb
import pytest

pytest.importorskip("edgewright.llm")

from pyspark.sql import functions as F  # noqa: E402

from edgewright.llm import substrings  # noqa: E402


def digests(df):
    rows = substrings.cleaned(df).select("doc_id", "n_words", "n_removed", F.sha2("clean_text", 256).alias("kept_sha256")).collect()
    return sorted(map(tuple, rows))


def sql_digests(df):
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    return sorted(con.sql(substrings.SQL).fetchall())


def windows_twice(texts):
    """(document, window) of the windows that more than one document has."""
    found = {(i, tuple(words[j : j + 13])) for i, t in enumerate(texts) for words in [t.split()] for j in range(len(words) - 12)}
    n = Counter(w for _, w in found)
    return {(i, w) for i, w in found if n[w] > 1}


def test_runs_that_share_no_minimiser_are_not_sorted(spark):
    # before, every run of every text went through the sort and to the comparison
    texts = [" ".join(f"w{i}x{j}" for j in range(80)) for i in range(30)]
    shared = " ".join(f"s{j}" for j in range(20))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert substrings.super_kmers(df).count() == 0
    texts[4], texts[20] = f"{texts[4]} {shared} end", f"{shared} {texts[20]}"
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartitionByRange(3, "doc_id")
    sent = substrings.super_kmers(df).collect()
    got = {(r.doc, tuple(words[j : j + 13])) for r in sent if r.minimiser is not None for words in [r.packed.decode().split()] for j in range(len(words) - 12)}
    assert windows_twice(texts) <= got and {d for d, _ in got} == {4, 20} and len(sent) < 20


@pytest.mark.parametrize("held", [0, 3_000, 24_000_000])
def test_buckets_beyond_what_a_worker_holds_equal_sql(spark, monkeypatch, held):
    monkeypatch.setattr(substrings, "HELD_BYTES", held)
    rng = random.Random(21)
    passages = [" ".join(rng.choice("abcdefgh") * 2 for _ in range(n)) for n in (13, 15, 40)]
    texts = [" ".join([*(rng.choice("xyz") + str(rng.randrange(30)) for _ in range(rng.randrange(30))), rng.choice(passages), "q" * rng.randrange(90), rng.choice(passages)]) for _ in range(90)]
    texts += [None, "", "\t \n", " a" * 12, "\x0ba" * 13 + "\x1f\xa0é", " a" * 300, " a b" * 99, f"\n{passages[0]}\r\f"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert digests(df) == sql_digests(df)
