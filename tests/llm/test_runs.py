"""Periodic runs against brute force, and on awkward rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("edgewright.llm")

from pyspark.sql import functions as F  # noqa: E402

from edgewright.llm import runs  # noqa: E402


def brute(words):
    """Every maximal run by trying all periods."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            begin = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            size = i - begin + q
            if i > begin and size >= max(12, 2 * q):
                found.setdefault((begin, size), q)  # periods ascend
            i += 1
    return sorted(((s, size, q) for (s, size), q in found.items()), key=lambda x: (x[0], x[2]))


def contract(doc_id, text):
    w = text.encode().split() if text else []
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute(w)
    drop = {i for s, size, q in found for i in range(s + q, s + size)}
    best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
    listed = "".join(f"{s},{size},{q}\n" for s, size, q in found)
    kept = b" ".join(x for i, x in enumerate(w) if i not in drop)
    return (len(found), *best, best[1] and 1000 * best[1] // best[2], hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def series(rng):
    n, k = rng.choice((0, 1, 5, 11, 12, 13, 30, 60, 120)), rng.choice((1, 2, 3, 6, 50))
    w = [rng.randrange(k) for _ in range(n)]
    if n and rng.random() < 0.6:
        a = rng.randrange(n)
        p = rng.randrange(1, 1 + max(1, (n - a) // rng.choice((1, 2, 3, 5))))
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w * 2 if rng.random() < 0.3 else w


def test_runs_equal_brute_force():
    rng = random.Random(3)
    for _ in range(400):
        docs = [series(rng) for _ in range(rng.randrange(1, 5))]
        ends = np.cumsum([len(d) for d in docs])
        want = [(s + end - len(d), size, q) for d, end in zip(docs, ends.tolist(), strict=True) for s, size, q in brute(d)]
        assert [tuple(x) for x in runs.runs(np.array(sum(docs, []), np.int64), ends).tolist()] == want


def test_long_series_take_time_in_proportion():
    one = runs.runs(np.zeros(300_000, np.int64), np.array([300_000]))
    assert one.tolist() == [[0, 300_000, 1]]
    a, b = [0], [0, 1]
    while len(b) < 100_000:
        a, b = b, b + a
    found = runs.runs(np.array(b), np.array([len(b)]))  # a Fibonacci word: many runs, nested
    assert len(found) > 20_000 and (found[:, 1] >= 2 * found[:, 2]).all() and len({(s, q) for s, _, q in found.tolist()}) == len(found)


def test_query_equals_brute_force_on_awkward_rows(spark, tmp_path):
    rng = random.Random(8)
    ids = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 10 == 0][:40] + [i for i in range(4000) if zlib.crc32(str(i).encode()) % 10][:20]
    rows = [(i, " ".join("w" + str(x) for x in series(rng))) for i in ids]
    rows += [(5000, None), (5001, ""), (5002, " \n\t "), (5003, "a\x0bb\x0ca b a b\n" * 9), (5004, "é 日本 🙂 " * 7), (5005, "x " * 30_000), (None, "a b " * 8), rows[0], rows[-1]]
    spark.createDataFrame(rows, "doc_id long, text string").withColumns({"start": F.lit("s"), "runs": F.lit(1), "period": F.lit(2)}).write.parquet(str(tmp_path / "documents.parquet"))
    found = runs.query(spark, str(tmp_path)).collect()
    assert len(found) == len(rows)
    names = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    slow = 5005
    want = sorted((str(i), *map(str, contract(i, t))) for i, t in rows if i != slow)
    assert sorted((str(r.doc_id), *(str(r[c]) for c in names)) for r in found if r.doc_id != slow) == want
    assert next(r for r in found if r.doc_id == slow).n_runs == 1


def test_whole_results_and_empty_tables(spark):
    df = spark.createDataFrame([("a", "x y z " * 6 + "end"), ("b", None)], "name string, body string").withColumns({"n_runs": F.lit(7), "doc_id": F.lit(1)})
    found = {r.name: r for r in runs.periodic_runs(df, id_col="name", text_col="body").collect()}
    assert found["a"].runs == [[0, 18, 3]] and found["a"].collapsed == "x y z end" and found["a"].n_dropped == 15
    assert found["b"].n_runs == 0 and found["b"].collapsed == "" and found["b"].n_words == 0
    assert runs.periodic_runs(df.limit(0), id_col="name", text_col="body").count() == 0


def test_small_tables_equal_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    some = {i: t for i, t in docs.items() if t is None or len(t) < 4000}
    names = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    found = {r.doc_id: tuple(r[c] for c in names) for r in runs.query(spark, sf_dir).collect()}
    assert found.keys() == docs.keys()
    assert all(found[i] == contract(i, t) for i, t in some.items())
