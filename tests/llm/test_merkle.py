"""The Merkle manifest against brute force and SQL, and on awkward rows."""

import hashlib
import zlib

import duckdb
import pytest

pytest.importorskip("edgewright.llm")

from pyspark.sql import functions as F  # noqa: E402

from edgewright.llm import merkle  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(leaves):
    """All levels of a tree and each leaf's siblings as (left, right)."""
    rows = [leaves]
    while len(rows[-1]) > 1:
        rows.append([h(*rows[-1][i : i + 3]) for i in range(0, len(rows[-1]), 3)])
    paths = []
    for i in range(len(leaves)):
        path = []
        for row in rows[:-1]:
            g = i - i % 3
            path.append(("".join(row[g:i]), "".join(row[i + 1 : g + 3])))
            i //= 3
        paths.append(path)
    return rows[-1][0], paths


def leaf(r, text):
    return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (r.doc_id, r.source, r.lang, r.n_chars, text)))


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    parts = {s: (sorted(by[s], key=lambda x: x[:3]), *tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])])) for s in names}
    root, over = tree([parts[s][1] for s in names])
    out = []
    for s, far in zip(names, over, strict=True):
        own, subroot, paths = parts[s]
        for (_, _, digest, r), path in zip(own, paths, strict=True):
            tampered = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and r.text is not None
            node = leaf(r, r.text.replace("\n", "")) if tampered else digest
            for left, right in path + far:
                node = h(left, node, right)
            out.append((str(r.doc_id), digest, subroot, root, h(*(x for pair in path + far for x in pair)), node, node == root))
    return sorted(out)


NAMES = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def ours(spark, folder, **options):
    return sorted((str(r.doc_id), *(r[c] for c in NAMES[1:])) for r in merkle.query(spark, folder, **options).collect())


def test_paths_and_nodes_of_trees_of_any_size():
    for n in [*range(1, 40), 80, 81, 82, 244]:
        leaves = [h(str(i)) for i in range(n)]
        root, paths = tree(leaves)
        assert [list(p) for p in merkle.traversal(leaves, merkle.levels(n))] == paths
        assert merkle.Treehash(leaves, merkle.levels(n), 0).finish() == root


def test_stacks_hold_as_many_nodes_as_there_are_levels(monkeypatch):
    alive, begin = [], merkle.Treehash.__init__
    monkeypatch.setattr(merkle.Treehash, "__init__", lambda self, *a: (begin(self, *a), alive.append(self))[0])
    most = 0
    for i, _ in enumerate(merkle.traversal([h(str(i)) for i in range(3**7)], 7)):
        alive[:] = [t for t in alive if not t.node]
        if i:
            most = max(most, sum(len(run) for t in alive for _, run in t.stack))
    assert most <= 2 * 7


@pytest.mark.parametrize("height", [merkle.HEIGHT, 1, 2])
def test_query_equals_brute_force_and_sql(spark, tmp_path, height):
    """With low blocks small tables have many of them, and several levels."""
    rows = [(i, None if i % 11 == 0 else f"line {i}\nmore\n" * (i % 4), None if i % 7 == 0 else "en", ("hot", "hot", None, "é", "b", "hot|x")[i % 6], None if i % 5 == 0 else i) for i in range(90)]
    rows += [(1000 + i, f"t{i}", "de", "hot", i) for i in range(60)] + [(7, "other text", "en", "alone", 1), rows[3], rows[3], (8, "", "", "", 0)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, DOCS).withColumns({"leaf": F.lit(1), "tree": F.lit(2), "pos": F.lit(3), "digest": F.lit(4)}).write.parquet(path)
    found = ours(spark, str(tmp_path), height=height)
    assert found == brute(spark.read.parquet(path).collect())
    assert {r[-1] for r in found} == {True, False}
    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    assert found == sorted((str(r[0]), *r[1:]) for r in duckdb.sql(f"SELECT {', '.join(NAMES)} FROM ({merkle.SQL})").fetchall())


def test_null_ids_one_row_and_no_row(spark, tmp_path):
    rows = spark.createDataFrame([(None, "a\nb", "en", None, None), (None, None, None, None, None), (2, "x" * 100_000 + "\n", None, "s", 1)], DOCS)
    for name, df in (("all", rows), ("one", rows.where("doc_id = 2")), ("none", rows.limit(0))):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        assert ours(spark, f"{tmp_path}/{name}") == (brute(df.collect()) if name != "none" else [])


def test_small_tables(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert ours(spark, sf_dir) == brute(rows)
