"""The licence scan and its SQL agree on lines without hints, full texts, long texts with one notice, and quoted terms."""

import json
import random

import duckdb
import pytest

pytest.importorskip("edgewright.llm")

from edgewright.llm import licences  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_sql_equals_the_scan_where_hints_do_not_reach(spark, tmp_path):
    rng = random.Random(6)
    bags = json.loads(licences.TEXTS.read_text())
    prose = lambda n: " ".join(rng.choice("the a of and this is all any software work version by under sa mit word other free".split()) for _ in range(n))
    texts = [" ".join(t for t, n in bag.items() for _ in range(n)) for bag in bags.values()]
    texts += [f"{prose(20)}\n{t}\n{prose(300)}" for t in licences.TEMPLATES.values()] + list(licences.TEMPLATES.values())
    texts += ["All rights reserved.", "ALL RIGHTS RESERVED", "Released under the MIT", "under mit", "a MIT b", "summit SA, mits", "relicensed terms", "(MPL) v. 2.0", "foundation-redistribution", None, "", "\n\n", "GNU\nGNU General Public License, version 2", "licence_1 mozilla_x"]
    texts += ["\n".join(prose(rng.randrange(12)) for _ in range(4)) for _ in range(40)]
    terms = sorted({t for x in licences.TEMPLATES.values() for t in licences._terms(x)})
    texts += [" ".join(rng.choice(terms) for _ in range(rng.randrange(1, 25))) for _ in range(60)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(i, t, "en", f"s{i % 3}", 0) for i, t in enumerate(texts)], DOCS).write.parquet(path)
    names = ("doc_id", "own_licence", "own_score", "licence_file", "licence", "licence_folder")
    ours = sorted(tuple(r[c] for c in names) for r in licences.query(spark, str(tmp_path)).collect())
    duckdb.sql(f"CREATE OR REPLACE TEMP VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    theirs = sorted(duckdb.sql(f"SELECT {', '.join(names)} FROM ({licences.SQL})").fetchall())
    key = lambda r: tuple(f"{float(x):.6f}" if k == 2 else x for k, x in enumerate(r))
    assert list(map(key, ours)) == list(map(key, theirs))
    assert {r[3] for r in ours} == {True, False} and sum(r[1] is not None for r in ours) > 30
