"""Where a review found operators doing less than their whole job."""

import json

import pytest

pytest.importorskip("edgewright.llm")

from edgewright.llm import licences, pagediff, quality  # noqa: E402


def test_licences_of_lines_without_a_hint_and_of_full_texts(spark):
    # a text of the full licence's own terms, one to a line, in the licence's numbers
    full = {name: "\n".join(" ".join([t] * n) for t, n in bag.items()) for name, bag in json.loads(licences.TEXTS.read_text()).items()}
    lines = {"All rights reserved.": "Proprietary", "CC-BY-4.0": "CC-BY-4.0", "MIT": "MIT", "released under mit": "MIT", "Redistribution and use in source and binary forms, with or without modification, are permitted provided": "BSD-3-Clause"}
    prose = ["And.", "By To.", "Mit", "Released.", "This is all of it", "the MITRE of the mit"]
    texts = [*lines, *prose, *full.values(), "the of to any and this is a " * 50 + "\nAll rights reserved."]
    df = spark.createDataFrame([(i, f"{i}/f.txt", t) for i, t in enumerate(texts)], "doc_id long, path string, text string")
    got = [r for r in sorted(licences.scan(df).collect(), key=lambda r: r.doc_id)]
    assert [r.own_licence for r in got[: len(lines)]] == list(lines.values())
    assert {r.own_licence for r in got[len(lines) : len(lines) + len(prose)]} == {None}
    assert [(r.own_licence, r.licence_file) for r in got[len(lines) + len(prose) : -1]] == [(name, True) for name in full]
    # the licence of one line in a long text is the file's, not its folder's
    assert got[-1].own_licence == "Proprietary" and not got[-1].licence_file


def test_few_hundred_labels_certify_all_rules_together(spark):
    # four rules and four strata as one sequence each: 217 good labels held out are enough if none is rejected
    rules = dict.fromkeys([(0, rule) for rule in quality.RULES], 20)
    assert quality.certify(rules, {(0, None): 217}, risk=0.02, error=0.05) == rules
    assert quality.certify(rules, {(0, None): 216}, risk=0.02, error=0.05) == {}
    # good documents that any rule rejects count once, for all rules; the sequence stops before they are too many
    assert quality.certify(rules, {(0, None): 400, (0, 30): 1, (0, 40): 30}, risk=0.02, error=0.05) == dict.fromkeys(rules, 64 - 39)
    texts = [" ".join(f"word{i}x{j}" + "%%%%%%%" * (i % 5 == 0) for j in range(30)) for i in range(800)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(800)], "doc_id long, quality int")
    got = quality.judged(docs, labels).select("doc_id", "kept").collect()
    assert {r.doc_id for r in got if not r.kept} == set(range(0, 800, 5))
    assert quality.keep(docs, labels).count() == 640


def test_shared_lines_inside_a_marked_article_go(spark):
    page = "<article><p>Buy at our shop today</p><p>{0}</p><p>More of {0}</p></article><p>outside {0}</p>"
    copy = "<main><p>A long line that both of two near copies have, so that they share nearly all</p><p>n{0}</p></main>"
    deep = "http://d/" + "/".join("abcdefghijklm")
    urls = ["http://h/a/1", "http://h/a/2", "http://g/a/1", "http://g/a/2"]
    rows = [(i, u, (page if i < 2 else copy).format(f"text number {i}")) for i, u in enumerate(urls)]
    got = {r.page_id: r.text for r in pagediff.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == "text number 0\nMore of text number 0" and got[1] == "text number 1\nMore of text number 1"
    assert got[2].endswith("nearly all\nntext number 2") and got[3].endswith("nearly all\nntext number 3")
    # pages in far-apart folders below a shallow one share its prefix
    assert "/a/" in pagediff.address(deep)[1]
