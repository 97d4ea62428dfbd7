"""Licence scan in DataFrame functions only: TF-IDF cosine to templates, then the nearest ancestor folder's licence.

Lines that may state a licence, and whole texts that hold such a line, become bags of terms; each is compared with
every template by the cosine of their TF-IDF weights (terms are weighted by how few templates have them). A line may
state a licence if it has any template term that is not ``COMMON``; common terms alone state nothing, though a line
of one word such as "By" would be near a template. A file's own licence is its best line's, from ``SIMILAR`` on.
A file that as a whole is a licence licenses its folder; the best of several, then the first by path. That is a file
whose cosine to a full licence text reaches ``FULL`` (it then has that licence), or one whose cosine to a notice
reaches ``WHOLE`` if its best line states the same licence: in long prose, common terms alone reach ``WHOLE``. Files without a licence of
their own take that of the nearest ancestor folder that has one: folders, not files, look their ancestors up by
joins on the path, and a file then looks its folder up.

Null and empty texts have no licence of their own. Files without a path have folder '' and only inherit from it.
Repeated rows get equal results; ties between templates go to the one listed first; an empty table gives an empty
table.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgewright.llm.common import stored, table

SIMILAR, WHOLE = 0.5, 0.3
TERM = r"[a-z0-9]+(?:\.[0-9]+)?"
#: Terms of licence texts by licence, with their numbers; full texts, unlike the notices below.
TEXTS, FULL = Path(__file__).with_name("licence_texts.json"), 0.85
#: Template terms that state nothing by themselves: they are common in prose, or numbers.
COMMON = frozenset("a and any are by in is of the this to under all released mit sa 1.0 2.0 4.0 2 3 v".split())
#: Common terms that do state a licence when written so.
WRITTEN = r"(?<![A-Za-z0-9])(?:MIT|SA)(?![A-Za-z0-9])|(?i:under (?:the )?mit)(?![A-Za-z0-9])"
#: Parts of words that may state a licence too.
HINTS = ("licen", "copyright", "public domain", "permission is hereby", "cc by", "cc0", "gnu ")
#: The notices by which licences are stated.
TEMPLATES = {
    "MIT": "Released under the MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software.",
    "MIT-short": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This program is free software under the GNU General Public License, version 2.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "Licensed under the GNU Affero General Public License, version 3.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms are permitted under the BSD 3-Clause License.",
    "MPL-2.0": "This source code form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0.",
    "Proprietary": "Copyright. All rights reserved.",
}


def _terms(text: str) -> list[str]:
    return re.findall(TERM, text.lower())


def weights() -> tuple[dict[str, float], float, dict[str, dict[str, float]]]:
    """The terms' inverse frequencies among templates, that of any other term, and each template's unit vector times them."""
    bags = {name: Counter(_terms(text)) for name, text in TEMPLATES.items()}
    found = Counter(t for bag in bags.values() for t in bag)
    idf = {t: round(math.log((1 + len(bags)) / (1 + n)) + 1, 9) for t, n in sorted(found.items())}
    out = {}
    for name, bag in bags.items():
        norm = math.sqrt(sum((n * idf[t]) ** 2 for t, n in bag.items()))
        out[name] = {t: round(n * idf[t] * idf[t] / norm, 9) for t, n in sorted(bag.items())}
    return idf, round(math.log(1 + len(bags)) + 1, 9), out


def licence_name(template: str) -> str:
    return template.removesuffix("-short")


def _lookup(values: dict[str, float], key: Column, default: float) -> Column:
    table_ = F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*map(F.lit, values.values())))
    return F.coalesce(F.try_element_at(table_, key), F.lit(default))


def best_template(text: Column) -> dict[str, Column]:
    """Columns to add in order; the last, ``best``, is the struct of score and licence."""
    idf, other, templates = weights()
    start = F.struct(F.lit("").alias("term"), F.lit(0.0).alias("run"), F.lit(0.0).alias("total"))

    def add(state: Column, term: Column) -> Column:
        run = F.when(state["term"] == term, state["run"]).otherwise(0.0)
        weight = _lookup(idf, term, other)
        return F.struct(term.alias("term"), (run + 1).alias("run"), (state["total"] + weight * weight * (2 * run + 1)).alias("total"))

    def cosine(values: dict[str, float]) -> Column:
        return F.round(F.aggregate("terms", F.lit(0.0), lambda total, term: total + _lookup(values, term, 0.0)) / F.col("norm"), 6)

    scores = [F.struct(cosine(w).alias("score"), F.lit(-i).alias("order"), F.lit(licence_name(name)).alias("licence")) for i, (name, w) in enumerate(templates.items())]
    return {
        "terms": F.array_sort(F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), F.lit(1))),
        "norm": F.sqrt(F.aggregate("terms", start, add)["total"]),
        "best": F.when(F.col("norm") > 0, F.array_max(F.array(*scores))),
    }


def may_state(text: Column) -> Column:
    """Whether a text has a template term that is not common, or one of the hints inside a word."""
    terms = "|".join(sorted({re.escape(t) for t in weights()[0]} - {re.escape(t) for t in COMMON}))
    return text.rlike(rf"(?i:{'|'.join(HINTS)}|(?<![a-z0-9])(?:{terms})(?![a-z0-9]))|{WRITTEN}")


def full_weights() -> tuple[list[str], float, list[tuple[str, float, list[float]]]]:
    """The licences with full texts, the inverse frequency of terms in none, and (term, its own, unit weight times it by licence)."""
    bags = json.loads(TEXTS.read_text())
    found = Counter(t for bag in bags.values() for t in bag)
    idf = {t: math.log((1 + len(bags)) / (1 + n)) + 1 for t, n in sorted(found.items())}
    norms = [math.sqrt(sum((n * idf[t]) ** 2 for t, n in bag.items())) for bag in bags.values()]
    return list(bags), math.log(1 + len(bags)) + 1, [(t, v, [bag.get(t, 0) * v * v / norm for bag, norm in zip(bags.values(), norms, strict=True)]) for t, v in idf.items()]


def full_texts(files: DataFrame) -> DataFrame:
    """(id, full_score, full_licence): the full licence text nearest to each file's, from ``FULL`` on; the first by name of equals."""
    names, other, rows = full_weights()
    known = files.sparkSession.createDataFrame(rows, "term string, idf double, ws array<double>")
    terms = files.select("id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"({TERM})"), F.lit(1))).alias("term"))
    counted = terms.groupBy("id", "term").agg(F.count("*").alias("tf")).join(F.broadcast(known), "term", "left")
    square = F.pow(F.col("tf") * F.coalesce("idf", F.lit(other)), F.lit(2.0))
    sums = counted.groupBy("id").agg(F.sqrt(F.sum(square)).alias("norm"), *(F.coalesce(F.sum(F.col("tf") * F.col("ws")[i]), F.lit(0.0)).alias(f"dot{i}") for i in range(len(names))))
    scores = [F.struct((-F.round(F.col(f"dot{i}") / F.col("norm"), 6)).alias("less"), F.lit(name).alias("licence")) for i, name in enumerate(names)]
    return sums.select("id", F.array_min(F.array(*scores)).alias("x")).select("id", (-F.col("x.less")).alias("full_score"), F.col("x.licence").alias("full_licence")).where(F.col("full_score") >= FULL)


def statements(files: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """(id, own_score, own_licence, whole_score, whole_licence, full_score, full_licence) of the files that may state a licence."""
    some = files.where(may_state(F.col(text_col))).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    lines = F.transform(F.filter(F.split("text", "\n"), may_state), lambda x: F.struct(F.lit(False).alias("whole"), x.alias("text")))
    parts = some.select("id", F.explode(F.concat(lines, F.array(F.struct(F.lit(True).alias("whole"), F.col("text"))))).alias("part")).select("id", "part.whole", "part.text")
    full = full_texts(some)
    for name, value in best_template(F.col("text")).items():
        parts = parts.withColumn(name, value)
    best = parts.groupBy("id").agg(F.max(F.when(~F.col("whole"), F.col("best"))).alias("own"), F.max(F.when(F.col("whole"), F.col("best"))).alias("all"))
    best = best.select("id", F.col("own.score").alias("own_score"), F.col("own.licence").alias("own_licence"), F.col("all.score").alias("whole_score"), F.col("all.licence").alias("whole_licence"))
    return best.join(full, "id", "left")


def ancestors(folder: Column) -> Column:
    """The folder, its parent, and so on up to the root ''."""
    steps = F.split(folder, "/")
    return F.concat(F.transform(F.sequence(F.lit(0), F.size(steps) - 1), lambda i: F.array_join(F.slice(steps, F.lit(1), F.size(steps) - i), "/")), F.array(F.lit("")))


def scan(files: DataFrame, *, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(id_col, own_licence, own_score, licence_file, licence, licence_folder) of every file."""
    found = stored(statements(files, id_col=id_col, text_col=text_col), "licences").dropDuplicates(["id"])
    folder = F.coalesce(F.regexp_extract(F.col(path_col), r"^(.*)/[^/]*$", 1), F.lit(""))
    places = files.select(F.col(id_col).alias("file"), F.col(path_col).alias("_path"), folder.alias("folder")).join(found, F.col("file") == F.col("id"), "left")
    states, full = F.col("own_score") >= SIMILAR, F.col("full_score").isNotNull()
    own = F.when(full, F.col("full_licence")).when(states, F.col("own_licence"))
    notice = states & (F.col("whole_score") >= WHOLE) & (F.col("whole_licence") == F.col("own_licence"))
    places = places.select(
        "file", "_path", "folder", own.alias("own_licence"), F.coalesce("full_score", F.when(states, F.col("own_score")), F.lit(0.0)).alias("own_score"),
        F.coalesce(full | notice, F.lit(False)).alias("licence_file"), F.coalesce("full_score", "whole_score").alias("whole_score"), F.coalesce("full_licence", "whole_licence").alias("whole_licence"),
    )
    places = stored(places, "places")
    licensed = places.where("licence_file").groupBy("folder").agg(F.min(F.struct((-F.col("whole_score")).alias("score"), "_path", F.col("whole_licence").alias("licence"))).alias("x")).select(F.col("folder").alias("above"), "x.licence")
    folders = places.select("folder").distinct().select("folder", F.posexplode(ancestors(F.col("folder"))).alias("up", "above"))
    resolved = folders.join(stored(licensed, "folders"), "above").groupBy("folder").agg(F.min(F.struct("up", "above", "licence")).alias("n"))
    resolved = stored(resolved.select("folder", F.col("n.above").alias("licence_folder"), F.col("n.licence").alias("folder_licence")), "resolved")
    joined = places.join(resolved, "folder", "left")
    inherits = F.col("own_licence").isNull()
    return joined.select(F.col("file").alias(id_col), "own_licence", "own_score", "licence_file", F.coalesce("own_licence", "folder_licence", F.lit("NONE")).alias("licence"), F.when(inherits, F.col("licence_folder")).alias("licence_folder"))


def document_path() -> Column:
    """Where a document lies: its source, then a folder for each digit of its id but the last."""
    digits = F.col("doc_id").cast("string")
    return F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.when(F.length(digits) > 1, F.array_join(F.split(F.substring(digits, F.lit(1), F.length(digits) - 1), ""), "/")), F.concat(digits, F.lit(".txt")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence of every document: its own, or that of the nearest folder above it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", document_path().alias("path"), "text")
    return scan(docs)


def _may_state_sql(text: str) -> str:
    """``may_state`` for an engine without looking around: what stands beside a term is part of the match."""
    terms = "|".join(sorted({re.escape(t) for t in weights()[0]} - {re.escape(t) for t in COMMON}))
    found = [rf"(?i){'|'.join(HINTS)}|(?:^|[^a-z0-9])(?:{terms})(?:[^a-z0-9]|$)", r"(?:^|[^A-Za-z0-9])(?:MIT|SA)(?:[^A-Za-z0-9]|$)", r"(?i)under (?:the )?mit(?:[^a-z0-9]|$)"]
    return "(" + " OR ".join(f"regexp_matches({text}, '{x}')" for x in found) + ")"


def _sql() -> str:
    idf, other, templates = weights()
    rows = ", ".join(f"({-i}, '{licence_name(name)}', '{t}', {w!r})" for i, (name, ws) in enumerate(templates.items()) for t, w in ws.items())
    names, rare, known = full_weights()
    full = ", ".join(f"('{t}', {v!r}::DOUBLE, [{', '.join(map(repr, ws))}]::DOUBLE[])" for t, v, ws in known)
    scores = ", ".join(f"{{'score': round(dot[{i + 1}] / norm, 6), 'licence': '{name}'}}" for i, name in enumerate(names))
    dots = ", ".join(f"coalesce(sum(tf * ws[{i + 1}]), 0)" for i in range(len(names)))
    return rf"""
WITH tpl(ord, licence, term, w) AS (VALUES {rows}),
idf(term, v) AS (VALUES {", ".join(f"('{t}', {v!r})" for t, v in idf.items())}),
known(term, v, ws) AS (VALUES {full}),
d AS (SELECT doc_id, text, coalesce(source, 'unknown') || CASE WHEN len(doc_id::VARCHAR) > 1 THEN '/' || array_to_string(regexp_extract_all(left(doc_id::VARCHAR, len(doc_id::VARCHAR) - 1), '.'), '/') ELSE '' END AS folder, doc_id || '.txt' AS leaf FROM documents),
m AS MATERIALIZED (SELECT doc_id, text FROM d WHERE {_may_state_sql("text")}),
p AS (SELECT doc_id, false AS whole, x FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM m) WHERE {_may_state_sql("x")} UNION ALL SELECT doc_id, true, text FROM m),
n AS MATERIALIZED (SELECT row_number() OVER () AS part, * FROM p),
b AS MATERIALIZED (SELECT part, term, count(*) AS tf FROM (SELECT part, unnest(regexp_extract_all(lower(x), '{TERM}')) AS term FROM n) GROUP BY ALL),
z AS (SELECT part, sqrt(sum(power(tf * coalesce(v, {other!r}), 2))) AS norm FROM b LEFT JOIN idf USING (term) GROUP BY part),
s AS (SELECT part, ord, licence, sum(tf * w) AS dot FROM b JOIN tpl USING (term) GROUP BY ALL),
c AS (SELECT n.doc_id, n.whole, round(dot / norm, 6) AS score, ord, licence FROM s JOIN z USING (part) JOIN n USING (part)),
o AS (SELECT doc_id, score AS own_score, licence AS own_licence FROM c WHERE NOT whole QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord DESC) = 1),
a AS (SELECT doc_id, score AS whole_score, licence AS whole_licence FROM c WHERE whole QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord DESC) = 1),
y AS (SELECT doc_id, sqrt(sum(power(tf * coalesce(v, {rare!r}), 2))) AS norm, [{dots}] AS dot FROM b JOIN n USING (part) LEFT JOIN known USING (term) WHERE whole GROUP BY doc_id),
x AS (SELECT doc_id, q.score AS full_score, q.licence AS full_licence FROM (SELECT doc_id, unnest([{scores}]) AS q FROM y) WHERE q.score >= {FULL} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY q.score DESC, q.licence) = 1),
f AS (SELECT d.doc_id, d.folder, d.leaf, coalesce(full_licence, CASE WHEN own_score >= {SIMILAR} THEN own_licence END) AS own_licence, coalesce(full_score, CASE WHEN own_score >= {SIMILAR} THEN own_score END, 0.0) AS own_score,
  coalesce(full_score IS NOT NULL OR (own_score >= {SIMILAR} AND whole_score >= {WHOLE} AND whole_licence = o.own_licence), false) AS licence_file, coalesce(full_score, whole_score) AS whole_score, coalesce(full_licence, whole_licence) AS whole_licence
  FROM d LEFT JOIN o USING (doc_id) LEFT JOIN a USING (doc_id) LEFT JOIN x USING (doc_id)),
l AS (SELECT folder AS above, whole_licence AS licence FROM f WHERE licence_file QUALIFY row_number() OVER (PARTITION BY folder ORDER BY whole_score DESC, folder || '/' || leaf) = 1),
r AS (SELECT f.doc_id, l.above, l.licence FROM f JOIN l ON f.folder = l.above OR starts_with(f.folder, l.above || '/') QUALIFY row_number() OVER (PARTITION BY f.doc_id ORDER BY len(l.above) DESC) = 1)
SELECT f.doc_id, own_licence, own_score, licence_file, coalesce(own_licence, r.licence, 'NONE') AS licence, CASE WHEN own_licence IS NULL THEN r.above END AS licence_folder
FROM f LEFT JOIN r USING (doc_id)
"""


SQL = _sql()
