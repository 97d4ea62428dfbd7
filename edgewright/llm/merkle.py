"""Merkle manifest of a dataset: a proof for every row, by a traversal of aligned blocks of leaves.

Every row is a leaf, the digest of its columns. Leaves of a source are in order of their id (ties by digest) and form a
tree of three children a node; the sources' roots, in order of their names, form the tree above. Positions come from
ranges of (source, id) that Spark sorts apart, so a source with a third of all rows is many tasks' work.

``ARITY**HEIGHT`` consecutive leaves whose first position is a multiple of that are an aligned block, a whole subtree. Blocks are
traversed apart: a leaf's authentication path (its siblings, level by level) becomes the next leaf's by ``Treehash``
stacks, one for each sibling that some later leaf will need; each leaf gives ``HEIGHT`` steps to those whose lowest node
is the lowest, so that they hold about as many nodes as the tree has levels. Blocks' roots are the leaves of the next
traversal, again in blocks, until each source has one; then sources' roots are traversed likewise. What lies above a
block is shared by all its leaves and appended to each path. A path never moves between tasks: leaves meet what lies
above their block, one row, as digests.

Nulls in any column are fields of their own; a null source is a source of its own, before the others; a null id comes
first and is never tampered with. Rows with one id are leaves side by side, extra columns are ignored, and an empty
table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgewright.llm.common import begun, crc_mod, dropped, released, stored, table

#: Children of a node, and levels of a block (2,187 leaves).
ARITY, HEIGHT = 3, 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
_PATH_SQL = "array<struct<left:string,right:string>>"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(fields: list[Column]) -> Column:
    """The digest of fields, each with its length in bytes before it, `-` if null."""
    values = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values)), 256)


def levels(n: int) -> int:
    """Levels above ``n`` leaves."""
    height = 0
    while n > 1:
        n, height = -(-n // ARITY), height + 1
    return height


class Treehash:
    """One node, made from the leaves below it a step at a time; the stack has its unfinished runs, the lowest last."""

    def __init__(self, leaves: list[str], level: int, index: int):
        self.leaves, self.level = leaves, level
        self.at, self.end = index * ARITY**level, min((index + 1) * ARITY**level, len(leaves))
        self.stack: list[tuple[int, list[str]]] = []
        self.node = ""

    @property
    def low(self) -> int:
        """The level of the lowest unfinished run; the node's own if none is begun."""
        return self.stack[-1][0] if self.stack else self.level

    def _put(self, level: int, node: str) -> None:
        if self.stack and self.stack[-1][0] == level:
            self.stack[-1][1].append(node)
        else:
            self.stack.append((level, [node]))

    def step(self) -> None:
        """Take one leaf and close the runs that it completes; behind the last leaf all that are open."""
        self._put(0, self.leaves[self.at])
        self.at += 1
        last = self.at == self.end
        while self.stack[-1][0] < self.level and (last or len(self.stack[-1][1]) == ARITY):
            level, run = self.stack.pop()
            self._put(level + 1, digest(*run))
        if last:
            self.node = self.stack.pop()[1][0]

    def finish(self) -> str:
        while not self.node:
            self.step()
        return self.node


def traversal(leaves: list[str], height: int) -> Iterator[list[tuple[str, str]]]:
    """The authentication path of each leaf in order: the joined siblings to the left and right of its node, by level."""
    n = len(leaves)
    counts = [-(-n // ARITY**level) for level in range(height)]

    def begin(level: int, run: int) -> list[Treehash]:
        """Hashes of a run's nodes but the first, which will be known when it is done."""
        return [Treehash(leaves, level, i) for i in range(ARITY * run + 1, min(ARITY * (run + 1), counts[level]))]

    now = [["", *(t.finish() for t in begin(level, 0))] for level in range(height)]
    later = [begin(level, 1) for level in range(height)]
    path = [("", "".join(run[1:])) for run in now]
    for i in range(n):
        yield path
        node, index = leaves[i], i
        for level in range(height):
            place = index % ARITY
            now[level][place] = node
            if place + 1 < len(now[level]):  # the next leaf is below the next node of this run
                path[level] = ("".join(now[level][: place + 1]), "".join(now[level][place + 2 :]))
                break
            node = digest(*now[level])
            if index + 1 < counts[level]:
                now[level] = ["", *(t.finish() for t in later[level])]
                later[level] = begin(level, index // ARITY + 2)
                path[level] = ("", "".join(now[level][1:]))
            index //= ARITY
        waiting = [t for each in later for t in each if not t.node]
        for _ in range(height):
            if not waiting:
                break
            least = min(waiting, key=lambda t: t.low)
            least.step()
            if least.node:
                waiting.remove(least)


def block_of(height: int) -> Column:
    return F.expr(f"pos div {ARITY**height}").alias("block")


def block_roots(nodes: DataFrame, height: int) -> DataFrame:
    """(tree, pos, n, digest) of the blocks of ``nodes``, which have the same columns. All blocks of a tree have the same
    levels, but a tree of one block ends at its root."""
    width = ARITY**height

    def root(block: pa.Table) -> pa.Table:
        begun(__name__)
        block = block.sort_by("pos")
        n, at = block["n"][0].as_py(), block["pos"][0].as_py() // width
        node = Treehash(block["digest"].to_pylist(), min(height, levels(n)), 0).finish()
        return pa.table({"tree": block["tree"].slice(0, 1), "pos": [at], "n": [-(-n // width)], "digest": [node]})

    return nodes.select("tree", "pos", "n", "digest").groupBy("tree", block_of(height)).applyInArrow(root, "tree string, pos long, n long, digest string")


def with_paths(nodes: DataFrame, above: DataFrame, keep: dict[str, str], height: int) -> DataFrame:
    """``keep`` (name and type) of ``nodes`` with ``path`` and what ``above`` (tree, block, path, ...) says of their block;
    its path goes behind the one inside the block."""
    shared = {f.name: f.dataType.simpleString() for f in above.schema if f.name not in ("tree", "block", "path")}

    def walk(leaves: pa.Table, top: pa.Table) -> pa.Table:
        begun(__name__)
        leaves = leaves.sort_by("pos")
        behind = [(x["left"], x["right"]) for x in top["path"][0].as_py()]
        lefts, rights, ends = [], [], [0]
        for path in traversal(leaves["digest"].to_pylist(), min(height, levels(leaves["n"][0].as_py()))):
            for left, right in path + behind:
                lefts.append(left)
                rights.append(right)
            ends.append(len(lefts))
        pairs = pa.StructArray.from_arrays([pa.array(lefts, pa.string()), pa.array(rights, pa.string())], ["left", "right"])
        columns = {c: leaves[c] for c in keep} | {"path": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)}
        columns |= {c: pa.array([top[c][0].as_py()] * len(leaves)) for c in shared}
        released()
        return pa.table(columns)

    schema = ", ".join(f"`{c}` {t}" for c, t in (keep | {"path": _PATH_SQL} | shared).items())
    left = nodes.select("tree", "pos", "n", "digest", *(c for c in keep if c not in ("tree", "pos", "n", "digest"))).groupBy("tree", block_of(height))
    return left.cogroup(above.groupBy("tree", "block")).applyInArrow(walk, schema)


def block_tops(nodes: DataFrame, height: int) -> DataFrame:
    """(tree, block, path, top): what lies above each block of ``nodes``, and its tree's root."""
    roots = stored(block_roots(nodes, height), "block-roots")
    if roots.where("n > 1").isEmpty():
        return roots.select("tree", F.col("pos").alias("block"), F.array().cast(_PATH_SQL).alias("path"), F.col("digest").alias("top"))
    above = with_paths(roots, block_tops(roots, height), {"tree": "string", "pos": "long"}, height)
    return stored(above.select("tree", F.col("pos").alias("block"), "path", "top"), "block-tops")


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with their place ``pos`` in the order of their ``tree`` and its number ``n`` of rows, stored. Ranges of the
    whole order are sorted apart; a table of counts by tree and range gives where each begins."""
    ranged = stored(rows.repartitionByRange("tree", *order).withColumn("part", F.spark_partition_id()), "ranged")
    tree = Window.partitionBy("tree")
    counts = ranged.groupBy("tree", "part").agg(F.count("*").alias("k"))
    first = F.coalesce(F.sum("k").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("tree", "part", first.alias("first"), F.sum("k").over(tree).alias("n"))
    own = F.row_number().over(Window.partitionBy("tree", "part").orderBy(*order)) - 1
    placed = ranged.withColumn("own", own).join(starts, ["tree", "part"]).withColumn("pos", F.col("first") + F.col("own")).drop("part", "first", "own")
    found = stored(placed, "numbered")
    dropped(ranged)
    return found


def folded(node: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    return F.aggregate(path, node, lambda x, s: F.sha2(F.concat(s["left"], x, s["right"]), 256))


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, *, id_col: str = "doc_id", source_col: str = "source", kept: dict[str, Column] | None = None, height: int = HEIGHT) -> DataFrame:
    """(id, leaf, subroot, root, path) of every row, and the columns ``kept``. A path goes from the leaf over its source's
    root to the root."""
    kept = kept or {}
    tree = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))  # sorts as the names do, null first
    rows = docs.select(tree.alias("tree"), F.col(id_col).alias("id"), leaf([F.col(c) for c in fields]).alias("digest"), *(c.alias(name) for name, c in kept.items()))
    leaves = numbered(rows, ["id", "digest"])
    blocks = block_tops(leaves, height).withColumnRenamed("top", "subroot")
    sources = blocks.where("block = 0").select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("subroot").alias("digest"))
    sources = numbered(sources, ["name"])
    shared = with_paths(sources, block_tops(sources, height), {"name": "string"}, height)
    above = blocks.join(shared.select(F.col("name").alias("tree"), F.col("path").alias("far"), F.col("top").alias("root")), "tree")
    above = stored(above.select("tree", "block", F.concat("path", "far").alias("path"), "subroot", "root"), "above")
    keep = {"id": rows.schema["id"].dataType.simpleString(), "digest": "string"} | {c: rows.schema[c].dataType.simpleString() for c in kept}
    return with_paths(leaves, above, keep, height).withColumnRenamed("digest", "leaf")


def query(spark: SparkSession, sf_dir: str, height: int = HEIGHT) -> DataFrame:
    """The manifest of the documents, and for each whether its leaf, after tampering, still leads to the root."""
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    spoilt = (crc_mod("doc_id", 2) == 0) & F.contains("text", F.lit("\n"))
    fields = [F.replace("text", F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in FIELDS]
    found = manifest(docs, kept={"tampered": F.when(spoilt, leaf(fields))}, height=height)
    now = F.coalesce("tampered", "leaf")
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    rows = found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded(now, F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


#: crc32 of an id's digits, bit by bit, in DuckDB's list functions.
_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)), lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"


def _field(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')"


def _sql() -> str:
    """Level by level in recursive queries; ``v`` has every node's run."""
    hashed = lambda text: f"sha256({' || '.join(_field(c) if c != 'text' else _field(text) for c in FIELDS)})"
    tree = "SELECT {tree}level + 1, pos // 3, max(n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM {t} WHERE n > 1 GROUP BY {tree}level, pos // 3"
    run = "SELECT {tree}level, pos, n, digest, coalesce(string_agg(digest, '' ORDER BY pos) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(digest, '' ORDER BY pos) OVER (r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {t} WHERE n > 1 WINDOW r AS (PARTITION BY {tree}level, pos // 3 ORDER BY pos)"
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || source, '') AS tree, {hashed("text")} AS leaf,
  CASE WHEN {_CRC} % 2 = 0 THEN {hashed("replace(text, chr(10), '')")} ELSE {hashed("text")} END AS tampered FROM documents),
p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d),
t AS (SELECT tree, 0 AS level, pos, n, leaf AS digest FROM p UNION ALL {tree.format(tree="tree, ", t="t")}),
s AS MATERIALIZED (SELECT tree, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM t WHERE t.n = 1),
u AS (SELECT 0 AS level, pos, n, subroot AS digest FROM s UNION ALL {tree.format(tree="", t="u")}),
tv AS MATERIALIZED ({run.format(tree="tree, ", t="t")}), uv AS MATERIALIZED ({run.format(tree="", t="u")}),
a AS (SELECT p.doc_id, p.tree, p.pos, v.level, v.l, v.r FROM p JOIN tv v ON v.tree = p.tree AND v.pos = p.pos // (3 ** v.level)::BIGINT
  UNION ALL SELECT p.doc_id, p.tree, p.pos, 1000 + v.level, v.l, v.r FROM p JOIN s USING (tree) JOIN uv v ON v.pos = s.pos // (3 ** v.level)::BIGINT),
f AS (SELECT tree, pos, sha256(coalesce(string_agg(l || r, '' ORDER BY level), '')) AS proof, list(l ORDER BY level) AS ls, list(r ORDER BY level) AS rs FROM a GROUP BY ALL),
e AS (SELECT p.doc_id, p.leaf, s.subroot, (SELECT digest FROM u WHERE n = 1) AS root, coalesce(f.proof, sha256('')) AS proof_sha256,
  list_reduce(list_concat([p.tampered], list_transform(range(1, coalesce(len(f.ls), 0) + 1), lambda i: f.ls[i] || '|' || f.rs[i])), lambda x, y: sha256(split_part(y, '|', 1) || x || split_part(y, '|', 2))) AS folded_root
  FROM p JOIN s USING (tree) LEFT JOIN f ON f.tree = p.tree AND f.pos = p.pos)
SELECT *, folded_root = root AS verified FROM e
"""


SQL = _sql()
