"""Merkle manifest of a dataset: a tree a source, one root over the sources, a proof a row.

A leaf is the SHA-256 of a row's fields, each written with its length. Leaves of a source
ascend by id; every 16 consecutive nodes become their parent, level by level, until one is
left, the source's subroot; the subroots, by source, become the root in the same way.

Work goes by aligned blocks of 16**``levels`` consecutive nodes of one tree. A block is walked
recursively in postorder: each call returns its subtree's digest, and while the calls unwind
every subtree's siblings are appended to the leaves it contains. The blocks' digests are the
nodes of the next tier, again dealt in blocks over the tasks, until a tier is one node a tree.
Then the tiers are walked from the top down: what a block's own node has as siblings above is
handed to its leaves, so no row carries more than its path, and no task more than a block.

Positions come without a sort in one task: rows are range-partitioned by (source, id), counted
a part, and numbered inside their part, so a source that holds a third of all rows is spread.

Defined cases: null fields count as ``-``; a null source is a tree of its own, first in order;
null ids come first; rows of one id are ordered by leaf, and equal rows take places in any
order, which gives the same rows; a row whose id is null is not tampered with; empty texts and
very long ones are hashed whole; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, discard, documents, store

FANOUT = 16
Path = list[tuple[str, str]]


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


# One block ---------------------------------------------------------------------


def height_of(n: int, levels: int, fanout: int = FANOUT) -> int:
    """Levels by which a block of a tree of n nodes is reduced: until one is left, at most ``levels``."""
    height = 0
    while fanout**height < n and height < levels:
        height += 1
    return height


def walk(nodes: list[str], height: int, paths: list[Path] | None = None, fanout: int = FANOUT) -> str:
    """The digest of the subtree over ``nodes``; appends to each of ``paths`` what stands before and after its node, level by level."""
    if not height:
        return nodes[0]
    width = fanout ** (height - 1)
    children = [walk(nodes[i : i + width], height - 1, paths and paths[i : i + width], fanout) for i in range(0, len(nodes), width)]
    if paths:
        for i in range(len(children)):
            beside = "".join(children[:i]), "".join(children[i + 1 :])
            for path in paths[i * width : (i + 1) * width]:
                path.append(beside)
    return digest("".join(children))


def folded(node: str, path: Path) -> str:
    """The root that ``node`` has with these siblings."""
    for before, after in path:
        node = digest(before + node + after)
    return node


# Tiers of blocks ---------------------------------------------------------------


def positions(rows: DataFrame, scraps: list[DataFrame], tree: str, *order: str) -> DataFrame:
    """``rows`` (stored) with pos, from 0 within each ``tree`` by ``order``, and n, the rows of the tree; what it stores joins ``scraps``."""
    dealt = rows.withColumn("tie", F.monotonically_increasing_id())
    placed = store(dealt.repartitionByRange(tree, *order, "tie").withColumn("part", F.spark_partition_id()))
    scraps.append(placed)
    counts = placed.groupBy(tree, "part").agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy(tree).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(tree, "part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"), F.sum("c").over(Window.partitionBy(tree)).alias("n"))
    inside = Window.partitionBy(tree, "part").orderBy(*order, "tie")
    return placed.join(starts, [tree, "part"]).withColumn("pos", F.col("start") + F.row_number().over(inside) - 1).drop("part", "tie", "start")


def _blocks(nodes: DataFrame, width: int, *carried: str) -> DataFrame:
    """(tree, n, block, items): up to ``width`` nodes in order, with what they carry."""
    item = F.struct("pos", "digest", *carried)
    return nodes.groupBy("tree", "n", F.expr(f"pos div {width}").alias("block")).agg(F.sort_array(F.collect_list(item)).alias("items"))


def _block_digests(levels: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.slice(i, 1)
                n, items = part.column("n")[0].as_py(), part.column("items")[0].as_py()
                top = walk([x["digest"] for x in items], height_of(n, levels))
                up = (n + FANOUT**levels - 1) // FANOUT**levels
                yield pa.RecordBatch.from_arrays([part.column("tree"), pa.array([up], pa.int64()), part.column("block"), pa.array([top])], ["tree", "n", "pos", "digest"])

    return run


def climb(nodes: DataFrame, scraps: list[DataFrame], levels: int, *carried: str) -> tuple[list[DataFrame], DataFrame]:
    """The stored blocks of every tier over ``nodes`` (tree, n, pos, digest), and (tree, digest) of the trees' tops."""
    tiers = []
    while True:
        tiers.append(store(_blocks(nodes, FANOUT**levels, *(carried if not tiers else ()))))
        nodes = store(tiers[-1].mapInArrow(_block_digests(levels), "tree string, n long, pos long, digest string"))
        scraps += [tiers[-1], nodes]
        if (nodes.agg(F.max("n").alias("n")).first()["n"] or 1) == 1:
            return tiers, nodes.select("tree", "digest")


_PATH = "path array<struct<before:string,after:string>>"


def _handed(levels: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                paths: list[Path] = [[] for _ in row["items"]]
                walk([x["digest"] for x in row["items"]], height_of(row["n"], levels), paths)
                above = [(x["before"], x["after"]) for x in row["path"]]
                whole = [[{"before": b, "after": a} for b, a in [*p, *above]] for p in paths]
                tree = [x.get("name", row["tree"]) for x in row["items"]]
                place = [0 if "name" in x else x["pos"] for x in row["items"]]
                yield pa.RecordBatch.from_arrays([pa.array(tree, pa.string()), pa.array(place, pa.int64()), pa.array(whole, kind)], ["tree", "block", "path"])

    return run


def descend(tiers: list[DataFrame], paths: DataFrame, levels: int) -> DataFrame:
    """(tree, block, path) of the nodes of the lowest of ``tiers``, given the paths of the blocks of the highest.

    A node that carries a name is the top of the tree of that name: its path is given to that tree's block 0.
    """
    for blocks in reversed(tiers):
        paths = blocks.join(paths, ["tree", "block"]).select("tree", "n", "items", "path").mapInArrow(_handed(levels), f"tree string, block long, {_PATH}")
    return paths


_OUT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _proven(levels: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _OUT.split(", ")]
        types = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                items, root = row["items"], row["root"]
                paths: list[Path] = [[] for _ in items]
                walk([x["digest"] for x in items], height_of(row["n"], levels), paths)
                above = [(x["before"], x["after"]) for x in row["path"]]
                out = []
                for item, path in zip(items, paths, strict=True):
                    path += above
                    again = folded(item["digest"] if item["changed"] is None else item["changed"], path)
                    proof = digest("".join(before + after for before, after in path))
                    out.append((item["doc_id"], item["digest"], row["subroot"], root, proof, again, again == root))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return run


# Rows --------------------------------------------------------------------------


def leaf(fields: list[Column]) -> Column:
    """SHA-256 of the fields, each as byte count, colon and value, or ``-`` for null."""
    written = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*written), 256)


def leaves(docs: DataFrame, tampered: Column, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text")) -> DataFrame:
    """(tree, doc_id, digest, changed): a row's leaf, and its tampered one's where the row is tampered with."""
    doc_id, source, _, _, text = columns
    other = [F.col(c) if c != text else ascii_lower(F.col(c)) for c in columns]
    return docs.select(
        F.coalesce(F.concat(F.lit("+"), F.col(source)), F.lit("")).alias("tree"),  # null first
        F.col(doc_id).cast("long").alias("doc_id"),
        leaf([F.col(c) for c in columns]).alias("digest"),
        F.when(tampered, leaf(other)).alias("changed"),
    )


def manifest(docs: DataFrame, tampered: Column, levels: int = 2, **options) -> DataFrame:
    """A row per row: doc_id, leaf, subroot, root, proof_sha256, and the root its (tampered) leaf folds to."""
    scraps = [store(leaves(docs, tampered, **options))]
    tiers, subroots = climb(positions(scraps[0], scraps, "tree", "doc_id", "digest"), scraps, levels, "doc_id", "changed")
    named = store(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"))
    upper, top = climb(positions(named, scraps, "tree", "name"), scraps, levels, "name")
    start = top.select("tree", F.lit(0).cast("long").alias("block"), F.array().cast("array<struct<before:string,after:string>>").alias("path"))
    paths = descend(tiers[1:], descend(upper, start, levels), levels)
    root = top.first()  # one row, or none of an empty table
    subroots = subroots.select("tree", F.col("digest").alias("subroot"), F.lit(root and root["digest"]).cast("string").alias("root"))
    out = store(tiers[0].join(paths, ["tree", "block"]).join(subroots, "tree").select("n", "items", "path", "subroot", "root").mapInArrow(_proven(levels), _OUT))
    discard(*scraps, named)
    return out


def one_in(doc_id: Column, share: int = 5) -> Column:
    """Whether ``share`` divides the crc32 of the id written as text; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % share == 0


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(documents(spark, sf_dir), one_in(F.col("doc_id")))


def _written(value: str) -> str:
    return f"coalesce(CAST(octet_length(encode({value})) AS VARCHAR) || ':' || {value}, '-')"


_HEAD = " || ".join(_written(f"CAST({c} AS VARCHAR)") for c in ("doc_id", "source", "lang", "n_chars"))
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BIT = "CASE WHEN {0} & 1 = 1 THEN xor({0} >> 1, 3988292384) ELSE {0} >> 1 END"
ORACLE = f"""
WITH RECURSIVE bits(b, i, c) AS (
  SELECT b, 0, b FROM range(256) t(b)
  UNION ALL SELECT b, i + 1, {_BIT.format("c")} FROM bits WHERE i < 8),
crc_of AS (SELECT b, c FROM bits WHERE i = 8),
crc(id, s, c) AS (
  SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR), CAST(4294967295 AS BIGINT) FROM documents WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT crc.id, substr(s, 2), xor(crc.c >> 8, k.c) FROM crc JOIN crc_of k ON k.b = xor(crc.c, CAST(ascii(s) AS BIGINT)) & 255 WHERE s <> ''),
leaves AS (
  SELECT coalesce('+' || source, '') AS tree, d.doc_id, sha256({_HEAD} || {_written("text")}) AS leaf,
         CASE WHEN xor(crc.c, 4294967295) % 5 = 0 THEN sha256({_HEAD} || {_written(_LOWER)}) END AS changed
  FROM documents d LEFT JOIN crc ON d.doc_id = crc.id AND crc.s = ''),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
nodes(tree, level, pos, digest) AS (
  SELECT tree, 0, pos, leaf FROM placed
  UNION ALL
  SELECT tree, level + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM nodes
  WHERE tree IN (SELECT tree FROM nodes GROUP BY tree HAVING count(*) > 1) GROUP BY tree, level, pos // 16),
tops AS (SELECT tree, level, digest AS subroot FROM (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY level DESC) AS r FROM nodes) WHERE r = 1),
named AS (SELECT *, row_number() OVER (ORDER BY tree) - 1 AS pos FROM tops),
above(level, pos, digest) AS (
  SELECT 0, pos, subroot FROM named
  UNION ALL
  SELECT level + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)) FROM above
  WHERE (SELECT count(*) FROM above) > 1 GROUP BY level, pos // 16),
best AS (SELECT level, digest AS root FROM above ORDER BY level DESC LIMIT 1),
beside AS (
  SELECT a.tree, a.level, a.pos,
         coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before,
         coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after
  FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.level = b.level AND a.pos // 16 = b.pos // 16 GROUP BY ALL
  UNION ALL
  SELECT NULL, a.level, a.pos,
         coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), ''),
         coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '')
  FROM above a JOIN above b ON a.level = b.level AND a.pos // 16 = b.pos // 16 GROUP BY ALL),
steps AS (
  SELECT p.tree, p.pos AS leaf_pos, s.level AS step, s.before, s.after
  FROM placed p JOIN tops t ON p.tree = t.tree JOIN beside s ON s.tree = p.tree AND s.level < t.level AND s.pos = p.pos // CAST(pow(16, s.level) AS BIGINT)
  UNION ALL
  SELECT p.tree, p.pos, 100 + s.level, s.before, s.after
  FROM placed p JOIN named n ON p.tree = n.tree CROSS JOIN best JOIN beside s ON s.tree IS NULL AND s.level < best.level AND s.pos = n.pos // CAST(pow(16, s.level) AS BIGINT)),
paths AS (
  SELECT tree, leaf_pos, sha256(string_agg(before || after, '' ORDER BY step)) AS proof,
         list(before ORDER BY step) AS before, list(after ORDER BY step) AS after FROM steps GROUP BY tree, leaf_pos),
folded(tree, pos, i, digest) AS (
  SELECT tree, pos, 0, coalesce(changed, leaf) FROM placed
  UNION ALL
  SELECT f.tree, f.pos, f.i + 1, sha256(s.before[f.i + 1] || f.digest || s.after[f.i + 1])
  FROM folded f JOIN paths s ON f.tree = s.tree AND f.pos = s.leaf_pos WHERE f.i < len(s.before)),
ended AS (SELECT tree, pos, arg_max(digest, i) AS digest FROM folded GROUP BY tree, pos)
SELECT p.doc_id, p.leaf, t.subroot, best.root, coalesce(s.proof, sha256('')) AS proof_sha256,
       e.digest AS folded_root, e.digest = best.root AS verified
FROM placed p JOIN tops t ON p.tree = t.tree CROSS JOIN best
LEFT JOIN paths s ON s.tree = p.tree AND s.leaf_pos = p.pos
JOIN ended e ON e.tree = p.tree AND e.pos = p.pos
"""
