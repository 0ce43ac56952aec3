"""Document fingerprints: a Merkle tree over words, paragraphs and sections.

Leaves are the words with the white space that follows them. A node at level k ends after a
word whose local context (a hash of it and its three predecessors) has k trailing zero bits;
a line end counts as three more. So borders move only near an edit, and each level groups
the nodes below it: paragraphs over words, sections over paragraphs. A node's digest hashes
its children's digests in order. The fingerprint writes down

    root (32 hex digits of SHA-256 over the whole text) : level : nodes of that level

where the level is the finest with at most ``most_nodes`` (64) nodes, so its size is bounded
whatever the text's. Equal roots mean equal texts. Two trees written at different levels are
brought to the coarser one, which the finer one's nodes determine; the nodes they share then
say how alike the texts are (Dice coefficient of the node multisets), and the others locate
the edits (``differing``).

``edited`` rows: a document's last third is replaced by the start of the next document in
descending order of ids. Documents are dealt by ranges of ids; each range also gets the first
rows of the one below it, so neighbours meet without a global sort in one task.

Defined cases: a null text is an empty one; the empty text has a root and no nodes; two empty
texts are alike (1.0); null ids come last; rows with the same id are ordered by their text;
a table of one row is its own neighbour; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Powers, documents, mix64, quantiles, rolling, span_hashes, word_spans

_DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"
_BYTES, _CONTEXT, _CHILDREN = Powers(0x2545F4914F6CDD1D), Powers(0x5851F42D4C957F2D), Powers(0x369DEA0F31A53F85)


@dataclass
class Tree:
    root: str
    level: int
    digests: np.ndarray  # of the nodes at `level`
    heights: np.ndarray  # the highest level at which each of them ends a node

    def text(self) -> str:
        nodes = "".join(f"{int(d):016x}{_DIGITS[h]}" for d, h in zip(self.digests, self.heights, strict=True))
        return f"{self.root}:{_DIGITS[self.level]}:{nodes}"

    @staticmethod
    def parse(text: str) -> Tree:
        root, level, nodes = text.split(":")
        parts = [nodes[i : i + 17] for i in range(0, len(nodes), 17)]
        return Tree(root, _DIGITS.index(level), np.array([int(p[:16], 16) for p in parts], np.uint64), np.array([_DIGITS.index(p[16]) for p in parts], np.int64))

    def raised(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        digests, heights = self.digests, self.heights
        for k in range(self.level + 1, level + 1):
            digests, heights = _parents(digests, heights, k)
        return digests, heights


def _parents(digests: np.ndarray, heights: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    if not len(digests):
        return digests, heights
    last = np.flatnonzero(heights >= level)
    if not len(last) or last[-1] != len(heights) - 1:
        last = np.append(last, len(heights) - 1)
    first = np.empty_like(last)
    first[0], first[1:] = 0, last[:-1] + 1
    up, down = _CHILDREN.get(len(digests) + 1)
    total = np.zeros(len(digests) + 1, np.uint64)
    np.cumsum(digests * up[: len(digests)], out=total[1:])
    return mix64((total[last + 1] - total[first]) * down[first] + (last - first + 1).astype(np.uint64)), heights[last]


def tree(data: bytes, most_nodes: int = 64) -> Tree:
    """The tree of a text's UTF-8 bytes."""
    root = hashlib.sha256(data).hexdigest()[:32]
    if not data:
        return Tree(root, 0, np.zeros(0, np.uint64), np.zeros(0, np.int64))
    raw = np.frombuffer(data, np.uint8)
    starts, ends = word_spans(raw)
    if not len(starts):
        starts, ends = np.array([0]), np.array([len(raw)])
    borders = np.append(starts, len(raw))
    borders[0] = 0
    words = span_hashes(raw, starts, ends, _BYTES)
    digests = span_hashes(raw, borders[:-1], borders[1:], _BYTES)
    context = words.copy()
    if len(words) >= 4:
        context[3:] = rolling(words, 4, _CONTEXT)
    low = context & (~context + np.uint64(1))
    heights = np.minimum(np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64), 28)
    heights[1:][context[1:] == context[:-1]] = 0  # a run of one word has its borders at its ends only
    lines = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(raw == 10, out=lines[1:])
    heights += 3 * (lines[borders[1:]] > lines[ends])
    level = 0
    while len(digests) > most_nodes and level < 32:
        level += 1
        digests, heights = _parents(digests, heights, level)
    return Tree(root, level, digests, np.minimum(heights, 35))


def likeness(a: Tree, b: Tree) -> float:
    """Share of nodes in common, 0 to 1."""
    if a.root == b.root:
        return 1.0
    level = max(a.level, b.level)
    left, right = a.raised(level)[0], b.raised(level)[0]
    if not len(left) or not len(right):
        return 0.0
    shared = sum((Counter(left.tolist()) & Counter(right.tolist())).values())
    return 2.0 * shared / (len(left) + len(right))


def differing(a: Tree, b: Tree) -> list[int]:
    """Positions of the first tree's nodes, at the common level, that the second lacks."""
    level = max(a.level, b.level)
    left, right = a.raised(level)[0].tolist(), Counter(b.raised(level)[0].tolist())
    out = []
    for i, digest in enumerate(left):
        if right[digest] > 0:
            right[digest] -= 1
        else:
            out.append(i)
    return out


def edited_text(text: str, following: str) -> str:
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", most_nodes: int = 64) -> DataFrame:
    """A row per document: its fingerprint, its edited text's, and how alike they are."""
    lowest = -(1 << 63)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("t"))
    rows = rows.withColumn("key", F.coalesce("doc_id", F.lit(lowest)))
    ids = rows.select("key")
    parts = max(1, docs.rdd.getNumPartitions())
    ranges = 4 * parts
    cuts = quantiles(ids, "key", ranges)
    if cuts:
        bound = F.array(*[F.lit(float(c)) for c in cuts])
        bucket = F.size(F.filter(bound, lambda c: c <= F.col("key").cast("double")))
    else:
        bucket = F.lit(0)
    tops = {r["bucket"]: r["top"] for r in ids.select(bucket.alias("bucket"), "key").groupBy("bucket").agg(F.max("key").alias("top")).collect()}
    order = sorted(tops)
    # the row after a range's last is the highest of the range below; after all, the highest
    halo = {tops[order[i - 1]]: b for i, b in enumerate(order)}
    dealt = rows.withColumn("bucket", bucket)
    if halo:
        table = docs.sparkSession.createDataFrame([(k, b) for k, b in halo.items()], "hkey long, hbucket int")
        dealt = dealt.join(F.broadcast(table), dealt["key"] == table["hkey"], "left")
        own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("halo"))
        extra = F.struct(F.col("hbucket").alias("bucket"), F.lit(True).alias("halo"))
        both = F.when(F.col("hbucket").isNull(), F.array(own)).otherwise(F.array(own, extra))
        dealt = dealt.select("doc_id", "key", "t", F.explode(both).alias("d")).select("doc_id", "key", "t", "d.bucket", "d.halo")
    else:
        dealt = dealt.withColumn("halo", F.lit(False))
    dealt = dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", "halo", F.desc("key"), "t")

    def run(batches):
        before = None
        out: list[tuple] = []

        def flush():
            columns = list(zip(*out, strict=True)) or [()] * 7
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            names = [f.split()[0] for f in _OUT.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for batch in batches:
            for doc_id, text, bucket, halo in zip(*(batch.column(i) for i in range(4)), strict=True):
                text, bucket = text.as_py(), bucket.as_py()
                now = (doc_id.as_py(), text, bucket, halo.as_py(), tree(text.encode(), most_nodes))
                if before is not None and before[2] == bucket and not before[3]:
                    changed = edited_text(before[1], text).encode()
                    new = tree(changed, most_nodes)
                    out.append((before[0], len(before[1]), hashlib.sha256(changed).hexdigest(), before[4].text(), new.text(), likeness(before[4], new), likeness(before[4], now[4])))
                    if len(out) >= 500:
                        yield flush()
                        out = []
                before = now
        if out:
            yield flush()

    return dealt.select("doc_id", "t", "bucket", "halo").mapInArrow(run, _OUT)


def op10_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))
