"""Archives, journals and catalogs as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], time: str, tie: str, deleted: Column) -> DataFrame:
    """The newest row of each key, ties to the greater ``tie``; keys whose newest is a deletion go."""
    order = Window.partitionBy(*keys).orderBy(F.desc(time), F.desc(tie))
    return df.withColumn("__rk", F.row_number().over(order)).where("__rk = 1").drop("__rk").where(~deleted)


def layered_lookup(df: DataFrame, keys: list[str], level: str, time: str, tie: str) -> DataFrame:
    """The row of each key in the youngest level that has it."""
    order = Window.partitionBy(*keys).orderBy(level, F.desc(time), F.desc(tie))
    return df.withColumn("__rk", F.row_number().over(order)).where("__rk = 1").drop("__rk")


def running_offsets(df: DataFrame, by: list[str], order: list[str], size: str, start: str = "start") -> DataFrame:
    """Where each row begins when rows are laid end to end in order."""
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(start, F.coalesce(F.sum(size).over(before), F.lit(0)))


def merkle_level(df: DataFrame, tree: list[str], index: str, digest: str) -> DataFrame:
    """Parents of a level: SHA-256 of two children's digests; an odd last one is paired with itself."""
    pair = df.select(*tree, F.floor(F.col(index) / 2).cast("long").alias(index), (F.col(index) % 2).alias("side"), F.col(digest).alias("d"))
    both = pair.groupBy(*tree, index).agg(F.max(F.when(F.col("side") == 0, F.col("d"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("d"))).alias("r"))
    return both.select(*tree, index, F.sha2(F.concat("l", F.coalesce("r", "l")), 256).alias(digest))


def merkle_roots(leaves: DataFrame, tree: list[str], index: str, digest: str) -> DataFrame:
    """A root per tree; the number of levels follows the largest index."""
    top = leaves.agg(F.max(index)).first()[0]
    level, n = leaves, int(top or 0) + 1
    while n > 1:
        level, n = merkle_level(level, tree, index, digest), (n + 1) // 2
    # a tree smaller than the largest one pairs its root with itself on the way up
    return level.select(*tree, F.col(digest).alias("root"))


def block_offsets(df: DataFrame, by: list[str], order: list[str], size: str) -> DataFrame:
    """Offset, size and ordinal of each block in its file."""
    out = running_offsets(df, by, order, size, "offset")
    return out.withColumn("block", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def synthesis_queue(pending: DataFrame, block: list[str], entry_bytes: int = 16) -> DataFrame:
    """Pending journal entries of each block and their size."""
    return pending.groupBy(*block).agg(F.count(F.lit(1)).alias("entries"), (F.count(F.lit(1)) * entry_bytes).alias("bytes"))


def interleave(rows: Column, depth: int) -> Column:
    """Column-wise reading of an array laid out in ``depth`` rows; a shorter last row leaves gaps out."""
    width = F.ceil(F.size(rows) / depth).cast("int")
    order = F.flatten(F.transform(F.sequence(F.lit(0), width - 1), lambda c: F.transform(F.sequence(F.lit(0), F.lit(depth - 1)), lambda r: r * width + c)))
    inside = F.filter(order, lambda i: i < F.size(rows))
    return F.when(F.size(rows) == 0, rows).otherwise(F.transform(inside, lambda i: F.get(rows, i)))


def stride_positions(n: Column, stride: int) -> Column:
    """The permutation i -> i*stride mod n (a bijection where stride and n have no common factor)."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: (i.cast("long") * stride) % n)


def xor_parity(df: DataFrame, by: list[str], payload: str) -> DataFrame:
    """(by, pos, parity): XOR of the rows' bytes at each position."""
    pairs = F.regexp_extract_all(F.hex(F.col(payload).cast("binary")), F.lit("(..)"), F.lit(1))
    rows = df.select(*by, F.posexplode(pairs).alias("pos", "h"))
    return rows.groupBy(*by, "pos").agg(F.bit_xor(F.conv("h", 16, 10).cast("long")).alias("parity"))
