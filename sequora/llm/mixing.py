"""Mixing sources to target weights by hash-random order and exact cuts.

Every document gets a hash-random key. Within its source, documents are range-sorted by the
key: the key's leading bits name one of 4096 equal ranges (cells) of a source, so a source
that holds a third of all rows is spread over 4096 sort groups. Prefix sums are distributed:
one sum per cell, a running sum over a source's cells, and a running sum inside each cell.
Each source is cut at its exact budget; a budget beyond one pass repeats whole epochs first.

Targets: sources in code-point order, null last, weigh 3, 1, 2 repeating; together they get
``share`` times all words; a target stops at ``most_epochs`` times its source's words and the
excess is shared again by weight until none is above. That is water filling: every target is
min(weight * level, cap), and the level is found from sums over sources sorted by cap/weight.

Defined cases: null text has size 0; a null source is a source of its own, last in order;
sources without words have target 0; repeated rows are rows of their own; ties of the key are
ordered by id and size; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, documents, free_names, own_columns, settle

WEIGHTS = (3, 1, 2)


def word_count(column: str = "text"):
    """Words of a text: a word starts where a non-space follows a space or the start."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.5, most_epochs: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(absent, name, source_size, target) from (absent, name, source_size), a row a source.

    One row per source passes through one task; the rows of documents never do.
    """
    order = Window.orderBy("absent", "name")
    ranked = sizes.withColumn("__rank", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("__rank") % len(weights) + 1).cast("int")).cast("double")
    capped = ranked.withColumn("w", weight).withColumn("cap", (F.col("source_size") * most_epochs).cast("double"))
    whole = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "absent", "name")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.lit(share) * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    )
    filled = capped.withColumn("__level", level)
    # a source is capped while the level that is left at its turn reaches its ratio
    open_level = F.min(F.when(F.col("__level") * F.col("w") < F.col("cap"), F.struct(F.col("cap") / F.col("w"), F.col("absent"), F.col("name"), F.col("__level").alias("l")))).over(whole)["l"]
    target = F.when(open_level.isNull(), F.col("cap")).otherwise(F.least("cap", F.col("w") * open_level))
    return filled.select("absent", "name", "source_size", target.alias("target"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken (words taken, repeats counted), a row a row."""
    return _taken(docs, **options).select("doc_id", "size", "source_size", "target", "taken")


def _taken(docs: DataFrame, seed: int = 42, share: float = 1.5, most_epochs: int = 2, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """mix's columns, the source, the number of whole epochs, and a tag that tells texts apart."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit("null"))).cast("binary"))
    rows = settle(
        docs.select(
            F.col(id_column).alias("doc_id"),
            F.col(source_column).isNull().alias("absent"),
            F.coalesce(F.col(source_column), F.lit("")).alias("name"),
            word_count(text_column).alias("size"),
            key.alias("key"),
            F.xxhash64(text_column).alias("tag"),
        ).withColumn("cell", F.substring("key", 1, 3))
    )
    cells = rows.groupBy("absent", "name", "cell").agg(F.sum("size").alias("cell_size"))
    targets = source_targets(cells.groupBy("absent", "name").agg(F.sum("cell_size").alias("source_size")), share, most_epochs)
    earlier = Window.partitionBy("absent", "name").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        cells.withColumn("start", F.coalesce(F.sum("cell_size").over(earlier), F.lit(0)))
        .join(targets, ["absent", "name"])
        .select("absent", "name", "cell", "start", "source_size", "target")
    )
    inside = Window.partitionBy("absent", "name", "cell").orderBy("key", "doc_id", "size", "tag").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    budget = F.floor(F.col("target") + 0.5).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    placed = (
        rows.join(starts, ["absent", "name", "cell"])
        .withColumn("before", F.col("start") + F.sum("size").over(inside) - F.col("size"))
        .withColumn("epochs", epochs)
        .withColumn("rest", budget - F.col("epochs") * F.col("source_size"))
    )
    cut = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    taken = (F.col("size") * F.col("epochs") + cut).cast("long")
    return placed.select("doc_id", "absent", "name", "size", "tag", "source_size", "target", "epochs", taken.alias("taken"))


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: whole documents once an epoch, and the document at the cut cut at its word.

    Columns are those of ``docs``, whatever they are called; n_chars, where there is one, follows a
    cut text. Of rows alike in id, source and text, as many are taken as the budget has room for;
    a source's cut goes through one such group at most, and only that group is numbered.
    """
    text, key, source = (options.get(k, v) for k, v in (("text_column", "text"), ("id_column", "doc_id"), ("source_column", "source")))
    size, tag, copy, rank, head = free_names(docs, "size", "tag", "copy", "rank", "head")
    into = free_names(docs, "id", "absent", "name", "words", "hash", "epochs", "rest", "rows")
    to_id, absent, name, words, hashed, epochs, rest, count = into
    same = ["doc_id", "absent", "name", "size", "tag", "epochs"]
    sums = _taken(docs, **options).groupBy(*same).agg(F.sum(F.col("taken") - F.col("size") * F.col("epochs")).alias("rest"), F.count(F.lit(1)).alias("rows")).toDF(*into)
    sums = settle(sums.where((F.col(words) > 0) & ((F.col(epochs) > 0) | (F.col(rest) > 0))))
    joined = docs.select("*", word_count(text).alias(size), F.xxhash64(text).alias(tag)).join(
        sums,
        F.col(key).eqNullSafe(F.col(to_id)) & (F.col(source).isNull() == F.col(absent)) & (F.coalesce(F.col(source), F.lit("")) == F.col(name)) & (F.col(size) == F.col(words)) & (F.col(tag) == F.col(hashed)),
    )
    cut_group = (F.col(count) > 1) & (F.col(rest) > 0) & (F.col(rest) < F.col(words) * F.col(count))
    if sums.where(cut_group).isEmpty():
        ranked = joined.withColumn(rank, F.lit(0))
    else:
        order = Window.partitionBy(to_id, absent, name, words, hashed).orderBy(text)
        ranked = joined.where(~cut_group).withColumn(rank, F.lit(0)).unionByName(joined.where(cut_group).withColumn(rank, F.row_number().over(order) - 1))
    part = F.greatest(F.lit(0), F.least(F.col(words), F.col(rest) - F.col(rank) * F.col(words))).cast("int")
    copies = F.when(F.col(epochs) > 0, F.sequence(F.lit(1), F.col(epochs).cast("int"))).otherwise(F.array().cast("array<int>"))
    more = F.when(part == F.col(words), F.array(F.col(epochs).cast("int") + 1)).when(part > 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    each = ranked.withColumn(head, part).withColumn(copy, F.explode(F.concat(copies, more)))
    begun = F.array_join(F.slice(F.regexp_extract_all(F.col(text), F.lit(f"({WORD})"), F.lit(1)), F.lit(1), F.greatest(F.col(head), F.lit(1))), " ")
    out = each.withColumn(text, F.when(F.col(copy) == 0, begun).otherwise(F.col(text)))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(copy) == 0, F.length(text).cast("long")).otherwise(F.col("n_chars")))
    return out.select(*own_columns(docs))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


ORACLE = r"""
WITH s AS (
  SELECT doc_id, source IS NULL AS absent, coalesce(source, '') AS name,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('42:' || CAST(doc_id AS VARCHAR)) AS key
  FROM documents),
src AS (SELECT absent, name, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY absent, name),
ranked AS (
  SELECT *, CAST(([3, 1, 2])[(row_number() OVER (ORDER BY absent, name) - 1) % 3 + 1] AS DOUBLE) AS w,
         CAST(source_size * 2 AS DOUBLE) AS cap FROM src),
lev AS (
  SELECT *,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, absent, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, absent, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS l
  FROM ranked),
t AS (
  SELECT absent, name, source_size,
    CASE WHEN (SELECT count(*) FROM lev WHERE l * w < cap) = 0 THEN cap
         ELSE least(cap, w * (SELECT l FROM lev WHERE l * w < cap ORDER BY cap / w, absent, name LIMIT 1)) END AS target
  FROM lev),
p AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
    CAST(sum(s.size) OVER (PARTITION BY s.absent, s.name ORDER BY s.key, s.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - s.size AS before,
    CAST(floor(t.target + 0.5) AS BIGINT) AS budget
  FROM s JOIN t ON s.absent = t.absent AND s.name = t.name),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p)
SELECT doc_id, size, source_size, target,
       CAST(size * epochs + greatest(0, least(size, budget - epochs * source_size - before)) AS BIGINT) AS taken
FROM e
"""
