"""Exact deduplication, all in DataFrame expressions.

Two texts are equal when they agree after every character of ``[\\x20\\x09-\\x0D]`` is
deleted. Rows are grouped by a 128-bit hash of that normalised text *and* the text itself,
so the aggregation compares bytes inside a hash group and a collision yields two groups.
Copies collapse on the map side (partial aggregation): a group that holds a third of all
rows arrives as one row per map task. Members then look up their group by (hash, SHA-256);
only groups of two or more are joined, and the skewed side of that join carries ids and
digests, never texts, so adaptive execution can split it.

Defined cases: a null text is an empty one; empty and white-space-only texts form one group;
ties go to the smallest id, a null id last; repeated rows of one id all carry the id that
stays (``unique_rows`` leaves one of them); extra columns are ignored by ``exact_groups``
and returned unchanged by ``unique_rows``; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE, documents, free_names, own_columns, settle


def _keyed(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(F.col(id_column).alias("doc_id"), F.length(text).alias("n"), F.regexp_replace(text, SPACE, "").alias("norm"))
    return rows.select("doc_id", "n", "norm", F.unhex(F.md5("norm")).alias("h"), F.sha2("norm", 256).alias("text_sha256"))


def _groups(keyed: DataFrame) -> DataFrame:
    best = F.min(F.struct((-F.col("n")).alias("less"), F.col("doc_id").isNull().alias("absent"), F.col("doc_id").alias("doc_id")))
    return (
        keyed.groupBy("h", "norm")
        .agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
        .select("h", F.sha2("norm", 256).alias("text_sha256"), F.col("best.doc_id").alias("keep_id"), "group_size")
    )


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    keyed = _keyed(docs, id_column, text_column)
    many = _groups(keyed).where("group_size > 1")
    joined = keyed.drop("norm", "n").join(many, ["h", "text_sha256"], "left")
    found = F.col("group_size").isNotNull()
    return joined.select(
        "doc_id",
        F.when(found, F.col("keep_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.when(found, F.col("doc_id").eqNullSafe(F.col("keep_id"))).otherwise(True).alias("kept"),
        "text_sha256",
    )


def unique_rows(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever these are called.

    Only the ids to drop travel to the rows. Of repeated rows of the id that stays, one of the
    longest text stays. A very long text is hashed where it lies.
    """
    key, sha, rank, lost, lost_sha = free_names(docs, "key", "sha", "rank", "lost", "lostsha")
    groups = settle(exact_groups(docs, id_column, text_column))
    kept = groups.where("kept")
    dropped = groups.where("not kept").select(F.col("doc_id").alias(lost), F.col("text_sha256").alias(lost_sha)).distinct()
    repeated = kept.where("group_size > 1").groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    text = F.coalesce(F.col(text_column), F.lit(""))
    marked = docs.select("*", F.sha2(F.regexp_replace(text, SPACE, ""), 256).alias(sha), F.col(id_column).alias(key))
    same = F.col(key).eqNullSafe(F.col(lost)) & (F.col(sha) == F.col(lost_sha))
    stay = marked.join(dropped, same, "left_anti")
    if not repeated.isEmpty():
        twice = repeated.select(F.col("doc_id").alias(lost), F.col("text_sha256").alias(lost_sha))
        first = Window.partitionBy(key, sha).orderBy(F.length(text).desc(), text)
        # ranks of at most 1 are cut in every task before the shuffle, so a large group is one row a task
        again = stay.join(twice, same, "left_semi").withColumn(rank, F.row_number().over(first)).where(F.col(rank) == 1).drop(rank)
        stay = stay.join(twice, same, "left_anti").unionByName(again)
    return stay.select(*own_columns(docs))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


ORACLE = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
r AS (
  SELECT doc_id, norm,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM n)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size,
       doc_id = keep_id AS kept, sha256(norm) AS text_sha256
FROM r
"""
