"""Queries over files that many tasks read: FASTQ and BAM by byte ranges, features by region.

Each writes a table of the given ones in the format, with Spark, and reads it in small splits.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators.bases import dna
from ..session import table
from ..sources import readers, tabix
from ..streaming import streams
from ..streaming.streams import scratch
from .base import dna_sql, query

SPLIT = 64 << 10


@query("fastq_splits", f"SELECT 'd' || doc_id AS id, length(dna) AS n, md5(dna) AS digest, length(dna) * 7 AS quality FROM (SELECT doc_id, coalesce({dna_sql('text')}, '') AS dna FROM documents) WHERE dna <> ''")
def fastq_splits(spark, sf):
    readers.register(spark)
    path = scratch(spark)
    rows = table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), dna("text").alias("sequence")).where("sequence <> ''")
    rows.withColumn("quality", F.array_repeat(F.lit(7), F.length("sequence"))).write.format("fastq").mode("append").save(path)
    back = spark.read.format("fastq").option("splitBytes", SPLIT).load(path)
    return back.select("id", F.length("sequence").cast("long").alias("n"), F.md5(F.col("sequence").cast("binary")).alias("digest"), F.aggregate("quality", F.lit(0).cast("long"), lambda a, q: a + q).alias("quality"))


@query("bam_splits", f"SELECT 'd' || doc_id AS qname, lang AS rname, CAST(doc_id + 1 AS INT) AS pos, CAST(length(dna) AS VARCHAR) || 'M' AS cigar, md5(dna) AS digest FROM (SELECT doc_id, lang, {dna_sql('text')} AS dna FROM documents WHERE lang IN ('de', 'en', 'es', 'fr')) WHERE dna <> ''")
def bam_splits(spark, sf):
    readers.register(spark)
    path = scratch(spark)
    rows = table(spark, sf, "documents").where(F.col("lang").isin("de", "en", "es", "fr"))
    rows = rows.select(F.concat(F.lit("d"), "doc_id").alias("qname"), F.col("lang").alias("rname"), (F.col("doc_id") + 1).cast("int").alias("pos"), S.bytes_to_dna("text").alias("seq"), F.lit(None).cast("string").alias("qual"))
    rows.where("seq <> ''").write.format("bam").mode("append").option("references", ",".join(f"{n}:500000000" for n in ("de", "en", "es", "fr"))).save(path)
    back = spark.read.format("bam").option("splitBytes", SPLIT).load(path)
    return back.select("qname", "rname", "pos", "cigar", F.md5(F.col("seq").cast("binary")).alias("digest"))


_FEATURES = "SELECT 'chr' || l_linenumber AS chrom, (l_partkey * 7919 + l_suppkey * 104729) % 400000000 AS start, CAST(l_quantity AS BIGINT) * CASE WHEN l_returnflag = 'R' THEN 9000 ELSE 20 END AS size, l_orderkey FROM lineitem"
REGIONS = (("chr3", 0, 1_000_000), ("3", 60_000_000, 61_000_000), ("chr1", 100_000_000, 160_000_000), ("9", 5, 99))


@query(
    "region_scan",
    " UNION ALL ".join(
        f"SELECT '{c}:{s}' AS region, count(*) AS n, coalesce(CAST(sum(start) AS BIGINT), 0) AS starts, count(DISTINCT l_orderkey) AS orders FROM ({_FEATURES}) WHERE chrom IN ('{c}', 'chr{c}') AND start < {e} AND start + size > {s}" for c, s, e in REGIONS
    ),
)
def region_scan(spark, sf):
    """Every line item as a feature, written by place with an index; then four regions, by name with and without chr."""
    readers.register(spark)
    path = scratch(spark)
    rows = table(spark, sf, "lineitem")
    size = F.col("l_quantity").cast("long") * F.when(F.col("l_returnflag") == "R", 9000).otherwise(20)
    rows = rows.select(F.concat(F.lit("chr"), "l_linenumber").alias("chrom"), ((F.col("l_partkey") * 7919 + F.col("l_suppkey") * 104729) % 400_000_000).alias("start"), size.alias("size"), "l_orderkey")
    tabix.write_indexed(rows.select("chrom", "start", (F.col("start") + F.col("size")).alias("end"), F.array(F.col("l_orderkey").cast("string")).alias("fields")), path)
    out = None
    for chrom, start, end in REGIONS:
        found = tabix.region(spark, path, chrom, start, end, splitBytes=SPLIT).select("start", F.col("fields")[3].alias("order"))
        one = found.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("start"), F.lit(0)).alias("starts"), F.countDistinct("order").alias("orders")).select(F.lit(f"{chrom}:{start}").alias("region"), "n", "starts", "orders")
        out = one if out is None else out.unionByName(one)
    return out


_DONE = "SELECT user_id, event_id, ts, dense_rank() OVER w AS seen, row_number() OVER w AS rk FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"


@query("stream_completion", f"SELECT user_id, 5 AS pieces, CAST(min(rk) AS BIGINT) AS reads FROM (SELECT *, len(list_distinct(list(event_id % 7) OVER (PARTITION BY user_id ORDER BY ts, event_id))) AS found FROM ({_DONE})) WHERE found >= 5 GROUP BY user_id")
def stream_completion(spark, sf):
    """A user's events are pieces (id modulo 7) of a file that needs five; each user that gets them is told once."""
    events = streams.event_stream(spark, f"{sf}/events.parquet", 1000).select("user_id", (F.col("event_id") % 7).alias("piece"), "ts", F.lit(5).cast("long").alias("needed"))
    found = streams.completion(events, "user_id", "piece", "ts", "needed", "3650 days")
    return streams.drain(found).where("outcome = 'complete'").select("user_id", F.col("pieces").cast("int").alias("pieces"), "reads")
