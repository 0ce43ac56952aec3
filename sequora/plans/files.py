"""Queries on file formats, structure scans and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import structure as T
from ..sources import formats as X
from ..sources import readers as R
from ..session import table
from ..streaming import streams
from .base import dna_sql, query

REFS = f"SELECT item_id, {dna_sql('text')} AS dna FROM benchmark"


def references(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", S.bytes_to_dna("text").alias("dna"))


@query("fastq_parse", f"SELECT 'r' || item_id AS id, length(dna) AS n, md5(dna) AS digest FROM ({REFS})")
def fastq_parse(spark, sf):
    quality = F.array_join(F.transform(F.split("dna", ""), lambda c: F.lit("I")), "")
    files = references(spark, sf).select(F.concat(F.lit("noise\n@r"), F.col("item_id").cast("string"), F.lit("\n"), "dna", F.lit("\n+\n"), quality, F.lit("\n")).alias("f"))
    rows = R.parse_column(files, "f", "fastq")
    return rows.select("id", F.length("sequence").cast("long").alias("n"), F.md5(F.col("sequence").cast("binary")).alias("digest"))


@query("fasta_roundtrip", f"SELECT 'item_' || item_id AS header, md5(dna) AS digest FROM ({REFS})")
def fasta_roundtrip(spark, sf):
    lines = F.array_join(S.chunks("dna", 70), "\n")
    files = references(spark, sf).select(F.concat(F.lit(">item_"), F.col("item_id").cast("string"), F.lit("\n"), lines, F.lit("\n")).alias("f"))
    return R.parse_column(files, "f", "fasta").select("header", F.md5(F.col("sequence").cast("binary")).alias("digest"))


@query("sam_parse", f"SELECT 'q' || item_id AS qname, CAST(item_id % 4096 AS INT) AS flag, CAST(item_id * 10 + 1 AS INT) AS pos, length(dna) AS n FROM ({REFS})")
def sam_parse(spark, sf):
    row = F.concat_ws("\t", F.concat(F.lit("q"), F.col("item_id").cast("string")), (F.col("item_id") % 4096).cast("string"), F.lit("chr1"), (F.col("item_id") * 10 + 1).cast("string"), F.lit("60"), F.lit("*"), F.lit("*"), F.lit("0"), F.lit("0"), "dna", F.lit("*"), F.lit("NM:i:0"))
    files = references(spark, sf).select(F.concat(F.lit("@HD\tVN:1.6\n"), row, F.lit("\nshort\tline\n")).alias("f"))
    return R.parse_column(files, "f", "sam").select("qname", "flag", "pos", F.length("seq").cast("long").alias("n"))


@query("vcf_parse", "SELECT CAST(p_partkey AS BIGINT) AS pos, CAST(p_size AS VARCHAR) AS dp, 'true' AS flag, p_retailprice AS qual FROM part")
def vcf_parse(spark, sf):
    row = F.concat_ws("\t", F.lit("chr1"), F.col("p_partkey").cast("string"), F.lit("."), F.lit("A"), F.lit("C"), F.col("p_retailprice").cast("string"), F.lit("PASS"), F.concat(F.lit("DP="), F.col("p_size").cast("string"), F.lit(";DB")))
    files = table(spark, sf, "part").select(F.concat(F.lit("##fileformat=VCFv4.2\n"), row, F.lit("\n")).alias("f"))
    return R.parse_column(files, "f", "vcf").select("pos", F.col("info")["DP"].alias("dp"), F.col("info")["DB"].alias("flag"), "qual")


@query("fai_region", f"SELECT item_id, substr(dna, 11, 100) AS bases FROM ({REFS})")
def fai_region(spark, sf):
    """Bases 10 to 110 of each reference, cut from a wrapped file by index arithmetic."""
    width, start, end = 61, 10, 110
    files = references(spark, sf).select("item_id", F.length("dna").alias("n"), F.array_join(S.chunks("dna", width - 1), "\n").alias("f"))
    stop = F.least(F.lit(end), F.col("n"))
    place = lambda i: F.floor(i / (width - 1)) * width + i % (width - 1)
    cut = F.col("f").substr((place(F.lit(start)) + 1).cast("int"), (place(stop - 1) - place(F.lit(start)) + 1).cast("int"))
    return files.select("item_id", F.when(stop > start, F.regexp_replace(cut, "\n", "")).otherwise("").alias("bases"))


@query("bam_roundtrip", f"SELECT 'r' || item_id AS qname, md5(dna) AS digest, CAST(length(dna) AS VARCHAR) || 'M' AS cigar FROM ({REFS})")
def bam_roundtrip(spark, sf):
    from ..operators import codecs as C

    def write(raw):
        name, dna = raw.decode().split(" ")
        return (X.bam_bytes([("chr1", 10**6)], [(name, 0, 0, 5, dna, "I" * len(dna))]),)

    files = C.apply(references(spark, sf).select("item_id", F.concat(F.lit("r"), F.col("item_id").cast("string"), F.lit(" "), "dna").alias("p")), ["item_id"], "p", write, "f binary")
    rows = R.parse_column(files, "f", "bam")
    return rows.select("qname", F.md5(F.col("seq").cast("binary")).alias("digest"), "cigar")


@query("archive_roundtrip", "SELECT doc_id, true AS ok FROM documents")
def archive_roundtrip(spark, sf):
    from ..operators import codecs as C

    def run(data):
        blocks = [data[i : i + 1024] for i in range(0, len(data), 1024)]
        back = list(X.sqar(X.sqar_bytes(blocks)))
        return (b"".join(r[3] for r in back) == data and [r[1] for r in back] == list(range(0, len(data), 1024)),)

    return C.apply(table(spark, sf, "documents"), ["doc_id"], "text", run, "ok boolean")


@query("hairpin_scan")
def hairpin_scan(spark, sf):
    return T.scan(references(spark, sf), "item_id", "dna", T.hairpins, "start long, stem long, loop long, tm double")


@query("orf_scan")
def orf_scan(spark, sf):
    return T.scan(references(spark, sf), "item_id", "dna", lambda s: T.reading_frames(s, 10), "frame long, start long, stop long, codons long")


@query(
    "stream_tumbling",
    """SELECT start, n FROM (SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) // 1000000 AS start, count(*) AS n FROM events GROUP BY 1)
    WHERE start + 3600 <= (SELECT epoch_us(max(ts)) / 1e6 - 600 FROM events)""",
)
def stream_tumbling(spark, sf):
    """Hourly counts of the event stream that the watermark has closed."""
    w = streams.tumbling(streams.event_stream(spark, f"{sf}/events.parquet"))
    return streams.drain(w).select(F.unix_seconds(F.col("window.start").cast("timestamp")).alias("start"), "n")


@query("stream_accumulate", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rk FROM events) WHERE rk <= 10")
def stream_accumulate(spark, sf):
    """The stateful stream's first ten events a user; equal to the batch query on one micro-batch."""
    s = streams.event_stream(spark, f"{sf}/events.parquet", 1000)
    return streams.drain(streams.capped_reads(s, "user_id", "ts", "event_id")).select("user_id", "event_id")


@query("stream_journal", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rk FROM events) WHERE rk = 1 AND event_id % 5 <> 0")
def stream_journal(spark, sf):
    """A journal fed by foreachBatch and compacted; every fifth event deletes its key."""
    journal = streams.Journal(spark, ["user_id", "event_type"], ["ts", "event_id"], "deleted")
    s = streams.event_stream(spark, f"{sf}/events.parquet").withColumn("deleted", F.col("event_id") % 5 == 0)
    q = s.writeStream.foreachBatch(lambda df, e: journal.append(df, e)).option("checkpointLocation", f"{journal.base}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    journal.compact()
    return journal.latest().select("user_id", "event_type", "event_id")
