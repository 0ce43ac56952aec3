import pytest
from pyspark.sql import functions as F

from sequora.sources import formats as X
from sequora.sources import readers as R
from sequora.streaming import streams


def test_fastq_recovers_after_noise():
    text = "junk\n@a\nACGT\n+\nIIII\nmore junk\n@b\nGG\n+\n!!\n"
    assert list(X.fastq(text.splitlines())) == [("a", "ACGT", [40] * 4), ("b", "GG", [0, 0])]


def test_vcf_flags_and_missing_quality():
    (row,) = X.vcf(["##x", "1\t7\t.\tA\tC\t.\tPASS\tDP=3;DB", "bad\tline"])
    assert row[7] == {"DP": "3", "DB": "true"} and row[5] != row[5]


def test_fai_slices_clamp():
    body = b">x\nACGTA\nCGTAC\nGT\n"
    index = ("x", 12, 3, 5, 6)
    for start, end in [(0, 12), (3, 8), (-4, 2), (10, 99), (5, 5)]:
        at, n = X.fai_slice(index, start, end)
        assert body[at : at + n].replace(b"\n", b"").decode() == "ACGTACGTACGT"[max(start, 0) : max(end, 0)]


def test_archive_detects_damage():
    data = X.sqar_bytes([b"one", b"two" * 50])
    assert [r[3] for r in X.sqar(data)] == [b"one", b"two" * 50] and X.sniff(data) == "sqar"
    hurt = bytearray(data)
    hurt[30] ^= 1
    with pytest.raises(ValueError):
        list(X.sqar(bytes(hurt)))


def test_data_sources(spark, tmp_path):
    R.register(spark)
    rows = spark.createDataFrame([("a", "ACGT", [1, 2, 3, 4]), ("b", "GG", [0, 40])], "id string, sequence string, quality array<int>")
    out = str(tmp_path / "reads")
    rows.write.format("fastq").mode("append").save(out)
    back = spark.read.format("fastq").load(out)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    assert sorted(r.id for r in R.read_files(spark, out, "fastq").collect()) == ["a", "b"]
    (tmp_path / "x.bam").write_bytes(X.bam_bytes([("chr1", 100)], [("r1", 16, 0, 4, "ACGTN", "IIIII")]))
    (row,) = spark.read.format("bam").load(str(tmp_path / "x.bam")).collect()
    assert (row.qname, row.flag, row.rname, row.pos, row.cigar, row.seq, row.qual) == ("r1", 16, "chr1", 5, "5M", "ACGTN", "IIIII")


def test_stream_equals_batch_over_many_files(spark, small, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet").withColumn("d", F.floor(F.col("event_id") / 250))
    path = str(tmp_path / "events")
    for i in range(4):
        events.where(F.col("d") == i).drop("d").coalesce(1).write.mode("append").parquet(path)
    got = streams.drain(streams.capped_reads(streams.event_stream(spark, path), "user_id", "ts", "event_id", 3))
    counts = {r.user_id: r["count"] for r in got.groupBy("user_id").count().collect()}
    want = {r.user_id: min(3, r["count"]) for r in events.groupBy("user_id").count().collect()}
    assert counts == want
