"""Splittable readers and the region scan: the same rows at any split, fewer bytes for a smaller region."""

import gzip
import io
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThan

from sequora.sources import blocks as B
from sequora.sources import formats as X
from sequora.sources import readers as R
from sequora.sources import splits, tabix


def bgzf(data: bytes, block: int = 3000) -> bytes:
    return b"".join(B.bgzf_block(data[i : i + block]) for i in range(0, len(data), block)) + B.END


def fastq(n: int, seed: int, end: str = "\n") -> str:
    rng, out = random.Random(seed), []
    for i in range(n):
        size = rng.choice([1, 20, 150, 700])
        quality = "".join(rng.choice("@+!I") for _ in range(size))  # lines that look like others
        out.append(f"@r{i} x{end}{''.join(rng.choices('ACGTN', k=size))}{end}+{rng.choice(['', 'r'])}{end}{quality}{end}")
        if i % 17 == 5:
            out.append(f"noise{end}@lost{end}")
    return "".join(out)


@pytest.mark.parametrize("pack", ["plain", "crlf", "bgzf", "gzip"])
@pytest.mark.parametrize("most", [1, 97, 1000, 4096, 1 << 30])
def test_fastq_at_any_split(tmp_path, pack, most):
    text = fastq(60 if most == 1 else 200, 1, "\r\n" if pack == "crlf" else "\n")
    if most == 1:
        most = 7
    want = list(X.fastq(text.splitlines()))
    data = {"bgzf": bgzf, "gzip": gzip.compress}.get(pack, bytes)(text.encode())
    path = tmp_path / "a.fastq"
    path.write_bytes(data)
    cuts = [(0, len(data))] if pack == "gzip" else B.ranges(len(data), most)
    got = []
    for start, stop in cuts:
        with B.opened(str(path)) as f:
            got += splits.fastq_range(f, start, stop)
    assert got == want


def bam_file(n: int, seed: int, block: int) -> tuple[bytes, list[tuple]]:
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        size = rng.choice([0, 1, 35, 151, 9000 if i % 40 == 7 else 80])
        rows.append((f"read/{i}", 0, rng.randrange(3), rng.randrange(10**6), "".join(rng.choices("ACGTN", k=size)), "".join(rng.choice("!5I~") for _ in range(size))))
    raw = X.bam_head([("chr1", 10**6), ("chr2", 10**6), ("é3", 10**6)]) + b"".join(X.bam_row(*r) for r in rows)
    return bgzf(raw, block), list(X.bam(bgzf(raw, block)))


@pytest.mark.parametrize("block", [200, 5000, 65000])
@pytest.mark.parametrize("most", [150, 2000, 50_000])
def test_bam_at_any_split(block, most, tmp_path):
    data, want = bam_file(300, block, block)
    path = tmp_path / "a.bam"
    path.write_bytes(data)
    assert len(want) == 300
    got = []
    for start, stop in B.ranges(len(data), most):
        with B.opened(str(path)) as f:
            got += splits.bam_range(f, start, stop, splits.bam_header(f))
    assert got == want


def test_bam_that_breaks_off_and_its_tags(tmp_path):
    data, want = bam_file(50, 3, 5000)
    (tmp_path / "cut.bam").write_bytes(data[: len(data) // 2])
    with B.opened(str(tmp_path / "cut.bam")) as f:
        got = list(splits.bam_range(f, 0, len(data), splits.bam_header(f)))
    assert 0 < len(got) < 50 and got == want[: len(got)]
    empty = bgzf(X.bam_head([("c", 5)]))
    (tmp_path / "none.bam").write_bytes(empty)
    with B.opened(str(tmp_path / "none.bam")) as f:
        assert list(splits.bam_range(f, 0, len(empty), splits.bam_header(f))) == []
    base = X.bam_row("r", 0, 0, 1, "ACG", None)

    def tags(extra):
        body = base[4:] + extra
        return X.bam_record((len(body)).to_bytes(4, "little") + body, 0, 4 + len(body), ["c"])[-1]

    assert tags(b"NMC\x05ASs\xfe\xffXZZhi\0XAAqXFBS\x02\0\0\0\x01\0\x02\0") == ["NM:i:5", "AS:i:-2", "XZ:Z:hi", "XA:A:q", "XF:B:S,1,2"]
    for broken in (b"NM", b"NMi\x01", b"XZZopen", b"XFBS\x09\0\0\0\x01", b"XX?\x01", b"XFBq\x01\0\0\0\x01"):
        assert tags(broken) == []
    assert X.bam_record(base, 0, len(base), ["c"])[9:11] == ("ACG", "*")


def test_blocks_are_found_past_false_ones(tmp_path):
    noise = bytes(random.Random(1).randrange(256) for _ in range(3000)) + B.END + B.MAGIC * 50
    data = B.bgzf_block(noise, 0) + B.bgzf_block(b"second") + B.END
    (tmp_path / "n").write_bytes(data)
    with B.opened(str(tmp_path / "n")) as f:
        content = B.Inflated(f)
        assert content.find(0) == 0 and content.find(len(data)) == len(data)
        assert content.find(len(data) - len(B.END)) == len(data) - len(B.END)
        assert B.block_size(content.read(content.find(3200), 99)) > 0
    assert B.bgzf_block(b"")[:16] == B.END[:16] and gzip.decompress(data) == noise + b"second"


def test_split_sources_in_spark(spark, tmp_path):
    R.register(spark)
    rows = spark.range(500).select(F.concat(F.lit("r"), "id").alias("qname"), F.lit("chr2").alias("rname"), (F.col("id") + 1).cast("int").alias("pos"), F.repeat(F.lit("ACGTA"), 40).alias("seq"), F.repeat(F.lit("I"), 200).alias("qual"))
    rows.coalesce(1).write.format("bam").mode("append").option("references", "chr1:9000,chr2:9000").save(str(tmp_path / "bam"))
    back = spark.read.format("bam").option("splitBytes", 1000).load(str(tmp_path / "bam"))
    assert back.rdd.getNumPartitions() > 3
    assert sorted(map(tuple, back.select("qname", "rname", "pos", "seq", "qual").collect())) == sorted(map(tuple, rows.collect()))
    assert R.read_files(spark, str(tmp_path / "bam"), "bam").count() == 500
    text = rows.select(F.col("qname").alias("id"), F.col("seq").alias("sequence"), F.expr("transform(sequence(1, 200), x -> x % 40)").alias("quality"))
    text.coalesce(1).write.format("fastq").mode("append").save(str(tmp_path / "fq"))
    back = spark.read.format("fastq").option("splitBytes", 5000).load(str(tmp_path / "fq"))
    assert back.rdd.getNumPartitions() > 10 and sorted(map(tuple, back.collect())) == sorted(map(tuple, text.collect()))


def features(n: int, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        start = rng.choice([rng.randrange(1 << 22), rng.randrange(tabix.LONGEST - 10**6), 1 << 14, (1 << 17) - 3])
        rows.append((rng.choice(["1", "chr2", "X"]), start, start + rng.choice([1, 50, 20_000, 700_000]), [f"f{i}", "é"]))
    return sorted(rows)


REGIONS = [(None, 0, tabix.LONGEST), ("1", 0, 100), ("1", 1 << 14, (1 << 14) + 1), ("chr2", 100_000, 3_000_000), ("X", 5, 1 << 28), ("Y", 0, 99), ("1", 500, 500), ("chr2", (1 << 29) - 10, 1 << 30)]


@pytest.mark.parametrize("most", [500, 1 << 30])
def test_region_scan_equals_full_scan(tmp_path, most):
    rows = features(3000, 2)
    index = tabix.Index()
    held = io.BytesIO()
    held.close, data = (lambda: None), held
    out = B.BgzfWriter(data, 2000)
    for chrom, start, end, fields in rows:
        begins = out.place
        out.write("\t".join(map(str, (chrom, start, end, *fields))).encode() + b"\n")
        index.add(chrom, start, end, begins, out.place)
    out.close()
    (tmp_path / "a.gz").write_bytes(data.getvalue())
    (tmp_path / "a.gz.tbi").write_bytes(bgzf(index.bytes()))
    back = tabix.Index.parse(bgzf(index.bytes()))
    assert {n: (dict(r.chunks), r.floors) for n, r in back.references.items()} == {n: (dict(r.chunks), r.floors) for n, r in index.references.items()}
    bytes_read = {}
    for chrom, start, end in REGIONS:
        reader = tabix.TabixReader(str(tmp_path / "a.gz"), most)
        reader.pushFilters(([EqualTo(("chrom",), chrom)] if chrom else []) + [LessThan(("start",), end), GreaterThan(("end",), start)])
        parts = reader.partitions()
        got = [r for p in parts for r in reader.read(p)]
        assert sorted(got) == sorted((c, s, e, [c, str(s), str(e), *f]) for c, s, e, f in rows if chrom in (None, c) and s < end and e > start)
        bytes_read[chrom, start, end] = sum(min(e >> 16, len(data.getvalue())) - (b >> 16) for p in parts for b, e in p.ranges)
    whole = bytes_read[REGIONS[0]]
    assert bytes_read["1", 0, 100] < whole / 10 and bytes_read["chr2", 100_000, 3_000_000] < whole / 3 and not bytes_read["Y", 0, 99]


def test_bins():
    for start, end in [(0, 1), (16383, 16385), (1 << 26, (1 << 26) + 1), (0, tabix.LONGEST), (1 << 20, 1 << 21)]:
        assert tabix.bin_of(start, end) in set(tabix.bins(start, end))
        for other in [(start, start + 1), (max(0, start - 5), end), (end - 1, end + 9)]:
            if other[0] < end and other[1] > start:
                assert tabix.bin_of(start, end) in set(tabix.bins(*other))
    assert tabix.bin_of(0, 1) == 4681 and tabix.bin_of(16383, 16385) == 585 and set(tabix.bins(0, tabix.LONGEST)) == set(range(tabix.BINS))


def test_pushed_filters_in_spark(spark, tmp_path):
    R.register(spark)
    rows = spark.createDataFrame(features(2000, 4), tabix.SCHEMA)
    path = str(tmp_path / "t")
    tabix.write_indexed(rows, path, 3)
    want = {(r.chrom, r.start, r.end, r.fields[0]) for r in rows.collect()}
    read = lambda df: {(r.chrom, r.start, r.end, r.fields[3]) for r in df.collect()}
    assert read(spark.read.format("tabix").option("splitBytes", 2000).load(path)) == want
    for chrom in ("chr1", "1"):
        got = tabix.region(spark, path, chrom, 1 << 14, 1 << 20)
        assert read(got) == {r for r in want if r[0] == "1" and r[1] < 1 << 20 and r[2] > 1 << 14} != set()
    assert tabix.region(spark, path, "chr2", 10, 20).rdd.getNumPartitions() < spark.read.format("tabix").option("splitBytes", 2000).load(path).rdd.getNumPartitions() + 1
    region = tabix.Region().narrowed([In(("chrom",), ("1", "chr1")), EqualTo(("start",), 7)])
    assert region == tabix.Region(("1", "chr1"), 7, 8)
    with pytest.raises(Exception, match="not in order"):
        spark.createDataFrame([("1", 9, 10, ["a"]), ("1", 3, 4, ["b"])], tabix.SCHEMA).coalesce(1).write.format("tabix").mode("append").save(str(tmp_path / "bad"))


def test_vcf_layout_and_comments():
    index = tabix.Index((1, 2, 0), tabix.VCF)
    assert index.row("#CHROM\tPOS") is None and index.row("1\tx\t.\tA") is None and index.row("1") is None
    assert index.row("1\t11\t.\tACG\tT")[:3] == ("1", 10, 13)
    assert tabix.Index((3, 4, 5), 0).row("a\tb\tchr1\t11\t20")[:3] == ("chr1", 10, 20)
