"""Inputs that the small tables do not have: far keys, halves, dense libraries, many equal rows."""

import itertools
import os

import pytest
from oracle import connect, same
from pyspark.sql import functions as F

from sequora.operators import intervals as I
from sequora.plans import catalog


def folder(tmp_path, small, **tables):
    """The small tables with some of them replaced: each by an SQL query over the small ones."""
    con = connect(small)
    for name in os.listdir(small):
        target = tmp_path / name
        if (sql := tables.get(name.removesuffix(".parquet"))) is None:
            target.symlink_to(f"{small}/{name}")
        else:
            con.execute(f"COPY ({sql}) TO '{target}' (FORMAT parquet)")
    return str(tmp_path)


def test_genomic_bins_beyond_the_scheme(spark, small, tmp_path):
    """Places beyond 512 Mb are in bin 0 unless a smaller bin holds them; a half rounds to even, as in SQL."""
    rows = "SELECT * REPLACE (l_orderkey + 700000 * (l_linenumber % 3) AS l_orderkey, CASE WHEN l_linenumber = 1 THEN 16384 * 40 - 1 - l_orderkey * 997 % 16384 + 0.5 ELSE l_extendedprice * 1000 END AS l_extendedprice) FROM lineitem"
    sf = folder(tmp_path, small, lineitem=rows)
    same(catalog.QUERIES["genomic_bins"](spark, sf), connect(sf), catalog.ORACLES["genomic_bins"])


def test_bins_beyond_the_scheme_meet_once(spark):
    at = [0, 5, 1 << 26, (1 << 29) - 3, 1 << 29, (1 << 30) + 77]
    spans = spark.createDataFrame([(a, b) for a in at for b in (a + 1, a + 40_000, a + (1 << 28), a + (1 << 30))], "s long, e long")
    own, wide = spans.withColumn("bin", I.genomic_bin(F.col("s"), F.col("e"))), spans.select(F.col("s").alias("x"), F.col("e").alias("y"), F.explode(I.genomic_bins(F.col("s"), F.col("e"))).alias("bin"))
    met = own.join(wide, "bin").where("s < y AND x < e").select("s", "e", "x", "y")
    want = spans.crossJoin(spans.toDF("x", "y")).where("s < y AND x < e")
    assert sorted(met.collect()) == sorted(want.collect())


def test_addresses_set_common_bases_right(spark):
    """References of one seed and near numbers leave few bases to look around in: far fewer rows are dealt than 48 a read."""
    from sequora.operators import addresses as A

    refs = spark.range(64).select(F.col("id").alias("strand"), A.address_code(F.col("id")).alias("code"))
    reads = spark.range(64).select(A.address_code(F.col("id")).bitwiseXOR(F.lit(1 << 20)).alias("code"))
    alike, bits = A._common(refs)
    assert bin(alike).count("1") == 26 and all(r.code & alike == bits for r in refs.collect())
    assert {(r.strand, r.changed) for r in A.nearest(reads, refs).collect()} == {(i, 1) for i in range(64)}


def test_overlaps_of_equal_intervals_are_joined_once(spark):
    """20 000 equal intervals on each side: 400 million pairs, counted without being made; others, and a customer twice, beside them."""
    left = spark.range(20_000).selectExpr("id AS k", "10L AS s", "20L AS e").union(spark.createDataFrame([(7, 900, 905), (9, 3, 3), (9, None, 4)], "k long, s long, e long"))
    right = spark.range(20_000).selectExpr("id + 5 AS p", "15L AS ps", "40L AS pe").union(spark.createDataFrame([(1, 19, 901), (2, 0, 4)], "p long, ps long, pe long"))
    found = I.overlap_counts(left, right, "s", "e", "ps", "pe", "p", 8)
    got = {tuple(r) for r in found.groupBy("s", "e", "n", "least").count().collect()}
    assert got == {(10, 20, 20_001, 1, 20_000), (900, 905, 1, 1, 1)} | {(3, 3, 1, 2, 1)}
    nodes = I.overlap_join(left.select("s", "e"), right, "s", "e", "ps", "pe", 8).where("s = 3").collect()
    assert [(r.s, r.p) for r in nodes] == [(3, 2)]


def test_dna_in_batches(spark):
    from sequora.functions import sequence as S
    from sequora.operators.bases import dna

    rows = spark.createDataFrame([("",), (None,), ("aé漢😀\0",), ("x" * 3000,)], "t string").repartition(3)
    assert rows.where(~dna("t").eqNullSafe(S.bytes_to_dna("t"))).count() == 0


def test_best_match_in_parts_equals_the_join(spark, monkeypatch):
    """Ties, odd letters, short and null strings, references in several parts, equal to the join; no read is shuffled."""
    import random

    from sequora.operators import kmer

    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    common = word(12)
    refs = [(i, word(30) + common * (i % 2) + word(9)) for i in range(40)] + [(50, "NNN"), (51, None), (52, "AC"), (53, "")]
    refs.append((54, refs[3][1]))
    reads = [(100 + i, refs[rng.randrange(40)][1][rng.randrange(9) :] + "N" * (i % 3) + word(5) + common) for i in range(60)] + [(1, None), (2, ""), (3, "NNNN"), (4, common)]
    r, f = spark.createDataFrame(reads, "r long, s string").repartition(3), spark.createDataFrame(refs, "f long, s string")
    for k, margin in ((5, 0), (7, 2)):
        want = sorted(map(tuple, kmer._best_match_joined(r, "r", f, "f", "s", k, 3, margin).collect()))
        for most in (1 << 14, 7):
            monkeypatch.setattr(kmer, "MOST_REFS", most)
            got = kmer.best_match(r, "r", f, "f", "s", k, 3, margin)
            assert sorted(map(tuple, got.collect())) == want and want
    monkeypatch.setattr(kmer, "MOST_REFS", 1 << 14)
    assert "Exchange hash" not in kmer.best_match(r, "r", f, "f", "s")._jdf.queryExecution().executedPlan().toString()


def test_warp_distances_side_by_side():
    import numpy as np

    from sequora.operators import consensus as K

    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(7, 9)), rng.normal(size=(5, 6))
    assert K.warp_distances(a, b).tolist() == [[K.warp_distance(x, y) for y in b] for x in a]
    heads, known = ["ACGTACGT", "AC", "TTTTGA", "ACGTACGT"], {5: "ACGTACGA", 2: "ACGTACGA", 9: "TT", 7: "TTTGACC"}
    keys, distances = K.nearest_signals(heads, known)
    for h, key, d in zip(heads, keys, distances, strict=True):
        each = {i: K.warp_distance(K.squiggle(h), K.squiggle(s)) for i, s in known.items()}
        best = min(each, key=lambda i: (each[i], i))
        assert (key, d) == (best, each[best])


def test_tolerant_trimming_looks_at_the_ends_in_batches(spark):
    from sequora.operators import decode as D

    head, tail = "ACGTTGCAAGCTTGACCTGA", "TTGACCATGCAAGTCGGATC"
    reads = {1: "GG" + head + "ACGT" * 300 + tail + "A", 2: head + "C" * 40, 3: head[:9] + head[10:] + "G" * 30 + "é" + tail, 4: "ACGT" * 30, 5: None, 6: "", 7: head + tail}
    rows = spark.createDataFrame(list(reads.items()), "i long, s string").repartition(2)
    found = D.trimmed_tolerant(rows, "s", head, tail, 20)
    assert {r.i: r.s for r in found.collect()} == {1: "A" + ("ACGT" * 300)[:-1], 2: "C" * 20, 3: "G" * 29, 7: tail}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "array_intersect" not in plan and "ArrowEvalPython" in plan


def test_tiling_walks_each_text_once(spark):
    """The same tiles as by rounds of joins, without a join."""
    from sequora.operators import libraries as L

    library = spark.createDataFrame([(3, "ab"), (1, "abc"), (9, "é😀"), (2, "ab"), (4, "cc")], "entry long, sequence string")
    texts = spark.createDataFrame([("x", "abcabxé😀é"), ("y", "ccc" * 50), ("z", None), (None, "ab"), ("w", "\0ab")], "id string, sequence string").repartition(2)
    for gap in (1, 3):
        found = L.tile(texts, library, gap)
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, found.collect())) == sorted(map(str, L._tile_in_rounds(texts.where("id is not null and sequence <> ''"), library, gap).collect()))


@pytest.mark.parametrize(("size", "pieces"), [(6, 900), (6, 5), (40, 30)])
def test_nearest_in_crowded_libraries(spark, monkeypatch, size, pieces):
    """A library that holds much of what there is makes no pairs of blocks and pieces that share a segment."""
    import random

    from sequora.operators import libraries as L

    rng = random.Random(size + pieces)
    letters = lambda: "".join(rng.choice("ACGT") for _ in range(size))
    library = [(i, letters()) for i in range(pieces)]
    blocks = {letters() for _ in range(200)} | {s[:-2] + "NN" for _, s in library[:9]} | {"N" * size, "\0" + library[0][1][1:]}
    used, masked = [], L._masked
    if pieces == 900:  # half of what there is, against segments that some hundred thousand pairs share
        blocks |= {"".join(b) for b in itertools.product("ACGT", repeat=6)}
        monkeypatch.setattr(L, "_masked", lambda *a: used.append(1) or masked(*a))
    found = L.nearest(spark.createDataFrame([(b,) for b in blocks], "block string"), spark.createDataFrame(library, "entry long, sequence string")).collect()
    want = {b: min((sum(x != y for x, y in zip(b, s, strict=True)), e) for e, s in library) for b in blocks}
    assert {r.block: (r.changed, r.entry) for r in found} == want and len(found) == len(want)
    assert bool(used) == (pieces == 900)


def test_multiplied_rows_are_not_broadcast(spark, monkeypatch):
    """A few rows that become thousands look small to the planner: their joins are told to merge."""
    from sequora.operators import addresses as A
    from sequora.operators import libraries as L

    plans = []
    for module in (A, L):
        monkeypatch.setattr(module, "settled", lambda df, keep=module.settled: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df))
    refs = spark.range(9).select(F.col("id").alias("strand"), A.address_code(F.col("id")).alias("code"))
    A.nearest(refs.select(F.col("code").bitwiseXOR(F.lit(5)).alias("code")), refs)
    L.nearest(spark.createDataFrame([("ACGTAC",), ("TTTTTT",)], "block string"), spark.createDataFrame([(1, "ACGTAA")], "entry long, sequence string"))
    waves = [p for p in plans if "Generate" in p and "Join Inner" in p]
    assert len(waves) >= 3 and all("strategy=merge" in p for p in waves)


def test_tallies_over_batches_and_blocks(spark):
    """A cluster of many reads goes on over batches and blocks; ties, other letters, empty and null reads; equal to plain counting."""
    import random

    from sequora.operators import reads as R

    rng = random.Random(2)
    rows = [(c, i, "".join(rng.choice("ACGTN") for _ in range(rng.choice([0, 1, 255, 256, 257, 700])))) for c in range(4) for i in range(9)]
    rows += [(7, 100 + i, rng.choice(["ACGT", "ACGA", "TÀ"])) for i in range(9000)] + [(8, 1, None), (9, 2, ""), (None, 3, "CCC"), (None, 4, "CCG")]
    table = spark.createDataFrame(rows, "c long, r long, s string").repartition(3)
    seen = {}
    for c, r, s in rows:
        for p, b in enumerate(s or ""):
            n, q = seen.setdefault((c, p), {}).get(b, (0, 0))
            seen[c, p][b] = (n + 1, q + 10 + (r * 7 + p * 13) % 31)
    want = {}
    for key, by in seen.items():
        total, quality = sum(n for n, _ in by.values()), sum(q for _, q in by.values())
        base = min(by, key=lambda b: (-by[b][0], b))
        share = round(by[base][0] / total, 6)
        want[key] = (base, share, share < 0.6 or quality / total < 15)
    calls = R.soft_calls(table, "c", "r", "s")
    assert {(x.c, x.pos): (x.base, x.confidence, x.erased) for x in calls.collect()} == want
    plan = calls._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "HashAggregate" not in plan
    found = {x.c: x.consensus for x in R.consensus(table.where("c is not null"), "c", "r", "s").collect()}
    assert found[7] == "".join(want[7, p][0] for p in range(4)) and 9 not in found
    assert all(found[c] == "".join(want[c, p][0] for p in range(len(found[c]))) for c in range(4) if c in found)


def test_fastq_ranges_share_tasks_and_come_in_batches(tmp_path):
    """A file of thousands of ranges is 512 tasks at most, whose Arrow batches hold each record once."""
    from sequora.sources import formats as X
    from sequora.sources import readers

    rows = [(f"r{i}", "ACGTN" * (i % 7 + 1), [i % 40] * (5 * (i % 7 + 1))) for i in range(3000)]
    (tmp_path / "a.fastq").write_text("".join(X.fastq_text(*r) for r in rows))
    reader = readers._Reader("fastq", str(tmp_path), 64)
    parts = reader.partitions()
    assert 1 < len(parts) <= 512
    batches = [b for p in parts for b in reader.read(p)]
    assert [tuple(r.values()) for b in batches for r in b.to_pylist()] == rows
