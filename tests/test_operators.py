import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sequora.functions import sequence as S
from sequora.operators import codecs as C
from sequora.operators import consensus as K
from sequora.operators import intervals as I
from sequora.operators import kmer
from sequora.operators import structure as T


def test_public_check_values():
    assert C.crc16(b"123456789") == 0x29B1
    assert C.crc8(b"123456789") == 0xF4


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=80))
def test_base_mappings_round_trip(data):
    assert C.undirect(C.direct(data)) == data
    assert C.unrotated(C.rotated(data)) == data
    assert C.ungoldman(C.goldman(data)) == data
    assert C.ungoldman_dense(C.goldman_dense(data), len(data)) == data
    assert C.un_big_integer_bases(C.big_integer_bases(data)) == data
    assert C.whiten(C.whiten(data, 99), 99) == data
    assert C.unsqueeze(*C.squeeze(data)) == data
    bases = C.direct(data)
    assert C.arithmetic_decode(C.arithmetic_encode(bases), len(bases)) == bases
    if data:
        assert all(a != b for a, b in zip(C.goldman(data), C.goldman(data)[1:], strict=False))


@pytest.mark.parametrize("bits,parity", [(8, 4), (8, 9), (16, 5)])
def test_reed_solomon_gives_back_any_rows(bits, parity):
    rng = np.random.default_rng(bits + parity)
    rows = rng.integers(0, 1 << bits, (20, 7))
    whole = np.vstack([rows, C.rs_parity(rows, parity, bits)])
    for _ in range(5):
        lost = sorted(rng.choice(len(whole), parity, replace=False).tolist())
        hurt = whole.copy()
        hurt[lost] = 0
        assert (C.rs_recover(hurt, lost, parity, bits) == whole).all()
    with pytest.raises(ValueError):
        C.rs_recover(whole, list(range(parity + 1)), parity, bits)


def test_holographic_any_k_of_n():
    data = bytes(range(200))
    shards = C.holographic(data, 6, 15)
    for seed in range(8):
        some = random.Random(seed).sample(shards, 6)
        assert C.unholographic(some, 6, len(data)) == data


@pytest.mark.parametrize("k", sorted(C.GENERATORS))
def test_viterbi_corrects(k):
    blocks = np.random.default_rng(k).integers(0, 256, (5, 16)).astype(np.uint8)
    code = C.convolve(blocks, k)
    code[:, 11::60] ^= 1
    assert (C.viterbi(code, k) == blocks).all()


def test_ldpc_corrects_and_fills():
    rng = np.random.default_rng(3)
    h = C.ldpc_matrix(128, 64)
    word = C.ldpc_encode(rng.integers(0, 2, (1, 128)).astype(np.uint8), h)[0]
    assert not (h.astype(int) @ word % 2).any()
    for bit in range(0, 192, 17):
        hurt = word.copy()
        hurt[bit] ^= 1
        assert (C.ldpc_correct(hurt, h) == word).all()
    erased = np.zeros(192, bool)
    erased[rng.choice(192, 20, replace=False)] = True
    filled = C.ldpc_fill(word, erased, h)
    assert filled is not None and (filled == word).all()


def test_fountain_needs_enough():
    chunks = [bytes([i] * 8) for i in range(10)]
    drops = [C.droplet(s, chunks) for s in range(40)]
    assert C.unfountain(drops, 10) == chunks
    assert C.unfountain(drops[:3], 10) is None


def test_alignment_and_consensus():
    a, b = K.align("ACGTACGT", "ACGACGTT")
    assert a.replace("-", "") == "ACGTACGT" and b.replace("-", "") == "ACGACGTT" and len(a) == len(b)
    truth = C.direct(bytes(range(24)))
    reads = [C.simulate(truth, s, 0.02, 0.02, 0.02) for s in range(15)]
    assert K.star_consensus(reads)[0] == truth
    assert K.star_consensus([]) == ("", [])
    assert K.attention_consensus(["ACGT", "ACGA", "ACGT"]) == "ACGT"
    assert K.warp_distance(K.squiggle("ACGTTG"), K.squiggle("ACGTTG")) == 0


def test_structure():
    assert T.hairpins("GGGGCCAAAAAGGCCCC")[0][1] >= 5
    frames = T.reading_frames("ATG" + "GCT" * 12 + "TAA", 5)
    assert frames[0] == (1, 0, 39, 13)
    reverse = T.reading_frames(T.reverse_complement("ATG" + "GCT" * 12 + "TAA"), 5)
    assert (-1, 3, 42, 13) in reverse


def test_sequence_expressions(spark):
    rows = spark.createDataFrame([("ACGTAACC",), ("",), (None,), ("GGGG",), ("ACNX",)], "s string")
    out = {r["s"]: r for r in rows.select("s", S.gc_content("s").alias("gc"), S.max_homopolymer("s").alias("hp"), S.reverse_complement("s").alias("rc"), S.dna_to_bytes("s").alias("b"), S.constraint_ok("s").alias("ok")).collect()}
    assert out["ACGTAACC"]["gc"] == 0.5 and out["ACGTAACC"]["rc"] == "GGTTACGT" and bytes(out["ACGTAACC"]["b"]) == b"\x1b\x05"
    assert out[""]["gc"] == 0 and out[""]["hp"] == 0 and out[""]["ok"]
    assert out[None]["gc"] is None and out["GGGG"]["hp"] == 4 and not out["GGGG"]["ok"]
    assert out["ACNX"]["rc"] == "NNGT" and out["ACNX"]["b"] is None


def test_intervals_against_brute_force(spark):
    rng = random.Random(4)
    a = [(i, s := rng.randrange(500), s + rng.randrange(1, 60)) for i in range(60)]
    b = [(i, s := rng.randrange(500), s + rng.randrange(1, 60)) for i in range(60)]
    left, right = spark.createDataFrame(a, "i long, s long, e long"), spark.createDataFrame(b, "j long, x long, y long")
    got = {(r.i, r.j) for r in I.overlap_join(left, right, "s", "e", "x", "y", 25).collect()}
    assert got == {(i, j) for i, s, e in a for j, x, y in b if s < y and x < e}
    assert I.overlap_join(left, right, "s", "e", "x", "y", 25).count() == len(got)


def test_asof_with_ties_and_gaps(spark):
    left = spark.createDataFrame([(1, 5), (1, 0), (2, 9), (3, 1)], "k long, t long")
    right = spark.createDataFrame([(1, 3, 10), (1, 5, 11), (1, 5, 12), (2, 10, 13)], "k long, t long, v long")
    got = {(r.k, r.t): r.matched_v for r in I.asof_backward(left, right, ["k"], "t", "t", ["v"]).collect()}
    assert got == {(1, 5): 12, (1, 0): None, (2, 9): None, (3, 1): None}


def test_leader_clusters_equal_one_pass(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("ACGT") for _ in range(60)) for _ in range(6)]
    rows = [(i, C.simulate(base[i % 6], i, 0.03, 0, 0)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, s string")
    got = {r.id: r.leader for r in kmer.leader_clusters(df, "id", "s", 8, 0.5).collect()}
    sets = {i: {s[p : p + 8] for p in range(len(s) - 7)} for i, s in rows}
    want, leaders = {}, []
    for i, _ in rows:
        fit = next((a for a in leaders if len(sets[a] & sets[i]) >= 0.5 * len(sets[a])), None)
        want[i] = i if fit is None else fit
        leaders += [i] * (fit is None)
    assert got == want


def test_partitioning_does_not_matter(spark, small):
    from sequora.plans import catalog

    one = catalog.QUERIES["consensus_majority"](spark, small).orderBy("conv_id").collect()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert catalog.QUERIES["consensus_majority"](spark, small).orderBy("conv_id").collect() == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_filters_and_columns_reach_the_scan(spark, small):
    from sequora.session import table

    plan = table(spark, small, "lineitem").where(F.col("l_quantity") > 40).select("l_orderkey")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,40.0)]" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_bit_llrs_are_those_of_the_bits(spark):
    """From the probabilities of the four bases, qualities clamped to 10..40 and ratios to 20."""
    import math

    from sequora.operators.decode import bit_llr

    rows = spark.createDataFrame([(q,) for q in (0, 3, 10, 25, 40, 93)], "q int").withColumn("w", bit_llr(F.col("q"))).collect()
    for r in rows:
        e = 10 ** (-max(10, min(40, r.q)) / 10)
        bases = [1 - e, e / 3, e / 3, e / 3]
        assert r.w == pytest.approx(min(20, math.log((bases[0] + bases[1]) / (bases[2] + bases[3])))) == pytest.approx(min(20, math.log((bases[0] + bases[2]) / (bases[1] + bases[3]))))


def test_seals_break_with_any_field(spark):
    from sequora.operators.decode import seal, seal_state

    rows = spark.createDataFrame([(i, "c", "h", "2024-01-01", None, False) for i in range(6)], "id long, content string, holder string, created string, expires date, revoked boolean")
    rows = rows.withColumn("seal", F.when(F.col("id") != 5, seal("id", "content", "holder", "created")))
    rows = rows.withColumn("content", F.when(F.col("id") == 1, "d").otherwise(F.col("content"))).withColumn("holder", F.when(F.col("id") == 2, "x").otherwise(F.col("holder")))
    rows = rows.withColumn("revoked", F.col("id") == 3).withColumn("expires", F.when(F.col("id") == 4, F.lit("2024-06-01").cast("date")))
    got = rows.select("id", seal_state("id", "content", "holder", "created", "seal", "expires", "revoked", F.lit("2025-01-01").cast("date")).alias("s")).collect()
    assert {r.id: r.s for r in got} == {0: "valid", 1: "broken", 2: "broken", 3: "revoked", 4: "expired", 5: "broken"}


HEAD, TAIL = "ACGTTGCAAGCTTGACCTGA", "TTGACCATGCAAGTCGGATC"


def plain_trim(read, expected):
    if read is None or len(read) < len(HEAD) + len(TAIL):
        return None

    def anchor(pattern, first, last):
        wanted, best = {pattern[i : i + 5] for i in range(len(pattern) - 4)}, (0, None)
        for p in range(first, last + 1):
            n = len(wanted & {read[p + i : p + i + 5] for i in range(len(pattern) - 4)})
            if n > best[0]:
                best = n, p
                if n >= len(wanted) - 1:
                    break
        return best

    n, at = anchor(HEAD, 0, min(20, len(read) - len(HEAD)))
    if n < 3:
        return None
    inner = at + len(HEAD)
    n, stop = anchor(TAIL, max(inner + 20, len(read) - len(TAIL) - 30), len(read) - len(TAIL))
    if n >= 3 and stop > inner + 16:
        return read[inner:stop]
    rest = read[inner : inner + expected] if expected else ""
    return rest if len(rest) >= 16 else None


@pytest.mark.parametrize("expected", [0, 60])
def test_tolerant_trimming_against_plain_python(spark, expected):
    """Primers with missing, extra and changed bases, noise before and after, reads without one or both."""
    from sequora.operators.decode import trimmed_tolerant

    rng = random.Random(expected)

    def hurt(text, n):
        for _ in range(n):
            p, kind = rng.randrange(len(text)), rng.choice("dis")
            text = text[:p] + {"d": "", "i": rng.choice("ACGT") + text[p], "s": rng.choice("ACGT")}[kind] + text[p + 1 :]
        return text

    dna = lambda n: "".join(rng.choices("ACGT", k=n))
    reads = [dna(rng.randrange(12)) + hurt(HEAD, i % 4) + dna(rng.choice([5, 18, 60, 90])) + (hurt(TAIL, i % 3) if i % 5 else "") + dna(rng.randrange(10)) for i in range(150)]
    reads += [None, "", HEAD, HEAD + TAIL, HEAD + dna(16) + TAIL, HEAD + dna(21) + TAIL, dna(80), dna(39)]
    got = trimmed_tolerant(spark.createDataFrame(list(enumerate(reads)), "i int, dna string"), "dna", HEAD, TAIL, expected).collect()
    want = {i: t for i, r in enumerate(reads) if (t := plain_trim(r, expected)) is not None}
    assert {r.i: r.dna for r in got} == want and 20 < len(want) < len(reads)
