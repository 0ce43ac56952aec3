"""Round trips of the codecs over whole tables; each row says whether it came back unchanged."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import functions as F

from ..operators import codecs as C
from ..session import table
from .base import query

ALL_TRUE = "SELECT doc_id, true AS ok FROM documents"
ITEMS_TRUE = "SELECT item_id, true AS ok FROM benchmark"


def _documents(spark, sf, run, schema="ok boolean"):
    return C.apply(table(spark, sf, "documents"), ["doc_id"], "text", run, schema)


def _items(spark, sf, run, schema="ok boolean"):
    return C.apply(table(spark, sf, "benchmark"), ["item_id"], "text", run, schema)


def _blocks(data: bytes, size: int = 32) -> np.ndarray:
    padded = data.ljust(-(-max(len(data), 1) // size) * size, b"\0")
    return np.frombuffer(padded, np.uint8).reshape(-1, size)


@query("crc_marks", ALL_TRUE)
def crc_marks(spark, sf):
    def run(data):
        plain, bad = C.unmarked(C.marked(data))
        hurt = C.marked(data)
        hurt = bytes([hurt[0] ^ 1]) + hurt[1:] if hurt else hurt
        return (plain == data and not bad and (not data or C.unmarked(hurt)[1] == [0]),)

    return _documents(spark, sf, run)


@query("crc16_blocks")
def crc16_blocks(spark, sf):
    return _documents(spark, sf, lambda d: (C.crc16(d),), "crc long")


@query("whitening_roundtrip", ALL_TRUE)
def whitening_roundtrip(spark, sf):
    return _documents(spark, sf, lambda d: (C.whiten(C.whiten(d, 7), 7) == d,))


@query("goldman_roundtrip", "SELECT doc_id, true AS ok, CAST(6 * octet_length(encode(text)) AS BIGINT) AS n FROM documents")
def goldman_roundtrip(spark, sf):
    def run(data):
        bases = C.goldman(data)
        return C.ungoldman(bases) == data and all(a != b for a, b in zip(bases, bases[1:], strict=False)), len(bases)

    return _documents(spark, sf, run, "ok boolean, n long")


@query("goldman_dense_roundtrip", ITEMS_TRUE)
def goldman_dense_roundtrip(spark, sf):
    return _items(spark, sf, lambda d: (C.ungoldman_dense(C.goldman_dense(d), len(d)) == d,))


@query("rotated_roundtrip", ALL_TRUE)
def rotated_roundtrip(spark, sf):
    return _documents(spark, sf, lambda d: (C.unrotated(C.rotated(d)) == d,))


@query("big_integer_roundtrip", ITEMS_TRUE)
def big_integer_roundtrip(spark, sf):
    return _items(spark, sf, lambda d: (C.un_big_integer_bases(C.big_integer_bases(d)) == d,))


def _rs(bits: int, parity: int):
    def run(data):
        rows = _blocks(data).astype(np.int64)
        for at in range(0, len(rows), 100):
            part = rows[at : at + 100]
            whole = np.vstack([part, C.rs_parity(part, parity, bits)])
            lost = [i * 7 % len(whole) for i in range(parity)]
            lost = sorted(set(lost))
            hurt = whole.copy()
            hurt[lost] = 0
            if not (C.rs_recover(hurt, lost, parity, bits) == whole).all():
                return (False,)
        return (True,)

    return run


@query("rs_recover", ALL_TRUE)
def rs_recover(spark, sf):
    """Reed-Solomon over GF(256) across a document's 32-byte blocks; as many are lost as there is parity."""
    return _documents(spark, sf, _rs(8, 4))


@query("rs16_recover", ITEMS_TRUE)
def rs16_recover(spark, sf):
    return _items(spark, sf, _rs(16, 6))


@query("holographic_sweep", ITEMS_TRUE)
def holographic_sweep(spark, sf):
    def run(data):
        shards = C.holographic(data, 5, 12)
        return (all(C.unholographic(shards[i:] + shards[:i], 5, len(data)) == data for i in range(12)),)

    return _items(spark, sf, run)


@query("fountain_roundtrip", ITEMS_TRUE)
def fountain_roundtrip(spark, sf):
    def run(data):
        chunks = [bytes(b) for b in _blocks(data, 16)]
        drops, seed = [], 0
        while True:
            drops += [C.droplet(s, chunks) for s in range(seed, seed + len(chunks))]
            seed += len(chunks)
            back = C.unfountain(drops, len(chunks))
            if back is not None or seed > 50 * len(chunks):
                return (back == chunks,)

    return _items(spark, sf, run)


def _trellis(k: int):
    def run(data):
        blocks = _blocks(data)
        code = C.convolve(blocks, k)
        code[:, 40::97] ^= 1
        return (bool((C.viterbi(code, k) == blocks).all()),)

    return run


@query("viterbi_roundtrip", ITEMS_TRUE)
def viterbi_roundtrip(spark, sf):
    """Constraint length 7; every 97th code bit is wrong."""
    return _items(spark, sf, _trellis(7))


@query("viterbi_k3", ITEMS_TRUE)
def viterbi_k3(spark, sf):
    return _items(spark, sf, _trellis(3))


@query("ldpc_roundtrip", ITEMS_TRUE)
def ldpc_roundtrip(spark, sf):
    def run(data):
        h = C.ldpc_matrix(256, 64)
        words = C.ldpc_encode(np.unpackbits(_blocks(data), axis=1), h)
        for i, word in enumerate(words):
            hurt = word.copy()
            hurt[i * 31 % len(word)] ^= 1
            if not (C.ldpc_correct(hurt, h) == word).all():
                return (False,)
            erased = np.zeros(len(word), bool)
            erased[(i * 13 + np.arange(12) * 5) % len(word)] = True
            filled = C.ldpc_fill(word, erased, h)
            if filled is not None and not (filled == word).all():
                return (False,)
        return (True,)

    return _items(spark, sf, run)


@query("osd_roundtrip", ITEMS_TRUE)
def osd_roundtrip(spark, sf):
    def run(data):
        h = C.ldpc_matrix(64, 32)
        for i, word in enumerate(C.ldpc_encode(np.unpackbits(_blocks(data, 8), axis=1), h)):
            llr = np.where(word == 0, 4.0, -4.0)
            llr[(i + np.arange(3) * 29) % len(word)] *= -0.1
            if not (C.ordered_statistics(llr, h, 1) == word).all():
                return (False,)
        return (True,)

    return _items(spark, sf, run)


@query("hash_repair", ITEMS_TRUE)
def hash_repair(spark, sf):
    """One substitution, deletion or insertion a strand, found by a 4-byte hash."""

    def run(data):
        for i, block in enumerate(_blocks(data, 24)):
            strand = C.direct(bytes(block))
            want = hashlib.sha256(strand.encode()).digest()[:4]
            at = i * 11 % len(strand)
            hurt = [strand[:at] + C.BASES[(C.BASES.index(strand[at]) + 1) % 4] + strand[at + 1 :], strand[:at] + strand[at + 1 :], strand[:at] + "A" + strand[at:]][i % 3]
            if C.repair(hurt, lambda c: hashlib.sha256(c.encode()).digest()[:4] == want, len(strand)) != strand:  # noqa: B023
                return (False,)
        return (True,)

    return _items(spark, sf, run)


@query("compress_roundtrip", ALL_TRUE)
def compress_roundtrip(spark, sf):
    return _documents(spark, sf, lambda d: (C.unsqueeze(*C.squeeze(d)) == d,))


@query("arithmetic_roundtrip", ITEMS_TRUE)
def arithmetic_roundtrip(spark, sf):
    def run(data):
        bases = C.direct(data)
        return (all(C.arithmetic_decode(C.arithmetic_encode(bases, k), len(bases), k) == bases for k in (0, 2)),)

    return _items(spark, sf, run)


@query("encrypt_roundtrip", "SELECT doc_id, true AS ok, true AS hidden FROM documents")
def encrypt_roundtrip(spark, sf):
    """AES-GCM in the JVM: compress, encrypt, decrypt; what is stored is not the text."""
    key = F.unhex(F.sha2(F.lit("a test key").cast("binary"), 256))
    d = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    e = d.withColumn("e", F.aes_encrypt("t", key, F.lit("GCM"), F.lit("DEFAULT")))
    return e.select("doc_id", (F.aes_decrypt("e", key, F.lit("GCM"), F.lit("DEFAULT")).cast("string") == F.col("t")).alias("ok"), (F.col("e") != F.col("t").cast("binary")).alias("hidden"))


@query("sign_verify", "SELECT doc_id, sha256('a test key' || sha256(to_json({'doc_id': doc_id, 'lang': lang})::VARCHAR)) AS signature FROM documents")
def sign_verify(spark, sf):
    """A keyed digest of a row's canonical JSON (keys in order, no spaces)."""
    d = table(spark, sf, "documents").select("doc_id", F.to_json(F.struct("doc_id", "lang")).alias("j"))
    return d.select("doc_id", F.sha2(F.concat(F.lit("a test key"), F.sha2("j", 256)), 256).alias("signature"))


def _pipeline(channel: str, copies: int):
    """Encode, add outer parity, simulate reads, vote, decode; the share of strands that came back."""
    sub, ins, dele, _, _ = C.CHANNELS[channel]

    def run(data):
        rows = _blocks(data, 16).astype(np.int64)
        good = total = 0
        for at in range(0, len(rows), 60):
            part = rows[at : at + 60]
            whole = np.vstack([part, C.rs_parity(part, 16)])
            back, lost = np.zeros_like(whole), []
            for i, row in enumerate(whole):
                raw = row.astype(np.uint8).tobytes()
                strand = C.direct(raw + C.crc16(raw).to_bytes(2, "big"))
                reads = [C.simulate(strand, hash((at, i, c, len(data))) & 0xFFFFFFFF, sub, ins, dele) for c in range(copies)]
                fit = [r for r in reads if len(r) == len(strand)]
                if fit:
                    voted = "".join(max(C.BASES, key=[r[p] for r in fit].count) for p in range(len(strand)))
                    got = C.undirect(voted)
                    if C.crc16(got[:-2]) == int.from_bytes(got[-2:], "big"):
                        back[i] = np.frombuffer(got[:-2], np.uint8)
                        continue
                lost.append(i)
            if len(lost) <= 16:
                back = C.rs_recover(back, lost, 16)
            good += int((back[: len(part)] == part).all(axis=1).sum())
            total += len(part)
        return good == total, good, total

    return run


@query("codec_pipeline", "SELECT item_id, true AS recovered FROM benchmark")
def codec_pipeline(spark, sf):
    return _items(spark, sf, _pipeline("illumina", 5), "recovered boolean, good long, total long").select("item_id", "recovered")


@query("coverage_sweep")
def coverage_sweep(spark, sf):
    parts = [_items(spark, sf, _pipeline("nanopore", n), "recovered boolean, good long, total long").select(F.lit(n).alias("coverage"), "*") for n in (1, 3, 7)]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.groupBy("coverage").agg(F.avg(F.col("recovered").cast("int")).alias("files"), (F.sum("good") / F.sum("total")).alias("strands"))


@query("error_sweep")
def error_sweep(spark, sf):
    parts = [_items(spark, sf, _pipeline(c, 5), "recovered boolean, good long, total long").select(F.lit(c).alias("channel"), "*") for c in ("clean", "illumina", "pacbio", "nanopore")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("channel").agg(F.avg(F.col("recovered").cast("int")).alias("files"), (F.sum("good") / F.sum("total")).alias("strands"))


@query("simulate_reads")
def simulate_reads(spark, sf):
    """Noisy reads of every reference under each channel, seeded by row: length and errors seen."""
    b = table(spark, sf, "benchmark")
    grid = b.crossJoin(spark.createDataFrame([(k,) for k in C.CHANNELS], "channel string"))

    rows = grid.select("item_id", "channel", F.concat_ws("\t", "channel", "item_id", "text").alias("p"))

    def one(raw):
        name, key, text = raw.decode().split("\t", 2)
        strand = C.direct(text.encode())
        sub, ins, dele, _, _ = C.CHANNELS[name]
        read = C.simulate(strand, int(key) * 31 + 1, sub, ins, dele)
        return len(strand), len(read)

    return C.apply(rows, ["item_id", "channel"], "p", one, "bases long, read_bases long")
