"""Parsers and writers of sequence file formats: pure functions from bytes or lines to rows."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def fastq(lines: Iterable[str]) -> Iterator[tuple[str, str, list[int]]]:
    """(id, sequence, Phred values). A record that does not start with @ and + is skipped a line at a time."""
    held: list[str] = []
    for line in lines:
        held.append(line.rstrip("\r\n"))
        while len(held) >= 4:
            if held[0].startswith("@") and held[2].startswith("+"):
                yield held[0][1:], held[1], [ord(c) - 33 for c in held[3]]
                held = held[4:]
            else:
                held = held[1:]


def fastq_batch(names: list[str], sequences: list[str], qualities: list[str]) -> pa.RecordBatch:
    """An Arrow batch of FASTQ records from their quality letters."""
    values = np.frombuffer("".join(qualities).encode("utf-32-le"), np.int32) - 33
    ends = np.concatenate([[0], np.cumsum([len(q) for q in qualities])]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sequences, pa.string()), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], ["id", "sequence", "quality"])


def fastq_text(name: str, sequence: str, quality: list[int]) -> str:
    return f"@{name}\n{sequence}\n+\n{''.join(chr(q + 33) for q in quality)}\n"


def fasta(lines: Iterable[str]) -> Iterator[tuple[str, str]]:
    """(header, sequence); lines before the first header are skipped."""
    header, parts = None, []
    for line in lines:
        line = line.strip()
        if line.startswith(">"):
            if header is not None:
                yield header, "".join(parts)
            header, parts = line[1:], []
        elif header is not None:
            parts.append(line)
    if header is not None:
        yield header, "".join(parts)


SAM_FIELDS = "qname string, flag int, rname string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual string, optional array<string>"


def sam(lines: Iterable[str]) -> Iterator[tuple]:
    """Alignment rows; header lines and rows under 11 fields are skipped."""
    for line in lines:
        p = line.rstrip("\r\n").split("\t")
        if line.startswith("@") or len(p) < 11:
            continue
        try:
            yield p[0], int(p[1]), p[2], int(p[3]), int(p[4]), p[5], p[6], int(p[7]), int(p[8]), p[9], p[10], p[11:]
        except ValueError:
            continue


VCF_FIELDS = "chrom string, pos long, id string, ref string, alt string, qual double, filter string, info map<string,string>, format array<string>, samples array<string>"


def vcf(lines: Iterable[str]) -> Iterator[tuple]:
    """Variant rows; a missing quality is NaN, a flag in INFO is 'true'.

    Rows under 8 fields, and rows whose position or quality is no number, are skipped.
    """
    for line in lines:
        p = line.rstrip("\r\n").split("\t")
        if line.startswith("#") or len(p) < 8:
            continue
        try:
            pos, qual = int(p[1]), float("nan") if p[5] == "." else float(p[5])
        except ValueError:
            continue
        info = {}
        for item in p[7].split(";"):
            key, eq, value = item.partition("=")
            if key and key != ".":
                info[key] = value if eq else "true"
        yield p[0], pos, p[2], p[3], p[4], qual, p[6], info, p[8].split(":") if len(p) > 8 else [], p[9:]


FAI_FIELDS = "name string, length long, offset long, line_bases int, line_width int"


def fai(lines: Iterable[str]) -> Iterator[tuple]:
    for line in lines:
        p = line.split("\t")
        if len(p) >= 5 and all(x.strip().isdigit() for x in p[1:5]):
            yield p[0], *(int(x) for x in p[1:5])


def fai_slice(index: tuple, start: int, end: int) -> tuple[int, int]:
    """(first byte, bytes) of the bases [start, end), clamped, line ends included."""
    _, length, offset, bases, width = index
    start, end = max(0, min(start, length)), max(0, min(end, length))
    if end <= start:
        return offset, 0
    place = lambda i: offset + i // bases * width + i % bases
    return place(start), place(end - 1) + 1 - place(start)


def bgzf_blocks(data: bytes) -> bytes:
    """The content of a BGZF file, or of any series of gzip members; other data stays as it is."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:
        z = zlib.decompressobj(31)
        out.append(z.decompress(data))
        data = z.unused_data
    return b"".join(out)


_SEQ, _OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
#: Struct letters of the number types of optional fields.
_TAGS = {"A": "c", "c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}


_LETTERS = str.maketrans("0123456789abcdef", _SEQ)
_CODES = str.maketrans(_SEQ, "0123456789abcdef")


def _bam_tags(data: bytes, p: int, end: int) -> Iterator[str]:
    """Optional fields as SAM writes them; those after one that breaks off or is unknown are left out."""
    while p + 3 <= end:
        tag, kind = data[p : p + 2].decode("latin-1"), chr(data[p + 2])
        p += 3
        size = struct.calcsize("<" + _TAGS[kind]) if kind in _TAGS else 0
        if size and p + size <= end:
            value = struct.unpack_from("<" + _TAGS[kind], data, p)[0]
            yield f"{tag}:{'i' if kind in 'cCsSiI' else kind}:{value.decode('latin-1') if isinstance(value, bytes) else value}"
            p += size
        elif kind in "ZH" and 0 <= (stop := data.find(0, p, end)):
            yield f"{tag}:{kind}:{data[p:stop].decode('latin-1')}"
            p = stop + 1
        elif kind == "B" and p + 5 <= end and chr(data[p]) in _TAGS:
            part, n = _TAGS[chr(data[p])], struct.unpack_from("<i", data, p + 1)[0]
            size = struct.calcsize("<" + part) * n
            if n < 0 or p + 5 + size > end:
                return
            yield ",".join([f"{tag}:B:{chr(data[p])}", *map(str, struct.unpack_from(f"<{n}{part}", data, p + 5))])
            p += 5 + size
        else:
            return


def bam_record(data: bytes, at: int, end: int, names: list[str]) -> tuple:
    """The row of the record in data[at:end], as one of SAM."""
    name_of = lambda i: names[i] if 0 <= i < len(names) else "*"
    ref, pos, n_name, mapq, _, n_cigar, flag, n_seq, next_ref, next_pos, tlen = struct.unpack_from("<iiBBHHHiiii", data, at + 4)
    p = at + 36
    name = data[p : p + n_name - 1].decode("latin-1")
    p += n_name
    ops = struct.unpack_from(f"<{n_cigar}I", data, p)
    p += 4 * n_cigar
    seq = data[p : p + (n_seq + 1) // 2].hex().translate(_LETTERS)[:n_seq]
    p += (n_seq + 1) // 2
    qual = bytes(q + 33 & 255 for q in data[p : p + n_seq]).decode("latin-1") if n_seq and data[p] != 255 else "*"
    tags = list(_bam_tags(data, p + n_seq, end))
    cigar = "".join(f"{o >> 4}{_OPS[o & 15]}" for o in ops) or "*"
    mate = "=" if next_ref == ref and next_ref >= 0 else name_of(next_ref)
    return name, flag, name_of(ref), pos + 1, mapq, cigar, mate, next_pos + 1, tlen, seq or "*", qual, tags


def bam(data: bytes) -> Iterator[tuple]:
    """The rows of a BAM file, as those of SAM (positions from 1); a record that breaks off ends them."""
    data = bgzf_blocks(data)
    if data[:4] != b"BAM\1":
        raise ValueError("not a BAM file")
    at = 8 + struct.unpack_from("<i", data, 4)[0]
    count, at, names = struct.unpack_from("<i", data, at)[0], at + 4, []
    for _ in range(count):
        n = struct.unpack_from("<i", data, at)[0]
        names.append(data[at + 4 : at + 3 + n].decode())
        at += 8 + n
    while at + 4 <= len(data):
        end = at + 4 + struct.unpack_from("<i", data, at)[0]
        if end > len(data):
            return
        yield bam_record(data, at, end, names)
        at = end


def bam_head(references: list[tuple[str, int]]) -> bytes:
    out = [b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", len(references))]
    named = [(name.encode() + b"\0", length) for name, length in references]
    out += [struct.pack("<i", len(name)) + name + struct.pack("<i", length) for name, length in named]
    return b"".join(out)


def bam_row(name: str, flag: int, ref: int, pos: int, seq: str, qual: str | None) -> bytes:
    """A record that matches whole at ``pos`` (from 0) of reference number ``ref``; no quality is 255 a base."""
    packed = bytes.fromhex(seq.translate(_CODES) + "0" * (len(seq) % 2))
    label = name.encode() + b"\0"
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(label), 60, 4680, 1, flag, len(seq), -1, -1, 0)
    body += label + struct.pack("<I", len(seq) << 4) + packed
    body += b"\xff" * len(seq) if qual is None else bytes(ord(q) - 33 for q in qual)
    return struct.pack("<i", len(body)) + body


def bam_bytes(references: list[tuple[str, int]], rows: list[tuple[str, int, int, int, str, str]]) -> bytes:
    """A small BAM in one gzip member: rows of (name, flag, reference number, position from 0, sequence, quality)."""
    return zlib.compress(bam_head(references) + b"".join(bam_row(*row) for row in rows), wbits=31)


SQAR_MAGIC = b"SQAR"


def sqar_bytes(blocks: list[bytes], block_size: int = 65536) -> bytes:
    """An archive: magic, version, sizes as 32-bit fields, blocks (length, CRC-32, deflate), index, SHA-256."""
    import hashlib

    body, index = [], []
    at = 20
    for b in blocks:
        packed = zlib.compress(b)
        index.append(struct.pack("<QII", at, len(b), zlib.crc32(b)))
        body.append(struct.pack("<II", len(packed), zlib.crc32(packed)) + packed)
        at += 8 + len(packed)
    digest = hashlib.sha256(b"".join(blocks)).digest()
    return SQAR_MAGIC + struct.pack("<IIQ", 1, block_size, len(blocks)) + b"".join(body) + b"".join(index) + digest


def sqar(data: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """(block, offset in the content, CRC-32, content); a broken block or digest raises."""
    import hashlib

    if data[:4] != SQAR_MAGIC:
        raise ValueError("not an archive")
    _, _, count = struct.unpack_from("<IIQ", data, 4)
    index, start, total = len(data) - 32 - 16 * count, 0, hashlib.sha256()
    rows = []
    for i in range(count):
        at, size, crc = struct.unpack_from("<QII", data, index + 16 * i)
        length, packed_crc = struct.unpack_from("<II", data, at)
        packed = data[at + 8 : at + 8 + length]
        if zlib.crc32(packed) != packed_crc:
            raise ValueError(f"block {i} is damaged")
        content = zlib.decompress(packed)
        if len(content) != size or zlib.crc32(content) != crc:
            raise ValueError(f"block {i} is damaged")
        total.update(content)
        rows.append((i, start, crc, content))
        start += size
    if total.digest() != data[-32:]:
        raise ValueError("the digest does not fit")
    yield from rows


def sniff(data: bytes) -> str:
    """sqar, bam, gzip, fasta, fastq, sam, vcf or unknown."""
    if data[:4] == SQAR_MAGIC:
        return "sqar"
    if data[:4] == b"BAM\1":
        return "bam"
    if data[:2] == b"\x1f\x8b":
        return "bam" if bgzf_blocks(data)[:4] == b"BAM\1" else "gzip"
    head = data[:64]
    if head.startswith(b">"):
        return "fasta"
    if head.startswith(b"##fileformat=VCF"):
        return "vcf"
    if head[:3] in (b"@HD", b"@SQ", b"@RG", b"@PG", b"@CO"):
        return "sam"
    return "fastq" if head.startswith(b"@") else "unknown"
