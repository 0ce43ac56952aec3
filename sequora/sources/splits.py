"""FASTQ and BAM read in many tasks a file: each task takes the records that begin in its byte range.

A FASTQ record begins at a line with @ whose next but one has +: no other line of a record is
followed so. A BAM record has no mark, so a range that does not begin at a known place tries
each byte of its first block until a chain of records fits: sizes, reference numbers, name and
lengths of each must agree, and each must begin where the one before ends.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from . import formats as X
from .blocks import Inflated, lines

FIXED = 36


def fastq_range(file, start: int, stop: int) -> Iterator[tuple[str, str, list[int]]]:
    """The records of a FASTQ file (plain, BGZF or gzip) that begin in [start, stop)."""
    for name, sequence, quality in fastq_lines(lines(file, start, stop)):
        yield name, sequence, [ord(c) - 33 for c in quality]


def fastq_lines(found: Iterator[tuple[bool, bytes]]) -> Iterator[tuple[str, str, str]]:
    """(id, sequence, quality letters) of the records that begin in a range, from the range's lines."""
    held: list[tuple[bool, bytes]] = []
    for line in found:
        held.append(line)
        while held and not held[0][0]:
            return  # what begins now is another range's
        if len(held) == 4:
            if held[0][1].startswith(b"@") and held[2][1].startswith(b"+"):
                name, sequence, quality = (held[i][1].decode("utf-8", "replace") for i in (0, 1, 3))
                yield name[1:], sequence, quality
                held = []
            else:
                held = held[1:]


def bam_header(file) -> tuple[list[str], int, int]:
    """Reference names, and where the first record begins: offset of its block, place in that block."""
    content = Inflated(file)

    def number(at: int) -> int:
        if not content.has(at + 4):
            raise ValueError("the BAM header breaks off")
        return struct.unpack("<i", content.bytes(at, 4))[0]

    if not content.has(8) or content.bytes(0, 4) != b"BAM\1":
        raise ValueError("not a BGZF-compressed BAM file")
    at = 8 + number(4)
    count, at, names = number(at), at + 4, []
    for _ in range(count):
        n = number(at)
        if not content.has(at + 8 + n):
            raise ValueError("the BAM header breaks off")
        names.append(content.bytes(at + 4, n - 1).decode())
        at += 8 + n
    if not content.has(at + 1):  # no record: the end of the content
        return names, content.size, 0
    block = content.block_of(at)
    return names, block, at - content.marks[0][0]


def _size(content: Inflated, at: int, references: int) -> int:
    """Bytes of the record at ``at`` if what is there can be one, else 0."""
    if not content.has(at + FIXED):
        return 0
    size, ref, pos, name, _, _, cigar, _, bases, mate, mate_pos, _ = struct.unpack("<iiiBBHHHiiii", content.bytes(at, FIXED))
    if not (-1 <= ref < references and -1 <= mate < references and pos >= -1 and mate_pos >= -1 and name and bases >= 0):
        return 0
    if size < FIXED - 4 + name + 4 * cigar + (bases + 1) // 2 + bases:
        return 0
    if not content.has(at + FIXED + name):
        return 0
    text = content.bytes(at + FIXED, name)
    return 4 + size if text[-1] == 0 and all(33 <= c <= 126 for c in text[:-1]) else 0


def _chained(content: Inflated, at: int, references: int, depth: int = 6) -> bool:
    for _ in range(depth):
        size = _size(content, at, references)
        if not size or not content.has(at + size):
            return False
        at += size
        if not content.has(at + 1):
            return True  # the last record ends with the file
    return True


def bam_range(file, start: int, stop: int, header: tuple[list[str], int, int]) -> Iterator[tuple]:
    """The rows of a BAM file whose records begin in blocks of [start, stop)."""
    names, block, within = header
    content = Inflated(file)
    if start <= block:
        content.next, at = block, within
    else:
        content.next, at = content.find(start), 0
        while True:
            if content.next >= stop and not content.data or not content.has(at + 1) or content.block_of(at) >= stop:
                return
            if _chained(content, at, len(names)):
                break
            at += 1
    while content.has(at + 4) and content.block_of(at) < stop:
        size = 4 + struct.unpack("<i", content.bytes(at, 4))[0]
        if size < FIXED or not content.has(at + size):
            return  # the file breaks off
        yield X.bam_record(content.bytes(at, size), 0, size, names)
        at += size
        content.forget(at)
