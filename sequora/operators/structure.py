"""Motif and structure scans: hairpins, open reading frames, safety reports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

_PAIR = str.maketrans("ACGT", "TGCA")
STOPS = ("TAA", "TAG", "TGA")


def reverse_complement(s: str) -> str:
    return s.translate(_PAIR)[::-1]


def hairpins(s: str, stems: range = range(12, 3, -1), loops: range = range(3, 11)) -> list[tuple[int, int, int, float]]:
    """(start, stem, loop, Tm) of non-overlapping hairpins, the most stable first.

    Tm is Wallace's on the stem less two degrees for each loop base over three.
    """
    found = []
    for stem in stems:
        for i in range(len(s) - 2 * stem - loops[0] + 1):
            left = s[i : i + stem]
            want = reverse_complement(left)
            for loop in loops:
                j = i + stem + loop
                if s[j : j + stem] == want:
                    gc = left.count("G") + left.count("C")
                    found.append((i, stem, loop, 2.0 * (stem - gc) + 4.0 * gc - 2.0 * (loop - 3)))
                    break
    taken, out = [], []
    for hit in sorted(found, key=lambda h: (-h[3], h[0], -h[1])):
        start, end = hit[0], hit[0] + 2 * hit[1] + hit[2]
        if all(end <= a or start >= b for a, b in taken):
            taken.append((start, end))
            out.append(hit)
    return out


def reading_frames(s: str, least: int = 30) -> list[tuple[int, int, int, int]]:
    """(frame, start, end, codons) in all six frames: ATG to a stop or the end, on the forward strand's places."""
    out = []
    for strand, text in ((1, s), (-1, reverse_complement(s))):
        for shift in range(3):
            at = shift
            while at + 3 <= len(text):
                if text[at : at + 3] != "ATG":
                    at += 3
                    continue
                end = at
                while end + 3 <= len(text) and text[end : end + 3] not in STOPS:
                    end += 3
                codons = (end - at) // 3
                if codons >= least:
                    start, stop = (at, end) if strand == 1 else (len(s) - end, len(s) - at)
                    out.append((strand * (shift + 1), start, stop, codons))
                at = end + 3
    return out


def scan(df: DataFrame, key: str, sequence: str, find, schema: str) -> DataFrame:
    """A row for each find in each sequence, in Arrow batches."""
    kind = df.schema[key].dataType.simpleString()
    names = [key, *(c.split()[0] for c in schema.split(", "))]

    def run(batches):
        for batch in batches:
            rows = [(k, *hit) for k, s in zip(batch[key], batch[sequence], strict=True) if s is not None for hit in find(s)]
            yield pd.DataFrame(rows, columns=names)

    return df.select(key, sequence).mapInPandas(run, f"{key} {kind}, {schema}")
