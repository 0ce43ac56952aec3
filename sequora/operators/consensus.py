"""Consensus of reads with insertions and deletions, a cluster at a time.

A cluster's reads are capped before they are gathered (``most`` reads, by id), as coverage
beyond that no longer changes a vote; so no group is unbounded.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BASES = "ACGT"


def align(a: str, b: str, match: int = 2, mismatch: int = -1, gap: int = -2, band: int | None = None) -> tuple[str, str]:
    """Global alignment by dynamic programming, row-vectorised; '-' marks gaps.

    With a band, cells farther than that from the (scaled) diagonal are not used.
    """
    n, m = len(a), len(b)
    x, y = np.frombuffer(a.encode(), np.uint8), np.frombuffer(b.encode(), np.uint8)
    score = np.full((n + 1, m + 1), -(10**9), np.int64)
    columns = np.arange(m + 1)
    score[0] = gap * columns
    for i in range(1, n + 1):
        best = np.maximum(score[i - 1] + gap, -(10**9))
        best[1:] = np.maximum(best[1:], score[i - 1, :-1] + np.where(y == x[i - 1], match, mismatch))
        best[0] = gap * i
        if band is not None:
            best[np.abs(columns - i * m / max(n, 1)) > band] = -(10**9)
        # a run of gaps along the row is a running maximum once the slope is taken out
        score[i] = np.maximum.accumulate(best - gap * columns) + gap * columns
    i, j, left, right = n, m, [], []
    while i or j:
        if i and j and score[i, j] == score[i - 1, j - 1] + (match if a[i - 1] == b[j - 1] else mismatch):
            i, j = i - 1, j - 1
            left.append(a[i])
            right.append(b[j])
        elif i and score[i, j] == score[i - 1, j] + gap:
            i -= 1
            left.append(a[i])
            right.append("-")
        else:
            j -= 1
            left.append("-")
            right.append(b[j])
    return "".join(reversed(left)), "".join(reversed(right))


def star_consensus(reads: list[str], rounds: int = 3, length: int | None = None) -> tuple[str, list[float]]:
    """(consensus, share of the winning vote by base): align all to a centre, vote, repeat.

    Votes are held per place of the centre, and per gap between places for insertions, so an
    insertion in one read does not shift the columns of the others.
    """
    if not reads:
        return "", []
    centre = sorted(reads, key=lambda r: (abs(len(r) - (length or int(np.median([len(q) for q in reads])))), r))[0]
    shares: list[float] = []
    for _ in range(rounds):
        votes = [dict.fromkeys(BASES + "-", 0) for _ in centre]
        inserted: list[dict[str, int]] = [{} for _ in range(len(centre) + 1)]
        for read in reads:
            at, pending = 0, ""
            for c, r in zip(*align(centre, read), strict=True):
                if c == "-":
                    pending += r
                    continue
                if pending:
                    inserted[at][pending] = inserted[at].get(pending, 0) + 1
                    pending = ""
                votes[at][r if r in BASES else "-"] += 1
                at += 1
            if pending:
                inserted[at][pending] = inserted[at].get(pending, 0) + 1
        out, shares = [], []
        for i in range(len(centre) + 1):
            extra = inserted[i]
            if extra and 2 * sum(extra.values()) > len(reads):
                text = max(sorted(extra), key=extra.get)
                out.append(text)
                shares += [extra[text] / len(reads)] * len(text)
            if i < len(centre):
                best = max("ACGT-", key=lambda b: votes[i][b])  # noqa: B023
                if best != "-":
                    out.append(best)
                    shares.append(votes[i][best] / len(reads))
        new = "".join(out)
        if new == centre:
            break
        centre = new
    return centre, shares


def attention_consensus(reads: list[str], temperature: float = 0.5, half: int = 5) -> str:
    """Votes weighed by how well a read agrees with the others around each place."""
    size = int(np.median([len(r) for r in reads])) if reads else 0
    grid = np.array([list(r.ljust(size, "N")[:size]) for r in reads]) if size else np.zeros((len(reads), 0))
    out = []
    for p in range(size):
        window = grid[:, max(0, p - half) : p + half + 1]
        alike = (window[:, None, :] == window[None, :, :]).mean(axis=2).mean(axis=1)
        weight = np.exp(alike / temperature)
        out.append(max(BASES, key=lambda b: weight[grid[:, p] == b].sum()))  # noqa: B023
    return "".join(out)


def edit_profile(pairs: list[tuple[str, str]]) -> dict[str, int]:
    """Matches, substitutions, insertions and deletions of reads against their references, aligned."""
    out = {"match": 0, "substitution": 0, "insertion": 0, "deletion": 0}
    for reference, read in pairs:
        for c, r in zip(*align(reference, read), strict=True):
            out["insertion" if c == "-" else "deletion" if r == "-" else "match" if c == r else "substitution"] += 1
    return out


def cluster_consensus(reads: DataFrame, cluster: str, read: str, sequence: str, most: int = 64) -> DataFrame:
    """(cluster, consensus, reads, confidence) by star alignment."""
    order = Window.partitionBy(cluster).orderBy(read)
    some = reads.withColumn("__rk", F.row_number().over(order)).where(F.col("__rk") <= most)
    kind = reads.schema[cluster].dataType.simpleString()

    def run(part: pd.DataFrame) -> pd.DataFrame:
        found, shares = star_consensus(part.sort_values(read)[sequence].dropna().tolist())
        return pd.DataFrame({cluster: [part[cluster].iloc[0]], "consensus": [found], "reads": [len(part)], "confidence": [float(np.mean(shares)) if shares else 0.0]})

    return some.select(cluster, read, sequence).groupBy(cluster).applyInPandas(run, f"{cluster} {kind}, consensus string, reads long, confidence double")


def warp_distance(a: np.ndarray, b: np.ndarray) -> float:
    """Dynamic time warping distance of two series, per step of the longer."""
    if not len(a) or not len(b):
        return float("inf")
    before = np.full(len(b) + 1, np.inf)
    before[0] = 0.0
    for x in a:
        now, cost = np.full(len(b) + 1, np.inf), np.abs(b - x)
        for j in range(1, len(b) + 1):
            now[j] = cost[j - 1] + min(before[j], now[j - 1], before[j - 1])
        before = now
    return float(before[-1] / max(len(a), len(b)))


def warp_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``warp_distance`` of every row of ``a`` with every row of ``b``, all pairs side by side."""
    if not a.shape[1] or not b.shape[1]:
        return np.full((len(a), len(b)), np.inf)
    out, step = np.empty((len(a), len(b))), max(1, 4096 // max(len(b), 1))
    for low in range(0, len(a), step):
        part = a[low : low + step]
        before = np.full((b.shape[1] + 1, len(part), len(b)), np.inf)
        before[0] = 0.0
        now = np.empty_like(before)
        for i in range(a.shape[1]):
            now[0] = np.inf
            for j in range(1, b.shape[1] + 1):
                best = np.minimum(before[j], now[j - 1], out=now[j])
                np.minimum(best, before[j - 1], out=best)
                best += np.abs(b[:, j - 1] - part[:, i, None])
            before, now = now, before
        out[low : low + step] = before[-1] / max(a.shape[1], b.shape[1])
    return out


def nearest_signals(heads: list[str], known: dict[int, str]) -> tuple[np.ndarray, np.ndarray]:
    """(key, distance): the key of ``known`` whose signal is nearest to each head's, the least of equally near ones; equal heads are compared once."""
    keys = np.array(sorted(known))
    signals = [squiggle(known[k]) for k in keys]
    distinct, place = np.unique(np.array(heads, object).astype(str), return_inverse=True)
    own = [squiggle(h) for h in distinct]
    found = np.full((len(own), len(keys)), np.inf)
    for m in {len(s) for s in own}:
        rows = [i for i, s in enumerate(own) if len(s) == m]
        for n in {len(s) for s in signals}:
            columns = [i for i, s in enumerate(signals) if len(s) == n]
            found[np.ix_(rows, columns)] = warp_distances(np.array([own[i] for i in rows]), np.array([signals[i] for i in columns]))
    best = found.argmin(axis=1)
    return keys[best][place], found[np.arange(len(own)), best][place]


def squiggle(bases: str, k: int = 3) -> np.ndarray:
    """A signal level for each k-mer: a fixed linear model of its codes."""
    codes = np.array([BASES.index(c) for c in bases if c in BASES], np.float64)
    if len(codes) < k:
        return np.zeros(0)
    weights = np.array([7.0, 19.0, 11.0, 3.0, 2.0][:k])
    return 60 + np.convolve(codes, weights[::-1], "valid")
