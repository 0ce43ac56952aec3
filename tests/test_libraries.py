"""Tiling and nearest pieces against one pass in plain Python."""

import random

import pytest

from sequora.operators import libraries as L


def plain_tiles(text, library, gap):
    out, at = [], 0
    while at < len(text):
        fits = [(-len(s), e) for e, s in library if s and text.startswith(s, at)]
        size, entry = min(fits, default=(-min(gap, len(text) - at), None))
        out.append((at + 1, -size, entry))
        at -= size
    return out


@pytest.mark.parametrize("gap", [1, 4])
def test_tiles_against_one_pass(spark, gap):
    """A long text, texts that end inside a piece, equal pieces, pieces that begin with each other."""
    rng = random.Random(gap)
    letters = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    library = [(i, letters(rng.choice([2, 3, 5, 5, 8]))) for i in range(40)] + [(90, "ACGTACGT"), (91, "ACGT"), (7, "ACGT"), (92, "")]
    texts = {0: letters(9000), 1: "ACGTACG", 2: "A", 3: "", 4: None, 5: "N" * 50, 6: "ACGTACGT" * 30, **{i: letters(i) for i in range(10, 60)}}
    rows = spark.createDataFrame(list(texts.items()), "id long, sequence string")
    got = {}
    for r in L.tile(rows, spark.createDataFrame(library, "entry long, sequence string"), gap).collect():
        got.setdefault(r.id, []).append((r.start, r.length, r.entry))
    assert {i: sorted(t) for i, t in got.items()} == {i: plain_tiles(t, library, gap) for i, t in texts.items() if t}


def test_tiles_of_nothing(spark):
    none = spark.createDataFrame([], "entry long, sequence string")
    texts = spark.createDataFrame([(1, "abc")], "id long, sequence string")
    assert sorted((r.start, r.length, r.entry) for r in L.tile(texts, none, 2).collect()) == [(1, 2, None), (3, 1, None)]
    assert L.tile(texts.limit(0), none).count() == 0
    with pytest.raises(ValueError):
        L.tile(texts, none, 0)


@pytest.mark.parametrize(("size", "most"), [(12, None), (12, 2), (12, 0), (5, None), (3, 2)])
def test_nearest_against_brute_force(spark, size, most):
    """Ties, equal pieces, blocks far from every piece, and one that shares no letter with any."""
    rng = random.Random(size)
    letters = lambda: "".join(rng.choice("ACGT") for _ in range(size))
    library = [(i, letters()) for i in range(30)] + [(50, "A" * size), (3, "A" * size)]
    blocks = [letters() for _ in range(60)] + ["N" * size, "A" * size, "A" * (size - 1) + "C"] * 2
    blocks += [s[: size // 2] + rng.choice("ACGT") + s[size // 2 + 1 :] for _, s in library]
    want = {}
    for b in blocks:
        changed, entry = min((sum(x != y for x, y in zip(b, s, strict=True)), e) for e, s in library)
        if most is None or changed <= most:
            want[b] = (entry, changed)
    found = L.nearest(spark.createDataFrame([(b,) for b in blocks], "block string"), spark.createDataFrame(library, "entry long, sequence string"), most).collect()
    assert {r.block: (r.entry, r.changed) for r in found} == want and len(found) == len(want)


def test_nearest_refuses_unequal_lengths(spark):
    library = spark.createDataFrame([(1, "ACGT")], "entry long, sequence string")
    for odd in ("ACG", None):
        with pytest.raises(ValueError):
            L.nearest(spark.createDataFrame([(odd,)], "block string"), library)
    assert L.nearest(spark.createDataFrame([("ACGT",)], "block string"), library.limit(0)).count() == 0
