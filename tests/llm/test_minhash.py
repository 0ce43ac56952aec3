"""Odd sketches, bands and the components of MinHash candidates against brute force."""

import random
from fractions import Fraction

import numpy as np
import pytest

from sequora.llm import minhash
from sequora.llm.common import documents


def shingle_set(text, width=5):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c if c not in "\t\n\v\f\r" else " " for c in text or "").split(" ") if w]
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def plain(rows, num=85):
    """{row index: component id} by comparing all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    at = list(range(len(rows)))

    def find(i):
        while at[i] != i:
            i = at[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in holders[x] if j > i}:
            both = len(s & sets[j])
            if 100 * both >= num * (len(s) + len(sets[j]) - both):
                at[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return sets, [least.get(find(i)) if sets[i] else rows[i][0] for i in range(len(rows))]


def check(docs, **options):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    sets, roots = plain(rows)
    want = sorted(((i, len(s), c, i == c) for (i, _), s, c in zip(rows, sets, roots, strict=True)), key=str)
    assert sorted(map(tuple, minhash.near_components(docs, **options).collect()), key=str) == want


def edited(words, n, seed):
    rng = random.Random(seed)
    words = list(words)
    for i in rng.sample(range(len(words)), n):
        words[i] = f"w{rng.random()}"
    return " ".join(words)


@pytest.fixture(scope="module")
def near_texts(prose):
    """Families around the threshold: one to eight words of 250 changed, and a chain of edits."""
    out = []
    for f in range(12):
        words = [f"{w}{f}x{i % 97}" for i, w in enumerate(prose(250, f).split())]
        out += [edited(words, k, 100 * f + k) for k in range(9)]
    return out


def test_components_against_brute_force(make, odd, near_texts):
    rows = [(7 * i % 997, t, "en", "a") for i, t in enumerate([*odd, *near_texts, near_texts[3].upper(), near_texts[3]])]
    check(make(rows, True).repartition(5))
    check(make([]))


def test_crowded_buckets_lose_no_link(make, prose):
    """Texts that share most of one passage, partly alike to others only, in blocks of four rows."""
    base = [f"{w}{i}" for i, w in enumerate(prose(200, 3).split())]
    texts = [edited(base, 4 + i % 5, i) for i in range(40)]
    texts += [edited(texts[i].split(), 1, 500 + i) for i in range(0, 40, 3)]
    check(make([(900 - i, t, "en", "a") for i, t in enumerate(texts)]), block=4)


def test_small_tables_of_the_data(spark, small):
    check(documents(spark, small))


def test_null_ids_repeated_rows_and_shared_ids(make, prose):
    text, other = prose(60, 1), prose(60, 2)
    docs = make([(None, text, "en", "a"), (None, text, "en", "a"), (3, text, "en", "a"), (3, text, "en", "a"), (None, other, "en", "a"), (4, None, "en", "a"), (None, "", "en", "a")])
    check(docs)
    got = minhash.near_components(make([(5, text, "en", "a"), (5, other, "en", "a"), (6, other, "en", "a")])).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(5, 5), (6, 5)}


def test_sets_of_long_texts_do_not_depend_on_blocks(prose):
    text = (prose(5000, 9) + " É Ü\n").encode()
    whole = minhash.shingles(text)
    assert len(whole) == len(shingle_set(text.decode()))
    for block in (1, 7, 1000):
        assert (minhash.shingles(text, block=block) == whole).all()
    assert len(minhash.shingles(b" \n")) == 0 and len(minhash.shingles(b"one two")) == 1
    assert (minhash.shingles(b"One two  three") == minhash.shingles(b"one TWO\nthree")).all()


def test_estimates_and_bound():
    rng = np.random.default_rng(5)
    bound = minhash.sketch_bound(448, 512, Fraction(85, 100))
    for share, worst in ((0.95, 0.02), (0.85, 0.03), (0.75, 0.05)):
        found, ones = [], []
        for _ in range(60):
            common, each = int(400 * share), (400 - int(400 * share)) // 2
            x = rng.integers(0, 1 << 63, common + 2 * each, dtype=np.uint64)
            a, b = minhash.minima(x[: common + each], 448), minhash.minima(np.concatenate([x[:common], x[common + each :]]), 448)
            ones.append(sum(int(v).bit_count() for v in minhash.odd_sketch(a, 512) ^ minhash.odd_sketch(b, 512)))
            found.append(minhash.estimate(ones[-1], 448, 512))
        assert abs(np.mean(found) - share) < worst
        assert share < 0.85 or max(ones) <= bound
    assert minhash.sketch_bound(448, 512, Fraction(1)) == 0 and minhash.estimate(300, 448, 512) == 0.0


def test_bands_find_pairs_at_the_threshold():
    rng, missed = np.random.default_rng(6), 0
    for _ in range(300):
        x = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
        a, b = (minhash.band_keys(minhash.minima(s, 448), 56) for s in (x[:185], np.concatenate([x[:170], x[185:]])))
        missed += not np.isin(a, b).any()
    assert missed == 0
