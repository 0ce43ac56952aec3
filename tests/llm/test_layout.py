import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sequora.llm import merkle, mixing, packing
from sequora.llm.common import tokenizer_path


def test_mixing_targets_and_budgets(make, prose, odd):
    docs = make([(i, prose(1 + i * 7 % 60, i), "en", s) for i, s in enumerate(["a"] * 60 + ["b"] * 9 + ["c"] * 3 + ["d"] * 20)] + [(100 + i, t, "en", None) for i, t in enumerate(odd)], True)
    got = mixing.mix(docs).collect()
    assert len(got) == 92 + len(odd)
    by = {}
    for r in got:
        by.setdefault((r.source_size, r.target), []).append(r)
        assert 0 <= r.taken <= 2 * r.size
    total = sum(r.size for r in got)
    assert abs(sum(t for _, t in by) - 1.5 * total) < 1e-6 * total
    for (size, target), rows in by.items():
        assert sum(r.size for r in rows) == size and target <= 2 * size + 1e-9
        assert abs(sum(r.taken for r in rows) - target) <= 0.5
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))
    assert mixing.mix(make([])).count() == 0


def test_mixed_rows_are_what_was_taken(make, prose):
    docs = make([(i, prose(5 + i % 20, i), "en", "a" if i % 3 else "b") for i in range(60)])
    taken = {r.doc_id: r.taken for r in mixing.mix(docs).collect()}
    rows = mixing.mixed_rows(docs)
    assert rows.columns == docs.columns
    words = Counter()
    for r in rows.collect():
        words[r.doc_id] += len(r.text.split())
        assert r.n_chars == len(r.text)
    assert words == Counter({i: n for i, n in taken.items() if n})


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_solution_places_every_piece(lengths):
    counts = np.bincount(np.array(lengths, np.int64), minlength=65)
    plan = packing.solve(counts, 64, rounds=12)
    placed = Counter()
    for config, times in plan:
        assert sum(n * k for n, k in config) <= 64 and times > 0
        for n, k in config:
            placed[n] += k * times
    assert placed == Counter(lengths)


def test_knapsack_against_brute_force():
    value = np.zeros(13)
    value[[3, 4, 7]] = [2.0, 3.0, 5.5]
    best = packing.best_configuration(value, 12)
    assert sum(value[n] * k for n, k in best.items()) == 9.0


def test_packing_round_trip(make, odd, prose):
    from tokenizers import Tokenizer

    texts = [*odd, "x <|endoftext|> Y <|ENDOFTEXT|>", "İ. Don't stop!! É.", *(prose(20 + i, i) for i in range(40))]
    got = packing.pack(make(texts, True)).collect()
    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    want = {}
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for p in range(0, len(ids), 4096):
            part = np.array(ids[p : p + 4096], "<u4")
            want[i, p // 4096] = (p, len(part), zlib.crc32(part.tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(r.length for r in got)
    assert len(sequences) <= -(-total // 4096) + 1
    assert packing.pack(make([])).count() == 0


def test_pieces_of_a_long_document(make):
    got = sorted((r.piece, r.start, r.length) for r in packing.pack(make(["a " * 9000])).collect())
    assert got == [(0, 0, 4096), (1, 4096, 4096), (2, 8192, 809)]


def test_repeated_rows_are_packed_each(make, prose):
    docs = make([(1, prose(30, 1), "en", "a")] * 5)
    got = packing.pack(docs).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == 5


def test_merkle_equality_and_edits(prose):
    a = prose(2000, 1)
    words = a.split(" ")
    b = " ".join([*words[:1000], "changed", *words[1001:]])
    x, y, z = merkle.tree(a.encode()), merkle.tree(b.encode()), merkle.tree(prose(2000, 2).encode())
    assert merkle.likeness(x, x) == 1.0 and x.text() == merkle.tree(a.encode()).text()
    assert 0.9 <= merkle.likeness(x, y) < 1.0 and merkle.likeness(x, z) < 0.1
    where = merkle.differing(x, y)
    assert where and all(0.3 < p / len(x.digests) < 0.7 for p in where)
    assert len(merkle.tree(prose(50000, 3).encode()).digests) <= 64
    back = merkle.Tree.parse(x.text())
    assert merkle.likeness(back, y) == merkle.likeness(x, y)


def test_merkle_levels_meet(prose):
    long, short = prose(4000, 4), prose(4000, 4)[:9000]
    a, b = merkle.tree(long.encode()), merkle.tree(short.encode())
    assert a.level != b.level and merkle.likeness(a, b) > 0.4


def test_edited_fingerprints(make, odd, prose):
    texts = [*odd, *(prose(30 + i, i) for i in range(30))]
    got = {r.doc_id: r for r in merkle.edited_fingerprints(make(texts, True).repartition(5)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        t, following = t or "", texts[i - 1] or ""
        changed = merkle.edited_text(t, following)
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert got[i].edited_fingerprint == merkle.tree(changed.encode()).text()
        assert got[i].near_next == pytest.approx(merkle.likeness(merkle.tree(t.encode()), merkle.tree(following.encode())))
    assert got[7].fingerprint == got[8].fingerprint
    assert merkle.edited_fingerprints(make([])).count() == 0
    (only,) = merkle.edited_fingerprints(make(["one alone"])).collect()
    assert only.near_next == 1.0
    nulls = merkle.edited_fingerprints(make([(None, "a", "en", "x"), (None, "b", "en", "x"), (2, "c", "en", "x")])).collect()
    assert len(nulls) == 3


CLASHES = ("key", "sha", "rank", "size", "tag", "copy", "id", "absent", "name", "words", "hash", "epochs", "rest", "rows", "__key", "__sha", "__id", "__size", "__rank", "__gone")


def clashing(docs):
    from pyspark.sql import functions as F

    return docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHES)])


def test_stages_return_clashing_columns_unchanged(make, odd, prose):
    from sequora.llm import exact_dedup, simhash

    docs = clashing(make([*odd, *(prose(40, i % 20) for i in range(40))]))
    for stage in (exact_dedup.unique_rows, simhash.one_per_component, mixing.mixed_rows):
        found = stage(docs)
        assert found.columns == docs.columns
        for r in found.collect():
            assert [r[c] for c in CLASHES] == list(range(len(CLASHES)))


def test_repeated_rows_keep_to_the_budget(make, prose):
    """Rows alike in all, rows of one id and size with other texts, and null ids and sources."""
    rows = [(1, prose(30, 1), "en", "a")] * 7 + [(2, prose(30, i), "en", "a") for i in range(5)] + [(None, prose(20, 9), "en", None)] * 6 + [(4, prose(25, 4), "en", "b")] * 4 + [(5, None, "en", "b"), (6, "", "en", "c")]
    docs = make(rows)
    taken, mixed = {}, {}
    for r in mixing._taken(docs).collect():
        taken[r.name] = taken.get(r.name, 0) + r.taken
    for r in mixing.mixed_rows(docs).collect():
        mixed[r.source or ""] = mixed.get(r.source or "", 0) + len(r.text.split())
    assert mixed == {k: n for k, n in taken.items() if n}


def test_the_longest_of_repeated_spellings_stays(make):
    from sequora.llm import exact_dedup

    docs = make([(1, "a b", "en", "s"), (1, "a  b ", "en", "s"), (1, "ab", "en", "s"), (2, "a b", "en", "s")])
    assert [(r.doc_id, r.text) for r in exact_dedup.unique_rows(docs).collect()] == [(1, "a  b ")]
