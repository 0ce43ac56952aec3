import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sequora.llm import exact_dedup, graph, repeats, simhash, substring, suffix


def rows(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


def brute_windows(texts, as_bytes):
    first, out = {}, {}
    for i, t in sorted(texts.items()):
        data = (t or "").encode()
        units = data if as_bytes else data.split()
        mask = bytearray(len(units))
        for p in range(len(units) - 49):
            k = units[p : p + 50] if as_bytes else b" ".join(units[p : p + 50])
            if first.setdefault(k, i) < i:
                mask[p : p + 50] = b"\1" * 50
        keep = [u for u, m in zip(units, mask, strict=True) if not m]
        kept = bytes(keep) if as_bytes else b" ".join(keep)
        spans = len([x for x in bytes(mask).split(b"\0") if x])
        out[i] = (len(units), sum(mask), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.fixture(scope="module")
def copies(prose, odd):
    base = [prose(200, s) for s in range(5)]
    rng = random.Random(0)
    texts = list(odd)
    for i in range(25):
        parts = [prose(rng.randrange(5, 40), 100 + i)]
        for _ in range(2):
            words = rng.choice(base).split()
            at = rng.randrange(0, 140)
            parts.append(" ".join(words[at : at + rng.randrange(45, 60)]))
            parts.append(prose(rng.randrange(5, 60), 200 + i))
        texts.append(" ".join(parts))
    return texts + ["tick " * 400, "tick " * 300, base[0], base[0]]


def test_substring_words(make, copies):
    got = rows(substring.dedup_words(make(copies, True)))
    want = brute_windows(dict(enumerate(copies)), False)
    assert {i: (r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in got.items()} == {i: (a, b, d) for i, (a, b, _, d) in want.items()}
    assert sum(w[1] for w in want.values()) > 500


def test_substring_index_does_not_depend_on_batches(make, copies):
    docs = make(copies)
    one = sorted(map(tuple, substring.dedup_words(docs, batches=1).collect()))
    assert sorted(map(tuple, substring.dedup_words(docs, batches=7, fanout=3).collect())) == one


def test_suffix_bytes(make, copies):
    got = rows(suffix.dedup_bytes(make(copies, True)))
    want = brute_windows(dict(enumerate(copies)), True)
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in got.items()} == want


def test_long_documents_cross_chunks(make, prose, monkeypatch):
    text = prose(400, 9)
    values = substring.word_units(text.encode())
    whole = {int(a) for a in repeats.rolling(values, 50, repeats._ONE)}
    monkeypatch.setattr(repeats, "CHUNK", 64)
    parts = [repeats.rolling(piece, 50, repeats._ONE) for _, piece in repeats.chunks(values, 50)]
    assert {int(a) for p in parts for a in p} == whole and sum(map(len, parts)) == len(values) - 49


def test_empty_tables(make):
    none = make([])
    assert substring.dedup_words(none).count() == suffix.dedup_bytes(none).count() == 0
    assert exact_dedup.exact_groups(none).count() == simhash.near_components(none).count() == 0
    assert simhash.one_per_component(none).count() == exact_dedup.unique_rows(none).count() == 0


def test_exact_groups(make, odd):
    got = rows(exact_dedup.exact_groups(make(odd, True)))
    norm = {i: "".join(c for c in (t or "") if c not in " \t\n\v\f\r") for i, t in enumerate(odd)}
    for i, t in enumerate(odd):
        group = [j for j in norm if norm[j] == norm[i]]
        keep = min(group, key=lambda j: (-len(odd[j] or ""), j))
        assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (keep, len(group), i == keep)
        assert got[i]["text_sha256"] == hashlib.sha256(norm[i].encode()).hexdigest()


def test_exact_unique_rows_with_repeated_ids(make):
    docs = make([(1, "a b", "en", "s"), (1, "a b", "en", "s"), (1, "c", "en", "s"), (2, "ab", "en", "s"), (None, "c ", "en", "s"), (None, "z", "en", "s")])
    kept = sorted(((r.doc_id, r.text) for r in exact_dedup.unique_rows(docs).collect()), key=str)
    assert kept == sorted([(1, "a b"), (None, "c "), (None, "z")], key=str)
    assert exact_dedup.unique_rows(docs).columns == docs.columns


def test_exact_is_native(make):
    plan = exact_dedup.exact_groups(make(["a", "b"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute_simhash(text):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_simhash_components(make, odd, prose):
    texts = [*odd, *(prose(300, 7) + f" tail{i}" for i in range(12)), prose(300, 7)]
    got = rows(simhash.near_components(make(texts, True)))
    prints = {i: brute_simhash(t) for i, t in enumerate(texts)}
    assert {i: r["fp"] & (2**64 - 1) for i, r in got.items()} == prints
    assert {i: r["component_id"] for i, r in got.items()} == brute_components(list(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)


@pytest.mark.parametrize("most_pairs", [128, 2])
def test_links_are_complete(spark, most_pairs):
    rng = random.Random(6)
    centres = [rng.getrandbits(64) for _ in range(12)]
    prints = set(centres)
    for c in centres:
        for _ in range(12):
            prints.add(c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 4))))
    signed = np.array(sorted(prints), np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = {(r.node): r.root for r in graph.components(simhash.links(df, most_pairs)).collect()}
    want = brute_components(signed, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 2)
    assert {n: found.get(n, n) for n in signed} == want


def test_components_long_chain(spark):
    order = list(range(300))
    random.Random(1).shuffle(order)
    df = spark.createDataFrame(list(zip(order, order[1:], strict=False)), "u long, v long")
    assert {r.root for r in graph.components(df).collect()} == {0}


def test_stage_drops_near_copies_only(make, prose):
    words = prose(300, 11).split()
    copy = words.copy()
    copy[100], copy[200] = "other", "words"
    docs = make([" ".join(words), prose(300, 12), " ".join(copy), prose(50, 13), "", None])
    kept = sorted(r.doc_id for r in simhash.one_per_component(docs).collect())
    assert kept == [0, 1, 3, 4, 5]
    assert simhash.one_per_component(docs).columns == docs.columns
    many = make([" ".join([*words[:i], f"w{i}", *words[i + 1 :]]) for i in range(150)])
    assert [r.doc_id for r in simhash.one_per_component(many, most_pairs=16).collect()] == [0]


def test_null_ids(make, prose):
    docs = make([(None, prose(80, 1), "en", "a"), (3, prose(80, 1), "en", "a"), (None, None, None, None)])
    assert substring.dedup_words(docs).count() == suffix.dedup_bytes(docs).count() == simhash.near_components(docs).count() == 3
    got = {(r.doc_id, r.n_words): r.n_removed for r in substring.dedup_words(docs).collect()}
    assert got == {(None, 80): 80, (3, 80): 0, (None, 0): 0}
    assert simhash.near_components(docs).where(F.col("component_id") == 3).count() == 2


def shingles(text):
    words = [w.lower() for w in text.split()]
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    return bool(a and b) and 5 * len(a & b) >= 4 * len(a | b)


def around(prose, seed, groups=20):
    """Texts in groups of six: one and copies of it with words changed, some 0.6 to 0.95 alike."""
    rng = random.Random(seed)
    texts = []
    for g in range(groups):
        words = prose(250, 1000 * seed + g).split()
        for changes in (0, 2, 4, 5, 6, 8):
            copy = words.copy()
            for at in rng.sample(range(250), changes):
                copy[at] = f"w{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    return texts


def test_similar_links_equal_brute_force(make, odd, prose):
    texts = [*odd, *around(prose, 5)]
    sets = [shingles(t or "") for t in texts]
    found = {r.node: r.root for r in graph.components(simhash.similar_links(make(texts, True))).collect()}
    want = brute_components(range(len(texts)), lambda a, b: alike(sets[a], sets[b]))
    assert {i: found.get(i, i) for i in range(len(texts))} == want


def test_similar_links_are_similar(make, prose):
    texts = around(prose, 7)
    sets = [shingles(t) for t in texts]
    links = simhash.similar_links(make(texts)).collect()
    assert links and all(alike(sets[r.u], sets[r.v]) for r in links)


def test_crowded_buckets_lose_no_pair(make, prose):
    """Many texts that are mostly one passage, under 0.8 alike, and true copies of some of them."""
    passage = prose(160, 3)
    texts = [f"{passage} {prose(60, 5000 + i)}" for i in range(120)]
    texts += [t + " end" for t in texts[20:60]]
    sets = [shingles(t) for t in texts]
    found = {r.node: r.root for r in graph.components(simhash.similar_links(make(texts), most_pairs=8)).collect()}
    want = brute_components(range(len(texts)), lambda a, b: alike(sets[a], sets[b]))
    assert len(set(want.values())) == 120
    assert {i: found.get(i, i) for i in range(len(texts))} == want


def test_near_stage_takes_every_link_of_the_fingerprints(spark, make, odd, prose):
    """Texts that fingerprints link, though their shingle sets are not alike, are one group too; so is what both reach together."""
    import corpus_pipeline

    loops = ["tick tock " * 200 + prose(n, 80 + n) for n in (3, 9, 20)] + ["hum " * 300 + t for t in ("end", "stop here")]
    texts = [*odd, *loops, *around(prose, 9, groups=6), loops[0] + " one more"]
    prints = [brute_simhash(t) for t in texts]
    sets = [shingles(t or "") for t in texts]
    near = lambda a, b: bool(sets[a] and sets[b]) and (prints[a] ^ prints[b]).bit_count() <= 2
    want = brute_components(range(len(texts)), lambda a, b: near(a, b) or alike(sets[a], sets[b]))
    alone = brute_components(range(len(texts)), lambda a, b: alike(sets[a], sets[b]))
    assert sum(want[i] == i for i in want) < sum(alone[i] == i for i in alone)
    docs = make(texts, True)
    kept = corpus_pipeline.drop_near(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == [i for i in want if want[i] == i]
    assert kept.columns == docs.columns


@pytest.mark.parametrize("letters", ["ab", "abcd"])
def test_suffix_short_windows(make, letters):
    """Every window of eight bytes against brute force."""
    rng = random.Random(len(letters))
    texts = ["".join(rng.choices(letters, k=rng.randrange(0, 90))) for _ in range(60)]
    got = rows(suffix.dedup_bytes(make(texts), window=8, gram=4, with_bytes=True))
    first = {}
    for i, t in enumerate(texts):
        gone = bytearray(len(t))
        for p in range(len(t) - 7):
            if first.setdefault(t[p : p + 8], i) < i:
                gone[p : p + 8] = b"\1" * 8
        assert bytes(got[i]["kept"]).decode() == "".join(c for c, g in zip(t, gone, strict=True) if not g)
        assert got[i]["n_removed"] == sum(gone)


def test_runs_hold_every_window_once_at_any_piece(monkeypatch):
    """Runs of a batch with null, empty, short and long texts; cut or not, each window has the same anchor."""
    import pyarrow as pa

    from sequora.llm import anchors

    rng = random.Random(3)
    texts = [None, b"", b"short", *(bytes(rng.choices(b"abcde ", k=rng.randrange(40, 400))) for _ in range(20)), None]
    column = pa.array([b"before", *texts], pa.binary()).slice(1)

    def windows():
        found = {}
        for part in anchors.runs(*anchors.buffer(column), 50, 24):
            for text, start, at, count, anchor in zip(part.text, part.start, part.at, part.count, part.anchor, strict=True):
                for j in range(count):
                    assert (text, start + j) not in found and start + j <= at <= start + j + 26
                    found[text, start + j] = (at, anchor)
        return found

    whole = windows()
    assert set(whole) == {(i, p) for i, t in enumerate(texts) for p in range(len(t or b"") - 49)}
    monkeypatch.setattr(anchors, "PIECE", 64)
    assert windows() == whole
