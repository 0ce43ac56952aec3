"""The dataset manifest and the divergence audit against plain Python, and their SQL on the smallest tables."""

import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import pytest
from oracle import connect, same
from pyspark.sql import functions as F

from sequora.llm import divergence, manifest, registry
from sequora.llm.common import ascii_lower


def h(text):
    return sha256(text.encode()).hexdigest()


def written(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def siblings(all_levels, at):
    for nodes in all_levels[:-1]:
        run = at // 16 * 16
        yield "".join(nodes[run:at]), "".join(nodes[at + 1 : run + 16])
        at //= 16


def plain_manifest(rows):
    trees = defaultdict(list)
    for r in rows:
        doc_id, text, lang, source, n = r
        fields = [doc_id, source, lang, n]
        leaf = h("".join(map(written, [*fields, text])))
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0
        changed = h("".join(map(written, [*fields, text if text is None else low(text)]))) if hit else leaf
        trees["" if source is None else "+" + source].append((doc_id is not None, doc_id or 0, leaf, doc_id, changed))
    order = sorted(trees, key=str.encode)
    below = {t: levels([x[2] for x in sorted(trees[t])]) for t in order}
    above = levels([below[t][-1][0] for t in order])
    out = []
    for i, t in enumerate(order):
        for at, (_, _, leaf, doc_id, changed) in enumerate(sorted(trees[t])):
            path = [*siblings(below[t], at), *siblings(above, i)]
            node = changed
            for before, after in path:
                node = h(before + node + after)
            out.append((doc_id, leaf, below[t][-1][0], above[-1][0], h("".join(b + a for b, a in path)), node, node == above[-1][0]))
    return out


def proven(docs, *levels):
    return manifest.manifest(docs, manifest.one_in(F.col("doc_id")), *levels)


def rows_of(docs):
    return [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs.collect()]


@pytest.mark.parametrize("depth", [1, 2])
def test_manifest_against_plain_python(make, odd, prose, depth):
    """Trees of one, sixteen, seventeen and three hundred leaves, null sources, ids and texts, repeated rows, clashing names."""
    texts = [(i, t, None if i % 4 else "en", None) for i, t in enumerate(odd)]
    texts += [(100 + i, f"Text {i} É", "de", "big") for i in range(300)] + [(500, "lone", "fr", "é")] + [(600 + i, "A", "fr", "a16") for i in range(16)] + [(700 + i, "b", None, "A17") for i in range(17)]
    texts += [(None, "no id", "en", "big")] * 3 + [(100, "TEXT again", "en", "big")] * 2 + [(101, "Text 1 É", "de", "big")] * 2 + [(5, prose(40000, 5), "en", "a16")]
    docs = make(texts, True)
    got = sorted(map(tuple, proven(docs.repartition(5), depth).collect()), key=str)
    assert got == sorted(plain_manifest(rows_of(docs)), key=str)


def test_manifest_of_one_source_one_row_and_none(make):
    assert proven(make([])).count() == 0
    for texts in (["Only"], ["x"] * 18):
        docs = make([(i, t, "en", "s") for i, t in enumerate(texts)])
        assert sorted(map(tuple, proven(docs).collect()), key=str) == sorted(plain_manifest(rows_of(docs)), key=str)


def test_many_sources_need_tiers_of_their_own(make):
    docs = make([(i, f"T{i}", "en", f"s{i % 19}") for i in range(60)])
    got = proven(docs, 1).collect()
    assert sorted(map(tuple, got), key=str) == sorted(plain_manifest(rows_of(docs)), key=str)
    assert {r.verified for r in got} == {True, False}


def test_walk_unwinds_what_the_fold_needs():
    for n in (1, 2, 16, 17, 256, 300):
        nodes = [h(str(i)) for i in range(n)]
        paths = [[] for _ in nodes]
        top = manifest.walk(nodes, manifest.height_of(n, 9), paths)
        assert top == levels(nodes)[-1][0]
        assert all(manifest.folded(node, path) == top for node, path in zip(nodes, paths, strict=True))


def plain_audit(rows, least=3, most=200):
    docs = [(lang or "", source or "", Counter(terms(text or ""))) for _, text, lang, source, _ in rows]
    holds, total, own, out = Counter(), Counter(), Counter(), []
    for lang, source, words in docs:
        for w, n in words.items():
            holds[lang, w] += 1
            total[lang, w] += n
            own[lang, source, w] += n
    kept = defaultdict(list)
    for (lang, w), n in holds.items():
        if n >= least:
            kept[lang].append(w)
    groups = {(lang, source) for lang, source, _ in docs}

    def shares(lang, counts):
        n = sum(counts)
        return [1 + 10**9 * (c + 1) // (n + len(counts)) for c in counts]

    ps = {g: shares(g[0], [own[*g, w] for w in kept[g[0]]]) for g in groups}
    qs = {lang: shares(lang, [total[lang, w] for w in kept[lang]]) for lang, _ in groups}
    f = lambda p, q: (p - q) * (p - q) // q
    for lang, source in groups:
        pairs = [(sum(map(f, ps[lang, source], ps[lang, o])), o) for a, o in groups if a == lang and o != source]
        words = [(f(p, q), w) for w, p, q in zip(kept[lang], ps[lang, source], qs[lang], strict=True) if own[lang, source, w] and p > q]
        for part, items, cut in (("pair", pairs, None), ("term", words, most)):
            ordered = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:cut]
            out += [(lang, source, part, item, value, i + 1) for i, (value, item) in enumerate(ordered)]
    return sorted(out)


def terms(text):
    import re

    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", low(text))


def test_audit_against_plain_python(make, odd, prose):
    """Null and empty columns, one hot group, groups without terms, a language that keeps none, ties, clashing names."""
    texts = [(i, t, "en" if i % 3 else None, "a" if i % 2 else None) for i, t in enumerate(odd)]
    texts += [(50 + i, prose(30 + i, i) + " Éa éA 日本", "en", f"s{i % 4}") for i in range(20)] + [(90 + i, "same Words here", "de", "hot") for i in range(30)]
    texts += [(200, "123 .", "de", "none"), (201, None, "de", ""), (202, "rare ones", "fr", "x"), (203, "other", "fr", "y"), (50, prose(30, 0), "en", "s0"), (50, prose(30, 0), "en", "s0")]
    docs = make(texts, True)
    got = divergence.audit(docs.repartition(5), salts=3)
    assert sorted(map(tuple, got.collect())) == plain_audit(rows_of(docs))
    assert divergence.audit(make([])).count() == 0


def test_audit_reports_two_hundred_terms(make):
    docs = make([(i, " ".join(chr(97 + j // 26) + chr(97 + j % 26) * (1 + j % 3) for j in range(260)) if i < 3 else "aa bb", "en", "a" if i < 3 else "b") for i in range(6)])
    got = [r for r in divergence.audit(docs).collect() if r.part == "term" and r.source == "a"]
    assert len(got) == 200 and sorted(map(tuple, divergence.audit(docs).collect())) == plain_audit(rows_of(docs))


def test_share_is_exact_beyond_64_bits(spark):
    row = spark.range(1).select(F.lit(40_000_000_000_000).alias("c"), F.lit(90_000_000_000_001).alias("t"), F.lit(7).cast("long").alias("v")).select(divergence.share("c", "t", "v").alias("p")).first()
    assert row.p == 1 + 10**9 * 40_000_000_000_001 // 90_000_000_000_008


def test_only_ascii_is_lowered(spark):
    texts = ["ABC xYz", "ÀB İK", "", None, "\x00Z"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(ascii_lower(F.col("t")).alias("l")).collect()
    assert [r.l for r in got] == [t if t is None else low(t) for t in texts]


@pytest.mark.parametrize("name", ["op11_manifest", "op12_divergence"])
def test_matches_sql(spark, make, small, name):
    same(registry.QUERIES[name](spark, small), connect(small), registry.ORACLES[name])
