import numpy as np
import pytest

from sequora.llm import langid, quality, toxicity
from sequora.llm.common import id_fold_value


@pytest.fixture(scope="module")
def labels(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_forward_sums_every_segmentation():
    pieces = ["a", "b", "ab", "ba", "aba", "▁", "▁a"]
    counts = np.array([[5.0, 3, 2, 4, 1, 6, 2], [1.0, 7, 3, 1, 2, 5, 1]])
    model = langid.Unigrams(["x", "y"], pieces, counts)
    p = {s: model.p[i] for i, s in enumerate(pieces)}

    def total(s):
        if not s:
            return np.ones(2)
        out = np.zeros(2)
        for k in range(1, len(s) + 1):
            if s[:k] in p:
                out += p[s[:k]] * total(s[k:])
            elif k == 1:
                out += 1e-7 * total(s[1:])
        return out

    words = ["a", "abab", "bbaabab", "aqa", "abababababababababab"]
    assert np.allclose(model.words(words), [np.log(total("▁" + w)) for w in words])


def test_language_held_out_and_odd_texts(spark, make, small, odd):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = langid.predict(docs, langid.fit(docs)).collect()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in found if r.held_out]
    assert len(found) == docs.count() and len(held) > 20
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in held]) >= 0.97
    assert all(r.held_out == (id_fold_value(r.doc_id, 4) == 2) for r in found)
    rows = {r.doc_id: r for r in langid.predict(make(odd, True), langid.fit(docs)).collect()}
    assert [rows[i].lang_pred for i in (0, 1, 2)] == ["und"] * 3 and rows[0].score == 0
    assert all(0 <= r.score <= 1 for r in rows.values())
    nothing = make([(1, "text", None, None), (2, None, "en", None)])
    assert {r.lang_pred for r in langid.predict(nothing, langid.fit(nothing)).collect()} == {"und"}
    assert langid.predict(make([]), None).count() == 0


def test_quality_held_out(spark, small):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    found = [r for r in quality.scores(docs, quality.fit(docs, labels)).collect() if r.held_out and r.doc_id in truth]
    assert np.mean([truth[r.doc_id] == r.predicted for r in found]) >= 0.95
    assert all(r.predicted == (r.score >= 0.3) for r in found)


def test_quality_odd_texts_and_labels(spark, make, labels, odd, prose):
    docs = make(odd, True)
    for rows, share in (([], 0.5), ([(5, 1, 0), (4, None, None), (None, 1, 1)], 1.0)):
        got = quality.scores(docs, quality.fit(docs, labels(rows))).collect()
        assert len(got) == len(odd) and {r.score for r in got} == {share}
    train = make([prose(40, i) if i % 2 else "!! ## " * 40 for i in range(60)])
    model = quality.fit(train, labels([(i, i % 2, 0) for i in range(60)]))
    again = quality.fit(train, labels([(i, i % 2, 0) for i in range(60)]))
    got = {r.doc_id: r.score for r in quality.scores(make(odd), model).collect()}
    assert got == {r.doc_id: r.score for r in quality.scores(make(odd), again).collect()}
    assert got[0] == got[1] == got[2] and all(0 <= s <= 1 for s in got.values())
    kept = quality.accepted(train, model)
    assert kept.columns == train.columns and {r.doc_id % 2 for r in kept.collect()} == {1}
    assert quality.accepted(make([]), model).count() == 0


def test_kernel_matches_its_definition():
    words = ["idiot", "idxiot", "iddiott", "moron", "ordinary", "ooo", "aaaa"]
    marks = toxicity.Landmarks(["idiot", "moron", "oooo"], least=0.05)
    near, values = marks.values(words)
    got = {words[i]: v for i, v in zip(near, values, strict=True)}
    for w in words:
        want = np.array([toxicity.kernel(w, m) for m in marks.words])
        want = np.where(want >= 0.05, want, 0)
        assert np.allclose(got.get(w, np.zeros(3)), want, atol=1e-5)


def test_kernel_tolerates_insertions():
    plain = toxicity.kernel("idiot", "ordinary")
    assert toxicity.kernel("idxiot", "idiot") > 0.5 > plain
    assert toxicity.units("you i d i o t now")[-1] == "idiot"
    assert toxicity.runs("i-d-i-o-t!") == ["idiot"]
    assert all(len(r) <= 24 for r in toxicity.runs("x" * 500))


def test_toxicity_held_out_and_odd(spark, make, labels, odd, prose):
    bad = ["grobnik", "slimewit", "dunderfool"]
    texts = [prose(30, i) + (f". {prose(2, i)} {bad[i % 3]} {prose(5, i)}" if i % 4 == 0 else "") for i in range(240)]
    docs = make(texts)
    table = labels([(i, 1, int(i % 4 == 0)) for i in range(240)])
    model = toxicity.fit(docs, table)
    got = {r.doc_id: r for r in toxicity.scores(docs, model).collect()}
    held = [i for i in got if got[i].held_out]
    assert len(held) > 20 and np.mean([got[i].predicted == (i % 4 == 0) for i in held]) >= 0.95
    fresh = make(["alpha beta gr-obnik gamma", "alpha s l i m e w i t beta", "alpha dunderxfool beta", "alpha beta gamma"])
    assert [r.predicted for r in sorted(toxicity.scores(fresh, model).collect())] == [1, 1, 1, 0]
    rows = {r.doc_id: r.score for r in toxicity.scores(make(odd, True), model).collect()}
    assert len(rows) == len(odd) and rows[0] == rows[1] == rows[2]
    assert {r.score for r in toxicity.scores(docs, toxicity.fit(docs, labels([]))).collect()} == {0.5}
    assert toxicity.scores(make([]), model).count() == 0
