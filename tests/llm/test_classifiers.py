import collections
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from maskwright.llm import language_id as L
from maskwright.llm import nbsvm as N
from maskwright.llm import queries

AT = "/root/testdata/sf0.01"


def test_presence_matches_sets():
    texts = ["Abc, abc 1x", "", "...", "ß" * 5, "a" * 600_000]
    rows = L.presence(texts)
    assert rows[0].sum() > 0 and not rows[1].any() and not rows[2].any() and rows[4].sum() == 8
    assert (L.presence(["abc  abc x"])[0] == rows[0]).all()
    assert (L.presence(texts[3:4])[0] == rows[3]).all()


def test_languages_are_recognised_on_held_out_rows(spark):
    rows = queries.op6_language_id(spark, AT).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{AT}/documents.parquet").collect()}
    assert len(rows) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out]
    assert sum(held) / len(held) > 0.98


def test_language_of_odd_rows(spark, odd_docs, no_docs):
    model = L.fit(["the cat sat on the mat", "der hund und die katze"] * 3, ["en", "de"] * 3)
    rows = L.add_predictions(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and {r.lang_pred for r in rows if r.doc_id in (3, 4, 5)} == {"und"}
    assert L.add_predictions(no_docs, model).count() == 0 and L.train(no_docs) is None
    assert {r.lang_pred for r in L.add_predictions(odd_docs, None).collect()} == {"und"}
    assert L.accept(odd_docs).columns == odd_docs.columns
    assert {r.doc_id for r in L.accept(odd_docs).collect()}.isdisjoint({3, 4, 5})


def test_quality_is_learned_on_held_out_rows(spark):
    rows = {r.doc_id: r for r in queries.op8_quality_classifier(spark, AT).collect()}
    labels = spark.read.parquet(f"{AT}/labels.parquet").collect()
    right = [rows[x.doc_id].predicted == x.quality for x in labels if rows[x.doc_id].held_out]
    assert len(right) > 50 and sum(right) / len(right) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows.values())


def test_indicators_match_one_text_at_a_time():
    texts = ["a b a b", None, "", " x ", "one two  three\nfour!! FIVE!!", "w " * 500] * 40
    together = N.indicators(pa.array(texts))
    assert all((a == N.indicators(pa.array([t], pa.string()))[0]).all() for t, a in zip(texts, together))
    assert len(together[1]) == len(together[2]) == 0 and len(together[0]) > 3


def test_dual_coordinate_descent_reaches_the_optimum():
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(60, 5)), np.where(rng.random(60) < 0.5, 1.0, -1.0)
    x[:, 0] += y
    rows = [np.arange(5)] * 60
    weight = N.dual_coordinate_descent(rows, list(x), y, np.ones(60), epochs=3000)[:5]
    loss = lambda w: w @ w / 2 + np.maximum(0, 1 - y * (x @ w)).sum()
    best = min(loss(weight + d) for d in rng.normal(0, 0.01, (500, 5)))
    assert loss(weight) <= best + 1e-2


def test_quality_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (2, 1), (6, 0), (8, 1), (None, 0), (9, None), (77, 0)], "doc_id long, quality int")
    model = N.train(odd_docs, labels)
    rows = N.add_scores(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert N.add_scores(no_docs, model).count() == 0
    assert {r.score for r in N.add_scores(odd_docs, N.train(odd_docs, labels.limit(0))).collect()} == {0.5}
    assert N.train(odd_docs, labels.where("quality = 1")).constant in (0.5, 1.0)
    assert N.accept(odd_docs, labels).columns == odd_docs.columns


def test_any_characters_are_read_alike_alone_and_together():
    rng = random.Random(5)
    parts = ["\0", "\0\0", "a", "Ab", " ", "é", "İ", "ß", "日本", "1", ".", "\n", "\x85", "ﬁ", "Σς", "\U0001f600"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(400)] + ["\0", "", "\0a", "a\0"]
    together = L.presence(texts)
    assert all((L.presence([t])[0] == row).all() for t, row in zip(texts, together))
    found = N.indicators(pa.array(texts, pa.string()))
    assert all((a == N.indicators(pa.array([t], pa.string()))[0]).all() for t, a in zip(texts, found))


def slow_presence(text):
    """The places of a text's n-grams, one at a time."""
    letters, out = "".join(c if c.isalpha() else " " for c in text.lower() + "."), set()
    squeezed, last = [], " "
    for c in letters:
        if c != " " or last != " ":
            squeezed.append(c)
        last = c
    if not any(c.isalpha() for c in squeezed):
        return out
    mask = (1 << 64) - 1
    for at in range(len(squeezed)):
        value = 0
        for n in range(1, 5):
            if at + n > len(squeezed):
                break
            c = squeezed[at + n - 1]
            value = (value * 0x9E3779B97F4A7C15 & mask) ^ ((ord(c) if c != " " else 32) + n)
            out.add(((value ^ value >> 29) * 0xBF58476D1CE4E5B9 & mask) >> 48)
    return out


def test_kernel_regression_matches_explicit_kernels():
    """The folded weights against landmark kernels, their inverse square root and ridge regression written out."""
    texts = ["the cat sat on the mat", "a dog and the cat", "der hund und die katze", "die maus und der hund", "le chat et le chien", "la souris et le chat"]
    langs = ["en", "en", "de", "de", "fr", "fr"]
    model = L.fit(texts, langs, landmarks=6, ridge=1e-3)
    order = [2, 0, 4, 3, 1, 5]  # de, en, fr in turn, as landmarks are taken
    sets = [slow_presence(texts[k]) for k in order]
    kernel = lambda a, b: len(a & b) / np.sqrt(len(a) * len(b))
    k = np.array([[kernel(a, b) for b in sets] for a in sets])
    values, vectors = np.linalg.eigh(k)
    root = vectors @ np.diag(values**-0.5)
    mapped = k @ root
    target = np.array([[1.0 if langs[o] == c else -1.0 for c in ("de", "en", "fr")] for o in order])
    beta = np.linalg.solve(mapped.T @ mapped / 2 + 1e-3 * np.eye(6), mapped.T @ target / 2)
    asked = ["the hund sat", "katze und maus", "le dog", "x"]
    want = np.array([[kernel(slow_presence(t), s) for s in sets] for t in asked]) @ root @ beta
    got, _ = model.scores(asked)
    assert np.allclose(got, want, atol=1e-3)


def slow_indicators(text):
    """Words, word pairs and one to three word shapes of a text as a set of named features."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    shapes = [N.shape(w) + ("=" if k and words[k - 1] == w else "") for k, w in enumerate(words)]
    out = {("w", w) for w in words} | {("s", s) for s in shapes} | set(zip("p" * len(words), words, words[1:]))
    return out | set(zip("2" * len(words), shapes, shapes[1:])) | set(zip("3" * len(words), shapes, shapes[1:], shapes[2:]))


def test_quality_scores_match_sets():
    """Ratios and margins from feature sets against those from hashed places."""
    good = ["The river runs past %s and the old mill." % w for w in ("Anna", "Berta", "Clara", "Dora", "Emma", "Frida")]
    bad = ["%s %s !!! buy buy now 99" % (w, w) for w in ("win", "cash", "free", "deal", "sale", "gold")]
    texts, labels = good + bad, np.array([1] * 6 + [0] * 6)
    model = N.fit(texts, labels)
    learn = [k for c in (0, 1) for r, k in enumerate(np.flatnonzero(labels == c)) if r % 4 != 3]
    sets = {k: slow_indicators(t) for k, t in enumerate(texts)}
    counts = {c: collections.Counter(f for k in learn if labels[k] == c for f in sets[k]) for c in (0, 1)}
    total = {c: sum(counts[c].values()) + N.PLACES for c in (0, 1)}
    ratio = {f: np.log((counts[1][f] + 1) / total[1]) - np.log((counts[0][f] + 1) / total[0]) for f in counts[0] | counts[1]}
    rows = N.indicators(pa.array(texts))
    for k in learn:
        assert len(rows[k]) == len(sets[k])
        assert np.allclose(sorted(model.ratio[rows[k]]), sorted(ratio[f] for f in sets[k]))
    # A margin is the weights of a text's scaled, unit-length indicators; scores are the logistic curve over it.
    for k, r in enumerate(rows):
        v = model.ratio[r]
        margin = sum(a * b for a, b in zip(model.weight[r], v)) / np.sqrt(max(sum(v * v), 1e-12))
        assert np.isclose(model.margins([r])[0], margin)
        assert np.isclose(model.scores([r])[0], 1 / (1 + np.exp(-(model.slope * margin + model.shift))))
    assert all((model.margins([r])[0] > 0) == (y == 1) for r, y in zip(rows, labels))


def test_ids_with_both_labels_are_not_learned_from(spark):
    docs = spark.createDataFrame([(i, f"text {i} " + ("good words here" if i % 2 else "x x x !!!")) for i in range(40)], "doc_id long, text string")
    clean = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    doubled = clean.union(spark.createDataFrame([(1, 0), (2, 1), (5, 5), (7, None)], clean.schema))
    without = clean.where("doc_id not in (1, 2)")
    a, b = N.train(docs, doubled), N.train(docs, without)
    assert (a.weight == b.weight).all() and a.slope == b.slope
    assert N.add_scores(docs.union(docs), a).count() == 80
