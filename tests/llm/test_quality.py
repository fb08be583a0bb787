"""The line model: marginals against enumeration, held-out accuracy, odd tables."""

import itertools
import random
import zlib

import numpy as np
import pytest

from quillscan.llm import quality


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    doc = np.repeat(np.arange(6), [1, 5, 2, 7, 1, 3])
    unary, edge = rng.normal(size=len(doc)) * 4, rng.normal(size=(2, 2)) * 2
    p, pair = quality.marginals(unary, edge, doc)
    for d in range(6):
        at = np.flatnonzero(doc == d)
        total, good, both = 0.0, np.zeros(len(at)), np.zeros((len(at) - 1, 2, 2))
        for labels in itertools.product((0, 1), repeat=len(at)):
            e = np.exp(sum(unary[a] * v for a, v in zip(at, labels)) + sum(edge[a, b] for a, b in zip(labels, labels[1:])))
            total += e
            good += e * np.asarray(labels)
            for k, (a, b) in enumerate(zip(labels, labels[1:])):
                both[k, a, b] += e
        assert np.allclose(p[at], good / total) and np.allclose(pair[at[:-1]], both / total)
    assert (pair[np.flatnonzero(np.diff(doc))] == 0).all()
    long = quality.marginals(np.full(100_000, 30.0), np.zeros((2, 2)), np.zeros(100_000, int))[0]
    assert np.allclose(long, 1)


def test_lines():
    data = [b"ab c\n\n  \nd\n", b"", b"\n", b"x y", b"z\n"]
    buf, offs = np.frombuffer(b"".join(data), np.uint8), np.concatenate(([0], np.cumsum([len(d) for d in data])))
    start, end, doc = quality.lines(buf, offs)
    assert [(bytes(buf[a:b]), d) for a, b, d in zip(start, end, doc.tolist())] == [(b"ab c\n", 0), (b"d\n", 0), (b"x y", 3), (b"z\n", 4)]


def texts():
    """Bad documents hold lines with symbols after words, or repeat themselves; good ones are plain."""
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    rows, labels = [], []
    for k in range(400):
        good = k % 4 > 0
        out = []
        for n in range(rng.randint(2, 12)):
            w = [rng.choice(vocabulary) for _ in range(rng.randint(5, 20))]
            if not good and n % 3 < 2:
                w = [x + rng.choice(("##", "$$", "%%")) for x in w] if k % 8 else [w[0]] * 15
            out.append(" ".join(w) + ".")
        rows.append((k, "\n".join(out), "clash", 0.5))
        labels.append((k, int(good), 0))
    return rows, labels


@pytest.fixture(scope="module")
def fitted(spark):
    rows, labels = texts()
    odd = [(900, None, "", 0.0), (901, "", "", 0.0), (902, " \n\t\n", "", 0.0), (None, "a plain line", "", 0.0), (903, "x" * 300_000, "", 0.0), (904, "line\n" * 50_000, "", 0.0)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, predicted string, held_out double").repartition(3)
    marks = spark.createDataFrame([*labels, (None, 1, 0), (5, None, 0), (6, 7, 1), (4000, 0, 0)], "doc_id long, quality int, toxic int")
    return docs, marks, quality.train(docs, marks), dict((a, b) for a, b, _ in labels)


def test_held_out_documents_are_told_apart(fitted):
    docs, _, model, known = fitted
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert len(got) == 406 and all(0 <= r.score <= 1 for r in got.values()) and got[3].predicted == "clash"
    held = [k for k in known if zlib.crc32(str(k).encode()) % 5 == 0]
    assert sum((got[k].score >= quality.THRESHOLD) == known[k] for k in held) >= 0.95 * len(held)
    assert got[900].score == got[901].score == got[902].score == model.base == pytest.approx(0.75, abs=0.05)
    text = {r.doc_id: r.text for r in docs.collect()}
    for k in (0, 1, 77, None):  # a text alone scores as in a batch
        data = np.frombuffer(text[k].encode(), np.uint8)
        assert model.scores(data, np.asarray([0, len(data)]))[0] == pytest.approx(got[k].score, abs=1e-9)


def test_training_is_bounded_and_without_held_out_rows(spark, fitted, monkeypatch):
    docs, marks, model, known = fitted
    seen = []
    monkeypatch.setattr(quality, "learn", lambda t, y, w: seen.append((t, y, w)))
    monkeypatch.setattr(quality, "TRAIN_DOCS", 20)
    many = docs.unionByName(spark.range(3000).selectExpr("1L doc_id", "concat('copy ', id) text", "'' predicted", "0D held_out"))
    quality.train(many, marks)
    (t, y, _), = seen
    assert y.count(0) <= 20 and y.count(1) <= 20 and len(t) == len(y) == 40
    held = {r.text for r in docs.collect() if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    assert not held & set(t)


def test_empty_tables(spark, fitted):
    docs, marks, model, _ = fitted
    assert quality.score(docs.limit(0), model).count() == 0
    none = quality.train(docs, marks.limit(0))
    assert {r.score for r in quality.score(docs, none).collect()} == {1.0}
    one = quality.train(docs, marks.filter("quality = 1"))
    assert {r.score for r in quality.score(docs, one).collect()} == {1.0}
    assert quality.train(docs.limit(0), marks).base == 1.0
    with pytest.raises(ValueError):
        quality.score(docs.withColumnRenamed("predicted", "score"), model)
