"""Importance resampling against a plain version."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quillscan.llm import importance


def features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(w), Counter(zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1))


def plain(docs, target, percent=5):
    all_, goal = Counter(), Counter()
    for _, t in docs:
        all_ += features(t)[1]
    for t in target:
        goal += features(t)[1]
    s_all, t_all = sum(all_.values()) + 10_000, sum(goal.values()) + 10_000
    gain = lambda b: math.floor(1000 * math.log(((goal[b] + 1) * s_all) / ((all_[b] + 1) * t_all)))
    out = []
    for i, t in docs:
        n, f = features(t)
        weight = sum(c * gain(b) for b, c in f.items())
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, sum(f.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0], r[1], r[2]))
    drawn = percent * len(able) // 100
    rank = {}
    for k, r in enumerate(able[:drawn]):
        rank.setdefault(tuple(r[:4]), []).append(k + 1)
    return sorted(((*r[:4], rank[tuple(r[:4])].pop(0) if rank.get(tuple(r[:4])) else None) for r in out), key=repr)


def run(docs, target, **options):
    return sorted((tuple(r) for r in importance.resample(docs, target, **options).select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def test_counts_by_linear_checksums(doc_rows):
    texts = [r[1] or "" for r in doc_rows] + ["q" * 63 + " " + "r" * 64 + " " + "s" * 65 + " t u", "é" * 40 + " ü", "A" * 500]
    data = [t.encode() for t in texts]
    offs = np.concatenate(([0], np.cumsum([len(d) for d in data])))
    n, at, bucket, count = importance.count_matrix(np.frombuffer(b"".join(data), np.uint8), offs)
    for k, t in enumerate(texts):
        words, want = features(t)
        assert n[k] == words and dict(zip(bucket[at[k] : at[k + 1]].tolist(), count[at[k] : at[k + 1]].tolist(), strict=True)) == want


def test_steps_inside_a_long_text(monkeypatch):
    monkeypatch.setattr(importance, "_WORDS", 7)
    test_counts_by_linear_checksums([(0, " ".join(f"w{k % 11}" for k in range(200))), (1, "a b c"), (2, "")])


def test_resample(docs, spark, doc_rows):
    rows = [(r[0], r[1]) for r in doc_rows]
    target = [rows[3][1], None, "one two three"]
    goal = spark.createDataFrame([(1, t, "clash") for t in target], "item_id int, text string, rank string")
    assert run(docs, goal) == plain(rows, target)
    assert run(docs, goal, percent=40) == plain(rows, target, 40)


def test_repeated_rows_and_null_ids(spark):
    base = " ".join(f"w{k}" for k in range(30))
    rows = [(7, base)] * 50 + [(None, base), (None, base + " w"), (8, base), (9, None), (9, "few words"), (10, base.upper())] + [(k, base + f" w{k % 3}") for k in range(20, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    none = spark.createDataFrame([], "text string")
    assert run(df, none, percent=30) == plain(rows, [], 30)


def test_empty(docs, no_docs, spark):
    assert run(no_docs, docs) == []
    assert all(r[4] is None for r in run(docs.filter("length(text) < 20"), no_docs))
    assert importance.resample(docs, docs).agg(F.count("rank")).first()[0] > 0


def test_blocks_are_bounded(spark, doc_rows, monkeypatch):
    """No row of the written matrix holds more counts than the bound, unless it is one document; results stay."""
    monkeypatch.setattr(importance, "_CELL", 200)
    rows = [(r[0], r[1]) for r in doc_rows]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    blocks = importance.csr_blocks(df).selectExpr("rows", "length(counts) div 4 AS n").collect()
    assert sum(b.rows for b in blocks) == len(rows) and len(blocks) > 1
    assert all(b.n <= 200 or b.rows == 1 for b in blocks)
    goal = spark.createDataFrame([("one two three",)], "text string")
    assert run(df, goal) == plain(rows, ["one two three"])
    assert importance._blocks(np.asarray([0, 0, 5, 9, 9, 30, 31]), 9) == [(0, 4), (4, 5), (5, 6)]
