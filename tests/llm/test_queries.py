"""Every query of the subpackage on the driver's smallest tables, against plain versions of what it must return."""

import hashlib
import os
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from test_text import linked, removed
from test_whitening import plain

from quillscan.llm import pii
from quillscan.llm import queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(table):
    import duckdb

    return duckdb.sql(f"SELECT * FROM '{SF}/{table}.parquet'").fetchall()


@pytest.fixture(scope="module")
def texts():
    return {r[0]: r[1] or "" for r in rows_of("documents")}


@pytest.fixture(scope="module")
def vectors():
    return {r[0]: np.asarray(r[1], dtype=np.float64) for r in rows_of("embeddings") if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])}


def run(spark, name):
    return Q.QUERIES[name](spark, SF).collect()


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def by_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = Q.QUERIES[name](spark, SF), con.sql(Q.ORACLE_SQL[name])
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    return sorted(repr(tuple(r)) for r in got.select(*cols).collect()), sorted(repr(r) for r in want.select(", ".join(cols)).fetchall())


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_sql(spark, name):
    got, want = by_sql(spark, name)
    assert got == want


def test_op1(spark, texts):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    want = {k: (len(t.encode()), n := len(model.encode(t)), n > 4096) for k, t in texts.items()}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in run(spark, "op1_token_counts")} == want


def test_op3(spark, texts):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    model.no_truncation()
    model.no_padding()
    ids = {k: [*model.encode(t, add_special_tokens=False).ids, 1] for k, t in texts.items()}
    got, by_doc, by_sequence = run(spark, "op3_packing"), {}, {}
    for r in got:
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == crc(ids[r.doc_id][r.start : r.start + r.length]) and r.length > 0
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    gapless = lambda parts: min(parts)[0] == 0 and all(a + n == b for (a, n), (b, _) in zip(sorted(parts), sorted(parts)[1:]))
    assert set(by_doc) == set(texts) and all(gapless(p) and sum(n for _, n in p) == len(ids[k]) for k, p in by_doc.items())
    assert all(gapless(p) and sum(n for _, n in p) <= 2048 for p in by_sequence.values())
    held = [sum(n for _, n in p) for p in by_sequence.values()]
    padded = sum(n if n & (n - 1) == 0 else 2048 for n in held)
    assert sum(held) / padded > 0.95


def test_op4(spark, vectors):
    usable = {k: v for k, v in vectors.items() if v.any()}
    keys = np.asarray(sorted(usable))
    x = np.stack([usable[k] for k in keys])
    got, hits, total = {}, 0, 0
    for r in run(spark, "op4_nearest_neighbours"):
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {k for k in usable if k % 20 == 0}
    for q, found in got.items():
        score = x @ usable[q]
        score[keys == q] = -np.inf
        best = keys[np.lexsort((keys, -score))][:20]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21)) and all(s == pytest.approx(float(usable[q] @ usable[v]), rel=1e-12) for _, v, s in found) and sorted(found, key=lambda f: (-f[2], f[1])) == found
        hits, total = hits + len(set(best.tolist()) & {f[1] for f in found}), total + 20
    assert hits >= 0.9 * total


def test_op5(spark, texts):
    known = {r[0]: r[2] for r in rows_of("documents")}
    got = {r.doc_id: r for r in run(spark, "op5_language_id")}
    assert set(got) == set(texts) and all(r.held_out == (zlib.crc32(str(k).encode()) % 4 == 2) and 0 <= r.score <= 1 for k, r in got.items())
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in texts[k])) for k, r in got.items())
    held = [k for k, r in got.items() if r.held_out and known[k] is not None and r.lang_pred != "und"]
    assert sum(got[k].lang_pred == known[k] for k in held) >= 0.9 * len(held)


def test_op6(spark, texts):
    source = {r[0]: r[3] for r in rows_of("documents")}
    size = {k: len(WORD.findall(t)) for k, t in texts.items()}
    sources = sorted({s for s in source.values() if s is not None}) + ([None] if None in source.values() else [])
    weight, have = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}, {s: sum(size[d] for d in size if source[d] == s) for s in sources}
    target, left, capped = {}, 1.5 * sum(have.values()), set()
    while True:
        open_ = [s for s in sources if s not in capped]
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * have[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s], left = 2.0 * have[s], left - 2 * have[s]
            capped.add(s)
    got = {r.doc_id: r for r in run(spark, "op6_source_mixing")}
    assert {k: (r.size, r.source_size) for k, r in got.items()} == {k: (size[k], have[source[k]]) for k in size}
    assert all(r.target == pytest.approx(target[source[k]]) and 0 <= r.taken <= 2 * r.size for k, r in got.items())
    for s in sources:
        assert sum(r.taken for k, r in got.items() if source[k] == s) == pytest.approx(target[s], abs=max(1, 0.01 * target[s]))


def test_op7(spark, texts):
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in run(spark, "op7_substring_dedup")} == removed(list(texts.items()))


def test_op8(spark, texts):
    names = ["email", "ip", "card", "phone"]
    got = {r.doc_id: r for r in run(spark, "op8_personal_data")}
    assert set(got) == set(texts)
    for k, text in texts.items():
        data = text.encode()
        spans = [(len(data[:s].decode()), kind, len(data[:e].decode())) for s, kind, e in pii.base_spans(data)]
        said = [f"{names[kind]}:{s}:{e}" for s, kind, e in sorted(spans)]
        r = got[k]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[1] == n for x in spans) for n in range(4)]
        assert r.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest() and set(said) <= set(r.spans.split(","))


def test_op9(spark, texts):
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in run(spark, "op9_jaccard_join")} == linked(list(texts.items()))


def test_op10(spark, texts):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    model.no_truncation()
    model.no_padding()
    want, at = {}, 0
    for k in sorted(texts):
        ids = [*model.encode(texts[k], add_special_tokens=False).ids, 0]
        want[k] = (at, len(ids), crc(ids))
        at += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in run(spark, "op10_token_records")} == want


def test_op11(spark, vectors):
    keys = sorted(vectors)
    z, _, cov, deviation = plain([vectors[k] for k in keys])
    e, u = np.linalg.eigh(np.asarray(cov, dtype=np.float64))
    e, u = e[::-1][:8], u[:, ::-1][:, :8]
    want = (z / len(keys)).astype(np.float64) @ u / np.sqrt(e)
    got = {}
    for r in run(spark, "op11_embedding_whitening"):
        got[r.vec_id, r.component] = r
    assert set(got) == {(k, c) for k in keys for c in range(1, 9)} and len({r.identity_error for r in got.values()}) == 1
    mine = np.asarray([[got[k, c].whitened for c in range(1, 9)] for k in keys])
    assert np.allclose(mine * np.sign((mine * want).sum(axis=0)), want, rtol=1e-6, atol=1e-8)
    assert [got[k, 1].deviation for k in keys] == deviation and {r.n for r in got.values()} == {len(keys)}
    total = float(sum(cov[k][k] for k in range(len(cov))))
    assert all(got[keys[0], c + 1].explained == pytest.approx(e[c] / total, rel=1e-4) for c in range(8)) and max(r.identity_error for r in got.values()) < 1e-4


def test_op13(spark, texts):
    marks = {r[0]: r[1] for r in rows_of("labels")}
    got = {r.doc_id: r for r in run(spark, "op13_quality_classifier")}
    assert set(got) == set(texts)
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for k, r in got.items())
    held = [k for k, r in got.items() if r.held_out and marks.get(k) is not None]
    good, bad = [got[k].score for k in held if marks[k] == 1], [got[k].score for k in held if marks[k] == 0]
    assert not good or not bad or np.mean([g > b for g in good for b in bad]) > 0.8
