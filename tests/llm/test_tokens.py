"""Token counts, packing and binary records against the libraries themselves."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillscan.llm import packing, records
from quillscan.llm.token_counts import token_counts
from quillscan.llm.tokenizing import Encoder

BYTE, WORD, PIECE = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


@pytest.mark.parametrize("path", [BYTE, WORD, PIECE])
def test_segments_give_the_librarys_ids(path):
    import pyarrow as pa

    rng = random.Random(1)
    parts = ["a", "the", "The", "'s", "I'll", " ", "  ", "\n", "\n\n", "\t", "\r\n", "é", "́", " ", "　", "\x1c", "\x85", "12", "3.5", "!!", "<|endoftext|>", "<s>", "▁", "中", "😀", "\x02", "\x03", "x" * 40]
    texts = ["".join(rng.choice(parts) + rng.choice(("", " ")) for _ in range(rng.randint(0, 30))) for _ in range(600)]
    enc = Encoder(path)
    want = enc.whole(texts)
    ids, ends = enc.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [w.tolist() for w in want]
    assert enc.count(pa.array(texts)).tolist() == [len(w) for w in want]


def test_whole_token_table_is_proven():
    enc = Encoder(PIECE)
    assert enc.cuts and len(enc.alone) > 10_000
    sample = sorted(enc.alone)[::50]
    assert all(len(x) == 1 for x in enc.sp.encode(sample))


def test_token_counts(docs, doc_rows, no_docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    want = {r[0]: (len((r[1] or "").encode()), len(sp.encode(r[1] or "")), len(sp.encode(r[1] or "")) > 100) for r in doc_rows}
    got = token_counts(docs, PIECE, context=100).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in got} == want and len(got) == len(doc_rows)
    assert token_counts(no_docs, PIECE).count() == 0


def test_records_round_trip(spark, docs, doc_rows, no_docs):
    tk = Tokenizer.from_file(BYTE)
    start, want = 0, []
    for r in sorted(doc_rows, key=lambda r: r[0]):
        ids = tk.encode(r[1] or "", add_special_tokens=False).ids + [0]
        want.append((r[0], start, len(ids), crc(ids), ids))
        start += len(ids)
    manifest = records.write_records(docs, BYTE)
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32, r.ids) for r in records.read_records(spark, manifest, with_ids=True).collect())
    assert got == want
    shard = next(r.asDict() for r in manifest.collect() if r.n_records > 3)
    some = records.read_at(shard, [2, 0])
    first = next(k for k, w in enumerate(want) if w[1] == shard["base"])
    assert [x.tolist() for x in some] == [want[first + 2][4], want[first][4]]
    assert records.read_records(spark, records.write_records(no_docs, BYTE)).count() == 0


def test_records_with_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a b"), (3, "x"), (3, "x"), (-1, None)], "doc_id long, text string")
    got = records.read_records(spark, records.write_records(df, BYTE)).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == [("-1", 1), ("3", 2), ("3", 2), ("None", 3)]


def test_damage_is_found():
    good = records.frame(b"payload")
    assert bytes(records.unframe(memoryview(good), 0)[0]) == b"payload"
    for k in range(len(good)):
        bad = bytearray(good)
        bad[k] ^= 1
        with pytest.raises(records.CorruptRecord):
            records.unframe(memoryview(bytes(bad)), 0)
    with pytest.raises(records.CorruptRecord):
        records.unframe(memoryview(good[:-1]), 0)


def test_packing(docs, doc_rows, no_docs):
    tk = Tokenizer.from_file(WORD)
    packed = packing.pack_documents(docs, WORD, capacity=256, with_ids=True)
    rows = packed.collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        assert crc(r.ids) == r.ids_crc32 and len(r.ids) == r.length
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for r in doc_rows:
        ids = tk.encode(r[1] or "", add_special_tokens=False).ids + [1]
        mine = sorted(by_doc[r[0]], key=lambda x: x.start)
        assert [i for x in mine for i in x.ids] == ids and [x.start for x in mine] == np.cumsum([0] + [x.length for x in mine])[:-1].tolist()
        assert all(x.doc_tokens == len(ids) for x in mine)
    for group in by_sequence.values():
        group.sort(key=lambda x: x.offset)
        assert [x.offset for x in group] == np.cumsum([0] + [x.length for x in group])[:-1].tolist()
        assert sum(x.length for x in group) <= 256
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    total = sum(r.length for r in rows)
    assert len(by_sequence) * 256 <= 1.05 * total + 256
    assert packing.sequences(packed, 256).filter(F.size("ids") != 256).count() == 0
    assert packing.pack_documents(no_docs, WORD).count() == 0


def test_cutting_stock_is_near_its_bound():
    rng = np.random.default_rng(0)
    weight, demand = np.unique(np.minimum(64, np.ceil(rng.lognormal(2.5, 1, 5000))).astype(int), return_counts=True)
    patterns, counts, bound = packing.cutting_stock(weight, demand.astype(float), 64)
    assert ((patterns * counts[:, None]).sum(axis=0) == demand).all() and (patterns @ weight).max() <= 64
    assert counts.sum() <= bound * 1.01 + 2


def test_few_encodings_are_held():
    """The word vocabulary's encodings, with offsets, come a few at a time and give the same ids."""
    import pyarrow as pa

    enc = Encoder(WORD)
    library, calls = enc.tk, []

    class Counting:
        def encode_batch(self, texts, **options):
            calls.append(len(texts))
            return library.encode_batch(texts, **options)

    enc.tk = Counting()
    texts = [" ".join(f"w{k}x{j}" for j in range(50)) for k in range(200)]
    ids, _ = enc.encode(pa.array(texts))
    assert max(calls) <= 16 and len(calls) > 1
    assert ids.tolist() == [i for t in texts for i in library.encode(t, add_special_tokens=False).ids]


def test_slice_of_a_worker_changes_no_piece(spark):
    docs = spark.createDataFrame([(k, f"word{k} " * (k * 40)) for k in range(40)], "doc_id long, text string")
    few, many = (sorted(packing.pieces_of(docs, WORD, slice_bytes=n).collect()) for n in (500, packing.TOKEN_SLICE))
    assert few == many
