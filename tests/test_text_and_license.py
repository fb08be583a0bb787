"""Text primitives and licence rules on literal rows."""

import hashlib

from pyspark.sql import functions as F

from quillscan.functions import license as L
from quillscan.functions import text as T
from quillscan.functions.spdx import parse


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v")).alias("r")).first().r


def test_lines(spark):
    assert one(spark, "a\r\nb\n", T.lines) == ["a", "b"]
    assert one(spark, "a\n\nb", T.lines) == ["a", "", "b"]


def test_ngrams_and_winnow(spark):
    assert one(spark, "a b c d", lambda c: T.ngrams(T.tokens(c), 3)) == ["a b c", "b c d"]
    assert one(spark, "a b", lambda c: T.ngrams(T.tokens(c), 3)) == []
    words = [f"w{k}" for k in range(20)]
    hashes = [int.from_bytes(hashlib.sha256(" ".join(words[i : i + 5]).encode()).digest()[:8], "little") for i in range(16)]
    want = list(dict.fromkeys(f"{min(hashes[i : i + 4]):016x}" for i in range(13)))
    assert one(spark, " ".join(words), lambda c: T.winnow(T.tokens(c))) == want


def test_occurrences_do_not_overlap(spark):
    assert one(spark, "aaaa", lambda c: T.occurrences(c, "aa")) == 2


def test_stem(spark):
    assert one(spark, "camelCase", T.stem) == "camel_case"
    assert one(spark, "XMLParser", T.stem) == "x_m_l_parser"


def test_cosine(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), ([0.0], [1.0])], "a array<double>, b array<double>")
    assert [r.c for r in rows.select(T.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [1.0, 0.0, 0.0]


def test_licence_of_text(spark):
    texts = {
        "Permission is hereby grаnted,  free of charge": "MIT",
        "GNU General Public License, version 3": "GPL-3.0-only",
        "Redistribution and use in source and binary forms": "BSD-2-Clause",
        "Apache License\nVersion 2.0": "Apache-2.0",
        "nothing here": None,
    }
    got = spark.createDataFrame(list(texts.items()), "t string, w string").select("w", L.licence_of_text(F.col("t")).alias("g")).collect()
    assert all(r.w == r.g for r in got)


def test_family(spark):
    want = {"BSL-1.0": "Permissive", "BUSL-1.1": "SourceAvailable", "Elastic-2.0": "SourceAvailable", "MIT WITH Commons-Clause": "SourceAvailable", "GPL-2.0-or-later": "StrongCopyleft", "GPL-3.0+": "StrongCopyleft", "AGPL-3.0-only": "NetworkCopyleft", "Nothing-1": "Unknown"}
    got = spark.createDataFrame(list(want.items()), "i string, w string").select("w", L.family(F.col("i")).alias("g")).collect()
    assert all(r.w == r.g for r in got)


def test_chimera(spark):
    text = "Permission is hereby granted, free of charge. Under the terms of the GNU General Public License. Apache License."
    assert sorted(one(spark, text, L.families_in_text)) == ["Apache", "GPL", "MIT"]


def test_compatibility(spark):
    f = F.lit(False)
    rows = [("GPL-2.0-only", "GPL-3.0-only", "Incompatible"), ("MIT", "GPL-3.0-only", "Conditional"), ("GPL-3.0-only", "Proprietary", "Incompatible"), ("CC0-1.0", "MIT", "Compatible"), ("GPL-3.0-only", "Apache-2.0", "Compatible")]
    got = spark.createDataFrame(rows, "u string, d string, w string").select("w", L.compatibility(F.col("u"), F.col("d"), f, f, f).alias("g")).collect()
    assert all(r.w == r.g for r in got)


def test_spdx():
    assert parse("(MIT OR Apache-2.0) AND CC-BY-4.0") == (True, ["MIT", "Apache-2.0", "CC-BY-4.0"], [], True, True)
    assert parse("GPL-2.0-only OR MIT")[4] and not parse("GPL-2.0-only AND MIT")[4]
    assert parse("GPL-2.0-only WITH Classpath-exception-2.0")[2:] == (["Classpath-exception-2.0"], False, True)
    assert not any(parse(x)[0] for x in ("", "MIT AND", "(MIT", "MIT MIT", None))


def test_slices_bound_what_workers_build(monkeypatch):
    """Every row once, in order; few rows and characters at a time, but for a longer text."""
    import pandas as pd

    monkeypatch.setattr(T, "SLICE_ROWS", 4)
    monkeypatch.setattr(T, "SLICE_CHARS", 10)
    texts = pd.Series(["abc"] * 9 + [None, "", "x" * 50, "yy"])
    parts = [texts.iloc[s] for s in T.slices(texts)]
    assert [v for p in parts for v in p] == list(texts)
    assert all(len(p) <= 4 and (len(p) == 1 or p.fillna("").str.len().sum() <= 10) for p in parts) and len(parts) > 4
    assert list(T.slices(texts.iloc[:0])) == []


def test_winnowed_over_many_slices(spark):
    from pyspark.sql import functions as F

    rows = [(k, None if k % 97 == 0 else " ".join(f"w{(k * j) % 13}" for j in range(k % 30))) for k in range(1, 700)]
    df = spark.createDataFrame(rows, "k int, text string").coalesce(1)
    got = df.select("k", T.winnowed("text").alias("a"), T.winnow(T.tokens(F.col("text"))).alias("b")).collect()
    assert len(got) == 699 and all((r.a or []) == (r.b or []) for r in got)


def test_expanded_rows_are_spread(spark, tmp_path):
    """What is made from a small file is made by more than one task."""
    from quillscan.queries import binaries, deobfuscation, scripts

    spark.createDataFrame([(k, f"a b{k}", "Brand#1", "X Y", k, 900.5) for k in range(50)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for rows, n in ((scripts.texts(spark, str(tmp_path)), 100), (deobfuscation.scripts(spark, str(tmp_path)), 50), (binaries.binaries(spark, str(tmp_path)).filter("path LIKE '%/tool'"), 50)):
        sizes = [s for s in rows.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect() if s]
        assert sum(sizes) == n and len(sizes) > 1 and max(sizes) < n
