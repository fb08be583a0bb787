"""Structure, headers and comparison on literal rows."""

from pyspark.sql import functions as F

from quillscan import catalog
from quillscan.operators import code, headers, structure
from quillscan.plans.comparison import compare


def test_signature(spark):
    text = "function f(x) { if (x) { return new Foo.Bar(1); } else { for (;;) {} } } React.createElement('a', \"b\"); React.createElement('a')"
    row = spark.createDataFrame([(text,)], "t string").select(structure.signature(F.col("t")).alias("s"), structure.calls(F.col("t")).alias("c"), structure.string_literals(F.col("t")).alias("n")).first()
    assert row.s == "FILErn" and row.c == ["Foo.Bar", "React.createElement"] and row.n == 2
    both = spark.createDataFrame([("FILErn", "FILrn"), ("", "")], "a string, b string").select(structure.sequence_similarity(F.col("a"), F.col("b")).alias("s"), structure.complexity(F.col("a")).alias("c")).collect()
    assert [(round(r.s, 4), r.c) for r in both] == [(0.8333, 3), (1.0, 1)]


def test_headers(spark):
    rows = [("a", "// SPDX-License-Identifier: MIT\n// Copyright (c) 2019-2021 Jane Roe\ncode"), ("b", "code only"), ("c", "// Code generated by x. DO NOT EDIT.\n"), ("d", "# SPDX-License-Identifier: GPL-3.0-only\n")]
    files = spark.createDataFrame(rows, "path string, text string")
    got = {r.path: r for r in headers.headers(files).collect()}
    assert (got["a"].licence, got["a"].confidence, got["c"].generated, got["b"].licence) == ("MIT", 0.99, True, None)
    assert sorted((r.path, r.vtype) for r in headers.header_findings(files, "MIT").collect()) == [("b", "MissingSpdxHeader"), ("d", "ManifestLicenseMismatch")]
    who = files.filter("path = 'a'").select(headers.copyrights(F.col("text")).alias("c")).first().c
    assert [(c.years, c.holder) for c in who] == [("2019-2021", "Jane Roe")]


def test_comparison(spark):
    body = " ".join(f"word{k}" for k in range(80))
    originals = spark.createDataFrame([(1, "o1", "// Copyright X\n" + body), (2, "o2", "other text entirely")], "ord long, path string, text string")
    suspects = spark.createDataFrame([(1, "s1", body), (2, "s2", "other text entirely"), (3, "s3", "unrelated")], "ord long, path string, text string")
    got = {(r.original, r.suspect): (r.kind, r.stripped_header) for r in compare(originals, suspects).collect()}
    assert got == {("o1", "s1"): ("near", True), ("o2", "s2"): ("exact", False)}


def test_short_and_lightly_edited_texts_match(spark):
    schema = "ord long, path string, text string"
    long = [f"w{k}" for k in range(60)]
    split = [w for k, w in enumerate(long) if k not in (10, 11)]
    part = "\n".join(["def {}(a):", "    x = 'a long enough line of the body'", "    y = 'and another one of them'", "    z = 3", "    print(x, y, z)"])
    references = [(1, "short", "Equal  FORM"), (2, "long", " ".join(long)), (3, "code", "fn a() {\n  if x { return 1 }\n}"), (4, "five", "a b c d e f g"), (5, "chunks", "\n".join(part.format(f"f{k}") for k in range(10)))]
    suspects = [(1, "s-short", "equal form // c"), (2, "s-long", " ".join(split)), (3, "s-code", "fn q() {\n  if yy { return 7 }\n}"), (4, "s-five", "a b c d e f g h"), (5, "s-none", "nothing"), (6, "s-chunks", "\n".join(part.format(f"f{k}") for k in (1, 0, *range(2, 10))))]
    got = {(r.suspect, r.reference): r.similarity for r in code.matches(*(code.fingerprint(spark.createDataFrame(x, schema)) for x in (suspects, references))).collect()}
    assert set(got) == {("s-short", "short"), ("s-long", "long"), ("s-code", "code"), ("s-five", "five"), ("s-chunks", "chunks")}
    assert (got["s-short", "short"], got["s-code", "code"], got["s-five", "five"]) == (1.0, 0.95, round(5 / 6, 6))


def test_comparison_reports_structure(spark):
    body = "function {0}({1}) {{ if ({1}) {{ return new Api.Thing({1}); }} else {{ for (;;) {{ while (true) {{ throw {1}; }} }} }} switch ({1}) {{ case 1: return 2; case 3: return 4; }} try {{ x }} catch (e) {{ Api.call({1}) }} }}"
    frame = lambda path, *names: spark.createDataFrame([(1, path, body.format(*names) + " " * 60)], "ord long, path string, text string")
    got = compare(frame("o", "first", "alpha"), frame("s", "other", "beta")).collect()
    assert [(r.original, r.suspect, r.kind, r.similarity) for r in got] == [("o", "s", "structural", 1.0)]


def test_code_queries_search_documents(spark, tmp_path):
    passage = " ".join(f"word{k}" for k in range(40))
    spark.createDataFrame([(1, passage + " end"), (2, passage), (3, "else")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(7, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    near = catalog.snippet_matches(spark, str(tmp_path)).collect()
    assert sorted((r.suspect, r.reference) for r in near) == [("documents/1.txt", "benchmark/7"), ("documents/2.txt", "benchmark/7")]
    both = catalog.file_set_comparison(spark, str(tmp_path)).collect()
    assert sorted((r.suspect, r.kind) for r in both) == [("documents/1.txt", "near"), ("documents/2.txt", "exact")]
