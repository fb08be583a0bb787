"""The licence classifier against a plain reader, and attribution of a few projects by hand."""

import random

from pyspark.sql import functions as F

from quillscan.operators import attribution as A
from quillscan.operators import classification as C
from quillscan.refdata_licences import LICENCES


def read(text, phrases):
    """Phrases as a reader finds them who stops at the first end of any, at the longest that ends there."""
    low, out, start = text.lower(), [], 0
    for end in range(1, len(low) + 1):
        ending = [p for p in phrases if end - len(p) >= start and low.startswith(p, end - len(p))]
        if ending:
            out.append(max(ending, key=len))
            start = end
    return out


def test_phrases_as_a_reader_finds_them(spark):
    rng = random.Random(3)
    ids = [i.lower() for i in C.IDS]
    pieces = [*C.PHRASES, *C.IDS, "either ", "a", " ", "G", "-only", "GNU ", "l", "the "]
    texts = ["".join(rng.choice((str.upper, str.lower, str))(rng.choice(pieces)) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string").select("k", C.phrase_hits(F.col("text")).alias("p"), F.transform(F.regexp_extract_all("text", F.lit(C.earliest(C.IDS)), F.lit(0)), F.lower).alias("i"), C.classified(F.col("text")).alias("c")).collect()
    for r in rows:
        hits, named = read(texts[r.k], list(C.PHRASES)), read(texts[r.k], ids)
        assert r.p == hits and r.i == named
        want = []
        if named:
            best = max(dict.fromkeys(named), key=lambda x: (named.count(x), -named.index(x)))
            want.append((-min(0.95, 0.7 + 0.05 * named.count(best)), 0, next(i for i in C.IDS if i.lower() == best)))
        for k, row in enumerate(LICENCES, 1):
            n = sum(C.PHRASES[h][0] == row[0] for h in hits)
            if n:
                want.append((-min(0.9, 0.5 + n / len(row[9]) * 0.4), k, row[0]))
        low = texts[r.k].lower()
        has = {c: all(any(t in low for t in some) for some in lists) for c, lists in C.CLAUSES.items()}
        want += [(-conf, 99, lic) for must, mustnt, lic, conf in C.BY_CLAUSES if all(has[c] for c in must) and not any(has[c] for c in mustnt)][:1]
        want.sort(key=lambda w: (round(w[0], 9), w[1]))
        assert (r.c is not None) == bool(want)
        if want:
            assert [r.c.licence, *(a.licence for a in r.c.alternatives)] == [w[2] for w in want] and abs(r.c.confidence + want[0][0]) < 1e-9


def test_directives_and_odd_texts(spark):
    texts = [
        "x\n// SPDX-License-Identifier:  MIT OR Apache-2.0 \n", "/* SPDX-License-Identifier: ISC */*/", "SPDX-License-Identifier: */\r\n * SPDX-License-Identifier: Zlib\r\n",
        "\n" * 50 + "SPDX-License-Identifier: Zlib", "// see SPDX-License-Identifier: Zlib", None, "", "plain words", "z" * 300_000 + " GPLv2",
        "a derivative work under the same terms; interact with it remotely", "a derivative work under the same terms", "Copyright Notice and permission notice, AS IS, without warranty", "GPL-3.0 GPLv2 gplv2 GPL-3.0",
    ]
    got = {r.k: r.c for r in spark.createDataFrame(list(enumerate(texts)), "k int, text string").select("k", C.classified(F.col("text")).alias("c")).collect()}
    assert [got[k] and got[k].licence for k in range(len(texts))] == ["MIT OR Apache-2.0", "ISC", "Zlib", None, None, None, None, None, "GPLv2", "AGPL-3.0-only", "GPL-2.0-only", "MIT", "GPL-3.0"]
    assert got[0].confidence == 0.99 and abs(got[12].confidence - 0.8) < 1e-9 and got[9].confidence == 0.75 and got[9].method == "StructuralAnalysis"


FILES = [
    ("a", "LICENSE", "MIT License, The MIT License, permission is hereby granted"), ("a", "COPYING", "GPLv2 GPLv2"), ("a", "notice.md", "one"), ("a", "NOTICE.md", "uses ONE"),
    ("a", "vendor/one/LICENSE-APACHE", "Apache License"), ("a", "node_modules/one/x.js", "bare"),
    ("a", "deps/@s/two/src/a.py", "# SPDX"), ("a", "deps/@s/two/src/b.py", "no"), ("a", "deps/@s/two/1/2/3/4/5.py", "no"), ("a", "deps/@s/two/1/2/3/4/5/6.py", "no"), ("a", "deps/@s/two/1/2/3/4/5/7.py", "no"),
    ("a", "vendor/twofold/LICENSE", "x"), ("a", "dist/big.js", "x" * 10_000), ("a", "dist/named.css", "/** @preserve */" + "x" * 10_000), ("a", "dist/small.js", "x"), ("a", "src/dist/big.js", "x" * 20_000), ("a", "dist/1/2/3/4/big.mjs", "x" * 20_000),
    ("b", "sub/LICENSE", "MIT"), ("b", "vendor/one/readme", None), ("b", None, "x"), (None, "LICENSE", "MIT"), ("b", "vendor/one/y.go", "// license " + "y" * 300_000), ("b", "vendor/one/y.go", "// license " + "y" * 300_000),
]
DEPS = [("a", "one", "Apache-2.0"), ("a", "one", "Apache-2.0"), ("a", "@s/two", "MIT"), ("a", "two", "MIT"), ("a", "absent", "Apache-2.0"), ("a", None, "MIT"), ("b", "one", "MIT"), ("b", "odd", None), ("c", "one", "Apache-2.0"), (None, "one", "MIT")]


def _check(spark, projects, files, deps):
    return A.check(
        spark.createDataFrame(projects, "project string, licence string, folder int"),
        spark.createDataFrame([(*f, "clash") for f in files], "project string, path string, text string, name string").repartition(3),
        spark.createDataFrame([(*d, 1) for d in deps], "project string, name string, licence string, said int"),
    )


def test_projects(spark):
    got = _check(spark, [("a", "GPL-2.0-only", 1), ("b", "MIT", 1), ("b", "MIT", 2), ("c", "MIT", 1), ("d", None, 1), (None, "MIT", 1)], FILES, DEPS)
    status = {(r.project, r.name): (r.folder, r.has_licence, r.matches, r.in_notice, r.headers_kept) for r in got.dependencies.collect()}
    assert status == {
        ("a", "one"): ("vendor/one", True, True, True, None),
        ("a", "@s/two"): ("deps/@s/two", False, None, None, False),
        ("a", "two"): (None, False, None, None, None),
        ("a", "absent"): (None, False, None, False, None),
        ("b", "one"): ("vendor/one", False, None, None, True),
        ("b", "odd"): (None, False, None, None, None),
        ("c", "one"): (None, False, None, False, None),
    }
    found = sorted(((r.project, r.vtype, r.severity, r.subject, r.evidence) for r in got.findings.collect()), key=str)
    assert found == sorted(
        [
            ("a", "IncorrectAttribution", "Critical", ".", "MIT"),
            ("a", "MissingNoticeFile", "Low", "absent", "Apache-2.0"),
            ("a", "StrippedLicense", "High", "@s/two", "deps/@s/two"),
            ("a", "StrippedLicense", "Medium", "@s/two", "deps/@s/two"),
            ("a", "MissingAttribution", "Low", "dist/big.js", "10000"),
            ("b", "MissingAttribution", "Medium", ".", "MIT"),
            ("b", "StrippedLicense", "High", "one", "vendor/one"),
            ("c", "MissingAttribution", "Medium", ".", "MIT"),
            ("c", "MissingNoticeFile", "Medium", ".", "1"),
            ("d", "MissingAttribution", "Medium", ".", None),
        ],
        key=str,
    )
    scores = {r.project: (r.n_dependencies, r.built_files, r.built_bare, round(r.completeness, 6)) for r in got.scores.collect()}
    assert scores == {"a": (4, 3, 1, round(0.8 * 0.25 + 0.2 * (2 / 3), 6)), "b": (2, 0, 0, 0.25), "c": (1, 0, 0, 0.0), "d": (0, 0, 0, 1.0)}


def test_empty_tables(spark):
    none = _check(spark, [], FILES, DEPS)
    assert none.scores.count() == 0
    alone = _check(spark, [("z", "MIT", 1)], [], [])
    assert [tuple(r) for r in alone.scores.collect()] == [("z", 0, 0, 0, 1.0)] and alone.dependencies.count() == 0
    assert [(r.vtype, r.subject) for r in alone.findings.collect()] == [("MissingAttribution", ".")]


def _shuffled(spark):
    """Rows that all stages so far wrote for a shuffle."""
    sc, jvm = spark.sparkContext._jsc.sc(), spark.sparkContext._jvm
    sc.listenerBus().waitUntilEmpty()
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_vendored_folders_by_one_shuffle(spark):
    """Folders against a plain reader; without broadcasts a file or dependency is shuffled about once, not once for every vendor folder."""
    rng = random.Random(5)
    names = ["a", "@s", "@s/b", "x/y/z", "a/", "", "a/b"]
    deps = [(p, n, "MIT") for p in range(40) for n in names if rng.random() < 0.7]
    files = sorted({(p, f"{rng.choice([*A.VENDOR_FOLDERS, 'src'])}/{rng.choice(names)}/{'q/' * rng.randint(0, 1)}{f}", "x") for p in range(40) for f in ("LICENSE", "m.py", "z") for _ in range(2)})
    want = {}
    for p, n, _ in deps:
        tops = [t for t in A.VENDOR_FOLDERS if any(q == p and f.startswith(f"{t}/{n}/") for q, f, _ in files)]
        held = [f[len(f"{tops[0]}/{n}/") :] for q, f, _ in files if q == p and f.startswith(f"{tops[0]}/{n}/")] if tops else []
        sources = [f for f in held if f.endswith(".py") and f.count("/") < A.VENDOR_DEPTH]
        want[p, n] = (f"{tops[0]}/{n}" if tops else None, "LICENSE" in held, len(sources) if tops else None)
    flags = A._flags(spark.createDataFrame(files, "project int, path string, text string"))
    wanted = spark.createDataFrame(deps, "project int, name string, licence string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = _shuffled(spark)
        got = {(r.project, r.name): (r.folder, bool(r.has_licence), r.sources) for r in wanted.join(A._vendored(flags, wanted), ["project", "name"], "left").collect()}
        rows = _shuffled(spark) - before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == want and any(w[0] and not w[1] for w in want.values()) and any(w[1] for w in want.values())
    assert rows <= len(deps) + 4 * len(files) + 50


def test_only_what_is_needed_is_gathered_by_project(spark):
    """Files that tell nothing of a project are not shuffled for its score, dependencies that owe no notice not for its notice."""
    projects = [(f"p{k}", "MIT", 1) for k in range(300)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        start = _shuffled(spark)
        got = _check(spark, projects, [(p, f, "x") for p, _, _ in projects for f in ("src/x.py", "README")] + [("p0", "NOTICE", "x")], [("p0", f"d{k}", "MIT") for k in range(300)] + [("p0", "X", "Apache-2.0")])
        kept = {r.name: r.in_notice for r in got.dependencies.collect()}
        checked = _shuffled(spark)
        scores = got.scores.collect()
        scored = _shuffled(spark) - checked
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(kept) == 301 and kept.pop("X") is True and set(kept.values()) == {None}
    assert len(scores) == 300 and {r.project: r.n_dependencies for r in scores}["p0"] == 301
    # projects, or dependencies, once; beside them a few rows a partition (repartition(3) deals 601 files)
    assert scored <= 300 + 50 and checked - start <= 601 + 301 + 50
