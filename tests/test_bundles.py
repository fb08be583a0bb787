"""Libraries in bundles: places against plain searches, signature files, ranges, odd rows."""

import random

import pytest

from quillscan.operators import bundles as B

TOML = r"""
[[lib]]
name = "One"
author = "Ann"
license = "MIT"
family = "permissive"
min_hits = 1
copyright = "(c) Ann"
source = ""
strings = [{ p = "aba", d = "first", c = 0.5 }, { p = "ab", d = "inner", c = 0.9 }, { p = "", d = "nothing", c = 1.0 }]
constants = [{ v = "baba", d = "number", c = 0.7 }]
versions = [{ r = "one/(\\d+\\.\\d+)", d = "" }]

[[lib]]
name = "Two"
author = "Bob"
license = "Own"
family = "unheard of"
min_hits = 2
copyright = "(c) Bob"
source = ""
commercial_restriction = "never"
strings = [{ p = "aba", d = "shared", c = 0.4 }, { p = "é→x", d = "wide", c = 0.8 }]
"""
FILES = "path string, text string, library string"


def test_places_equal_plain_searches():
    sigs = B.parse_signatures(TOML)
    assert [(s.family, s.restriction, len(s.texts), len(s.numbers)) for s in sigs] == [("permissive", None, 3, 1), ("permissive", "never", 2, 0)]
    searcher, rng = B.Searcher(sigs), random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b", "é→x", "\n", "var ", "}).call", ";var ", "function"]) for _ in range(rng.randint(0, 40)))
        found = {lib["library"]: lib for lib in searcher.libraries(text)}
        for s, sig in enumerate(sigs):
            there = [(t, lined) for lined, part in ((True, sig.texts), (False, sig.numbers)) for t, _, _ in part if t and t in text]
            assert (s in found) == (len(there) >= sig.least_hits)
            if s in found:
                want = [(t, len(text[: text.find(t)].encode()), text[: text.find(t)].count("\n") + 1 if lined else None) for t, lined in there]
                assert [(h["text"], h["at"], h["line"]) for h in found[s]["hits"]] == want
                first, last = min(text.find(t) for t, _ in there), max(text.find(t) for t, _ in there)
                assert (found[s]["start"], found[s]["end"]) == tuple(len(text[:p].encode()) + max(0, p - len(text)) for p in B.covered(text, first, last))


def test_ranges():
    assert B.covered("x var a; function b KEY..LAST..;var c", 20, 25) == (2, 31)
    assert B.covered("function b KEY LAST})(x", 11, 15) == (0, 19)
    assert B.covered("KEY", 0, 0) == (0, 1000)
    assert B.covered("KEY" + "é" * 2499 + ";var ", 0, 0) == (0, 1000)  # the end lies beyond 5,000 bytes


def test_reports_of_odd_rows(spark, tmp_path):
    (tmp_path / "s.toml").write_text(TOML)
    sigs = B.load_signatures(spark, str(tmp_path))
    long = "z" * 400_000 + "aba" + "é→x" + "q" * 400_000
    rows = [
        ("p/a.js", "var m=aba; // Copyright 2020 Zoe. All rights reserved", "clash"),
        ("p/a.js", "var m=aba; // Copyright 2020 Zoe. All rights reserved", "clash"),
        ("p/b.css", "aba é→x (c) Bob one/1.25", ""),
        ("q/c.mjs", "aba (c) Ann", ""),
        ("q/LICENSE", "aba", ""),
        ("d.html", None, ""),
        ("p/empty.js", "", ""),
        ("p/long.cjs", long, ""),
        ("p/aba.txt", "aba", ""),
        (".js", "aba", ""),
        (None, "aba", ""),
    ]
    reports = B.bundle_reports(spark.createDataFrame(rows, FILES).repartition(3), sigs)
    got = {}
    for r in reports.collect():
        got.setdefault(r.path, []).append(r)
    assert set(got) == {"p/a.js", "p/b.css", "q/c.mjs", "d.html", "p/empty.js", "p/long.cjs"} and len(got["p/a.js"]) == 2
    a, b, c = got["p/a.js"][0], got["p/b.css"][0], got["q/c.mjs"][0]
    assert a.integrity == "CopyrightFraud" and not a.attributed and a.claims[0].holder == "Zoe. All rights reserved" and a.claims[0].year == "2020"
    assert [lib.name for lib in b.libraries] == ["One", "Two"] and b.libraries[0].version == "1.25" and b.libraries[1].version is None
    assert b.integrity == "LicenseViolation" and c.integrity == "Clean" and c.attributed
    assert got["d.html"][0].size == 0 and got["d.html"][0].integrity == got["p/empty.js"][0].integrity == "Clean" and got["d.html"][0].foreign_bytes == 0
    lib = got["p/long.cjs"][0].libraries[1]
    assert (lib.start, lib.end, lib.hits[1].at) == (400_000, 401_006, 400_003) and got["p/long.cjs"][0].foreign_bytes == 1006  # the wide text has three characters in six bytes
    assert a.third_party == 100.0 and a.original == 0 and a.foreign_bytes == a.size
    found = {(f.file, f.vtype, f.library) for f in B.bundle_findings(reports).collect()}
    assert {("p/a.js", "StrippedLicense", "One"), ("p/a.js", "LicenseTextTampering", "One"), ("p/a.js", "LicenseTextTampering", None), ("p/b.css", "CommercialUseViolation", "Two")} <= found
    assert not [f for f in found if f[0] == "q/c.mjs"]
    assert B.bundle_reports(spark.createDataFrame([], FILES), sigs).count() == 0
    assert B.bundle_reports(spark.createDataFrame(rows, FILES), []).filter("size(libraries) > 0").count() == 0
    with pytest.MonkeyPatch.context() as m:
        m.setattr(B, "SIGNATURE_BYTES", 10)
        with pytest.raises(ValueError):
            B.load_signatures(spark, str(tmp_path))
