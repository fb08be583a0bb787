"""Readers of modules and programs: real files, every damage, odd rows."""

import os
import random
import struct
import sys

import pytest
from pyspark.sql import functions as F

from quillscan.operators import binaries as B
from quillscan.queries.binaries import KEY, elf, wasm

FILES = "path string, content binary, strings string"


def test_numbers():
    assert B.varint(b"\xe5\x8e\x26", 0) == (624485, 3) and B.varint(b"\xff\xff\xff\xff\x0f", 0)[0] == 2**32 - 1
    for bad in (b"", b"\x80", b"\xff\xff\xff\xff\x1f", b"\x80\x80\x80\x80\x80\x80\1"):
        with pytest.raises(B.Damaged):
            B.varint(bad, 0)


def test_modules_survive_any_damage():
    whole = wasm([("env", "f", b"\0\5"), ("env", "m", b"\2\1\1\x80\1"), ("e", "t", b"\1\x70\0\4"), ("e", "g", b"\3\x7f\1"), ("e", "x", b"\4\0\2")], [("run", 0), ("mém", 2)], b"data")
    full = B.module_of(whole)
    assert not full["damaged"] and [(s["number"], s["name"]) for s in full["sections"]] == [(2, None), (7, None), (11, None), (0, "producers")]
    assert [(e["name"], e["kind"]) for e in full["entries"]] == [("f", "function"), ("m", "memory"), ("t", "table"), ("g", "global"), ("x", "tag"), ("run", "function"), ("mém", "memory")]
    for cut in range(len(whole)):
        part = B.module_of(whole[:cut])
        assert part["entries"] == full["entries"][: len(part["entries"])]
        assert part["damaged"] or cut in (8, *(s["at"] + s["size"] for s in full["sections"]))
    rng = random.Random(1)
    for _ in range(2000):
        data = bytearray(whole)
        for _ in range(rng.randint(1, 6)):
            data[rng.randrange(8, len(data))] = rng.randrange(256)
        B.module_of(bytes(data))
    assert B.module_of(b"\0asm\1\0\0\0\2\xff\xff\xff\xff\x0f\xff\xff\xff\xff\x0f")["entries"] == []


@pytest.mark.parametrize(("wide", "order"), [(True, "<"), (True, ">"), (False, "<"), (False, ">")])
def test_elf(wide, order):
    data = elf(["liba.so", "libb.so"], ["g_object_new", "free"], ["main", "free"], wide, order)
    assert B.program_of(data) == {"format": "Elf", "needed": ["liba.so", "libb.so"], "exports": ["g_object_new", "free"], "symbols": ["main", "free", "g_object_new", "free"]}
    for cut in range(len(data)):
        assert B.program_of(data[:cut])["format"] in ("Elf", "Unknown")
    rng = random.Random(2)
    for _ in range(1000):
        bad = bytearray(data)
        for _ in range(rng.randint(1, 8)):
            bad[rng.randrange(4, len(bad))] = rng.randrange(256)
        B.program_of(bytes(bad))


def test_a_real_program():
    path = os.path.realpath(sys.executable)
    data = open(path, "rb").read()
    if data[:4] != b"\x7fELF":
        pytest.skip("not an ELF machine")
    p = B.program_of(data)
    assert any(n.startswith("libc.so") for n in p["needed"]) and "__libc_start_main" in p["exports"]


def pe(dlls, names, wide):
    """A PE file of one section at 0x1000, stored at 0x200."""
    body, at = bytearray(), lambda: 0x1000 + len(body)
    text = lambda s: (at(), body.extend(s.encode() + b"\0"))[0]
    placed = [text(d) for d in dlls]
    named = [text(n) for n in names]
    imports = at()
    body.extend(b"".join(struct.pack("<5I", 1, 0, 0, p, 1) for p in placed) + bytes(20))
    pointers = at()
    body.extend(struct.pack(f"<{len(named)}I", *named))
    exports = at()
    body.extend(struct.pack("<10I", 0, 0, 0, 0, 1, len(named), len(named), 0, pointers, 0))
    optional = (112 if wide else 96) + 16
    head = b"MZ" + bytes(58) + struct.pack("<I", 64) + b"PE\0\0" + struct.pack("<HHIIIHH", 0x8664, 1, 0, 0, 0, optional, 0)
    head += struct.pack("<H", 0x20B if wide else 0x10B) + bytes(optional - 18) + struct.pack("<4I", exports, 40, imports, 40)
    head += b".text\0\0\0" + struct.pack("<4I", len(body), 0x1000, len(body), 0x200) + bytes(16)
    return head.ljust(0x200, b"\0") + bytes(body)


@pytest.mark.parametrize("wide", [True, False])
def test_pe(wide):
    data = pe(["KERNEL32.dll", "libcurl.dll"], ["curl_easy_init", "start"], wide)
    assert B.program_of(data) == {"format": "Pe", "needed": ["KERNEL32.dll", "libcurl.dll"], "exports": ["curl_easy_init", "start"], "symbols": []}
    for cut in range(len(data)):
        B.program_of(data[:cut])


def test_odd_rows(spark):
    mod = wasm([("env", "f", b"\0\5")], [("run", 0)], b"see bark.us/x here\0github.com/own/tool\0github.com/lib/pq\0https://a.b/telemetry\0" + b"z" * 300_000)
    rows = [
        ("d/a.wasm", mod, "clash"), ("d/a.wasm", mod, "clash"), ("e/b.wasm", mod, ""), ("e/NOTICE", b"", ""), ("n", None, ""), ("m", b"", ""), ("x.wasm", b"\0asm", ""), (None, mod, ""),
        ("p", elf(["libGTK.so"], ["gtk_main_loop"], ["gpg_start", "gtk_a", "rl_x", "x264_go"]), ""), ("q", b"\xcf\xfa\xed\xfe LGPL and gpl, copyright (c) 2020 " + b"y" * 200, ""),
    ]
    files = spark.createDataFrame([(p, None if c is None else bytearray(c), s) for p, c, s in rows], FILES).repartition(3)
    got = {r.path: r for r in B.module_reports(files, collectors=["bark.us"], own=["own/"]).collect()}
    assert set(got) == {"d/a.wasm", "e/b.wasm", "x.wasm", None} and got["e/b.wasm"].noticed and not got["d/a.wasm"].noticed
    a = got["d/a.wasm"]
    assert a.compiler == "Go" and [(p.name, p.licence, p.own) for p in a.packages] == [("github.com/lib/pq", "MIT", False), ("github.com/own/tool", None, True)]
    assert [(x.url, x.kind) for x in a.addresses] == [("https://a.b/telemetry", "Telemetry"), ("bark.us", "DataCollection")] and got["x.wasm"].n_strings == 0
    found = sorted((f.file or "", f.vtype, f.package) for f in B.module_findings(B.module_reports(files, own=["own/"])).filter("file LIKE '%/%'").collect() if f.package)
    assert found == [("d/a.wasm", "MissingAttribution", "github.com/lib/pq")] * 2
    assert {(r.path, r.damaged, len(r.entries)) for r in B.modules(files).collect()} == {("d/a.wasm", False, 2), ("e/b.wasm", False, 2), (None, False, 2), ("x.wasm", True, 0)}
    programs = {r.path: r for r in B.programs(files).collect()}
    p = programs["p"]
    assert p.format == "Elf" and p.n_symbols == 5 and [(x.library, x.symbol, x.dynamic) for x in p.libraries] == [("GTK", "gtk_main_loop", True), ("GnuPG", "gpg_start", False)]
    assert programs["n"].format == programs["m"].format == "Unknown" and programs["q"].format == "MachO"
    assert [t.at for t in programs["q"].licence_texts] == [5, 14, 19] and [t.text[-80:].strip("y") for t in programs["q"].licence_texts][2] == " 2020 "
    assert sorted((f.vtype, f.library) for f in B.program_findings(B.programs(files), "MIT").collect()) == [("BinaryContainsGplSymbols", "GnuPG")]
    assert B.program_findings(B.programs(files), "GPL-3.0-only").count() == 0
    none = files.limit(0)
    assert B.programs(none).count() == B.modules(none).count() == B.module_reports(none).count() == B.strings(none).count() == 0
    assert KEY.isalpha() and B.strings(files, 4).filter(F.col("path") == "n").first().strings == []


@pytest.mark.parametrize("name", ["program_findings", "program_libraries"])
def test_programs_are_made_of_all_parts(spark, tmp_path, name):
    # Keys of more than six digits had no program.
    import duckdb

    from quillscan.catalog import ORACLE_SQL, QUERIES

    keys = [6, 7, 8, 999_999, 1_000_000, 1_000_001, 1_000_002, 2**62, -5, -3_000_001, None]
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    got = sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(ORACLE_SQL[name]).fetchall())
    assert {r[0] for r in got} == {f"part/{k}/tool" for k in keys if k is not None}
