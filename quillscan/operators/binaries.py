"""Programs and WebAssembly modules as tables: what they import, export and say, and which licences that binds them to.

``files`` has ``path, content`` (binary), as a ``binaryFile`` source gives it. Readers walk headers, sections and symbol
tables, never trust a length, and give what stands before the damage; symbol tables are read as arrays.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.license import family
from ..functions.text import bound
from ..refdata_binaries import ADDRESS, ADDRESS_KINDS, AFTER, BEFORE, COMPILERS, FUNCTION, GO_LICENCES, LEAST_STRING, LICENCE_BESIDE, LICENCE_TEXTS, NOTICE_BESIDE, PACKAGE, SYMBOLS, THIRD_PARTY_BESIDE
from .bundles import file_name, folder
from .classification import earliest

_LICENCE_TEXT = re.compile(earliest(LICENCE_TEXTS).encode())
_COPYLEFT = ["StrongCopyleft", "WeakCopyleft", "NetworkCopyleft"]


# ---------------------------------------------------------------- modules


class Damaged(Exception):
    """A length or number leads out of the data."""


def varint(data: bytes, at: int, bits: int = 32) -> tuple[int, int]:
    """A variable-length unsigned number and where it ends."""
    value = shift = 0
    while True:
        if at >= len(data) or shift >= bits:
            raise Damaged
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            if value >> bits:
                raise Damaged
            return value, at


def _name(data: bytes, at: int, end: int) -> tuple[str, int]:
    size, at = varint(data, at)
    if at + size > end:
        raise Damaged
    return data[at : at + size].decode("utf-8", "replace"), at + size


def _limits(data: bytes, at: int) -> int:
    flags, at = varint(data, at)
    _, at = varint(data, at, 64)
    return varint(data, at, 64)[1] if flags & 1 else at


def _entries(data: bytes, at: int, end: int, section: str) -> tuple[list[dict], bool]:
    """Entries of an import or export section, and whether all were whole."""
    out: list[dict] = []
    try:
        count, at = varint(data, at)
        for _ in range(count):
            module = None
            if section == "import":
                module, at = _name(data, at, end)
            name, at = _name(data, at, end)
            if at >= end:
                raise Damaged
            kind, at = data[at], at + 1
            if section == "export" or kind == 0:  # an index
                at = varint(data, at)[1]
            elif kind == 1:
                at = _limits(data, at + 1)
            elif kind == 2:
                at = _limits(data, at)
            elif kind == 3:
                at += 2
            elif kind == 4:
                at = varint(data, at + 1)[1]
            else:
                raise Damaged
            if at > end:
                raise Damaged
            out.append({"section": section, "module": module, "name": name, "kind": ("function", "table", "memory", "global", "tag")[kind] if kind < 5 else None})
    except Damaged:
        return out, False
    return out, True


def module_of(data: bytes) -> dict:
    """Sections, imports and exports of a module; ``damaged`` tells that something after them could not be read."""
    out = {"sections": [], "entries": [], "damaged": True}
    if data[:4] != b"\0asm" or len(data) < 8:
        return out
    at, whole = 8, True
    try:
        while at < len(data):
            number = data[at]
            size, at = varint(data, at + 1)
            end = min(at + size, len(data))
            title = _name(data, at, end)[0] if number == 0 else None
            out["sections"].append({"number": number, "name": title, "at": at, "size": size})
            if number in (2, 7):
                found, fine = _entries(data, at, end, "import" if number == 2 else "export")
                out["entries"] += found
                whole &= fine
            if at + size > len(data):
                raise Damaged
            at += size
        out["damaged"] = not whole
    except Damaged:
        pass
    return out


_MODULE = "struct<sections: array<struct<number: int, name: string, at: long, size: long>>, entries: array<struct<section: string, module: string, name: string, kind: string>>, damaged: boolean>"


def modules(files: DataFrame) -> DataFrame:
    """``path, sections, entries, damaged`` of every WebAssembly module. Null contents and other files have no row."""

    @pandas_udf(_MODULE)
    def read(content: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([module_of(c) for c in content], columns=["sections", "entries", "damaged"])

    wasm = files.filter(F.hex(F.substring("content", 1, 4)) == "0061736D")
    return wasm.select("path", read("content").alias("m")).select("path", "m.*")


def strings(files: DataFrame, least: int = LEAST_STRING) -> DataFrame:
    """``path, strings`` with ``text, at`` of every run of at least so many printable bytes (none in null contents)."""
    printable = re.compile(rb"[\x20-\x7e]{%d,}" % least)

    @pandas_udf("array<struct<text: string, at: long>>")
    def runs(content: pd.Series) -> pd.Series:
        return content.map(lambda c: [{"text": m[0].decode("ascii"), "at": m.start()} for m in printable.finditer(c or b"")])

    return files.select("path", runs("content").alias("strings"))


def _any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def category(text: Column) -> Column:
    """What a string is; the first that fits."""
    return (
        F.when(text.rlike(PACKAGE), "PackagePath")
        .when(text.rlike(FUNCTION), "FunctionName")
        .when(text.rlike(ADDRESS), "Url")
        .when(_any(text, ["LICENSE", "Copyright", "license"]), "LicenseText")
        .when(_any(text, ["error", "Error", "panic"]), "ErrorMessage")
        .when(_any(text, [".com", ".io", ".app"]), "Domain")
        .when(text.rlike("^[0-9A-Fa-f]{32,}$"), "ApiKey")
        .otherwise("Other")
    )


def compiler(content: Column) -> Column:
    """Which compiler made a module."""

    def of(text: Column) -> Column:
        out = F.lit("Unknown")
        for name, words in reversed(COMPILERS):
            out = F.when(_any(text, words), name).otherwise(out)
        return out

    return bound(F.decode(content, "ISO-8859-1"), of)


def address_kind(url: Column) -> Column:
    def of(low: Column) -> Column:
        out = F.lit("Unknown")
        for name, words in reversed(ADDRESS_KINDS):
            out = F.when(_any(low, words), name).otherwise(out)
        return out

    return bound(F.lower(url), of)


def module_reports(files: DataFrame, collectors: list[str] | None = None, own: list[str] | None = None) -> DataFrame:
    """``path, size, compiler, n_strings, packages, functions, addresses, licensed, noticed, third_party`` of every module.

    ``packages`` hold name and licence, ``addresses`` url and kind; ``collectors`` are domains that count as
    collecting data wherever a string names them, ``own`` parts of package names that are the project's. Files in the same folder tell whether licences,
    notices and others' notices come along; equal paths count each.
    """
    wasm = files.filter(F.hex(F.substring("content", 1, 4)) == "0061736D")
    base = wasm.select("path", F.octet_length("content").cast("long").alias("size"), compiler(F.col("content")).alias("compiler"), "content")
    printable = re.compile(rb"[\x20-\x7e]{%d,}" % LEAST_STRING)

    @pandas_udf("array<string>")
    def runs(content: pd.Series) -> pd.Series:
        return content.map(lambda c: [m[0].decode("ascii") for m in printable.finditer(c)])

    told = base.select("path", "size", "compiler", runs("content").alias("s"))
    every = lambda pattern: F.array_distinct(F.flatten(F.transform("s", lambda x: F.regexp_extract_all(x, F.lit(pattern), F.lit(0)))))

    def package(p: Column) -> Column:
        licence = F.lit(None).cast("string")
        for prefix, known in reversed(GO_LICENCES):
            licence = F.when(p.startswith(prefix), known).otherwise(licence)
        return F.struct(p.alias("name"), licence.alias("licence"), _any(p, own or []).alias("own"))

    holds = lambda domain: F.exists("s", lambda x: x.contains(domain))
    named = F.array_except(F.array_compact(F.array(*(F.when(holds(d), d) for d in collectors or []))).cast("array<string>"), every(ADDRESS))
    addresses = F.concat(F.transform(every(ADDRESS), lambda u: F.struct(u.alias("url"), address_kind(u).alias("kind"))), F.transform(named, lambda d: F.struct(d.alias("url"), F.lit("DataCollection").alias("kind"))))
    out = told.select("path", "size", "compiler", F.size("s").alias("n_strings"), F.transform(F.array_sort(every(PACKAGE)), package).alias("packages"), F.array_sort(every(FUNCTION)).alias("functions"), addresses.alias("addresses"), folder(F.col("path")).alias("_folder"))
    name = file_name(F.col("path"))
    beside = files.filter(name.isin(LICENCE_BESIDE + NOTICE_BESIDE + THIRD_PARTY_BESIDE)).groupBy(folder(F.col("path")).alias("_folder"))
    beside = beside.agg(*(F.bool_or(name.isin(names)).alias(flag) for flag, names in (("licensed", LICENCE_BESIDE), ("noticed", NOTICE_BESIDE), ("third_party", THIRD_PARTY_BESIDE))))
    return out.join(beside, "_folder", "left").select("path", "size", "compiler", "n_strings", "packages", "functions", "addresses", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("licensed", "noticed", "third_party")))


def module_findings(reports: DataFrame) -> DataFrame:
    """``file, vtype, severity, confidence, package``: packages without attribution or notice, modules that say nothing of licences."""

    def finding(vtype: str, severity: str, confidence: float, package: Column) -> Column:
        return F.struct(F.lit(vtype).alias("vtype"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"), package.cast("string").alias("package"))

    silent = ~F.col("licensed") & ~F.col("noticed") & ~F.col("third_party")
    each = lambda p: F.array_compact(F.array(F.when(silent & ~p["own"], finding("MissingAttribution", "High", 0.9, p["name"])), F.when((p["licence"] == "Apache-2.0") & ~F.col("noticed") & ~p["own"], finding("MissingNoticeFile", "High", 0.95, p["name"]))))
    opaque = F.when(~F.col("licensed") & ~F.col("third_party") & (F.size("packages") > 0), finding("OpaqueDistribution", "Critical", 0.95, F.lit(None)))
    found = F.concat(F.flatten(F.transform("packages", each)), F.array_compact(F.array(opaque)))
    return reports.select(F.col("path").alias("file"), F.explode(found).alias("f")).select("file", "f.*")


# ---------------------------------------------------------------- programs


def _texts(table: bytes, at: np.ndarray) -> list[str]:
    """Names in a string table; those that lie outside or are empty are left out."""
    out = []
    for k in at[at < len(table)].tolist():
        end = table.find(b"\0", k)
        name = table[k : end if end >= 0 else len(table)]
        if name:
            out.append(name.decode("utf-8", "replace"))
    return out


def _cut(data: bytes, at: int, size: int) -> bytes:
    return data[at : at + size] if 0 <= at < len(data) and size >= 0 else b""


def elf(data: bytes) -> dict:
    """Libraries needed, dynamic symbols and all symbols of an ELF file, by its section table."""
    wide, order = data[4] == 2, "<" if data[5] == 1 else ">"
    head = struct.Struct(order + ("HHIQQQIHHHHHH" if wide else "HHIIIIIHHHHHH"))
    fields = head.unpack(data[16 : 16 + head.size])
    at, each, count = fields[5], fields[10], fields[11]
    one = struct.Struct(order + ("IIQQQQIIQQ" if wide else "IIIIIIIIII"))
    sections = []
    for k in range(count):
        raw = _cut(data, at + k * each, one.size)
        if each < one.size or len(raw) < one.size:
            break
        _, kind, _, _, start, size, link, _, _, _ = one.unpack(raw)
        sections.append((kind, start, size, link))
    table = lambda link: _cut(data, *sections[link][1:3]) if link < len(sections) else b""
    word = order + ("u8" if wide else "u4")
    symbol = np.dtype({"names": ["name"], "formats": [order + "u4"], "offsets": [0], "itemsize": 24 if wide else 16})
    out: dict[str, list[str]] = {"needed": [], "dynamic": [], "symbols": []}
    for kind, start, size, link in sections:
        body = _cut(data, start, size)
        if kind == 6:
            pairs = np.frombuffer(body[: len(body) // (2 * np.dtype(word).itemsize) * 2 * np.dtype(word).itemsize], word).reshape(-1, 2)
            ends = np.flatnonzero(pairs[:, 0] == 0)
            pairs = pairs[: ends[0]] if len(ends) else pairs
            out["needed"] += _texts(table(link), pairs[pairs[:, 0] == 1, 1].astype(np.int64))
        elif kind in (2, 11):
            names = np.frombuffer(body[: len(body) // symbol.itemsize * symbol.itemsize], symbol)["name"]
            out["symbols" if kind == 2 else "dynamic"] += _texts(table(link), names.astype(np.int64))
    return {"format": "Elf", "needed": out["needed"], "exports": out["dynamic"], "symbols": out["symbols"] + out["dynamic"]}


def pe(data: bytes) -> dict:
    """Libraries imported and names exported by a PE file."""
    out = {"format": "Pe", "needed": [], "exports": [], "symbols": []}
    (at,) = struct.unpack_from("<I", data, 0x3C)
    if data[at : at + 4] != b"PE\0\0":
        return {**out, "format": "Unknown"}
    count, optional = struct.unpack_from("<H", data, at + 6)[0], struct.unpack_from("<H", data, at + 20)[0]
    top = at + 24
    directories = top + (112 if struct.unpack_from("<H", data, top)[0] == 0x20B else 96)
    exports, _, imports, _ = struct.unpack_from("<4I", data, directories)
    sections = [struct.unpack_from("<4I", data, top + optional + 40 * k + 8) for k in range(count) if top + optional + 40 * k + 24 <= len(data)]

    def place(rva: int) -> int:
        return next((rva - start + raw for size, start, stored, raw in sections if start <= rva < start + max(size, stored)), len(data))

    text = lambda rva: _texts(_cut(data, place(rva), 512), np.zeros(1, np.int64))
    at = place(imports) if imports else len(data)
    while at + 20 <= len(data) and any(entry := struct.unpack_from("<5I", data, at)):
        out["needed"] += text(entry[3])
        at += 20
    at = place(exports) if exports else len(data)
    if at + 40 <= len(data):
        n, names = struct.unpack_from("<I", data, at + 24)[0], place(struct.unpack_from("<I", data, at + 32)[0])
        for rva in np.frombuffer(data[names : names + 4 * n][: len(data[names : names + 4 * n]) // 4 * 4], "<u4").tolist():
            out["exports"] += text(rva)
    return out


_MACH = (b"\xfe\xed\xfa\xce", b"\xfe\xed\xfa\xcf", b"\xce\xfa\xed\xfe", b"\xcf\xfa\xed\xfe", b"\xca\xfe\xba\xbe")


def program_of(data: bytes) -> dict:
    """``format, needed, exports, symbols``: nothing but the format where headers are damaged."""
    none = {"needed": [], "exports": [], "symbols": []}
    kind = "Elf" if data[:4] == b"\x7fELF" else "Pe" if data[:2] == b"MZ" else "MachO" if data[:4] in _MACH else "Unknown"
    try:
        if kind in ("Elf", "Pe"):
            return elf(data) if kind == "Elf" else pe(data)
    except (struct.error, IndexError):
        pass
    return {"format": kind, **none}


def known_libraries(symbols: list[str]) -> list[dict]:
    """Libraries that symbols belong to, by name, each with its first symbol."""
    first: dict[str, tuple[str, str]] = {}
    heads: dict[str, list[tuple[str, str, str]]] = {}
    for row in SYMBOLS:
        heads.setdefault(row[0][:2], []).append(row)
    for s in symbols:
        for prefix, library, licence in heads.get(s[:2], ()):
            if s.startswith(prefix) and len(s.encode()) > len(prefix) + 2:
                first.setdefault(library, (licence, s))
    return [{"library": lib, "licence": first[lib][0], "symbol": first[lib][1]} for lib in sorted(first)]


def licence_texts(data: bytes) -> list[dict]:
    return [{"text": data[max(0, m.start() - BEFORE) : m.end() + AFTER].decode("utf-8", "replace"), "at": m.start()} for m in _LICENCE_TEXT.finditer(data)]


_LIBRARIES = "array<struct<library: string, licence: string, symbol: string>>"


def programs(files: DataFrame) -> DataFrame:
    """``path, format, needed, exports, n_symbols, libraries, licence_texts`` of every file of ``path, content``.

    ``libraries`` hold library, licence, symbol and whether the program is linked to it ``dynamic``ally, which the names of what it
    needs tell. A null content counts as empty, of unknown format. Equal rows give equal rows.
    """

    @pandas_udf(f"struct<format: string, needed: array<string>, exports: array<string>, n_symbols: int, libraries: {_LIBRARIES}, licence_texts: array<struct<text: string, at: long>>>")
    def inspect(content: pd.Series) -> pd.DataFrame:
        rows = []
        for data in content:
            p = program_of(data)
            rows.append((p["format"], p["needed"], p["exports"], len(p["symbols"]), known_libraries(p["symbols"] + p["exports"]), licence_texts(data)))
        return pd.DataFrame(rows, columns=["format", "needed", "exports", "n_symbols", "libraries", "licence_texts"])

    read = files.select("path", inspect(F.coalesce("content", F.lit(b""))).alias("p")).select("path", "p.*")
    linked = F.transform("libraries", lambda lib: lib.withField("dynamic", F.exists("needed", lambda n: F.lower(n).contains(F.lower(lib["library"])))))
    return read.withColumn("libraries", linked)


def program_findings(programs_: DataFrame, claimed: str) -> DataFrame:
    """``file, vtype, library, licence, symbol``: copyleft libraries in programs of another licence; those of weak copyleft may be linked dynamically."""
    own = family(F.lit(claimed))
    rows = programs_.select(F.col("path").alias("file"), F.explode("libraries").alias("l")).select("file", "l.*").withColumn("_f", family(F.col("licence")))
    kind = F.when(~F.col("dynamic"), "BinaryContainsGplSymbols").when(F.col("_f") == "StrongCopyleft", "GplDynamicLinking")
    return rows.filter(~own.isin(_COPYLEFT) & F.col("_f").isin(_COPYLEFT)).select("file", kind.alias("vtype"), "library", "licence", "symbol").filter("vtype IS NOT NULL")
