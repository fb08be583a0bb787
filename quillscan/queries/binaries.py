"""Modules and programs made from parts: a few binary forms in which the part's key is filled in. The SQL reads their bytes one by one."""

from __future__ import annotations

import struct

from pyspark.sql import functions as F

from ..catalog import _family_sql, _q, _values, query
from ..operators import binaries as B
from ..refdata_binaries import ADDRESS, ADDRESS_KINDS, FUNCTION, GO_LICENCES, LEAST_STRING, PACKAGE, SYMBOLS
from ..storage import spread

#: Stands for the key of a part, six digits, in the forms.
KEY = "KEYKEY"


def _leb(n: int) -> bytes:
    out = b""
    while n > 0x7F:
        out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
    return out + bytes([n])


def _named(name: str) -> bytes:
    return _leb(len(name.encode())) + name.encode()


def wasm(imports: list[tuple[str, str, bytes]], exports: list[tuple[str, int]], data: bytes) -> bytes:
    """A module with an import, an export, a data and a named section."""

    def section(number: int, body: bytes) -> bytes:
        return bytes([number]) + _leb(len(body)) + body

    out = b"\0asm\1\0\0\0" + section(2, _leb(len(imports)) + b"".join(_named(m) + _named(n) + d for m, n, d in imports))
    out += section(7, _leb(len(exports)) + b"".join(_named(n) + bytes([k]) + _leb(200 + i) for i, (n, k) in enumerate(exports)))
    return out + section(11, data) + section(0, _named("producers") + b"\1\2")


def elf(needed: list[str], dynamic: list[str], symbols: list[str], wide: bool = True, order: str = "<") -> bytes:
    """An ELF file with a dynamic section and two symbol tables."""
    texts, where = b"\0", {}
    for name in [*needed, *dynamic, *symbols]:
        where.setdefault(name, len(texts))
        if where[name] == len(texts):
            texts += name.encode() + b"\0"
    pair, symbol = order + ("QQ" if wide else "II"), (order + "I" + ("20x" if wide else "12x"))
    bodies = [b"", texts, b"".join(struct.pack(pair, 1, where[n]) for n in needed) + struct.pack(pair, 0, 0), struct.pack(symbol, 0) + b"".join(struct.pack(symbol, where[n]) for n in dynamic), b"".join(struct.pack(symbol, where[n]) for n in symbols)]
    head, at, sections = 64 if wide else 52, 64 if wide else 52, b""
    for kind, body in zip((0, 3, 6, 11, 2), bodies, strict=True):
        sections += struct.pack(order + ("IIQQQQIIQQ" if wide else "IIIIIIIIII"), 0, kind, 0, 0, at, len(body), 1, 0, 0, 0)
        at += len(body)
    fields = (2, 62, 1, 0, 0, at, 0, head, 0, 0, len(sections) // 5, 5, 1)
    start = b"\x7fELF" + bytes([2 if wide else 1, 1 if order == "<" else 2]) + b"\1" + bytes(9)
    return start + struct.pack(order + ("HHIQQQIHHHHHH" if wide else "HHIIIIIHHHHHH"), *fields) + b"".join(bodies) + sections


_MODULES = [
    wasm(
        [("env", f"js.f{KEY}", b"\0\5"), ("env", "memory", b"\2\1\1\x80\1"), ("go", "runtime.wasmExit", b"\0\1")],
        [("run", 0), (f"mem{KEY}", 2)],
        f"github.com/rs/zerolog/log\0github.com/p{KEY}/kit v1\0main.handle{KEY}\0https://api.example{KEY}.com/collect/x\0panic: no memory\0short\0Copyright {KEY} someone\0".encode(),
    ),
    wasm([("wbg", f"__wbindgen_{KEY}", b"\0\3"), ("wbg", "t", b"\1\x70\0\4"), ("wbg", "g", b"\3\x7f\1")], [("start", 3)], f"https://cfg.example.org/settings/{KEY}\0{KEY * 6}\0plain words {KEY}".encode()),
    wasm([("env", "tag", b"\4\0\2")], [(f"x{KEY}", 1)], b"github.com/spf13/cobra\0main.Run\0main.a.b \xff wrong.io name\0")[:-9],
]
#: What the import and export sections of the forms hold.
_ENTRIES = [
    (0, 0, "import", "env", f"js.f{KEY}", "function"), (0, 1, "import", "env", "memory", "memory"), (0, 2, "import", "go", "runtime.wasmExit", "function"), (0, 3, "export", None, "run", "function"), (0, 4, "export", None, f"mem{KEY}", "memory"),
    (1, 0, "import", "wbg", f"__wbindgen_{KEY}", "function"), (1, 1, "import", "wbg", "t", "table"), (1, 2, "import", "wbg", "g", "global"), (1, 3, "export", None, "start", "global"),
    (2, 0, "import", "env", "tag", "tag"), (2, 1, "export", None, f"x{KEY}", "table"),
]
#: Stands for the key of a part in programs where six digits do not hold it.
LONG_KEY = "KEY" * 6 + "KE"


def _program_forms(key: str) -> list[tuple]:
    return [
        (["libgtk-3.so", f"lib{key}.so"], [f"gtk_init_{key}", f"local_{key}"], ["main", f"x264_open_{key}", "av_x"], True, "<"),
        (["libreadline.so"], [f"rl_start_{key}", f"sqlite3_{key}"], [f"gcry_{key}", "main"], False, ">"),
        ([f"libGNU Readline {key}.so"], [f"readline_{key}"], ["PyInit_mod"], True, ">"),
    ]


_PROGRAMS = _program_forms(KEY)
_FILLED = "replace({form}, '" + KEY.encode().hex().upper() + "', hex(lpad(CAST(p_partkey AS STRING), 6, '0')))"
_FOLDER = "'part/' || CAST(p_partkey AS STRING)"


def _case(values: list[str]) -> str:
    return "CASE p_partkey % " + str(len(values)) + " " + " ".join(f"WHEN {k} THEN {_q(v)}" for k, v in enumerate(values)) + " END"


_MODULE_HEX = _FILLED.format(form=_case([m.hex().upper() for m in _MODULES]))
_DIGITS = "CAST(p_partkey AS STRING)"
_FORM = f"(p_partkey % {len(_PROGRAMS)} + {len(_PROGRAMS)}) % {len(_PROGRAMS)}"


def _program_case(key: str) -> str:
    forms = " ".join(f"WHEN {k} THEN {_q(elf(*p).hex().upper())}" for k, p in enumerate(_program_forms(key)))
    return f"replace(CASE {_FORM} {forms} END, '{key.encode().hex().upper()}', hex(lpad({_DIGITS}, {len(key)}, '0')))"


_PROGRAM_HEX = f"CASE WHEN length({_DIGITS}) > {len(KEY)} THEN {_program_case(LONG_KEY)} ELSE {_program_case(KEY)} END"
_KNOWN = "p_partkey IS NOT NULL AND p_partkey < 1000000"


def binaries(spark, sf_dir):
    """``path, content``: a module per part of up to six digits, with a licence beside every fifth and a notice beside every fourth."""
    part = spread(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey").filter(_KNOWN))
    of = lambda name, content: part.select(F.expr(f"{_FOLDER} || '/{name}'").alias("path"), content.alias("content"), "p_partkey")
    text = F.lit("text").cast("binary")
    files = of("app.wasm", F.unhex(F.expr(_MODULE_HEX)))
    return files.unionByName(of("LICENSE", text).filter("p_partkey % 5 = 0")).unionByName(of("NOTICE.txt", text).filter("p_partkey % 4 = 0")).drop("p_partkey")


def tools(spark, sf_dir):
    """``path, content``: a program per part."""
    part = spread(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey"))
    return part.select(F.expr(f"{_FOLDER} || '/tool'").alias("path"), F.unhex(F.expr(_PROGRAM_HEX)).alias("content"))


_RUNS = f"""WITH module AS (SELECT p_partkey AS k, {_FOLDER} || '/app.wasm' AS path, {_MODULE_HEX} AS h FROM part WHERE {_KNOWN}),
b AS (SELECT k, path, CAST('0x' || unnest(regexp_extract_all(h, '..')) AS INTEGER) AS b, generate_subscripts(regexp_extract_all(h, '..'), 1) - 1 AS pos FROM module),
isle AS (SELECT *, pos - row_number() OVER (PARTITION BY k ORDER BY pos) AS g FROM b WHERE b BETWEEN 32 AND 126),
run AS MATERIALIZED (SELECT k, path, CAST(min(pos) AS BIGINT) AS pos, string_agg(chr(b), '' ORDER BY pos) AS text FROM isle GROUP BY k, path, g HAVING count(*) >= {LEAST_STRING})"""


@query(
    f"""{_RUNS} SELECT path, pos AS first_byte, text, CASE WHEN regexp_matches(text, {_q(PACKAGE)}) THEN 'PackagePath' WHEN regexp_matches(text, {_q(FUNCTION)}) THEN 'FunctionName' WHEN regexp_matches(text, {_q(ADDRESS)}) THEN 'Url' WHEN regexp_matches(text, 'LICENSE|Copyright|license') THEN 'LicenseText'
  WHEN regexp_matches(text, 'error|Error|panic') THEN 'ErrorMessage' WHEN regexp_matches(text, '\\.(com|io|app)') THEN 'Domain' WHEN regexp_full_match(text, '[0-9A-Fa-f]{{32,}}') THEN 'ApiKey' ELSE 'Other' END AS category FROM run"""
)
def module_strings(spark, sf_dir):
    """Strings of modules, where they stand and what they are."""
    each = B.strings(binaries(spark, sf_dir).filter("path LIKE '%.wasm'")).select("path", F.explode("strings").alias("s"))
    return each.select("path", F.col("s.at").alias("first_byte"), F.col("s.text").alias("text"), B.category(F.col("s.text")).alias("category"))


@query(
    f"WITH e(form, place, section, module, name, kind) AS ({_values(_ENTRIES)}) SELECT {_FOLDER} || '/app.wasm' AS path, place, section, module, replace(name, '{KEY}', lpad(CAST(p_partkey AS VARCHAR), 6, '0')) AS name, kind, form = 2 AS damaged FROM part JOIN e ON form = p_partkey % {len(_MODULES)} WHERE {_KNOWN}"
)
def module_entries(spark, sf_dir):
    """What modules import and export."""
    rows = B.modules(binaries(spark, sf_dir)).select("path", "damaged", F.posexplode("entries").alias("place", "e"))
    return rows.select("path", "place", "e.section", "e.module", "e.name", "e.kind", "damaged")


_KIND = "CASE " + " ".join(f"WHEN regexp_matches(lower(url), '{'|'.join(words)}') THEN '{name}'" for name, words in ADDRESS_KINDS) + " ELSE 'Unknown' END"


@query(f"{_RUNS}, u AS (SELECT DISTINCT path, unnest(regexp_extract_all(text, {_q(ADDRESS)})) AS url FROM run) SELECT path, url, {_KIND} AS kind FROM u")
def module_addresses(spark, sf_dir):
    """Where modules call."""
    return B.module_reports(binaries(spark, sf_dir)).select("path", F.explode("addresses").alias("a")).select("path", "a.url", "a.kind")


@query(
    f"""{_RUNS}, p AS (SELECT DISTINCT k, path, unnest(regexp_extract_all(text, {_q(PACKAGE)})) AS package FROM run), l(prefix, licence) AS ({_values(GO_LICENCES)}),
    q AS (SELECT k, path, package, licence FROM p LEFT JOIN l ON starts_with(package, prefix))
    SELECT path AS file, 'MissingAttribution' AS vtype, 'High' AS severity, 0.9::DOUBLE AS confidence, package FROM q WHERE k % 5 <> 0 AND k % 4 <> 0 UNION ALL SELECT path, 'MissingNoticeFile', 'High', 0.95, package FROM q WHERE licence = 'Apache-2.0' AND k % 4 <> 0
    UNION ALL SELECT DISTINCT path, 'OpaqueDistribution', 'Critical', 0.95, NULL FROM q WHERE k % 5 <> 0"""
)
def module_findings(spark, sf_dir):
    """Packages in modules that come without their licences or notices."""
    return B.module_findings(B.module_reports(binaries(spark, sf_dir)))


_SYMBOL_ROWS = [(form, place, name) for form, (_, dynamic, symbols, _, _) in enumerate(_PROGRAMS) for place, name in enumerate([*symbols, *dynamic])]
_NEEDED_ROWS = [(form, name) for form, (needed, *_rest) in enumerate(_PROGRAMS) for name in needed]
_PROGRAM_SQL = f"""WITH f AS (SELECT p_partkey, {_FORM} AS form, {_FOLDER} || '/tool' AS path, lpad({_DIGITS}, CASE WHEN length({_DIGITS}) > {len(KEY)} THEN {len(LONG_KEY)} ELSE {len(KEY)} END, '0') AS k FROM part), s(form, place, name) AS ({_values(_SYMBOL_ROWS)}), n(form, name) AS ({_values(_NEEDED_ROWS)}), y(prefix, library, licence) AS ({_values(SYMBOLS)}),
hit AS (SELECT path, form, library, first(licence ORDER BY place) AS licence, first(replace(name, '{KEY}', k) ORDER BY place) AS symbol FROM f JOIN s USING (form) JOIN y ON starts_with(name, prefix) AND length(name) > length(prefix) + 2 GROUP BY path, form, library),
lib AS (SELECT *, EXISTS (SELECT 1 FROM n WHERE n.form = hit.form AND contains(lower(name), lower(library))) AS dynamic FROM hit)"""


@query(_PROGRAM_SQL + " SELECT path, library, licence, symbol, dynamic FROM lib")
def program_libraries(spark, sf_dir):
    """Libraries whose symbols programs hold."""
    return B.programs(tools(spark, sf_dir)).select("path", F.explode("libraries").alias("l")).select("path", "l.*")


@query(f"{_PROGRAM_SQL} SELECT path AS file, CASE WHEN NOT dynamic THEN 'BinaryContainsGplSymbols' ELSE 'GplDynamicLinking' END AS vtype, library, licence, symbol FROM (SELECT *, {_family_sql('licence')} AS fam FROM lib) WHERE fam IN ('StrongCopyleft', 'NetworkCopyleft') OR (fam = 'WeakCopyleft' AND NOT dynamic)")
def program_findings(spark, sf_dir):
    """Copyleft libraries in programs that claim the MIT licence."""
    return B.program_findings(B.programs(tools(spark, sf_dir)), "MIT")
