"""Web and binary content: types by magic bytes, printable strings, bundler marks, source maps, fonts, de-obfuscation."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from .code import GENERIC_FONTS

# Content types by their first bytes (hex; a dot is any half byte).
MAGIC = {
    "Zip": ["504B0304"], "Gzip": ["1F8B...."], "SevenZip": ["377ABCAF"], "Rar": ["52617221"], "Elf": ["7F454C46"], "Pe": ["4D5A...."],
    "MachO": ["FEEDFACE", "FEEDFACF", "CEFAEDFE", "CFFAEDFE"], "Wasm": ["0061736D"], "Png": ["89504E47"], "Jpeg": ["FFD8FF.."], "Gif": ["47494638"],
    "Webp": ["52494646"], "Pdf": ["25504446"], "Crx": ["43723234", "43727833"], "Deb": ["213C6172"],
}
# Marks that bundlers leave; the first that is found names the tool, with its confidence.
BUNDLERS = [
    ("Webpack + Terser", 0.85, ["__webpack_require__"]), ("Google Closure Compiler", 0.90, ["$jscomp.", "$jscomp="]), ("esbuild", 0.85, ["__toESM", "__toCommonJS"]),
    ("Rollup", 0.70, ['Object.defineProperty(exports,"__esModule"', "Object.defineProperty(exports, '__esModule'"]), ("Browserify", 0.70, ["Cannot find module"]),
]


def content_type(content: Column) -> Column:
    """Type by magic bytes; tar by its mark at byte 257; ``Unknown`` below four bytes."""
    head = F.hex(F.substring(content, 1, 4))
    chain = F.when(F.length(content) < 4, "Unknown")
    for kind, patterns in MAGIC.items():
        chain = chain.when(head.rlike("^(" + "|".join(patterns) + ")"), kind)
    return chain.when(F.hex(F.substring(content, 258, 5)) == "7573746172", "Tar").otherwise("Unknown")


def printable_strings(content: Column, least: int = 6) -> Column:
    """Runs of at least ``least`` printable ASCII bytes."""
    return F.regexp_extract_all(F.decode(content, "ISO-8859-1"), F.lit(f"[\\x20-\\x7E]{{{least},}}"), F.lit(0))


def zip_start(content: Column) -> Column:
    """Byte offset of the zip signature, null if there is none."""
    at = F.instr(F.decode(content, "ISO-8859-1"), "PK\x03\x04")
    return F.when(at > 0, at - 1)


def bundler(text: Column) -> Column:
    """Struct ``name, confidence`` of the tool that made a bundle, null if unknown."""
    chain = None
    for name, confidence, marks in BUNDLERS:
        test = F.exists(F.array(*(F.lit(m) for m in marks)), lambda m: text.contains(m))
        value = F.struct(F.lit(name).alias("name"), F.lit(confidence).alias("confidence"))
        chain = F.when(test, value) if chain is None else chain.when(test, value)
    return chain


def source_maps(text: Column) -> Column:
    """Targets of sourceMappingURL comments; inline ones are data URLs."""
    return F.regexp_extract_all(text, F.lit(r"//[#@]\s*sourceMappingURL=(\S+)"), F.lit(1))


def fonts(text: Column) -> Column:
    """Distinct font family names that are not generic."""
    named = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(r"font-family\s*:\s*([^;}]+)"), F.lit(1)), lambda v: F.split(v, ",")))
    clean = F.transform(named, lambda v: F.trim(F.regexp_replace(v, "[\"']", "")))
    return F.array_distinct(F.filter(clean, lambda v: (v != "") & ~F.lower(v).isin(GENERIC_FONTS)))


_HEX = re.compile(r"(?:\\x[0-9a-fA-F]{2})+")
_UNICODE = re.compile(r"(?:\\u[0-9a-fA-F]{4})+")
_JOINED = re.compile(r"(['\"])([^'\"\\\n]{0,20})\1\s*\+\s*\1([^'\"\\\n]{0,20})\1")
_BRACKET = re.compile(r"\[(['\"])([A-Za-z_$][\w$]*)\1\]")
_CODES = re.compile(r"String\.fromCharCode\(([0-9,\s]+)\)")
PASSES = 5


def readable(text: str) -> str:
    """Escapes decoded, character codes and joined literals as text, a['b'] as a.b; up to ``PASSES`` rounds until nothing changes."""
    for _ in range(PASSES):
        before = text
        text = _HEX.sub(lambda m: bytes.fromhex(m[0].replace("\\x", "")).decode("latin-1"), text)
        text = _UNICODE.sub(lambda m: m[0].encode().decode("unicode_escape").encode("utf-16", "surrogatepass").decode("utf-16", "replace"), text)
        text = _CODES.sub(lambda m: repr("".join(chr(int(n)) for n in m[1].split(",") if n.strip() and int(n) < 0x110000)), text)
        text = _JOINED.sub(r"\1\2\3\1", text)
        text = _BRACKET.sub(r".\2", text)
        if text == before:
            break
    return text


@pandas_udf(StringType())
def deobfuscated(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else readable(t))
