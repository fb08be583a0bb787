"""Readable scripts from obfuscated ones: rewriting rules applied to a fixed point, with a table of names.

Rules take a text and give a text and how often they applied.  The first group undoes encodings of literals
(escapes, base64, character codes, joined literals, hexadecimal numbers, literal arrays, bracket
access); the second undoes structure (traps, proxies, conditions that are always true or false,
dispatcher loops, code behind a jump, comma lists).  Every rule only shortens or settles its text, and
rounds are bounded, so nested and cyclic dispatchers end.
"""

from __future__ import annotations

import base64
import binascii
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Most rounds of all rules of a group.
ROUNDS = 12

Rule = Callable[[str], tuple[str, int]]
Rewrite = Callable[[re.Match], str | None]


def _each(pattern: re.Pattern, rewrite: Rewrite) -> Rule:
    """A rule that replaces matches; ``None`` leaves one as it is."""

    def rule(text: str) -> tuple[str, int]:
        done = 0

        def one(m: re.Match) -> str:
            nonlocal done
            new = rewrite(m)
            if new is None or new == m[0]:
                return m[0]
            done += 1
            return new

        return pattern.sub(one, text), done

    return rule


# ---------------------------------------------------------------- literals


def _quoted(value: str) -> str:
    return '"' + value.replace('"', '\\"') + '"'


def _plain_base64(m: re.Match) -> str | None:
    try:
        return _quoted(base64.b64decode(m[1], validate=True).decode())
    except (binascii.Error, UnicodeDecodeError):
        return None


def _characters(m: re.Match) -> str | None:
    codes = [int(n) for n in m[1].split(",") if n.strip().isdigit()]
    value = "".join(chr(c) for c in codes if c < 0x110000 and not 0xD800 <= c < 0xE000)
    return _quoted(value) if value else None


_ARRAY = re.compile(r"\b(?:var|let|const)\s+(_0x[0-9a-fA-F]+)\s*=\s*\[((?:\s*(?:\"[^\"]*\"|'[^']*')\s*,?)+)\s*\]")
_LITERAL = re.compile(r"\"([^\"]*)\"|'([^']*)'")
_LOOKUP = re.compile(r"\b(_0x[0-9a-fA-F]+)\s*[\[(]\s*(0x)?([0-9a-fA-F]+)\s*[\])]")


def _arrays(text: str) -> tuple[str, int]:
    """Look-ups in literal arrays as the literals; numbers of more than two digits and with 0x are hexadecimal."""
    table = {m[1]: [a or b for a, b in _LITERAL.findall(m[2])] for m in _ARRAY.finditer(text)}
    if not table:
        return text, 0

    def value(m: re.Match) -> str | None:
        items = table.get(m[1], ())
        if not m[2] and len(m[3]) <= 2 and not m[3].isdigit():
            return None
        at = int(m[3], 16 if m[2] or len(m[3]) > 2 else 10)
        return f'"{items[at]}"' if at < len(items) else None

    return _each(_LOOKUP, value)(text)


LITERAL_RULES: list[tuple[str, Rule]] = [
    ("HexEscape", _each(re.compile(r"(?:\\x[0-9a-fA-F]{2})+"), lambda m: bytes.fromhex(m[0].replace("\\x", "")).decode("latin-1"))),
    ("UnicodeEscape", _each(re.compile(r"(?:\\u[0-9a-fA-F]{4})+"), lambda m: "".join(chr(int(h, 16)) for h in m[0].split("\\u")[1:]).encode("utf-16", "surrogatepass").decode("utf-16", "replace"))),
    ("Base64Decode", _each(re.compile(r"\batob\s*\(\s*[\"']([A-Za-z0-9+/=]+)[\"']\s*\)"), _plain_base64)),
    ("FromCharCode", _each(re.compile(r"\bString\.fromCharCode\s*\(([\d,\s]+)\)"), _characters)),
    ("StringConcat", _each(re.compile(r"(?:\"([^\"'\n]{0,20})\"|'([^\"'\n]{0,20})')\s*\+\s*(?:\"([^\"'\n]{0,20})\"|'([^\"'\n]{0,20})')"), lambda m: '"' + "".join(g or "" for g in m.groups()) + '"')),
    ("ParseIntHex", _each(re.compile(r"\bparseInt\s*\(\s*[\"']0x([0-9a-fA-F]{1,16})[\"']\s*,\s*16\s*\)"), lambda m: str(int(m[1], 16)))),
    ("StringArrayLookup", _arrays),
    ("BracketToDot", _each(re.compile(r"(?<=[\w$)\]])\s*\[\s*[\"']([A-Za-z_]\w*)[\"']\s*\](?!\s*=\s*function)"), lambda m: "." + m[1])),
]


# ---------------------------------------------------------------- structure

_STEP = re.compile(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\])*`|/\*.*?\*/|//[^\n]*|[{}]", re.S)


def closing(text: str, at: int) -> int:
    """Place of the brace that closes the one at ``at``, past quoted texts and comments; -1 without one."""
    depth = 0
    for m in _STEP.finditer(text, at):
        depth += (m[0] == "{") - (m[0] == "}")
        if not depth:
            return m.start()
    return -1


def _traps(text: str) -> tuple[str, int]:
    text, a = _each(re.compile(r"\b(?:setInterval|setTimeout)\s*\(\s*function\s*\(\s*\)\s*\{\s*debugger\s*;?\s*\}\s*,\s*\d+\s*\)"), lambda m: "/* debugger trap neutralized */")(text)
    text, b = _each(re.compile(r"\bconsole\s*\[\s*[\"']\w+[\"']\s*\]\s*=\s*function\s*\([^)]*\)\s*\{[^}]*\}"), lambda m: "/* console override neutralized */")(text)
    return text, a + b


_PROXY = re.compile(r"\bfunction\s+(_0x[0-9a-fA-F]+)\s*\(\s*(\w+)\s*,\s*(\w+)\s*\)\s*\{\s*return\s+(\w+)\s*(===?|!==?|<<|>>>?|[-+*/%&|^])\s*(\w+)\s*;?\s*\}\s*;?[ \t]*\n?")


def _proxies(text: str) -> tuple[str, int]:
    """Calls of functions that only apply an operator to their parameters, innermost first, as that; their definitions go."""
    table = {m[1]: (m[5], m[4] == m[2]) for m in _PROXY.finditer(text) if {m[4], m[6]} == {m[2], m[3]}}
    if not table:
        return text, 0
    text = _PROXY.sub(lambda m: "" if m[1] in table else m[0], text)
    total = 0
    for m in reversed(list(re.finditer(rf"\b({'|'.join(table)})\s*\(", text))):  # a call inside another one begins behind it
        args, end = _arguments(text, m.end())
        if len(args) == 2:
            a, b = args if table[m[1]][1] else args[::-1]
            text = f"{text[: m.start()]}({a} {table[m[1]][0]} {b}){text[end:]}"
            total += 1
    return text, max(1, total)


_COMMA = re.compile(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|[,()\[\]{}]", re.S)


def _arguments(text: str, at: int) -> tuple[list[str], int]:
    """Arguments of the call whose bracket ends at ``at``, and where the call ends; none without a closing bracket."""
    depth, begin, out = 0, at, []
    for m in _COMMA.finditer(text, at):
        if m[0] in "([{":
            depth += 1
        elif m[0] in ")]}":
            if not depth:
                return [*out, text[begin : m.start()].strip()], m.end()
            depth -= 1
        elif m[0] == "," and not depth:
            out.append(text[begin : m.start()].strip())
            begin = m.end()
    return [], at


_TRUE = re.compile(r"\(\s*(\w+)\s*\*\s*\1\s*\+\s*\1\s*\)\s*%\s*2\s*===?\s*0|\btypeof\s+undefined\s*===?\s*[\"']undefined[\"']|\bvoid\s+0\s*===?\s*undefined\b|!!\[\]\s*===?\s*true\b|(?<!!)!\[\]\s*===?\s*false\b|\bNaN\s*!==?\s*NaN\b|\(\s*(\w+)\s*\|\s*0\s*\)\s*===?\s*\2\b|\bInfinity\s*===?\s*Infinity\b")
_FALSE = re.compile(r"\btypeof\s+undefined\s*===?\s*[\"']number[\"']|\bNaN\s*===?\s*NaN\b|\[\]\s*===?\s*\[\]")
_IF = re.compile(r"\bif\s*\(\s*(true|false)\s*(?:&&[^(){}]*)?\)\s*\{")


def _predicates(text: str) -> tuple[str, int]:
    """Conditions of fixed value as true or false, and the branch they choose."""
    text, total = _each(_TRUE, lambda m: "true")(text)
    text, n = _each(_FALSE, lambda m: "false")(text)
    total += n
    at = 0
    while m := _IF.search(text, at):
        end = closing(text, m.end() - 1)
        if end < 0 or (m[1] == "true" and "&&" in m[0]):
            at = m.end()
            continue
        if m[1] == "true":
            text = f"{text[: m.start()]}{{ /* always-true path */{text[m.end() :]}"
        else:
            text = f"{text[: m.start()]}/* dead: always-false path removed */{text[end + 1 :]}"
        total, at = total + 1, m.start()
    return text, total


_DISPATCH = re.compile(r"\bwhile\s*\(\s*(?:true|!!\[\]|!0|1)\s*\)\s*\{\s*switch\s*\(\s*(\w+)\s*\)\s*\{")
_LABEL = r"(?:[\"']([^\"']+)[\"']|(0x[0-9a-fA-F]+|\d+))"
_CASE = re.compile(r"\bcase\s+" + _LABEL + r"\s*:|\bdefault\s*:")


def _state(m: re.Match) -> str:
    return m[1] if m[1] is not None else str(int(m[2], 0)) if m[2] and m[2].lower().startswith("0x") else m[2] or ""


def _cases(body: str) -> dict[str, str]:
    """Bodies by label, of the labels at the outermost level; the first of equal labels counts."""
    marks, depth, at = [], 0, 0
    for m in re.finditer(f"{_STEP.pattern}|{_CASE.pattern}", body, re.S):
        if m[0] in "{}":
            depth += 1 if m[0] == "{" else -1
        elif not depth and (c := _CASE.fullmatch(m[0])):
            marks.append((m.start(), m.end(), _state(c)))
    out: dict[str, str] = {}
    for k, (_, at, label) in enumerate(marks):
        out.setdefault(label, body[at : marks[k + 1][0] if k + 1 < len(marks) else len(body)])
    return out


def _flattened(text: str) -> tuple[str, int]:
    """Dispatcher loops as the statements their states run through, innermost first.

    A walk ends where a state has no case, sets no next one or was there before (a
    cycle, which a comment names).  A loop without a known first state stays.
    """
    done, before = 0, len(text)
    while True:
        found = [m for m in _DISPATCH.finditer(text, 0, before)]
        if not found:
            return text, done
        m = found[-1]  # no other dispatcher begins behind it, so none is inside
        before = m.start()
        name = re.escape(m[1])
        inner = closing(text, m.end() - 1)
        outer = closing(text, text.index("{", m.start()))
        begins = list(re.finditer(rf"\b{name}\s*=\s*{_LABEL}", text[: m.start()]))
        if inner < 0 or outer < 0 or not begins:
            continue
        cases = _cases(text[m.end() : inner])
        step = re.compile(rf"\b{name}\s*=\s*{_LABEL}\s*;?")
        jump = re.compile(r"\s*\b(?:break|continue)\s*;?\s*$")
        state, seen, out = _state(begins[-1]), set(), []
        while state in cases and state not in seen:
            seen.add(state)
            body = jump.sub("", cases[state].rstrip())
            moves = list(step.finditer(body))
            kept = step.sub("", body).strip()
            if kept:
                out.append(kept)
            if not moves:
                break
            state = _state(moves[-1])
        else:
            if state in seen:
                out.append(f"/* back to state {state} */")
        if out:
            text = f"{text[: m.start()]}/* recovered control flow */\n" + "\n".join(out) + text[outer + 1 :]
            done += 1


_JUMP = re.compile(r"(?:return|throw)\b[^?]*;|(?:return|break|continue);")
_EMPTY = ("function(){};", "function(){}", "()=>{}")


def _dead(text: str) -> tuple[str, int]:
    """Lines behind a jump of their own block, and lines that only make an empty function, as comments."""
    out, total, depth, dead_at = [], 0, 0, None
    for line in text.split("\n"):
        bare = line.strip()
        opens, closes = bare.count("{"), bare.count("}")
        if dead_at is not None and (depth < dead_at or bare.startswith("}") or re.match(r"(?:case\b|default\s*:)", bare)):
            dead_at = None
        if bare in _EMPTY:
            line, total = "/* dead function */", total + 1
        elif dead_at is not None and bare and not bare.startswith(("//", "/*")):
            line, total = f"/* unreachable: {bare.replace('*/', '* /')} */", total + 1
        elif dead_at is None and opens == closes == 0 and _JUMP.fullmatch(bare) and "if" not in bare.split():
            dead_at = depth
        depth += opens - closes
        out.append(line)
    return "\n".join(out), total


_COMMAS = re.compile(r"(?<![\w$)\]])\(\s*(\w+\s*=\s*[^,(){};=]+(?:,\s*\w+\s*=\s*[^,(){};=]+)+),\s*(\w+)\s*\)")


def _commas(text: str) -> tuple[str, int]:
    """Lists of assignments inside a statement, before it."""
    out, at, done = [], 0, 0
    for m in _COMMAS.finditer(text):
        begin = max(at, *(text.rfind(c, at, m.start()) + 1 for c in ";{}\n"))
        head = text[begin : m.start()]
        indent = head[: len(head) - len(head.lstrip())]
        out += [text[at:begin], *(f"{indent}{p.strip()};\n" for p in m[1].split(",")), head, m[2]]
        at, done = m.end(), done + 1
    return "".join([*out, text[at:]]), done


STRUCTURE_RULES: list[tuple[str, Rule]] = [
    ("SelfDefendingRemoval", _traps),
    ("ProxyFunctionInlining", _proxies),
    ("OpaquePredicateElimination", _predicates),
    ("ControlFlowRecovery", _flattened),
    ("DeadCodeRemoval", _dead),
    ("CommaExpressionSimplification", _commas),
]


def rewritten(text: str, rules: list[tuple[str, Rule]]) -> tuple[str, dict[str, int]]:
    """All rules in order, again and again until a round changes nothing."""
    counts = dict.fromkeys((name for name, _ in rules), 0)
    for _ in range(ROUNDS):
        before = text
        for name, rule in rules:
            text, n = rule(text)
            counts[name] += n
        if text == before:
            break
    return text, counts


_RESULT = "clean string, counts map<string,int>"


def _frame(text: pd.Series) -> pd.DataFrame:
    rows = []
    for value in text:
        if value is None:
            rows.append((None, {}))
            continue
        clean, a = rewritten(value, LITERAL_RULES)
        clean, b = rewritten(clean, STRUCTURE_RULES)
        rows.append((clean, {k: n for k, n in (a | b).items() if n}))
    return pd.DataFrame(rows, columns=["clean", "counts"])


def cleaned(files: DataFrame) -> DataFrame:
    """``files`` with ``clean`` and ``counts`` (rule -> how often it applied); null texts give null and no counts."""
    run = pandas_udf(_frame, _RESULT)
    return files.withColumn("_c", run("text")).select(*files.columns, "_c.clean", "_c.counts")


def obfuscator(text: Column) -> Column:
    """The tool whose habits a script shows, the first of the list; null without any."""
    return F.when(text.rlike(r"_0x[0-9a-f]{4,6}\s*=\s*function\s*\(\s*_0x[0-9a-f]+"), "javascript-obfuscator").when(text.rlike("jscrambler|__jsc__"), "JScrambler").when(text.rlike(r"!function\s*\([a-z]\s*,\s*[a-z]\s*,\s*[a-z]\)"), "UglifyJS")


def score(text: Column, clean: Column) -> Column:
    """0 to 1: density of hexadecimal names, what de-obfuscation took away, other characters than printable ASCII, short names."""
    size = F.octet_length(text)
    names = F.least(F.lit(0.3), F.regexp_count(text, F.lit("_0x[0-9a-fA-F]{2,6}")) / (size / 100) * 0.1)
    shrunk = F.greatest(F.lit(0.0), 1 - F.octet_length(clean) / size) * 0.3
    odd = F.least(F.lit(0.2), F.regexp_count(text, F.lit(r"[^\x21-\x7E\t\n\f\r ]")) / size * 10)
    short = F.regexp_count(text, F.lit(r"(?<![\p{L}\p{M}\p{N}_])[A-Za-z_][\p{L}\p{M}\p{N}_]{0,2}(?![\p{L}\p{M}\p{N}_])"))
    all_ = F.greatest(F.lit(1), F.regexp_count(text, F.lit(r"(?<![\p{L}\p{M}\p{N}_])[A-Za-z_][\p{L}\p{M}\p{N}_]*")))
    total = names + shrunk + odd + F.when(short / all_ > 0.8, 0.2).otherwise(0.0)
    return F.when(size == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), total))


def traps(text: Column) -> Column:
    """Signs that a script defends itself, in the order of the list."""
    signs = [
        ("SourceCheck", r"\.toString\(\)\.search\("),
        ("DebuggerLoop", r"\b(?:setInterval|setTimeout)\s*\(\s*function\s*\(\s*\)\s*\{\s*debugger"),
        ("ConsoleOverride", r"\bconsole\s*\[\s*[\"']\w+[\"']\s*\]\s*=\s*function"),
        ("TimingCheck", r"(?:Date|performance)\.now\s*\(\s*\).*(?:Date|performance)\.now\s*\(\s*\).*>\s*\d{2,}"),
    ]
    return F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(n)) for n, p in signs)))
