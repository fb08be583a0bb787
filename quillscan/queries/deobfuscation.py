"""Scripts that rows of ``part`` were obfuscated into, and what de-obfuscation gives; the SQL fills in the clean forms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..catalog import _q, query
from ..operators import deobfuscation as O
from ..storage import spread

#: Obfuscated form, the clean form it must give, and the counts of the rules. {hex} is the name in \x escapes, {b64} in base64, {codes} as character codes.
FORMS = [
    ('show("{hex}");\n', 'show("{name}");\n', {"HexEscape": 1}),
    ('show(atob("{b64}") + "!");\n', 'show("{name}!");\n', {"Base64Decode": 1, "StringConcat": 1}),
    ("show(String.fromCharCode({codes}), parseInt('0x{hexkey}', 16));\n", 'show("{name}", {key});\n', {"FromCharCode": 1, "ParseIntHex": 1}),
    ('var _0x12ab = ["{name}", "log"];\nconsole[_0x12ab[1]](_0x12ab[0x0]);\n', 'var _0x12ab = ["{name}", "log"];\nconsole.log("{name}");\n', {"StringArrayLookup": 2, "BracketToDot": 1}),
    (
        'var _0x1 = "b";\nwhile(true) {\n  switch(_0x1) {\n    case "a": show(x + y); _0x1 = "c"; break;\n    case "b": var x = {key}; _0x1 = "d"; break;\n    case "c": done("{name}");\n    case "d": var y = 2; _0x1 = "a"; break;\n  }\n}\n',
        'var _0x1 = "b";\n/* recovered control flow */\nvar x = {key};\nvar y = 2;\nshow(x + y);\ndone("{name}");\n',
        {"ControlFlowRecovery": 1},
    ),
    (
        "var s = 0x1;\nwhile (!0) { switch (s) { case 0x1: var t = '7'; while (1) { switch (t) { case '7': inner({key}); t = '8'; continue; case '8': t = '7'; again(); } } s = 2; break; case 2: s = 1; outer(); } }\n",
        "var s = 0x1;\n/* recovered control flow */\nvar t = '7'; /* recovered control flow */\ninner({key});\nagain();\n/* back to state 7 */\nouter();\n/* back to state 1 */\n",
        {"ControlFlowRecovery": 2},
    ),
    (
        "if ((k * k + k) % 2 === 0) { keep({key}); }\nif (typeof undefined === 'number') { if (deep) { drop(); } }\nreturn {key};\nnever();\n",
        "{ /* always-true path */ keep({key}); }\n/* dead: always-false path removed */\nreturn {key};\n/* unreachable: never(); */\n",
        {"OpaquePredicateElimination": 4, "DeadCodeRemoval": 1},
    ),
    (
        "function _0xa1(a, b) { return a * b; }\nfunction _0xb2(a, b) { return b - a; }\nz = _0xa1(_0xb2(1, {key}), w);\nsetInterval(function() { debugger; }, 100);\nv = (p = {key}, q = 2, p);\n",
        "z = (({key} - 1) * w);\n/* debugger trap neutralized */;\np = {key};\nq = 2;\nv = p;\n",
        {"ProxyFunctionInlining": 2, "SelfDefendingRemoval": 1, "CommaExpressionSimplification": 1},
    ),
    ("use((p = {key}, q = 2, p));\n", "p = {key};\nq = 2;\nuse(p);\n", {"CommaExpressionSimplification": 1}),
]


def _fill(text, fill):
    return reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), kv[1]), fill.items(), text)


def scripts(spark, sf_dir):
    """``path, text, form``: one obfuscated script per part."""
    name = F.col("p_name")
    chars = F.filter(F.split(name, ""), lambda c: c != "")
    fill = {
        "{hexkey}": F.lower(F.hex("p_partkey")),
        "{hex}": F.array_join(F.transform(chars, lambda c: F.concat(F.lit("\\x"), F.lower(F.hex(F.ascii(c))))), ""),
        "{b64}": F.base64(F.encode(name, "UTF-8")),
        "{codes}": F.array_join(F.transform(chars, lambda c: F.ascii(c).cast("string")), ", "),
        "{name}": name,
        "{key}": F.col("p_partkey").cast("string"),
    }
    form = (F.col("p_partkey") % len(FORMS)).cast("int")
    body = F.element_at(F.array(*(F.lit(f[0]) for f in FORMS)), form + 1)
    part = spread(spark.read.parquet(f"{sf_dir}/part.parquet"))
    return part.select(F.concat(F.lit("part/"), F.col("p_partkey").cast("string"), F.lit(".js")).alias("path"), _fill(body, fill).alias("text"), form.alias("form"))


_CLEAN = f"forms(form, clean) AS (VALUES {', '.join(f'({k}, {_q(f[1])})' for k, f in enumerate(FORMS))})"
_COUNTS = f"counts(form, kind, n) AS (VALUES {', '.join(f'({k}, {_q(kind)}, {n})' for k, f in enumerate(FORMS) for kind, n in f[2].items())})"
_PATH = "'part/' || p_partkey || '.js'"


@query(f"WITH {_CLEAN} SELECT {_PATH} AS path, replace(replace(clean, '{{name}}', p_name), '{{key}}', CAST(p_partkey AS VARCHAR)) AS clean FROM part JOIN forms ON form = p_partkey % {len(FORMS)}")
def clean_scripts(spark, sf_dir):
    return O.cleaned(scripts(spark, sf_dir)).select("path", "clean")


@query(f"WITH {_COUNTS} SELECT {_PATH} AS path, kind, CAST(n AS INTEGER) AS n FROM part JOIN counts ON form = p_partkey % {len(FORMS)}")
def script_rewrites(spark, sf_dir):
    return O.cleaned(scripts(spark, sf_dir)).select("path", F.explode("counts").alias("kind", "n"))


@query(
    rf"""WITH s AS (SELECT page_id, html AS text, strlen(html) AS size FROM pages), c AS (SELECT *, len(regexp_extract_all(text, '_0x[0-9a-fA-F]{{2,6}}')) AS hex_names,
  len(regexp_extract_all(text, '[^\x21-\x7E\t\n\f\r ]')) AS odd, list_filter(regexp_extract_all(text, '[\pL\pM\pN_]+'), lambda w: regexp_matches(w, '^[A-Za-z_]')) AS names FROM s)
  SELECT page_id, hex_names, odd, len(list_filter(names, lambda w: len(w) <= 3)) AS short_names, CASE WHEN size = 0 THEN 0 ELSE round(least(0.3, hex_names / (size / 100::DOUBLE) * 0.1) + least(0.2, odd / size::DOUBLE * 10) + CASE WHEN len(list_filter(names, lambda w: len(w) <= 3)) / greatest(1, len(names))::DOUBLE > 0.8 THEN 0.2 ELSE 0 END, 6) END AS score FROM c"""
)
def page_script_scores(spark, sf_dir):
    """The obfuscation score of pages, which de-obfuscation leaves as long as they are."""
    rows = O.cleaned(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.col("html").alias("text")))
    word = r"[\p{L}\p{M}\p{N}_]"
    short = F.regexp_count("text", F.lit(rf"(?<!{word})[A-Za-z_]{word}{{0,2}}(?!{word})"))
    return rows.select("page_id", F.regexp_count("text", F.lit("_0x[0-9a-fA-F]{2,6}")).cast("long").alias("hex_names"), F.regexp_count("text", F.lit(r"[^\x21-\x7E\t\n\f\r ]")).cast("long").alias("odd"), short.cast("long").alias("short_names"), F.round(O.score(F.col("text"), F.col("clean")), 6).alias("score"))
