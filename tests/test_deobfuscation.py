"""The rewriting rules: texts of known outcome, nested and cyclic dispatchers, damaged and long input."""

import time

import pytest

from quillscan.operators import deobfuscation as O
from quillscan.queries.deobfuscation import FORMS


def clean(text):
    a, n = O.rewritten(text, O.LITERAL_RULES)
    b, m = O.rewritten(a, O.STRUCTURE_RULES)
    return b, {k: v for k, v in (n | m).items() if v}


def test_flattened_state_machine():
    text = '\nvar _0x12 = "0";\nwhile(true) {\n    switch(_0x12) {\n        case "0": var x = 1; _0x12 = "1"; break;\n        case "1": var y = 2; _0x12 = "2"; break;\n        case "2": console.log(x + y); _0x12 = "3"; break;\n        case "3": return;\n    }\n}\n'
    got, counts = clean(text)
    assert counts["ControlFlowRecovery"] == 1
    body = got[got.index("recovered control flow") :]
    assert body.index("var x = 1;") < body.index("var y = 2;") < body.index("console.log(x + y);") and "switch" not in got and "_0x12 =" not in body


def test_layers():
    text = 'setInterval(function() { debugger }, 500);\nif (typeof undefined === "undefined") {\n  if ((x * x + x) % 2 === 0) {\n    var _0x1 = "0";\n    while(true) {\n      switch(_0x1) {\n        case "0": var real = doSomething(); _0x1 = "1"; break;\n        case "1": processResult(real); _0x1 = "2"; break;\n        case "2": return real;\n      }\n    }\n  }\n}\nfunction(){}\n'
    got, counts = clean(text)
    assert counts == {"SelfDefendingRemoval": 1, "OpaquePredicateElimination": 4, "ControlFlowRecovery": 1, "DeadCodeRemoval": 1}
    assert got.count("{") == got.count("}") and "neutralized" in got


def test_traps():
    text = 'setInterval(function() { debugger }, 100);\nconsole["log"] = function() {};\nconsole["warn"] = function() {};\n'
    assert clean(text)[1] == {"SelfDefendingRemoval": 3} and "console" not in clean(text)[0].replace("console override", "")


@pytest.mark.parametrize("text", ["while(true){switch(a){case 1: a = 1;", "var a = 1; while(1){switch(a){}}", "while(1){switch(a){case 1: x(); a = 2; break; case 2: y();}}", "if (false) { x(", "_0x1[0]", "atob('%%%')", "atob('/w==')", "String.fromCharCode(99999999)", "function _0xa(a, b) { return a + c; } _0xa(1, 2)", "", "}}}{{{", "'unclosed {", '"a" + '])
def test_damaged_texts_stay(text):
    assert clean(text)[0] == text


def test_cycles_end():
    got, counts = clean('var s = "a"; while(true){switch(s){case "a": one(); s = "b"; break; case "b": two(); s = "a"; break;}}')
    assert "one();\ntwo();\n/* back to state a */" in got and counts["ControlFlowRecovery"] == 1
    self_ = 'var s = 1; while(1){switch(s){case 1: while(1){switch(s){case 1: s = 1; x(); break;}} break;}}'
    assert clean(self_)[1]["ControlFlowRecovery"] == 2


def test_dead_code_ends_with_its_block():
    text = "function f() {\n  if (a) {\n    return 1;\n    lost();\n  }\n  kept();\n  throw new E();\n  // note\n  lost2();\n}\nkept2();"
    got = clean(text)[0]
    assert "unreachable: lost();" in got and "unreachable: lost2();" in got and "\n  kept();" in got and "\nkept2();" in got


def test_proxies_nest():
    assert clean("function _0x1f(a, b) { return a + b; }\nx = _0x1f(1, _0x1f(_0x1f(2, y), 3));")[0] == "x = (1 + ((2 + y) + 3));"


def test_frames_and_long_texts(spark):
    fill = lambda t: t.replace("{key}", "5").replace("{name}", "n")
    rows = [(k, fill(f[0])) for k, f in enumerate(FORMS)] + [(90, None), (91, "")]
    long = {100: "a = b[c] + 'd';  " * 60_000, 101: "(" * 200_000, 102: "while(true){switch(x){" * 2_000, 103: "'a' + " * 20_000 + "'b'", 104: "x" * 500_000, 105: "if (false) {" * 3_000}
    start = time.time()
    frame = spark.createDataFrame([*rows, *long.items()], "id int, text string").withColumnRenamed("id", "clean_id")
    got = {r.clean_id: r for r in O.cleaned(frame).collect()}
    assert time.time() - start < 120
    assert all(got[k].clean == fill(f[1]) and got[k].counts == f[2] for k, f in enumerate(FORMS) if k > 3)
    assert got[90].clean is None and got[90].counts == {} and got[91].clean == "" and len(got) == len(rows) + len(long)
    assert O.cleaned(frame.limit(0)).count() == 0
    scores = {r.clean_id: r.s for r in O.cleaned(frame).select("clean_id", O.score(O.F.col("text"), O.F.col("clean")).alias("s")).collect()}
    assert scores[91] == 0 and scores[3] > 0
