"""The scan cache: what is scanned again, through which needs, and what a cut-off run leaves."""

import pytest
from pyspark.sql import functions as F

from quillscan.plans.incremental import forget, incremental_scan, log

SCHEMA = "path string, text string, state string"


def run(spark, cache, rows, rules="1", needs=None):
    """What a run scanned, found, and thought of each file."""
    looked = []

    def detector(files):
        looked.extend(tuple(r) for r in files.select("path", "text", "state").collect())
        words = F.explode(F.split(F.coalesce("text", F.lit("null")), " ")).alias("word")
        return files.select(F.col("path").alias("file"), words, F.lit(rules).alias("by"))

    files = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).repartition(3)
    table = None if needs is None else spark.createDataFrame(needs, "path string, needs string")
    out = incremental_scan(files, cache, detector, rules, table)
    found = sorted((r.file, r.word, r.by) for r in out.findings.collect())
    return sorted(x[0] for x in looked), found, {r.path: r.state for r in out.states.collect()}, out


FILES = [("a", "one two"), ("b", "three"), ("c", None), ("d", ""), ("e", "x " * 50_000), (None, "lost")]


def test_only_what_changed_is_scanned(spark, tmp_path):
    cache = str(tmp_path)
    looked, found, states, out = run(spark, cache, FILES)
    assert looked == ["a", "b", "c", "d", "e"] and set(states.values()) == {"new"} and (out.hits, out.misses, out.hit_rate, out.generation) == (0, 5, 0.0, 1)
    looked, again, states, out = run(spark, cache, FILES)
    assert looked == [] and again == found and set(states.values()) == {"hit"} and (out.hits, out.hit_rate, out.generation) == (5, 1.0, 2)
    # a changed, d gone, f new; an empty text is a null one's content
    looked, found, states, out = run(spark, cache, [("a", "one"), *FILES[1:3], FILES[4], ("f", "new")])
    assert looked == ["a", "f"] and states == {"a": "changed", "b": "hit", "c": "hit", "d": "removed", "e": "hit", "f": "new"}
    assert {f for f in found if f[0] in "adf"} == {("a", "one", "1"), ("f", "new", "1")} and out.hit_rate == 0.6
    looked, found, states, _ = run(spark, cache, [("a", "one"), ("f", "new")], rules="2")
    assert looked == ["a", "f"] and states == {"a": "rules", "f": "rules", "b": "removed", "c": "removed", "e": "removed"} and {f[2] for f in found} == {"2"}
    assert [r.generation for r in log(spark, cache).orderBy("generation").collect()] == [1, 2, 3, 4]
    assert forget(spark, cache) == 3 and run(spark, cache, [("a", "one"), ("f", "new")], rules="2")[0] == []


def test_needs_reach_through_chains_and_cycles(spark, tmp_path):
    cache, n = str(tmp_path), 12
    rows = [(f"f{k}", "same") for k in range(n)] + [("x", "1"), ("y", "1"), ("z", "1"), ("gone", "1"), ("after", "1")]
    needs = [(f"f{k + 1}", f"f{k}") for k in range(n - 1)] + [("f0", f"f{n - 1}"), ("x", "y"), ("y", "x"), ("z", "z"), ("after", "gone"), (None, "x"), ("x", None), ("nobody", "f3")]
    assert len(run(spark, cache, rows, needs=needs)[0]) == len(rows)
    rows = [("f3", "other") if r[0] == "f3" else r for r in rows if r[0] != "gone"]
    looked, _, states, _ = run(spark, cache, rows, needs=needs)
    assert looked == sorted([*(f"f{k}" for k in range(n)), "after"])
    assert states["f3"] == "changed" and {states[f"f{k}"] for k in range(n) if k != 3} == {"depends"} and states["after"] == "depends" and states["gone"] == "removed" and {states[k] for k in "xyz"} == {"hit"}


def test_paths_that_repeat(spark, tmp_path):
    rows = [("a", "one"), ("a", "one"), ("b", "p"), ("b", "q"), ("b", "p"), ("c", "z")]
    looked, found, _, out = run(spark, str(tmp_path), rows)
    assert looked == ["a", "b", "c"] and out.misses == 3 and len(found) == 3
    assert run(spark, str(tmp_path), rows[::-1])[:2] == ([], found)


def test_a_run_that_is_cut_off_leaves_nothing(spark, tmp_path):
    cache = str(tmp_path)
    run(spark, cache, [("a", "one")])

    def fails(files):
        return files.select(F.col("path").alias("file"), F.raise_error(F.lit("lost")).cast("string").alias("word"), F.lit("1").alias("by"))

    with pytest.raises(Exception, match="lost"):
        incremental_scan(spark.createDataFrame([("a", "two", "")], SCHEMA), cache, fails)
    looked, found, states, out = run(spark, cache, [("a", "one")])
    assert looked == [] and found == [("a", "one", "1")] and out.generation == 2
    assert run(spark, cache, [])[1:3] == ([], {"a": "removed"})
