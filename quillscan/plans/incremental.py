"""Scans that look only at what changed: findings are kept by path and content, with the rules they were made by.

A cache is a folder of generations, each with ``files`` (path, sha256, rules) and ``findings``, and
a log that names the generations that are whole. A run reads the newest whole one, scans what it does not answer for, and
writes the next; a run that is cut off leaves a generation that nobody reads.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import written
from .scan import detect

_LOG = "generation long, name string, hits long, misses long"
_FILES = "path string, sha256 string, rules string"


@dataclass
class Scanned:
    """What a run found; all are tables that are written already."""

    #: Findings of all files, old and new.
    findings: DataFrame
    #: ``path, sha256, state``: ``hit``, ``changed``, ``new``, ``rules``, ``depends`` or ``removed``.
    states: DataFrame
    generation: int
    hits: int
    misses: int

    @property
    def hit_rate(self) -> float:
        return self.hits / (self.hits + self.misses) if self.hits + self.misses else 0.0


def log(spark: SparkSession, cache: str) -> DataFrame:
    """``generation, name, hits, misses`` of all whole generations; no rows for a folder that is not there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{cache.rstrip('/')}/log")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], _LOG)
    return spark.read.schema(_LOG).parquet(f"{cache.rstrip('/')}/log")


def _reached(changed: DataFrame, needs: DataFrame, paths: DataFrame) -> DataFrame:
    """``path`` of files that need a changed one, directly or through others; a round of written frontiers per step of the way."""
    needs = written(needs.filter("path IS NOT NULL AND needs IS NOT NULL AND path <> needs").select("path", "needs").distinct(), "needs")
    frontier, seen = written(changed.select("path").distinct(), "changed"), None
    while True:
        seen = frontier if seen is None else written(seen.unionByName(frontier), "reached")
        step = needs.join(frontier.withColumnRenamed("path", "needs"), "needs", "left_semi").select("path").distinct()
        frontier = written(step.join(seen, "path", "left_anti"), "frontier")
        if frontier.isEmpty():
            return seen.join(changed, "path", "left_anti").join(paths, "path", "left_semi")


def incremental_scan(files: DataFrame, cache: str, detector: Callable[[DataFrame], DataFrame] = detect, rules: str = "1", needs: DataFrame | None = None) -> Scanned:
    """Findings of ``files`` (``path, text`` and what ``detector`` needs), scanning only what the cache does not answer for.

    A file is scanned if its path is new, its content or the name of the ``rules`` is another than last time, or if it
    ``needs`` (a table ``path, needs``) a file that is scanned or gone, through any number of others. ``detector`` must work
    file by file and name them in ``file``. Files that are gone lose their findings. A null text counts as empty; rows
    without a path take no part. Of rows that share a path one counts: that whose content's hash is least, of equal
    contents any. What has to be scanned is told before any text is read again.
    """
    spark, root = files.sparkSession, cache.rstrip("/")
    last = log(spark, root).orderBy(F.desc("generation"), "name").first()
    files = files.filter("path IS NOT NULL").withColumn("_sha", F.sha2(F.coalesce("text", F.lit("")), 256))
    least = files.groupBy("path", "_sha").agg(F.count("*").alias("n")).groupBy("path").agg(F.min(F.struct("_sha", "n")).alias("_one"), F.count("*").alias("contents"))
    now = written(least.select("path", F.col("_one._sha").alias("sha256"), F.col("_one.n").alias("n"), "contents"), "hashes")
    old = spark.createDataFrame([], _FILES) if last is None else spark.read.schema(_FILES).parquet(f"{root}/{last.name}/files")
    both = now.select("path", "sha256", F.lit(True).alias("_now")).join(old.select("path", F.col("sha256").alias("_was"), "rules"), "path", "full")
    state = F.when(F.col("_now").isNull(), "removed").when(F.col("_was").isNull(), "new").when(F.col("_was") != F.col("sha256"), "changed").when(F.col("rules") != rules, "rules").otherwise("hit")
    states = written(both.select("path", F.coalesce("sha256", "_was").alias("sha256"), state.alias("state")), "states")
    if needs is not None and last is not None:
        reached = _reached(states.filter("state <> 'hit'").select("path"), needs, now.select("path")).withColumn("_reached", F.lit(True))
        states = written(states.join(reached, "path", "left").select("path", "sha256", F.when(F.col("_reached"), "depends").otherwise(F.col("state")).alias("state")), "states")
    counted = {r.state: r.n for r in states.groupBy("state").agg(F.count("*").alias("n")).collect()}
    hits, misses = counted.get("hit", 0), sum(n for s, n in counted.items() if s not in ("hit", "removed"))

    due = files
    if hits or not now.filter("contents > 1").isEmpty():
        due = files.join(states.filter("state NOT IN ('hit', 'removed')").select("path", F.col("sha256").alias("_sha")), ["path", "_sha"], "left_semi")
    again = written(now.filter("n > 1").select("path"), "repeated")
    if not again.isEmpty():
        due = due.join(again, "path", "left_anti").unionByName(due.join(again, "path", "left_semi").dropDuplicates(["path"]))
    fresh = detector(due.drop("_sha"))
    if hits:
        kept = spark.read.parquet(f"{root}/{last.name}/findings").join(states.filter("state = 'hit'").select(F.col("path").alias("file")), "file", "left_semi")
        fresh = kept.select(*fresh.columns).unionByName(fresh)

    generation = 1 if last is None else last.generation + 1
    name = f"generation-{generation}-{uuid.uuid4().hex}"
    fresh.write.option("compression", "zstd").parquet(f"{root}/{name}/findings")
    states.filter("state <> 'removed'").select("path", "sha256", F.lit(rules).alias("rules")).write.option("compression", "zstd").parquet(f"{root}/{name}/files")
    spark.createDataFrame([(generation, name, hits, misses)], _LOG).coalesce(1).write.mode("append").parquet(f"{root}/log")
    return Scanned(spark.read.parquet(f"{root}/{name}/findings"), states, generation, hits, misses)


def forget(spark: SparkSession, cache: str, keep: int = 1) -> int:
    """Delete all but the newest ``keep`` whole generations; how many went. The log keeps naming them as a history."""
    names = [r.name for r in log(spark, cache).orderBy(F.desc("generation"), "name").collect()][max(1, keep) :]
    gone = 0
    for name in names:
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{cache.rstrip('/')}/{name}")
        gone += place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return gone
