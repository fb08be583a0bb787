"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Each source's documents are cut into hash blocks in a permuted order.  A source's block
quota is whole passes over its blocks and a partial one that ends inside the block where
its target in words is met.  The quotas are partitioned among the output shards by a
tree: a range of shards hands its two halves one multivariate hypergeometric draw of its
block quotas.  Each shard then draws its quota of a source: the next run of the source's
permuted blocks, disjoint from all other shards' runs, and shuffles its documents
locally by a hash order.  In the block that ends a source's partial pass documents are
drawn in hash order and the last one is cut, so the target is met to the word.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, written

#: Weights by a source's place in code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: Size of the mix and most repetitions, in units of the input's and of a source's size.
TOTAL, MOST = 1.5, 2.0
BLOCKS = 1024
#: Parts of a source's last block; groups that its equal rows are dealt to; sources whose figures are surely small.
_SUBS, _SALTS, _FEW = 64, 32, 1_000
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[float], total: float, most: float = MOST) -> list[float]:
    """Share ``total`` by weight; no share above ``most`` times its size, the excess going to the others by weight."""
    out = [0.0] * len(sizes)
    capped: set[int] = set()
    while True:
        free = [k for k in range(len(sizes)) if k not in capped]
        left = total - math.fsum(most * sizes[k] for k in capped)
        scale = math.fsum(weights[k] for k in free)
        for k in free:
            out[k] = left * weights[k] / scale if scale else 0.0
        over = [k for k in free if out[k] > most * sizes[k]]
        if not over:
            return out
        for k in over:
            out[k] = most * sizes[k]
        capped.update(over)


def splitting_tree(quotas: list[int], shards: int, seed: int = 0) -> np.ndarray:
    """Draws of each source (columns) per shard (rows); every shard gets an equal share up to rounding."""
    out = np.zeros((shards, len(quotas)), dtype=np.int64)
    todo = [(0, shards, np.asarray(quotas, dtype=np.int64))]
    while todo:
        lo, hi, counts = todo.pop()
        if hi - lo == 1:
            out[lo] = counts
            continue
        mid = (lo + hi) // 2
        n = int(counts.sum()) * (mid - lo) // (hi - lo)
        rng = np.random.default_rng([seed, lo, hi])
        left = rng.multivariate_hypergeometric(counts, n, method="marginals") if n else np.zeros_like(counts)
        todo += [(lo, mid, left), (mid, hi, counts - left)]
    return out


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def first_words(text: Column, n: Column) -> Column:
    """The text up to its n-th word, white space as it stands."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), F.lit(1), n.cast("int")), "")


def draw(docs: DataFrame, payload: list[str], id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", total: float = TOTAL, shards: int | None = None, blocks: int = BLOCKS, seed: int = 0) -> DataFrame:
    """One row per row of ``docs``: ``_id, _size, _source_size, _target, _draws`` and a struct ``_row`` of the payload columns.

    ``_draws`` is an array of (pass, shard, take, order), one per copy in the mix.
    ``docs`` is written once with its word counts; then only per-source figures (a row
    per source) and the tree (a row per source and shard that draws from it, at most
    the quotas' sum) pass through the driver.  Blocks spread a hot source over
    ``blocks`` groups; only the one block per source that its pass ends in is put in
    order, in ``_SUBS`` parts by content and, inside one content, ``_SALTS`` groups.  Null text has size 0 and is drawn with its block; null
    sources form a source of their own, ordered last; rows that agree in id and text
    are interchangeable.
    """
    spark = docs.sparkSession
    shards = shards or partitions(spark)
    source, text = docs[source_col].cast("string"), docs[text_col].cast("string")
    base = docs.select(
        docs[id_col].cast("long").alias("_id"),
        source.isNull().alias("_none"),
        F.coalesce(source, F.lit("")).alias("_src"),
        word_count(text).alias("_size"),
        F.xxhash64(F.lit(seed), docs[id_col].cast("long"), text).alias("_h"),
        F.monotonically_increasing_id().alias("_n"),
        F.struct(*(docs[c] for c in payload)).alias("_row") if payload else F.lit(None).cast("int").alias("_row"),
    )
    base = written(base.withColumn("_block", F.pmod(F.xxhash64(F.lit(seed + 1), "_h"), F.lit(blocks)).cast("int")), "sized")
    key = ["_none", "_src"]
    per_block = base.groupBy(*key, "_block").agg(F.sum("_size").alias("_words"), F.count("*").alias("_rows"))
    order = Window.partitionBy(*key).orderBy(F.xxhash64(F.lit(seed + 2), "_src", "_block"), "_block")  # at most `blocks` rows a source
    before = F.sum("_words").over(order.rowsBetween(Window.unboundedPreceding, -1))
    placed = written(per_block.select(*key, "_block", "_words", "_rows", (F.row_number().over(order) - 1).alias("_place"), F.coalesce(before, F.lit(0)).alias("_before")), "blocks")
    stats = sorted(placed.groupBy(*key).agg(F.sum("_words").alias("w"), F.count("*").alias("n")).collect(), key=lambda r: (r["_none"], r["_src"]))
    sizes = [r.w for r in stats]
    goal = targets(sizes, [WEIGHTS[k % len(WEIGHTS)] for k in range(len(stats))], total * sum(sizes))
    passes = [int(t // s) if s else 0 for t, s in zip(goal, sizes, strict=True)]
    rest = [min(s, round(t - p * s)) for t, p, s in zip(goal, passes, sizes, strict=True)]
    plan = spark.createDataFrame(
        [(r["_none"], r["_src"], s, float(t), p, q, r.n) for r, s, t, p, q in zip(stats, sizes, goal, passes, rest, strict=True)],
        "_none boolean, _src string, _source_size long, _target double, _passes int, _rest long, _blocks int",
    )
    # blocks of the partial pass: those that begin before the rest is met
    opened = {(r["_none"], r["_src"]): r.n for r in placed.join(plan, key).filter("_before < _rest").groupBy(*key).agg(F.count("*").alias("n")).collect()}
    quotas = [p * r.n + opened.get((r["_none"], r["_src"]), 0) for r, p in zip(stats, passes, strict=True)]
    tree = splitting_tree(quotas, shards, seed)
    upto = np.cumsum(tree, axis=0)
    runs = [(stats[k]["_none"], stats[k]["_src"], int(j), int(upto[j, k] - tree[j, k]), int(upto[j, k])) for j, k in zip(*np.nonzero(tree), strict=True)]
    drawn = (
        spark.createDataFrame(runs, "_none boolean, _src string, shard int, _lo int, _hi int")
        .join(plan.select(*key, "_blocks"), key)
        .select(*key, "shard", "_blocks", F.explode(F.sequence(F.col("_lo"), F.col("_hi") - 1)).alias("_no"))
        .select(*key, "shard", (F.col("_no") % F.col("_blocks")).alias("_place"), (F.floor(F.col("_no") / F.col("_blocks")) + 1).cast("int").alias("pass"))
    )
    of_place = drawn.groupBy(*key, "_place").agg(F.collect_list(F.struct("pass", "shard")).alias("_list"))  # a draw per pass
    fate = placed.join(plan, key).join(of_place, [*key, "_place"], "left").withColumn("_open", F.col("_rest") - F.col("_before"))
    fate = fate.select(*key, "_block", "_source_size", "_target", "_passes", "_list", "_rows", F.when((F.col("_open") > 0) & (F.col("_open") < F.col("_words")), F.col("_open")).alias("_open"))
    fate = written(fate, "fate")
    # the block a pass ends in (at most one per source): words before each row, by sums over parts and an order inside them
    ends = [tuple(r) for r in fate.filter("_open IS NOT NULL").select(*key, "_block", "_rows", "_open").collect()]
    edge = spark.createDataFrame(ends, "_none boolean, _src string, _block int, _in long, _left long")
    marked = base.join(F.broadcast(edge) if len(ends) <= _FEW else edge, [*key, "_block"], "left")
    part = F.pmod(F.xxhash64(F.lit(seed + 5), "_h", F.lit(None).cast("long")), F.lit(_SUBS)).cast("int")
    # rows that agree in hash, id and size are interchangeable: which of them a salt gets decides nothing
    like = [*key, "_part", "_h", "_id", "_size", "_salt"]
    inside = marked.filter("_left IS NOT NULL").withColumns({"_part": part, "_salt": F.pmod(F.xxhash64("_n"), F.lit(_SALTS)).cast("int")})
    alike = inside.groupBy(*like).agg(F.sum("_size").alias("_sum"))
    sums = alike.groupBy(*key, "_part").agg(F.sum("_sum").alias("_all"))
    shift = sums.select(*key, "_part", F.coalesce(F.sum("_all").over(Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_shift"))
    in_part = Window.partitionBy(*key, "_part").orderBy("_h", "_id", "_size", "_salt").rowsBetween(Window.unboundedPreceding, -1)
    begins = alike.withColumn("_begin", F.coalesce(F.sum("_sum").over(in_part), F.lit(0))).join(shift, [*key, "_part"])
    within = Window.partitionBy(*like).orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
    counted = inside.withColumn("_inner", F.coalesce(F.sum("_size").over(within), F.lit(0)))
    same = [counted[c].eqNullSafe(begins[c]) for c in like]
    ranked = counted.join(begins, reduce(and_, same)).select(*(counted[c] for c in counted.columns), (begins["_begin"] + counted["_inner"]).alias("_earlier"), begins["_shift"])
    cut = ranked.withColumn("_cut", F.greatest(F.lit(0), F.least("_size", F.col("_left") - F.col("_earlier") - F.col("_shift"))))
    names = [*base.columns, "_cut"]
    rows = marked.filter("_left IS NULL").withColumn("_cut", F.col("_size")).select(names).unionByName(cut.select(names)).join(fate, [*key, "_block"])
    draws = F.transform(
        F.coalesce(F.col("_list"), F.expr("cast(array() as array<struct<pass:int,shard:int>>)")),
        lambda d: F.struct(d["pass"].alias("pass"), d["shard"].alias("shard"), F.when(d["pass"] > F.col("_passes"), F.col("_cut")).otherwise(F.col("_size")).alias("take"), F.xxhash64(F.lit(seed + 4), F.col("_h"), d["pass"], d["shard"]).alias("order")),
    )
    kept = F.array_sort(F.filter(draws, lambda d: (d["take"] > 0) | ((F.col("_size") == 0) & (d["pass"] == 1))))
    return rows.select("_id", "_size", "_source_size", "_target", kept.alias("_draws"), "_row")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix itself: rows of ``docs`` with all their columns, as often as they are drawn, the cut ones with the words taken.

    Rows come out by shard and, inside a shard, in shuffled order.  An empty table gives
    an empty mix.
    """
    copies = draw(docs, docs.columns, id_col, text_col, source_col, **options).select("_size", "_row", F.explode("_draws").alias("_d"))
    shards = options.get("shards") or partitions(docs.sparkSession)
    copies = copies.repartition(shards, F.col("_d.shard")).sortWithinPartitions("_d.shard", "_d.order")
    text = F.when(F.col("_d.take") < F.col("_size"), first_words(F.col("_row")[text_col], F.col("_d.take"))).otherwise(F.col("_row")[text_col])
    return copies.select(*(text.alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in docs.columns))
