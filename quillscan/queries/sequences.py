"""Entropy of byte windows of the documents, and k-grams of nodes and calls of scripts made from parts; the SQL counts every window anew."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import sequences as S
from ..operators.structure import NODES
from .scripts import SQL, texts

SIZE, STEP = 512, 256
#: Entropy of a window that counts as dense.
DENSE = 4.3

_WINDOWS = f"""WITH b AS (SELECT doc_id, octet_length(encode(text)) AS n, unnest(regexp_extract_all(hex(encode(text)), '..')) AS byte, generate_subscripts(regexp_extract_all(hex(encode(text)), '..'), 1) - 1 AS pos FROM documents),
w AS (SELECT doc_id, n, byte, unnest([pos // {STEP} - 1, pos // {STEP}]) AS k FROM b),
c AS (SELECT doc_id, k, byte, count(*) AS c FROM w WHERE k >= 0 AND k * {STEP} + {SIZE} <= n GROUP BY doc_id, k, byte),
e AS MATERIALIZED (SELECT doc_id, k * {STEP} AS first_byte, round(greatest(0, -sum(c / {SIZE}.0::DOUBLE * log2(c / {SIZE}.0::DOUBLE))), 6) AS entropy FROM c GROUP BY doc_id, k)"""


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


@query(f"{_WINDOWS} SELECT doc_id, CAST(first_byte AS BIGINT) AS first_byte, entropy FROM e")
def entropy_windows(spark, sf_dir):
    """Entropy of every window of every document."""
    return S.windowed_entropy(_docs(spark, sf_dir), SIZE, STEP, "doc_id").select("doc_id", F.col("at").alias("first_byte"), F.round("entropy", 6).alias("entropy"))


@query(
    f"""{_WINDOWS}, hot AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY first_byte) AS g FROM (SELECT *, CASE WHEN first_byte - lag(first_byte) OVER (PARTITION BY doc_id ORDER BY first_byte) <= {SIZE} THEN 0 ELSE 1 END AS new FROM e WHERE entropy >= {DENSE}))
  SELECT doc_id, CAST(min(first_byte) AS BIGINT) AS first_byte, CAST(max(first_byte) + {SIZE} AS BIGINT) AS end_byte, CAST(count(*) AS INTEGER) AS windows, max(entropy) AS peak FROM hot GROUP BY doc_id, g"""
)
def packed_ranges(spark, sf_dir):
    """Byte ranges of documents whose windows are dense."""
    found = S.packed_ranges(_docs(spark, sf_dir), DENSE, SIZE, STEP, "doc_id")
    return found.select("doc_id", F.col("start").alias("first_byte"), F.col("end").alias("end_byte"), "windows", F.round("peak", 6).alias("peak"))


#: Calls and nodes that a script gets besides its own.
_MORE = "text || CASE WHEN part % 2 = 0 THEN 'Math.max(a); React.createElement.call (b); Math.max(c); A.1x(d); ' ELSE '' END || CASE WHEN part % 3 = 0 THEN 'if (x) { throw y; } while(z) new Foo.bar$ (w); x => y; ' ELSE '' END || CASE WHEN part % 5 = 0 THEN 'try { Array.prototype.slice(' || CAST(part AS STRING) || ') } catch (e) { return; } P' || CAST(part AS STRING) || '.q(r); ' ELSE '' END"
_NUMBERS = " || ".join(
    f"list_transform(range({' + '.join(f'''(length(low) - length(replace(low, '{k}', ''))) // {len(k)}''' for k in keys)}), lambda x: CAST({S.NODE_NUMBERS[letter]} AS UBIGINT))" for letter, _, keys in sorted(NODES, key=lambda n: n[1])
)
_FNV = f"list_transform(calls, lambda c: list_reduce([CAST({S.FNV_START} AS UBIGINT)] || list_transform(string_split(c, ''), lambda x: CAST(ord(x) AS UBIGINT)), lambda h, b: CAST((CAST(xor(h, b) AS UHUGEINT) * {S.FNV_FACTOR}) % 18446744073709551616 AS UBIGINT)))"


def _gram_sql() -> str:
    h = "CAST(0 AS UBIGINT)"
    for k, factor in enumerate(S.GRAM_FACTORS):
        mixed = f"xor({h}, CAST((CAST(f[i + {k}] AS UHUGEINT) * CAST({factor} AS UHUGEINT)) % 18446744073709551616 AS UBIGINT))"
        h = f"list_transform([{mixed}], lambda y{k}: CAST((CAST(y{k} AS UHUGEINT) * {2**S.TURN}) % 18446744073709551616 AS UBIGINT) | (y{k} >> {64 - S.TURN}))[1]"
    return f"list_transform(range(1, greatest(1, len(f) - {S.GRAM - 2})), lambda i: {h})"


@query(
    rf"""WITH {SQL}, src AS (SELECT path, {_MORE.replace("STRING", "VARCHAR")} AS text FROM code),
    parts AS (SELECT path, lower(text) AS low, list_distinct_in_order AS calls FROM (SELECT path, text, list_transform(list_filter(list_zip(c, range(len(c))), lambda z: list_position(c, z[1]) = z[2] + 1), lambda z: z[1]) AS list_distinct_in_order FROM (SELECT path, text, regexp_extract_all(text, '([A-Z][a-zA-Z0-9_$]*(?:\.[a-zA-Z_$][a-zA-Z0-9_$]*)+)\s*\(', 1) AS c FROM src))),
    feat AS (SELECT path, {_NUMBERS} || {_FNV} AS f FROM parts), gram AS (SELECT path, f, {_gram_sql()} AS g FROM feat),
    least_ AS (SELECT path, f, g, list_transform(range(1, greatest(1, len(g) - {S.WINDOW - 2})), lambda i: list_min(g[i:i + {S.WINDOW - 1}])) AS w FROM gram),
    out_ AS (SELECT path, CASE WHEN len(f) < {S.GRAM} THEN f WHEN len(g) < {S.WINDOW} THEN g ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: i = 1 OR w[i] <> w[i - 1]), lambda i: w[i]) END AS h FROM least_),
    each AS (SELECT path, unnest(h) AS h, generate_subscripts(h, 1) AS place FROM out_)
    SELECT path, CAST(place AS INTEGER) AS place, CAST(CASE WHEN h >= 9223372036854775808 THEN CAST(h AS HUGEINT) - 18446744073709551616 ELSE h END AS BIGINT) AS gram FROM each"""
)
def node_grams(spark, sf_dir):
    """Winnowed k-grams over nodes and calls of scripts."""
    scripts = texts(spark, sf_dir).select("path", F.expr(_MORE).alias("text"))
    return scripts.select("path", F.posexplode(S.node_grams(F.col("text"))).alias("_k", "gram")).select("path", (F.col("_k") + 1).alias("place"), "gram")
