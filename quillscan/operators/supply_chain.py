"""Supply-chain checks over ``dependencies(ecosystem, name, version_spec)``, and manifest parsers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import lines
from ..refdata import DEPRECATED, DISPUTED, POPULAR


def popular_packages(spark: SparkSession) -> DataFrame:
    """``ecosystem, popular``: a fixed number of rows."""
    return spark.createDataFrame([(e, p) for e, names in POPULAR.items() for p in names], "ecosystem string, popular string")


def typosquats(deps: DataFrame) -> DataFrame:
    """Dependencies a small edit distance from a popular package that are not themselves popular.

    The popular table is fixed, so it is broadcast; the distance is computed with its
    bound, which ends early.
    """
    known = popular_packages(deps.sparkSession)
    size = F.length("popular")
    most = F.when(size <= 4, 1).when(size <= 10, 2).otherwise(3)
    joined = deps.join(known.select("ecosystem", F.col("popular").alias("name")), ["ecosystem", "name"], "left_anti").join(F.broadcast(known), "ecosystem")
    near = joined.withColumn("distance", F.levenshtein("name", "popular")).filter((F.col("distance") > 0) & (F.col("distance") <= most))
    return near.select("ecosystem", "name", "popular", "distance", F.round(1 - F.col("distance") / F.greatest(F.length("name"), size), 6).alias("confidence"))


def is_pinned(version: Column) -> Column:
    """Digits and dots only, with one = in front at most."""
    return F.coalesce(F.trim(version).rlike(r"^=?[0-9.]+$"), F.lit(False))


def flagged(deps: DataFrame) -> DataFrame:
    """Disputed, deprecated and unpinned dependencies: ``ecosystem, name, flag``."""
    flags = F.array_compact(
        F.array(F.when(F.col("name").isin(DISPUTED), F.lit("disputed")), F.when((F.col("ecosystem") == "npm") & F.col("name").isin(DEPRECATED), F.lit("deprecated")), F.when(~is_pinned(F.col("version_spec")), F.lit("unpinned")))
    )
    return deps.select("ecosystem", "name", F.explode(flags).alias("flag"))


def npm_dependencies(manifests: DataFrame) -> DataFrame:
    """Rows of all four dependency sections of package.json texts."""
    sections = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
    schema = "struct<" + ",".join(f"{s}:map<string,string>" for s in sections) + ">"
    parsed = manifests.select("path", F.from_json("text", schema).alias("m"))
    parts = [parsed.select("path", F.lit(s).alias("section"), F.explode(f"m.{s}").alias("name", "version_spec")) for s in sections]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("path", F.lit("npm").alias("ecosystem"), "name", "version_spec", "section")


def python_requirements(manifests: DataFrame) -> DataFrame:
    """Rows of requirements.txt texts: the name ends at > < = ! [ ; and the version follows == or >=."""
    line = F.trim("line")
    rows = manifests.select("path", F.explode(lines(F.col("text"))).alias("line")).filter((line != "") & ~line.startswith("#") & ~line.startswith("-"))
    return rows.select("path", F.lit("pypi").alias("ecosystem"), F.trim(F.regexp_extract(line, r"^([^><=!\[;]+)", 1)).alias("name"), F.nullif(F.trim(F.regexp_extract(line, r"(==|>=)\s*([^,;\s]+)", 2)), F.lit("")).alias("version_spec"))


def go_requirements(manifests: DataFrame) -> DataFrame:
    """First version per module of go.sum texts."""
    rows = manifests.select("path", F.posexplode(lines(F.col("text"))).alias("no", "line")).withColumn("p", F.split(F.trim("line"), r"\s+")).filter(F.size("p") >= 2)
    version = F.regexp_replace(F.element_at("p", 2), "/go\\.mod$", "")
    return rows.groupBy("path", F.element_at("p", 1).alias("name")).agg(F.min_by(version, "no").alias("version_spec")).select("path", F.lit("go").alias("ecosystem"), "name", "version_spec")


def purl(ecosystem: Column, name: Column, version: Column) -> Column:
    """Package URL; an npm scope is its namespace."""
    scoped = (ecosystem == "npm") & name.startswith("@")
    kind = F.when(ecosystem == "crates", "cargo").when(ecosystem == "go", "golang").otherwise(ecosystem)
    path = F.when(scoped, F.concat(F.lit("%40"), F.substring(name, F.lit(2), F.length(name)))).otherwise(name)
    return F.concat(F.lit("pkg:"), kind, F.lit("/"), path, F.coalesce(F.concat(F.lit("@"), version), F.lit("")))
