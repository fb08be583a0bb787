"""Whether projects keep the licences, notices and headers of what they ship, for any number of projects at once.

``projects`` has ``project, licence``; ``files`` has ``project, path, text`` with paths from the project's root;
``dependencies`` has ``project, name, licence``. What a vendored folder holds is counted where its files are: a file
becomes a few flags first, which are written down, then is counted under every ancestor that a dependency's name is long
enough for; these counts meet the dependencies. Texts are read once and, but for notices, never shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.license import family
from ..functions.text import bound, lines
from ..storage import written
from .bundles import extension, file_name
from .classification import classified
from .licences import obligations

# Names of licence and notice files, in the order they are looked for.
LICENCE_FILES = ["LICENSE", "LICENSE.md", "LICENSE.txt", "LICENSE-MIT", "LICENSE-APACHE", "LICENSE.MIT", "LICENSE.APACHE", "LICENCE", "LICENCE.md", "LICENCE.txt", "COPYING", "COPYING.md", "COPYING.txt", "COPYING.LIB", "COPYING.LESSER", "COPYRIGHT", "COPYRIGHT.txt"]
NOTICE_FILES = ["NOTICE", "NOTICE.md", "NOTICE.txt", "NOTICES", "THIRD-PARTY-NOTICES", "THIRD-PARTY-NOTICES.txt", "THIRD_PARTY_NOTICES", "THIRD_PARTY_NOTICES.md", "THIRDPARTYNOTICES", "ThirdPartyNotices.txt"]
# Folders that hold copies of dependencies, in the order they are looked for, and folders that builds fill.
VENDOR_FOLDERS = ["vendor", "third_party", "third-party", "node_modules", "deps", "lib", "extern", "external", "thirdparty", "3rdparty"]
BUILD_FOLDERS = ["dist", "build", "out", "public"]
# Source files that need headers, words of a header, lines it may fill, least share of files with one; depths of the folders.
SOURCES = ["rs", "py", "js", "ts", "java", "go", "c", "h", "cpp", "hpp"]
HEADER_WORDS = ["license", "copyright", "spdx"]
HEADER_LINES, HEADER_SHARE = 30, 0.5
VENDOR_DEPTH, BUILD_DEPTH = 5, 4
# Scripts and sheets that builds make, least bytes of one that needs a comment, what such a comment looks like.
BUILT = ["js", "css", "mjs", "cjs"]
BUILT_BYTES = 10_000
COMMENT = r"(?:/\*[!*]|/\*\*?)\s*(?:@license|@preserve|@copyright|Copyright|Licensed under|MIT License|Apache License|GNU General)"
# Weight of dependencies beside built files in the score; least confidence of a licence that does not match.
DEPENDENCY_WEIGHT, SURE = 0.8, 0.6


@dataclass
class Checked:
    """What :func:`check` found: lazy DataFrames."""

    #: project, name, licence, folder, has_licence, matches, in_notice, headers_kept
    dependencies: DataFrame
    #: project, vtype, severity, confidence, subject, evidence
    findings: DataFrame
    #: project, n_dependencies, built_files, built_bare, completeness
    scores: DataFrame


def _place(name: Column, names: list[str]) -> Column:
    return F.nullif(F.array_position(F.array(*map(F.lit, names)), name), F.lit(0).cast("long"))


def _segments(path: Column) -> Column:
    return F.split(path, "/")


def _flags(files: DataFrame) -> DataFrame:
    """``project, path, depth, top, licence_place, said, source, headed, built, bare, size``: what is needed of each file."""
    path, name, ext = F.col("path"), file_name(F.col("path")), extension(F.col("path"))
    text = F.coalesce("text", F.lit(""))
    head = F.lower(F.array_join(F.slice(lines(text), 1, HEADER_LINES), "\n"))
    licence = _place(name, LICENCE_FILES)
    source, built = F.coalesce(ext.isin(SOURCES), F.lit(False)), F.coalesce(ext.isin(BUILT), F.lit(False))
    headed = F.lit(False)
    for word in HEADER_WORDS:
        headed = headed | head.contains(word)
    size = F.octet_length(text)
    top, depth = _segments(path)[0], F.size(_segments(path))
    said = bound(classified(text), lambda c: F.when(c.isNotNull(), F.struct(c["licence"].alias("licence"), c["confidence"].alias("confidence"))))
    built = built & top.isin(BUILD_FOLDERS) & (depth >= 2) & (depth <= BUILD_DEPTH + 1)
    return files.filter("project IS NOT NULL AND path IS NOT NULL").select(
        "project",
        "path",
        depth.alias("depth"),
        top.alias("top"),
        licence.alias("licence_place"),
        F.when(licence.isNotNull(), said).alias("said"),
        source.alias("source"),
        (source & headed).alias("headed"),
        built.alias("built"),
        (built & (size >= BUILT_BYTES) & ~text.rlike(COMMENT)).alias("bare"),
        size.alias("size"),
    )


def _first(value: Column, place: Column) -> Column:
    """``value``, a licence struct, of the row with the least place; of those the one without a licence, or with the first one."""
    return F.min_by(value, F.struct(place, F.coalesce(value["licence"], F.lit("")), F.coalesce(value["confidence"], F.lit(0.0))))


def _vendored(flags: DataFrame, wanted: DataFrame) -> DataFrame:
    """``project, name, folder`` of the first vendored folder of that name, with what it holds; also of names that only look like a dependency's.

    Files are dealt out once, by project and name, and put in order once: the counts by folder, the choice of a folder
    and the join with ``wanted`` all keep that order.
    """
    parts, tops = _segments(F.col("path")), F.array(*map(F.lit, VENDOR_FOLDERS))
    inside = flags.filter(F.col("top").isin(VENDOR_FOLDERS) & (F.col("depth") >= 3)).withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("depth") - 2)))
    lengths = wanted.select(F.size(_segments(F.col("name"))).alias("_n")).distinct()
    below = F.col("depth") - 1 - F.col("_n")
    direct, near = (below == 1) & F.col("licence_place").isNotNull(), below <= VENDOR_DEPTH
    each = inside.join(F.broadcast(lengths), "_n", "left_semi").select(
        "project",
        F.array_join(F.slice(parts, F.lit(2), F.col("_n")), "/").alias("name"),
        F.array_position(tops, F.col("top")).cast("int").alias("_rank"),
        F.when(direct, F.col("licence_place")).alias("_place"),
        F.when(direct, F.col("said")).alias("said"),
        (near & F.col("source")).alias("source"),
        (near & F.col("headed")).alias("headed"),
    )
    found = each.repartition("project", "name").groupBy("project", "name", "_rank").agg(
        (F.count("_place") > 0).alias("has_licence"),
        _first(F.col("said"), F.coalesce("_place", F.lit(len(LICENCE_FILES) + 1))).alias("said"),
        F.count_if("source").alias("sources"),
        F.count_if("headed").alias("headed"),
    )
    best = F.min_by(F.struct("_rank", "has_licence", "said", "sources", "headed"), "_rank")
    return found.groupBy("project", "name").agg(best.alias("_v")).select("project", "name", F.concat(F.element_at(tops, F.col("_v._rank")), F.lit("/"), "name").alias("folder"), *(f"_v.{c}" for c in ("has_licence", "said", "sources", "headed")))


def _finding(vtype: str, severity: str, confidence: Column | float, subject: Column, evidence: Column) -> list[Column]:
    confidence = confidence if isinstance(confidence, Column) else F.lit(confidence)
    return ["project", F.lit(vtype).alias("vtype"), F.lit(severity).alias("severity"), confidence.alias("confidence"), subject.cast("string").alias("subject"), evidence.cast("string").alias("evidence")]


def check(projects: DataFrame, files: DataFrame, dependencies: DataFrame) -> Checked:
    """All checks of all projects; what is known of files and of dependencies is written to the shared folder first. Rows with a null project, name or path take no part; a null licence owes nothing and matches none.

    A project or a dependency (project and name) that is listed again counts once, with its least licence. Files
    that share a path all count; of several licence or notice files the first by name is read, of those that share a
    path the notice with the least text and the licence file that names none, or the first one. Projects without files miss their licence; projects without dependencies are complete.
    """
    projects = projects.filter("project IS NOT NULL").groupBy("project").agg(F.min("licence").alias("licence"))
    deps = dependencies.filter("project IS NOT NULL AND name IS NOT NULL").groupBy("project", "name").agg(F.min("licence").alias("licence"))
    deps = obligations(deps).select("project", "name", "licence", *(F.array_contains("obligations", o).alias(o) for o in ("Attribution", "NoticeFile", "HeaderPreservation")))
    flags = written(_flags(files), "attribution-files")

    root_place = F.when((F.col("depth") == 1) & F.col("licence_place").isNotNull(), F.col("licence_place"))
    roots = flags.filter(root_place.isNotNull() | F.col("built")).groupBy("project").agg(F.min(root_place).alias("root_place"), _first(F.when(root_place.isNotNull(), F.col("said")), F.coalesce(root_place, F.lit(len(LICENCE_FILES) + 1))).alias("root_said"), F.count_if("built").alias("built_files"), F.count_if("bare").alias("built_bare"))
    notices = files.filter("project IS NOT NULL AND path IS NOT NULL").withColumn("_place", _place(F.col("path"), NOTICE_FILES)).filter("_place IS NOT NULL").groupBy("project").agg(F.lower(F.min_by(F.coalesce("text", F.lit("")), F.struct("_place", F.coalesce("text", F.lit(""))))).alias("notice"))

    fits = (F.col("said.licence") == F.col("licence")) | (family(F.col("said.licence")) == family(F.col("licence")))
    status = deps.join(_vendored(flags, deps), ["project", "name"], "left").withColumn("matches", F.when(F.col("has_licence") & F.col("said").isNotNull(), F.coalesce(fits, F.lit(False))))
    kept = (F.col("sources") == 0) | (F.col("headed") / F.col("sources") >= HEADER_SHARE)
    status = status.withColumn("headers_kept", F.when(F.col("folder").isNotNull() & F.col("HeaderPreservation"), kept))
    status = written(status.withColumn("has_licence", F.coalesce("has_licence", F.lit(False))), "attribution-dependencies")
    in_notice = F.coalesce(F.col("notice").contains(F.lower("name")), F.lit(False))
    owing = written(status.filter("NoticeFile").join(notices, "project", "left").withColumn("in_notice", in_notice).withColumn("has_notice", F.col("notice").isNotNull()).drop("notice"), "attribution-notices")
    status = status.filter("NOT NoticeFile").withColumn("in_notice", F.lit(None).cast("boolean")).unionByName(owing.drop("has_notice"))

    root = projects.join(roots, "project", "left")
    differs = ~F.coalesce((F.col("root_said.licence") == F.col("licence")) | (family(F.col("root_said.licence")) == family(F.col("licence"))), F.lit(False))
    found = [
        root.filter("root_place IS NULL").select(_finding("MissingAttribution", "Medium", 0.99, F.lit("."), F.col("licence"))),
        root.filter(F.col("root_said").isNotNull() & differs & (F.col("root_said.confidence") > SURE)).select(_finding("IncorrectAttribution", "Critical", F.col("root_said.confidence"), F.lit("."), F.col("root_said.licence"))),
        owing.filter(~F.col("has_notice")).groupBy("project").agg(F.count("*").alias("n")).select(_finding("MissingNoticeFile", "Medium", 0.95, F.lit("."), F.col("n"))),
        owing.filter(F.col("has_notice") & ~F.col("in_notice")).select(_finding("MissingNoticeFile", "Low", 0.8, F.col("name"), F.col("licence"))),
        status.filter(~F.col("matches") & (F.col("said.confidence") > SURE)).select(_finding("IncorrectAttribution", "High", F.col("said.confidence"), F.col("name"), F.col("said.licence"))),
        status.filter(F.col("folder").isNotNull() & ~F.col("has_licence") & F.col("Attribution")).select(_finding("StrippedLicense", "High", 0.9, F.col("name"), F.col("folder"))),
        status.filter(~F.col("headers_kept")).select(_finding("StrippedLicense", "Medium", 0.8, F.col("name"), F.col("folder"))),
        flags.filter("bare").select(_finding("MissingAttribution", "Low", 0.65, F.col("path"), F.col("size"))),
    ]
    findings = found[0]
    for more in found[1:]:
        findings = findings.unionByName(more)

    checks = [F.col("has_licence"), F.col("matches"), F.col("in_notice"), F.col("headers_kept")]
    points = sum((F.coalesce(c.cast("int"), F.lit(0)) for c in checks), F.lit(0)) / sum((c.isNotNull().cast("int") for c in checks), F.lit(0))
    by_project = status.withColumn("_points", points).groupBy("project").agg(F.count("*").alias("n_dependencies"), F.avg("_points").alias("_mean"))
    scores = root.select("project", F.coalesce("built_files", F.lit(0)).alias("built_files"), F.coalesce("built_bare", F.lit(0)).alias("built_bare")).join(by_project, "project", "left")
    built = F.when(F.col("built_files") > 0, DEPENDENCY_WEIGHT * F.col("_mean") + (1 - DEPENDENCY_WEIGHT) * (1 - F.col("built_bare") / F.col("built_files"))).otherwise(F.col("_mean"))
    scores = scores.select("project", F.coalesce("n_dependencies", F.lit(0)).alias("n_dependencies"), "built_files", "built_bare", F.coalesce(built, F.lit(1.0)).alias("completeness"))
    return Checked(status.select("project", "name", "licence", "folder", "has_licence", "matches", "in_notice", "headers_kept"), findings, scores)
