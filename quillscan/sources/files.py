"""Sources: directories as a ``files`` table, and driver tables seen as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# File categories by extension, licence-like names and manifests.
EXTENSIONS = {
    "JavaScript": ["js", "mjs", "cjs", "jsx"],
    "TypeScript": ["ts", "tsx", "mts", "cts"],
    "SourceCode": ["rs", "py", "go", "java", "c", "h", "cpp", "hpp", "cc", "cs", "rb", "php", "swift", "kt", "scala"],
    "Stylesheet": ["css", "scss", "sass", "less"],
    "Markup": ["html", "htm", "xml", "svg"],
    "Config": ["toml", "yaml", "yml", "ini", "cfg", "conf", "env"],
    "Data": ["csv", "tsv", "json", "jsonl", "ndjson", "parquet", "sqlite", "db", "xlsx"],
    "Image": ["png", "jpg", "jpeg", "gif", "webp", "bmp", "ico"],
    "Audio": ["mp3", "wav", "flac", "ogg", "m4a"],
    "Video": ["mp4", "mov", "avi", "mkv", "webm"],
    "Font": ["ttf", "otf", "woff", "woff2", "eot"],
    "Document": ["md", "txt", "rst", "pdf", "doc", "docx"],
    "Archive": ["zip", "tar", "gz", "bz2", "xz", "7z", "rar"],
    "Binary": ["exe", "dll", "so", "dylib", "wasm"],
}
MANIFESTS = [
    "package.json",
    "package-lock.json",
    "yarn.lock",
    "Cargo.toml",
    "Cargo.lock",
    "requirements.txt",
    "pyproject.toml",
    "Pipfile",
    "go.mod",
    "go.sum",
    "pom.xml",
    "build.gradle",
    "composer.json",
    "composer.lock",
    "Gemfile",
    "Gemfile.lock",
]
LICENSE_NAMES = ["LICENSE", "LICENCE", "COPYING", "NOTICE"]


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def category(path: Column) -> Column:
    """Licence-like name, then manifest name, then extension."""
    name, ext = file_name(path), extension(path)
    chain = F.when(F.exists(F.array(*(F.lit(n) for n in LICENSE_NAMES)), lambda n: F.upper(name).startswith(n)), "License").when(name.isin(MANIFESTS), "Manifest")
    for kind, names in EXTENSIONS.items():
        chain = chain.when(ext.isin(names), kind)
    return chain.otherwise("Other")


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """One row per file under ``root``: ``path, ext, size, mtime, category, content, text`` (null if not UTF-8)."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    path = F.col("path")
    return raw.select("path", extension(path).alias("ext"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), category(path).alias("category"), "content", text.alias("text"))


def documents_as_files(docs: DataFrame) -> DataFrame:
    """``ord, path, text``: a row per document, in a stable order."""
    return docs.select(F.col("doc_id").alias("ord"), F.concat(F.lit("documents/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text")


def input_kind(target: Column) -> Column:
    """What kind of input a string names; the first rule that holds."""
    ext = extension(target)
    return (
        F.when(target == "-", "Stdin")
        .when(target.rlike("^(npm|pypi|pip|crate|cargo):"), "Package")
        .when(target.rlike("^(crx|chrome|extension):"), "BrowserExtension")
        .when(target.startswith("docker:"), "DockerImage")
        .when(target.rlike(r"^https?://(www\.)?(github|gitlab|bitbucket)\.[a-z]+/[^/]+(/[^/]+)?/?$"), "GitRepo")
        .when(target.rlike(r"^https?://.*\.(zip|gz|tar|js|css|wasm|apk|json)$"), "FileUrl")
        .when(target.rlike("^https?://"), "WebsiteUrl")
        .when(target.startswith("git@") | target.endswith(".git"), "GitRepo")
        .when(ext.isin("apk", "ipa"), "MobileApp")
        .when(ext == "asar", "ElectronApp")
        .when(ext == "wasm", "WasmBinary")
        .when(ext.isin("zip", "tar", "gz", "tgz", "bz2", "xz", "7z", "rar"), "Archive")
        .when(ext.isin("bin", "img", "fw"), "Firmware")
        .otherwise("LocalPath")
    )


def package_spec(spec: Column) -> Column:
    """Struct ``ecosystem, name, version``; the version follows the last @ that is not the first character."""
    head, rest = F.regexp_extract(spec, "^([a-z]+):", 1), F.regexp_replace(spec, "^[a-z]+:", "")
    ecosystem = F.when(head == "npm", "npm").when(head.isin("pypi", "pip"), "pypi").when(head.isin("crate", "cargo"), "crates").when(head.isin("crx", "chrome", "extension"), "crx").when(head.isin("url", "http", "https"), "url")
    has = rest.rlike("^.+@[^@]+$")
    name = F.when(has, F.regexp_extract(rest, "^(.+)@([^@]+)$", 1)).otherwise(rest)
    version = F.when(has, F.regexp_extract(rest, "^(.+)@([^@]+)$", 2))
    return F.struct(ecosystem.alias("ecosystem"), name.alias("name"), version.alias("version"))
