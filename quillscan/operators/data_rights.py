"""Data-rights detectors: personal data, secrets, data sets and data licences in text."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound, lines
from ..refdata import DATA_LICENSES, GEODATA, ML_DATASETS, PII_COLUMNS, SECRETS

_ASSIGNED = r"(password|token|secret)\s*[=:]\s*\S"


def has_email(text: Column) -> Column:
    """A letter or digit, @, a letter or digit, and a dot within the next characters."""
    return F.coalesce(text.rlike(r"(?s)[\p{L}\p{N}]@[\p{L}\p{N}].{0,47}\."), F.lit(False))


def has_ipv4(text: Column) -> Column:
    """A run of digits and dots with exactly four numbers up to 255."""
    runs = F.filter(F.split(text, "[^0-9.]+"), lambda r: r.rlike(r"^[0-9]{1,9}(\.[0-9]{1,9}){3}$"))
    return F.coalesce(F.exists(runs, lambda r: F.forall(F.split(r, r"\."), lambda o: o.cast("int") <= 255)), F.lit(False))


def mentions(files: DataFrame, table: list[tuple[str, str]], name: str) -> DataFrame:
    """``ord, path`` and the entry of each table row whose name the lower-cased text holds; the table is fixed."""
    low = F.lower("text")
    found = F.array_compact(F.array(*(F.when(low.contains(n), F.struct(F.lit(n).alias(name), F.lit(v).alias("licence"))) for n, v in table)))
    return files.select("ord", "path", F.explode(found).alias("_m")).select("ord", "path", F.col(f"_m.{name}").alias(name), "_m.licence")


def ml_datasets(files: DataFrame) -> DataFrame:
    return mentions(files, ML_DATASETS, "dataset")


def data_licences(files: DataFrame) -> DataFrame:
    return mentions(files, DATA_LICENSES, "pattern")


def geodata_of(low: Column) -> Column:
    """``provider, licence, attribution`` of the map data that a lower-cased text names, one struct per provider."""
    chains: dict[str, Column] = {}
    for mark, provider, licence, attribution in GEODATA:
        entry = F.struct(F.lit(provider).alias("provider"), F.lit(licence).alias("licence"), F.lit(attribution).alias("attribution"))
        chains[provider] = chains[provider].when(low.contains(mark), entry) if provider in chains else F.when(low.contains(mark), entry)
    return F.array_compact(F.array(*chains.values()))


def geodata(files: DataFrame) -> DataFrame:
    """``ord, path, provider, licence, attribution``: a row per file and provider; no rows for a null text."""
    return files.select("ord", "path", F.explode(geodata_of(F.lower("text"))).alias("_g")).select("ord", "path", "_g.*")


def redacted(line: Column) -> Column:
    """The first eight and, past twenty characters, the last four characters of a trimmed line."""
    value = F.trim(line)
    return F.when(F.length(value) > 20, F.concat(F.left(value, F.lit(8)), F.lit("..."), F.right(value, F.lit(4)))).otherwise(F.concat(F.left(value, F.lit(8)), F.lit("...")))


def holds_secret(text: Column) -> Column:
    """Whether a line can match a secret's pattern, by plain searches first: spares most texts the split into lines."""
    leads = [re.match(r"(?:[\w -]|\\\.)+", p)[0].replace("\\", "") for _, p in SECRETS]
    low = F.lower(text)
    keys = reduce(or_, (text.contains(lead) for lead in leads))
    return keys | (reduce(or_, (low.contains(w) for w in ("password", "token", "secret"))) & low.rlike(_ASSIGNED))


def secrets_of(text: Column) -> Column:
    """``line_no, secret, redacted`` of each line (comments too) and each pattern that it matches, in that order."""

    def of_line(line: Column, no: Column) -> Column:
        kinds = F.array_compact(F.array(*(F.when(line.rlike(p), F.lit(n)) for n, p in SECRETS), F.when(F.lower(line).rlike(_ASSIGNED), F.lit("Assigned secret"))))
        return F.transform(kinds, lambda kind: F.struct((no + 1).cast("long").alias("line_no"), kind.alias("secret"), redacted(line).alias("redacted")))

    # The empty text yields an empty array of the same type.
    return F.flatten(bound(F.when(holds_secret(text), text).otherwise(""), lambda held: F.transform(lines(held), of_line)))


def secret_lines(files: DataFrame) -> DataFrame:
    """``ord, path, line_no, secret, redacted``: lines that match a secret's pattern, a row per pattern, value shortened."""
    held = files.filter(holds_secret(F.col("text")))
    return held.select("ord", "path", F.explode(secrets_of(F.col("text"))).alias("_s")).select("ord", "path", "_s.*")


def pii_of_column(column: Column) -> Column:
    """Kind of personal data that a column name suggests, null if none: equality first, then containment."""
    low = F.lower(column)
    pairs = PII_COLUMNS
    chain = F.when(low == pairs[0][0], F.lit(pairs[0][1]))
    for n, kind in pairs[1:]:
        chain = chain.when(low == n, F.lit(kind))
    for n, kind in pairs:
        chain = chain.when(low.contains(n), F.lit(kind))
    return chain


def header_columns(text: Column, separator: str = ",") -> Column:
    """Column names of a delimited file's first line."""
    return F.transform(F.split(F.element_at(lines(text), 1), separator), lambda c: F.trim(F.replace(c, F.lit('"'), F.lit(""))))
