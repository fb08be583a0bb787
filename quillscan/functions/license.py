"""Licence identification as column expressions, built from rule tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..refdata import CHIMERA_SIGNATURES, COPYLEFT, FAMILY_RULES, LICENSE_PHRASES, PERMISSIVE, RESTRICTIVE
from .text import bound, read_through_lookalikes, squeezed


def _first_of(rules: list[tuple[Column, str]], otherwise: Column) -> Column:
    test, name = rules[0]
    chain = F.when(test, F.lit(name))
    for test, name in rules[1:]:
        chain = chain.when(test, F.lit(name))
    return chain.otherwise(otherwise)


def licence_of_text(text: Column) -> Column:
    """Id of the first phrase rule that the normalised text meets, null if none."""

    def ladder(plain: Column) -> Column:
        rules = []
        for name, all_, any_ in LICENSE_PHRASES:
            tests = [plain.contains(p) for p in all_]
            if any_:
                tests.append(reduce(lambda a, b: a | b, (plain.contains(p) for p in any_)))
            rules.append((reduce(lambda a, b: a & b, tests), name))
        return _first_of(rules, F.lit(None).cast("string"))

    return bound(squeezed(read_through_lookalikes(text)), ladder)


def family(licence: Column) -> Column:
    """Licence family of an SPDX id; ``Unknown`` if no rule matches."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.upper(licence), "(-ONLY)+$", ""), "(-OR-LATER)+$", ""), "\\++$", "")

    def ladder(name: Column) -> Column:
        def test(kind: str, value: str) -> Column:
            if kind == "prefix":
                return name.startswith(value)
            if kind == "equal":
                return name == value
            return reduce(lambda a, b: a & b, (name.contains(v) for v in value.split("|")))

        return F.when(name.isNull(), F.lit(None).cast("string")).otherwise(_first_of([(test(k, v), f) for f, k, v in FAMILY_RULES], F.lit("Unknown")))

    return bound(bare, ladder)


def is_copyleft(fam: Column) -> Column:
    return fam.isin(COPYLEFT)


def is_permissive(fam: Column) -> Column:
    return fam.isin(PERMISSIVE)


def is_restrictive(fam: Column) -> Column:
    return fam.isin(RESTRICTIVE)


def families_in_text(text: Column) -> Column:
    """Distinct families whose signature phrases the normalised text holds."""
    found = bound(squeezed(read_through_lookalikes(text)), lambda plain: F.array(*(F.when(plain.contains(p), F.lit(f)) for p, f in CHIMERA_SIGNATURES)))
    return F.array_distinct(F.array_compact(found))


def compatibility(upstream: Column, downstream: Column, commercial: Column, network: Column, static_linking: Column) -> Column:
    """``Compatible``, ``Conditional`` or ``Incompatible`` for an upstream licence inside a downstream one."""
    both = F.struct(family(upstream).alias("up"), family(downstream).alias("down"), F.upper(upstream).alias("u"), F.upper(downstream).alias("d"))
    return bound(both, lambda b: _compatible(b["up"], b["down"], b["u"], b["d"], commercial, network, static_linking))


def _compatible(up: Column, down: Column, u: Column, d: Column, commercial: Column, network: Column, static_linking: Column) -> Column:
    strong = up == "StrongCopyleft"
    yes, maybe, no = F.lit("Compatible"), F.lit("Conditional"), F.lit("Incompatible")
    return (
        F.when((up == "PublicDomain") | (down == "PublicDomain"), yes)
        .when(up.isin("Permissive", "PermissivePatent"), maybe)
        .when(strong & (down == "StrongCopyleft"), F.when(u.contains("GPL-2") & d.contains("GPL-3"), no).otherwise(yes))
        .when(strong & (down == "PermissivePatent"), F.when(u.contains("GPL-2"), no).otherwise(yes))
        .when(strong & (down == "Permissive"), yes)
        .when(strong & (down == "Proprietary"), no)
        .when((up == "NetworkCopyleft") & network, no)
        .when((up == "WeakCopyleft") & static_linking, F.when(u.contains("LGPL"), no).otherwise(maybe))
        .when((up == "CreativeCommonsRestricted") & commercial, no)
        .when(up == "Proprietary", no)
        .otherwise(maybe)
    )
