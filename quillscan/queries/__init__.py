"""Further driver queries with their DuckDB SQL; importing a module registers its queries in the catalog."""

from . import attribution, binaries, bundles, classification, commons, contamination, cross_language, deobfuscation, digests, embeddings, incremental, licences, oracles, packages, selection, sequences, web

__all__ = ["attribution", "binaries", "bundles", "classification", "commons", "contamination", "cross_language", "deobfuscation", "digests", "embeddings", "incremental", "licences", "oracles", "packages", "selection", "sequences", "web"]
