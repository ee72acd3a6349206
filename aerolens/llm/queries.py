"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import centroids, embeddings, fingerprints, html_text, jaccard, language, mixing, packing, personal, secrets, spelling, substrings, token_files

_MODULES = (fingerprints, embeddings, secrets, packing, language, jaccard, substrings, token_files, mixing, html_text, personal, spelling, centroids)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}
