"""Filters that searches, harvests and hooks share, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FILTERS = ("source", "repo", "feature", "doc_type")


def matches(filters: dict[str, str | None], with_archived: bool = False) -> Column:
    """Equality for each filter given; archived documents are left out unless asked for or a feature is named."""
    out = F.lit(True)
    for name in FILTERS:
        if filters.get(name):
            out &= F.col(name) == filters[name]
    if not with_archived and not filters.get("feature"):
        out &= F.col("status").isNull() | (F.col("status") != "arquivado")
    return out


def coherent(document: str, filters: str) -> Column:
    """Each filter of the struct ``filters`` is empty or equals the column of the struct ``document``."""
    out = F.lit(True)
    for name in FILTERS:
        want = F.coalesce(F.col(f"{filters}.{name}"), F.lit(""))
        out &= (want == "") | F.coalesce(F.col(f"{document}.{name}") == want, F.lit(False))
    return out


def relevant(tokens: Column, text: Column) -> Column:
    """At least two tokens (or the only one), and half of all, occur in the folded text; without tokens, none is relevant."""
    found = F.size(F.filter(tokens, lambda t: F.contains(text, t)))
    n = F.size(tokens)
    return (n > 0) & (found >= F.least(F.lit(2), n)) & (2 * found >= n)


def in_workspace(source: Column, path: Column, repo: Column, prefix: str, repos: list[str], allow: bool, by_path: list[str]) -> Column:
    """Sources that bear paths by their prefix; others by a list of repositories, allowed or denied; no repository, no match."""
    listed = F.lower(repo).isin([r.lower() for r in repos])
    by_repo = F.coalesce(F.nullif(repo, F.lit("")).isNotNull() & (listed if allow else ~listed), F.lit(False))
    return F.when(source.isin(by_path), F.lower(F.replace(path, F.lit("\\"), F.lit("/"))).startswith(prefix.lower())).otherwise(by_repo)


def leaked(path: Column, folders: tuple[str, ...]) -> Column:
    """Paths that lead through a folder which must not be indexed."""
    flat, out = F.replace(path, F.lit("\\"), F.lit("/")), F.lit(False)
    for f in folders:
        out |= flat.contains(f"/{f}/")
    return out
