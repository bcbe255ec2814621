"""Canonical forms of the names that records spell in several ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_repo(col: Column | str) -> Column:
    """``owner___repo`` in lower case from any spelling of a repository.

    Handles blanks, letter case, ``owner/repo``, web addresses, scp-like
    addresses, a trailing slash and a trailing ``.git``.  Null, blank and values
    with an empty owner or repository give null.
    """
    c = F.col(col) if isinstance(col, str) else col
    s = F.regexp_replace(F.lower(c), r"(?U)\s+", "")
    s = F.regexp_replace(s, r"^(?:[a-z][a-z0-9+.-]*://[^/]+/|[^@/:]+@[^:/]+:)", "")
    s = F.regexp_replace(s, r"/+$", "")
    s = F.regexp_replace(s, r"\.git$", "")
    s = F.regexp_replace(s, r"^((?:(?!___)[^/])+)/(.+)$", "$1___$2")
    return F.nullif(F.regexp_extract(s, r"^.+?___.+$", 0), F.lit(""))


def repo_owner(canonical: Column | str) -> Column:
    """The owner of a canonical repository name; null stays null."""
    c = F.col(canonical) if isinstance(canonical, str) else canonical
    return F.substring_index(c, "___", 1)


def base_idx(col: Column | str) -> Column:
    """The number before the first underscore, without blanks and leading zeros.

    A blank value gives null, a value of zeros gives ``0``.
    """
    c = F.col(col) if isinstance(col, str) else col
    s = F.regexp_replace(F.substring_index(c, "_", 1), r"(?U)^\s+|\s+$", "")
    s = F.regexp_replace(s, r"^0+(?=.)", "")
    return F.when(s != "", s)


def canonical_label(col: Column | str) -> Column:
    """Lower case, blanks trimmed, hyphens and blanks as underscores; blank gives null."""
    c = F.col(col) if isinstance(col, str) else col
    s = F.regexp_replace(F.lower(c), r"(?U)^\s+|\s+$", "")
    s = F.regexp_replace(s, r"[\s-]+", "_")
    return F.when(s != "", s)
