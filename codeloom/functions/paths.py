"""Expressions on relative paths and repository names."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom import constants as K


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """Suffix of the file name with its dot; a name that only starts with one has none."""
    return F.regexp_extract(file_name(path), r"^\.*[^.].*?(\.[^.]+)$", 1)


def has_suffix(path: Column, suffixes: Iterable[str] = K.SOURCE_SUFFIXES) -> Column:
    """Case-insensitive allow-list; an empty one admits every file."""
    allowed = list(suffixes)
    if not allowed:
        return F.lit(True)
    return F.lower(suffix(path)).isin(allowed)


def in_hidden_folder(path: Column) -> Column:
    """True below a folder whose name starts with a dot. Hidden files are not meant."""
    return F.concat(F.lit("/"), path).rlike(r"/\.[^/]*/")


def language(path: Column) -> Column:
    ext = F.lower(suffix(path))
    out = None
    for name, exts in K.LANGUAGE_SUFFIXES.items():
        hit = ext.isin(list(exts))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(K.OTHER_LANGUAGE)


def _first_role(path: Column, label) -> Column:
    lowered = F.lower(F.coalesce(path, F.lit("")))
    out = None
    for rank, (role, terms) in enumerate(K.ROLE_TERMS):
        hit = None
        for term in terms:
            if any(other != term and other in term for other in terms):
                continue  # a shorter listed term finds it already
            found = lowered.contains(term)
            hit = found if hit is None else hit | found
        value = label(rank, role)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(label(len(K.ROLE_TERMS), K.OTHER_ROLE))


def role(path: Column) -> Column:
    return _first_role(path, lambda rank, name: F.lit(name))


def role_rank(path: Column) -> Column:
    return _first_role(path, lambda rank, name: F.lit(rank))


def collection_name(repo: Column) -> Column:
    return F.concat(F.lit("repo_"), F.lower(repo))


def repo_from_url(url: Column) -> Column:
    """Last path segment of a URL without its suffix."""
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return F.regexp_replace(file_name(path), r"^(\.*[^.].*)\.[^.]*$", "$1")
