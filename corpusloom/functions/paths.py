"""Column expressions on '/'-separated relative paths."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom import fixed_values as fv


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-cased suffix of the file name with its dot; '' for none or '.name'."""
    return F.lower(F.regexp_extract(base_name(path), r"(?s)^.+(\.[^.]+)$", 1))


def has_allowed_extension(path: Column, extensions: list[str]) -> Column:
    return extension(path).isin(list(extensions))


def in_excluded_dir(path: Column, names: list[str]) -> Column:
    """True when any directory of the path, at any depth, is in `names`."""
    steps = F.split(path, "/")
    dirs = F.slice(steps, F.lit(1), F.size(steps) - 1)
    return F.arrays_overlap(dirs, F.array(*[F.lit(n) for n in names])) if names else F.lit(False)


def size_in_range(size: Column, max_bytes: int) -> Column:
    return (size > 0) & (size <= max_bytes)


def looks_like_test(path: Column) -> Column:
    lowered = F.lower(path)
    found = F.lit(False)
    for part in fv.TEST_PATH_PARTS:
        found = found | F.contains(lowered, F.lit(part))
    for ending in fv.TEST_PATH_ENDINGS:
        found = found | F.endswith(lowered, F.lit(ending))
    return found


def language(path: Column) -> Column:
    """Language by extension; an unknown extension stands for itself, without dots."""
    known = F.create_map(*[F.lit(v) for v in chain(*fv.LANGUAGE_BY_EXTENSION.items())])
    ext = extension(path)
    return F.coalesce(F.try_element_at(known, ext), F.ltrim(ext, F.lit(".")))


def package(path: Column) -> Column:
    """Dotted directory below the first source-root marker present, else the parent.

    Null for a file directly below the marker or the root.
    """
    derived = _parent(path)
    for marker in reversed(fv.PACKAGE_MARKERS):
        below = F.split(path, marker, 2)[1]
        derived = F.when(
            F.contains(path, F.lit(marker)), F.replace(_parent(below), F.lit("/"), F.lit("."))
        ).otherwise(derived)
    return F.nullif(derived, F.lit(""))


def _parent(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^(.*)/", 1)


def role(path: Column) -> Column:
    """Role of the first hint found anywhere in the path."""
    (needle, name), *others = fv.ROLE_HINTS
    guess = F.when(F.contains(path, F.lit(needle)), F.lit(name))
    for needle, name in others:
        guess = guess.when(F.contains(path, F.lit(needle)), F.lit(name))
    return guess.otherwise(F.lit(fv.DEFAULT_ROLE))


def package_or_root(pkg: Column) -> Column:
    return F.coalesce(F.nullif(pkg, F.lit("")), F.lit(fv.ROOT_PACKAGE))
