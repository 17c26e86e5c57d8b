"""File and route paths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stem(path: Column, suffix: str = "") -> Column:
    """The file name without its last extension, and without ``suffix`` before it."""
    name = F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)
    return F.regexp_replace(name, f"\\Q{suffix}\\E$", "") if suffix else name


def directory(path: Column) -> Column:
    """The path up to its last slash; none gives an empty text."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def resolve(base: Column, relative: Column) -> Column:
    """A path relative to a directory, without . and .. parts; null where it leaves the root."""
    parts = F.filter(F.split(F.concat_ws("/", base, relative), "/"), lambda x: ~x.isin("", "."))
    step = lambda s, x: F.when(s.isNull(), s).when(x != "..", F.array_append(s, x)).when(F.size(s) > 0, F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def join_route(parent: Column, segment: Column, index: Column) -> Column:
    """The full path of a route from its parent's path and its own segment.

    Without a parent: the segment with a leading slash, or / alone. An index route or one without a segment has its
    parent's path; an absolute segment replaces it; else the two are joined by one slash.
    """
    absolute = segment.startswith("/")
    root = F.when(segment.isNull(), "/").when(absolute, segment).otherwise(F.concat(F.lit("/"), segment))
    return (
        F.when(parent.isNull() | (parent == ""), root)
        .when(index | segment.isNull(), parent)
        .when(absolute, segment)
        .otherwise(F.concat(F.regexp_replace(parent, "/$", ""), F.lit("/"), segment))
    )


def prefixes(value: Column) -> Column:
    """All nonempty prefixes of a text, itself included."""
    return F.transform(F.sequence(F.lit(1), F.length(value)), lambda i: F.substring(value, F.lit(1), i))


def directory_prefixes(value: Column) -> Column:
    """The prefixes of a path that end in a slash."""
    parts = F.split(value, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))
