"""Regular-expression matches with their line numbers, in JVM expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unix_lines(text: Column) -> Column:
    """Line ends as text files are read: \\r\\n and lone \\r become \\n."""
    return F.regexp_replace(text, "\r\n?", "\n")


def line_feeds(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


#: Marks a match's start while lines are counted; a text's own character of this kind counts as another one.
_MARK = "\ue000"


def matches_with_lines(text: Column, pattern: str, groups: int) -> Column:
    """array<struct<line, groups...>>: every match's first line (from 1) and its first groups (g1, g2, ...).

    Each match is marked in a copy of the text; a line's number is then listed once for every mark in it, so the work
    follows the text's length, however many matches it has. ``pattern`` is a Java pattern; it must not match empty text.
    """
    rx = F.lit(pattern)
    parts = [F.regexp_extract_all(text, rx, F.lit(g)) for g in range(1, groups + 1)]
    marked = F.split(F.regexp_replace(F.translate(text, _MARK, "\ue001"), rx, F.lit(_MARK + "$0")), "\n", -1)
    marks = lambda x: F.length(x) - F.length(F.replace(x, F.lit(_MARK), F.lit("")))
    lines = F.flatten(F.transform(marked, lambda x, k: F.array_repeat(k + 1, marks(x))))
    rows = F.arrays_zip(lines.alias("line"), *[p.alias(f"g{k + 1}") for k, p in enumerate(parts)])
    names = ["line", *[f"g{k + 1}" for k in range(groups)]]
    return F.transform(rows, lambda r: F.struct(r[names[0]].cast("long").alias("line"), *[r[n].alias(n) for n in names[1:]]))
