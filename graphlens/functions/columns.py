"""Collections and records, null-safe, in a stated order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def collect_distinct(value: Column) -> Column:
    """Aggregate: the distinct values without nulls, sorted; no value gives an empty list."""
    return F.sort_array(F.collect_set(value))


def record_or_null(present: Column, *columns: Column) -> Column:
    """A struct of the columns where ``present`` is not null, else null, so that collections skip absent matches."""
    return F.when(present.isNotNull(), F.struct(*columns))


def contains_text(column: Column, wanted: str) -> Column:
    """Whether a text contains another, whatever the letter case."""
    return F.lower(column).contains(wanted.lower())


def as_text(df: DataFrame, separator: str = ",", but: tuple[str, ...] = ()) -> DataFrame:
    """Lists become one text each: sorted elements, records as fields joined by a bar, nulls empty. Structs likewise. ``but``: columns that stay."""
    return df.select(*[text_of(F.col(f"`{f.name}`"), f.dataType, separator).alias(f.name) if f.name not in but and isinstance(f.dataType, (T.ArrayType, T.StructType)) else F.col(f"`{f.name}`") for f in df.schema.fields])


def text_of(value: Column, kind: T.DataType, separator: str = ",") -> Column:
    """A value as ``as_text`` writes it."""
    if isinstance(kind, T.ArrayType):
        return F.array_join(F.sort_array(F.transform(value, _element(kind.elementType, separator))), separator)
    if isinstance(kind, T.StructType):
        return F.concat_ws("|", *[F.coalesce(text_of(value[f.name], f.dataType, separator), F.lit("")) for f in kind.fields])
    return value.cast("string")


def _element(kind: T.DataType, separator: str):
    return lambda x: text_of(x, kind, separator)
