"""Long lists of few values as texts: lists are ranks of a table of texts in order, so that no text is sorted or compared."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Values of the lists that are put together at once: a few dozen megabytes of text.
_AT_ONCE = 1 << 20


def _of_rows(column: pa.ListArray) -> list[np.ndarray]:
    flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def _union(parts: list[np.ndarray], n: int) -> np.ndarray:
    """The distinct numbers, all below n, of some lists."""
    if sum(map(len, parts)) < n // 16:
        return np.unique(np.concatenate([np.empty(0, np.int32), *parts]))
    seen = np.zeros(n, bool)
    for part in parts:
        seen[part] = True
    return np.flatnonzero(seen).astype(np.int32)


def joined_texts(rows: DataFrame, places: str, under: pa.Table, lists: dict[str, tuple[str, tuple[str, ...]]], texts: dict[str, pa.Table], separator: str = ",") -> DataFrame:
    """Rows with their lists as texts, sorted and joined; the columns that lists are made from go.

    ``lists``: by name, a kind and the lists that one is made of, each distinct in itself: a column of ranks, or a column of
    ``under`` (place, lists of ranks), of which a row has all that stands at its ``places``. ``texts``: by kind (code, value), the
    text of each rank. Both tables are sent to every executor once; a row is short before and long behind, and never shuffled then.
    """
    made = {places} | {k for _, parts in lists.values() for k in parts}
    kept = [f for f in rows.schema.fields if f.name not in made]
    schema = T.StructType([*kept, *[T.StructField(name, T.StringType()) for name in lists]])
    tables = rows.sparkSession.sparkContext.broadcast((under.sort_by("place").combine_chunks(), {k: t.sort_by("code")["value"].combine_chunks() for k, t in texts.items()}))

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below, values = tables.value
        below = {c: _of_rows(below[c].combine_chunks()) if len(below) else [] for c in below.column_names if c != "place"}
        for batch in batches:
            columns = {k: _of_rows(batch[k]) for k in made if k not in below}
            begin, size, ranks = 0, 0, {name: [] for name in lists}
            for i in range(len(batch)):
                for name, (kind, parts) in lists.items():
                    own = [_union([below[k][p] for p in columns[places][i]], len(values[kind])) if k in below else columns[k][i] for k in parts]
                    ranks[name].append(np.sort(np.concatenate(own)))
                    size += len(ranks[name][-1])
                if size >= _AT_ONCE or i == len(batch) - 1:
                    done = []
                    for name, (kind, _) in lists.items():
                        ends = pa.array(np.cumsum([0, *map(len, ranks[name])]), pa.int32())
                        done.append(pc.binary_join(pa.ListArray.from_arrays(ends, values[kind].take(pa.array(np.concatenate(ranks[name])))), separator))
                    part = batch.slice(begin, i + 1 - begin)
                    yield pa.RecordBatch.from_arrays([*[part[f.name] for f in kept], *done], names=schema.names)
                    begin, size, ranks = i + 1, 0, {name: [] for name in lists}

    return rows.mapInArrow(put_together, schema)
