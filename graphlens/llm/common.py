"""Shared helpers: lineage cuts in the shared folder, and vectorised word splitting over Arrow buffers."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes that the vectorised code holds at once; a longer single text is still taken whole.
BLOCK_BYTES = 1 << 19


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that ``spark.checkpoint.dir`` names; where it is unset, one of our own, in local mode only."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="graphlens-checkpoints-")
    context.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the rows are written once to the shared folder and outlive executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(df: DataFrame) -> None:
    """Delete the files of a ``cut`` that nothing will read again."""
    plan = df._jdf.queryExecution().analyzed()
    file = plan.rdd().getCheckpointFile()
    if file.isDefined():
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that the frame does not have yet, in any letter case."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name += "_"
    return name


def with_schema(df: DataFrame, **columns: str) -> T.StructType:
    """The frame's schema and further columns, given as name=type."""
    schema = T.StructType(list(df.schema.fields))
    for name, kind in columns.items():
        schema = schema.add(name, T._parse_datatype_string(kind))
    return schema


def held_out(doc_id):
    """Rows that no label may be learnt from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of at most ``limit`` bytes, or of one row; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(column)
    if not n:
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def small_batches(batches: Iterator[pa.RecordBatch], column: int, limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The rows in batches of at most ``limit`` bytes of a text column, or of one row."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        a = 0
        while a < len(batch):
            b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + limit, "right")))
            yield batch.slice(a, b - a)
            a = b


# --- words of a block -------------------------------------------------------------------------------------------

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base**i modulo 2**64 for i < n, kept between calls."""
    have = _powers.get(str(base))
    if have is None or len(have) < n:
        steps = np.full(max(n, BLOCK_BYTES + (1 << 16)), base, np.uint64)
        steps[0] = 1
        have = _powers[str(base)] = np.cumprod(steps)
    return have[:n]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    """Which byte values separate words."""
    table = np.zeros(256, bool)
    for a, b in ranges:
        table[a : b + 1] = True
    return table


#: Words are runs of anything but the six ASCII white-space characters.
WHITE = separators((0x20, 0x20), (0x09, 0x0D))
#: Words are runs of a-z, 0-9 and all non-ASCII, after lower-casing A-Z.
NOT_ALNUM = separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_bounds(raw: np.ndarray, offsets: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the first word's number of each row (one more at the end)."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = ~sep[raw]
    begins = inside[1:] & ~inside[:-1]
    ends = inside[:-1] & ~inside[1:]
    edges = offsets[1:-1]
    both = edges[inside[edges] & inside[edges + 1]]  # a word never runs on from one row into the next
    begins[both] = True
    ends[both] = True
    starts = np.flatnonzero(begins)
    stops = np.flatnonzero(ends)
    return starts, stops, np.searchsorted(starts, offsets)


def prefix_sums(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """total and back: (total[b] - total[a]) * back[a] is a polynomial hash of bytes a to b, wherever they stand."""
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _power(_ODD, len(raw)), out=total[1:])
    return total, _power(_INVERSE, len(raw) + 1)


def word_hashes(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, by a polynomial prefix sum over the block."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    total, back = prefix_sums(raw)
    return mix((total[stops] - total[starts]) * back[starts] + (stops - starts).astype(np.uint64))


def window_hashes(words: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of ``width`` words of the array (row bounds are the caller's matter)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(mix(words, salt) * _power(_ODD, len(words)), out=total[1:])
    return mix((total[width:] - total[:n]) * _power(_INVERSE, n + 1)[:n], salt)


def arrow_rows(batch: pa.RecordBatch, schema: pa.Schema, **columns) -> pa.RecordBatch:
    """The batch with further columns."""
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=[*batch.schema.names, *columns])
