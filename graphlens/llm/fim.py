"""Fill-in-the-middle: a two-state automaton is scanned over chunks in parallel, its composed counts find the cuts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.llm.common import WHITE, arrow_rows, cut, fresh_name, small_batches, text_blocks, with_schema

#: The marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
_P, _S, _M = (m.encode() for m in MARKS)
FIM = "n long, form string, output string, prefix_chars long, middle_chars long"


def transfer(raw: np.ndarray) -> tuple[int, int, int]:
    """What the automaton does along a chunk: (exit state, units that end from state 0, from state 1).

    State 1 is inside a word, state 0 is before one. A unit ends where a white-space byte follows a word, so the count
    depends on the entry state by the chunk's first byte alone, and the exit state on its last byte alone.
    """
    white = WHITE[raw]
    inner = int(np.count_nonzero(white[1:] & ~white[:-1]))
    return int(not white[-1]), inner, inner + int(white[0])


def compose(parts: list[tuple[int, int, int]]) -> tuple[list[int], list[int], int]:
    """Entry state and units ended before each chunk, and the units ended in all, by pairs: the scan is associative."""

    def then(a: tuple, b: tuple) -> tuple:
        # (exits, counts) by entry state: a first, then b from where a ends.
        return tuple(b[0][x] for x in a[0]), tuple(a[1][s] + b[1][a[0][s]] for s in (0, 1))

    def scan(xs: list[tuple]) -> list[tuple]:
        if len(xs) < 2:
            return xs
        paired = scan([then(a, b) for a, b in zip(xs[::2], xs[1::2], strict=False)])
        return [xs[0]] + [paired[k // 2] if k % 2 else then(paired[k // 2 - 1], xs[k]) for k in range(1, len(xs))]

    sums = scan([((x, x), (c0, c1)) for x, c0, c1 in parts])
    return [0, *[s[0][0] for s in sums[:-1]]], [0, *[s[1][0] for s in sums[:-1]]], sums[-1][1][0]


def unit_end(raw: np.ndarray, entry: int, rank: int) -> int:
    """The byte in a chunk at which its ``rank``-th unit (from 1) ends."""
    white = WHITE[raw]
    ends = np.flatnonzero(white & ~np.concatenate([[not entry], white[:-1]]))
    return int(ends[rank - 1])


def draws(doc_id, seed: int) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of a document's id; a null id counts as no digits."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))


def arranged(body: bytes, form: str, a: int, b: int) -> bytes:
    """The output of a text cut at bytes a and b."""
    if form == "psm":
        return _P + body[:a] + _S + body[b:] + _M + body[a:b]
    return _S + body[b:] + _P + body[:a] + _M + body[a:b] if form == "spm" else body


def form_of(body: bytes, h: tuple[int, int, int, int], rate: int, spm: int) -> str:
    if not body or h[2] % 100 >= rate or any(m in body for m in (_P, _S, _M)):
        return "plain"
    return "spm" if h[3] % 100 < spm else "psm"


def _chars(body: bytes) -> int:
    """Code points: bytes that do not go on from the one before."""
    return int(np.count_nonzero(np.frombuffer(body, np.uint8) & 0xC0 != 0x80))


def _columns(rows: list[tuple]) -> list[pa.Array]:
    n, form, output, prefix, middle = zip(*rows, strict=True) if rows else ((),) * 5
    return [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(output, pa.binary()).cast(pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64())]


def _row(body: bytes, n: int, form: str, a: int, b: int) -> tuple:
    if form == "plain":
        return n, form, body, None, None
    return n, form, arranged(body, form, a, b), _chars(body[:a]), _chars(body[a:b])


def _short(id_at: int, text_at: int, names: list[str], seed: int, rate: int, spm: int):
    """Texts of one chunk: its automaton starts in state 0, and the cuts are looked up in it at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text_at):
            out = []
            ids = batch.column(id_at).to_pylist()
            for first, _, raw, offsets in text_blocks(batch.column(text_at)):
                white = WHITE[raw]
                left = np.concatenate([[False], ~white[:-1]]) & white
                left[offsets[:-1][offsets[:-1] < len(raw)]] = False  # a row starts in state 0
                ends = np.flatnonzero(left)
                upto = np.searchsorted(ends, offsets)
                data = raw.tobytes()
                for row in range(len(offsets) - 1):
                    body = data[offsets[row] : offsets[row + 1]]
                    own = ends[upto[row] : upto[row + 1]]
                    n = len(own) + 1 if body else 0
                    h = draws(ids[first + row], seed)
                    form = form_of(body, h, rate, spm)
                    k = sorted((h[0] % (n + 1), h[1] % (n + 1)))
                    a, b = (0 if x == 0 else len(body) if x == n else int(own[x - 1] - offsets[row]) for x in k)
                    out.append(_row(body, n, form, a, b))
            yield arrow_rows(batch, batch.schema, **dict(zip(names, _columns(out), strict=True)))

    return run


def _chunks(chunk: int):
    """(key, body) to (key, k, lo, part): the bytes of each chunk, wherever its ends fall, and where it begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, body in zip(batch.column(0), batch.column(1), strict=True):
                data = memoryview(body.as_buffer())
                for k, lo in enumerate(range(0, len(data), chunk)):
                    yield pa.RecordBatch.from_arrays([pa.array([key.as_py()]), pa.array([k], pa.int32()), pa.array([lo], pa.int64()), pa.array([bytes(data[lo : lo + chunk])], pa.binary())], names=["key", "k", "lo", "part"])

    return run


def _transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [transfer(np.frombuffer(x.as_buffer(), np.uint8)) for x in batch.column("part")]
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("k"), *[pa.array([x[i] for x in got], pa.int64()) for i in range(3)]], names=["key", "k", "leave", "from0", "from1"])


def _composed(rows: pd.DataFrame) -> pd.DataFrame:
    """One text's chunk functions, a few numbers each, to the chunks' entry states and counts before."""
    rows = rows.sort_values("k")
    entry, before, total = compose(list(zip(rows["leave"], rows["from0"], rows["from1"], strict=True)))
    return pd.DataFrame({"key": rows["key"].to_numpy(), "k": rows["k"].to_numpy(), "entry": entry, "before": before, "n": total + 1})


def _selected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, t, part, lo, entry, before) to (key, t, at): the byte of the text at which its t-th unit ends."""
    for batch in batches:
        at = [lo + unit_end(np.frombuffer(part.as_buffer(), np.uint8), entry, t - before) for part, lo, entry, before, t in zip(batch.column("part"), *[batch.column(c).to_pylist() for c in ("lo", "entry", "before", "t")], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("t"), pa.array(at, pa.int64())], names=["key", "t", "at"])


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm: int = 80, chunk: int = 1 << 20, prefix: str = "fim_") -> DataFrame:
    """The documents with ``fim_`` n, form, output, prefix_chars and middle_chars (underscores where names are taken).

    A unit is white space and the word after it, or white space at the text's end; n counts them. Two numbers drawn from
    ``seed`` and id cut the units into prefix, middle and suffix; ``rate`` per cent of the texts are rearranged, ``spm`` per
    cent of those with the suffix first. Texts that are empty or hold a mark stay plain, and then have no lengths.

    A text of fewer than ``chunk`` bytes is one chunk and is done where it is read. A longer one is split into chunks,
    and every chunk yields what the automaton does along it from either state; an associative scan of those functions
    gives each chunk's entry state and the units before it; a cut is then looked up in the one chunk that holds it.
    Equal giant texts are scanned once.

    Defined results: null texts count as empty; a null id draws as the text ``42:``; equal rows get equal results; empty
    table - no rows.
    """
    names = []
    for field in FIM.split(", "):
        names.append(fresh_name(docs, prefix + field.split()[0]))
    kinds = dict(zip(names, [x.split()[1] for x in FIM.split(", ")], strict=True))
    id_at, text_at = docs.columns.index(id_col), docs.columns.index(text_col)
    giant = F.coalesce(F.octet_length(text_col) >= chunk, F.lit(False))
    short = docs.where(~giant).mapInArrow(_short(id_at, text_at, names, seed, rate, spm), with_schema(docs, **kinds))
    key, a_name, b_name, n_name = (fresh_name(docs, x) for x in ("key", "cut_a", "cut_b", "units"))
    long = docs.where(giant).withColumn(key, F.sha2(text_col, 256))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Giant texts are named by their hash and dealt by it before they are split.
    texts = long.select(F.col(key).alias("key"), F.col(text_col).cast("binary").alias("body")).repartition(n, "key").dropDuplicates(["key"])
    parts = cut(texts.mapInArrow(_chunks(chunk), "key string, k int, lo long, part binary").repartition(n, "key", "k"))
    functions = parts.mapInArrow(_transfers, "key string, k int, leave long, from0 long, from1 long")
    index = cut(functions.groupBy("key").applyInPandas(_composed, "key string, k int, entry long, before long, n long"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h = lambda k: F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")
    sizes = index.groupBy(F.col("key").alias(key)).agg(F.first("n").alias(n_name))
    long = long.join(sizes, key)
    x, y = h(0) % (F.col(n_name) + 1), h(1) % (F.col(n_name) + 1)
    long = long.withColumn(a_name, F.least(x, y)).withColumn(b_name, F.greatest(x, y))
    # Selection: the chunk of a text's t-th unit end is the one with fewer before it and as many up to its own end.
    asked = long.select(F.col(key).alias("key"), F.explode(F.array(a_name, b_name)).alias("t"), F.col(n_name).alias("n")).where("t > 0 and t < n").select("key", "t").distinct()
    starts = index.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("before", "k", "entry"))).alias("starts"))
    held = F.element_at(F.filter("starts", lambda s: s["before"] < F.col("t")), -1)
    placed = asked.join(starts, "key").withColumn("c", held).select("key", "t", F.col("c.k").alias("k"), F.col("c.entry").alias("entry"), F.col("c.before").alias("before"))
    cuts = placed.join(parts, ["key", "k"]).select("key", "t", "part", "lo", "entry", "before").mapInArrow(_selected, "key string, t long, at long")
    size = F.octet_length(text_col).cast("long")
    for name in (a_name, b_name):
        at = cuts.select(F.col("key").alias(key), F.col("t").alias(name), F.col("at").alias(name + "_at"))
        long = long.join(at, [key, name], "left").withColumn(name + "_at", F.when(F.col(name) == 0, F.lit(0)).when(F.col(name) == F.col(n_name), size).otherwise(F.col(name + "_at")))
    long = long.select(*docs.columns, n_name, a_name + "_at", b_name + "_at")

    width = len(docs.columns)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text_at):
            out = []
            for doc_id, text, units, a, b in zip(batch.column(id_at).to_pylist(), batch.column(text_at), *[batch.column(width + k).to_pylist() for k in range(3)], strict=True):
                body = text.as_buffer().to_pybytes()
                out.append(_row(body, units, form_of(body, draws(doc_id, seed), rate, spm), a, b))
            own = batch.select(list(range(width)))
            yield arrow_rows(own, own.schema, **dict(zip(names, _columns(out), strict=True)))

    return short.union(long.mapInArrow(build, with_schema(docs, **kinds)))


def restored(output: bytes, form: str) -> bytes:
    """The text that an output was made from."""
    if form == "psm":
        prefix, _, rest = output[len(_P) :].partition(_S)
        suffix, _, middle = rest.partition(_M)
    elif form == "spm":
        suffix, _, rest = output[len(_S) :].partition(_P)
        prefix, _, middle = rest.partition(_M)
    else:
        return output
    return prefix + middle + suffix


def restore(rows: DataFrame, name: str = "restored", output_col: str = "fim_output", form_col: str = "fim_form") -> DataFrame:
    """The rows with the text rebuilt from output and form (underscores where the name is taken); a null output gives an empty text."""
    name = fresh_name(rows, name)
    places = rows.columns.index(output_col), rows.columns.index(form_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, places[0]):
            output = pc.fill_null(batch.column(places[0]).cast(pa.large_binary()), b"")
            got = [restored(x.as_py(), form) for x, form in zip(output, batch.column(places[1]).to_pylist(), strict=True)]
            yield arrow_rows(batch, batch.schema, **{name: pa.array(got, pa.binary()).cast(pa.string())})

    return rows.mapInArrow(run, with_schema(rows, **{name: "string"}))
