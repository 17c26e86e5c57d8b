"""Substring dedup: words inside a long window that an earlier document, or a reference, has are removed.

``remove_reference`` broadcasts suffix automata of a reference's shards and streams the documents along them. Over a
corpus against itself that is every document against every shard, so ``substring_dedup`` finds the same windows by
anchors and hashes instead; the README has the figures.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.llm.automaton import match, without_spans
from graphlens.llm.common import WHITE, cut, fresh_name, mix, text_blocks, window_hashes, word_bounds, word_hashes


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of ``width`` values, by doubling."""
    have = 1
    while 2 * have <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[: len(values) - (width - have)], values[width - have :]) if have < width else values


def _anchors(words: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start word, row, anchor) of every window inside a row: the least hash among the window's half-long runs.

    Equal windows have equal anchors, and neighbouring windows mostly share one.
    """
    half = max(1, window // 2)
    if len(words) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = _sliding_min(window_hashes(words, half), window - half + 1)
    row = np.searchsorted(first, np.arange(len(least)), "right") - 1
    whole = np.flatnonzero(np.arange(len(least)) + window <= first[row + 1])
    return whole, row[whole], least[whole]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _profile(window: int):
    """(id, text_key, body) to (id, text_key, words, seq1, seq2, anchors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, offsets in text_blocks(batch.column(2)):
                starts, stops, first = word_bounds(raw, offsets, WHITE)
                words = word_hashes(raw, starts, stops)
                sequence = []
                for salt in (1, 2):
                    # A row's whole sequence: its words' hashes, each mixed with its place in the row.
                    place = np.arange(len(words)) - np.repeat(first[:-1], np.diff(first))
                    total = np.zeros(len(words) + 1, np.uint64)
                    np.cumsum(mix(words ^ mix(place.astype(np.uint64), salt), salt), out=total[1:])
                    sequence.append(mix(total[first[1:]] - total[first[:-1]], salt))
                _, row, anchor = _anchors(words, first, window)
                new = np.ones(len(row), bool)
                new[1:] = (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1])
                row, anchor = row[new], anchor[new]
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32)), _signed(anchor))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(np.diff(first).astype(np.int64)), _signed(sequence[0]), _signed(sequence[1]), lists],
                    names=["id", "text_key", "words", "seq1", "seq2", "anchors"],
                )

    return run


def _windows(window: int):
    """(id, text_key, body, anchors) to the windows whose anchor is one of these: (w1, w2, id, text_key, start)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marked = batch.column(3)
            for a, b, raw, offsets in text_blocks(batch.column(2)):
                starts, stops, first = word_bounds(raw, offsets, WHITE)
                words = word_hashes(raw, starts, stops)
                start, row, anchor = _anchors(words, first, window)
                part = marked.slice(a, b - a)
                wanted = np.unique(part.flatten().to_numpy(zero_copy_only=False).view(np.uint64))
                keep = np.isin(anchor, wanted)
                start, row = start[keep], row[keep]
                w1, w2 = (window_hashes(words, window, salt)[start] for salt in (1, 2))
                place = pa.array(row + a)
                yield pa.RecordBatch.from_arrays(
                    [_signed(w1), _signed(w2), batch.column(0).take(place), batch.column(1).take(place), pa.array(start - first[row])],
                    names=["w1", "w2", "id", "text_key", "start"],
                )

    return run


def _cut_words(window: int):
    """(id, text_key, body, starts, whole) to (id, n_words, n_removed, kept_text, kept_sha256)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, offsets in text_blocks(batch.column(2)):
                starts, stops, first = word_bounds(raw, offsets, WHITE)
                body = raw.tobytes()
                counts, removed, kept = np.diff(first), [], []
                for k in range(b - a):
                    lo, hi = int(first[k]), int(first[k + 1])
                    windows = batch.column(3)[a + k].values
                    gone = np.zeros(hi - lo + 1, np.int64)
                    if batch.column(4)[a + k].as_py():
                        gone[0] = 1
                    elif windows is not None and len(windows):
                        at = windows.to_numpy()
                        np.add.at(gone, at, 1)
                        np.add.at(gone, at + window, -1)
                    stay = np.flatnonzero(np.cumsum(gone[:-1]) == 0) + lo
                    removed.append(hi - lo - len(stay))
                    kept.append(b" ".join([body[x:y] for x, y in zip(starts[stay].tolist(), stops[stay].tolist(), strict=True)]))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(counts.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in kept])],
                    names=["id", "n_words", "n_removed", "kept_text", "kept_sha256"],
                )

    return run


def substring_dedup(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col``, n_words, n_removed, kept_text (kept words joined by one space), kept_sha256.

    A word goes if a window of ``window`` consecutive words covers it whose word sequence also starts in a document of
    smaller id. Each window's anchor is the least hash of its half-long word runs, so equal windows share an anchor:
    anchors that two documents have pick the windows worth comparing, and those windows' 128-bit hashes, with the
    smallest id for each, decide. Documents of equal word sequence are represented by their smallest id. All groups
    are minima with partial aggregates and joins on hashes; no group of rows is gathered.

    Defined results: null text has no words; fewer words than a window - nothing goes; a null id is no smaller or
    larger than any, so nothing goes from such rows and because of them; rows of equal id do not remove each other's
    words; empty table - no rows. Further columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).withColumn("text_key", F.coalesce(F.xxhash64("body"), F.lit(0).cast("long")))
    rows = rows.select("id", "text_key", "body")
    known = rows.where("id is not null")
    profiles = cut(known.mapInArrow(_profile(window), f"id {kind}, text_key long, words long, seq1 long, seq2 long, anchors array<long>").where(F.col("words") >= window))
    # Joins of groups' minima go by another key than the grouping, so both sides are dealt anew and a hot group can be split.
    first = profiles.groupBy("seq1", "seq2").agg(F.min("id").alias("first_id")).select(F.bitwise_not("seq1").alias("not1"), "seq2", "first_id")
    matched = profiles.withColumn("not1", F.bitwise_not("seq1")).join(first, ["not1", "seq2"])
    copies = matched.where("id > first_id").select("id", "text_key").distinct()
    anchored = matched.where("id = first_id").select("id", "text_key", F.explode("anchors").alias("anchor"))
    shared = anchored.groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select(F.bitwise_not("anchor").alias("not1"))
    marked = anchored.withColumn("not1", F.bitwise_not("anchor")).join(shared, "not1").groupBy("id", "text_key").agg(F.collect_set("anchor").alias("anchors"))
    marked = cut(marked)
    windows = known.join(marked, ["id", "text_key"]).select("id", "text_key", "body", "anchors").mapInArrow(_windows(window), f"w1 long, w2 long, id {kind}, text_key long, start long")
    earliest = windows.groupBy("w1", "w2").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select(F.bitwise_not("w1").alias("not1"), "w2", "low")
    gone = windows.withColumn("not1", F.bitwise_not("w1")).join(earliest, ["not1", "w2"]).where("id > low").groupBy("id", "text_key").agg(F.collect_set("start").alias("starts"), F.lit(False).alias("whole"))
    gone = gone.unionByName(copies.select("id", "text_key", F.array().cast("array<long>").alias("starts"), F.lit(True).alias("whole")))
    body = known.join(gone, ["id", "text_key"], "left").select("id", "text_key", "body", "starts", "whole")
    body = body.unionByName(rows.where("id is null").select("*", F.lit(None).cast("array<long>").alias("starts"), F.lit(None).cast("boolean").alias("whole")))
    out = body.mapInArrow(_cut_words(window), f"id {kind}, n_words long, n_removed long, kept_text string, kept_sha256 string")
    return out.withColumnRenamed("id", id_col)


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a block, unchanged: hashes, starts, ends, first word of each row."""
    starts, stops, first = word_bounds(raw, offsets, WHITE)
    return word_hashes(raw, starts, stops), starts, stops, first


def reference_spans(docs: DataFrame, reference: DataFrame, window: int = 50, text_col: str = "text", reference_col: str = "text", shard_words: int = 1 << 17) -> DataFrame:
    """The documents with reference_spans: the word ranges [a, b) inside windows that a reference text has, with their bytes.

    The reference is dealt into shards of about ``shard_words`` words; tasks build each shard's suffix automaton, one
    broadcast of bounded size, and the documents stream along one shard at a time for their matching statistics.
    Ranges of different shards may overlap. A reference text of fewer words than a window marks nothing.

    Defined results: null texts have no words; equal texts get equal spans; an empty reference marks nothing; empty
    table - no rows.
    """
    long = F.size(F.filter(F.split(reference_col, r"[\x20\x09-\x0D]+"), lambda x: x != "")) >= window
    texts = reference.where(F.col(reference_col).isNotNull() & long).select(F.lit(None).cast("string").alias("id"), F.col(reference_col).alias("body")).distinct()
    out = match(docs, texts, words_of, window, text_col, ("reference_words", "reference_spans", "reference_items"), shard_words)
    return out.select(*docs.columns, F.col(out.columns[-2]).alias(fresh_name(docs, "reference_spans")))


def remove_reference(docs: DataFrame, reference: DataFrame, window: int = 50, text_col: str = "text", **options) -> DataFrame:
    """The documents' own columns, the text without the spans of ``window`` words or more that a reference text has.

    Texts without such a span stay byte for byte, null texts null; the rest is as in ``reference_spans``.

    Defined results: a text that is all span becomes empty; equal texts become equal; white space around a span stays; no
    reference, or one of fewer words than a window only, changes nothing; empty table - no rows.
    """
    out = reference_spans(docs, reference, window, text_col, **options)
    return out.withColumn(text_col, without_spans(F.col(text_col), F.col(out.columns[-1]))).select(*docs.columns)
