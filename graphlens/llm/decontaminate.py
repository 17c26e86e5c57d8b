"""Benchmark decontamination: a suffix automaton of the benchmark's items, along which training words are streamed."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.llm.automaton import match, without_spans
from graphlens.llm.common import LOWER, NOT_ALNUM, fresh_name, word_bounds, word_hashes


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words of a block: hashes, starts, ends, first word of each row."""
    raw = LOWER[raw]
    starts, stops, first = word_bounds(raw, offsets, NOT_ALNUM)
    return word_hashes(raw, starts, stops), starts, stops, first


def match_benchmark(docs: DataFrame, benchmark: DataFrame, width: int = 13, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_words: int = 1 << 17) -> DataFrame:
    """The documents with bench_words, bench_spans and bench_items (names get underscores where taken).

    A window is ``width`` consecutive words of an item, or the whole item if it has fewer; bench_spans are the word
    ranges [a, b) inside occurrences of windows, with their byte range [start, stop); bench_items are the ids of the
    items whose windows occur. The items are dealt into blocks of about ``block_words`` words; tasks build each
    block's automaton, one broadcast of bounded size, and the documents stream past one block at a time.

    Defined results: null or wordless text has no words and no spans, and as an item no window; an item with a null
    id marks spans but is not listed; items with equal text are each listed; items of any length are taken whole; an
    empty benchmark marks nothing; equal texts get equal marks; empty table - no rows.
    """
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("body")).where("body is not null")
    return match(docs, items, words_of, width, text_col, ("bench_words", "bench_spans", "bench_items"), block_words)


def word_total(spans) -> F.Column:
    """Words inside the union of word ranges."""
    ordered = F.array_sort(spans)
    state = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("sum"))
    return F.aggregate(
        ordered,
        state,
        lambda s, x: F.struct(F.greatest(s["end"], x["b"]).alias("end"), (s["sum"] + F.greatest(F.lit(0), x["b"] - F.greatest(s["end"], x["a"]))).alias("sum")),
        lambda s: s["sum"],
    )


def contamination(docs: DataFrame, benchmark: DataFrame, coverage: tuple[int, int] = (1, 20), **options) -> DataFrame:
    """match_benchmark's rows with bench_hit (words inside occurrences) and contaminated (hit words reach the share ``coverage``)."""
    out = match_benchmark(docs, benchmark, **options)
    n_words, spans = out.columns[-3], out.columns[-2]
    hit, bad = fresh_name(docs, "bench_hit"), fresh_name(docs, "contaminated")
    return out.withColumn(hit, word_total(spans)).withColumn(bad, (F.col(hit) > 0) & (F.col(hit) * coverage[1] >= F.col(n_words) * coverage[0]))


def remove_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents' own columns without contaminated documents, and without the marked spans of the others.

    A span at least one window long exceeds the length limit and is cut from the text; a document whose marked
    words reach the coverage limit goes as a whole.

    Defined results: texts without a marked span stay byte for byte, null and empty ones among them; rows equal in the
    text stay or go together; an empty benchmark changes nothing; empty table - no rows.
    """
    out = contamination(docs, benchmark, text_col=text_col, **options)
    spans, bad = out.columns[-4], out.columns[-1]
    return out.where(~F.col(bad)).withColumn(text_col, without_spans(F.col(text_col), F.col(spans))).select(*docs.columns)
