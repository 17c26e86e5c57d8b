"""Suffix automata of a reference's texts, built in tasks, broadcast block by block, along which documents are streamed."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlens.llm.common import arrow_rows, cut, fresh_name, small_batches, text_blocks, with_schema
from graphlens.llm.sharding import with_prefix

#: Words of a block of bytes with row offsets: hashes, starts, ends, first word of each row.
Split = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
SPANS = "array<struct<a:long,b:long,start:long,stop:long>>"
#: Words of a reference text that are taken together at most; longer texts are parted, every window staying whole.
PIECE = 1 << 12


class SuffixAutomaton:
    """Generalised suffix automaton of named word sequences: every word run of every sequence is a path from the root.

    ``full[v]``: the state that holds the length-``width`` suffix of v's strings, or -1. ``items[v]``: the sequences
    in which that state's width-long run occurs. ``short[v]``: (length, sequence) of whole sequences of fewer words
    that end v's strings.
    """

    def __init__(self, sequences: list[tuple[str, list[int]]], width: int):
        self.width = width
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for _, words in sequences:
            last = 0
            for w in words:
                last = self._extend(last, w)
        order = sorted(range(len(self.link)), key=self.length.__getitem__)
        self.full = [-1] * len(self.link)
        self.items: dict[int, set[str]] = {}
        self.short: list[list[tuple[int, str]]] = [[] for _ in self.link]
        for name, words in sequences:
            v = 0
            for w in words:
                v = self.next[v][w]
            if 0 < len(words) < width:
                self.short[self._holding(v, len(words))].append((len(words), name))
        for v in order[1:]:
            up = self.link[v]
            self.full[v] = v if self.length[up] < width <= self.length[v] else self.full[up]
            self.short[v] = self.short[v] + self.short[up]
        for name, words in sequences:
            v = 0
            for i, w in enumerate(words):
                v = self.next[v][w]
                if i + 1 >= width:
                    self.items.setdefault(self.full[v], set()).add(name)

    def _holding(self, v: int, length: int) -> int:
        while v and self.length[self.link[v]] >= length:
            v = self.link[v]
        return v

    def _extend(self, last: int, w: int) -> int:
        """The state of last's string and w, made where it is missing."""
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, w)
        v = self._state(self.length[last] + 1, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = v
            p = self.link[p]
        if p < 0:
            self.link[v] = 0
        else:
            q = self.next[p][w]
            self.link[v] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, w)
        return v

    def _state(self, length: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(0)
        return len(self.link) - 1

    def _clone(self, p: int, q: int, w: int) -> int:
        c = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[c], self.link[q] = self.link[q], c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def pack(self) -> bytes:
        """The automaton as arrays: transitions, links, lengths, and what its states hold."""
        edges = np.array([(v, w, q) for v, following in enumerate(self.next) for w, q in following.items()], np.int64).reshape(-1, 3)
        short = {v: x for v, x in enumerate(self.short) if x}
        return pickle.dumps((self.width, edges, np.array(self.link, np.int32), np.array(self.length, np.int32), np.array(self.full, np.int32), self.items, short))


class Matcher:
    """A packed automaton to stream words along, with the numbers of its words' hashes."""

    def __init__(self, payload: bytes):
        self.table, packed = pickle.loads(payload)
        self.width, edges, link, length, full, self.items, self.short = pickle.loads(packed)
        self.size = len(self.table) + 1
        self.next = dict(zip((edges[:, 0] * self.size + edges[:, 1]).tolist(), edges[:, 2].tolist(), strict=True))
        self.link, self.length, self.full = link.tolist(), length.tolist(), full.tolist()
        self.least = min([self.width, *(n for x in self.short.values() for n, _ in x)])

    @staticmethod
    def payload(sequences: list[tuple[str, np.ndarray]], width: int) -> bytes:
        table = np.unique(np.concatenate([x for _, x in sequences])) if sequences else np.zeros(0, np.uint64)
        return pickle.dumps((table, SuffixAutomaton([(name, np.searchsorted(table, x).tolist()) for name, x in sequences], width).pack()))

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each word is one of the reference's, and its number."""
        if not len(self.table):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.table, hashes), len(self.table) - 1)
        return self.table[at] == hashes, at

    def stream(self, words: Iterable[int]) -> Iterator[tuple[int, int, int]]:
        """(end, state, length) of the longest match that ends at each word."""
        v = length = 0
        follow, size = self.next.get, self.size
        for i, w in enumerate(words):
            q = follow(v * size + w)
            while q is None and v:
                v = self.link[v]
                length = self.length[v]
                q = follow(v * size + w)
            if q is None:
                v = length = 0
            else:
                v, length = q, length + 1
            yield i, v, length

    def hits(self, words: Iterable[int]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged spans (start, end) of words inside windows that occur, and the sequences they occur in."""
        spans: list[list[int]] = []
        found: set[str] = set()
        states: set[int] = set()
        for i, v, length in self.stream(words):
            size = self.width if length >= self.width else 0
            if size:
                states.add(self.full[v])
            for n, name in self.short.get(v, ()):
                if n <= length:
                    found.add(name)
                    size = max(size, n)
            if size:
                while spans and spans[-1][0] >= i + 1 - size:
                    spans.pop()
                if spans and spans[-1][1] >= i + 1 - size:
                    spans[-1][1] = i + 1
                else:
                    spans.append([i + 1 - size, i + 1])
        for state in states:
            found.update(self.items[state])
        return [(a, b) for a, b in spans], found


def _known_runs(known: np.ndarray, first: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(row, start, end) of runs of at least ``least`` words that the benchmark has, within a row."""
    gap = np.flatnonzero(~known)
    bounds = np.unique(np.concatenate([[-1], gap, first[1:-1] - 0.5, [len(known)]]))
    a = np.floor(bounds[:-1] + 1).astype(np.int64)
    b = np.ceil(bounds[1:]).astype(np.int64)
    long = np.flatnonzero(b - a >= least)
    rows = np.searchsorted(first, a[long], "right") - 1
    return zip(rows.tolist(), a[long].tolist(), b[long].tolist(), strict=True)


def _pieces(split: Split, width: int, piece: int):
    """(id, body) to (id, part, n, words): hashed words, in overlapping parts that have every window whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, _, raw, offsets in text_blocks(batch.column(1)):
                hashes, _, _, first = split(raw, offsets)
                for row in range(len(offsets) - 1):
                    words = hashes[first[row] : first[row + 1]]
                    for part, at in enumerate(range(0, max(1, len(words) - width + 1), max(1, piece - width + 1))):
                        own = words[at : at + piece]
                        if len(own):
                            lists = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), pa.array(own.view(np.int64)))
                            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a + row, 1), pa.array([part], pa.int64()), pa.array([len(own)], pa.int64()), lists], names=["id", "part", "n", "words"])

    return run


def automata(reference: DataFrame, split: Split, width: int, block_words: int, piece: int = PIECE) -> DataFrame:
    """(block, payload): one packed automaton per about ``block_words`` words of the reference (id string, body string).

    Texts are hashed and parted in tasks, dealt into blocks by prefix sums of their words, and a task builds each
    block's automaton; a block has at most ``block_words`` words and one ``piece`` more, however long a text is.
    """
    parts = reference.mapInArrow(_pieces(split, width, piece), "id string, part long, n long, words array<long>")
    parts = parts.withColumn("tie", F.xxhash64("words"))
    placed, _ = with_prefix(parts, ["id", "part", "tie"], ["n"])

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        names = [None if pd.isna(x) else x for x in rows["id"]]
        payload = Matcher.payload([(name, np.asarray(w, np.int64).view(np.uint64)) for name, w in zip(names, rows["words"], strict=True)], width)
        return pd.DataFrame({"block": rows["block"].iloc[:1], "payload": [payload]})

    blocks = placed.select(F.expr(f"cast(before_n div {int(block_words)} as int)").alias("block"), "id", "words")
    return cut(blocks.groupBy("block").applyInPandas(build, "block int, payload binary"))


def _stream(matcher: Broadcast | None, split: Split, text_at: int, names: list[str], hits_only: bool):
    """A mapInArrow function: the rows (or the first column of those with spans) with word count, spans and item ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        along = Matcher(Matcher.payload([], 1) if matcher is None else matcher.value)
        kind = pa.list_(pa.struct([(k, pa.int64()) for k in ("a", "b", "start", "stop")]))
        for batch in small_batches(batches, text_at):
            count, spans, items = [], [], []
            for _, _, raw, offsets in text_blocks(batch.column(text_at)):
                hashes, starts, stops, first = split(raw, offsets)
                count += np.diff(first).tolist()
                known, number = along.numbers(hashes)
                found: dict[int, tuple[list, set]] = {}
                for row, a, b in _known_runs(known, first, along.least) if known.any() else ():
                    runs, ids = along.hits(number[a:b].tolist())
                    if runs:
                        own = found.setdefault(row, ([], set()))
                        own[0].extend((x + a - first[row], y + a - first[row], starts[x + a] - offsets[row], stops[y + a - 1] - offsets[row]) for x, y in runs)
                        own[1].update(ids)
                for row in range(len(offsets) - 1):
                    runs, ids = found.get(row, ([], set()))
                    spans.append([dict(zip(("a", "b", "start", "stop"), map(int, x), strict=True)) for x in runs])
                    items.append(sorted(ids - {None}))
            values = [pa.array(count, pa.int64()), pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))]
            if hits_only:
                hit = pa.array([bool(x) for x in spans], pa.bool_())
                batch, values = batch.select([0]).filter(hit), [x.filter(hit) for x in values]
            yield arrow_rows(batch, batch.schema, **dict(zip(names, values, strict=True)))

    return run


def match(docs: DataFrame, reference: DataFrame, split: Split, width: int, text_col: str, names: tuple[str, str, str], block_words: int) -> DataFrame:
    """The documents with word count, spans and items (``names``; underscores where taken), against reference (id, body).

    A window is ``width`` consecutive words of a reference text, or the whole text if it has fewer. Spans are the word
    ranges [a, b) inside occurrences of windows, with their byte range [start, stop); those of different blocks may
    overlap. The documents stream past the first block's automaton without a shuffle. Every further block
    is a pass of its own over the texts, so that a task holds one automaton at a time; its few hits, one row per
    distinct text, are written, its broadcast is given up, and the hits are joined to the documents by the text's hash.
    """
    names = [fresh_name(docs, c) for c in names]
    count, spans, items = names
    blocks = automata(reference, split, width, block_words)
    numbers = sorted(r.block for r in blocks.select("block").collect())
    context = docs.sparkSession.sparkContext

    def matcher(k: int) -> Broadcast:
        # Bounded by block_words; the first block's and one other exist at a time.
        return context.broadcast(bytes(blocks.where(F.col("block") == k).first().payload))

    schema = with_schema(docs, **{count: "long", spans: SPANS, items: "array<string>"})
    first = matcher(numbers[0]) if numbers else None
    out = docs.mapInArrow(_stream(first, split, docs.columns.index(text_col), names, False), schema)
    if len(numbers) > 1:
        texts = docs.select(F.sha2(text_col, 256).alias("key"), F.col(text_col).alias("body")).where("body is not null")
        found = None
        for k in numbers[1:]:
            sent = matcher(k)
            own = texts.mapInArrow(_stream(sent, split, 1, ["n", "more", "ids"], True), f"key string, n long, more {SPANS}, ids array<string>")
            own = cut(own.groupBy("key").agg(F.first("more").alias("more"), F.first("ids").alias("ids")))
            sent.destroy()  # what it found is written
            found = own if found is None else found.unionByName(own)
        found = cut(found.groupBy("key").agg(F.flatten(F.collect_list("more")).alias("more_"), F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids_")).withColumnRenamed("key", "key_"))
        out = out.join(found, F.sha2(out[text_col], 256) == found["key_"], "left")
        both = {spans: F.when(F.col("key_").isNull(), F.col(spans)).otherwise(F.concat(spans, "more_")), items: F.when(F.col("key_").isNull(), F.col(items)).otherwise(F.array_sort(F.array_union(items, "ids_")))}
        out = out.select(*[both[c].alias(c) if c in both else F.col(c) for c in [*docs.columns, *names]])
    return out


def without_spans(text: Column, spans: Column) -> Column:
    """The text without the bytes of its spans; byte for byte the same if it has none."""
    raw = text.cast("binary")
    state = F.struct(F.lit(0).cast("long").alias("end"), F.array().cast("array<string>").alias("parts"))
    piece = lambda a, b: F.decode(F.substring(raw, (a + 1).cast("int"), F.greatest(F.lit(0), b - a).cast("int")), "UTF-8")
    rest = F.aggregate(
        F.array_sort(spans),
        state,
        lambda s, x: F.struct(F.greatest(s["end"], x["stop"]).alias("end"), F.array_append(s["parts"], piece(s["end"], x["start"])).alias("parts")),
        lambda s: F.concat(F.array_join(s["parts"], ""), piece(s["end"], F.octet_length(raw).cast("long"))),
    )
    return F.when(F.size(spans) > 0, rest).otherwise(text)
