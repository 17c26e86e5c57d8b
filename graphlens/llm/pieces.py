"""SentencePiece encoding and decoding, with a max-plus parallel scan over the chunks of giant documents."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from sentencepiece import sentencepiece_model_pb2
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.llm.common import arrow_rows, cut, fresh_name, small_batches, with_schema

SPACE = "▁"
#: Stands for a literal U+2581 while a text is encoded, U+2581 itself being a space then; no text can hold a lone surrogate.
LITERAL = "\ud800"
#: Characters of its neighbours that a chunk carries on either side: no piece may be longer.
HALO = 64
#: No piece goes on across the start of one of these: a line feed, a run of spaces with what follows, or other text.
_WORDS = re.compile(rf"[\n{LITERAL}]|{SPACE}+[^{SPACE}{LITERAL}\n]*|[^{SPACE}{LITERAL}\n]+")
NEVER = -1e18
Token = tuple[int, int, int]  # start, end, id; an unknown character's id is -1 - its code point; (b, b, 0) at a word start


def normal(text: str) -> str:
    """A text with its spaces as pieces write them, and each literal U+2581 told apart; of the same length."""
    return text.replace(SPACE, LITERAL).replace(" ", SPACE)


class Vocabulary:
    """The pieces of a SentencePiece model, BPE or unigram, that keeps white space and falls back to bytes.

    ``model`` is the model file's content. Encoding gives the library's ids, but for a literal U+2581, which is encoded
    by its bytes so that decoding gives every text back exactly. The kind is read from the model unless it is given. A
    model of another kind is refused, and one that changes texts before encoding, puts no space before them, has no bytes,
    has user-defined symbols, or pieces that go on over a space or line feed or are longer than a chunk's surroundings.
    """

    def __init__(self, model: bytes, kind: str | None = None, cache: int = 1 << 18):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        kind = kind or kind_of(model)
        probe = "  ﬁ　ＡÅ a\tb "
        if sp.normalize(probe) != SPACE + probe.replace(" ", SPACE):
            raise ValueError("the model normalises texts or puts no space before them; its ids cannot be told from the text as it is")
        self.kind, self.limit = kind, cache
        plain = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in plain}
        self.text = {i: p for p, i in self.ids.items()}
        self.byte_ids = {int(sp.id_to_piece(i)[3:-1], 16): i for i in range(sp.vocab_size()) if sp.is_byte(i)}
        if len(self.byte_ids) < 256:
            raise ValueError("the vocabulary has no bytes to fall back to")
        self.four = {p: i.to_bytes(4, "little") for p, i in self.ids.items()}
        odd = next((p for p in self.ids if _WORDS.findall(p) != [p]), None)
        if odd is not None:
            raise ValueError(f"the vocabulary has the piece {odd!r}, which goes on over a space or line feed; texts are cut there")
        self.longest = max(map(len, self.ids))
        if self.longest > HALO:
            raise ValueError(f"the vocabulary has a piece of {self.longest} characters, more than the {HALO} that a chunk sees of its neighbours")
        self.worst = min(self.score.values()) - 10.0  # of an unknown character, in a unigram model
        self.surface = surfaces(model)
        self.compatible = lru_cache(1 << 18)(self._compatible)
        self.reachable = lru_cache(1 << 16)(lambda piece: self.kind != "bpe" or self.merged(piece) == [piece])
        vocabulary = self

        class Cache(dict):
            """Words in use; when full they become the last generation, from which a word seen again returns."""

            last: dict[str, bytes] = {}

            def __missing__(self, word: str) -> bytes:
                got = self.last.get(word)
                if got is None:
                    got = vocabulary.packed(vocabulary.segment(word))
                if len(self) >= vocabulary.limit:
                    self.last = dict(self)
                    self.clear()
                if len(word) <= 64:
                    self[word] = got
                return got

        self.cache = Cache()

    # --- one word ---------------------------------------------------------------------------------------------------

    def merged(self, word: str) -> list[str]:
        """BPE: the best-scored neighbours join first, the leftmost of equals."""
        parts = list(word)
        if len(parts) > 64:
            return self._merged_long(parts)
        score = self.score.get
        pairs = [score(a + b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs and (best := max(pairs)) > NEVER:
            i = pairs.index(best)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i:
                pairs[i - 1] = score(parts[i - 1] + parts[i], NEVER)
            if i < len(pairs):
                pairs[i] = score(parts[i] + parts[i + 1], NEVER)
        return parts

    def _merged_long(self, parts: list[str]) -> list[str]:
        """The same for long words, with a heap of candidate pairs."""
        n, score = len(parts), self.score.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-s, i, parts[i], parts[i + 1]) for i in range(n - 1) if (s := score(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b or not a:
                continue
            parts[i], parts[j] = a + b, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (s := score(parts[i] + parts[k])) is not None:
                    heapq.heappush(heap, (-s, i, parts[i], parts[k]))
            h = before[i]
            if h >= 0 and (s := score(parts[h] + parts[i])) is not None:
                heapq.heappush(heap, (-s, h, parts[h], parts[i]))
        return [p for p in parts if p]

    def segment(self, word: str) -> list[str]:
        if self.kind == "bpe":
            return self.merged(word)
        nodes = self.run(word, 0, len(word), [(0, 0, 0)])
        return [word[s:e] for s, e, _ in self.path(nodes, [(0, 0, 0)], 0, self.best_end(nodes, len(word)))]

    def packed(self, parts: list[str]) -> bytes:
        try:
            return b"".join([self.four[p] for p in parts])
        except KeyError:  # unknown characters, by their bytes
            return b"".join([self.four.get(p) or b"".join(self.byte_ids[x].to_bytes(4, "little") for x in p.replace(LITERAL, SPACE).encode()) for p in parts])

    # --- max-plus lattice -------------------------------------------------------------------------------------------

    def _compatible(self, a: int, b: int) -> bool:
        """BPE: whether the two pieces' text is encoded as just these two."""
        return a < 0 or b < 0 or self.merged(self.text[a] + self.text[b]) == [self.text[a], self.text[b]]

    def starting(self, text: str, at: int) -> list[Token]:
        """The tokens that may start at a place."""
        found = []
        for end in range(at + 1, min(len(text), at + self.longest) + 1):
            piece = text[at:end]
            i = self.ids.get(piece)
            if i is not None and self.reachable(piece):
                found.append((at, end, i))
        if text[at] not in self.ids:
            found.append((at, at + 1, -1 - ord(text[at])))
        return found

    @staticmethod
    def word_start(text: str, at: int) -> bool:
        """Whether no token can cover both sides of a place, and neither side affects the other."""
        if at <= 0 or at >= len(text):
            return True
        a, b = text[at - 1], text[at]
        return a in ("\n", LITERAL) or b in ("\n", LITERAL) or (b == SPACE and a != SPACE)

    def states(self, text: str, at: int) -> list[Token]:
        """Boundary states: the tokens that may cover the last character before a place; one state at a word start."""
        if self.word_start(text, at):
            return [(at, at, 0)]
        return [t for s in range(max(0, at - self.longest), at) for t in self.starting(text, s) if t[1] >= at]

    def run(self, text: str, lo: int, hi: int, entries: list[Token]) -> dict[int, dict[Token, tuple[np.ndarray, list[Token | None]]]]:
        """Tokens by end, each with its best value from every entry state and the tokens before it on those paths.

        Unigram: a path's value is the sum of its pieces' scores. BPE: it is 0 if all neighbours are compatible, and
        the path is then the only one, and none otherwise. Both add along a path and take the greatest at a join.
        """
        ends: dict[int, dict[Token, tuple[np.ndarray, list]]] = {}
        for k, t in enumerate(entries):
            value = np.full(len(entries), NEVER)
            value[k] = 0.0
            ends.setdefault(t[1], {})[t] = (value, [None] * len(entries))
        for at in range(min(ends, default=hi), hi):
            before = ends.get(at)
            if not before:
                continue
            for t in self.starting(text, at):
                value, back = None, None
                for p, (v, _) in before.items():
                    if self.kind == "bpe":
                        if p[0] != p[1] and not self.word_start(text, at) and not self.compatible(p[2], t[2]):
                            continue
                        w = v
                    else:
                        w = v + (self.score[self.text[t[2]]] if t[2] >= 0 else self.worst)
                    if value is None:
                        value, back = w.copy(), [p if x > NEVER / 2 else None for x in w]
                    else:
                        better = w > value
                        if better.any():
                            value = np.where(better, w, value)
                            back = [p if b else q for b, q in zip(better, back, strict=True)]
                if value is not None and value.max() > NEVER / 2:
                    ends.setdefault(t[1], {})[t] = (value, back)
        return ends

    @staticmethod
    def best_end(ends: dict, at: int, entry: int = 0) -> Token:
        return max(ends[at], key=lambda t: ends[at][t][0][entry])

    @staticmethod
    def path(ends: dict, entries: list[Token], entry: int, last: Token) -> list[Token]:
        """The tokens after an entry state up to the last one."""
        out = []
        t = last
        while t != entries[entry]:
            out.append(t)
            t = ends[t[1]][t][1][entry]
        return out[::-1]

    def transfer(self, text: str, lo: int, hi: int) -> np.ndarray:
        """The max-plus matrix of a chunk: best value from each boundary state before it to each one after it."""
        entries, exits = self.states(text, lo), self.states(text, hi)
        cuts = self._inner(text, lo, hi)
        if cuts:
            head = self.run(text, lo, cuts[0], entries)
            into = np.max([v for v, _ in head.get(cuts[0], {}).values()] or [np.full(len(entries), NEVER)], axis=0)
            tail = self._reach(text, self.run(text, cuts[1], hi, [(cuts[1], cuts[1], 0)]), hi, exits, 1)
            middle = 0.0 if self.kind == "bpe" else sum(self.score.get(p, self.worst) for w in _WORDS.findall(text[cuts[0] : cuts[1]]) for p in self.segment(w))
            return np.maximum(NEVER, into[:, None] + middle + tail[0][None, :])
        return self._reach(text, self.run(text, lo, hi, entries), hi, exits, len(entries))

    def _reach(self, text: str, ends: dict, hi: int, exits: list[Token], rows: int) -> np.ndarray:
        if exits == [(hi, hi, 0)]:
            return np.max([v for v, _ in ends.get(hi, {}).values()] or [np.full(rows, NEVER)], axis=0)[:, None]
        return np.array([ends.get(t[1], {}).get(t, (np.full(rows, NEVER),))[0] for t in exits]).T

    def _inner(self, text: str, lo: int, hi: int) -> tuple[int, int] | None:
        """The first and last word start inside a chunk, its own start included."""
        first = next((i for i in range(lo, hi + 1) if self.word_start(text, i)), None)
        if first is None:
            return None
        return first, next(i for i in range(hi, lo - 1, -1) if self.word_start(text, i))

    def traced(self, text: str, lo: int, hi: int, entry: int, leave: int) -> bytes:
        """The ids of the tokens that start inside a chunk, on the best path between two boundary states.

        Only what lies before the chunk's first word start and behind its last depends on the states; whole words between
        them come from the cache.
        """
        entries, exits = self.states(text, lo), self.states(text, hi)
        ids = lambda path: self.packed([self.text[i] if i >= 0 else chr(-1 - i) for _, _, i in path])
        last = exits[leave]
        cuts = self._inner(text, lo, hi)
        if not cuts:
            return ids(self.path(self.run(text, lo, hi, [entries[entry]]), [entries[entry]], 0, last))
        out = []
        if cuts[0] > lo:
            ends = self.run(text, lo, cuts[0], [entries[entry]])
            out.append(ids(self.path(ends, [entries[entry]], 0, self.best_end(ends, cuts[0]))))
        out += map(self.cache.__getitem__, _WORDS.findall(text[cuts[0] : cuts[1]]))
        if cuts[1] < hi:
            start = (cuts[1], cuts[1], 0)
            ends = self.run(text, cuts[1], hi, [start])
            out.append(ids(self.path(ends, [start], 0, last if last[0] != last[1] else self.best_end(ends, hi))))
        return b"".join(out)

    # --- whole texts ------------------------------------------------------------------------------------------------

    def encode(self, text: str | None) -> bytes:
        """A text's ids as little-endian 32-bit integers."""
        return b"".join(map(self.cache.__getitem__, _WORDS.findall(normal(f" {text}")))) if text else b""

    def encode_in_chunks(self, text: str, chunk: int) -> bytes:
        """The same by the scan, all chunks in one place: transfer matrices, their prefix products, each chunk traced back."""
        text = normal(f" {text}")
        bounds = [(lo, min(len(text), lo + chunk)) for lo in range(0, len(text), chunk)]
        matrices = [self.transfer(text, lo, hi) for lo, hi in bounds]
        enter, leave = chosen(matrices)
        return b"".join([self.traced(text, lo, hi, a, b) for (lo, hi), a, b in zip(bounds, enter, leave, strict=True)])

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD."""
        got = b"".join([self.surface[i] for i in ids])
        return got.removeprefix(b" ").decode("utf-8", "replace")


def kind_of(model: bytes) -> str:
    """bpe or unigram, as a model's own description says; other kinds and user-defined symbols are refused."""
    described = sentencepiece_model_pb2.ModelProto.FromString(model)
    kind = {1: "unigram", 2: "bpe"}.get(described.trainer_spec.model_type)
    if kind is None:
        raise ValueError("the model is neither of BPE nor of unigram kind")
    symbol = next((p.piece for p in described.pieces if p.type == p.USER_DEFINED), None)
    if symbol is not None:
        raise ValueError(f"the vocabulary has the user-defined symbol {symbol!r}, which is taken before all else")
    return kind


@lru_cache(2)
def surfaces(model: bytes) -> list[bytes]:
    """The bytes that each id stands for: all that decoding needs of a model."""
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)

    def of(i: int) -> bytes:
        if sp.is_byte(i):
            return bytes([int(sp.id_to_piece(i)[3:-1], 16)])
        return b"" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else sp.id_to_piece(i).replace(SPACE, " ").encode()

    return [of(i) for i in range(sp.vocab_size())]


def _text(surface: np.ndarray, ids: np.ndarray) -> str:
    return b"".join(surface[ids].tolist()).removeprefix(b" ").decode("utf-8", "replace")


_loaded: dict[tuple[int, str], Vocabulary] = {}


def _vocabulary(model: bytes, kind: str) -> Vocabulary:
    key = (hash(model), kind)
    if key not in _loaded:
        _loaded[key] = Vocabulary(model, kind)
    return _loaded[key]


def scan(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """Prefix products in the max-plus semiring, by pairs: the products of pairs first, then what lies between."""
    if len(matrices) == 1:
        return matrices
    paired = scan([_times(a, b) for a, b in zip(matrices[::2], matrices[1::2], strict=False)])
    out = [matrices[0]]
    for k in range(1, len(matrices)):
        out.append(paired[k // 2] if k % 2 else _times(paired[k // 2 - 1], matrices[k]))
    return out


def chosen(matrices: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """The boundary states of the best path, by which each chunk is entered and left: a scan, then back from the end."""
    sums = scan(matrices)
    leave = [0] * len(matrices)
    for k in range(len(matrices) - 1, 0, -1):
        leave[k - 1] = int(np.argmax(sums[k - 1][0] + matrices[k][:, leave[k]]))
    return [0, *leave[:-1]], leave


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(NEVER, (a[:, :, None] + b[None, :, :]).max(axis=1))


def _chunks(chunk: int):
    """(key, body) to (key, k, context, lo, hi): a chunk of the text, a space before it, with its neighbours' nearest characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, body in zip(batch.column(0), batch.column(1), strict=True):
                text = f" {body.as_py()}"
                for k, lo in enumerate(range(0, len(text), chunk)):
                    hi = min(len(text), lo + chunk)
                    a, b = max(0, lo - HALO), min(len(text), hi + HALO)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([key.as_py()]), pa.array([k], pa.int32()), pa.array([text[a:b]]), pa.array([lo - a], pa.int32()), pa.array([hi - a], pa.int32())],
                        names=["key", "k", "context", "lo", "hi"],
                    )

    return run


def _transfers(model: bytes, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(model, kind)
        for batch in batches:
            rows = batch.to_pylist()
            found = [vocabulary.transfer(normal(r["context"]), r["lo"], r["hi"]) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([m.shape[0] for m in found], pa.int32()), pa.array([m.ravel().tolist() for m in found], pa.list_(pa.float64()))],
                names=["key", "k", "states", "matrix"],
            )

    return run


def _choose(rows: pd.DataFrame) -> pd.DataFrame:
    """One document's matrices, a few numbers per chunk, to the boundary states of its best path."""
    rows = rows.sort_values("k")
    enter, leave = chosen([np.array(m).reshape(s, -1) for m, s in zip(rows["matrix"], rows["states"], strict=True)])
    return pd.DataFrame({"key": rows["key"].to_numpy(), "k": rows["k"].to_numpy(), "enter": enter, "leave": leave})


def _traces(model: bytes, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(model, kind)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                ids = vocabulary.traced(normal(r["context"]), r["lo"], r["hi"], r["enter"], r["leave"])
                out.append(np.frombuffer(ids, np.int32).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int32()))], names=["key", "k", "ids"])

    return run


def encode(docs: DataFrame, model_path: str, name: str = "ids", text_col: str = "text", kind: str | None = None, chunk: int = 1 << 15, decoded: str | None = None, giant: int = 1 << 20) -> DataFrame:
    """The documents with their SentencePiece ids (array<int>); names get underscores where taken.

    ``decoded`` names one more column: the text that the ids give back, decoded by the task that has just encoded it.

    Texts shorter than ``chunk`` characters are a single chunk, whose only states are its two ends: they are traced at
    once, in one pass without a shuffle; words seen before come from a bounded cache. Longer texts are split into
    chunks anywhere, in the task that reads them; the chunks of those of ``giant`` characters or more are dealt to tasks of
    their own. A chunk's state at a boundary is the token that covers the
    character before it; each chunk yields the max-plus matrix from its entry to its exit states, a document's
    matrices are combined by an associative scan, and every chunk is traced back by itself between the chosen states.

    Defined results: null and empty texts have no ids; a literal U+2581 is encoded by its bytes; characters outside the
    vocabulary are encoded by their bytes; equal rows get equal ids; empty table - no rows.
    """
    model = Path(model_path).read_bytes()
    place = docs.columns.index(text_col)
    name = fresh_name(docs, name)
    schema = with_schema(docs, **{name: "array<int>"})
    if decoded:
        decoded = fresh_name(docs.withColumn(name, F.lit(0)), decoded)
        schema = schema.add(decoded, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(model, model_kind)
        surface = np.array(vocabulary.surface, object)
        for batch in small_batches(batches, place):
            packed = [vocabulary.encode(t) if t is None or len(t) < chunk else vocabulary.encode_in_chunks(t, chunk) for t in batch.column(place).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in packed])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), np.int32)))
            back = {decoded: pa.array([_text(surface, np.frombuffer(x, np.int32)) for x in packed], pa.string())} if decoded else {}
            yield arrow_rows(batch, batch.schema, **{name: ids}, **back)

    model_kind = kind or kind_of(model)
    dealt = F.coalesce(F.length(text_col) >= giant, F.lit(False))
    short = docs.where(~dealt).mapInArrow(run, schema)
    long = docs.where(dealt)
    # Giant texts are named by their hash: equal texts share one encoding. They are dealt by it before they are split.
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = long.select(F.sha2(text_col, 256).alias("key"), F.col(text_col).alias("body")).repartition(n, "key").dropDuplicates(["key"])
    pieces = texts.mapInArrow(_chunks(chunk), "key string, k int, context string, lo int, hi int").repartition(n, "key", "k")
    pieces = cut(pieces)
    best = pieces.mapInArrow(_transfers(model, model_kind), "key string, k int, states int, matrix array<double>").groupBy("key").applyInPandas(_choose, "key string, k int, enter int, leave int")
    traced = pieces.join(best, ["key", "k"]).select("key", "k", "context", "lo", "hi", "enter", "leave").mapInArrow(_traces(model, model_kind), "key string, k int, ids array<int>")
    whole = traced.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("ids_"))
    joined = long.join(whole, F.sha2(long[text_col], 256) == whole["key"]).select(*[long[c] for c in docs.columns], whole["ids_"].alias(name))
    return short.union(decode(joined, model_path, decoded, name) if decoded else joined)


def decode(rows: DataFrame, model_path: str, name: str = "decoded", ids_col: str = "ids") -> DataFrame:
    """The rows with the text of their ids (underscores where the name is taken); null or no ids give an empty text."""
    model = Path(model_path).read_bytes()
    name = fresh_name(rows, name)
    place = rows.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        surface = np.array(surfaces(model), object)
        for whole in batches:
            for a in range(0, len(whole), 256):
                batch = whole.slice(a, 256)
                out = [_text(surface, x.values.to_numpy()) if x.is_valid else "" for x in batch.column(place)]
                yield arrow_rows(batch, batch.schema, **{name: pa.array(out, pa.string())})

    return rows.mapInArrow(run, with_schema(rows, **{name: "string"}))
