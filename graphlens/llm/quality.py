"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated by temperature."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.llm.common import cut, held_out, mix, text_blocks, word_hashes

#: Classes of bytes: white space and control, word (letters, digits, all non-ASCII), punctuation.
_CLASS = np.full(256, 2, np.uint8)
_CLASS[:33] = 0
_CLASS[127] = 0
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _CLASS[_a:_b] = 1
_UPPER, _DIGIT = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT[48:58] = True
SHAPES = 64


@dataclass(frozen=True)
class Space:
    """Sizes of the random-indexing space: hashed words, dimensions, nonzero entries of an index vector."""

    words: int = 1 << 14
    dims: int = 32
    nonzero: int = 2

    @property
    def rows(self) -> int:
        return self.words + SHAPES

    def index_vectors(self) -> tuple[np.ndarray, np.ndarray]:
        """Dimensions and signs of every row's sparse ternary index vector."""
        ids = np.arange(self.rows, dtype=np.uint64)
        drawn = [mix(ids, k + 1) for k in range(self.nonzero)]
        return np.array([x % np.uint64(self.dims) for x in drawn], np.int64), np.array([1 - 2 * ((x >> np.uint64(40)) & np.uint64(1)).astype(np.int64) for x in drawn])


def tokens(raw: np.ndarray, offsets: np.ndarray, space: Space) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word numbers, shape numbers and the first token of each row; a token is a run of word or of punctuation bytes."""
    kind = _CLASS[raw]
    change = np.ones(len(raw), bool)
    change[1:] = kind[1:] != kind[:-1]
    change[offsets[:-1][offsets[:-1] < len(raw)]] = True
    begins = np.flatnonzero(change)
    stops = np.append(begins[1:], len(raw))
    real = kind[begins] > 0
    starts, stops = begins[real], stops[real]
    words = (word_hashes(raw, starts, stops) % np.uint64(space.words)).astype(np.int64)
    size = stops - starts
    count = lambda flags: np.diff(np.append(0, np.cumsum(flags, dtype=np.int64))[np.stack([starts, stops])], axis=0)[0]
    upper, digit = count(_UPPER[raw]), count(_DIGIT[raw])
    punct = kind[starts] == 2
    case = np.where(upper == 0, 0, np.where(2 * upper > size, 3, np.where(_UPPER[raw[starts]], 1, 2)))
    length = np.minimum(7, np.where(punct, size, size // 3))
    shape = punct * 32 + np.where(punct, 0, case * 8) + length
    shape = np.where(~punct & (digit > 0), 40 + np.minimum(7, digit), shape)
    return words, space.words + np.minimum(shape, SHAPES - 1), np.searchsorted(starts, offsets)


def _contexts(space: Space, blocks: int):
    """Context counts of all words over a task's texts, as one row per block of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dims, signs = space.index_vectors()
        total = np.zeros(space.rows * space.dims, np.float64)
        for batch in batches:
            for _, _, raw, offsets in text_blocks(batch.column(0), 1 << 21):  # large: each block adds whole tables
                words, shapes, first = tokens(raw, offsets, space)
                if len(words) < 2:
                    continue
                together = np.ones(len(words) - 1, bool)
                together[first[1:-1][(first[1:-1] > 0) & (first[1:-1] < len(words))] - 1] = False
                left, right = np.flatnonzero(together), np.flatnonzero(together) + 1
                for here, near in ((left, right), (right, left)):
                    for beside in (words[near], shapes[near]):
                        for d, s in zip(dims, signs, strict=True):
                            column, weight = d[beside], s[beside]
                            for centre in (words, shapes):
                                total += np.bincount(centre[here] * space.dims + column, weight, len(total))
        parts = np.array_split(total.astype(np.int64), blocks)
        yield pa.RecordBatch.from_arrays([pa.array(range(blocks), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], names=["block", "counts"])

    return run


def _add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of each block, one payload at a time."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            counts = np.frombuffer(payload.as_buffer(), np.int64)
            sums[block] = sums[block] + counts if block in sums else counts.copy()
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["block", "counts"])


def word_vectors(docs: DataFrame, text_col: str = "text", space: Space = Space(), blocks: int = 16) -> np.ndarray:  # noqa: B008
    """Random-indexing vectors from all texts: a word's vector sums the index vectors of its neighbours.

    Words are hashed into a fixed number of rows, so the model's size does not grow with the data. Each task sums its
    own texts; the sums are added block by block in two rounds, and one fixed-size table reaches the driver.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = "block int, counts binary"
    sums = docs.select(text_col).mapInArrow(_contexts(space, blocks), kind)
    sums = sums.withColumn("salt", F.spark_partition_id() % 16).repartition(n, "block", "salt").select("block", "counts").mapInArrow(_add_blocks, kind)
    sums = sums.repartition(blocks, "block").mapInArrow(_add_blocks, kind)
    got = {r.block: np.frombuffer(r.counts, np.int64) for r in sums.collect()}
    table = np.concatenate([got[k] for k in range(blocks)]) if got else np.zeros(space.rows * space.dims, np.int64)
    table = table.reshape(space.rows, space.dims).astype(np.float64)
    table /= np.maximum(1e-9, np.linalg.norm(table, axis=1, keepdims=True))
    return table.astype(np.float32)


def _pool(table: np.ndarray, space: Space):
    """(id, body) to (id, vector): mean word vector, mean shape vector, share of each shape, log of the token count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = []
            for _, _, raw, offsets in text_blocks(batch.column(1)):
                words, shapes, first = tokens(raw, offsets, space)
                rows, counts = len(offsets) - 1, np.diff(first)
                out = np.zeros((rows, 2 * space.dims + SHAPES + 1), np.float64)
                full = np.flatnonzero(counts)
                if len(full):
                    for k, ids in enumerate((words, shapes)):
                        out[full, k * space.dims : (k + 1) * space.dims] = np.add.reduceat(table[ids], first[:-1][full], axis=0) / counts[full, None]
                    owner = np.repeat(np.arange(rows), counts)
                    share = np.bincount(owner * SHAPES + shapes - space.words, minlength=rows * SHAPES).reshape(rows, SHAPES)
                    out[:, 2 * space.dims : -1] = np.sqrt(share / np.maximum(1, counts)[:, None])
                out[:, -1] = np.log1p(counts)
                vectors.append(out.astype(np.float32))
            every = np.concatenate(vectors) if vectors else np.zeros((0, 1), np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in every], pa.binary())], names=["id", "vector"])

    return run


class Network:
    """Two-layer network for a probability, trained by Adam with early stopping and calibrated by a temperature.

    ``shift`` is added to the calibrated logits: the log odds of all rows less those of the rows drawn for training.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, seed: int = 1, decay: float = 1e-4, shift: float = 0.0):
        rng = np.random.default_rng(seed)
        self.shift = shift
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        x = self._standard(x)
        order = rng.permutation(len(x))
        hold = order[: max(1, len(x) // 5)] if len(x) > 20 else order
        fit = order[len(hold) :] if len(x) > 20 else order
        shape = (x.shape[1], hidden)
        self.weights = [rng.normal(0, shape[0] ** -0.5, shape), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.array(0.0)]
        first, second = [np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights]
        best, step = (np.inf, self.weights), 0
        for _ in range(epochs):
            for batch in np.array_split(rng.permutation(fit), max(1, len(fit) // 128)):
                step += 1
                a = np.tanh(x[batch] @ self.weights[0] + self.weights[1])
                error = (_sigmoid(a @ self.weights[2] + self.weights[3]) - y[batch]) / len(batch)
                back = np.outer(error, self.weights[2]) * (1 - a * a)
                slopes = [x[batch].T @ back + decay * self.weights[0], back.sum(axis=0), a.T @ error + decay * self.weights[2], error.sum()]
                for k, g in enumerate(slopes):
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.weights[k] = self.weights[k] - 3e-3 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
            loss = _loss(self._logits(x[hold]), y[hold])
            if loss < best[0]:
                best = (loss, [w.copy() for w in self.weights])
        self.weights = best[1]
        z = self._logits(x[hold])
        self.temperature = min(np.geomspace(0.25, 8, 60), key=lambda t: _loss(z / t, y[hold]))

    def _standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def _logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.weights[0] + self.weights[1]) @ self.weights[2] + self.weights[3]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self._logits(self._standard(x)) / self.temperature + self.shift)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(z / 2))


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def learnable(labels: DataFrame, label: str, id_col: str) -> DataFrame:
    """(id, label): one row per id that may be learnt from.

    An id with several labels counts as its largest. Null ids and null labels are left out.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    return known.groupBy(F.col(id_col).alias("id")).agg((F.max(label) > 0).cast("int").alias("label"))


def labelled_sample(labels: DataFrame, label: str, id_col: str, limit: int) -> DataFrame:
    """(id, label): at most ``limit`` ids of each label that may be learnt from, by a hash of the id."""
    known = learnable(labels, label, id_col)
    one = lambda k: known.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id").limit(limit)
    return one(0).unionByName(one(1))


def one_text_each(rows: DataFrame, chosen: DataFrame, value: str) -> DataFrame:
    """(id, label, value) of the chosen ids: one row per id however many rows have it, with their smallest value."""
    # Broadcast: as many ids and labels as the sample has.
    found = rows.join(F.broadcast(chosen), "id")
    return found.groupBy("id", "label").agg(F.min(value).alias(value))


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, sample: int = 8000, space: Space = Space()) -> DataFrame:  # noqa: B008
    """One row per document: ``id_col``, held_out, score (probability of label 1), predicted (1 if score >= ``threshold``).

    The word vectors come from all texts, the network from at most ``sample`` labelled rows of each label, none of them
    held out (crc32 of the id as text, modulo 4, is 2). The prior is that of all learnable ids, however few
    are drawn of a label. Only the text is an input of the score.

    Defined results: null and empty texts have the zero vector and get a score too; with no labels, or one kind only,
    the score is 0.5 or that label's value for all; an id with several labels counts as its largest, and of several
    vectors of one labelled id one is learnt from; a null id is not held out and teaches nothing; empty table - no rows.
    """
    table = word_vectors(docs, text_col, space)
    kind = docs.schema[id_col].dataType.simpleString()
    pooled = cut(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).mapInArrow(_pool(table, space), f"id {kind}, vector binary"))
    chosen = labelled_sample(labels, label, id_col, sample)
    # At most 2 * sample rows.
    train = one_text_each(pooled, chosen, "vector").orderBy("id").select("label", "vector").toPandas()
    x = np.array([np.frombuffer(v, np.float32) for v in train["vector"]], np.float64)
    y = train["label"].to_numpy(float)
    network = None
    if len(set(y)) == 2:
        # The sample may favour the rarer label; the network's prior is set back to that of all labelled rows.
        every = {r[0]: r[1] for r in learnable(labels, label, id_col).groupBy("label").count().collect()}
        undrawn = {k: np.log(n / min(n, sample)) for k, n in every.items()}
        network = Network(x, y, shift=undrawn[1] - undrawn[0])
    constant = float(y[0]) if len(y) else 0.5

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([np.frombuffer(v.as_buffer(), np.float32) for v in batch.column(1)], np.float64)
            got = network.probability(rows) if network is not None and len(rows) else np.full(len(rows), constant)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64())], names=["id", "score"])

    scored = pooled.mapInArrow(score, f"id {kind}, score double")
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
