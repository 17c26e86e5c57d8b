"""Near-duplicate vectors by a subspace pigeonhole join: of two close vectors, some block of coordinates is closer still."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlens.llm.common import cut
from graphlens.llm.components import connected_components

#: Of what rounding may add to a squared distance.
SLACK = 1e-9
_PAIRS = 1 << 21  # distances that a task holds at once
_CANDIDATES = 1 << 15  # of which so many are looked at more closely at once
#: Stands for a block where all pairs of a dense group and its neighbours are compared.
GROUP = -1


def unpacked(packed: list[bytes], dim: int) -> np.ndarray:
    """Rows of float64 from the bytes of vectors of one length."""
    return np.frombuffer(b"".join(packed), np.float64).reshape(len(packed), dim) if len(packed) and len(packed[0]) == 8 * dim else np.frombuffer(b"".join(packed), np.float32).astype(np.float64).reshape(len(packed), dim)


def units(rows: np.ndarray) -> np.ndarray:
    """The rows at length one; scaled first, so that squares neither overflow nor vanish."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def rotated(rows: np.ndarray, seed: int) -> np.ndarray:
    """A random rotation: signs and Hadamard butterflies, twice, of rows filled up with zeros to a power of two.

    Only element-wise steps, so that a vector's coordinates are the same bits whatever rows stand beside it.
    """
    dim = max(8, 1 << (rows.shape[1] - 1).bit_length())
    out = np.zeros((len(rows), dim))
    out[:, : rows.shape[1]] = rows
    for k in (0, 1):
        out *= np.random.default_rng([seed, k, dim]).choice([-1.0, 1.0], dim)
        half = 1
        while half < dim:
            pair = out.reshape(len(rows), -1, 2, half)
            out = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], axis=2).reshape(len(rows), dim)
            half *= 2
        out /= math.sqrt(dim)
    return out


@dataclass(frozen=True)
class Plan:
    """How a range join parts a block's space: cut points along its first coordinates, and the squared distance allowed."""

    cosine: float
    width: int  # coordinates of a block
    bits: int  # two to the power of bits cells in each block
    seed: int = 7

    def __post_init__(self):
        if self.width not in (1, 2, 4, 8) or not 0 <= self.bits <= 2 * self.width or not 0 < self.cosine < 1:
            raise ValueError("a block has 1, 2, 4 or 8 coordinates, each cut in 4 at most; the cosine is above 0 and below 1")

    def blocks(self, dim: int) -> int:
        return dim // self.width

    def budget(self, dim: int) -> float:
        """Of two vectors within the whole squared distance, some block is within its share."""
        return (2.0 - 2.0 * self.cosine) / self.blocks(dim) + SLACK

    def edges(self, axis: int, dim: int) -> np.ndarray:
        """Cut points along a block's coordinate: at the normal distribution's quantiles, which rotation brings about.

        Where coordinates lie otherwise, cells are uneven, but no pair is missed.
        """
        own = self.bits // self.width + (axis < self.bits % self.width)
        normal = {0: [], 1: [0.0], 2: [-0.6745, 0.0, 0.6745]}
        return np.array(normal[min(own, 2)]) / math.sqrt(dim)

    def cells(self, part: np.ndarray, dim: int, probe: bool) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of the cells that rows lie in, or of all that a ball of the budget around them meets, own cells first."""
        row, code = np.arange(len(part)), np.zeros(len(part), np.int64)
        cost, moved = np.zeros(len(part)), np.zeros(len(part), bool)
        for axis in range(self.width):
            edges = self.edges(axis, dim)
            if not len(edges):
                continue
            x = part[row, axis]
            own = np.searchsorted(edges, x, "right")
            code = code * (len(edges) + 1)
            if not probe:
                code = code + own
                continue
            low, high = np.append(-np.inf, edges), np.append(edges, np.inf)
            away = np.maximum(0.0, np.maximum(low[None] - x[:, None], x[:, None] - high[None])) ** 2 + cost[:, None]
            where, to = np.nonzero(away <= self.budget(dim))
            moved = moved[where] | (own[where] != to)
            row, code, cost = row[where], code[where] + to, away[where, to]
        if probe:
            order = np.argsort(moved, kind="stable")
            row, code = row[order], code[order]
        return row, code


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, vector) to (id, label, packed): the vector's bytes; null where it can link with nothing."""
    for batch in batches:
        column = batch.column(2)
        kind = np.float32 if pa.types.is_float32(column.type.value_type) else np.float64
        out = []
        for x in column:
            values = x.values
            if values is None or not len(values) or values.null_count:
                out.append(None)
                continue
            v = values.to_numpy().astype(kind)
            out.append(v.tobytes() if np.isfinite(v).all() and v.any() else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["id", "label", "packed"])


def _by_size(batch: pa.RecordBatch, at: int) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """(row numbers, packed vectors) of the batch's rows of each length."""
    packed = batch.column(at).to_pylist()
    sizes = np.array([len(x) for x in packed])
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, [packed[i] for i in rows]


def _filed(plan: Plan, item: int, own_only: bool):
    """(node, label, packed, weight, grouped) to rows per block and cell; grouped vectors only look up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), 4096):
                batch = whole.slice(start, 4096)
                for rows, packed in _by_size(batch, 2):
                    dim = len(packed[0]) // item
                    turned = rotated(units(unpacked(packed, dim)), plan.seed)
                    grouped = batch.column(4).to_numpy(zero_copy_only=False)[rows]
                    for b in range(plan.blocks(turned.shape[1])):
                        part = turned[:, b * plan.width : (b + 1) * plan.width]
                        at, cell = plan.cells(part, turned.shape[1], not own_only)
                        # 0: filed in this cell, and looks up there; 1: looks up only.
                        _, home = plan.cells(part, turned.shape[1], False)
                        probe = (cell != home[at]) | grouped[at]
                        if own_only:
                            at, cell, probe = at[~probe], cell[~probe], probe[~probe]
                        take = pa.array(rows[at])
                        columns = [batch.column(1).take(take), pa.array(np.full(len(at), dim, np.int32)), pa.array(np.full(len(at), b, np.int32)), pa.array(cell), pa.array(probe.astype(np.int32))]
                        if own_only:
                            yield pa.RecordBatch.from_arrays(columns[:4], names=["label", "dim", "block", "cell"])
                        else:
                            yield pa.RecordBatch.from_arrays([*columns, batch.column(0).take(take), batch.column(3).take(take), batch.column(2).take(take)], names=["label", "dim", "block", "cell", "probe", "node", "weight", "packed"])

    return run


class Cell:
    """The vectors filed in one cell, to which those that look up are compared; links are counted and spanned, never listed."""

    def __init__(self, plan: Plan, dim: int, block: int, rows: list[tuple[np.ndarray, np.ndarray, list[bytes]]]):
        self.plan, self.dim, self.block = plan, dim, block
        self.node = np.concatenate([r[0] for r in rows])
        self.weight = np.concatenate([r[1] for r in rows])
        self.unit = units(unpacked([x for r in rows for x in r[2]], dim))
        self.turned = rotated(self.unit, plan.seed)
        self.group = np.arange(len(self.node))

    def _root(self, x: int) -> int:
        while self.group[x] != x:
            self.group[x] = x = self.group[self.group[x]]
        return x

    def look_up(self, node: np.ndarray, packed: list[bytes]) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """(weight of the vectors linked to each, links that join what the new links join).

        A pair counts in the first block that is within its share, so it counts once, whatever blocks it meets in.
        """
        plan, budget, width = self.plan, self.plan.budget(self.turned.shape[1]), self.plan.width
        unit = units(unpacked(packed, self.dim))
        turned = rotated(unit, plan.seed)
        counts, links = np.zeros(len(node), np.int64), []
        if self.block == GROUP:
            return self._whole(node, unit)
        block = slice(self.block * width, (self.block + 1) * width)
        here = self.turned[:, block]
        squares = (here * here).sum(axis=1)
        step = max(1, _PAIRS // len(self.node))
        for a in range(0, len(node), step):
            mine = turned[a : a + step]
            rough = (mine[:, block] ** 2).sum(axis=1)[:, None] + squares[None] - 2.0 * (mine[:, block] @ here.T)
            i, j = np.nonzero(rough <= budget + SLACK)
            for lo in range(0, len(i), _CANDIDATES):
                x, y = i[lo : lo + _CANDIDATES], j[lo : lo + _CANDIDATES]
                apart = ((mine[x, : block.stop] - self.turned[y, : block.stop]) ** 2).reshape(len(x), -1, width).sum(axis=2) <= budget
                ok = apart[:, -1] & ~apart[:, :-1].any(axis=1) & (node[a + x] != self.node[y])
                x, y = x[ok], y[ok]
                ok = (unit[a + x] * self.unit[y]).sum(axis=1) >= plan.cosine
                x, y = x[ok], y[ok]
                if len(x):
                    np.add.at(counts, a + x, self.weight[y])
                    links += self._spanned(node[a + x], x, y)
        return counts, links

    def _whole(self, node: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """The same for a dense group's vectors, which are linked with each other already: all pairs are compared."""
        counts, links = np.zeros(len(node), np.int64), []
        step = max(1, _PAIRS // len(self.node))
        for a in range(0, len(node), step):
            rough = unit[a : a + step] @ self.unit.T
            sure = rough >= self.plan.cosine + SLACK
            i, j = np.nonzero(~sure & (rough >= self.plan.cosine - SLACK))
            sure[i, j] = (unit[a + i] * self.unit[j]).sum(axis=1) >= self.plan.cosine
            counts[a : a + step] = (sure * self.weight).sum(axis=1)
            some = np.flatnonzero(sure.any(axis=1))
            links += zip(node[a + some].tolist(), self.node[sure[some].argmax(axis=1)].tolist(), strict=True)
        return counts, links

    def _spanned(self, node: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
        """One link for each that looks up, and one for each two sets of filed vectors that it brings together."""
        first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        out = [(int(node[k]), int(self.node[y[k]])) for k in first]
        head = np.repeat(y[first], np.diff(np.append(first, len(x))))
        apart = self.group[head] != self.group[y]
        for p, q in np.unique(np.stack([head[apart], y[apart]], axis=1), axis=0).tolist():
            p_root, q_root = self._root(p), self._root(q)
            if p_root != q_root:
                self.group[max(p_root, q_root)] = min(p_root, q_root)
                out.append((int(self.node[p]), int(self.node[q])))
        for p in np.unique(y).tolist():
            self.group[p] = self._root(p)
        return out


def _joined(plan: Plan):
    """Rows sorted by (label, dim, block, cell, tile, probe) to (node, n, other): counts of links, and links that span them.

    A cell's filed rows come first and are held; those that look up stream past.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, cell = None, [], None

        def answers(cell: Cell, node: np.ndarray, packed: list[bytes]) -> Iterator[pa.RecordBatch]:
            counts, links = cell.look_up(node, packed)
            some = counts > 0
            a, b = (np.array(x, np.int64) for x in (zip(*links, strict=True) if links else ((), ())))
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([node[some], a])), pa.array(np.concatenate([counts[some], np.zeros(len(a), np.int64)])), pa.array(np.concatenate([np.full(int(some.sum()), -1), b]))], names=["node", "n", "other"])

        def closed() -> Iterator[pa.RecordBatch]:
            """All filed rows are here: they are compared among themselves."""
            nonlocal cell, held
            if held:
                cell = Cell(plan, key[1], key[2], held)
                for node, _, packed in held if key[2] != GROUP else ():
                    yield from answers(cell, node, packed)
                held = []

        for batch in batches:
            columns = [batch.column(c) for c in ("label", "dim", "block", "cell", "tile")]
            keys = list(zip(*[c.to_pylist() for c in columns], batch.column("probe").to_pylist(), strict=True))
            node, weight = batch.column("node").to_numpy(), batch.column("weight").to_numpy()
            packed = batch.column("packed").to_pylist()
            a = 0
            while a < len(keys):
                b = a + 1
                while b < len(keys) and keys[b] == keys[a]:
                    b += 1
                if keys[a][:5] != key:
                    yield from closed()
                    key, cell = keys[a][:5], None
                if keys[a][5] == 0:
                    held.append((node[a:b], weight[a:b], packed[a:b]))
                else:
                    yield from closed()
                    if cell is not None:
                        yield from answers(cell, node[a:b], packed[a:b])
                a = b
        yield from closed()

    return run


# --- dense groups -------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Balls:
    """Centres of dense groups, by label and length of vectors; small tables, of at most ``most`` rows."""

    centres: dict[tuple, np.ndarray]  # (label, dim): rows of unit vectors
    numbers: dict[tuple, np.ndarray]

    def nearest(self, key: tuple, unit: np.ndarray, within: float) -> np.ndarray:
        """The number of the nearest centre at an angle of at most ``within``; -1 without one."""
        if key not in self.centres:
            return np.full(len(unit), -1)
        angle = np.arccos(np.clip(unit @ self.centres[key].T, -1, 1))
        best = angle.argmin(axis=1)
        return np.where(angle[np.arange(len(unit)), best] <= within, self.numbers[key][best], -1)


def _balls(rows: list[tuple]) -> Balls:
    """From (number, label, dim, centre)."""
    by: dict[tuple, list] = {}
    for number, label, dim, centre in rows:
        by.setdefault((label, dim), []).append((number, centre))
    return Balls({k: np.array([c for _, c in v]) for k, v in by.items()}, {k: np.array([n for n, _ in v]) for k, v in by.items()})


def _each_label(batch: pa.RecordBatch, item: int) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    """((label, dim), row numbers, unit vectors) of a batch (node, label, packed, ...)."""
    labels = np.array(batch.column(1).to_pylist(), object)
    for rows, packed in _by_size(batch, 2):
        unit = units(unpacked(packed, len(packed[0]) // item))
        for label in dict.fromkeys(labels[rows].tolist()):
            own = labels[rows] == label
            yield (label, unit.shape[1]), rows[own], unit[own]


def _sums(balls: Balls, within: float, item: int):
    """The sum of the unit vectors around each centre, one row per centre and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, _, unit in _each_label(batch, item):
                near = balls.nearest(key, unit, within)
                for number in np.unique(near[near >= 0]).tolist():
                    sums[number] = sums.get(number, 0.0) + unit[near == number].sum(axis=0)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["number", "total"])

    return run


def _total(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"number": [rows["number"].iloc[0]], "total": [np.sum(np.stack(rows["total"]), axis=0).tolist()]})


def _grouped(balls: Balls, within: float, item: int):
    """(node, label, packed, weight) with the number of the group that holds a vector, -1 for none, and its angle to the centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number, angle = np.full(len(batch), -1), np.zeros(len(batch))
            for key, rows, unit in _each_label(batch, item):
                near = balls.nearest(key, unit, within)
                number[rows] = near
                has = near >= 0
                if has.any():
                    centre = balls.centres[key][np.searchsorted(balls.numbers[key], near[has])]
                    angle[rows[has]] = np.arccos(np.clip((unit[has] * centre).sum(axis=1), -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number), pa.array(angle)], names=[*batch.schema.names, "number", "angle"])

    return run


def _near_groups(balls: Balls, stats: dict[int, tuple[float, int, int]], limit: float, item: int):
    """(node, label, packed, weight, number) to (node, n, other, ask): what the whole groups around a vector say of its links.

    stats: a group's greatest angle, weight and one of its nodes. A group all of whose vectors must link is counted at
    once; of one that may hold some, ``ask`` names it, for its vectors to be compared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, own = batch.column(0).to_numpy(), batch.column(4).to_numpy()
            out: list[tuple] = []
            for key, rows, unit in _each_label(batch, item):
                if key not in balls.centres:
                    continue
                numbers = balls.numbers[key]
                reach = np.array([stats[x][0] if x in stats else -9.0 for x in numbers.tolist()])
                angle = np.arccos(np.clip(unit @ balls.centres[key].T, -1, 1))
                mine = own[rows][:, None] == numbers[None]
                sure = ((angle + reach <= limit - 1e-6) | mine) & (reach >= 0)
                for i, j in zip(*np.nonzero(sure), strict=True):
                    weight, head = stats[int(numbers[j])][1:]
                    out.append((node[rows[i]], weight, head, None))
                maybe = ~sure & (angle - reach <= limit + 1e-6) & (reach >= 0)
                out += [(node[rows[i]], 0, -1, numbers[j]) for i, j in zip(*np.nonzero(maybe), strict=True)]
            if out:
                a, n, b, ask = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(n, pa.int64()), pa.array(b, pa.int64()), pa.array(ask, pa.int64())], names=["node", "n", "other", "ask"])

    return run


def near_vectors(rows: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", width: int = 8, bits: int | None = None, tile: int = 8192, centres: int = 1024) -> DataFrame:
    """One row per input row: ``id_col``, n_links, component_id, kept; rows of equal label link at a cosine of at least ``cosine``.

    n_links counts the other rows that a row links with; component_id is the smallest id that links reach, itself
    included; kept is whether it is the row's own.

    Equal vectors are one node with a weight. Unit vectors are rotated and split into blocks of ``width`` coordinates; two
    within the squared distance 2 - 2 cosine are within an equal share of it in some block. Each block is parted into
    2**``bits`` cells (by default enough for some thousand vectors of the largest label in each); a vector is filed in
    its own cell and looks up every cell that the ball of the block's share around it meets. Block distances find the
    candidates, and the cosine of the whole vectors in double precision decides; a pair counts in the first block within its share only. Pairs are
    compared and counted in tasks; what leaves a task is a count for each vector, and links that span what the pairs join.

    A cell of more than ``tile`` vectors is dealt to several tasks. Where there is one, dense groups are taken out first: at
    most ``centres`` of them, found from vectors of crowded cells, hold what lies within half the linking angle of a
    centre, so that all their vectors link with each other, and are counted, not compared. Other vectors are compared
    with a group's only where the angles leave it open. Where groups are found changes the work, not the result.

    Defined results: a null label, and vectors that are null, empty, zero or hold null or non-finite components, have no
    links and their own id as the component; vectors of different lengths do not link; null ids do not count for the
    smallest (null and not kept if there is no other); equal ids are separate rows; empty table - no rows. ``label_col``
    None: all rows have one label. Further columns are not read.
    """
    label = F.col(label_col).cast("string") if label_col else F.lit("")
    kind = rows.schema[id_col].dataType.simpleString()
    given = rows.select(F.col(id_col).alias("id"), label.alias("label"), F.col(vector_col).alias("v"))
    item = 4 if rows.schema[vector_col].dataType.elementType.simpleString() == "float" else 8
    if item == 8:
        given = given.withColumn("v", F.col("v").cast("array<double>"))
    packed = given.mapInArrow(_pack, f"id {kind}, label string, packed binary").withColumn("packed", F.when(F.col("label").isNotNull(), F.col("packed")))
    classes = packed.where("packed is not null").groupBy("label", "packed").agg(F.count(F.lit(1)).alias("weight"), F.min("id").alias("low"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))
    counts = _links(classes.select("node", "label", "packed", "weight"), cosine, width, bits, tile, centres, item)
    links = counts.where("other >= 0").select(F.col("node").alias("a"), F.col("other").alias("b"))
    parts = connected_components(links)
    sums = counts.groupBy("node").agg(F.sum("n").alias("n"))
    known = classes.join(sums, "node", "left").join(parts.withColumnRenamed("component", "top"), "node", "left").withColumn("top", F.coalesce("top", "node"))
    # Joined back by another key than the grouping's, so that a component of many vectors can be split between tasks.
    lowest = known.groupBy("top").agg(F.min("low").alias("lowest")).select(F.bitwise_not("top").alias("not_top"), "lowest")
    known = known.withColumn("not_top", F.bitwise_not("top")).join(lowest, "not_top").select("label", "packed", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "lowest")
    joined = packed.join(known, ["label", "packed"], "left")
    found = joined.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("lowest")).alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))


def _links(nodes: DataFrame, cosine: float, width: int, bits: int | None, tile: int, centres: int, item: int) -> DataFrame:
    """(node, n, other) over (node, label, packed, weight): n adds up to the weight of a node's links; other >= 0 is a link to it."""
    if bits is None:
        most = nodes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
        bits = min(2 * width, max(0, math.ceil(math.log2(max(1, 2 * most / tile)))))
    plan = Plan(cosine, width, bits)
    place = ["label", "dim", "block", "cell"]
    own = lambda rows: rows.mapInArrow(_filed(plan, item, True), "label string, dim int, block int, cell long").groupBy(*place).count().where(F.col("count") > tile)
    alone = nodes.withColumn("grouped", F.lit(False))
    crowded = cut(own(alone))
    found = []
    busy = not crowded.isEmpty()
    if busy:
        groups = _groups(nodes, crowded, plan, tile, centres, item)
        if groups is not None:
            alone, more = groups
            found.append(more)
            crowded = cut(own(alone))
            busy = not crowded.isEmpty()
    filed = alone.mapInArrow(_filed(plan, item, False), "label string, dim int, block int, cell long, probe int, node long, weight long, packed binary")
    if busy:
        filed = _tiled(filed, crowded.withColumnRenamed("count", "size"), place, tile)
    else:
        filed = filed.withColumn("tile", F.lit(0).cast("long"))
    found.append(_compared(filed, plan))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return cut(out.groupBy("node", "other").agg(F.sum("n").alias("n")))


def _tiled(filed: DataFrame, sizes: DataFrame, place: list[str], tile: int) -> DataFrame:
    """The rows with their tile: a filed row goes to one tile of its cell and looks up in all, like the others."""
    tiles = F.coalesce(F.ceil(F.col("size") / tile), F.lit(1)).cast("long")
    rows = filed.join(sizes, place, "left").withColumn("tiles", tiles).drop("size")
    rows = rows.withColumn("home", F.pmod(F.xxhash64("node"), F.col("tiles"))).withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    return rows.withColumn("probe", F.when((F.col("probe") == 0) & (F.col("home") == F.col("tile")), 0).otherwise(1)).drop("home", "tiles")


def _compared(filed: DataFrame, plan: Plan) -> DataFrame:
    n = int(filed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["label", "dim", "block", "cell", "tile"]
    dealt = filed.select(*keys, "probe", "node", "weight", "packed").repartition(n, *keys).sortWithinPartitions(*keys, "probe")
    return dealt.mapInArrow(_joined(plan), "node long, n long, other long")


def _groups(nodes: DataFrame, crowded: DataFrame, plan: Plan, tile: int, centres: int, item: int) -> tuple[DataFrame, DataFrame] | None:
    """(nodes with ``grouped``, their (node, n, other) with whole groups); None if no dense group is found."""
    limit = math.acos(max(-1.0, plan.cosine))
    # A few vectors of the most crowded cells start the search: at most ``centres`` in all.
    cells = crowded.orderBy(F.desc("count"), "label", "dim", "block", "cell").limit(max(1, centres // 8)).drop("count")
    homes = nodes.withColumn("grouped", F.lit(False)).mapInArrow(_filed(plan, item, False), "label string, dim int, block int, cell long, probe int, node long, weight long, packed binary").where("probe = 0")
    best = Window.partitionBy("label", "dim", "block", "cell").orderBy(F.xxhash64("node"))
    starts = homes.join(cells, ["label", "dim", "block", "cell"]).withColumn("r", F.row_number().over(best)).where("r <= 8").select("label", "dim", "packed").distinct().collect()
    seeds: dict[tuple, list] = {}
    for r in sorted(starts, key=lambda r: (r["label"], r["dim"], bytes(r["packed"]))):
        unit = units(unpacked([bytes(r["packed"])], r["dim"]))[0]
        have = seeds.setdefault((r["label"], r["dim"]), [])
        if not have or float(np.max(np.array(have) @ unit)) < math.cos(limit / 2):
            have.append(unit)
    listed = [(k, *key, c) for k, (key, c) in enumerate((key, c) for key, cs in seeds.items() for c in cs)]
    rows = nodes.select("node", "label", "packed", "weight")
    for _ in range(2):  # a centre moves to the mean of what is around it
        sums = rows.mapInArrow(_sums(_balls(listed), limit, item), "number long, total array<double>").groupBy("number").applyInPandas(_total, "number long, total array<double>").collect()
        means = {r["number"]: np.array(r["total"]) for r in sums}
        listed = [(k, label, dim, units(means[k][None])[0] if k in means and means[k].any() else c) for k, label, dim, c in listed]
    kept: list[tuple] = []
    for k, label, dim, c in listed:  # centres that have met are one
        if not any(x[1:3] == (label, dim) and float(x[3] @ c) > math.cos(limit / 8) for x in kept):
            kept.append((k, label, dim, c))
    balls = _balls(kept)
    schema = "node long, label string, packed binary, weight long, number long, angle double"
    placed = cut(rows.mapInArrow(_grouped(balls, limit / 2 - 1e-6, item), schema))
    # At most ``centres`` rows. Groups too small to spare work are none.
    stats = placed.where("number >= 0").groupBy("number").agg(F.max("angle").alias("reach"), F.sum("weight").alias("weight"), F.min("node").alias("head"), F.count(F.lit(1)).alias("n")).where(F.col("n") > tile // 8).collect()
    if not stats:
        return None
    held = {r["number"]: (r["reach"], r["weight"], r["head"]) for r in stats}
    placed = placed.withColumn("number", F.when(F.col("number").isin(list(held)), F.col("number")).otherwise(F.lit(-1).cast("long")))
    said = cut(placed.select("node", "label", "packed", "weight", "number").mapInArrow(_near_groups(balls, held, limit, item), "node long, n long, other long, ask long"))
    sure = said.where("ask is null").select("node", "n", "other")
    # A group counts its own vectors, each of which counted itself too.
    itself = placed.where("number >= 0").select("node", (-F.col("weight")).alias("n"), F.lit(-1).cast("long").alias("other"))
    asked = said.where("ask is not null").select("node", F.col("ask").alias("cell"))
    sizes = {r["number"]: r["n"] for r in stats}
    size_of = F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, v)])[F.col("cell")]
    everyone = placed.select("node", "label", "packed", "weight")
    members = placed.where("number >= 0").select(F.col("number").alias("cell"), F.lit(0).alias("probe"), "node", "label", "packed", "weight")
    probes = asked.join(everyone, "node").select("cell", F.lit(1).alias("probe"), "node", "label", "packed", "weight")
    needed = members.join(asked.select("cell").distinct(), "cell", "left_semi")
    rows = needed.unionByName(probes).withColumn("tiles", F.ceil(size_of / tile).cast("long"))
    home = F.pmod(F.xxhash64("node"), F.col("tiles"))
    tiled = rows.withColumn("tile", F.explode(F.when(F.col("probe") == 0, F.array(home)).otherwise(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))))
    tiled = tiled.select("label", (F.octet_length("packed") / item).cast("int").alias("dim"), F.lit(GROUP).alias("block"), "cell", "tile", "probe", "node", "weight", "packed")
    more = _compared(tiled, plan)
    grouped = placed.select("node", "label", "packed", "weight", (F.col("number") >= 0).alias("grouped"))
    return grouped, sure.unionByName(itself).unionByName(more)
