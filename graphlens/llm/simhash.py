"""SimHash near-duplicates: word-shingle fingerprints, multi-index hashing, components of linked fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.llm.common import LOWER, WHITE, arrow_rows, cut, fresh_name, small_batches, text_blocks, with_schema, word_bounds
from graphlens.llm.components import connected_components

#: For each byte value, its eight bits in the eight bytes of one integer, so that 255 of them add without a carry.
_LANES = (np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")).view(np.uint64).ravel()


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes; no hash gives zero."""
    if not len(hashes):
        return 0
    octets = hashes.view(np.uint8).reshape(-1, 8)
    counts = np.zeros(64, np.int64)
    for a in range(0, len(octets), 255):
        counts += np.ascontiguousarray(_LANES[octets[a : a + 255]].sum(axis=0, dtype=np.uint64)).view(np.uint8)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(text_at: int, width: int, seed: int, name: str, keep: list[int]):
    """A mapInArrow function: the kept columns and the fingerprint of the text column."""

    def prints_of(column: pa.Array) -> Iterator[int]:
        digest = xxhash.xxh64_intdigest
        for _, _, raw, offsets in text_blocks(column):
            raw = LOWER[raw]
            starts, stops, first = word_bounds(raw, offsets, WHITE)
            # The words joined by one space: every shingle is then one slice.
            inside = np.zeros(len(raw) + 1, np.int8)
            inside[starts] += 1
            inside[stops] -= 1
            lengths = stops - starts
            joined = np.full(int(lengths.sum() + len(lengths)), 0x20, np.uint8)
            ends = np.cumsum(lengths + 1) - 1
            begins = ends - lengths
            gap = np.ones(len(joined), bool)
            gap[ends] = False
            joined[gap] = raw[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]
            body = joined.tobytes()
            for row in range(len(offsets) - 1):
                a, b = int(first[row]), int(first[row + 1])
                if b - a <= width:
                    yield fingerprint(np.array([digest(body[begins[a] : ends[b - 1]], seed)] if b > a else [], np.uint64))
                else:
                    slices = zip(begins[a : b - width + 1].tolist(), ends[a + width - 1 : b].tolist(), strict=True)
                    yield fingerprint(np.fromiter((digest(body[x:y], seed) for x, y in slices), np.uint64, b - a - width + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text_at):
            prints = np.fromiter(prints_of(batch.column(text_at)), np.uint64, len(batch))
            yield arrow_rows(batch.select(keep), batch.schema, **{name: pa.array(prints.view(np.int64))})

    return run


def add_fingerprint(docs: DataFrame, name: str = "fingerprint", text_col: str = "text", width: int = 4, seed: int = 42, keep: list[str] | None = None) -> DataFrame:
    """The documents, or their columns ``keep``, with a 64-bit SimHash, as a signed long, of their lower-cased word shingles.

    Defined results: null and wordless texts give zero; fewer words than ``width`` form one shingle; equal texts give equal
    values; ``name`` must not be taken; empty table - no rows.
    """
    keep = docs.columns if keep is None else keep
    places = [docs.columns.index(c) for c in keep]
    schema = with_schema(docs.select(*keep), **{name: "long"})
    return docs.mapInArrow(_fingerprints(docs.columns.index(text_col), width, seed, name, places), schema)


@dataclass(frozen=True)
class Table:
    """One table of the index: some bits of a fingerprint, and the radius of the ball looked up around their value."""

    mask: int
    radius: int

    def ball(self) -> list[int]:
        """Every difference of at most ``radius`` of the bits, 0 first, as signed 64-bit numbers."""
        ones = [1 << i for i in range(64) if self.mask >> i & 1]
        out = [sum(x) for r in range(self.radius + 1) for x in combinations(ones, r)]
        return [_signed(x) for x in out]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def tables(distance: int, rows: int) -> list[Table]:
    """The tables for so many fingerprints, with values wide enough that no more than 64 share one on average.

    Of ``blocks`` blocks of bits, the ``taken`` that two fingerprints within ``distance`` differ least in have at most
    distance * taken // blocks differences, so one table for every choice of that many blocks finds all links. The
    first plan that is wide enough is taken, and the widest beyond: fewer rows are named than by wider tables, while
    comparing 64 fingerprints costs less than a row that is shuffled.
    """
    for blocks, taken in ((3, 1), (5, 2), (2, 1)):
        radius = distance * taken // blocks
        edges = [64 * i // blocks for i in range(blocks + 1)]
        parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
        plan = [Table(sum(x), radius) for x in combinations(parts, taken)]
        if radius <= 2 and rows <= 64 << min(t.mask.bit_count() for t in plan):
            return plan
    if radius > 2:
        raise ValueError("balls of more than two bits are too large; use a smaller distance")
    return plan


def _match(distance: int):
    """Sorted (bucket, fp, probe) rows to a spanning forest of each bucket's links: pairs are compared, never emitted."""

    def forest(own: np.ndarray, other: np.ndarray) -> list[tuple[int, int]]:
        """Links that join what links of own rows to own and other rows join."""
        everyone = np.concatenate([own, other])
        group = np.arange(len(everyone))
        out = []
        for i in range(len(own)):
            near = np.flatnonzero(np.bitwise_count(everyone[i + 1 :] ^ own[i]) <= distance) + i + 1
            labels = np.unique(group[near])
            labels = labels[labels != group[i]]
            if len(labels):
                firsts = near[np.unique(group[near], return_index=True)[1]]
                out += [(int(own[i]), int(everyone[j])) for j in firsts if group[j] != group[i]]
                group[np.isin(group, labels)] = group[i]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[pa.RecordBatch] = []

        def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
            key = table.column("bucket").to_numpy()
            fp = table.column("fp").to_numpy().view(np.uint64)
            probe = table.column("probe").to_numpy().astype(bool)
            edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(edge, len(key)))
            links: list[tuple[int, int]] = []
            small = np.flatnonzero((size > 1) & (size <= 8))
            for shift in range(1, 8):  # small buckets, all at once
                which = small[size[small] > shift]
                if not len(which):
                    break
                first = _positions(edge[which], size[which] - shift)
                second = first + shift
                ok = (np.bitwise_count(fp[first] ^ fp[second]) <= distance) & ~(probe[first] & probe[second]) & (fp[first] != fp[second])
                links += zip(fp[first[ok]].tolist(), fp[second[ok]].tolist(), strict=True)
            for e, s in zip(edge[size > 8].tolist(), size[size > 8].tolist(), strict=True):
                here, probing = fp[e : e + s], probe[e : e + s]
                if not probing.all():
                    links += forest(here[~probing], here[probing])
            if links:
                a, b = np.array(links, np.uint64).T
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a).view(np.int64)), pa.array(np.ascontiguousarray(b).view(np.int64))], names=["a", "b"])

        for batch in batches:
            pending.append(batch)
            key = batch.column(0).to_numpy()
            if len(key) and key[0] != key[-1] or sum(len(x) for x in pending) > 1 << 20:
                table = pa.Table.from_batches(pending)
                key = table.column("bucket").to_numpy()
                last = int(np.searchsorted(key, key[-1]))  # the last bucket may go on
                if last:
                    yield from work(table.slice(0, last))
                    pending = table.slice(last).to_batches()
        if sum(len(x) for x in pending):
            yield from work(pa.Table.from_batches(pending))

    return run


def _positions(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after another."""
    total = np.cumsum(lengths)
    return np.repeat(starts - (total - lengths), lengths) + np.arange(total[-1] if len(total) else 0)


def near_links(prints: DataFrame, distance: int = 4, plan: list[Table] | None = None, hot: int = 4096) -> DataFrame:
    """Links (a, b) of distinct fingerprints (column fp) whose components are those of all pairs at ``distance`` or less.

    Multi-index hashing: every fingerprint is filed in each table of the ``plan`` (by default the one for as many rows,
    ``tables``) under the value of the table's bits and looked up under every value of the small Hamming ball around
    it; complete distances decide. A bucket gives a spanning forest of its links, not all of them.

    A table value of more than ``hot`` fingerprints, and the values around it, are never gathered. Their fingerprints
    are linked exactly in another way: two are within 2r bits when some word lies within r bits of both, so each
    fingerprint names all words of its ball and takes the smallest fingerprint that named the same word; the work is
    in proportion to the rows.
    """
    if plan is None:
        plan = tables(distance, prints.count())
    masks = F.array(*[F.array(*[F.lit(x).cast("long") for x in t.ball()]) for t in plan])
    value = lambda t: F.col("fp").bitwiseAND(F.lit(_signed(t.mask)).cast("long"))
    # A bucket is a hash of table and value: values that share one are compared too, and their distances decide.
    bucket = lambda k, x: F.xxhash64(k, x)
    around = lambda k, t: lambda x: F.struct(bucket(F.lit(k), value(t).bitwiseXOR(x)).alias("bucket"), (x != 0).alias("probe"))
    entries = [F.transform(masks[k], around(k, t)) for k, t in enumerate(plan)]
    filed = prints.select("fp", F.explode(F.concat(*entries)).alias("e")).select("e.bucket", "fp", "e.probe")
    own = prints.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), value(t).alias("value")) for k, t in enumerate(plan)])).alias("t")).select("t.*")
    crowded = own.groupBy("k", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot)
    big = cut(crowded.select(F.explode(F.transform(F.get(masks, F.col("k")), lambda x: bucket(F.col("k"), F.col("value").bitwiseXOR(x)))).alias("bucket")).distinct())
    usual, links = filed, None
    if not big.isEmpty():
        usual = filed.join(big, "bucket", "left_anti")
        dense = filed.join(big, "bucket", "left_semi").select("fp").distinct()
        half = distance // 2
        if 2 * half != distance:
            raise ValueError("an odd distance has no exact midpoint words; use an even one")
        ball = Table((1 << 64) - 1, half).ball()
        named = dense.select("fp", F.explode(F.array(*[F.lit(x).cast("long") for x in ball])).alias("x")).select("fp", F.col("fp").bitwiseXOR(F.col("x")).alias("word"))
        star = named.groupBy("word").agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high")
        links = named.join(star, "word").where("fp <> low").select(F.col("fp").alias("a"), F.col("low").alias("b")).distinct()
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = usual.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_match(distance), "a long, b long")
    return found.distinct() if links is None else found.union(links).distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, distance: int = 4, seed: int = 42, plan: list[Table] | None = None, hot: int = 4096) -> DataFrame:
    """One row per document: ``id_col``, fingerprint (16 hex digits), component_id.

    Fingerprints link at ``distance`` or fewer differing bits; component_id is the smallest id that links reach,
    itself included. Copies share a fingerprint and count as linked; only distinct fingerprints are compared.

    Defined results: null and wordless texts have fingerprint zero and link like any other; fewer words than a
    shingle form one shingle; equal ids are separate rows; null ids are ignored by the minimum (null if all are);
    empty table - no rows. Further columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    rows = cut(add_fingerprint(rows, "fp", "body", width, seed, keep=["id"]))
    found = _components(rows, distance, plan, hot)
    return found.select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _components(rows: DataFrame, distance: int, plan: list[Table] | None, hot: int) -> DataFrame:
    """Rows with columns id and fp, further with their class (one of its fingerprints) and component_id."""
    prints = cut(rows.groupBy("fp").agg(F.min("id").alias("low")))
    parts = connected_components(near_links(prints.select("fp"), distance, plan, hot))
    # Each fingerprint's class: itself, or the smallest fingerprint it reaches; then the smallest id of the class.
    classes = prints.join(parts, prints.fp == parts.node, "left").select("fp", "low", F.coalesce("component", "fp").alias("class"))
    # Joined back by another key than the grouping's, so that a class of many fingerprints can be split between tasks.
    lowest = classes.groupBy("class").agg(F.min("low").alias("component_id")).select(F.bitwise_not("class").alias("not_class"), "component_id")
    classes = classes.withColumn("not_class", F.bitwise_not("class")).join(lowest, "not_class")
    return rows.join(classes.select("fp", "class", "component_id"), "fp")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, distance: int = 4, seed: int = 42, plan: list[Table] | None = None, hot: int = 4096) -> DataFrame:
    """The documents' own columns, with one row of each class of near-duplicates: its smallest id.

    Defined results: rows of equal id, or of none, are told apart by their text; of those with a class's smallest id,
    the text of the smallest hash stays. Rows equal in both are one and the same document, of which any one row stays. A null
    id stays only in a class without others. Null and wordless texts are near-duplicates of each other and of whatever
    has a fingerprint of at most ``distance`` bits. Texts are not changed; empty table - no rows.
    """
    text_hash = F.coalesce(F.unhex(F.sha2(F.col(text_col), 256)), F.lit(b""))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"), text_hash.alias("hash"))
    rows = cut(add_fingerprint(rows, "fp", "body", width, seed, keep=["id", "hash"]))
    lowest = _components(rows, distance, plan, hot).where(F.col("id").eqNullSafe(F.col("component_id")))
    keys = cut(lowest.groupBy("class", "id", "hash").count())
    keep = cut(keys.groupBy("class", F.col("id").alias("keep_id")).agg(F.min("hash").alias("keep_hash")).drop("class"))
    name = fresh_name(docs, "hash")
    kept = docs.withColumn(name, text_hash)
    kept = kept.join(keep, kept[id_col].eqNullSafe(keep["keep_id"]) & (kept[name] == keep["keep_hash"]), "left_semi")
    repeated = not keys.where("count > 1").isEmpty()
    return (kept.dropDuplicates([id_col, name]) if repeated else kept).drop(name)
