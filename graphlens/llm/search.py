"""Ranked lexical search: an inverted treap per term and slice of the documents, traversed together to the best k."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlens.llm.common import LOWER, NOT_ALNUM, cut, release, small_batches, text_blocks, word_bounds, word_hashes
from graphlens.llm.sharding import with_prefix

#: Documents whose postings are one key of a treap; a slice of documents is searched by one step of a task.
BLOCK = 256
SLICE = 1 << 15


def words_of(text: str | None) -> list[bytes]:
    """The terms of a text, in order: runs of a-z, 0-9 and non-ASCII after lower-casing A-Z."""
    raw = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    starts, stops, _ = word_bounds(raw, np.array([0, len(raw)]), NOT_ALNUM)
    data = raw.tobytes()
    return [data[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]


def hashes_of(words: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words], dtype=np.int64) - 1
    return word_hashes(raw, ends - np.array([len(w) for w in words], np.int64), ends)


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


# --- postings ---------------------------------------------------------------------------------------------------


class Terms:
    """The terms that some query has, numbered; a word is looked up by its hash, and told by its bytes."""

    def __init__(self, words: list[bytes]):
        hashes = hashes_of(words)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.number = hashes[order], order
        if len(hashes) > 1 and (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two query terms have one hash")
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.raw = np.frombuffer(b"".join(words), np.uint8)

    def find(self, raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which words are terms, their numbers)."""
        hashes = word_hashes(raw, starts, stops)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        hit = np.flatnonzero(self.hashes[at] == hashes)
        number = self.number[at[hit]]
        lengths = stops[hit] - starts[hit]
        same = lengths == self.lengths[number]
        for k in range(int(lengths.max(initial=0))):  # byte by byte, all words at once
            on = np.flatnonzero(same & (lengths > k))
            if not len(on):
                break
            same[on] = raw[starts[hit[on]] + k] == self.raw[self.begins[number[on]] + k]
        return hit[same], number[same]


def _postings(words: list[bytes], text_at: int, keep: int):
    """A mapInArrow function: id, n (all terms with repeats), and the query terms with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(words) if words else None
        for batch in small_batches(batches, text_at):
            counts, lists, tfs = [], [], []
            for _, _, raw, offsets in text_blocks(batch.column(text_at)):
                raw = LOWER[raw]
                starts, stops, first = word_bounds(raw, offsets, NOT_ALNUM)
                counts.append(np.diff(first))
                if terms is None:
                    lists += [[]] * (len(offsets) - 1)
                    tfs += [[]] * (len(offsets) - 1)
                    continue
                hit, number = terms.find(raw, starts, stops)
                row = np.searchsorted(first, hit, "right") - 1
                pairs, tf = np.unique(row * len(words) + number, return_counts=True)
                edges = np.searchsorted(pairs, np.arange(len(offsets)) * len(words))
                own = pairs % len(words)
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    lists.append(own[a:b])
                    tfs.append(tf[a:b])
            yield pa.RecordBatch.from_arrays([batch.column(keep), pa.array(np.concatenate(counts) if counts else [], pa.int64()), pa.array(lists, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))], names=["id", "n", "terms", "tfs"])

    return run


# --- treaps -----------------------------------------------------------------------------------------------------


@dataclass
class Treap:
    """Blocks of a term's postings in search order by document, in heap order by their greatest impact."""

    block: np.ndarray  # node: block number, ascending
    impact: np.ndarray  # node: the block's greatest impact
    left: np.ndarray
    right: np.ndarray
    root: int

    @staticmethod
    def build(block: np.ndarray, impact: np.ndarray) -> Treap:
        n = len(block)
        left, right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        spine: list[int] = []  # from the root along right children
        values = impact.tolist()
        for k in range(n):
            last = -1
            while spine and values[spine[-1]] < values[k]:
                last = spine.pop()
            left[k] = last
            if spine:
                right[spine[-1]] = k
            spine.append(k)
        return Treap(block, impact, left, right, spine[0] if spine else -1)


class Slice:
    """Some documents' postings by term and block, with a treap per term, to be asked many queries."""

    def __init__(self, lengths: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, weights: np.ndarray, n: int, total: int):
        """Documents are numbered in the order of ids; lengths are their terms with repeats; n and total are the corpus's."""
        m = 75 + np.array([25 * x * n // max(1, total) for x in lengths.tolist()], np.int64)
        order = np.lexsort((doc, term))
        self.doc, term, tf = doc[order], term[order], tf[order].astype(np.int64)
        self.impact = 1_000_000_000 * tf // (1000 * tf + 12 * m[self.doc])
        self.size = len(lengths)
        key = term.astype(np.int64) * (self.size // BLOCK + 1) + self.doc // BLOCK
        self.edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        self.stop = np.append(self.edge[1:], len(key))
        best = np.maximum.reduceat(self.impact, self.edge) if len(key) else np.zeros(0, np.int64)
        owner = term[self.edge]
        self.treaps: dict[int, Treap] = {}
        self.base: dict[int, int] = {}
        cuts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else []
        for a, b in zip(cuts, np.append(cuts[1:], len(owner)), strict=True):
            t = int(owner[a])
            if weights[t] > 0:
                self.treaps[t] = Treap.build(self.doc[self.edge[a:b]] // BLOCK, best[a:b])
                self.base[t] = int(a)
        self.weights = weights

    def top(self, terms: np.ndarray, repeats: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores) of the best k, equal scores by document, and how many blocks were scored.

        The treaps are walked together: of a range of blocks, every term has the highest node inside it, whose impact is
        the greatest of the range; where the sum of those cannot enter the best k, the range is left with all subtrees.
        Ranges are parted at the node that promises most, and the half that promises more goes first.
        """
        known = [(int(t), int(r)) for t, r in zip(terms, repeats, strict=True) if int(t) in self.treaps]
        treaps = [self.treaps[t] for t, _ in known]
        factor = [int(self.weights[t]) * r for t, r in known]
        base = [self.base[t] for t, _ in known]
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        floor, scored = 0, 0  # a document needs a score above the floor

        def within(lo: int, hi: int, nodes: list[tuple[int, int]]) -> tuple[int, list[tuple[int, int]]]:
            """The nodes' subtrees narrowed to a range, and the sum of their greatest impacts."""
            bound, kept = 0, []
            for j, x in nodes:
                tree = treaps[j]
                while x >= 0:
                    at = tree.block[x]
                    if at < lo:
                        x = tree.right[x]
                    elif at >= hi:
                        x = tree.left[x]
                    else:
                        break
                if x >= 0:
                    kept.append((j, x))
                    bound += factor[j] * int(tree.impact[x])
            return bound, kept

        last = self.size // BLOCK + 1
        stack = [(*within(0, last, [(j, t.root) for j, t in enumerate(treaps)]), 0, last)]
        while stack:
            bound, nodes, lo, hi = stack.pop()
            if bound <= floor or not nodes:
                continue
            j, x = max(nodes, key=lambda e: factor[e[0]] * int(treaps[e[0]].impact[e[1]]))
            middle = int(treaps[j].block[x])
            if hi - lo > 1:
                # The block itself, and what lies before and after it.
                parts = [(*within(a, b, nodes), a, b) for a, b in ((lo, middle), (middle, middle + 1), (middle + 1, hi)) if a < b]
                stack += sorted((p for p in parts if p[0] > floor), key=lambda p: p[0])
                continue
            scored += 1
            sums = np.zeros(BLOCK, np.int64)
            for j, x in nodes:
                a, b = self.edge[base[j] + x], self.stop[base[j] + x]
                sums[self.doc[a:b] - middle * BLOCK] += factor[j] * self.impact[a:b]  # a document stands once in a list
            good = np.flatnonzero(sums > floor)
            if len(good):
                docs, scores = np.concatenate([docs, good + middle * BLOCK]), np.concatenate([scores, sums[good]])
                if len(docs) > k:
                    order = np.lexsort((docs, -scores))[:k]
                    docs, scores = docs[order], scores[order]
                # Equal scores go by document, and blocks come in any order: only what is below the k-th score is left.
                floor = max(floor, int(scores.min()) - 1) if len(docs) == k else floor
        order = np.lexsort((docs, -scores))
        return docs[order], scores[order], scored


def _search(queries: list[tuple[int, list[int], list[int]]], weights: list[int], n: int, total: int, k: int, size: int):
    """A mapInArrow function: postings rows (id, n, terms, tfs) to (query, id, score), the best k of every slice."""

    def answers(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("id", "ascending")], null_placement="at_end")).combine_chunks()
        lists = rows.column("terms").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        tfs = rows.column("tfs").combine_chunks()
        tfs = tfs.chunk(0) if isinstance(tfs, pa.ChunkedArray) else tfs
        doc = np.repeat(np.arange(len(rows)), pc.list_value_length(lists).to_numpy())
        part = Slice(rows.column("n").to_numpy(), doc, lists.flatten().to_numpy(), tfs.flatten().to_numpy(), np.array(weights, np.int64), n, total)
        who, docs, scores = [], [], []
        for number, terms, repeats in queries:
            got, score, _ = part.top(terms, repeats, k)
            who.append(np.full(len(got), number, np.int64))
            docs.append(got)
            scores.append(score)
        if queries:
            at = pa.array(np.concatenate(docs))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(who)), rows.column("id").take(at).combine_chunks(), pa.array(np.concatenate(scores))], names=["query", "id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[pa.RecordBatch] = []
        for batch in batches:
            pending.append(batch)
            if sum(len(x) for x in pending) >= size:
                yield from answers(pa.Table.from_batches(pending))
                pending = []
        if pending:
            yield from answers(pa.Table.from_batches(pending))

    return run


def ranked_search(docs: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text", block_bytes: int = 1 << 20, slice_docs: int = SLICE) -> DataFrame:
    """(``query_id``, rank, ``id_col``, score): every query's ``k`` documents of the highest score above 0, from rank 1.

    A term's weight is floor(1000 ln((2N+2)/(2df+1))); a document gets, for every term of the query with repeats, the
    weight times (10^9 tf) div (1000 tf + 12 m), m being 75 + (25 n N) div L: N documents with a term, L their terms, n
    the document's. All else is integer.

    Queries are taken in blocks of ``block_bytes`` of text (and one query), of which one at a time is on the driver and
    sent to the tasks. Per block the documents are read once: what is written is one short row per document, its length
    and its query terms. N, L and df come from those rows; then every task builds the treaps of slices of at most
    ``slice_docs`` documents and a batch, and gives the best k of each, and those few rows are ranked.

    Defined results: null and empty texts have no terms; a query without terms, or without documents, has no rows; equal
    scores go by ascending id, a null id last; equal ids are separate documents, and equal or null query ids are
    separate queries (their rows have the same or no ``query_id``); no documents or no queries - no rows. Further columns are not read.
    """
    spark = docs.sparkSession
    asked = queries.select(F.col(query_id).alias("item"), F.col(query_text).alias("body")).withColumn("size", (F.coalesce(F.octet_length("body"), F.lit(0)) + 16).cast("long")).withColumn("one", F.lit(1).cast("long"))
    asked, _ = with_prefix(asked, ["item", "body"], ["size", "one"])
    asked = cut(asked.select("item", "body", F.expr(f"before_size div {block_bytes}").alias("block"), F.col("before_one").alias("query")))
    blocks = sorted(r["block"] for r in asked.select("block").distinct().collect())
    found = None
    for block in blocks:
        rows = asked.where(F.col("block") == block).select("query", "body").collect()  # bounded by block_bytes and one text
        part = _ranked(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")), [(r["query"], r["body"]) for r in rows], k, slice_docs)
        found = part if found is None else found.unionByName(part)
    kind = docs.schema[id_col].dataType
    if found is None:
        found = spark.createDataFrame([], "query long, id long, score long").withColumn("id", F.col("id").cast(kind))
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(asked.select("query", "item"), "query").select(F.col("item").alias(query_id), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


def _ranked(docs: DataFrame, queries: list[tuple[int, str | None]], k: int, slice_docs: int) -> DataFrame:
    """The best k of every slice for one block of queries: (query, id, score)."""
    lists = [(number, words_of(text)) for number, text in queries]
    words = sorted({w for _, ws in lists for w in ws})
    number_of = {w: i for i, w in enumerate(words)}
    kind = docs.schema["id"].dataType.simpleString()
    postings = cut(docs.mapInArrow(_postings(words, 1, 0), f"id {kind}, n long, terms array<int>, tfs array<int>").where("n > 0"))
    n, total = postings.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    # No more rows than the block's queries have terms.
    df = dict(postings.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
    weights = [weight(n, df.get(t, 0)) for t in range(len(words))]
    asked = []
    for number, ws in lists:
        terms, repeats = np.unique([number_of[w] for w in ws], return_counts=True) if ws else ((), ())
        asked.append((number, [int(t) for t in terms], [int(r) for r in repeats]))
    found = cut(postings.where(F.size("terms") > 0).mapInArrow(_search(asked, weights, n, total, k, slice_docs), f"query long, id {kind}, score long"))
    release(postings)
    return found

