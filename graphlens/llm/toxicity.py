"""Toxicity by weak supervision: lexicon and pattern voters, a generative label model, a linear classifier."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.llm.common import LOWER, arrow_rows, cut, fresh_name, held_out, mix, prefix_sums, separators, text_blocks, with_schema, word_bounds
from graphlens.llm.quality import _sigmoid, labelled_sample, learnable, one_text_each

#: Words are runs of letters, digits and non-ASCII.
_SPLIT = separators((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
#: Word beginnings, in bytes, that a lexicon may hold beside whole words (0).
PREFIXES = (0, 4, 5, 6, 7, 8, 10)
#: Words that address the reader and words that tell what someone is, in English, German, French and Spanish.
_YOU = "you your you're ya u du dich dir dein deine euch ihr tu te toi ton ta vous votre tú tus ti usted ustedes vosotros"
_ARE = "are is were be being so such a an bist seid sind ist ein eine es êtes est un une eres es son sois una qué"


def lower_latin(raw: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A-Z and the capitals of Latin-1 in lower case."""
    out = LOWER[raw]
    capital = np.zeros(len(raw), bool)
    capital[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
    out[capital] += 32
    return out


def units(raw: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For whole words and each beginning: unit hashes and their rows; and the words of each row."""
    raw = lower_latin(raw)
    starts, stops, first = word_bounds(raw, offsets, _SPLIT)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    total, back = prefix_sums(raw)
    hashes, rows = [], []
    for k, size in enumerate(PREFIXES):
        long = np.flatnonzero(stops - starts > size) if size else np.arange(len(starts))
        a = starts[long]
        b = a + size if size else stops
        hashes.append(mix((total[b] - total[a]) * back[a], k))
        rows.append(row[long])
    return hashes, rows, np.diff(first)


def _count_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, body) to (unit, kind, toxic, clean): in how many of a task's texts a unit occurs."""
    for batch in batches:
        label = np.array(batch.column(0).to_pylist(), np.int64)
        parts: list[list] = [[] for _ in PREFIXES]
        for a, _, raw, offsets in text_blocks(batch.column(1)):
            hashes, rows, _ = units(raw, offsets)
            for k, (h, r) in enumerate(zip(hashes, rows, strict=True)):
                if len(h):
                    order = np.lexsort((r, h))
                    h, r = h[order], r[order]
                    new = np.ones(len(h), bool)
                    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
                    parts[k].append((h[new], label[a + r[new]]))
        for k, part in enumerate(parts):
            if part:
                h, y = (np.concatenate(x) for x in zip(*part, strict=True))
                unit, where = np.unique(h, return_inverse=True)
                toxic = np.bincount(where, y, len(unit)).astype(np.int64)
                every = np.bincount(where, minlength=len(unit))
                yield pa.RecordBatch.from_arrays([pa.array(unit.view(np.int64)), pa.array(np.full(len(unit), k, np.int32)), pa.array(toxic), pa.array(every - toxic)], names=["unit", "kind", "toxic", "clean"])


def _hashes_of(words: str) -> np.ndarray:
    raw = np.frombuffer(words.encode(), np.uint8)
    return np.unique(units(raw, np.array([0, len(raw)]))[0][0])


#: The voters that read a text's writing and know no lexicon.
PATTERNS = ("shouting", "capital words", "repeated marks", "masked words", "drawn-out letters", "addresses the reader", "tells the reader what they are", "one word over and over")


def patterns(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Votes of the pattern voters on each text: 1 (toxic), -1 (clean) or 0 (too little text to tell)."""
    rows = len(offsets) - 1
    per_row = lambda flags: np.diff(np.append(0, np.cumsum(flags, dtype=np.int64))[offsets])
    upper = (raw >= 65) & (raw <= 90)
    letter = upper | ((raw >= 97) & (raw <= 122)) | (raw >= 128)
    letters = per_row(letter)
    mark = np.isin(raw, np.frombuffer(b"!?", np.uint8))
    mask = np.isin(raw, np.frombuffer(b"*#@$", np.uint8))
    same = np.zeros(len(raw), bool)
    same[1:] = raw[1:] == raw[:-1]
    edge = offsets[1:-1][offsets[1:-1] < len(raw)]
    same[edge] = False
    twice_marked = mark & same
    thrice = np.zeros(len(raw), bool)
    thrice[2:] = same[2:] & same[1:-1] & ((raw[2:] >= 97) & (raw[2:] <= 122))
    masked = np.zeros(len(raw), bool)
    masked[1:-1] = mask[1:-1] & letter[:-2] & letter[2:]
    masked[offsets[:-1][offsets[:-1] < len(raw)]] = False
    hashes, owner, words = units(raw, offsets)
    word, row = hashes[0], owner[0]
    starts, stops, _ = word_bounds(raw, offsets, _SPLIT)
    capitals = np.append(0, np.cumsum(upper, dtype=np.int64))
    loud = (capitals[stops] - capitals[starts] == stops - starts) & (stops - starts >= 3)
    you, are = np.isin(word, _hashes_of(_YOU)), np.isin(word, _hashes_of(_ARE))
    beside = np.zeros(len(word), bool)
    again = np.zeros(len(word), bool)
    if len(word) > 1:
        together = row[1:] == row[:-1]
        beside[1:] = together & ((you[1:] & are[:-1]) | (you[:-1] & are[1:]))
        again[1:] = together & (word[1:] == word[:-1])
    of = lambda flags: np.bincount(row, flags, rows)
    found = [2 * per_row(upper) > letters, 10 * of(loud) >= np.maximum(1, words), per_row(twice_marked) > 0, per_row(masked) > 0]
    found += [per_row(thrice) > 0, 25 * of(you) >= np.maximum(1, words), of(beside) > 0, 2 * of(again) > words]
    return np.where(words[:, None] >= 5, np.where(np.column_stack(found), 1, -1), 0)


class Features:
    """Counts of lexicon units in texts, and the votes of lexicon and pattern voters on them."""

    def __init__(self, lexicon: list[tuple[int, int, float]], groups: int):
        """lexicon: (unit, kind, log-odds); groups: lexicons of whole words, and of beginnings, dealt by a unit's hash."""
        lexicon = sorted(lexicon)
        self.tables = []
        self.size = len(lexicon)
        whole = np.array([x[1] == 0 for x in lexicon], bool)
        dealt = mix(np.array([x[0] & (2**64 - 1) for x in lexicon], np.uint64), 99) % np.uint64(groups) if lexicon else np.zeros(0, np.uint64)
        self.group = np.where(whole, 0, groups) + dealt.astype(np.int64)
        self.groups = groups
        self.voters = 4 * groups + len(PATTERNS)
        for k in range(len(PREFIXES)):
            own = [(np.uint64(u & (2**64 - 1)), i) for i, (u, kind, _) in enumerate(lexicon) if kind == k]
            own.sort()
            self.tables.append((np.array([u for u, _ in own], np.uint64), np.array([i for _, i in own], np.int64)))

    def counts(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts by units: how often each occurs; and the texts' words."""
        hashes, rows, words = units(raw, offsets)
        out = np.zeros((len(words), max(1, self.size)))
        for (table, number), h, r in zip(self.tables, hashes, rows, strict=True):
            if len(table) and len(h):
                at = np.minimum(np.searchsorted(table, h), len(table) - 1)
                hit = table[at] == h
                np.add.at(out, (r[hit], number[at[hit]]), 1)
        return out, words

    def votes(self, counts: np.ndarray, words: np.ndarray, pattern: np.ndarray) -> np.ndarray:
        """1 (toxic), -1 (clean) or 0 (no vote) of every voter.

        Each lexicon votes twice: on whether the text has any of its units, and on whether it has them in one word of
        sixty or more. The pattern voters' votes follow.
        """
        out = np.zeros((len(words), self.voters))
        counts = counts[:, : self.size]
        for g in range(2 * self.groups):
            hits = counts[:, self.group == g].sum(axis=1)
            if (self.group == g).any():
                # A voter calls a text clean only if it is long enough to tell.
                out[:, 2 * g] = np.where(hits > 0, 1, np.where(words >= 5, -1, 0))
                out[:, 2 * g + 1] = np.where((hits > 0) & (60 * hits >= words), 1, np.where(words >= 5, -1, 0))
        out[:, 4 * self.groups :] = pattern
        return out

    def design(self, counts: np.ndarray, words: np.ndarray, pattern: np.ndarray) -> np.ndarray:
        """Inputs of the linear classifier."""
        hits = counts[:, : self.size].sum(axis=1)
        kinds = (counts[:, : self.size] > 0).sum(axis=1)
        sums = np.column_stack([hits, kinds, *[counts[:, : self.size][:, self.group == g].sum(axis=1) for g in range(2 * self.groups)]])
        dense = np.log1p(100 * sums / np.maximum(5, words)[:, None])
        return np.column_stack([np.log1p(counts[:, : self.size]), np.log1p(sums), dense, np.log1p(words) / 4, self.votes(counts, words, pattern), np.ones(len(words))])


def _tree(dependence: np.ndarray) -> list[int]:
    """Each voter's parent (-1: none) in the spanning tree of the greatest total dependence; independent voters get none."""
    m = len(dependence)
    parent, best = [-1] * m, np.full(m, -1.0)
    inside = np.zeros(m, bool)
    for _ in range(m):
        v = int(np.argmax(np.where(inside, -np.inf, best)))
        inside[v] = True
        closer = ~inside & (dependence[v] > np.maximum(best, 1e-3))
        best[closer] = dependence[v][closer]
        for w in np.flatnonzero(closer):
            parent[w] = v
    return parent


def label_model(votes: np.ndarray, prior: float, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of label 1, voters' accuracies, and the dependence of each pair of voters given the label.

    A generative model of the votes alone: the hidden label is 1 with probability ``prior``; each voter votes by the
    label and by one other voter, the parent that it depends on most once the label is known (a tree over the voters,
    by conditional mutual information). Expectation-maximisation estimates the voters' conditional rates, and the tree
    anew every fifth round. The first guess goes by the votes for 1, voters that say the same sharing one say. No
    label is read.
    """
    n, m = votes.shape
    shown = np.stack([votes == v for v in (-1.0, 0.0, 1.0)], axis=2).reshape(n, 3 * m).astype(np.float64)
    ones = (votes == 1).astype(np.float64)
    apart = ones - ones.mean(axis=0)
    scale = np.sqrt((apart**2).sum(axis=0)) + 1e-9
    alike = (apart.T @ apart / np.outer(scale, scale)) ** 4
    np.fill_diagonal(alike, 1)
    for_one = ones @ (1 / alike.sum(axis=1))
    # The first guess: the share ``prior`` of rows with the most votes for 1.
    order = np.argsort(np.argsort(-for_one, kind="stable"), kind="stable")
    posterior = np.clip(np.where(order < prior * n, 0.9, 0.1) * (for_one > 0), 0.02, 0.98)
    parent = [-1] * m
    dependence = np.zeros((m, m))
    own = np.zeros((2, m, 3))
    for step in range(rounds):
        pair = []  # of each label: how often voters i, j vote a, b
        for y, weight in enumerate((1 - posterior, posterior)):
            pair.append((shown * weight[:, None]).T @ shown)
            single = np.diag(pair[-1]).reshape(m, 3) + 0.5
            own[y] = single / single.sum(axis=1, keepdims=True)
        if step % 5 == 0:
            dependence = _dependence(pair, own)
            parent = _tree(dependence)
        z = np.full(n, np.log(prior / (1 - prior)))
        for v, p in enumerate(parent):
            if p < 0:
                z += shown[:, 3 * v : 3 * v + 3] @ (np.log(own[1, v]) - np.log(own[0, v]))
            else:
                # Rates given the parent's vote, drawn to the voter's own rates where the pair is rare.
                rate = [pair[y][3 * p : 3 * p + 3, 3 * v : 3 * v + 3] + 2 * own[y, v] for y in (0, 1)]
                odds = np.log(rate[1] / rate[1].sum(axis=1, keepdims=True)) - np.log(rate[0] / rate[0].sum(axis=1, keepdims=True))
                z += np.einsum("na,ab,nb->n", shown[:, 3 * p : 3 * p + 3], odds, shown[:, 3 * v : 3 * v + 3], optimize=True)
        new = _sigmoid(z)
        moved = np.abs(new - posterior).max()
        posterior = new
        if moved < 1e-6 and step > 4:
            break
    said = 1 - prior * own[1, :, 1] - (1 - prior) * own[0, :, 1]
    accuracy = (own[1, :, 2] * prior + own[0, :, 0] * (1 - prior)) / np.maximum(1e-9, said)
    return posterior, accuracy, dependence


def _dependence(pair: list[np.ndarray], own: np.ndarray) -> np.ndarray:
    """Mutual information of each two voters' votes given the label."""
    m = own.shape[1]
    total = sum(p[:3, :3].sum() for p in pair)
    out = np.zeros((m, m))
    for y in (0, 1):
        joint = pair[y].reshape(m, 3, m, 3) / max(1e-9, total)
        share = joint[0, :, 0, :].sum()
        apart = own[y][:, :, None, None] * own[y][None, None, :, :] * share
        out += np.where(joint > 0, joint * np.log(np.maximum(joint, 1e-300) / np.maximum(apart, 1e-300)), 0).sum(axis=(1, 3))
    np.fill_diagonal(out, 0)
    return np.maximum(out, 0)


def fit_linear(x: np.ndarray, target: np.ndarray, weight: np.ndarray, decay: float = 1e-3, rounds: int = 400) -> np.ndarray:
    """Weighted logistic regression on soft targets, by accelerated gradient steps."""
    weight = (weight / weight.sum()).astype(x.dtype)
    scale = np.sqrt(np.einsum("nk,nk,n->k", x, x, weight)) + 1e-3
    x = x / scale
    beta = ahead = np.zeros(x.shape[1])
    top = np.ones(x.shape[1])
    for _ in range(30):  # the greatest curvature, by power iteration
        top = x.T @ (weight * (x @ top))
        curve = np.linalg.norm(top)
        top /= max(1e-12, curve)
    step = 4 / (1.1 * curve + 4 * decay)
    for k in range(rounds):
        slope = x.T @ (weight * (_sigmoid(x @ ahead) - target)) + decay * ahead
        new = ahead - step * slope
        ahead = new + k / (k + 3) * (new - beta)
        beta = new
    return beta / scale


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample: int = 4000, lexicon: int = 400, groups: int = 4):
    """The scorer of a block of texts, learnt from at most ``sample`` labelled rows of each label that are not held out.

    Lexicons are the ``lexicon`` units at most that tell toxic rows of the sample best, dealt to ``groups`` voters of either kind.

    Defined results: rows without a label, id or text do not teach; with labels of one value only, every text scores that
    value (0 without labels); of rows with one id one text teaches.
    """
    chosen = labelled_sample(labels, label, id_col, sample)
    every = {r[0]: r[1] for r in learnable(labels, label, id_col).groupBy("label").count().collect()}
    texts = cut(one_text_each(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")), chosen, "body").select("label", "body"))
    got = {r[0]: r[1] for r in texts.groupBy("label").count().collect()}
    if len(got) < 2:
        constant = float(next(iter(got))) if got else 0.0
        return lambda raw, offsets: np.full(len(offsets) - 1, constant)
    prior = every[1] / (every[0] + every[1])
    counted = texts.mapInArrow(_count_units, "unit long, kind int, toxic long, clean long").groupBy("unit", "kind").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    least = max(3, got[1] // 200)
    odds = F.log((F.col("toxic") + 0.1) / (got[1] + 0.2)) - F.log((F.col("clean") + 0.1) / (got[0] + 0.2))
    telling = counted.where(F.col("toxic") >= least).withColumn("odds", odds).where(F.col("odds") > 2)
    best = telling.orderBy((F.col("odds") * F.sqrt("toxic")).desc(), "kind", "unit").limit(lexicon).collect()
    features = Features([(r.unit, r.kind, r.odds) for r in best], groups)
    weights = _fit(texts, features, prior, got)

    def score(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return _sigmoid(features.design(*features.counts(raw, offsets), patterns(raw, offsets)) @ weights)

    return score


def add_toxicity(docs: DataFrame, labels: DataFrame, name: str = "toxicity", id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with the probability that they are toxic, from their whole texts, in one pass without a shuffle.

    The column gets underscores where its name is taken.

    Defined results: null texts score as empty ones, and every text scores between 0 and 1; equal texts score alike, whatever
    their ids and other columns; labels as in ``fit_toxicity``; empty table - no rows.
    """
    scorer = fit_toxicity(docs, labels, id_col=id_col, text_col=text_col, **options)
    place = docs.columns.index(text_col)
    name = fresh_name(docs, name)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [scorer(raw, offsets) for _, _, raw, offsets in text_blocks(batch.column(place))]
            yield arrow_rows(batch, batch.schema, **{name: pa.array(np.concatenate(out) if out else [], pa.float64())})

    return docs.mapInArrow(score, with_schema(docs, **{name: "double"}))


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, **options) -> DataFrame:
    """One row per document: ``id_col``, held_out, score (probability of label 1), predicted (1 if score >= ``threshold``).

    Lexicons are the words and word beginnings that are telling on at most ``sample`` labelled rows of each label, none
    of them held out (crc32 of the id as text, modulo 4, is 2). Lexicon voters and pattern voters, which read how a
    text is written, vote on those rows; the generative label model turns the votes alone into posteriors, and a
    linear classifier learns the posteriors; the sample's labels set the level of its scores. It then scores every whole
    text in one pass without a shuffle. Only the text is an input of the score.

    Defined results: null and empty texts are scored like a text without words; with no labels, or one kind only, the
    score is 0 or that label's value for all; an id with several labels counts as its largest, and of several texts of
    one labelled id the smallest is learnt from; a null id is not held out and teaches nothing; further columns of
    either table, of any name, are not read; empty table - no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    known = labels.select(F.col(id_col).alias("id"), F.col(options.get("label", "toxic")).alias(options.get("label", "toxic")))
    scored = add_toxicity(rows, known, "score", "id", "body", **options)
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def remove_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, **options) -> DataFrame:
    """The documents' own columns and rows, without the rows whose score (``toxicity_scores``) reaches the threshold.

    Defined results: texts are not changed; null and empty texts are scored like a text without words; rows equal in
    the text stay or go together, whatever their ids; without labels of both kinds the score is constant (0 without
    any, so all stay); empty table - no rows.
    """
    scored = add_toxicity(docs, labels, "toxicity", id_col, text_col, **options)
    return scored.where(F.col(scored.columns[-1]) < threshold).select(*[scored[c] for c in docs.columns])


def _fit(texts: DataFrame, features: Features, prior: float, got: dict[int, int]) -> np.ndarray:
    """The classifier's weights, from the votes on the bounded sample."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, words, seen = [], [], []
            for _, _, raw, offsets in text_blocks(batch.column(1)):
                c, w = features.counts(raw, offsets)
                counts += [x.astype(np.float32).tobytes() for x in c]
                seen += [x.astype(np.int8).tobytes() for x in patterns(raw, offsets)]
                words += w.tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.binary()), pa.array(seen, pa.binary()), pa.array(words, pa.int64())], names=["label", "counts", "patterns", "words"])

    # At most 2 * sample rows of as many numbers as the lexicon has units.
    rows = texts.mapInArrow(measure, "label int, counts binary, patterns binary, words long").toPandas()
    counts = np.array([np.frombuffer(x, np.float32) for x in rows.pop("counts")])
    pattern = np.array([np.frombuffer(x, np.int8) for x in rows.pop("patterns")])
    words = rows["words"].to_numpy()
    drawn = got[1] / (got[0] + got[1])
    votes = features.votes(counts, words, pattern)
    # Labels check the voters: one that is right no more often than chance is left out of the model.
    label = rows["label"].to_numpy() > 0
    better = np.array([useful(v, label) for v in votes.T], bool)
    posterior, _, _ = label_model(votes[:, better], drawn) if better.any() else (np.full(len(label), drawn), None, None)
    # The sample has more of the rarer label than all labelled rows have: weights set the shares right.
    weight = posterior * prior / drawn + (1 - posterior) * (1 - prior) / (1 - drawn)
    design = features.design(counts, words, pattern).astype(np.float32)
    weights = fit_linear(design, posterior, weight)
    slope, offset = _level(design @ weights, label, np.where(label, prior / drawn, (1 - prior) / (1 - drawn)))
    weights *= slope
    weights[-1] += offset
    return weights


def _level(logit: np.ndarray, label: np.ndarray, weight: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and offset that turn logits into log-odds of the labels: the classifier orders texts, labels say how high its scores are.

    Weighted logistic regression by damped Newton steps. Targets are drawn in by one row of either label, so that separable
    labels give finite values. Logits that do not rise with the label stay as they are.
    """
    ones = int(label.sum())
    target = np.where(label, (ones + 1) / (ones + 2), 1 / (len(label) - ones + 2))
    x = np.column_stack([logit, np.ones(len(logit))]).astype(np.float64)
    at = np.array([1.0, 0.0])

    def loss(at: np.ndarray) -> float:
        z = x @ at
        return float(weight @ (np.logaddexp(0, z) - target * z))

    for _ in range(rounds):
        p = _sigmoid(x @ at)
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + 1e-9 * np.eye(2), x.T @ (weight * (p - target)))
        size = 1.0
        while size > 1e-6 and loss(at - size * step) > loss(at):
            size /= 2
        at = at - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return (float(at[0]), float(at[1])) if at[0] > 0 else (1.0, 0.0)


def useful(vote: np.ndarray, label: np.ndarray) -> bool:
    """Whether votes for 1 fall on label 1 more often than on label 0."""
    rate = [((vote == 1) & (label == y)).sum() / max(1, (label == y).sum()) for y in (False, True)]
    return bool(rate[1] > 1.2 * rate[0] + 0.005)
