"""Vector near-duplicates, ranked search and fill-in-the-middle against plain brute-force versions."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphlens.llm import fim, search, vectors

SF = "/root/testdata/sf0.001"


# --- vectors ------------------------------------------------------------------------------------------------------


def linked(rows, cosine):
    """id, n_links and smallest reachable id of every row (id, vector, label), all pairs compared."""
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) and label is not None for _, v, label in rows]
    near = [[] for _ in rows]
    for i, (_, v, label) in enumerate(rows):
        for j, (_, w, other) in enumerate(rows[:i]):
            if ok[i] and ok[j] and label == other and len(v) == len(w):
                a, b = np.array(v, np.float64), np.array(w, np.float64)
                if a @ b / math.sqrt(a @ a) / math.sqrt(b @ b) >= cosine:
                    near[i].append(j)
                    near[j].append(i)
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        low = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((rows[i][0], len(near[i]), low, rows[i][0] is not None and rows[i][0] == low))
    return sorted(out, key=str)


def clustered(seed, dim, groups, single):
    rng = np.random.default_rng(seed)
    rows = []
    for size, spread in groups:
        centre = rng.normal(size=dim)
        centre /= np.linalg.norm(centre)
        rows += [(centre + rng.normal(size=dim) * spread / math.sqrt(dim)).astype(np.float32).tolist() for _ in range(size)]
    rows += rng.normal(size=(single, dim)).astype(np.float32).tolist()
    rng.shuffle(rows)
    return [(i, v, int(i % 7 == 0)) for i, v in enumerate(rows)]


def result(frame):
    return sorted([tuple(r) for r in frame.select("vec_id", "n_links", "component_id", "kept").collect()], key=str)


SCHEMA = "vec_id long, embedding array<float>, label int, node long, weight string"


@pytest.mark.parametrize(("dim", "more"), [(64, {}), (64, {"bits": 5, "tile": 40}), (64, {"bits": 3, "tile": 16, "centres": 8}), (24, {"bits": 7, "width": 4, "cosine": 0.9}), (3, {"cosine": 0.99, "bits": 4})])
def test_vectors_equal_brute_force(spark, dim, more):
    # Tight groups, one as wide as the limit itself, and a chain of both.
    rows = clustered(dim, dim, [(60, 0.12), (40, 0.27), (30, 0.4), (12, 0.02)], 80)
    frame = spark.createDataFrame([(i, v, c, 1, "x") for i, v, c in rows], SCHEMA)
    assert result(vectors.near_vectors(frame, **more)) == linked(rows, more.get("cosine", 0.93))


def test_dense_groups_are_counted_not_compared(spark):
    rows = [(i, v, 0) for i, v, _ in clustered(3, 64, [(150, 0.1), (120, 0.3)], 40)]
    frame = spark.createDataFrame([(i, v, c, 1, "x") for i, v, c in rows], SCHEMA)
    nodes = frame.select("vec_id", "label", "embedding").mapInArrow(vectors._pack, "id long, label int, packed binary")
    nodes = nodes.select(F.col("id").alias("node"), F.col("label").cast("string").alias("label"), "packed", F.lit(1).cast("long").alias("weight"))
    plan = vectors.Plan(0.93, 8, 0)
    crowded = spark.createDataFrame([("0", 64, b, 0, len(rows)) for b in range(8)], "label string, dim int, block int, cell long, count long")
    grouped, more = vectors._groups(nodes, crowded, plan, 50, 64, 4)
    held = grouped.where("grouped").count()
    assert held >= 140
    # What is counted against groups is what brute force finds against their vectors.
    inside = {r.node for r in grouped.where("grouped").collect()}
    units = vectors.units(np.array([v for _, v, _ in rows], np.float64))
    near = units @ units.T >= 0.93
    want = {i: int(sum(near[i, j] for j in inside if j != i)) for i in range(len(rows))}
    got = {r.node: r.n for r in more.groupBy("node").agg(F.sum("n").alias("n")).collect()}
    assert {i: n for i, n in want.items() if n} == {i: n for i, n in got.items() if n}


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [nan, 1.0], 0), (5, [inf, 1.0], 0), (6, [None, 1.0], 0), (7, [1.0, 0.0], None), (8, [1.0, 0.0], 0), (9, [2.0, 0.0], 0)]
    rows += [(10, [1.0, 0.0, 0.0], 0), (None, [3.0, 0.0], 0), (11, [1.0, 0.0], 1), (8, [1.0, 0.0], 0), (12, [1e38, 1e-38], 0), (13, [-1.0, 0.0], 0), (None, [0.0, 5.0], 2), (14, [1e-45, 0.0], 0)]
    frame = spark.createDataFrame([(i, v, c, 1, "x") for i, v, c in rows], SCHEMA)
    assert result(vectors.near_vectors(frame)) == linked(rows, 0.93)
    wide = frame.withColumn("embedding", F.col("embedding").cast("array<double>"))
    assert result(vectors.near_vectors(wide)) == linked(rows, 0.93)
    assert vectors.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    assert vectors.near_vectors(frame, label_col=None).where("n_links > 0").count() == 8


def test_a_rotation_keeps_angles_and_does_not_depend_on_neighbours():
    rows = vectors.units(np.random.default_rng(1).normal(size=(50, 40)))
    turned = vectors.rotated(rows, 7)
    assert np.allclose(turned @ turned.T, rows @ rows.T)
    assert (vectors.rotated(rows[17:18], 7) == turned[17:18]).all()


# --- ranked search ------------------------------------------------------------------------------------------------


def terms(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def ranking(docs, queries, k):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n, total = len(counted), sum(x[2] for x in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in queries:
        scores = []
        for i, c, size in counted:
            m = 75 + 25 * size * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            scores.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted((x for x in scores if x[0] < 0), key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def found(frame):
    return sorted([tuple(r) for r in frame.select("item_id", "rank", "doc_id", "score").collect()], key=str)


@pytest.mark.parametrize("more", [{}, {"slice_docs": 1}, {"block_bytes": 200}])
def test_search_equals_brute_force(spark, more):
    rng = random.Random(2)
    pool = [f"w{i}" for i in range(300)] + ["Été", "été", "x", "Ж"]
    say = lambda n: " ".join(pool[min(int(rng.expovariate(0.03)), len(pool) - 1)] for _ in range(n))
    docs = [(i, say(rng.randint(0, 60))) for i in range(700)] + [(9000 + i, "same words here") for i in range(30)]
    docs += [(None, "same words here"), (5, None), (6, ""), (7, "w1 " * 5000), (7, "W1,w2;w299")]
    queries = [(i, say(12)) for i in range(8)] + [(50, "same WORDS"), (51, "nothing-of-this zzz"), (52, None), (53, "w1 w1 w1"), (50, "w299"), (None, "été x")]
    frame = spark.createDataFrame([(i, t, "e", 1) for i, t in docs], "doc_id long, text string, id string, n long").repartition(3)
    asked = spark.createDataFrame([(i, t, 0) for i, t in queries], "item_id long, text string, query long")
    assert found(search.ranked_search(frame, asked, 20, **more)) == ranking(docs, queries, 20)


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert search.ranked_search(none, asked).count() == 0
    assert search.ranked_search(spark.createDataFrame([(1, "a")], "doc_id long, text string"), asked.limit(0)).count() == 0


def test_treaps_leave_out_blocks_that_cannot_enter():
    rng = np.random.default_rng(3)
    size = search.BLOCK * 60
    doc = np.concatenate([np.sort(rng.choice(size, n, replace=False)) for n in (9000, 400, 30)])
    term = np.repeat([0, 1, 2], [9000, 400, 30])
    tf = rng.integers(1, 4, len(doc))
    part = search.Slice(rng.integers(20, 400, size), doc, term, tf, np.array([5, 3000, 9000]), size, size * 200)
    for tree in part.treaps.values():  # search order and heap order
        for x in range(len(tree.block)):
            for y, side in ((tree.left[x], -1), (tree.right[x], 1)):
                assert y < 0 or ((tree.block[y] - tree.block[x]) * side > 0 and tree.impact[y] <= tree.impact[x])
    docs, scores, scored = part.top([0, 1, 2], [1, 1, 2], 10)
    plain = np.zeros(size, np.int64)
    for t, w in ((0, 5), (1, 3000), (2, 18000)):
        own = np.flatnonzero(term == t)
        order = np.argsort(doc[own])
        a = np.flatnonzero(np.sort(term) == t)
        np.add.at(plain, doc[own][order], w * part.impact[a])
    best = np.lexsort((np.arange(size), -plain))[:10]
    assert docs.tolist() == best.tolist() and scores.tolist() == plain[best].tolist()
    assert scored < 40


# --- fill in the middle -------------------------------------------------------------------------------------------


def middle(doc_id, text):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n = len(units)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in fim.MARKS) or h[2] % 100 >= 50:
        return doc_id, text, n, "plain", text, None, None
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return doc_id, text, n, "spm", f"<S>{suf}<P>{pre}<M>{mid}", len(pre), len(mid)
    return doc_id, text, n, "psm", f"<P>{pre}<S>{suf}<M>{mid}", len(pre), len(mid)


@pytest.mark.parametrize("chunk", [1 << 20, 7, 1])
def test_fill_in_middle_equals_brute_force(spark, chunk):
    rng = random.Random(4)
    texts = ["", " ", "  \n ", "one", " one", "one ", "été à\tla\x0bplage x  y", "a <P> b", "<M>", "<S", "<<S>", "P>", "\x85 \x1c word"]
    texts += ["".join(rng.choice("ab é\n \t字<S>PM") for _ in range(rng.randint(1, 90))) for _ in range(300)]
    rows = list(enumerate(texts)) + [(None, "no id at all here"), (3, None), (4, texts[20]), (-7, "minus one two"), (4, texts[20])]
    frame = spark.createDataFrame([(i, t, "k", 3) for i, t in rows], "doc_id long, text string, key string, fim_n int").repartition(3)
    out = fim.fill_in_middle(frame, chunk=chunk)
    assert out.columns[:5] == ["doc_id", "text", "key", "fim_n", "fim_n_"]
    got = [(r.doc_id, r.text or "", r.fim_n_, r.fim_form, r.fim_output, r.fim_prefix_chars, r.fim_middle_chars) for r in out.collect()]
    assert sorted(got, key=str) == sorted([middle(i, t) for i, t in rows], key=str)
    back = fim.restore(out).select("text", "restored").collect()
    assert len(back) == len(rows) and all((r.text or "") == r.restored for r in back)
    assert fim.fill_in_middle(frame.limit(0), chunk=chunk).count() == 0


def test_real_texts_in_small_chunks(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = [(r.doc_id, r.text or "", r.fim_n, r.fim_form, r.fim_output, r.fim_prefix_chars, r.fim_middle_chars) for r in fim.fill_in_middle(docs, chunk=500).collect()]
    assert sorted(got, key=str) == sorted([middle(r.doc_id, r.text) for r in docs.collect()], key=str)


def test_compose_is_associative():
    rng = random.Random(6)
    raw = np.array([rng.choice(b"ab \n") for _ in range(400)], np.uint8)
    edges = sorted({0, 400, *(rng.randint(1, 399) for _ in range(30))})
    parts = [raw[a:b] for a, b in zip(edges, edges[1:], strict=False)]
    entry, before, total = fim.compose([fim.transfer(p) for p in parts])
    for k, at in enumerate(edges[:-1]):
        head = bytes(raw[:at])
        assert entry[k] == (head[-1:] not in (b"", b" ", b"\n")) and before[k] == len(re.findall(rb"[ab](?=[ \n])", bytes(raw[: at + 0]) + b"a"))
    assert total == len(re.findall(rb"[ab](?=[ \n])", bytes(raw)))
