"""The dedup, sharding and decontamination operators against plain brute-force versions."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from graphlens.llm import automaton, decontaminate, exact, lines, sharding, simhash, substring
from graphlens.llm.components import connected_components

SF = "/root/testdata/sf0.001"
WORDS = [f"w{i}" for i in range(40)]


def corpus():
    rng = random.Random(5)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    passage, item = say(60), say(20)
    texts = [None, "", " \n\t ", "one", "One  TWO", "été à la plage", say(400), passage]
    texts += [say(30) + " " + passage + "\n" + say(30) for _ in range(5)]
    texts += ["same line\nother line\nthird", "same line\nother line\nlast", "x\nx\nx"]
    base = say(120).split()
    for i in range(6):
        near = list(base)
        near[i * 7] = "changed"
        texts.append(" ".join(near))
    texts += [texts[6]] * 3 + [say(5) + " " + item + " " + say(8), item, "A-B, " + item.replace(" ", ", ").upper()]
    return [(i, t) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus() + [(None, "null id"), (3, "one"), (4, "another text of a known id")]
    return spark.createDataFrame([(i, t, "extra", 7) for i, t in rows], "doc_id long, text string, fp string, pos int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


def pairs_of(frame):
    return [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]


def test_exact(spark, docs, empty):
    for frame, weak in ((docs, None), (docs, lambda t: F.length(t) % 3), (real(spark), None)):
        groups = defaultdict(list)
        for i, t in pairs_of(frame):
            groups[t or ""].append(i)
        want = []
        for t, ids in groups.items():
            keep = max((x for x in ids if x is not None), default=None)
            want += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
        got = [tuple(r) for r in exact.exact_dedup(frame, keep="max", content_hash=weak).collect()]
        assert sorted(got, key=str) == sorted([(a, b, c, True if b is None else d, e) for a, b, c, d, e in want], key=str)
    assert exact.exact_dedup(empty).count() == 0


def test_sharding(spark, docs, empty):
    for frame, shards in ((docs, 3), (real(spark), 40)):
        rows = sharding.shard_by_bytes(frame, shards).collect()
        assert len(rows) == frame.count()
        total, biggest = sum(r["size"] for r in rows), max(r["size"] for r in rows)
        by = defaultdict(list)
        for r in rows:
            by[r.shard].append(r)
        want = sorted((i is not None, i or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in pairs_of(frame))
        assert want == sorted((r.doc_id is not None, r.doc_id or 0, r["size"], r.text_crc32) for r in rows)
        for k, own in by.items():
            assert 0 <= k < shards and sorted(r.slot for r in own) == list(range(len(own)))
            assert abs(sum(r["size"] for r in own) - total / shards) <= 2 * biggest
        # In order of the first id of a text; a text's documents in one shard, unless they have more bytes than the largest.
        first, sizes, where = {}, defaultdict(int), defaultdict(set)
        for i, t in pairs_of(frame):
            crc = zlib.crc32((t or "").encode())
            first[crc] = min(first.get(crc, 1 << 60), 1 << 60 if i is None else i)
            sizes[crc] += len((t or "").encode()) + 16
        ordered = [r for r in sorted(rows, key=lambda r: (r.shard, r.slot)) if first[r.text_crc32] < 1 << 60 and r.doc_id is not None]
        assert [(first[r.text_crc32], r.doc_id) for r in ordered] == sorted((first[r.text_crc32], r.doc_id) for r in ordered)
        for r in rows:
            where[r.text_crc32].add(r.shard)
        assert all(len(where[crc]) == 1 for crc, size in sizes.items() if size <= biggest)
    same = spark.createDataFrame([(i, "one and the same text") for i in range(500)], "doc_id long, text string")
    assert {r["n"] for r in sharding.shard_by_bytes(same, 10).groupBy("shard").agg(F.count("*").alias("n")).collect()} == {50}
    assert sharding.shard_by_bytes(empty).count() == 0


def brute_print(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes) > 0)


def brute_components(prints, distance=4):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(prints):
        for j, (_, b) in enumerate(prints[:i]):
            if (a ^ b).bit_count() <= distance:
                root[find(i)] = find(j)
    low = {}
    for i, (doc, _) in enumerate(prints):
        if doc is not None:
            low[find(i)] = min(doc, low.get(find(i), doc))
    return [(doc, f"{p:016x}", low.get(find(i))) for i, (doc, p) in enumerate(prints)]


@pytest.mark.parametrize("options", [{}, {"plan": simhash.tables(4, 1 << 28), "hot": 1}])
def test_simhash(spark, docs, empty, options):
    for frame in (docs, real(spark)):
        want = brute_components([(i, brute_print(t)) for i, t in pairs_of(frame)])
        got = [tuple(r) for r in simhash.simhash_components(frame, **options).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert simhash.simhash_components(empty).count() == 0


def test_simhash_links_of_dense_prints(spark):
    rng = random.Random(1)
    prints = {0}
    for _ in range(120):
        prints.add(rng.choice(sorted(prints)) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6))))
    prints |= {rng.getrandbits(64) for _ in range(50)}
    prints = sorted(prints)
    want = {f"{p:016x}": c for _, h, c in brute_components([(i, p) for i, p in enumerate(prints)]) for p in [int(h, 16)]}
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    for hot, rows in ((4096, 0), (2, 0), (4096, 1 << 28), (2, 1 << 28), (4096, 1 << 60)):
        plan = simhash.tables(4, rows)
        assert len(plan) == {0: 3, 1 << 28: 10, 1 << 60: 2}[rows]
        parts = {r.node: r.component for r in connected_components(simhash.near_links(frame, plan=plan, hot=hot)).collect()}
        groups = defaultdict(set)
        for p in prints:
            s = p - (1 << 64) if p >> 63 else p
            groups[parts.get(s, s)].add(f"{p:016x}")
        brute = defaultdict(set)
        for h, c in want.items():
            brute[c].add(h)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, brute.values()))


def test_simhash_of_very_long_texts():
    rng = random.Random(4)
    text = " ".join(rng.choice(WORDS) for _ in range(200_000))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([text, None, "a"])], names=["id", "t"])
    got = pa.Table.from_batches(simhash._fingerprints(1, 4, 42, "fp", [0])(iter([batch]))).to_pydict()
    assert got["id"] == [1, 2, 3] and [x % (1 << 64) for x in got["fp"]] == [brute_print(text), 0, brute_print("a")]


def test_simhash_dedup_keeps_one_of_each(spark, docs):
    rows = pairs_of(docs)
    prints = [brute_print(t) for _, t in rows]
    left, classes = set(range(len(rows))), 0
    while left:
        reached, classes = {left.pop()}, classes + 1
        while near := {j for j in left for i in reached if (prints[i] ^ prints[j]).bit_count() <= 4}:
            reached |= near
            left -= near
    got = simhash.simhash_dedup(docs)
    assert got.columns == docs.columns and got.count() == classes


def test_simhash_dedup_tells_rows_of_equal_id_apart_by_text(spark):
    rng = random.Random(8)
    a, b, c, d, e, f = (" ".join(rng.choices("abcdefghijklmnop", k=200)) for _ in range(6))
    rows = [(None, a), (None, b), (None, c), (5, d), (5, e), (5, c), (3, c), (7, f), (7, f), (None, None), (6, "")]
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, hash int")
    got = simhash.simhash_dedup(frame)
    assert got.columns == frame.columns
    # Row (5, c) is a copy of document 3, (None, c) too, and the null text one of document 6.
    want = [(None, a), (None, b), (5, d), (5, e), (3, c), (7, f), (6, "")]
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, want))
    tied = frame.withColumn("doc_id", F.lit(None).cast("long")).where(F.col("text").isNull() | (F.col("text") == ""))
    assert simhash.simhash_dedup(tied).count() == 1


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_contamination(documents, items):
    out = []
    for i, t in documents:
        words, hit, found = bench_words(t), set(), set()
        for item, body in items:
            own = bench_words(body)
            n = min(13, len(own))
            windows = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if own else set()
            for k in range(len(words) - n + 1):
                if tuple(words[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found.add(str(item))
        out.append((i, len(words), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(words)))
    return out


@pytest.mark.parametrize("block_words", [1 << 17, 40])
def test_contamination(spark, docs, empty, block_words):
    own = corpus()[-2][1]
    items = [(1, own), (2, own + " w1 w2"), (3, "w1 w2 w3"), (4, None), (5, "!!"), (6, "w5"), (7, " ".join(own.split()[2:18])), (8, own)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    tables = [(docs, bench)] if block_words == 40 else [(docs, bench), (real(spark), spark.read.parquet(f"{SF}/benchmark.parquet"))]
    for frame, table in tables:
        want = brute_contamination(pairs_of(frame), [(r.item_id, r.text) for r in table.collect()])
        rows = decontaminate.contamination(frame, table, block_words=block_words).collect()
        got = [(r.doc_id, r.bench_words, r.bench_hit, r.bench_items, r.contaminated) for r in rows]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(docs, empty.select(F.col("doc_id").alias("item_id"), "text")).where("contaminated").count() == 0


def test_spans_are_cut(spark):
    item = " ".join(WORDS[:20])
    texts = ["é " + "z " * 500 + item + " tail " + "y " * 300, item, "clean words only"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r.doc_id: r.text for r in decontaminate.remove_contamination(frame, bench).collect()}
    assert got == {0: texts[0].replace(item, ""), 2: texts[2]}


def brute_substrings(documents, width=50):
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in documents]
    first = {}
    for i, words in split:
        if i is not None:
            for k in range(len(words) - width + 1):
                w = tuple(words[k : k + width])
                first[w] = min(i, first.get(w, i))
    out = []
    for i, words in split:
        gone = set()
        for k in range(len(words) - width + 1):
            if i is not None and first[tuple(words[k : k + width])] < i:
                gone |= set(range(k, k + width))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("width", [50, 7, 1])
def test_substrings(spark, docs, empty, width):
    for frame in (docs, real(spark)):
        got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.substring_dedup(frame, width).collect()]
        assert sorted(got, key=str) == sorted(brute_substrings(pairs_of(frame), width), key=str)
    assert substring.substring_dedup(empty).count() == 0


@pytest.mark.parametrize("shard_words", [1 << 17, 300])
def test_reference_spans(spark, docs, empty, shard_words):
    texts = [t for _, t in corpus()][6:12]
    reference = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string")
    windows = {tuple(w[k : k + 20]) for t in texts for w in [t.split()] for k in range(len(w) - 19)}
    rows = substring.reference_spans(docs, reference, 20, shard_words=shard_words).collect()
    assert len(rows) == docs.count()
    for r in rows:
        words = (r.text or "").split()
        want = {p for k in range(len(words) - 19) if tuple(words[k : k + 20]) in windows for p in range(k, k + 20)}
        assert {p for s in r.reference_spans for p in range(s.a, s.b)} == want
    cut_texts = {(r.doc_id, len((r.text or "").split())) for r in substring.remove_reference(docs, reference, 20, shard_words=shard_words).collect()}
    marked = {(r.doc_id, len((r.text or "").split()) - len({p for s in r.reference_spans for p in range(s.a, s.b)})) for r in rows}
    assert cut_texts == marked
    assert substring.reference_spans(empty, reference).count() == 0


def test_twenty_blocks_and_one_item_longer_than_a_block(spark):
    """Blocks stay bounded however long an item is, and every window is found in whichever block has it."""
    rng = random.Random(21)
    long = [f"v{rng.randrange(500)}" for _ in range(9000)]
    items = [(0, " ".join(long))] + [(i, " ".join(f"u{i}x{j}" for j in range(60))) for i in range(1, 180)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = bench.select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("body"))
    blocks = automaton.automata(rows, decontaminate.words_of, 13, 1000, piece=500).collect()
    assert len(blocks) >= 20 and max(len(r.payload) for r in blocks) < 1_000_000
    texts = [" ".join(["x"] * 9 + long[8_000 - n : 8_000 + n] + ["y"]) for n in (6, 7, 40, 700)] + [items[90][1], "nothing here", items[90][1]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = decontaminate.contamination(docs, bench, block_words=1000).collect()
    assert sorted((r.doc_id, r.bench_hit, r.bench_items) for r in got) == [(0, 0, []), (1, 14, ["0"]), (2, 80, ["0"]), (3, 1400, ["0"]), (4, 60, ["90"]), (5, 0, []), (6, 60, ["90"])]


def brute_lines(documents, least):
    """(id, n_lines, n_removed, kept text, runs): runs by growing every run of lines until it has no earlier copy."""
    from pyspark.sql import SparkSession

    session = SparkSession.active()
    frame = session.createDataFrame(documents, "id long, t string").withColumn("k", F.xxhash64(F.coalesce("t", F.lit(""))))
    keys = {(r.id, r.t): r.k for r in frame.collect()}
    order = sorted({d for d in documents if d[1] is not None}, key=lambda d: (d[0] is not None, d[0] or 0, keys[d]))
    seen, result = set(), {}
    for d in order:
        parts, gone, shared = d[1].split("\n"), set(), {}
        for k in range(len(parts)):
            runs = [tuple(parts[k:e]) for e in range(k + 1, len(parts) + 1)]
            lcp = next((j for j, run in enumerate(runs) if run not in seen), len(runs))
            if lcp >= least:
                gone |= set(range(k, k + lcp))
                shared[k] = lcp
            seen.update(runs)
        heads = [(k, n) for k, n in sorted(shared.items()) if shared.get(k - 1) != n + 1]
        result[d] = (len(parts), len(gone), "\n".join(p for k, p in enumerate(parts) if k not in gone), heads)
    return [(d[0], *result.get(d, (0, 0, None, []))) for d in documents]


def line_rows(frame, least):
    return [(r.doc_id, r.n_lines, r.n_removed, r.kept_text, [tuple(x) for x in r.line_runs]) for r in lines.line_dedup(frame, min_lines=least).collect()]


@pytest.mark.parametrize("least", [1, 2, 6])
def test_lines(spark, docs, empty, least):
    for frame in (docs, real(spark)):
        assert sorted(line_rows(frame, least), key=str) == sorted(brute_lines(pairs_of(frame), least), key=str)
    assert lines.line_dedup(empty).count() == 0


def test_runs_of_few_different_lines(spark):
    """Texts over three lines share runs of all lengths; every longest prefix must be found, and blank lines alone stay."""
    rng = random.Random(17)
    texts = ["\n".join(rng.choice(["a", "b", ""]) for _ in range(rng.randint(1, 60))) for _ in range(25)]
    texts += ["\n".join(["x"] * 50), texts[3], texts[4] + "\n" + texts[3], "one\n\ntwo", "three\n\nfour"]
    rows = list(enumerate(texts)) + [(None, texts[5]), (2, texts[6])]
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, n_lines int, base int")
    for least in (1, 3):
        got = [(r.doc_id, r.n_lines_, r.n_removed, r.kept_text, [tuple(x) for x in r.line_runs]) for r in lines.line_dedup(frame, min_lines=least).collect()]
        assert sorted(got, key=str) == sorted(brute_lines(rows, least), key=str)
    kept = {r.doc_id: r.text for r in lines.remove_repeated_lines(frame).collect()}
    assert kept[28] == "one\n\ntwo" and kept[29] == "three\n\nfour"


def test_very_long_texts_go_through_whole(spark):
    """Texts of about a megabyte, one a copy with more at its end, in line, exact and substring dedup, sharding and decontamination."""
    long = "\n".join(" ".join(f"w{i}x{j}" for j in range(30)) for i in range(4000))
    more = "first\n" + long + "\nlast"
    frame = spark.createDataFrame([(1, long), (2, more), (3, None), (4, long)], "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_removed, [tuple(x) for x in r.line_runs]) for r in lines.line_dedup(frame).collect()}
    assert got == {1: (4000, 0, []), 2: (4002, 4000, [(1, 4000)]), 3: (0, 0, []), 4: (4000, 4000, [(0, 4000)])}
    assert {r.doc_id: (r.keep_id, r.group_size) for r in exact.exact_dedup(frame, keep="max").collect()} == {1: (4, 2), 2: (2, 1), 3: (3, 1), 4: (4, 2)}
    sizes = {r.doc_id: r["size"] for r in sharding.shard_by_bytes(frame, 4).collect()}
    assert sizes == {1: len(long) + 16, 2: len(more) + 16, 3: 16, 4: len(long) + 16}
    removed = {r.doc_id: (r.n_words, r.n_removed) for r in substring.substring_dedup(frame).collect()}
    assert removed == {1: (120_000, 0), 2: (120_002, 120_000), 3: (0, 0), 4: (120_000, 120_000)}
    item = " ".join(f"w3999x{j}" for j in range(30))
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    hits = {r.doc_id: (r.bench_hit, r.contaminated) for r in decontaminate.contamination(frame, bench).collect()}
    assert hits == {1: (30, False), 2: (30, False), 3: (0, False), 4: (30, False)}
