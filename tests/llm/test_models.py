"""SentencePiece, HTML extraction, quality and toxicity: brute force, exact round trips and held-out accuracy."""

import math
import random
import re
import time
import zlib

import numpy as np
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2
from pyspark.sql import functions as F

from graphlens.llm import html, pieces, quality, toxicity
from graphlens.llm.html_pages import labelled_pages
from graphlens.llm.queries import QUERIES, TOKENIZER

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=TOKENIZER)


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary(open(TOKENIZER, "rb").read())


def texts():
    rng = random.Random(2)
    return ["", "a", " a", "  a  b ", "\n\n a\n", "日本語テキスト🙂 ok", " " * 40 + "z", "ab" * 200 + " q", "\t\x00q", "word " * 50, "".join(rng.choice("abcdehinorst") for _ in range(900))]


@pytest.mark.parametrize(("chunk", "giant"), [(9, 9), (50, 50), (50, 1 << 20), (1 << 16, 1 << 16)])
def test_encode_equals_the_library_and_decodes(spark, library, chunk, giant):
    rows = [(i, t, 1) for i, t in enumerate(texts())] + [(None, None, 1), (50, "literal ▁ mark", 1), (3, "  a  b ", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, k int")
    out = pieces.decode(pieces.encode(docs, TOKENIZER, chunk=chunk, giant=giant), TOKENIZER).collect()
    assert len(out) == len(rows)
    once = pieces.encode(docs.withColumn("ids", F.lit("taken")), TOKENIZER, chunk=chunk, decoded="decoded", giant=giant)
    assert once.columns == ["doc_id", "text", "k", "ids", "ids_", "decoded"]
    assert sorted((str(r.text), tuple(r.ids_), r.decoded) for r in once.collect()) == sorted((str(r.text), tuple(r.ids), r.decoded) for r in out)
    for r in out:
        assert r.decoded == (r.text or "")
        if "▁" not in (r.text or ""):
            assert r.ids == library.encode(r.text or "")


@pytest.mark.parametrize("giant", [500, 1 << 20])
def test_encode_real_documents(spark, library, giant):
    """Every document through the scan, dealt out or where it is read: chunks of 500 characters, most texts longer."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = pieces.encode(docs, TOKENIZER, chunk=500, giant=giant).collect()
    assert len(rows) == 1000 and sum(len(r.text) >= 500 for r in rows) > 600
    for r in rows:
        assert r.ids == library.encode(r.text)


def test_giant_text_with_literal_marks_is_split(spark, vocabulary):
    """A megabyte with U+2581 goes through many chunks and gives the plain way's ids and itself back."""
    rng = random.Random(12)
    text = "".join(rng.choice(["ab", "cde", " ", "▁", "\n", "é", "the ", "▁▁", "ing"]) for _ in range(500_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = pieces.encode(docs, TOKENIZER, chunk=1 << 14, decoded="back").first()
    assert row.back == text and row.ids == np.frombuffer(vocabulary.encode(text), np.int32).tolist()


def test_other_models_are_refused(monkeypatch):
    model = open(TOKENIZER, "rb").read()
    monkeypatch.setattr(pieces, "HALO", 5)
    with pytest.raises(ValueError, match="piece of"):
        pieces.Vocabulary(model)
    real = sentencepiece.SentencePieceProcessor.normalize
    monkeypatch.setattr(sentencepiece.SentencePieceProcessor, "normalize", lambda self, x: real(self, x).replace("ﬁ", "fi"))
    with pytest.raises(ValueError, match="normalises"):
        pieces.Vocabulary(model)


def changed(change):
    """The model with its description changed."""
    described = sentencepiece_model_pb2.ModelProto.FromString(open(TOKENIZER, "rb").read())
    change(described)
    return described.SerializeToString()


def test_models_whose_pieces_cannot_be_cut_at_words_are_refused():
    for piece in ("a▁b", "a▁", "a\nb", "\n\n"):
        with pytest.raises(ValueError, match="goes on over"):
            pieces.Vocabulary(changed(lambda m, piece=piece: m.pieces.add(piece=piece, score=-1.0)))
    with pytest.raises(ValueError, match="user-defined"):
        pieces.Vocabulary(changed(lambda m: m.pieces.add(piece="zzz", score=0.0, type=4)))
    with pytest.raises(ValueError, match="neither"):
        pieces.Vocabulary(changed(lambda m: setattr(m.trainer_spec, "model_type", 3)))


def test_the_kind_is_read_from_the_model(spark, tmp_path):
    """A model that says it is of unigram kind gives the library's ids without being told."""

    def unigram(m):
        m.trainer_spec.model_type = 1
        for p in m.pieces:
            if p.type == p.NORMAL:
                p.score = -1.0 - (zlib.crc32(p.piece.encode()) % 100_003) / 1000

    path = tmp_path / "unigram.model"
    path.write_bytes(changed(unigram))
    assert pieces.kind_of(path.read_bytes()) == "unigram"
    plain = sentencepiece.SentencePieceProcessor(model_file=str(path))
    rng = random.Random(8)
    some = ["the quick brown fox", "", "été 日本", "xq" * 40] + ["".join(rng.choice("abcdehinorst  ") for _ in range(120)) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")
    for chunk, giant in ((1 << 15, 1 << 20), (30, 1 << 20), (30, 30)):
        for r in pieces.encode(docs, str(path), chunk=chunk, giant=giant).collect():
            assert r.ids == plain.encode(r.text)


def test_unigram_chunks_equal_plain_viterbi(vocabulary):
    """The same vocabulary read as a unigram model: a chunked scan finds a path of the best total score."""
    model = pieces.Vocabulary(open(TOKENIZER, "rb").read(), "unigram")
    model.score = {p: -1.0 - (zlib.crc32(p.encode()) % 1000) / 1000 for p in model.ids}
    for text in ["thequickbrownfoxjumps" * 3, "the quick brown fox jumps over"]:
        normal = pieces.SPACE + text.replace(" ", pieces.SPACE)
        best = [0.0] + [-1e9] * len(normal)
        for i in range(len(normal)):
            for s, e, k in model.starting(normal, i):
                best[e] = max(best[e], best[s] + model.score[model.text[k]])
        for size in (5, 13, 100):
            spans = [(lo, min(len(normal), lo + size)) for lo in range(0, len(normal), size)]
            sums = pieces.scan([model.transfer(normal, lo, hi) for lo, hi in spans])
            assert sums[-1][0, 0] == pytest.approx(best[-1])


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert pieces.encode(empty, TOKENIZER).count() == 0
    assert quality.quality_scores(empty, labels).count() == 0
    assert toxicity.toxicity_scores(empty, labels).count() == 0
    assert toxicity.remove_toxic(empty, labels).columns == ["doc_id", "text"]


PAGES = {
    "": "",
    "plain words only": "plain words only",
    "<p>a&amp;b&nbsp;c <b>d</b>e<p>f &lt;g&gt;": "a&b c de\nf <g>",
    "<nav><a href='/'>Home</a></nav><article><h1>Title here</h1><p>One <a href='/x'>two</a>.<br>Three</p><div class='ad'>Buy now</div><ul><li>Last</li></ul></article><footer>Foot</footer>": "Title here\nOne two.\nThree\nLast",
    "<body><div class='cookie-notice'>We use cookies, accept them all please<main><header><h1>Head</h1></header><p>Short.</p><form><label>Your mail</label></form></main><aside>Other things to read today</aside></body>": "Head\nShort.",
    "<article><p>Only this.</p><script>var a = '<p>no</p>'</script><style>p{}</style><!-- <p>gone</p> --></article><section id='comments'><article class='comment'><p>First! I liked it so much that I wrote this.</p></article></section>": "Only this.",
    "<article><p>broken <b>bold</article><footer>x": "broken bold",
}


def test_pages(spark):
    rows = [(i, "u", page, 0) for i, page in enumerate(PAGES)] + [(99, None, None, 0)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text_ int")
    got = {r.page_id: r.text for r in html.extract_text(frame).collect()}
    assert got == {**dict(enumerate(PAGES.values())), 99: ""}


def test_labelled_pages_are_recovered():
    """Nearly all pages the weights come from, and of as many that they have not seen."""
    weights = html.default_weights()
    for seed in (11, 5):
        pages = labelled_pages(300, seed)
        right = [html.extract(html.unmarked(p), weights) == html.marked_text(p, weights) for p in pages]
        assert np.mean(right) > 0.98


def test_one_word_of_a_class_decides_nothing():
    page = "<article><p>First part of it.</p><div class='{}'><p>Kept or not.</p></div><p>Last part of it.</p></article>"
    for name in ("related-work", "alert", "widget-maker", "menu-of-the-day", "shared-memory", "x ad-hoc-networks"):
        assert html.extract(page.format(name)) == "First part of it.\nKept or not.\nLast part of it."
    for name in ("ad", "notice", "social", "share-buttons", "related-posts", "ad-banner", "comments", "box ad", "cookie-notice-2"):
        assert html.extract(page.format(name)) == "First part of it.\nLast part of it."
    assert html.extract("<body><div class='alert'><p>All that this page has to say.</p></div></body>") == "All that this page has to say."


def test_parts_of_an_article_stay_whatever_their_class():
    page = "<body><nav><a href='/'>Home</a></nav><article><p>First part of it.</p>{}<p>Last part of it.</p></article><footer>Imprint</footer></body>"
    cases = {
        '<p>See <span class="share">this share</span> of the <a class="comment-link">public comment</a> record.</p>': "See this share of the public comment record.",
        '<p>He wrote a <em class="related">related novel</em> in Bergen then.</p>': "He wrote a related novel in Bergen then.",
        '<table><tr><th class="header">Year</th><td class="footer">1901</td></tr></table>': "Year\n1901",
        '<h2 class="banner">The flood</h2>': "The flood",
        '<ul><li class="comment">One</li><li class="ad">Two</li></ul>': "One\nTwo",
        '<dl><dt class="menu">Fish</dt><dd class="notice">Caught</dd></dl>': "Fish\nCaught",
        '<div class="ad"><p>Buy <span>now</span></p></div>': None,
    }
    for inner, text in cases.items():
        for container in ("article", 'div class="article-body"'):
            own = page.replace("<article>", f"<{container}>").replace("</article>", f"</{container.split()[0]}>")
            assert html.extract(own.format(inner)) == "\n".join(x for x in ("First part of it.", text, "Last part of it.") if x)


def test_comments_are_told_by_where_they_stand_and_how_they_are_built():
    words = "The mill stood by the river and the water drove it for two hundred years until the war came."
    article = f"<article><h1>Mill</h1><p>{words}</p><p>{words}</p></article>"
    entry = "<div class='{}'><b>Anna</b> <time>2020-01-0{}</time><p>I saw the mill, it is a fine one and I would go again.</p></div>"
    for name in ("user-responses", "kommentare", "x1"):
        listed = f"<div class='{name}'>" + "".join(entry.format("e", k) for k in range(1, 5)) + "</div>"
        plain = f"<div class='{name}'><p>A fine mill.</p><p>I would not go there again.</p></div>"
        for after in (listed, plain):
            for page in (f"<body>{article}{after}</body>", f"<body><main>{article}{after}</main></body>" if after is listed else ""):
                assert html.extract(page) == (f"Mill\n{words}\n{words}" if page else "")
    # An article's own dated parts stay, and so does a page that is nothing but a list of posts.
    parts = "".join(f"<section class='update'><time>10:0{k}</time><p>{words}</p></section>" for k in range(3))
    assert html.extract(f"<body><article>{parts}</article></body>").count(words) == 3
    assert html.extract("<body><div class='posts'>" + "".join(entry.format("post", k) for k in range(1, 5)) + "</div></body>").count("I saw the mill") == 4
    # What follows an article goes on with it where it is content by its kind.
    assert html.extract(f"<body>{article}<section class='text'><p>{words}</p></section></body>").count(words) == 3


def test_best_region_equals_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        values = [rng.choice([-3.0, -1.0, -0.5, 0.5, 1.0, 2.0]) for _ in range(rng.randint(0, 14))]
        sums = {(a, b): sum(values[a:b]) for a in range(len(values)) for b in range(a + 1, len(values) + 1)}
        top = max(sums.values(), default=0)
        a, b = html.best_region(values)
        assert (a, b) == (0, 0) if top <= 0 else sums[a, b] == top


def test_hostile_pages_take_linear_time():
    pages = ["<b>" * 100_000 + "</i>" * 100_000 + "text", "<a " * 200_000 + "'>", "<!" * 300_000, "<div class=ad>" + "<article>" * 50_000, "<p>" * 300_000, '<a "' * 200_000]
    took = time.perf_counter()
    assert [html.extract(p) for p in pages][0] == "text"
    assert time.perf_counter() - took < 20


def test_odd_pages(spark):
    long = "<article>" + "<p>long &amp; winding</p>" * 50_000 + "</article>"
    frame = spark.createDataFrame([(1, long, "a"), (1, long, "a"), (None, None, None), (3, "", "b")], "page_id long, html string, TEXT string")
    got = html.extract_text(frame)
    assert got.columns == ["page_id", "html", "TEXT", "text_"]
    assert sorted((str(r.page_id), r.text_.count("long & winding")) for r in got.collect()) == [("1", 50_000), ("1", 50_000), ("3", 0), ("None", 0)]
    assert html.extract_text(frame.where("false")).count() == 0


def auc(y, s):
    rank = np.argsort(np.argsort(s)) + 1
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


@pytest.mark.parametrize(("query", "label", "least"), [("op6_quality", "quality", 0.95), ("op10_toxicity", "toxic", 0.75)])
def test_held_out_accuracy(spark, query, label, least):
    scores = QUERIES[query](spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = scores.join(labels, "doc_id").toPandas()
    held = rows[[zlib.crc32(str(i).encode()) % 4 == 2 for i in rows.doc_id]]
    assert held.held_out.all() and not rows.drop(held.index).held_out.any()
    assert auc(held[label].to_numpy(), held["score"].to_numpy()) >= least
    assert ((held.predicted == held[label]).mean()) >= 0.9
    assert scores.count() == 1000


def test_held_out_labels_and_other_columns_change_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    wrong = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string"))
    a = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs, labels).collect()}
    b = {r.doc_id: r.score for r in toxicity.toxicity_scores(other, wrong).collect()}
    assert a == pytest.approx(b)


def test_odd_texts_get_scores(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "!!!"), (None, "null id"), (4, "x" * 300_000), (4, "again")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, 0), (4, None, None), (None, 1, 1), (5, 0, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")
    for out in (quality.quality_scores(docs, labels), toxicity.toxicity_scores(docs, labels)):
        rows = out.collect()
        assert len(rows) == 6 and all(0 <= r.score <= 1 for r in rows)


def test_label_model_finds_the_good_voters():
    rng = np.random.default_rng(4)
    y = rng.random(4000) < 0.3
    votes = np.column_stack([np.where(rng.random(4000) < a, y, ~y) * 2.0 - 1 for a in (0.95, 0.9, 0.85, 0.6)])
    votes = np.column_stack([votes, votes[:, 3], votes[:, 3]])  # three voters that are one
    posterior, accuracy, dependence = toxicity.label_model(votes, 0.3)
    assert ((posterior > 0.5) == y).mean() > 0.95
    assert accuracy[0] > accuracy[3] and dependence[3, 4] > 10 * dependence[0, 1]


@pytest.mark.parametrize("noise", [0.0, 0.02])
def test_label_model_settles_on_voters_that_agree(noise):
    rng = np.random.default_rng(1)
    y = rng.random(1000) < 0.5
    votes = np.column_stack([np.where(rng.random(1000) < noise, ~y, y) * 2.0 - 1 for _ in range(12)])
    posterior, accuracy, _ = toxicity.label_model(votes, 0.5)
    assert ((posterior > 0.5) == y).all() and accuracy.min() > 0.9
    for rounds in (1, 2, 3):
        assert len(toxicity.label_model(votes, 0.5, rounds)[0]) == 1000


def test_label_model_equals_a_plain_count(monkeypatch):
    """One round of expectation-maximisation by loops over rows, voters and votes, for voters without parents."""
    rng = np.random.default_rng(9)
    votes = rng.choice([-1.0, 0.0, 1.0], (60, 3))
    monkeypatch.setattr(toxicity, "_tree", lambda dependence: [-1, -1, -1])
    got, _, _ = toxicity.label_model(votes, 0.25, 1)
    alike = np.corrcoef((votes == 1).T) ** 4
    most = sorted(range(60), key=lambda i: (-round(sum((votes[i][j] == 1) / alike[j].sum() for j in range(3)), 9), i))
    start = [0.9 if i in most[:15] and (votes[i] == 1).any() else 0.1 if (votes[i] == 1).any() else 0.02 for i in range(60)]
    for i in range(60):
        odds = math.log(0.25 / 0.75)
        for j in range(3):
            share = []
            for side in (start, [1 - p for p in start]):
                mass = {v: 0.5 + sum(p for p, row in zip(side, votes, strict=True) if row[j] == v) for v in (-1.0, 0.0, 1.0)}
                share.append(mass[votes[i][j]] / sum(mass.values()))
            odds += math.log(share[0] / share[1])
        assert got[i] == pytest.approx(1 / (1 + math.exp(-odds)), abs=1e-9)


def test_spanning_tree_joins_what_depends():
    dependence = np.zeros((5, 5))
    for a, b, x in ((0, 1, 0.5), (1, 2, 0.4), (0, 2, 0.1), (3, 4, 0.2)):
        dependence[a, b] = dependence[b, a] = x
    links = {frozenset((v, p)) for v, p in enumerate(toxicity._tree(dependence)) if p >= 0}
    assert links == {frozenset((0, 1)), frozenset((1, 2)), frozenset((3, 4))}


def test_pattern_voters_read_the_text():
    texts = ["YOU ARE ALL SO VERY LOUD", "what!! is this all about??", "such an a*shole as this one", "noooo way that is good now", "you are such a one as that", "word word word word word word", "a quiet text that says nothing", "hi", ""]
    body = [t.encode() for t in texts]
    got = toxicity.patterns(np.frombuffer(b"".join(body), np.uint8), np.cumsum([0, *map(len, body)]))
    fires = [{toxicity.PATTERNS[k] for k in np.flatnonzero(row == 1)} for row in got]
    assert fires[0] >= {"shouting", "capital words", "addresses the reader", "tells the reader what they are"}
    assert fires[1] == {"repeated marks"} and fires[2] == {"masked words"} and fires[3] == {"drawn-out letters"}
    assert fires[4] == {"addresses the reader", "tells the reader what they are"} and fires[5] == {"one word over and over"}
    assert fires[6] == set() and (got[6] == -1).all() and (got[7:] == 0).all()


def test_counts_of_units_equal_a_dictionary():
    """Lexicon counts of texts by a plain dictionary of words and byte beginnings."""
    texts = ["Idiot idiotic idiots", "nothing of the kind", "", "IDIOT!"]
    body = [t.encode() for t in texts]
    raw, offsets = np.frombuffer(b"".join(body), np.uint8), np.cumsum([0, *map(len, body)])
    hashes, rows, words = toxicity.units(raw, offsets)
    assert words.tolist() == [3, 4, 0, 1]
    idiot = toxicity._hashes_of("idiot")[0]
    features = toxicity.Features([(int(idiot.view(np.int64)), 0, 3.0), (int(hashes[2][0].view(np.int64)), 2, 3.0)], 2)
    counts, _ = features.counts(raw, offsets)
    plain = []
    for t in texts:
        found = re.findall(r"[a-z0-9]+", t.lower())
        plain.append(sorted([sum(w == "idiot" for w in found), sum(len(w) > 5 and w[:5] == "idiot" for w in found)]))
    assert [sorted(x) for x in counts.tolist()] == plain


def test_separable_labels_and_clashing_columns(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice("abcdefgh") * 3 for _ in range(30)) + (" vile foul mean base cruel rude coarse" if i % 2 else ""), i % 2) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxicity int")
    labels = spark.createDataFrame([(i, y, i + 1000, "x") for i, _, y in rows], "doc_id long, toxic int, id long, text string")
    scores = {r.doc_id: r.predicted for r in toxicity.toxicity_scores(docs, labels).collect()}
    assert scores == {i: y for i, _, y in rows}
    kept = toxicity.remove_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, _, y in rows if not y}
    assert toxicity.add_toxicity(docs, labels).columns[-1] == "toxicity_"


def test_labels_set_the_level_of_toxicity_scores(spark, monkeypatch):
    """A label model that orders texts well but is too sure that they are clean hides no toxic text."""
    model = toxicity.label_model
    monkeypatch.setattr(toxicity, "label_model", lambda *a: (0.2 * model(*a)[0], None, None))
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice("abcdefgh") * 3 for _ in range(30)) + (" vile foul mean base cruel rude coarse" if i % 2 else ""), i % 2) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    assert {r.doc_id: r.predicted for r in toxicity.toxicity_scores(docs, docs).collect()} == {i: y for i, _, y in rows}


def test_level_is_finite_and_rising():
    rng = np.random.default_rng(3)
    z = rng.normal(size=2000) * 2
    y = rng.random(2000) < 1 / (1 + np.exp(-(2 * z + 1)))
    assert toxicity._level(z, y, np.ones(2000)) == pytest.approx((2, 1), abs=0.35)
    assert np.isfinite(toxicity._level(np.where(y, 5.0, -9.0), y, np.ones(2000))).all()
    assert toxicity._level(-z, y, np.ones(2000)) == (1.0, 0.0) and np.isfinite(toxicity._level(np.zeros(2000), y, np.ones(2000))).all()


def test_a_labelled_id_of_many_rows_teaches_once(spark):
    docs = spark.range(3000).selectExpr("id % 4 as doc_id", "concat('word ', id) as text")
    chosen = spark.createDataFrame([(0, 1), (1, 0), (3, 1)], "id long, label int")
    got = quality.one_text_each(docs.withColumnRenamed("doc_id", "id"), chosen, "text").collect()
    assert sorted((r.id, r.text) for r in got) == [(0, "word 0"), (1, "word 1"), (3, "word 1003")]


def test_vectors_and_pooling_equal_a_plain_count(spark):
    """Random-indexing vectors and pooled vectors of a few texts by loops over tokens."""
    texts = ["the cat sat on the mat", "The dog, the cat!", None, "x"]
    space = quality.Space(words=64, dims=8, nonzero=2)
    dims, signs = space.index_vectors()
    table = np.zeros((space.rows, space.dims))
    split = []
    for t in texts:
        body = (t or "").encode()
        words, shapes, _ = quality.tokens(np.frombuffer(body, np.uint8), np.array([0, len(body)]), space)
        split.append((words.tolist(), shapes.tolist()))
        for i in range(len(words)):
            for j in (i - 1, i + 1):
                if 0 <= j < len(words):
                    for beside in (words[j], shapes[j]):
                        for k in range(space.nonzero):
                            for centre in (words[i], shapes[i]):
                                table[centre, dims[k][beside]] += signs[k][beside]
    table /= np.maximum(1e-9, np.linalg.norm(table, axis=1, keepdims=True))
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = quality.word_vectors(docs, "text", space, 4)
    assert np.allclose(got, table, atol=1e-6)
    pooled = docs.mapInArrow(quality._pool(got, space), "id long, vector binary").collect()
    for r in pooled:
        words, shapes = split[r.id]
        vector = np.frombuffer(r.vector, np.float32)
        want = [np.mean([table[w] for w in part], axis=0) if part else np.zeros(space.dims) for part in (words, shapes)]
        share = [math.sqrt(sum(s == space.words + k for s in shapes) / max(1, len(shapes))) for k in range(quality.SHAPES)]
        assert np.allclose(vector, [*want[0], *want[1], *share, math.log1p(len(words))], atol=1e-5)


def test_quality_prior_does_not_follow_the_sample(spark):
    """Texts say nothing of the label, so a score is the share of label 1, however few rows of a label are drawn."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(30)), int(i % 7 > 0)) for i in range(1400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    mean = {n: quality.quality_scores(docs.drop("quality"), docs.drop("text"), sample=n).agg(F.avg("score")).first()[0] for n in (50, 8000)}
    assert mean[8000] == pytest.approx(6 / 7, abs=0.05)
    assert mean[50] == pytest.approx(mean[8000], abs=0.1)
