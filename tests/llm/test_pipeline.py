"""The corpus pipeline, stage by stage, against brute-force versions on the smallest tables."""

import re

import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from graphlens.llm import toxicity
from graphlens.llm.queries import TOKENIZER
from tests.llm.test_dedup import bench_words, brute_components, brute_contamination, brute_lines, brute_print

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], SF).write.parquet(f"{folder}/{k}")
        out.append(spark.read.parquet(f"{folder}/{k}"))
    return out


def rows(frame):
    return sorted((r.doc_id, r.text) for r in frame.select("doc_id", "text").collect())


def test_stages_are_these_and_keep_the_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "SimHash near-dedup", "benchmark decontamination", "SentencePiece encoding and decoding"]
    assert all(s.columns == stages[0].columns for s in stages[1:-1])


def test_toxicity_drops_what_it_predicts(spark, stages):
    scores = toxicity.toxicity_scores(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))
    keep = {r.doc_id for r in scores.where("predicted = 0").collect()}
    assert rows(stages[1]) == [x for x in rows(stages[0]) if x[0] in keep]


def test_lines(stages):
    assert rows(stages[2]) == sorted((i, t) for i, _, _, t, _ in brute_lines(rows(stages[1]), 2))


def test_near_duplicates(stages):
    before = rows(stages[2])
    lowest = {c for _, _, c in brute_components([(i, brute_print(t)) for i, t in before])}
    assert rows(stages[3]) == [x for x in before if x[0] in lowest]


def test_contamination(spark, stages):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = rows(stages[3])
    marks = {i: (n, hit, bad) for i, n, hit, _, bad in brute_contamination(before, items)}
    after = dict(rows(stages[4]))
    assert set(after) == {i for i, (_, _, bad) in marks.items() if not bad}
    for i, text in before:
        if i in after:
            n, hit, _ = marks[i]
            assert len(bench_words(after[i])) == n - hit
            if not hit:
                assert after[i] == text


def test_tokens(stages):
    library = sentencepiece.SentencePieceProcessor(model_file=TOKENIZER)
    found = stages[5].collect()
    assert len(found) == stages[4].count()
    for r in found:
        assert r.round_trip and r.ids == library.encode(r.text)


def test_run_gives_the_last_stage_and_scores_each_document_once(spark, stages, monkeypatch):
    scored = spark.sparkContext.accumulator(0)
    fit = toxicity.fit_toxicity

    def counting(*args, **options):
        scorer = fit(*args, **options)

        def score(raw, offsets):
            scored.add(len(offsets) - 1)
            return scorer(raw, offsets)

        return score

    monkeypatch.setattr(toxicity, "fit_toxicity", counting)
    got = corpus_pipeline.run(spark, SF)
    got.write.format("noop").mode("overwrite").save()
    assert scored.value == stages[0].count()
    assert sorted((r.doc_id, tuple(r.ids)) for r in got.collect()) == sorted((r.doc_id, tuple(r.ids)) for r in stages[5].collect())


def test_odd_documents_pass(spark, tmp_path):
    odd = [(1, None), (2, ""), (None, "null id"), (3, "x\nx\nx"), (3, "x\nx\nx"), (4, "é" * 70_000 + " \n end"), (5, "a b c")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in odd], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        docs.write.parquet(str(tmp_path / re.sub(r"\W", "_", name)))
        docs = stage(spark, spark.read.parquet(str(tmp_path / re.sub(r"\W", "_", name))), SF)
    kept = docs.collect()
    # The null text and the empty one are copies of each other, and so are the two rows of document 3.
    assert sorted((str(r.doc_id), (r.text or "")[:5]) for r in kept) == sorted([("1", ""), ("None", "null "), ("3", "x"), ("4", "ééééé"), ("5", "a b c")])
    assert all(r.round_trip for r in kept)
    empty = docs.drop("ids", "round_trip").where(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0
