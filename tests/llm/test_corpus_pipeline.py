"""The pipeline's stages against plain versions on their own inputs, and what passes through."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from clinops.llm import toxicity_crf
from clinops.llm.common import read
from tests.llm import brute

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_one_after_the_other(spark, tmp_path):
    docs = read(spark, SF, "documents")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        rows = out.collect()
        if name != "length_buckets":
            assert sorted(out.columns) == sorted(COLUMNS)
        if name == "toxicity":
            field = toxicity_crf.train_on(docs, read(spark, SF, "labels"))
            bad = {r["id"] for r in toxicity_crf.score(docs, field).where("predicted = 1").collect()}
            assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in before} - bad
        elif name == "ngram_jaccard_join":
            want = brute.jaccard([(r["doc_id"], r["text"]) for r in before])
            assert sorted(r["doc_id"] for r in rows) == sorted({c for _, c in want.values()})
        elif name == "suffix_array_dedup":
            want = brute.suffix([(r["doc_id"], r["text"]) for r in before], 200)
            assert {r["doc_id"]: len((r["text"] or "").encode()) for r in rows}.keys() == want.keys()
            for r in rows:
                n, gone, _, _ = want[r["doc_id"]]
                assert 0 <= n - gone - len((r["text"] or "").encode()) <= 6 * want[r["doc_id"]][2]
                assert r["n_chars"] == len(r["text"])
        elif name == "fair_mix":
            held = {r["doc_id"]: r for r in before}
            assert all(held[r["doc_id"]] == r for r in rows)
            size = {k: len(brute.words(r["text"])) for k, r in held.items()}
            assert abs(sum(size[r["doc_id"]] for r in rows) - 1.5 * sum(size.values())) <= max(size.values())
        else:
            assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in before)
        docs = out
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def test_stages_on_odd_rows(spark):
    """Nulls, repeated rows, empty texts and an extra column."""
    long = " ".join("u%d" % random.Random(i).randrange(10**6) for i in range(90))
    rows = [(1, long, "en", "a", 1, "x"), (1, long, "en", "a", 1, "x"), (2, None, None, None, None, None),
            (None, "only this", "en", "b", 9, "y"), (4, "", "en", "a", 0, "z"), (5, "words here", "en", None, 10, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, copies string")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        if name == "ngram_jaccard_join":
            assert out.where("doc_id = 1").count() == 1 and out.count() == 5
        if name == "suffix_array_dedup":
            assert out.count() == 6 and [r["text"] for r in out.where("doc_id = 1").collect()] == ["", ""]
        if name == "fair_mix":
            assert out.where(F.col("text").isNull()).count() == 0
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
