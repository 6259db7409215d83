"""The pipeline against its parts, on a small table."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mediaframe.llm import bpe, pii, toxicity
from mediaframe.llm.common import materialize
from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet").withColumn("key", F.lit("clash")).withColumn("words", F.lit(1))
    odd = spark.createDataFrame([(10_001, None, None, None, None, "k", 2), (10_002, "", "en", "src1", 0, "k", 2), (None, "mail me at someone@mail.example.com please", "en", "src1", 5, "k", 2)], base.schema)
    return materialize(base.unionByName(odd), "documents")


def test_stages(spark, docs):
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = materialize(stage(spark, now, SF), name)
        assert after.columns == docs.columns and after.count() <= now.count(), name
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        if name == "toxicity":
            model = toxicity.train_tables(spark, SF, spark.read.parquet(f"{SF}/documents.parquet"))
            assert ids == {r.doc_id for r in toxicity.score(now, model).where("score < 0.5").collect()}
        elif name == "near_copies":
            rows = [(r.doc_id, r.text) for r in now.collect()]
            want = brute.similar([x for x in rows if x[0] is not None], 5, 80)
            assert ids == {i for i, c in want.items() if i == c} | {i for i, _ in rows if i is None}
        elif name == "decontamination":
            windows = brute.windows([tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()])
            assert ids == {r.doc_id for r in now.collect() if not brute.contamination(r.text, windows)[1]}
        else:
            texts = {r.doc_id: r for r in after.collect()}
            added = brute.bootstrap([r.text for r in now.collect()])
            for r in now.collect():
                want = pii.masked(r.text, brute.base_spans(r.text) + added[r.text]) if r.text else r.text
                assert texts[r.doc_id].text == want and texts[r.doc_id].n_chars == (None if want is None else len(want))
        now = after
    name, stage = corpus_pipeline.STAGES[-1]
    coder = bpe.Encoder(bpe.default_vocabulary())
    got = {r.doc_id: r for r in stage(spark, now, SF).collect()}
    for r in now.collect():
        ids, _ = coder.encode([r.text or ""])
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_no_documents(spark, docs):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name


def test_repeated_ids(spark):
    """Rows of one id with different texts go through every stage, each by its own text."""
    rows = [(1, "mail me at someone@mail.example.com please", "en", "s", 5), (1, "another text of the same id", "en", "s", 5), (1, "another text of the same id", "en", "s", 5)]
    now = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = materialize(stage(spark, now, SF), name)
    assert sorted(r.text for r in now.collect()) == ["another text of the same id", "another text of the same id", "mail me at [EMAIL] please"]


def test_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and 0 < got.count() <= 200


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_copies", "decontamination", "personal_data", "encoding"]
