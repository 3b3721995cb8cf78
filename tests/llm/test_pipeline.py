import os

import public_tokenizers
import pytest

import corpus_pipeline
from lodestone.llm.pretokens import tokenizer

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    planted = [(90_001, benchmark, "en", "src0", 1), (90_002, "12 !! 34", "en", "src0", 1)]
    copy = docs.where("n_chars > 500").first()
    planted += [(90_003, copy.text, copy.lang, copy.source, copy.n_chars)]
    docs = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        seen[name] = docs
        if name != "token_output":
            assert docs.columns == before.columns
    ids = lambda name: {r.doc_id for r in seen[name].select("doc_id").collect()}
    assert 90_002 not in ids("language_id") and 90_001 in ids("language_id")
    assert 90_003 not in ids("near_duplicates") and copy.doc_id in ids("near_duplicates")
    assert 90_001 not in ids("decontamination") and len(ids("decontamination")) > 100
    assert seen["mixing"].groupBy("doc_id").count().where("count > 3").count() == 0
    mixed = sorted(seen["mixing"].collect(), key=lambda r: r.doc_id)
    tk = tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    got = sorted(seen["token_output"].collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [r.doc_id for r in mixed]
    start = 0
    for row, doc in zip(got, mixed):
        assert row.start == start and row.n_tokens == len(tk.encode(doc.text or "", add_special_tokens=False).ids) + 1
        start += row.n_tokens


def test_mixing_stage_keeps_columns_and_rows_without_id(spark):
    rows = [(None, "a b c d", "en", "u", 1, 5), (1, "e f", "en", "s", 1, 6), (2, None, None, None, None, None), (3, "g h i", "en", "t", 1, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, copies int")
    out = corpus_pipeline.mixing(spark, docs, SF)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} <= {None, 1, 3} and any(r.doc_id is None for r in out.collect())
    assert corpus_pipeline.mixing(spark, docs.limit(0), SF).count() == 0


def test_a_passage_in_a_long_text_is_found(spark):
    words = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 100").first().text.split()[:20]
    clean = [f"w{i * i % 9973}" for i in range(15_000)]
    docs = spark.createDataFrame([(1, " ".join(clean[:7000] + words + clean[7000:])), (2, " ".join(clean))], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.decontamination(spark, docs, SF).collect()] == [2]


def test_stages_judge_each_row(spark, tmp_path):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 100").first().text
    text = " ".join(f"w{i * i % 97}" for i in range(60))
    rows = [(None, bench, "a"), (7, bench, "b"), (7, text, "c"), (7, text, "d"), (None, text, "e"), (None, "x y z", "f"), (8, None, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "doc_id as `__key`", "doc_id as `n.m`", "source as copies")
    docs.write.parquet(str(tmp_path / "docs"))
    for own in (docs, spark.read.parquet(str(tmp_path / "docs"))):
        left = {r.source for r in corpus_pipeline.decontamination(spark, own, SF).collect()}
        assert left == set("cdefg")
        left = [r.source for r in corpus_pipeline.near_duplicate_removal(spark, own, SF).collect()]
        assert len(left) == 4 and {"f", "g"} < set(left) and len({"a", "b"} & set(left)) == 1 and len({"c", "d", "e"} & set(left)) == 1
        for stage in (corpus_pipeline.decontamination, corpus_pipeline.near_duplicate_removal, corpus_pipeline.mixing):
            assert stage(spark, own.limit(0), SF).count() == 0 and stage(spark, own, SF).columns == own.columns
