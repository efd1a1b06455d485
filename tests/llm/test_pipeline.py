"""The pipeline's stages, each against what its operator says of the stage's own input."""

import corpus_pipeline as P
from pyspark.sql import functions as F

from docspark.llm import mixing, ngram_join, packing, pii, quality_rules
from docspark.llm.staging import stage

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    given = [docs]
    for name, f in P.STAGES:
        given.append(stage(f(spark, given[-1], DIR), name))
    raw, good, single, masked, mixed, packed = given
    for df in (good, single, masked, mixed):
        assert df.columns == docs.columns and df.count() > 50
    ids = lambda df: {r[0] for r in df.select("doc_id").collect()}
    assert ids(good) == ids(quality_rules.report(raw).where("kept"))
    assert ids(single) == ids(ngram_join.report(good).where("kept")) and single.count() == len(ids(single))
    anchors = pii.automaton()
    assert not [s for r in masked.select("text").collect() for s in pii.find_spans(r["text"], anchors) if s[0] in pii.BASE_KINDS]
    untouched = single.join(pii.report(single).where("spans = ''").select("doc_id"), "doc_id").select("doc_id", "text")
    assert untouched.exceptAll(masked.select("doc_id", "text")).count() == 0 and masked.count() == single.count()
    assert masked.where(F.col("n_chars") != F.length("text")).count() == 0
    assert mixed.exceptAll(masked).count() == 0
    tokens = lambda df: df.agg(F.sum(mixing.count_tokens(F.col("text")))).first()[0]
    assert tokens(mixed) <= 0.8 * tokens(masked) + 1
    pieces = packed.toPandas()
    assert set(pieces["doc_id"]) == ids(mixed) and pieces.groupby("sequence_id")["length"].sum().max() <= packing.CAPACITY
    ran = P.run(spark, DIR)
    assert ran.columns == packed.columns and ran.count() == len(pieces)


def test_odd_documents(spark):
    rows = [(None, None, None, None, None, 1), (1, "", "en", "src1", 0, 2), (1, "", "en", "src1", 0, 2), (2, "word " * 30_000, "en", "src2", 5, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _row int")
    for df in (docs, docs.limit(0)):
        for name, f in P.STAGES[:-1]:
            out = f(spark, df, DIR)
            assert out.columns == df.columns
            out.collect()
        assert P.packed(spark, df, DIR).count() >= df.count()
