"""The stages one after the other, and each against what its operator says."""

from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import minhash, quality


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, steps = [], [docs]
    for name, stage in corpus_pipeline.STAGES:
        steps.append(stage(spark, steps[-1], sf).cache())
        names.append(name)
    assert names == ["quality rules", "near duplicates", "personal data", "mixture", "tokens"]
    assert all(s.columns == docs.columns for s in steps[:-1])
    ids = [[r.doc_id for r in s.select("doc_id").collect()] for s in steps]
    assert set(ids[1]) == {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    assert set(ids[2]) == {r.doc_id for r in minhash.near_duplicates(steps[1], k=5).where("kept").collect()}
    assert sorted(ids[3]) == sorted(ids[2]) and sorted(ids[5]) == sorted(ids[4]) and max(map(ids[4].count, ids[4])) == 2
    assert steps[3].selectExpr("bool_and(n_chars = length(text))").first()[0]
    sizes = [s.selectExpr("sum(regexp_count(text, '[^\\\\x20\\\\x09-\\\\x0D]+'))").first()[0] for s in (steps[3], steps[4])]
    assert abs(sizes[1] - 1.5 * sizes[0]) < 0.01 * sizes[0]
    digests = {r.x for r in steps[4].selectExpr("sha2(text, 256) x").collect()}
    assert {r.decoded_sha256 for r in steps[5].collect()} == digests


def test_stages_leave_other_columns_alone(spark):
    """Columns of any name go through every stage but the last; repeated rows, nulls and empty texts too."""
    text = "Plain words about rivers and towns that a reader would not mind, written to anna@example.org on 2024-05-06. " * 6
    names = ("_id", "_copies", "_copy", "_hits", "_found", "pii", "kept_id", "found_pii", "mixed_id", "mixed_times", "mixed_copy", "copies", "kept", "size")
    rows = [(i, t, "en", "s", 1) for i, t in enumerate([text, text + "More of it here.", "", None, text])]
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({n: F.lit(f"own {n}") for n in names})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        assert all(r[n] == f"own {n}" for r in out.collect() for n in names)
    assert corpus_pipeline.tokens(spark, docs, "").count() == 6
