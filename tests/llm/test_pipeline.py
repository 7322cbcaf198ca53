"""Every stage on odd rows, and the whole pipeline on the small tables."""

import corpus_pipeline


def test_stages_take_odd_rows(spark, odd_docs, no_docs, tmp_path):
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        for kind, docs in (("odd", odd_docs), ("none", no_docs)):
            out = stage(spark, docs, "/root/testdata/sf0.001")
            out.write.parquet(f"{tmp_path}/{kind}{number}")
            if number < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns, name
            if kind == "none":
                assert spark.read.schema(out.schema).parquet(f"{tmp_path}/{kind}{number}").count() == 0


def test_pipeline_runs_over_the_tables(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").toPandas()
    assert 0 < len(out) <= 200 and (out["taken"] <= 3 * out["size"]).all()
