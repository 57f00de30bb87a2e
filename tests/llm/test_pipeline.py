"""The pipeline against its stages' meaning on a small corpus."""

import pandas as pd

import corpus_pipeline
from flowloom.llm import queries


def test_pipeline_on_small_data(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.written(stage(spark, before, sf_dir))
        kept[name] = docs.toPandas()
        if name != "mixing":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    ids = {k: set(v.doc_id) for k, v in kept.items()}
    assert ids["line_dedup"] == ids["language_id"] and ids["mixing"] <= ids["decontamination"]
    assert ids["decontamination"] < ids["near_dedup"] < ids["line_dedup"]
    assert (kept["mixing"].groupby(["doc_id", "text"]).copy.max() <= 2).all()
    texts = kept["line_dedup"]
    assert (texts.n_chars == texts.text.map(len)).all()
    bench = pd.read_parquet(f"{sf_dir}/benchmark.parquet")
    left = kept["decontamination"].text.str.lower()
    assert not any(left.str.contains(item.lower(), regex=False).any() for item in bench.text)


def test_queries_have_the_contract_columns(spark):
    want = {
        "op4_token_counts": ["doc_id", "n_bytes", "n_tokens", "over_limit"],
        "op7_language_id": ["doc_id", "held_out", "lang_pred", "score"],
        "op9_line_dedup": ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
    }
    for name, columns in want.items():
        assert queries.queries()[name](spark, "/root/testdata/sf0.001").columns[: len(columns)] == columns
