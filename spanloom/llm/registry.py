"""Queries of the training-data operators and their SQL, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm.bpe import op1_bpe
from spanloom.llm.cross_polytope import op7_cross_polytope
from spanloom.llm.language_id import op3_language_id
from spanloom.llm.licenses import op12_licenses
from spanloom.llm.merkle import OP11_SQL, op11_merkle
from spanloom.llm.mixing import op2_mixing
from spanloom.llm.mtree import OP5_SQL, op5_mtree
from spanloom.llm.near_duplicates import op8_near_duplicates
from spanloom.llm.phrases import op13_phrases
from spanloom.llm.sharding import op4_sharding
from spanloom.llm.token_files import op6_token_files
from spanloom.llm.toxicity import op10_toxicity
from spanloom.llm.url_filters import OP9_SQL, op9_url_filters


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_bpe": op1_bpe,
    "op2_mixing": op2_mixing,
    "op3_language_id": op3_language_id,
    "op4_sharding": op4_sharding,
    "op5_mtree": op5_mtree,
    "op6_token_files": op6_token_files,
    "op7_cross_polytope": op7_cross_polytope,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_url_filters": op9_url_filters,
    "op10_toxicity": op10_toxicity,
    "op11_merkle": op11_merkle,
    "op12_licenses": op12_licenses,
    "op13_phrases": op13_phrases,
}

ORACLES = {
    "op5_mtree": OP5_SQL,
    "op9_url_filters": OP9_SQL,
    "op11_merkle": OP11_SQL,
}
