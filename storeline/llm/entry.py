"""The subpackage's queries, by name, and DuckDB SQL for those that SQL can express.

The others have no SQL that finishes on whole tables in reasonable time or gives the same hashes;
``tests/llm`` compares them with brute-force versions instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from storeline.llm import divergence, merkle, pivot_index
from storeline.llm.cotraining import op4_cotraining
from storeline.llm.divergence import op11_source_divergence
from storeline.llm.merkle import op13_merkle_manifest
from storeline.llm.mixing import op2_mixing
from storeline.llm.multi_index import op5_multi_index
from storeline.llm.piece_bpe import op3_piece_bpe
from storeline.llm.pivot_index import op12_pivot_top_k
from storeline.llm.substring_rlz import op8_substring_rlz
from storeline.llm.suffix_array import op9_suffix_array
from storeline.llm.suffix_tree_lm import op1_suffix_tree_lm
from storeline.llm.superminhash import op6_superminhash
from storeline.llm.toxicity_crf import op10_toxicity_crf
from storeline.llm.winnowing import op7_winnowing
from storeline.session import ensure_checkpoint_dir, ship_package

OPERATORS = [op1_suffix_tree_lm, op2_mixing, op3_piece_bpe, op4_cotraining, op5_multi_index, op6_superminhash,
             op7_winnowing, op8_substring_rlz, op9_suffix_array, op10_toxicity_crf, op11_source_divergence, op12_pivot_top_k, op13_merkle_manifest]


def _ready(query: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ensure_checkpoint_dir(spark)
        ship_package(spark)
        return query(spark, sf_dir)
    return run


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: _ready(q) for q in OPERATORS} | {"pipeline": _ready(_pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op11_source_divergence": divergence.SQL, "op12_pivot_top_k": pivot_index.SQL,
            "op13_merkle_manifest": merkle.sql()}
