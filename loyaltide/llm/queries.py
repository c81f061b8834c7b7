"""Queries of this subpackage, by name, and their comparison SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loyaltide.llm import (
    bpe,
    collocations,
    jaccard_join,
    language_id,
    lm_scoring,
    minhash_join,
    mixing,
    periodic_runs,
    quality_mil,
    quality_rules,
    sharding,
    topk,
    toxicity,
)
from loyaltide.llm.common import remainder, table, tokenizer_path

Query = Callable[[SparkSession, str], DataFrame]


def op1_attention_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = remainder(F.col("doc_id"), 3) == 1
    network = quality_mil.train(docs, labels, ~held_out)
    found = quality_mil.score(docs, network)
    return found.select("doc_id", held_out.alias("held_out"), "score",
                        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_log_bilinear_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 7) == 2
    found = lm_scoring.score(docs, lm_scoring.train(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), *found.columns[1:])


def op3_branch_and_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.filter("vec_id % 100 = 0"))


def op4_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op5_ftrl_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 4) == 2
    model = language_id.train(docs, ~held_out)
    found = language_id.predict(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_report(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_parity_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op8_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op9_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = remainder(F.col("doc_id"), 5) == 3
    found = toxicity.score(docs, toxicity.train(docs, labels, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), F.col("toxic").alias("score"),
                        (F.col("toxic") >= 0.5).cast("int").alias("predicted"),
                        "toxic_junk", "toxic_prose")


def op10_adaptive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"))


def op11_collocation_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_report(table(spark, sf_dir, "documents"))


def op13_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_join.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_attention_mil": op1_attention_mil,
    "op2_log_bilinear_lm": op2_log_bilinear_lm,
    "op3_branch_and_bound": op3_branch_and_bound,
    "op4_pivotal_mixing": op4_pivotal_mixing,
    "op5_ftrl_language": op5_ftrl_language,
    "op6_trie_bpe": op6_trie_bpe,
    "op7_parity_jaccard": op7_parity_jaccard,
    "op8_kd_sharding": op8_kd_sharding,
    "op9_toxicity_chain": op9_toxicity_chain,
    "op10_adaptive_rules": op10_adaptive_rules,
    "op11_collocation_automata": op11_collocation_automata,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_minhash_join": op13_minhash_join,
}
ORACLES: dict[str, str] = {
    "op3_branch_and_bound": topk.SQL,
    "op7_parity_jaccard": jaccard_join.SQL,
    "op10_adaptive_rules": quality_rules.SQL,
    "op11_collocation_automata": collocations.SQL,
    "op13_minhash_join": minhash_join.SQL,
}
