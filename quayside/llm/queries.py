"""The registered queries of the pipeline operators: whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import (collocations, factor_quality, host_rules, interpolation, language_codes, line_join,
               packing, prefix_trie, signature_trees, spaced_seeds, token_files, toxic_segments, warc)
from .common import prepare, table


def tokenizer_file(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return spaced_seeds.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return host_rules.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "rules_failed", "host_docs", "host_failures", "host_verdict", "kept")


def op3_line_similarity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return line_join.line_verdicts(table(spark, sf_dir, "documents"))


def op4_warc_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return warc.archive(table(spark, sf_dir, "pages"), least=100)


def op5_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return interpolation.interpolated_scores(table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    manifest = token_files.write_token_files(table(spark, sf_dir, "documents"),
                                             tokenizer_file("byte_bpe_50k.json"), end_id=0)
    return token_files.read_token_files(manifest)


def op7_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return language_codes.identify(table(spark, sf_dir, "documents"))


def op8_signature_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return signature_trees.similar_groups(table(spark, sf_dir, "documents"), size=3, num=90, den=100) \
        .drop("first")


def op9_first_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return packing.pack(table(spark, sf_dir, "documents"),
                        tokenizer_file("word_bpe_49k.json"), end_id=1, capacity=2048)


def op10_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return factor_quality.quality_scores(table(spark, sf_dir, "documents"),
                                         table(spark, sf_dir, "labels"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return prefix_trie.prefix_nodes(table(spark, sf_dir, "conversations"))


def op12_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return toxic_segments.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return collocations.top_collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_spaced_seed_decontamination": op1_spaced_seed_decontamination,
    "op2_host_rules": op2_host_rules,
    "op3_line_similarity_join": op3_line_similarity_join,
    "op4_warc_members": op4_warc_members,
    "op5_deleted_interpolation": op5_deleted_interpolation,
    "op6_token_files": op6_token_files,
    "op7_language_codes": op7_language_codes,
    "op8_signature_tree_join": op8_signature_tree_join,
    "op9_first_fit_packing": op9_first_fit_packing,
    "op10_factorisation_machine": op10_factorisation_machine,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_toxic_segments": op12_toxic_segments,
    "op13_collocations": op13_collocations,
}

ORACLES: dict[str, str] = {
    "op2_host_rules": host_rules.ORACLE,
    "op11_prefix_trie": prefix_trie.ORACLE,
    "op13_collocations": collocations.ORACLE,
}
