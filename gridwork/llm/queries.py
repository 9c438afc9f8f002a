"""The corpus operators as queries over the driver's tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridwork.llm._common import table


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridwork.llm.token_binary import token_report

    return token_report(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2)


def op9_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridwork.llm.piece_codec import codec_report

    return codec_report(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op4_ann_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridwork.llm.ann_blocks import search

    return search(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op8_hd_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridwork.llm.hd_language import language_report

    return language_report(table(spark, sf_dir, "documents"))


def op3_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridwork.llm.chat import rotate

    return rotate(table(spark, sf_dir, "conversations"))


def op6_html_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridwork.llm.html_cut import page_report

    return page_report(table(spark, sf_dir, "pages"))


#: Target weights of the sources; every other source weighs 1.
MIX_WEIGHTS = {"src0": 4.0, "src1": 2.0, "src2": 1.5}


def op10_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridwork.llm.pfair_mix import mix_report

    return mix_report(table(spark, sf_dir, "documents"), MIX_WEIGHTS)


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridwork.llm.jaccard_join import jaccard_classes

    return jaccard_classes(table(spark, sf_dir, "documents"))


def op7_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridwork.llm.merkle import fingerprint_report

    return fingerprint_report(table(spark, sf_dir, "documents"))


def op5_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridwork.llm.pii import pii_report

    return pii_report(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridwork.llm.filter_audit import filter_report

    return filter_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridwork.llm.hard_negatives import negative_report

    return negative_report(table(spark, sf_dir, "embeddings"))


def op13_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridwork.llm.quality_gam import quality_report

    return quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ALL = [op1_jaccard_join, op5_pii_boosting, op7_merkle, op2_token_binary, op3_chat_rotation, op4_ann_blocks, op6_html_cut, op8_hd_language, op9_piece_codec, op10_pfair_mix, op11_filter_audit, op12_hard_negatives, op13_quality_gam]


def queries() -> dict:
    return {f.__name__: f for f in ALL}


def oracle_sql() -> dict[str, str]:
    from gridwork.llm import chat, filter_audit, hard_negatives

    return {"op3_chat_rotation": chat.ORACLE, "op11_filter_audit": filter_audit.ORACLE, "op12_hard_negatives": hard_negatives.ORACLE}
