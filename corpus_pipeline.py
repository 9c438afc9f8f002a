"""The corpus pipeline: stages over documents, each written and read again by the next.

language   documents that the language profiles reject (no letter, or nothing
           like any learned language) go; all others stay as they are
near_dups  one document of each group of n-gram Jaccard links stays
pii        personal data in the text is replaced by its kind
mix        documents are put in the order of the Pfair mix of sources, and get
           their position in it
encode     SentencePiece ids: doc_id, source, lang, position, n_tokens, ids;
           the mix is the rows in the order of position

Defined results: a null or empty text has no letter, so language drops it; a null
id, source or lang stays null, and rows are told apart by their texts; repeated
rows are copies, of which near_dups keeps one; texts of any length are treated
whole; an empty table gives no rows; extra columns of documents are carried along
to mix, whose ``position`` replaces one of that name, and encode leaves them out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridwork.llm import hd_language, jaccard_join, pfair_mix, pii, piece_codec
from gridwork.llm._common import fresh_path
from gridwork.llm.queries import MIX_WEIGHTS, vocabulary

#: A document is rejected when its cosine with every language is below this: text of one or two words of any language has more.
LEAST_COSINE = 0.01


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prototypes = hd_language.learn(docs.filter(~hd_language.held_out()))
    # The documents' own columns stay apart, whatever their names.
    rows = hd_language.predict(docs.select(F.struct(*docs.columns).alias("own"), F.col("text").alias("_text")), prototypes, "_text")
    return rows.filter((F.col("lang_pred") != hd_language.UNDETERMINED) & (F.col("score") >= LEAST_COSINE)).select("own.*")


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_first(docs)


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pfair_mix.reordered(docs, MIX_WEIGHTS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = piece_codec.encode(docs.select("doc_id", "source", "lang", "position", "text"), vocabulary("piece_bpe_32k.model"))
    return rows.select("doc_id", "source", "lang", "position", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("language", language), ("near_dups", near_dups), ("pii", personal), ("mix", mix), ("encode", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
