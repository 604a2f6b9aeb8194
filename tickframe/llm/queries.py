"""The queries of the training-data operators over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_trees, decontaminate, line_chunks, pieces, secrets_scan, set_join, token_blocks, toxicity, url_rules, vantage_trees
from .common import table
from .oracles import ORACLES

END_ID = 2


def op1_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_blocks.encode_corpus(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), END_ID)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op2_chat_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_trees.format_conversations(rows.unionByName(probe))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_scan.scan(table(spark, sf_dir, "documents"))


def op6_vantage_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = vantage_trees.usable(table(spark, sf_dir, "embeddings"))
    return vantage_trees.nearest(vectors, F.col("id") % 20 == 0)


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = pieces.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_ids", "ids_crc32", "exact")


def op8_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_chunks.report(table(spark, sf_dir, "documents"))


def op9_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.join_sets(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "copy_of", "n_copies")


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_rules.judge(pages, url_rules.mine(url_rules.labels_of_pages(pages, table(spark, sf_dir, "labels"))))


def listed_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rule list says of every page, which SQL can express; mined rules decide on the others."""
    told = url_rules.judge(table(spark, sf_dir, "pages"), url_rules.Rules(()))
    return told.select("page_id", "host", "path", "rule", "verdict")


QUERIES = {f.__name__: f for f in (op1_token_blocks, op2_chat_trees, op3_decontaminate, op4_toxicity, op5_secrets, op6_vantage_trees, op7_pieces, op8_line_chunks, op9_set_join, op10_url_rules, listed_urls)}

__all__ = ["ORACLES", "QUERIES"]
