"""The operators over the given tables, one query each, and the SQL they agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from titletags.llm import bpe, language_id, oracle, pairwise_quality, toxicity
from titletags.llm.block_naming import exact_duplicates
from titletags.llm.common import documents, embeddings, id_remainder, labels, written
from titletags.llm.filter_audit import filter_audit
from titletags.llm.hard_negatives import hard_negatives
from titletags.llm.line_join import line_classes
from titletags.llm.mixing import mix
from titletags.llm.packing import pack, token_pieces
from titletags.llm.pitman_yor import score_texts
from titletags.llm.search import top_k
from titletags.llm.settings import END_ID, MIXTURE, PATTERN, VOCABULARY, WORD_PIECES, domain
from titletags.llm.simhash import near_duplicates

def op1_pairwise_quality(spark, sf_dir):
    docs, held_out = documents(spark, sf_dir), id_remainder(5) == 0
    model = pairwise_quality.fit(docs.filter(~held_out), labels(spark, sf_dir))
    return pairwise_quality.score_quality(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_mixing(spark, sf_dir):
    return mix(documents(spark, sf_dir), domain(), MIXTURE)


def op3_line_dedup(spark, sf_dir):
    return line_classes(documents(spark, sf_dir))


def op4_block_max_search(spark, sf_dir):
    """The ten best documents for every document whose id is divisible by 20."""
    docs = documents(spark, sf_dir)
    return top_k(docs, docs.filter(F.col("doc_id") % 20 == 0), k=10)


def op5_exact_dedup(spark, sf_dir):
    return exact_duplicates(documents(spark, sf_dir))


def op6_byte_bpe(spark, sf_dir):
    return bpe.digests(bpe.encoded_documents(
        documents(spark, sf_dir), VOCABULARY, PATTERN))


def op7_pitman_yor_scores(spark, sf_dir):
    docs = documents(spark, sf_dir)
    scored = score_texts(docs, id_remainder(7) != 2)
    held_out = id_remainder(7) == 2
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known",
                         "train_tokens", "base_score", "score")


def op8_toxicity_chain(spark, sf_dir):
    """Bad texts first, then toxic ones; `score` and `predicted` are about toxicity."""
    docs, held_out = documents(spark, sf_dir), id_remainder(5) == 0
    marked = labels(spark, sf_dir).select(
        "doc_id", (1 - F.col("quality")).alias("bad"), F.col("toxic"))
    chain = toxicity.fit(docs.filter(~held_out), marked, ["bad", "toxic"])
    return toxicity.score_toxicity(docs, chain).select(
        "doc_id", held_out.alias("held_out"), F.col("p_toxic").alias("score"),
        F.col("is_toxic").alias("predicted"), "p_bad", "is_bad")


def op9_simhash_near_dedup(spark, sf_dir):
    return near_duplicates(documents(spark, sf_dir))


def op10_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = language_id.fit(docs.filter(id_remainder(4) != 2))
    held_out = id_remainder(4) == 2
    return language_id.identify(docs, model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op11_best_fit_packing(spark, sf_dir):
    pieces = written(token_pieces(documents(spark, sf_dir), WORD_PIECES, END_ID))
    return pack(pieces.select("doc_id", "piece", "start", "length",
                              F.crc32("ids").alias("ids_crc32"), "part", "nth"))


def op12_hard_negatives(spark, sf_dir):
    """Where vec_id is divisible by 7 the label is a wrong one."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(
        F.col("label"))
    return hard_negatives(embeddings(spark, sf_dir).withColumn("label", label),
                          F.col("vec_id") % 50 == 0)


def op13_filter_audit(spark, sf_dir):
    return filter_audit(documents(spark, sf_dir), labels(spark, sf_dir))


QUERIES = {
    "op1_pairwise_quality": op1_pairwise_quality,
    "op2_mixing": op2_mixing,
    "op3_line_dedup": op3_line_dedup,
    "op4_block_max_search": op4_block_max_search,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_pitman_yor_scores": op7_pitman_yor_scores,
    "op8_toxicity_chain": op8_toxicity_chain,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_language_id": op10_language_id,
    "op11_best_fit_packing": op11_best_fit_packing,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE = oracle.ORACLE
