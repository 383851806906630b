"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

import functools
import math
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import scratch_folder, steady_unions
from . import bpe, jaccard_join, lattice, line_windows, mixing, negatives, phrases, pu_quality, rules, spotsigs, token_files, toxicity, warc
from .common import fold, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(run):
    @functools.wraps(run)
    def steady(spark, sf_dir):
        steady_unions(spark)
        return run(spark, sf_dir)

    QUERIES[run.__name__] = steady
    return steady


def vocabulary(name: str) -> bytes:
    """A public tokenizer's file, read where the query is written and broadcast from there."""
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_bytes()


@query
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_folder(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    token_files.write_tokens(docs, path, vocabulary("word_bpe_49k.json").decode(), end=2)
    return token_files.id_checksums(token_files.read_tokens(spark, path))


@query
def op2_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = spotsigs.fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return prints.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        spotsigs.fingerprint(F.col("sigs")).alias("fingerprint"), spotsigs.fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        spotsigs.likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        spotsigs.likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"))


@query
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def unigram_pieces() -> list[tuple[str, float]]:
    """The normal pieces of the public piece vocabulary.  Its scores are falling ranks; a piece's weight is one by its rank."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    odd = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
    return [(model.id_to_piece(k), -math.log(1 - model.get_score(k))) for k in range(model.get_piece_size()) if not any(f(k) for f in odd)]


@query
def op4_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), unigram_pieces())


@query
def op5_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_windows.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


ORACLE["op5_line_windows"] = line_windows.ORACLE


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"))


@query
def op7_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.size("spans").alias("stretches"))


@query
def op9_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = pu_quality.learn(docs, table(spark, sf_dir, "labels"))
    return pu_quality.score(docs, model).select(
        "doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= pu_quality.CUT).cast("int").alias("predicted"))


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = rules.apply_rules(docs, table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                         "n_lines", "n_distinct", "n_bare")


@query
def op11_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_folder(spark)
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE["op11_warc_bundles"] = warc.ORACLE


@query
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(negatives.taking_part(table(spark, sf_dir, "embeddings"), label=label), F.col("vec_id") % 100 == 0)


ORACLE["op12_hard_negatives"] = negatives.ORACLE


@query
def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


ORACLE["op13_phrase_mining"] = phrases.ORACLE
