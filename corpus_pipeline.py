"""The corpus pipeline: each stage works on all that the one before it kept.

1. Toxic documents go.
2. Later occurrences of three-line windows are cut out; a document with nothing left goes.
3. Of each group of copies and near copies one document stays.
4. The sources are mixed to target weights, by whole documents.
5. The texts are encoded, and decoded again as a check.

A row is a document; only the mix repeats rows.  Missing ids and texts pass
through: a missing text is not toxic, has no lines, no copies and no words, so the
mix never takes it.  Further columns pass through whatever their names: a stage's own
columns never stand beside them.  Rows of one id and one set of shingles are copies; of these the
one whose text hashes lowest stays, and of equal texts the one whose other columns, as
text, come first, so reruns agree.  Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from recordlens.llm import bpe, jaccard_join, line_windows, mixing, toxicity
from recordlens.llm.common import table
from recordlens.llm.suite import vocabulary
from recordlens.session import cut_lineage, steady_unions


def framed(docs: DataFrame, *read: str) -> DataFrame:
    """The columns a stage reads, and all others but the text in one struct, where no made name can meet them."""
    return docs.select(*read, F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_row"))


def unframed(df: DataFrame, columns: list[str], **changed) -> DataFrame:
    """The columns of ``documents`` again, in their order, with the text as it is now and what the stage changed."""
    return df.select(*[
        changed[c].alias(c) if c in changed else F.col("text") if c == "text" else F.col("_row")[c].alias(c) for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose whole text scores below the threshold; learned from ``labels`` as the single operator is."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(framed(docs, "text"), model, made="_toxicity")
    return unframed(scored.where(F.col("_toxicity") < toxicity.CUT), docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; ``n_chars`` follows the text."""
    steady_unions(spark)
    cut = line_windows.dedup_lines(framed(docs, "doc_id", "text"))
    left = (F.col("n_removed") == 0) | F.regexp_like("text", F.lit(line_windows.HAS_WORD))
    n_chars = F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col("_row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return unframed(cut.where(left), docs.columns, n_chars=n_chars)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links connect: the one with the least id.  Documents without words all stay."""
    steady_unions(spark)
    rows, classes = jaccard_join.similar(docs)
    heads = classes.where(F.col("key") == F.col("class_key")).select(F.col("copy_id").alias("_head_id"), F.col("key").alias("_head"))
    with_key = jaccard_join.with_keys(framed(docs, "doc_id", "text"), "_key")
    # By id and key: a key alone may be that of a third of all documents.
    mine = (F.col("_key") == F.col("_head")) & F.col("doc_id").eqNullSafe(F.col("_head_id"))
    kept = with_key.join(heads.hint("merge"), mine, "left").where(F.col("_key").isNull() | F.col("_head").isNotNull())
    # Rows with one id and one set of shingles are copies of each other too.
    first = F.row_number().over(Window.partitionBy("_key", "doc_id").orderBy(F.xxhash64("text"), F.col("_row").cast("string")))
    worded = kept.where(F.col("_key").isNotNull()).withColumn("_first", first).where(F.col("_first") == 1)
    return unframed(worded, docs.columns).unionByName(unframed(kept.where(F.col("_key").isNull()), docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix, a row for each time a document is taken, gathered by output shard and shuffled within it."""
    taken = mixing.dealt_out(mixing.mix(framed(docs, "doc_id", "source", "text"), whole=True))
    return unframed(taken, docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, n_tokens``, the ids, and digests of the ids and of the text they decode to."""
    import public_tokenizers

    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True)
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard", drop_near_copies),
    ("source_mix", mix_sources),
    ("byte_bpe", encode),
]
ORACLE_SQL = None  # trained scores, sampled blocks and merges by rank have no SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared checkpoint folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
