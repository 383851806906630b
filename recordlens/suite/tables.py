"""The given tables read as record tables, in Spark and as SQL for the oracle.

Sources stand for vehicles, languages for kinds, the benchmark texts for
queries.  The mapping assigns; it drops nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.identity import trim_key
from ..functions.text import trim_ws
from ..operators.sizing import is_small, spread
from ..operators.validation import checked_queries

ANY = "all"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def day(column: Column) -> Column:
    return F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(column, F.lit(365)).cast("int"))


def kind(lang: Column) -> Column:
    return F.when(lang == "en", "complaint").when(lang == "fr", "recall").otherwise("investigation")


def trim_of(key: Column) -> Column:
    n = F.pmod(key, F.lit(4))
    return F.when(n == 1, "Base").when(n == 2, "Sport-X").when(n == 3, "base")


def litres_of(key: Column) -> Column:
    n = F.pmod(key, F.lit(3))
    return F.when(n == 1, F.lit("2.0").cast("decimal(4,1)")).when(n == 2, F.lit("3.5").cast("decimal(4,1)"))


def cylinders_of(key: Column) -> Column:
    n = F.pmod(key, F.lit(5))
    return F.when(n == 1, F.lit(4)).when(n == 2, F.lit(6)).when(n == 3, F.lit(8))


def fitted(df: DataFrame, key: str) -> DataFrame:
    k = F.col(key)
    return df.withColumns({
        "trim": trim_of(k), "trim_key": trim_key(trim_of(k)),
        "engine_litres": litres_of(k), "engine_cylinders": cylinders_of(k),
    })


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    plain = d.select(
        F.col("doc_id").alias("document_id"),
        F.regexp_extract("source", r"(\d+)", 1).cast("long").alias("vehicle_id"),
        kind(F.col("lang")).alias("kind"),
        F.col("doc_id").cast("string").alias("external_id"),
        F.concat(
            F.lit("GROUP "), F.pmod("n_chars", F.lit(5)).cast("string"),
            F.lit(":UNIT "), F.pmod("n_chars", F.lit(3)).cast("string"),
        ).alias("component"),
        day(F.col("doc_id")).alias("filed_on"),
        F.concat(F.lit("record "), F.col("doc_id").cast("string")).alias("title"),
        F.col("text").alias("body"),
    )
    return fitted(plain, "document_id")


def corpus(spark: SparkSession, sf_dir: str, embedded: bool = True) -> DataFrame:
    """One whole-body passage per document, with the vector of the same id where there is one."""
    d = documents(spark, sf_dir)
    chunks = d.withColumnRenamed("body", "text").withColumns({
        "chunk_id": F.col("document_id"), "text": trim_ws(F.col("text")),
    })
    if not embedded:
        return chunks
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return chunks.join(vectors, "chunk_id", "left")


def worded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``corpus`` without vectors: texts meet them only if a chunk has several, each of which is a row."""
    several = table(spark, sf_dir, "embeddings").where("vec_id IS NOT NULL").groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return corpus(spark, sf_dir, embedded=False) if is_small(several, 0) else corpus(spark, sf_dir).drop("embedding")


def vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "documents").select(
        F.regexp_extract("source", r"(\d+)", 1).cast("long").alias("vehicle_id"), "source"
    ).distinct()
    named = ids.select(
        "vehicle_id", F.lit("MAKER").alias("make"), F.upper("source").alias("model"),
        F.lit(None).cast("string").alias("recall_model"),
        (F.lit(2000) + F.col("vehicle_id")).cast("int").alias("model_year"),
        F.concat(F.lit("Vehicle "), F.col("source")).alias("display_name"),
        F.lit(None).cast("string").alias("vin"),
    )
    return fitted(named, "vehicle_id")


def queries(
    spark: SparkSession, sf_dir: str, mode: str = "hybrid", scope: str = ANY,
    filtered: bool = False, embedded: bool = True,
) -> DataFrame:
    """Benchmark texts as queries, spread over the vehicles; vectors by id."""
    b = table(spark, sf_dir, "benchmark")
    key = F.col("item_id")
    q = b.select(
        key.alias("query_id"),
        F.pmod(key, F.lit(20)).alias("vehicle_id"),
        "text",
        F.lit(mode).alias("mode"),
        F.lit(scope).alias("scope"),
        (F.when(F.pmod(key, F.lit(2)) == 0, "thisTrim").otherwise("allTrims") if filtered
         else F.lit("allTrims")).alias("trims"),
        (F.when(F.pmod(key, F.lit(5)) == 0, F.lit(" group 1:unit 1 ")) if filtered
         else F.lit(None).cast("string")).alias("component"),
        (F.when(F.pmod(key, F.lit(3)) == 0, F.lit("2024-03-01").cast("date")) if filtered
         else F.lit(None).cast("date")).alias("filed_from"),
        (F.when(F.pmod(key, F.lit(4)) == 0, F.lit("2024-10-31").cast("date")) if filtered
         else F.lit(None).cast("date")).alias("filed_to"),
        (F.lit(5) if filtered else F.lit(10)).alias("limit"),
    )
    if embedded:
        vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
        q = q.join(vectors, "query_id", "left")
    return q


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each investigation names the next recall of its vehicle and a window around its date."""
    from pyspark.sql import Window

    d = documents(spark, sf_dir).where(F.col("kind") != "complaint")
    following = Window.partitionBy("vehicle_id").orderBy(F.desc("document_id")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    recall = F.when(F.col("kind") == "recall", F.col("document_id"))
    named = d.withColumn("campaign", F.min(recall).over(following))
    return named.where(F.col("kind") == "investigation").select(
        F.col("document_id").alias("investigation_document_id"),
        F.coalesce(F.col("campaign").cast("string"), F.lit("unstored")).alias("campaign_number"),
        "component",
        F.date_sub("filed_on", 30).alias("opened_on"),
        F.when(F.pmod("document_id", F.lit(4)) != 0, F.date_add("filed_on", 60)).alias("closed_on"),
    )


# --- the same tables for the oracle ------------------------------------------------

DOCS = """docs AS (
  SELECT doc_id AS document_id, CAST(regexp_extract(source, '([0-9]+)', 1) AS BIGINT) AS vehicle_id,
    CASE lang WHEN 'en' THEN 'complaint' WHEN 'fr' THEN 'recall' ELSE 'investigation' END AS kind,
    CAST(doc_id AS VARCHAR) AS external_id,
    'GROUP ' || (n_chars % 5) || ':UNIT ' || (n_chars % 3) AS component,
    CAST(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS DATE) AS filed_on,
    'record ' || doc_id AS title, text AS body,
    CASE doc_id % 4 WHEN 1 THEN 'Base' WHEN 2 THEN 'Sport-X' WHEN 3 THEN 'base' END AS trim,
    CASE doc_id % 4 WHEN 1 THEN 'base' WHEN 2 THEN 'sportx' WHEN 3 THEN 'base' END AS trim_key,
    CASE doc_id % 3 WHEN 1 THEN 2.0 WHEN 2 THEN 3.5 END AS engine_litres,
    CASE doc_id % 5 WHEN 1 THEN 4 WHEN 2 THEN 6 WHEN 3 THEN 8 END AS engine_cylinders
  FROM documents)"""

VEHICLES = """vehicles AS (
  SELECT *, 'MAKER' AS make, upper(source) AS model, CAST(2000 + vehicle_id AS INTEGER) AS model_year,
    'Vehicle ' || source AS display_name,
    CASE vehicle_id % 4 WHEN 1 THEN 'Base' WHEN 2 THEN 'Sport-X' WHEN 3 THEN 'base' END AS trim,
    CASE vehicle_id % 4 WHEN 1 THEN 'base' WHEN 2 THEN 'sportx' WHEN 3 THEN 'base' END AS trim_key,
    CASE vehicle_id % 3 WHEN 1 THEN 2.0 WHEN 2 THEN 3.5 END AS engine_litres,
    CASE vehicle_id % 5 WHEN 1 THEN 4 WHEN 2 THEN 6 WHEN 3 THEN 8 END AS engine_cylinders
  FROM (SELECT DISTINCT source, CAST(regexp_extract(source, '([0-9]+)', 1) AS BIGINT) AS vehicle_id
        FROM documents))"""


def queries_sql(source: str = "benchmark", filtered: bool = False, scope: str = ANY) -> str:
    extra = """, CASE WHEN item_id % 2 = 0 THEN 'thisTrim' ELSE 'allTrims' END AS trims,
    CASE WHEN item_id % 5 = 0 THEN 'GROUP 1:UNIT 1' END AS component,
    CASE WHEN item_id % 3 = 0 THEN DATE '2024-03-01' END AS filed_from,
    CASE WHEN item_id % 4 = 0 THEN DATE '2024-10-31' END AS filed_to, 5 AS lim""" if filtered else """,
    'allTrims' AS trims, CAST(NULL AS VARCHAR) AS component, CAST(NULL AS DATE) AS filed_from,
    CAST(NULL AS DATE) AS filed_to, 10 AS lim"""
    return f"""queries AS (
  SELECT item_id AS query_id, item_id % 20 AS vehicle_id, text, '{scope}' AS scope{extra} FROM {source})"""


IGNORED = ("the and but for was were are you your this that with from have has had not can will would could "
           "should when what why how does did get got any all its it''s there then than know known problem "
           "issue vehicle car truck mine").split()


def words_sql(text: str) -> str:
    kept = rf"regexp_replace({text}, '[^\p{{L}}\p{{Nd}}\s]+', '', 'g')"
    return rf"list_filter(regexp_split_to_array({kept}, '\s+'), lambda w: w <> '')"


def terms_sql(source: str = "queries", key: str = "query_id") -> str:
    """``terms``: the distinct usable words of each query, at most 24, with their place."""
    ignored = ", ".join(f"'{w}'" for w in IGNORED)
    return f"""
words AS (SELECT {key}, generate_subscripts(w, 1) AS i, unnest(w) AS term
          FROM (SELECT {key}, {words_sql('text')} AS w FROM {source})),
firsts AS (SELECT {key}, lower(term) AS lexeme, min(i) AS i, arg_min(term, i) AS term FROM words
           WHERE length(term) >= 3 AND lower(term) NOT IN ({ignored}) GROUP BY ALL),
terms AS (SELECT {key}, term, lexeme, pos FROM (
            SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY i) - 1 AS pos FROM firsts)
          WHERE pos < 24)"""


def tokens_sql(source: str = "docs", key: str = "document_id", text: str = "body") -> str:
    return f"tokens AS (SELECT {key} AS chunk_id, unnest({words_sql(f'lower({text})')}) AS lexeme FROM {source})"


PASSES = """(q.scope = 'all' OR d.kind <> 'complaint')
  AND (q.component IS NULL OR d.component = q.component)
  AND (q.filed_from IS NULL OR d.filed_on >= q.filed_from)
  AND (q.filed_to IS NULL OR d.filed_on <= q.filed_to)"""
OWN = """(d.trim_key IS NULL OR v.trim_key IS NULL OR d.trim_key = v.trim_key)
  AND (d.engine_litres IS NULL OR v.engine_litres IS NULL OR d.engine_litres = v.engine_litres)
  AND (d.engine_cylinders IS NULL OR v.engine_cylinders IS NULL OR d.engine_cylinders = v.engine_cylinders)"""

# Sparse and dense candidate lists of ``queries`` over ``docs`` within each vehicle.
PAIRS = f"""pairs AS (SELECT q.query_id, d.document_id AS chunk_id FROM queries q
  JOIN docs d ON d.vehicle_id = q.vehicle_id JOIN vehicles v ON v.vehicle_id = q.vehicle_id
  WHERE {PASSES} AND (q.trims = 'allTrims' OR ({OWN})))"""
SPARSE = """counts AS (SELECT t.query_id, k.chunk_id, count(*) AS score
  FROM terms t JOIN tokens k USING (lexeme) SEMI JOIN pairs p
  ON p.query_id = t.query_id AND p.chunk_id = k.chunk_id GROUP BY ALL),
sparse AS (SELECT query_id, chunk_id, sparse_rank FROM (SELECT *, row_number() OVER
  (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS sparse_rank FROM counts) WHERE sparse_rank <= 50)"""
DENSE = """distances AS (SELECT p.query_id, p.chunk_id,
    round(1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS distance
  FROM pairs p JOIN embeddings a ON a.vec_id = p.query_id JOIN embeddings b ON b.vec_id = p.chunk_id),
dense AS (SELECT query_id, chunk_id, dense_rank FROM (SELECT *, row_number() OVER
  (PARTITION BY query_id ORDER BY distance, chunk_id) AS dense_rank FROM distances) WHERE dense_rank <= 50)"""
FUSED = """fused AS (SELECT query_id, chunk_id, dense_rank, sparse_rank,
    coalesce(1.0::DOUBLE / (60 + dense_rank), 0) + coalesce(1.0::DOUBLE / (60 + sparse_rank), 0) AS fused_score
  FROM dense FULL JOIN sparse USING (query_id, chunk_id)),
positions AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC, chunk_id) AS position
  FROM fused)"""


def with_sql(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n" + select


def normal_queries(q: DataFrame) -> DataFrame:
    """Queries in normal form."""
    return checked_queries(q).where("problem IS NULL").drop("problem")
