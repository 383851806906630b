"""Retrieval: terms, rankings, fusion, search and its filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import snippet
from ..operators import filters, postings, ranking
from ..operators.blocks import block_ranking, pack_blocks
from ..operators.cells import cell_ranking, pack_cells
from ..operators.hits import campaign_matches, chunk_context
from ..operators.neighbours import knn
from ..operators.sizing import hot_vehicles, is_small
from ..operators.validation import QUERY_LENGTH_PROBLEM
from ..plans import search as plan
from ..session import cut_lineage
from . import tables as t
from .tables import DENSE, DOCS, FUSED, PAIRS, SPARSE, VEHICLES, with_sql

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def keep(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run
    return keep


def _one_vehicle(df: DataFrame) -> DataFrame:
    return df.withColumn("vehicle_id", F.lit(0).cast("long"))


def _open_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Every document under one vehicle: the largest scope there can be."""
    return _one_vehicle(t.corpus(spark, d, embedded=False))


def _only_vehicle(spark: SparkSession, d: str) -> DataFrame:
    """The vehicle of ``_one_vehicle``, of no known version."""
    unknown = {k: F.lit(None).cast(c) for k, c in
               (("trim_key", "string"), ("engine_litres", "decimal(4,1)"), ("engine_cylinders", "int"))}
    return _one_vehicle(t.vehicles(spark, d)).withColumns(unknown).select("vehicle_id", *unknown).distinct()


def _own(q: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    return filters.own_fit(t.normal_queries(q), t.vehicles(spark, d))


@query("query_terms", with_sql(t.terms_sql("benchmark", "item_id"), select="""
SELECT item_id AS query_id, CAST(pos AS INTEGER) AS pos, term FROM terms"""))
def query_terms(spark, d):
    b = t.table(spark, d, "benchmark").withColumnRenamed("item_id", "query_id")
    return postings.query_terms(b).select("query_id", "pos", "term")


@query("postings", with_sql(DOCS, t.tokens_sql(), select="""
SELECT chunk_id, lexeme, CAST(count(*) AS INTEGER) AS tf FROM tokens GROUP BY ALL"""))
def build_postings(spark, d):
    return postings.build_postings(t.corpus(spark, d, embedded=False)).select("chunk_id", "lexeme", "tf")


_OPEN = [DOCS, t.terms_sql("benchmark", "item_id"), t.tokens_sql(),
         """counts AS (SELECT item_id AS query_id, chunk_id, count(*) AS score, count(DISTINCT lexeme) AS words
  FROM terms JOIN tokens USING (lexeme) GROUP BY ALL)"""]


def _open_matches(spark, d):
    q = _one_vehicle(t.queries(spark, d, mode="sparse", embedded=False))
    own = filters.own_fit(q, _only_vehicle(spark, d))
    return postings.match_terms(
        postings.query_terms(own), postings.tokens_of(_open_corpus(spark, d)),
        plan.hot_or_none(_open_corpus(spark, d), is_small(q)),
    )


@query("sparse_topk", with_sql(*_OPEN, select="""
SELECT query_id, chunk_id, CAST(sparse_rank AS INTEGER) AS sparse_rank FROM (SELECT *, row_number() OVER
  (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS sparse_rank FROM counts) WHERE sparse_rank <= 50"""))
def sparse_topk(spark, d):
    return ranking.rank_sparse(postings.sparse_scores(_open_matches(spark, d)))


@query("sparse_topk_distinct_terms", with_sql(*_OPEN, select="""
SELECT query_id, chunk_id, CAST(sparse_rank AS INTEGER) AS sparse_rank FROM (SELECT *, row_number() OVER
  (PARTITION BY query_id ORDER BY words DESC, chunk_id) AS sparse_rank FROM counts) WHERE sparse_rank <= 50"""))
def sparse_topk_distinct(spark, d):
    return ranking.rank_sparse(postings.sparse_scores(_open_matches(spark, d), "distinct"))


@query("sparse_topk_blocks", with_sql(*_OPEN, select="""
SELECT query_id, chunk_id, CAST(sparse_rank AS INTEGER) AS sparse_rank FROM (SELECT *, row_number() OVER
  (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS sparse_rank FROM counts) WHERE sparse_rank <= 50"""))
def sparse_topk_blocks(spark, d):
    """``sparse_topk`` from stored blocks."""
    q = filters.own_fit(_one_vehicle(t.queries(spark, d, mode="sparse", embedded=False)), _only_vehicle(spark, d))
    return block_ranking(q, cut_lineage(pack_blocks(_open_corpus(spark, d))))


_SCOPED = [DOCS, VEHICLES, t.terms_sql(), t.tokens_sql(), PAIRS, SPARSE]


@query("sparse_topk_pool", with_sql(t.queries_sql(scope="campaigns"), *_SCOPED, select="""
SELECT query_id, chunk_id, CAST(sparse_rank AS INTEGER) AS sparse_rank FROM sparse"""))
def sparse_topk_pool(spark, d):
    q = _own(t.queries(spark, d, mode="sparse", scope="campaigns", embedded=False), spark, d)
    c = t.corpus(spark, d, embedded=False)
    return plan.sparse_ranking(q, postings.tokens_of(c), plan.hot_or_none(c, is_small(q)))


@query("sparse_topk_blocks_filtered", with_sql(t.queries_sql(filtered=True), *_SCOPED, select="""
SELECT query_id, chunk_id, CAST(sparse_rank AS INTEGER) AS sparse_rank FROM sparse"""))
def sparse_topk_blocks_filtered(spark, d):
    """Every filter of a query, on blocks of its vehicle."""
    q = _own(t.queries(spark, d, mode="sparse", filtered=True, embedded=False), spark, d)
    return block_ranking(q, cut_lineage(pack_blocks(t.corpus(spark, d, embedded=False), chunks_a_block=64)))


@query("sparse_score_single", with_sql(t.queries_sql(), *_SCOPED, select="""
SELECT query_id, chunk_id, CAST(NULL AS INTEGER) AS dense_rank, CAST(sparse_rank AS INTEGER) AS sparse_rank,
  round(1.0::DOUBLE / (60 + sparse_rank), 9) AS fused_score FROM sparse"""))
def sparse_score_single(spark, d):
    q = _own(t.queries(spark, d, mode="sparse", embedded=False), spark, d)
    c = t.corpus(spark, d, embedded=False)
    ranked = plan.sparse_ranking(q, postings.tokens_of(c), plan.hot_or_none(c, is_small(q)))
    return ranking.explain_single(ranked, "sparse").withColumn("fused_score", F.round("fused_score", 9))


_DENSE_TOPK = """
SELECT query_id, chunk_id, CAST(dense_rank AS INTEGER) AS dense_rank, distance FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS dense_rank FROM (
    SELECT item_id AS query_id, b.vec_id AS chunk_id,
      round(1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS distance
    FROM benchmark JOIN embeddings a ON a.vec_id = item_id, embeddings b)) WHERE dense_rank <= 50"""


def _open_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Every stored vector under one vehicle, of no known date or version."""
    return t.table(spark, d, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), "embedding", F.lit(0).cast("long").alias("vehicle_id"),
        F.lit("complaint").alias("kind"), F.lit(None).cast("string").alias("component"),
        F.lit(None).cast("date").alias("filed_on"), F.lit(None).cast("string").alias("trim_key"),
        F.lit(None).cast("decimal(4,1)").alias("engine_litres"),
        F.lit(None).cast("int").alias("engine_cylinders"),
    )


@query("dense_topk", _DENSE_TOPK)
def dense_topk(spark, d):
    """Every benchmark vector against every stored vector, all in one scope."""
    vectors = _open_vectors(spark, d)
    q = _one_vehicle(t.queries(spark, d, mode="dense"))
    own = filters.own_fit(q, _only_vehicle(spark, d))
    return knn(own, vectors, plan.hot_or_none(vectors, is_small(q))).withColumn("distance", F.round("distance", 9))


@query("dense_topk_cells", _DENSE_TOPK)
def dense_topk_cells(spark, d):
    """``dense_topk`` from stored cells."""
    own = filters.own_fit(_one_vehicle(t.queries(spark, d, mode="dense")), _only_vehicle(spark, d))
    return cell_ranking(own, cut_lineage(pack_cells(_open_vectors(spark, d)))).withColumn("distance", F.round("distance", 9))


@query("dense_topk_cells_filtered", with_sql(t.queries_sql(filtered=True), DOCS, VEHICLES, PAIRS, DENSE, select="""
SELECT query_id, chunk_id, CAST(dense_rank AS INTEGER) AS dense_rank FROM dense"""))
def dense_topk_cells_filtered(spark, d):
    """Every filter of a query, on cells of its vehicle."""
    q = _own(t.queries(spark, d, mode="dense", filtered=True), spark, d)
    return cell_ranking(q, cut_lineage(pack_cells(t.corpus(spark, d)))).select("query_id", "chunk_id", "dense_rank")


@query("dense_topk_by_label", """
SELECT query_id, chunk_id, CAST(dense_rank AS INTEGER) AS dense_rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS dense_rank FROM (
    SELECT a.vec_id AS query_id, b.vec_id AS chunk_id,
      round(1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS distance
    FROM embeddings a JOIN embeddings b USING (label))) WHERE dense_rank <= 50""")
def dense_topk_by_label(spark, d):
    """Every vector against the vectors of its label, by the shuffled path."""
    vectors = t.table(spark, d, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), "embedding", F.col("label").cast("long").alias("vehicle_id"),
        F.lit("complaint").alias("kind"), F.lit(None).cast("string").alias("component"),
        F.lit(None).cast("date").alias("filed_on"), F.lit(None).cast("string").alias("trim_key"),
        F.lit(None).cast("decimal(4,1)").alias("engine_litres"),
        F.lit(None).cast("int").alias("engine_cylinders"),
    )
    asked = vectors.select(
        F.col("chunk_id").alias("query_id"), "vehicle_id", "embedding", F.lit("all").alias("scope"),
        F.lit("allTrims").alias("trims"), "component", F.col("filed_on").alias("filed_from"),
        F.col("filed_on").alias("filed_to"), F.col("trim_key").alias("own_trim_key"),
        F.col("engine_litres").alias("own_engine_litres"),
        F.col("engine_cylinders").alias("own_engine_cylinders"),
    )
    return knn(asked, vectors, hot_vehicles(vectors, 20)).select("query_id", "chunk_id", "dense_rank")


_HYBRID = [*_SCOPED, DENSE, FUSED]


@query("hybrid_rrf", with_sql(t.queries_sql(), *_HYBRID, select="""
SELECT query_id, chunk_id, CAST(dense_rank AS INTEGER) AS dense_rank, CAST(sparse_rank AS INTEGER) AS sparse_rank,
  round(fused_score, 9) AS fused_score, CAST(position AS INTEGER) AS position FROM positions"""))
def hybrid_rrf(spark, d):
    q = _own(t.queries(spark, d), spark, d)
    return plan.fused_ranking(q, t.corpus(spark, d), is_small(q)).withColumn(
        "fused_score", F.round("fused_score", 9)
    )


@query("chunk_contexts", with_sql(DOCS, select="""
SELECT document_id * 10 AS chunk_id, document_id, vehicle_id, kind, external_id, component, filed_on FROM docs"""))
def chunk_contexts(spark, d):
    """Chunks meet the records they were cut from."""
    docs = t.documents(spark, d)
    chunks = docs.select((F.col("document_id") * 10).alias("chunk_id"), "document_id", F.col("body").alias("text"))
    return chunk_context(chunks, docs).select(
        "chunk_id", "document_id", "vehicle_id", "kind", "external_id", "component", "filed_on")


_HITS = """SELECT query_id, CAST(position AS INTEGER) AS position, document_id, chunk_id, kind, external_id, title,
  d.component, filed_on, CASE WHEN length(s) <= 240 THEN s
    ELSE CASE WHEN contains(left(s, 241), ' ') THEN regexp_extract(left(s, 241), '^(.*) ', 1) ELSE left(s, 240) END
      || '…' END AS snippet,
  CAST(dense_rank AS INTEGER) AS dense_rank, CAST(sparse_rank AS INTEGER) AS sparse_rank,
  round_even(fused_score, 5) AS fused_score, dense_rank IS NOT NULL AND sparse_rank IS NOT NULL AS found_by_both,
  CASE WHEN trim IS NOT NULL OR engine_litres IS NOT NULL OR engine_cylinders IS NOT NULL THEN
    concat_ws(' · ', trim, regexp_replace(CAST(engine_litres AS VARCHAR), '\\.0$', '') || 'L',
      engine_cylinders || ' cyl') END AS trim
FROM positions p JOIN (SELECT *, trim(regexp_replace(body, '\\s+', ' ', 'g')) AS s FROM docs) d
  ON d.document_id = p.chunk_id JOIN (SELECT query_id, lim FROM queries) q USING (query_id) WHERE position <= lim"""


@query("search_hits", with_sql(t.queries_sql(), *_HYBRID, select=_HITS))
def search_hits(spark, d):
    """The flagship: hybrid search of every benchmark text within its vehicle."""
    hits, _ = plan.search(t.queries(spark, d), t.vehicles(spark, d), t.corpus(spark, d))
    return hits


@query("search_rejects", """
SELECT query_id, CASE WHEN length(trim(coalesce(text, ''), E' \\n\\t\\r')) NOT BETWEEN 2 AND 500 THEN 'malformed'
  WHEN item_id % 25 >= 20 THEN 'unknown vehicle' ELSE 'no vector' END AS kind
FROM (SELECT *, item_id AS query_id FROM benchmark)
WHERE length(trim(coalesce(text, ''), E' \\n\\t\\r')) NOT BETWEEN 2 AND 500 OR item_id % 25 >= 20
  OR (item_id % 4 = 0 AND item_id % 3 <> 0) OR item_id NOT IN (SELECT vec_id FROM embeddings) AND item_id % 3 <> 0""")
def search_rejects(spark, d):
    """Unknown vehicles, and queries of two of three modes without a vector of their own."""
    key = F.col("query_id")
    asked = t.queries(spark, d).withColumns({
        "vehicle_id": F.pmod(key, F.lit(25)),
        "mode": F.element_at(F.array(F.lit("sparse"), F.lit("dense"), F.lit("hybrid")), (F.pmod(key, F.lit(3)) + 1).cast("int")),
        "embedding": F.when(F.pmod(key, F.lit(4)) != 0, F.col("embedding")),
    })
    _, rejects = plan.search(asked, t.vehicles(spark, d), t.corpus(spark, d))
    kind = F.when(F.col("problem") == plan.NO_QUERY_VECTOR, "no vector").when(
        F.col("problem") == QUERY_LENGTH_PROBLEM, "malformed").otherwise("unknown vehicle")
    return rejects.select("query_id", kind.alias("kind"))


@query("search_filtered", with_sql(t.queries_sql(filtered=True), *_HYBRID, select=_HITS))
def search_filtered(spark, d):
    """Search with component, date and fit filters and a limit of five."""
    hits, _ = plan.search(t.queries(spark, d, filtered=True), t.vehicles(spark, d), t.corpus(spark, d))
    return hits


@query("search_filtered_shuffled", with_sql(t.queries_sql(filtered=True), *_HYBRID, select=_HITS))
def search_filtered_shuffled(spark, d):
    """The same search by the paths taken when there are too many queries to broadcast."""
    hits, _ = plan.search(
        t.queries(spark, d, filtered=True), t.vehicles(spark, d), t.corpus(spark, d), small=False
    )
    return hits


@query("campaign_matches", with_sql(t.queries_sql(scope="campaigns"), *_HYBRID, select="""
SELECT query_id, CAST(position AS INTEGER) AS position, document_id, kind, external_id, title, d.component, filed_on
FROM positions p JOIN docs d ON d.document_id = p.chunk_id WHERE position <= 10"""))
def matches(spark, d):
    hits, _ = plan.search(t.queries(spark, d, scope="campaigns"), t.vehicles(spark, d), t.corpus(spark, d))
    return campaign_matches(hits)


@query("distinct_document_order", with_sql(t.queries_sql(), *_HYBRID, """
best AS (SELECT query_id, vehicle_id * 100 + d.document_id % 10 AS document_id, min(position) AS best
  FROM positions p JOIN docs d ON d.document_id = p.chunk_id GROUP BY ALL)""", select="""
SELECT query_id, document_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY best, document_id) AS INTEGER)
  AS rank FROM best"""))
def distinct_document_order(spark, d):
    """Ranked chunks folded into the larger records they are taken to belong to."""
    c = t.corpus(spark, d)
    q = _own(t.queries(spark, d), spark, d)
    small = is_small(q)
    owner = c.select("chunk_id", (F.col("vehicle_id") * 100 + F.pmod("chunk_id", F.lit(10))).alias("document_id"))
    ranked = plan.fused_ranking(q, c, small)
    return ranking.document_order(owner.join(F.broadcast(ranked) if small else ranked, "chunk_id"))


@query("distinct_document_ids", with_sql(t.queries_sql(), *_HYBRID, select="""
SELECT query_id, list(chunk_id ORDER BY position) AS document_ids FROM positions WHERE position <= 10 GROUP BY ALL"""))
def distinct_document_ids(spark, d):
    hits, _ = plan.search(t.queries(spark, d), t.vehicles(spark, d), t.corpus(spark, d))
    return ranking.distinct_ids(hits)


@query("fit_filter", with_sql(DOCS, VEHICLES, select=f"""
SELECT d.document_id, d.vehicle_id FROM docs d JOIN vehicles v USING (vehicle_id) WHERE {t.OWN}"""))
def fit_filter(spark, d):
    return filters.within_fit(t.documents(spark, d), t.vehicles(spark, d)).select("document_id", "vehicle_id")


@query("other_version_count", with_sql(DOCS, VEHICLES, t.queries_sql(filtered=True), select=f"""
SELECT q.query_id, count(d.document_id) FILTER (NOT ({t.OWN})) AS other_trims
FROM queries q JOIN vehicles v USING (vehicle_id) LEFT JOIN docs d ON d.vehicle_id = q.vehicle_id AND {t.PASSES}
GROUP BY ALL"""))
def other_version_count(spark, d):
    return plan.other_trims(t.queries(spark, d, filtered=True), t.vehicles(spark, d),
                            t.corpus(spark, d, embedded=False))


@query("filtered_records", with_sql(DOCS, t.queries_sql(filtered=True), select=f"""
SELECT q.query_id, count(*) AS records FROM queries q JOIN docs d USING (vehicle_id) WHERE {t.PASSES} GROUP BY ALL"""))
def filtered_records(spark, d):
    q = _own(t.queries(spark, d, filtered=True, embedded=False), spark, d)
    return t.documents(spark, d).alias("r").join(
        q.alias("q"), (F.col("r.vehicle_id") == F.col("q.vehicle_id")) & filters.passes("r", "q", trims=False)
    ).groupBy("q.query_id").agg(F.count(F.lit(1)).alias("records"))


@query("dense_ready", with_sql(t.queries_sql(filtered=True), DOCS, VEHICLES, PAIRS, select="""
SELECT q.query_id, q.query_id IN (SELECT query_id FROM pairs JOIN embeddings ON vec_id = chunk_id) AS ready
FROM queries q"""))
def dense_ready(spark, d):
    q = _own(t.queries(spark, d, filtered=True, embedded=False), spark, d)
    ready, waiting = filters.dense_ready(q, t.corpus(spark, d))
    return ready.select("query_id", F.lit(True).alias("ready")).unionByName(
        waiting.select("query_id", F.lit(False).alias("ready"))
    )


@query("unknown_scope", """
SELECT item_id AS query_id, (item_id % 25) IN (SELECT CAST(regexp_extract(source, '([0-9]+)', 1) AS BIGINT)
  FROM documents) AS known FROM benchmark""")
def unknown_scope(spark, d):
    q = t.queries(spark, d, embedded=False).withColumn("vehicle_id", F.pmod("query_id", F.lit(25)))
    known, unknown = filters.reject_unknown_scope(q, t.vehicles(spark, d))
    return known.select("query_id", F.lit(True).alias("known")).unionByName(
        unknown.select("query_id", F.lit(False).alias("known"))
    )


@query("snippets", """
SELECT doc_id, CASE WHEN length(s) <= 240 THEN s ELSE
  CASE WHEN contains(left(s, 241), ' ') THEN regexp_extract(left(s, 241), '^(.*) ', 1) ELSE left(s, 240) END
  || '…' END AS snippet
FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS s FROM documents)""")
def snippets(spark, d):
    return t.table(spark, d, "documents").select("doc_id", snippet(F.col("text")).alias("snippet"))
