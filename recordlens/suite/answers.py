"""Answers: evidence, replies, citations and grounding."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import answers, grounding, postings, ranking
from ..plans import audit
from ..session import cut_lineage, scratch_folder
from . import tables as t
from .retrieval import _OPEN, _open_matches, _own
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


# --- citations of the texts each benchmark query finds ----------------------------


def _citations(spark, d) -> tuple[DataFrame, DataFrame]:
    """Each query cites what it found: its own text, a re-wrapped span, nothing, or a changed span.

    Spans lie near the start of a body, at two thirds of it, and at its end.  Records past the fortieth were not shown; every tenth citation names none.
    """
    # Cited, shown and pooled: ranked once.
    found = cut_lineage(ranking.rank_sparse(postings.sparse_scores(_open_matches(spark, d))))
    text = t.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("asked"))
    body = t.documents(spark, d).select(F.col("document_id").alias("chunk_id"), "body")
    r = F.col("sparse_rank")
    length = F.char_length("body")
    begin = F.when(F.pmod(r, F.lit(3)) == 0, 11).when(F.pmod(r, F.lit(3)) == 1, F.floor(length * 2 / 3)).otherwise(length - 59)
    span = F.substr(F.col("body"), F.greatest(begin.cast("int"), F.lit(1)), F.lit(60))
    quote = (
        F.when(F.pmod(r, F.lit(4)) == 0, F.col("asked"))
        .when(F.pmod(r, F.lit(4)) == 1, F.concat(F.lit(" \n"), F.regexp_replace(span, " ", "\t  "), F.lit(" ")))
        .when(F.pmod(r, F.lit(4)) == 2, F.lit(" \n\t "))
        .otherwise(F.upper(span))
    )
    cited = found.join(text, "query_id").join(body, "chunk_id").select(
        F.col("query_id").alias("answer_id"), r.alias("pos"),
        F.when(F.pmod(r, F.lit(10)) == 0, F.lit(" ")).otherwise(F.col("chunk_id").cast("string")).alias("document_id"),
        quote.alias("quote"),
    )
    shown = found.where("sparse_rank <= 40").select(
        F.col("query_id").alias("answer_id"), F.col("chunk_id").alias("document_id")
    )
    return cited, shown


def _checked(spark, d) -> DataFrame:
    cited, shown = _citations(spark, d)
    return grounding.check_citations(cited, shown, t.documents(spark, d))


_REASONS = [grounding.MISSING_DOCUMENT_ID, grounding.UNKNOWN_DOCUMENT, grounding.EMPTY_QUOTE, grounding.NOT_FOUND]
_CHECKED = [*_OPEN, """found AS (SELECT query_id, chunk_id, r FROM (SELECT query_id, chunk_id, row_number() OVER
  (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM counts) WHERE r <= 50)""", r"""
cited AS (SELECT query_id AS answer_id, r, chunk_id, body, CASE WHEN r % 10 = 0 THEN ' ' ELSE CAST(chunk_id AS VARCHAR) END
    AS document_id, regexp_replace(body, '\s', ' ', 'g') AS flat, substr(body, greatest(1, CASE r % 3 WHEN 0 THEN 11
      WHEN 1 THEN floor(length(body) * 2 / 3)::BIGINT ELSE length(body) - 59 END), 60) AS span,
    CASE r % 4 WHEN 0 THEN trim(regexp_replace(b.text, '\s+', ' ', 'g'))
      WHEN 1 THEN trim(regexp_replace(span, '\s', ' ', 'g')) WHEN 2 THEN ''
      ELSE trim(regexp_replace(upper(span), '\s', ' ', 'g')) END AS quote
  FROM found JOIN benchmark b ON b.item_id = query_id JOIN docs ON docs.document_id = chunk_id)""", f"""
checked AS (SELECT answer_id, r AS pos, document_id, chunk_id, reason, reason IS NULL AS verified,
    CASE WHEN r % 10 <> 0 AND r <= 40 AND reason IS NULL THEN strpos(flat, quote) - 1 END AS start_offset,
    CASE WHEN r % 10 <> 0 AND r <= 40 AND reason IS NULL THEN strpos(flat, quote) - 1 + length(quote) END AS end_offset
  FROM (SELECT *, CASE WHEN r % 10 = 0 THEN '{_REASONS[0]}' WHEN r > 40 THEN '{_REASONS[1]}'
    WHEN quote = '' THEN '{_REASONS[2]}' WHEN strpos(flat, quote) = 0 THEN '{_REASONS[3]}' END AS reason FROM cited))"""]


@query("verify_citations", with_sql(*_CHECKED, select="""
SELECT answer_id, CAST(pos AS INTEGER) AS pos, document_id, verified, reason, CAST(start_offset AS INTEGER) AS start_offset,
  CAST(end_offset AS INTEGER) AS end_offset FROM checked"""))
def verify_citations(spark, d):
    return _checked(spark, d).drop("quote")


@query("citation_accounting", with_sql(*_CHECKED, select="""
SELECT answer_id, count(*) AS emitted, count(*) FILTER (verified) AS verified, count(*) FILTER (NOT verified) AS dropped,
  count(*) FILTER (verified) > 0 AS is_grounded FROM checked GROUP BY ALL"""))
def citation_accounting(spark, d):
    return grounding.citation_accounting(_checked(spark, d))


@query("faithfulness", with_sql(*_CHECKED, select="""
SELECT verified, emitted, round(verified::DOUBLE / emitted, 9) AS faithfulness FROM (
  SELECT count(*) FILTER (verified) AS verified, count(*) AS emitted FROM checked)"""))
def faithfulness(spark, d):
    return grounding.faithfulness(_checked(spark, d)).select(
        "verified", "emitted", F.round("faithfulness", 9).alias("faithfulness")
    )


@query("cited_records", with_sql(*_CHECKED, select="""
SELECT answer_id, CAST(min(pos) AS INTEGER) AS pos, kind, external_id FROM checked
JOIN docs ON docs.document_id = chunk_id WHERE verified AND kind <> 'complaint' GROUP BY ALL"""))
def cited_records(spark, d):
    return grounding.cited_records(_checked(spark, d), t.documents(spark, d))


@query("uncited_matches", with_sql(*_CHECKED, select="""
SELECT f.query_id AS answer_id, external_id FROM found f JOIN docs ON docs.document_id = chunk_id
WHERE kind <> 'complaint' AND r <= 40 AND (f.query_id, chunk_id) NOT IN (
  SELECT (answer_id, chunk_id) FROM checked WHERE verified)"""))
def uncited_matches(spark, d):
    cited, shown = _citations(spark, d)
    docs = t.documents(spark, d)
    official = docs.where(F.col("kind") != "complaint").select("document_id", "external_id")
    pool = shown.join(official, "document_id").select("answer_id", "external_id")
    checked = grounding.check_citations(cited, shown, docs)
    return grounding.uncited_matches(pool, grounding.cited_records(checked, docs))


@query("citation_context", with_sql(*_CHECKED, select="""
SELECT answer_id, CAST(pos AS INTEGER) AS pos, c.document_id, left(body, start_offset) AS before,
  substr(body, start_offset + 1, end_offset - start_offset) AS highlighted, substr(body, end_offset + 1) AS after
FROM checked c JOIN docs ON docs.document_id = chunk_id WHERE verified"""))
def citation_context(spark, d):
    return grounding.citation_context(_checked(spark, d).where("verified"), t.documents(spark, d))


@query("ground_answers", with_sql(*_CHECKED, """
totals AS (SELECT answer_id, count(*) FILTER (verified) AS verified, count(*) FILTER (NOT verified) AS dropped
  FROM checked GROUP BY ALL)""", select=f"""
SELECT item_id AS answer_id, CASE WHEN verified > 0 THEN text ELSE '{grounding.NO_EVIDENCE}' END AS answer_text,
  coalesce(verified > 0, FALSE) AND item_id % 2 = 0 AS is_known_pattern, coalesce(verified > 0, FALSE) AS is_grounded,
  CASE WHEN verified > 0 THEN 1 ELSE 0 END AS campaigns, coalesce(verified, 0) AS verified_citation_count,
  coalesce(dropped, 0) AS dropped_citation_count FROM benchmark LEFT JOIN totals ON answer_id = item_id"""))
def ground_answers(spark, d):
    said = t.table(spark, d, "benchmark").select(
        F.col("item_id").alias("answer_id"), F.col("text").alias("answer_text"),
        (F.pmod("item_id", F.lit(2)) == 0).alias("is_known_pattern"),
        F.array(F.lit("17V001000")).alias("linked_campaigns"),
    )
    grounded = grounding.ground_answers(said, grounding.citation_accounting(_checked(spark, d)))
    return grounded.withColumn("campaigns", F.size("linked_campaigns")).drop("linked_campaigns")


# --- replies ---------------------------------------------------------------------


def _replies(spark, d) -> DataFrame:
    """Conversation turns as replies: well formed, malformed, and of the wrong types."""
    c = t.table(spark, d, "conversations")
    text = F.regexp_extract(F.to_json(F.struct(F.col("text").alias("x"))), r'^\{"x":(.*)\}$', 1)
    role = F.regexp_extract(F.to_json(F.struct(F.col("role").alias("x"))), r'^\{"x":(.*)\}$', 1)
    n = F.pmod("conv_id", F.lit(6))
    known = F.when(F.pmod("turn", F.lit(2)) == 0, F.lit("true")).otherwise(F.lit('"true"'))
    good = F.concat(
        F.lit('{"answer": '), text, F.lit(', "isKnownPattern": '), known,
        F.lit(', "citations": [{"documentId": "record '), F.col("turn").cast("string"), F.lit('", "quote": '), role,
        F.lit('}, "junk", {"quote": '), text, F.lit('}, {"documentId": 7, "quote": 7}], "linkedCampaigns": ['),
        role, F.lit(', "", 3, " "]}'),
    )
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"),
        F.when(n == 0, F.concat(F.lit("{"), text)).when(n == 1, F.concat(F.lit("["), text, F.lit("]")))
        .when(n == 2, F.lit('{"answer": "  "}')).when(n == 3, F.lit('{"answer": 5}')).otherwise(good).alias("reply"),
    )


_GOOD = """good AS (SELECT conv_id * 1000 + turn AS answer_id, * FROM conversations WHERE conv_id % 6 > 3)"""


@query("parse_answers", with_sql(_GOOD, select="""
SELECT answer_id, text AS answer_text, turn % 2 = 0 AS is_known_pattern, [role] AS linked_campaigns FROM good"""))
def parse_answers(spark, d):
    return answers.parse_answers(_replies(spark, d))[0]


@query("parse_citations", with_sql(_GOOD, select="""
SELECT answer_id, 0 AS pos, CAST(turn AS VARCHAR) AS document_id, role AS quote FROM good UNION ALL
SELECT answer_id, 2, '', text FROM good UNION ALL SELECT answer_id, 3, '', '' FROM good"""))
def parse_citations(spark, d):
    return answers.parse_answers(_replies(spark, d))[1]


@query("parse_failures", f"""
SELECT conv_id * 1000 + turn AS answer_id, CASE WHEN conv_id % 6 < 2 THEN '{answers.MALFORMED_JSON.replace("'", "''")}'
  ELSE '{answers.MISSING_ANSWER.replace("'", "''")}' END AS failure FROM conversations WHERE conv_id % 6 <= 3""")
def parse_failures(spark, d):
    return answers.parse_answers(_replies(spark, d))[2]


# --- evidence and the audit ------------------------------------------------------


def _questions(spark, d) -> DataFrame:
    return t.queries(spark, d).select("query_id", "vehicle_id", "text", "mode", "embedding")


def _shown(spark, d) -> DataFrame:
    docs, vehicles = t.documents(spark, d), t.vehicles(spark, d)
    wide, campaigns = audit.evidence_pools(_questions(spark, d), vehicles, t.corpus(spark, d))
    return audit.shown_records(wide, campaigns, docs)


_POOLS = """queries AS (SELECT item_id * 2 AS query_id, item_id % 20 AS vehicle_id, text, 'all' AS scope,
    'allTrims' AS trims, CAST(NULL AS VARCHAR) AS component, CAST(NULL AS DATE) AS filed_from,
    CAST(NULL AS DATE) AS filed_to, 12 AS lim FROM benchmark UNION ALL
  SELECT item_id * 2 + 1, item_id % 20, text, 'campaigns', 'allTrims', NULL, NULL, NULL, 4 FROM benchmark)"""
_SHOWN = [_POOLS, DOCS, VEHICLES, t.terms_sql(), t.tokens_sql(), PAIRS, SPARSE,
          DENSE.replace("a.vec_id = p.query_id", "a.vec_id = p.query_id // 2"), FUSED, """
shown AS (SELECT DISTINCT query_id // 2 AS query_id, vehicle_id, chunk_id AS document_id FROM positions
  JOIN (SELECT query_id, vehicle_id, lim FROM queries) USING (query_id) WHERE position <= lim)"""]


@query("evidence_pools", with_sql(*_SHOWN, select="SELECT query_id, document_id FROM shown"))
def evidence_pools(spark, d):
    return _shown(spark, d).select("query_id", "document_id")


@query("evidence_order", with_sql(*_SHOWN, select="""
SELECT query_id, document_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY document_id) AS INTEGER) AS pos
FROM shown"""))
def evidence_order(spark, d):
    return answers.evidence_order(_shown(spark, d)).select("query_id", "document_id", "pos")


@query("evidence_context", with_sql(*_SHOWN, select="""
SELECT query_id, 'Vehicle: ' || display_name || E'\\n\\nRecords:\\n' || string_agg(E'\\n\\nRECORD ' || document_id
    || E'\\nkind: ' || kind || E'\\nnhtsa id: ' || external_id || E'\\nfiled: ' || strftime(filed_on, '%Y-%m-%d')
    || E'\\ntext: ' || body || E'\\n', '' ORDER BY document_id)
  || E'\\nQuestion: ' || trim(text, E' \\n\\t\\r') AS context
FROM shown s JOIN (SELECT document_id, kind, external_id, filed_on, body FROM docs) USING (document_id)
JOIN (SELECT vehicle_id, display_name FROM vehicles) USING (vehicle_id)
JOIN benchmark ON item_id = query_id GROUP BY query_id, display_name, text"""))
def evidence_context(spark, d):
    return audit.question_contexts(_questions(spark, d), t.vehicles(spark, d), _shown(spark, d))


@query("answered_questions", "SELECT query_id, CAST(length(context) AS VARCHAR) AS reply FROM (" + ORACLE["evidence_context"] + ")")
def answered_questions(spark, d):
    """Every context goes to the answering service, here one that says how long it is."""
    contexts = audit.question_contexts(_questions(spark, d), t.vehicles(spark, d), _shown(spark, d))
    return answers.answer(contexts, lambda batch: [str(len(context)) for context in batch])


@query("mode_fallback", """
SELECT item_id AS query_id, CASE WHEN item_id % 4 = 0 OR item_id NOT IN (SELECT vec_id FROM embeddings) THEN 'sparse'
  ELSE 'hybrid' END AS mode FROM benchmark WHERE length(trim(text, E' \\n\\t\\r')) BETWEEN 2 AND 500""")
def mode_fallback(spark, d):
    """A quarter of the questions has no vector and is asked by keyword."""
    q = _own(t.queries(spark, d), spark, d).withColumn(
        "embedding", F.when(F.pmod("query_id", F.lit(4)) != 0, F.col("embedding")))
    return audit.with_fallback(q, t.corpus(spark, d)).select("query_id", "mode")


def _shown_replies(shown: DataFrame) -> DataFrame:
    """Replies that cite every shown record: rightly, wrongly, or under a foreign id."""
    n = F.pmod("document_id", F.lit(3))
    citation = F.struct(
        F.when(n == 2, F.lit("999999999")).otherwise(F.concat(F.lit("RECORD "), F.col("document_id").cast("string")))
        .alias("documentId"),
        F.when(n == 1, F.lit("no such words stand here")).otherwise(F.substr(F.col("body"), F.greatest(
            F.floor(F.char_length("body") * 2 / 3).cast("int"), F.lit(1)), F.lit(25))).alias("quote"),
    )
    cited = shown.groupBy("query_id").agg(F.collect_list(citation).alias("citations"))
    refused = F.pmod("query_id", F.lit(7)) == 0
    reply = F.to_json(F.struct(
        F.lit("So it seems.").alias("answer"), F.lit(True).alias("isKnownPattern"), F.col("citations"),
        F.array(F.lit("17V001000")).alias("linkedCampaigns"),
    ))
    return cited.select(
        "query_id", F.when(F.pmod("query_id", F.lit(5)) == 0, F.lit("not json")).otherwise(reply).alias("reply"),
        F.when(refused, F.lit("The model declined to answer this question.")).alias("refusal"),
    )


@query("audit_answers", with_sql(*_SHOWN, """
marks AS (SELECT query_id, count(*) FILTER (document_id % 3 = 0 AND trim(substr(body, greatest(1, floor(length(body) * 2 / 3)::BIGINT), 25), E' \\n\\t\\r') <> '') AS good,
    count(*) AS emitted FROM shown JOIN (SELECT document_id, body FROM docs) USING (document_id) GROUP BY ALL),
states AS (SELECT item_id, text, good, emitted, CASE WHEN emitted IS NULL THEN 'none' WHEN item_id % 7 = 0 THEN 'refused'
    WHEN item_id % 5 = 0 THEN 'broken' WHEN good > 0 THEN 'good' ELSE 'bad' END AS state
  FROM benchmark LEFT JOIN marks ON query_id = item_id)""", select=f"""
SELECT item_id AS answer_id, item_id % 20 AS vehicle_id, text AS question, CASE state
    WHEN 'none' THEN '{audit.NO_RECORDS}' WHEN 'refused' THEN 'The model declined to answer this question.'
    WHEN 'broken' THEN '{answers.MALFORMED_JSON.replace("'", "''")}' WHEN 'bad' THEN '{grounding.NO_EVIDENCE}'
    ELSE 'So it seems.' END AS answer_text, state = 'good' AS is_known_pattern, state = 'good' AS is_grounded,
  CASE WHEN state = 'good' THEN 1 ELSE 0 END AS campaigns,
  CASE WHEN state IN ('good', 'bad') THEN good ELSE 0 END AS verified_citation_count,
  CASE WHEN state IN ('good', 'bad') THEN emitted - good ELSE 0 END AS dropped_citation_count FROM states"""))
def audit_answers(spark, d):
    return _audited(spark, d).withColumn("campaigns", F.size("linked_campaigns")).drop("linked_campaigns")


def _audited(spark, d) -> DataFrame:
    shown = _shown(spark, d)
    replies = cut_lineage(_shown_replies(shown))
    return audit.audit_answers(_questions(spark, d), shown, replies, t.documents(spark, d))[0]


@query("answer_log", f"""
SELECT answer_id, vehicle_id, question, answer_text, is_grounded, verified_citation_count, dropped_citation_count
FROM ({ORACLE["audit_answers"]})""")
def answer_log(spark, d):
    """The answers as their append-only log keeps them, read back."""
    path = scratch_folder(spark)
    audit.append_answers(_audited(spark, d), path, "2026-09-06 10:00:00")
    return spark.read.parquet(path).select(
        "answer_id", "vehicle_id", "question", F.get_json_object("answer_json", "$.AnswerText").alias("answer_text"),
        (F.get_json_object("answer_json", "$.IsGrounded") == "true").alias("is_grounded"),
        "verified_citation_count", "dropped_citation_count",
    )
