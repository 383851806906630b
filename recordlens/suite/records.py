"""Records: feeds, planning, passages, links, identity and stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import dates, identity
from ..functions.vectors import hash_bytes
from ..operators import ground_truth, names, passages, planning, validation
from ..plans import decode, embed, load
from ..session import cut_lineage, scratch_folder
from ..sources import feeds, flatfile, tables as stored
from . import tables as t
from .tables import DOCS, with_sql

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def keep(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run
    return keep


# --- feeds -----------------------------------------------------------------------


def _envelopes(records: DataFrame, element: Column, key: Column) -> DataFrame:
    """Feed responses written from table rows: one envelope per key."""
    return records.groupBy(key.cast("string").alias("path")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("doc_id"), F.to_json(element).alias("j")))).alias("rows")
    ).select("path", F.concat(
        F.lit('{"Count": 1, "Results": ['), F.array_join(F.transform("rows", lambda r: r["j"]), ", "), F.lit("]}")
    ).alias("body"))


def _response(docs: DataFrame) -> Column:
    """Eight records a response, in the order of their ids."""
    return F.floor(F.col("doc_id") / 8)


def _slash(date: Column, key: Column) -> Column:
    """Dates written month first, day first, or not at all."""
    return F.when(F.pmod(key, F.lit(3)) == 0, F.date_format(date, "MM/dd/yyyy")).when(
        F.pmod(key, F.lit(3)) == 1, F.date_format(date, "d/M/yyyy")
    ).otherwise(F.lit("not a date"))


_SLASH_SQL = """CASE doc_id % 3 WHEN 0 THEN strftime(day, '%m/%d/%Y')
  WHEN 1 THEN CAST(day(day) AS VARCHAR) || '/' || CAST(month(day) AS VARCHAR) || '/' || year(day)
  ELSE 'not a date' END"""
_READ_SQL = """coalesce(try_strptime({0}, '%m/%d/%Y'), try_strptime({0}, '%d/%m/%Y'))::DATE"""
_DAYS = "days AS (SELECT *, CAST(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS DATE) AS day FROM documents)"


def _complaint_feed(spark, d) -> DataFrame:
    docs = t.table(spark, d, "documents")
    element = F.struct(
        F.col("doc_id").alias("odiNumber"), F.col("lang").alias("COMPONENTS"),
        F.col("text").alias("summary"), _slash(t.day(F.col("doc_id")), F.col("doc_id")).alias("dateComplaintFiled"),
        (F.col("n_chars") > 1000).alias("crash"),
    )
    return feeds.complaints_from(_envelopes(docs, element, _response(docs)))


@query("complaints_feed", with_sql(_DAYS, f"written AS (SELECT *, {_SLASH_SQL} AS s FROM days)", select=f"""
SELECT doc_id % 8 AS seq, CAST(doc_id AS VARCHAR) AS odi_number, lang AS components, text AS summary, {_READ_SQL.format('s')} AS filed_on,
  '' AS vin FROM written"""))
def complaints_feed(spark, d):
    return _complaint_feed(spark, d).select(F.col("feed_order.seq").alias("seq"), "odi_number", "components", "summary", "filed_on", "vin")


@query("recalls_feed", with_sql(_DAYS, f"written AS (SELECT *, {_SLASH_SQL} AS s FROM days)", select=f"""
SELECT doc_id % 8 AS seq, source || '-' || doc_id AS campaign_number, lang AS component, text AS summary, '' AS consequence,
  CASE WHEN n_chars > 1000 THEN 'True' ELSE 'False' END AS remedy, {_READ_SQL.format('s')} AS received_on
FROM written"""))
def recalls_feed(spark, d):
    docs = t.table(spark, d, "documents")
    element = F.struct(
        F.concat_ws("-", "source", "doc_id").alias("NHTSACampaignNumber"), F.col("lang").alias("Component"),
        F.col("text").alias("Summary"), F.array("lang").alias("Consequence"),
        (F.col("n_chars") > 1000).alias("Remedy"),
        _slash(t.day(F.col("doc_id")), F.col("doc_id")).alias("ReportReceivedDate"),
    )
    return feeds.recalls_from(_envelopes(docs, element, _response(docs))).select(
        F.col("feed_order.seq").alias("seq"), "campaign_number", "component", "summary", "consequence", "remedy", "received_on"
    )


@query("ambiguous_dates", with_sql(_DAYS, f"written AS (SELECT *, {_SLASH_SQL} AS s FROM days)", select="""
SELECT CAST(doc_id AS VARCHAR) AS odi_number, s AS filed_text FROM written
WHERE try_strptime(s, '%m/%d/%Y') <> try_strptime(s, '%d/%m/%Y')"""))
def ambiguous_dates(spark, d):
    return feeds.ambiguous_dates(_complaint_feed(spark, d), "filed_text").select("odi_number", "filed_text")


@query("slash_dates", """
SELECT o_orderkey, coalesce(try_strptime(m, '%m/%d/%Y'), try_strptime(m, '%d/%m/%Y'))::DATE AS month_first,
  coalesce(try_strptime(f, '%m/%d/%Y'), try_strptime(f, '%d/%m/%Y'))::DATE AS day_first,
  coalesce(try_strptime(f, '%m/%d/%Y') <> try_strptime(f, '%d/%m/%Y'), FALSE) AS ambiguous,
  o_orderdate::DATE AS compact
FROM (SELECT *, strftime(o_orderdate, '%m/%d/%Y') AS m, strftime(o_orderdate, '%d/%m/%Y') AS f FROM orders)""")
def slash_dates(spark, d):
    m, f = F.date_format("o_orderdate", "MM/dd/yyyy"), F.date_format("o_orderdate", "dd/MM/yyyy")
    return t.table(spark, d, "orders").select(
        "o_orderkey", dates.slash_date(m).alias("month_first"), dates.slash_date(f).alias("day_first"),
        dates.is_ambiguous_date(f).alias("ambiguous"),
        dates.compact_date(F.date_format("o_orderdate", "yyyyMMdd")).alias("compact"),
    )


@query("classify_envelopes", """
SELECT event_id, CASE event_type WHEN 'click' THEN 'empty' WHEN 'view' THEN 'rows' WHEN 'signup' THEN 'failed'
  WHEN 'purchase' THEN 'empty' ELSE 'failed' END AS outcome FROM events""")
def classify_envelopes(spark, d):
    """Responses made of event payloads: a body and a status per event type."""
    e = t.table(spark, d, "events")
    kind = F.col("event_type")
    responses = e.select(
        "event_id",
        F.when(kind.isin("click", "view", "purchase"), F.lit(200)).otherwise(F.lit(503)).alias("status"),
        F.when(kind == "click", F.concat(F.lit('{"results": [], "p": '), "props", F.lit("}")))
        .when(kind == "view", F.concat(F.lit('{"RESULTS": ['), "props", F.lit("]}")))
        .when(kind == "signup", F.concat(F.lit('{"results": null, "p": '), "props", F.lit("}")))
        .when(kind == "purchase", F.col("props"))
        .otherwise(F.concat(F.lit("<html>"), "props")).alias("body"),
    )
    return feeds.classify_envelopes(responses).select("event_id", "outcome")


@query("rejected_envelopes", f"""
SELECT CAST(event_id AS VARCHAR) AS path, CASE WHEN event_type IN ('purchase', 'signup') THEN '{feeds.NO_RESULTS}'
  ELSE '{feeds.NOT_JSON}' END AS reason FROM events WHERE event_type NOT IN ('click', 'view')""")
def rejected_envelopes(spark, d):
    """The same bodies, by what keeps them from giving rows."""
    kind = F.col("event_type")
    bodies = t.table(spark, d, "events").select(
        F.col("event_id").cast("string").alias("path"),
        F.when(kind == "click", F.concat(F.lit('{"results": [], "p": '), "props", F.lit("}")))
        .when(kind == "view", F.concat(F.lit('{"RESULTS": ['), "props", F.lit("]}")))
        .when(kind == "signup", F.concat(F.lit('{"results": null, "p": '), "props", F.lit("}")))
        .when(kind == "purchase", F.col("props"))
        .otherwise(F.concat(F.lit("<html>"), "props")).alias("body"),
    )
    return feeds.rejected_envelopes(bodies)


@query("registry", """
SELECT 'MAKER' || s_nationkey AS make, upper(s_name) AS model, 2000 + s_nationkey AS model_year,
  'Car of ' || s_name AS display_name FROM supplier""")
def registry(spark, d):
    """Suppliers as the vehicles of settings files, one file a nation."""
    s = t.table(spark, d, "supplier")
    vehicle = F.struct(
        F.format_string("maker%s", "s_nationkey").alias("Make"), F.col("s_name").alias("Model"),
        (F.col("s_nationkey") + 2000).alias("ModelYear"), F.concat(F.lit(" Car of "), "s_name").alias("DisplayName"),
    )
    path = scratch_folder(spark)
    s.groupBy("s_nationkey").agg(F.collect_list(vehicle).alias("Vehicles")).select(
        F.col("s_nationkey").alias("nation"), F.to_json(F.struct(F.struct("Vehicles").alias("Registry"))).alias("value")
    ).write.partitionBy("nation").text(path)
    return feeds.read_registry(spark, path).select("make", "model", "model_year", "display_name")


@query("model_names", """
SELECT upper(p_brand) AS make, p_size AS model_year, min(p_name) AS model FROM part GROUP BY 1, 2, p_name""")
def model_names(spark, d):
    """Part names as models by brand and size, each written in two spellings."""
    p = t.table(spark, d, "part")
    both = p.select("p_partkey", "p_brand", "p_size", F.explode(F.array(
        F.struct(F.lit(0).alias("n"), F.col("p_name").alias("name")),
        F.struct(F.lit(1).alias("n"), F.concat(F.lit(" "), F.upper("p_name")).alias("name")),
    )).alias("s"))
    return feeds.distinct_model_names(both.select(
        F.struct(F.col("s.n"), F.col("p_partkey")).alias("feed_order"), F.upper("p_brand").alias("make"),
        F.col("p_size").alias("model_year"), F.col("s.name").alias("model"),
    ))


def _flat_lines(spark, d) -> DataFrame:
    """Every third text is missing its last column; odd ones hold a tab inside it."""
    docs = t.table(spark, d, "documents")
    body = F.translate("text", "\n\r\t", "   ")
    summary = F.when(F.pmod("doc_id", F.lit(2)) == 1, F.concat(body, F.lit("\t"), F.lit("end"))).otherwise(body)
    open_, close = t.day(F.col("doc_id")), F.date_add(t.day(F.col("doc_id")), 90)
    columns = [
        F.concat(F.lit(" PE"), F.pmod("doc_id", F.lit(50)).cast("string")), F.lit("MAKER"), F.upper("source"),
        F.when(F.pmod("doc_id", F.lit(7)) == 0, F.lit("year")).otherwise(
            F.concat(F.lit("20"), F.lpad(F.regexp_extract("source", "([0-9]+)", 1), 2, "0"))),
        F.col("lang"), F.lit("M"), F.date_format(open_, "yyyyMMdd"),
        F.when(F.pmod("doc_id", F.lit(4)) == 0, F.lit("")).otherwise(F.date_format(close, "yyyyMMdd")),
        F.concat(F.lit("C"), F.pmod("doc_id", F.lit(10)).cast("string")), F.col("source"),
    ]
    line = F.when(F.pmod("doc_id", F.lit(3)) == 0, F.concat_ws("\t", *columns)).otherwise(
        F.concat_ws("\t", *columns, summary)
    )
    return docs.select(F.col("doc_id").alias("feed_order"), line.alias("line"))


_FLAT = r"""flat AS (SELECT doc_id AS feed_order, 'PE' || (doc_id % 50) AS action_number, 'MAKER' AS make,
    upper(source) AS model, CAST(2000 + CAST(regexp_extract(source, '([0-9]+)', 1) AS INTEGER) AS INTEGER) AS model_year, lang AS component, 'M' AS manufacturer,
    CAST(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS DATE) AS opened_on,
    CASE WHEN doc_id % 4 <> 0 THEN CAST(DATE '2024-01-01' + CAST(doc_id % 365 + 90 AS INTEGER) AS DATE) END AS closed_on,
    'C' || (doc_id % 10) AS campaign_number, source AS subject,
    trim(translate(text, chr(10) || chr(13) || chr(9), '   ') || CASE WHEN doc_id % 2 = 1 THEN chr(9) || 'end' ELSE '' END,
      ' ' || chr(9)) AS summary
  FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 7 <> 0)"""


@query("investigations_flat_file", with_sql(_FLAT, select="SELECT * FROM flat"))
def investigations_flat_file(spark, d):
    return flatfile.parse_investigations(_flat_lines(spark, d)).drop("raw_line")


_FLAT_GROUPS = _FLAT + """, kept AS (SELECT * FROM flat WHERE summary <> ''),
heads AS (SELECT action_number, min(feed_order) AS feed_order FROM kept GROUP BY ALL),
parts AS (SELECT action_number, string_agg(component, '; ' ORDER BY seen) AS component FROM (
  SELECT action_number, component, min(feed_order) AS seen FROM kept GROUP BY ALL) GROUP BY ALL),
linked AS (SELECT action_number, campaign_number, component, min(feed_order) AS feed_order FROM kept GROUP BY ALL)"""


def _flat_rows(spark, d) -> DataFrame:
    rows = flatfile.parse_investigations(_flat_lines(spark, d)).withColumn("vehicle_id", F.lit(1).cast("long"))
    return cut_lineage(rows)


@query("plan_investigations", with_sql(_FLAT_GROUPS, select="""
SELECT k.action_number AS external_id, p.component, k.opened_on AS filed_on, k.subject AS title, k.summary AS body
FROM heads h JOIN kept k USING (feed_order) JOIN parts p ON p.action_number = k.action_number"""))
def plan_investigations(spark, d):
    return planning.plan_investigations(_flat_rows(spark, d)).select(
        "external_id", "component", "filed_on", "title", "body"
    )


@query("planned_links", with_sql(_FLAT_GROUPS, select="""
SELECT k.action_number AS external_id, k.campaign_number, k.component, k.opened_on, k.closed_on
FROM linked l JOIN kept k USING (feed_order)"""))
def planned_links(spark, d):
    rows = _flat_rows(spark, d)
    planned = planning.plan_investigations(rows).withColumn("document_id", F.xxhash64("external_id"))
    return stored.new_links(planned, planning.investigation_links(rows)).join(
        planned.select(F.col("document_id").alias("investigation_document_id"), "external_id"),
        "investigation_document_id",
    ).select("external_id", "campaign_number", F.col("component"), "opened_on", "closed_on")


@query("plan_complaints", r"""
SELECT external_id, arg_min(lang, doc_id) AS component, left(regexp_replace(trim(arg_min(text, doc_id), E' \n\r\t'),
    '\r\n|[\n\r\f]', ' ', 'g'), 80) AS title, arg_min(text, doc_id) AS body
FROM (SELECT *, CAST(doc_id // 2 AS VARCHAR) AS external_id FROM documents WHERE trim(text, E' \n\r\t') <> '')
GROUP BY external_id""")
def plan_complaints(spark, d):
    """Two neighbouring texts share an id, padded differently: the first one stays."""
    feed = t.table(spark, d, "documents").select(
        F.lit(1).cast("long").alias("vehicle_id"), F.col("doc_id").alias("feed_order"),
        F.concat(F.lit(" "), F.floor(F.col("doc_id") / 2).cast("string"), F.lit("\t")).alias("odi_number"),
        F.col("lang").alias("components"), t.day(F.col("doc_id")).alias("filed_on"),
        F.col("text").alias("summary"), F.lit("{}").alias("raw"),
    )
    return planning.plan_complaints(feed).select("external_id", "component", "title", "body")


@query("plan_recalls", r"""
SELECT external_id, component, external_id || ' ' || component AS title, body FROM (
  SELECT 'R' || doc_id AS external_id, lang AS component, array_to_string(list_filter(
    [text, CASE WHEN doc_id % 2 = 0 THEN source ELSE '  ' END, CASE WHEN doc_id % 3 = 0 THEN lang ELSE '' END],
    lambda s: trim(s, E' \n\r\t') <> ''), E'\n\n') AS body FROM documents) WHERE trim(body, E' \n\r\t') <> ''""")
def plan_recalls(spark, d):
    feed = t.table(spark, d, "documents").select(
        F.lit(1).cast("long").alias("vehicle_id"), F.col("doc_id").alias("feed_order"),
        F.concat(F.lit("R"), F.col("doc_id").cast("string")).alias("campaign_number"),
        F.col("lang").alias("component"), F.col("text").alias("summary"),
        F.when(F.pmod("doc_id", F.lit(2)) == 0, F.col("source")).otherwise("  ").alias("consequence"),
        F.when(F.pmod("doc_id", F.lit(3)) == 0, F.col("lang")).otherwise("").alias("remedy"),
        t.day(F.col("doc_id")).alias("received_on"), F.lit("{}").alias("raw"),
    )
    return planning.plan_recalls(feed).select("external_id", "component", "title", "body")


_ORDERED = """ordered AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,
    l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS rn
  FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def _order_rows(spark, d) -> DataFrame:
    """Order lines as investigation rows: an order is one action, part types are components."""
    line = t.table(spark, d, "lineitem").join(
        t.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")
    )
    return line.select(
        "l_orderkey",
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount",
                 "l_tax", "l_returnflag", "l_linestatus", "l_shipdate").alias("feed_order"),
        F.col("p_type").alias("component"), F.col("p_name").alias("subject"),
        F.col("l_linestatus").alias("summary"),
        F.when(F.col("l_returnflag") != "N", F.to_date("l_shipdate")).alias("opened_on"),
        F.to_date("l_shipdate").alias("closed_on"),
        F.when(F.col("l_discount") > 0, F.col("p_brand")).otherwise(" ").alias("campaign_number"),
    )


@query("collapse_groups", with_sql(_ORDERED, """
parts AS (SELECT l_orderkey, string_agg(p_type, '; ' ORDER BY seen) AS component FROM (
  SELECT l_orderkey, p_type, min(rn) AS seen FROM ordered GROUP BY ALL) GROUP BY ALL)""", select="""
SELECT l_orderkey, p_name AS subject, l_linestatus AS summary,
  CASE WHEN l_returnflag <> 'N' THEN l_shipdate::DATE END AS opened_on, component
FROM ordered JOIN parts USING (l_orderkey) WHERE rn = 1"""))
def collapse_groups(spark, d):
    return planning.collapse_investigations(_order_rows(spark, d), ["l_orderkey"])


@query("distinct_links", with_sql(_ORDERED, """
firsts AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, p_brand, p_type ORDER BY rn) AS pick
  FROM ordered WHERE l_returnflag <> 'N' AND l_discount > 0)""", select="""
SELECT l_orderkey, p_brand AS campaign_number, p_type AS component, l_shipdate::DATE AS opened_on,
  l_shipdate::DATE AS closed_on FROM firsts WHERE pick = 1"""))
def distinct_links(spark, d):
    return planning.distinct_links(_order_rows(spark, d), ["l_orderkey"]).drop("feed_order")


@query("match_family", """
SELECT r.p_partkey AS row_id, v.vehicle_id FROM (SELECT *, split_part(p_name, ' ', 1) AS family FROM part) r
JOIN (SELECT p_partkey AS vehicle_id, upper(p_brand) AS make, upper(p_name) AS model, p_size FROM part) v
ON v.make = upper(r.p_brand) AND v.p_size = r.p_size
  AND (v.model = upper(r.family) OR starts_with(v.model, upper(r.family) || ' '))""")
def match_family(spark, d):
    p = t.table(spark, d, "part")
    rows = p.select(
        F.col("p_partkey").alias("row_id"), F.lower("p_brand").alias("make"),
        F.substring_index("p_name", " ", 1).alias("model"), F.col("p_size").alias("model_year"),
    )
    vehicles = p.select(
        F.col("p_partkey").alias("vehicle_id"), F.upper("p_brand").alias("make"),
        F.upper("p_name").alias("model"), F.col("p_size").alias("model_year"),
    )
    return planning.match_family(rows, vehicles).select("row_id", "vehicle_id")


# --- passages --------------------------------------------------------------------


def _pack_sql(units: str, sep: str, limit: int) -> str:
    width = len(sep.encode().decode("unicode_escape"))
    return f"""list_reduce(list_transform({units}, lambda u: {{'done': []::VARCHAR[], 'held': u}}),
      lambda a, x: CASE WHEN length(a.held) + {width} + length(x.held) > {limit}
        THEN {{'done': list_append(a.done, a.held), 'held': x.held}}
        ELSE {{'done': a.done, 'held': a.held || E'{sep}' || x.held}} END)"""


def _passages_sql(text: str, limit: int = 1500) -> str:
    """Sentences are cut where a terminator meets white space, by marking the place first."""
    marked = rf"regexp_replace(p, '([.!?])\s', '\1' || chr(1), 'g')"
    sentences = (rf"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: trim(s, E' \t\n')), "
                 "lambda s: s <> '')")
    pieces = (f"flatten(list_transform({sentences}, lambda s: list_transform("
              f"range(0, length(s), {limit}), lambda i: substr(s, i + 1, {limit}))))")
    inner = _pack_sql("w.pieces", " ", limit)
    outer = _pack_sql("units", "\\n\\n", limit)
    lines = rf"list_transform(string_split({text}, chr(10)), lambda l: trim(l, E' \t\r'))"
    paragraphs = (rf"list_filter(list_transform(regexp_split_to_array(trim(array_to_string({lines}, chr(10)), chr(10)), "
                  rf"'\n\n+'), lambda p: replace(p, chr(10), ' ')), lambda p: p <> '')")
    return f"""paras AS (SELECT doc_id, generate_subscripts(ps, 1) AS i, unnest(ps) AS p
  FROM (SELECT doc_id, {paragraphs} AS ps FROM documents)),
cut AS (SELECT doc_id, i, CASE WHEN length(p) <= {limit} THEN [p] ELSE {pieces} END AS pieces FROM paras),
packed AS (SELECT doc_id, i, w.pieces AS pieces, CASE WHEN len(w.pieces) > 0 THEN {inner} END AS s FROM cut w),
units AS (SELECT doc_id, flatten(list(list_append(s.done, s.held) ORDER BY i)) AS units FROM packed
  WHERE s IS NOT NULL GROUP BY ALL),
done AS (SELECT doc_id, CASE WHEN len(units) > 0 THEN {outer} END AS s FROM units),
texts AS (SELECT doc_id, list_append(s.done, s.held) AS ps FROM done),
rows AS (SELECT doc_id AS document_id, CAST(generate_subscripts(ps, 1) - 1 AS INTEGER) AS ordinal,
  trim(unnest(ps), E' \\t\\n') AS text FROM texts)"""


@query("split_passages", with_sql(_passages_sql("text"), select="SELECT * FROM rows"))
def split_passages(spark, d):
    return passages.split_passages(t.documents(spark, d))


@query("split_passages_paragraphs", with_sql(
    _passages_sql("replace(text, chr(10), E'\\n \\n')", 400), select="SELECT * FROM rows"))
def split_passages_paragraphs(spark, d):
    """Every line is a paragraph of its own and passages are short."""
    spaced = t.documents(spark, d).withColumn("body", F.regexp_replace("body", "\n", "\n \r\n"))
    return passages.split_passages(spaced, 400)


@query("whole_passage", r"""
SELECT doc_id AS document_id, 0 AS ordinal, trim(text, E' \n\r\t') AS text FROM documents
WHERE trim(text, E' \n\r\t') <> ''""")
def whole_passage(spark, d):
    return passages.whole_passage(t.documents(spark, d))


# --- links and ground truth ------------------------------------------------------

_LINKS = """raw_links AS (SELECT *, min(CASE WHEN kind = 'recall' THEN document_id END) OVER (
    PARTITION BY vehicle_id ORDER BY document_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS campaign
  FROM docs WHERE kind <> 'complaint'),
links AS (SELECT document_id AS link, vehicle_id, external_id, component, coalesce(CAST(campaign AS VARCHAR), 'unstored')
    AS campaign_number, CAST(filed_on - 30 AS DATE) AS opened_on,
    CASE WHEN document_id % 4 <> 0 THEN CAST(filed_on + 60 AS DATE) END AS closed_on
  FROM raw_links WHERE kind = 'investigation'),
qrels AS (SELECT link, link AS document_id FROM links UNION
  SELECT l.link, d.document_id FROM links l JOIN docs d ON d.vehicle_id = l.vehicle_id AND d.kind = 'recall'
    AND d.external_id = l.campaign_number),
cases AS (SELECT link, vehicle_id, case_id, document_id, body FROM (SELECT l.link, l.vehicle_id,
    l.external_id || ':' || d.external_id AS case_id, d.document_id, d.body,
    row_number() OVER (PARTITION BY l.link ORDER BY d.external_id) AS pick
  FROM links l JOIN docs d ON d.vehicle_id = l.vehicle_id AND d.kind = 'complaint'
    AND starts_with(d.component, left(trim(l.component), 12)) AND d.filed_on >= l.opened_on
    AND (l.closed_on IS NULL OR d.filed_on <= l.closed_on)) WHERE pick <= 20)"""


@query("ground_truth_cases", with_sql(DOCS, _LINKS, select="""
SELECT case_id, vehicle_id, document_id, body AS query_text FROM cases"""))
def ground_truth_cases(spark, d):
    cases, _ = ground_truth.build_ground_truth(t.links(spark, d), t.documents(spark, d))
    return cases.select("case_id", "vehicle_id", "document_id", "query_text")


@query("relevant_sets", with_sql(DOCS, _LINKS, select="""
SELECT link AS investigation_document_id, document_id FROM qrels"""))
def relevant_sets(spark, d):
    docs = t.documents(spark, d)
    scoped = ground_truth.scoped_links(t.links(spark, d), docs)
    return ground_truth.qrels(scoped, docs).join(
        scoped.select("link_id", "investigation_document_id"), "link_id"
    ).select("investigation_document_id", "document_id")


@query("link_recalls", with_sql(DOCS, _LINKS, select="""
SELECT l.link AS investigation_document_id, d.document_id AS recall_document_id FROM links l LEFT JOIN docs d
ON d.vehicle_id = l.vehicle_id AND d.kind = 'recall' AND d.external_id = l.campaign_number"""))
def link_recalls(spark, d):
    docs = t.documents(spark, d)
    scoped = ground_truth.scoped_links(t.links(spark, d), docs)
    return ground_truth.link_recalls(scoped, docs).join(
        scoped.select("link_id", "investigation_document_id"), "link_id"
    ).select("investigation_document_id", "recall_document_id")


@query("ordered_links", with_sql(DOCS, _LINKS, select="""
SELECT row_number() OVER (PARTITION BY vehicle_id ORDER BY external_id, component, campaign_number, link) AS place,
  vehicle_id, external_id, component, campaign_number FROM links"""))
def ordered_links(spark, d):
    from pyspark.sql import Window

    ordered = ground_truth.ordered_links(t.links(spark, d), t.documents(spark, d))
    place = F.row_number().over(Window.partitionBy("vehicle_id").orderBy("pos"))
    return ordered.select(
        place.cast("long").alias("place"), "vehicle_id",
        F.col("investigation_external_id").alias("external_id"), "component", "campaign_number",
    )


@query("window_ground_truth", """
WITH complaints AS (SELECT DISTINCT l_suppkey % 100 AS vehicle_id, o_orderpriority || ':' || l_returnflag AS component,
    l_shipdate::DATE AS filed_on, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS external_id
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT link_id, external_id FROM (SELECT o.o_orderkey AS link_id, c.external_id,
    row_number() OVER (PARTITION BY o.o_orderkey ORDER BY c.external_id, c.filed_on, c.component) AS pick
  FROM orders o JOIN complaints c ON c.vehicle_id = o.o_custkey % 100
    AND starts_with(c.component, left(o.o_orderpriority, 12))
    AND c.filed_on >= o.o_orderdate::DATE
    AND (o.o_orderstatus = 'O' OR c.filed_on <= o.o_orderdate::DATE + 90)) WHERE pick <= 20""")
def window_ground_truth(spark, d):
    """Orders as links with a window, order lines as complaints."""
    orders = t.table(spark, d, "orders")
    links = orders.select(
        F.col("o_orderkey").alias("link_id"), F.pmod("o_custkey", F.lit(100)).alias("vehicle_id"),
        F.col("o_orderpriority").alias("component"), F.to_date("o_orderdate").alias("opened_on"),
        F.when(F.col("o_orderstatus") != "O", F.date_add(F.to_date("o_orderdate"), 90)).alias("closed_on"),
    )
    lines = t.table(spark, d, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    complaints = lines.select(
        F.pmod("l_suppkey", F.lit(100)).alias("vehicle_id"),
        F.concat_ws(":", "o_orderpriority", "l_returnflag").alias("component"),
        F.to_date("l_shipdate").alias("filed_on"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("external_id"),
    ).distinct().withColumn(
        "document_id", F.struct("filed_on", "component")
    )
    return ground_truth.first_in_window(links, complaints).select("link_id", "external_id")


# --- stored tables ---------------------------------------------------------------


@query("insert_if_absent", """
SELECT doc_id, doc_id NOT IN (SELECT doc_id FROM labels) AS is_new FROM documents""")
def insert_if_absent(spark, d):
    """Labelled documents are stored already; the whole table is planned."""
    known = t.table(spark, d, "labels").select("doc_id")
    new, unchanged = stored.append_new(known, t.table(spark, d, "documents"), ["doc_id"])
    return new.select("doc_id", F.lit(True).alias("is_new")).unionByName(
        unchanged.select("doc_id", F.lit(False).alias("is_new"))
    )


@query("upsert_registry", """
SELECT model, coalesce(o.make, n.make) AS make, coalesce(o.vin, n.vin) AS vin, coalesce(o.display_name, n.display_name)
  AS display_name FROM (SELECT right(c_name, 9) AS model, 'M' AS make, c_name AS display_name,
    CASE WHEN c_nationkey % 2 = 1 THEN md5(c_name) END AS vin FROM customer) o
FULL JOIN (SELECT right(s_name, 9) AS model, 'M' AS make, s_name AS display_name, md5(s_name) AS vin FROM supplier) n
USING (model)""")
def upsert_registry(spark, d):
    """Customers are registered; suppliers of the same number come in."""
    def registry(name, label, vin):
        return t.table(spark, d, name).select(
            F.lit("M").alias("make"), F.right(F.col(label), F.lit(9)).alias("model"), F.lit(2000).alias("model_year"),
            F.col(label).alias("display_name"), vin.alias("vin"),
        )
    old = registry("customer", "c_name", F.when(F.pmod("c_nationkey", F.lit(2)) == 1, F.md5("c_name")))
    new = registry("supplier", "s_name", F.md5("s_name"))
    return stored.upsert_registry(old, new).select("model", "make", "vin", "display_name")


@query("lookup_documents", """
SELECT doc_id AS document_id, text AS body FROM documents WHERE doc_id IN (SELECT item_id FROM benchmark)""")
def lookup_documents(spark, d):
    ids = t.table(spark, d, "benchmark").select(F.col("item_id").alias("document_id"))
    return stored.lookup_documents(t.documents(spark, d), ids).select("document_id", "body")


@query("load_report", with_sql(DOCS, select="""
SELECT vehicle_id, count(*) FILTER (kind = 'complaint') AS complaints_fetched,
  count(*) FILTER (kind = 'complaint' AND trim(body) = '') AS complaints_skipped_empty,
  count(*) FILTER (kind = 'complaint' AND trim(body) <> '' AND document_id NOT IN (SELECT doc_id FROM labels))
    AS complaints_new,
  count(*) FILTER (kind = 'complaint' AND trim(body) <> '' AND document_id IN (SELECT doc_id FROM labels))
    AS complaints_unchanged,
  count(*) FILTER (kind = 'recall') AS recalls_fetched,
  count(*) FILTER (kind = 'recall' AND document_id NOT IN (SELECT doc_id FROM labels)) AS recalls_new,
  count(*) FILTER (kind = 'recall' AND document_id IN (SELECT doc_id FROM labels)) AS recalls_unchanged,
  count(*) FILTER (kind = 'investigation') AS investigation_rows,
  count(*) FILTER (kind = 'investigation' AND document_id NOT IN (SELECT doc_id FROM labels)) AS investigations_new,
  count(*) FILTER (kind = 'investigation' AND document_id NOT IN (SELECT doc_id FROM labels)) AS links_created,
  count(*) FILTER (trim(body) <> '' AND document_id NOT IN (SELECT doc_id FROM labels)) AS chunks_created
FROM docs GROUP BY ALL"""))
def load_report(spark, d):
    docs = t.documents(spark, d).withColumn("is_empty", F.trim("body") == "")
    planned = docs.where(~F.col("is_empty")).withColumn("passages", F.array("body"))
    known = t.table(spark, d, "labels").select(F.col("doc_id").alias("document_id"))
    new = stored.not_stored(planned, known, ["document_id"])
    return stored.load_report(docs, planned, new, new.where(F.col("kind") == "investigation"))


# --- identity --------------------------------------------------------------------


def _vin_documents(spark, d) -> DataFrame:
    """Customers as complaints whose payload holds a VIN, a padded one, none, or broken JSON."""
    c = t.table(spark, d, "customer")
    vin = F.upper(F.substring(F.md5(F.pmod("c_custkey", F.lit(97)).cast("string")), 1, 17))
    n = F.pmod("c_custkey", F.lit(5))
    raw = (
        F.when(n == 0, F.lit('{"VIN": ""}')).when(n == 1, F.lit('{"vin": '))
        .when(n == 2, F.concat(F.lit('{"Vin": " '), F.lower(vin), F.lit(' "}')))
        .otherwise(F.concat(F.lit('{"vin": "'), vin, F.lit('"}')))
    )
    return c.select(
        F.col("c_custkey").alias("document_id"), F.col("c_nationkey").cast("long").alias("vehicle_id"),
        F.lit("complaint").alias("kind"), raw.alias("raw_payload"),
    )


def _nations(spark, d) -> DataFrame:
    return t.table(spark, d, "nation").select(
        F.col("n_nationkey").cast("long").alias("vehicle_id"),
        (F.lit(2000) + F.col("n_regionkey")).cast("int").alias("model_year"),
    )


def _decodes(spark, d) -> DataFrame:
    """What suppliers are known to have answered."""
    s = t.table(spark, d, "supplier")
    known = s.select(
        F.upper(F.substring(F.md5(F.pmod("s_suppkey", F.lit(50)).cast("string")), 1, 8)).alias("descriptor"),
        F.explode(F.array(F.lit(2001), F.lit(2002))).alias("model_year"),
        F.pmod("s_suppkey", F.lit(50)).alias("n"),
    ).distinct()
    return known.select("descriptor", "model_year", identity.fit(
        t.trim_of(F.col("n")), t.litres_of(F.col("n")), t.cylinders_of(F.col("n"))
    ).alias("f")).select("descriptor", "model_year", "f.*")


_VINS = """described AS (SELECT c_custkey AS document_id, CASE WHEN c_custkey % 5 > 1
    THEN upper(left(md5(CAST(c_custkey % 97 AS VARCHAR)), 8)) END AS descriptor,
    CAST(2000 + n_regionkey AS INTEGER) AS model_year
  FROM customer JOIN nation ON n_nationkey = c_nationkey),
decodes AS (SELECT DISTINCT upper(left(md5(CAST(s_suppkey % 50 AS VARCHAR)), 8)) AS descriptor, model_year,
    CASE (s_suppkey % 50) % 4 WHEN 1 THEN 'Base' WHEN 2 THEN 'Sport-X' WHEN 3 THEN 'base' END AS trim,
    CASE (s_suppkey % 50) % 4 WHEN 1 THEN 'base' WHEN 2 THEN 'sportx' WHEN 3 THEN 'base' END AS trim_key,
    CASE (s_suppkey % 50) % 3 WHEN 1 THEN 2.0 WHEN 2 THEN 3.5 END AS engine_litres,
    CASE (s_suppkey % 50) % 5 WHEN 1 THEN 4 WHEN 2 THEN 6 WHEN 3 THEN 8 END AS engine_cylinders
  FROM supplier, (VALUES (2001), (2002)) y(model_year))"""


@query("resolve_decodes", with_sql(_VINS, select="""
SELECT document_id, descriptor, model_year, trim, trim_key, engine_litres, engine_cylinders
FROM described LEFT JOIN decodes USING (descriptor, model_year)"""))
def resolve_decodes(spark, d):
    records = decode.described(_vin_documents(spark, d), _nations(spark, d))
    resolved, _ = decode.resolve_decodes(records, _decodes(spark, d))
    return resolved.select("document_id", "descriptor", "model_year", "trim", "trim_key",
                           "engine_litres", "engine_cylinders")


@query("descriptor_worklist", with_sql(_VINS, select="""
SELECT DISTINCT descriptor, model_year FROM described ANTI JOIN decodes USING (descriptor, model_year)
WHERE descriptor IS NOT NULL"""))
def descriptor_worklist(spark, d):
    records = decode.described(_vin_documents(spark, d), _nations(spark, d))
    return decode.descriptor_worklist(records, _decodes(spark, d))


@query("decode_report", with_sql(_VINS, select="""
SELECT (SELECT count(*) FROM nation) AS vehicles, 0 AS own_vins_decoded,
  count(*) FILTER (descriptor IS NOT NULL) AS complaints_described,
  count(*) FILTER (descriptor IS NULL) AS complaints_without_vin FROM described"""))
def decode_report(spark, d):
    nations = _nations(spark, d)
    return decode.decode_report(
        decode.described(_vin_documents(spark, d), nations),
        nations.withColumn("was_decoded", F.lit(False)),
    )


@query("vin_decode_feed", """
SELECT 'D' || p_partkey AS descriptor, p_size AS model_year, p_type AS trim, lower(p_type) AS trim_key,
  CAST(nullif(p_partkey % 7, 0) AS DECIMAL(4,1)) AS engine_litres, CASE WHEN p_size % 9 > 0 THEN p_size % 9 END
  AS engine_cylinders FROM part""")
def vin_decode_feed(spark, d):
    p = t.table(spark, d, "part")
    first = F.to_json(F.struct(
        F.concat(F.lit(" "), "p_type").alias("Trim"),
        F.concat(F.pmod("p_partkey", F.lit(7)).cast("string"), F.lit(".0")).alias("DisplacementL"),
        F.pmod("p_size", F.lit(9)).cast("string").alias("EngineCylinders"), F.lit("0").alias("ErrorCode"),
    ))
    return feeds.vin_decodes_from(p.select(
        F.concat(F.lit("D"), F.col("p_partkey").cast("string")).alias("descriptor"),
        F.col("p_size").alias("model_year"),
        F.concat(F.lit('{"Results": ['), first, F.lit(', {"Trim": "other"}]}')).alias("body"),
    ))


@query("fit_labels", with_sql(DOCS, select="""
SELECT document_id, CASE WHEN trim IS NULL AND engine_litres IS NULL AND engine_cylinders IS NULL
  THEN 'trim not decoded' ELSE concat_ws(' · ', trim, regexp_replace(CAST(engine_litres AS VARCHAR), '\\.0$', '') || 'L',
  engine_cylinders || ' cyl') END AS label FROM docs"""))
def fit_labels(spark, d):
    return t.documents(spark, d).select("document_id", identity.fit_label(
        F.col("trim"), F.col("engine_litres"), F.col("engine_cylinders")
    ).alias("label"))


@query("hash_bytes", """
SELECT doc_id, """ + " || ".join(
    f"sha256(encode(text) || '{''.join(chr(92) + f'x{x:02X}' for x in b.to_bytes(4, 'little'))}'::BLOB)" for b in range(32)
) + " AS hex FROM documents")
def hash_embedding_bytes(spark, d):
    return t.table(spark, d, "documents").select("doc_id", hash_bytes(F.col("text"), 32).alias("hex"))


@query("hash_embed", "WITH h AS (" + ORACLE["hash_bytes"] + """),
v AS (SELECT doc_id, list_transform(generate_series(0, 1023), lambda i:
  (CAST('0x' || substr(hex, CAST(2 * i + 1 AS INTEGER), 2) AS INTEGER) - 128)::DOUBLE) AS b FROM h),
n AS (SELECT doc_id, b, sqrt(list_sum(list_transform(b, lambda x: x * x))) AS size FROM v)
SELECT doc_id AS chunk_id, 1024 AS width, 1.0::DOUBLE AS length, round(b[1] / size, 3) + 0.0 AS first, round(b[512] / size, 3) + 0.0 AS middle,
  round(b[1024] / size, 3) + 0.0 AS last FROM n""")
def hash_embed(spark, d):
    chunks = t.table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    vectors = embed.check_vectors(embed.hash_embedded(chunks), 1024)
    squares = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    at = lambda place, name: (F.round(F.element_at("embedding", place).cast("double"), 3) + 0.0).alias(name)
    return vectors.select("chunk_id", F.size("embedding").alias("width"), F.round(F.sqrt(squares), 4).alias("length"),
                          at(1, "first"), at(512, "middle"), at(1024, "last"))


# --- validation and names --------------------------------------------------------


@query("validate_queries", r"""
SELECT query_id, problem, CASE WHEN problem IS NULL THEN mode END AS mode, CASE WHEN problem IS NULL THEN
  CASE WHEN query_id % 11 = 2 THEN 'campaigns' ELSE 'all' END END AS scope, coalesce(lim, 10) AS "limit", 'X Y' AS component
FROM (SELECT doc_id AS query_id, CASE doc_id % 8 WHEN 1 THEN 0 WHEN 2 THEN 51 WHEN 3 THEN 50 END AS lim,
  CASE doc_id % 6 WHEN 0 THEN 'magic' WHEN 1 THEN 'dense' ELSE 'hybrid' END AS mode,
  CASE WHEN length(trim(text, E' \n\r\t')) NOT BETWEEN 2 AND 500 THEN 'The query must be between 2 and 500 characters.'
    WHEN doc_id % 6 = 0 THEN 'Unknown mode ''magic''. Use dense, sparse, or hybrid.'
    WHEN doc_id % 11 = 0 THEN 'Unknown scope ''recalls''. Use all or campaigns.'
    WHEN doc_id % 13 = 0 THEN 'Unknown trims ''1''. Use thisTrim or allTrims.'
    WHEN doc_id % 8 IN (1, 2) THEN 'The limit must be between 1 and 50.'
    WHEN doc_id % 17 = 0 THEN 'filedFrom is later than filedTo, so the range holds no dates.' END AS problem
  FROM documents)""")
def validate_queries(spark, d):
    key = F.col("doc_id")
    n = lambda m: F.pmod(key, F.lit(m))
    asked = t.table(spark, d, "documents").select(
        key.alias("query_id"), F.lit(1).cast("long").alias("vehicle_id"), "text",
        F.when(n(6) == 0, "magic").when(n(6) == 1, " DENSE ").alias("mode"),
        F.when(n(11) == 0, "recalls").when(n(11) == 1, "  ").when(n(11) == 2, "Campaigns").alias("scope"),
        F.when(n(13) == 0, "1").when(n(13) == 1, "thistrim").alias("trims"),
        F.lit(" x y ").alias("component"),
        F.when(n(8) == 1, 0).when(n(8) == 2, 51).when(n(8) == 3, 50).alias("limit"),
        F.lit("2024-05-01").cast("date").alias("filed_from"),
        F.when(n(17) == 0, F.lit("2024-04-01").cast("date")).alias("filed_to"),
    )
    valid, rejects = validation.validate_queries(asked)
    return valid.select(
        "query_id", F.lit(None).cast("string").alias("problem"), "mode", "scope", "limit", "component"
    ).unionByName(rejects.select(
        "query_id", "problem", F.lit(None).cast("string").alias("mode"),
        F.lit(None).cast("string").alias("scope"), "limit", "component",
    ))


@query("validate_registrations", """
SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 'A make is required, for example "Ford".'
  WHEN p_partkey % 10 = 0 THEN 'An NHTSA model name is required, for example "EXPLORER".'
  WHEN p_partkey % 11 = 0 THEN 'A display name is required, for example "2013 Explorer Sport".'
  WHEN p_partkey % 7 = 0 THEN 'A VIN is 17 letters and digits, never I, O, Q. Leave it blank if you do not have it to hand.'
  WHEN 1900 + p_size * 3 NOT BETWEEN 1949 AND 2027 THEN 'The model year must be between 1949 and 2027.' END AS problem
FROM part""")
def validate_registrations(spark, d):
    key = F.col("p_partkey")
    n = lambda m: F.pmod(key, F.lit(m)) == 0
    vin = F.substring(F.md5(key.cast("string")), 1, 17)
    asked = t.table(spark, d, "part").select(
        "p_partkey", F.when(~n(9), F.col("p_brand")).alias("make"),
        F.when(n(10), F.lit(" ")).otherwise(F.col("p_name")).alias("model"),
        F.lit("").alias("recall_model"), F.when(~n(11), F.col("p_name")).alias("display_name"),
        F.when(n(7), F.concat(F.lit("I"), F.substring(vin, 2, 16))).when(n(2), vin).alias("vin"),
        (F.lit(1900) + F.col("p_size") * 3).alias("model_year"),
    )
    valid, rejects = validation.validate_registrations(asked, 2026)
    return valid.select("p_partkey", F.lit(None).cast("string").alias("problem")).unionByName(
        rejects.select("p_partkey", "problem")
    )


_NAMES = r"""names AS (SELECT p_brand, min(p_name) AS name FROM part GROUP BY p_brand, upper(p_name)),
typed AS (SELECT DISTINCT p_brand, p_type || '-' || split_part(p_name, ' ', 2) AS typed FROM part),
words AS (SELECT DISTINCT p_brand, typed, unnest(regexp_split_to_array(upper(typed), '[ \-(),/._]')) AS token FROM typed),
held AS (SELECT DISTINCT p_brand, name, unnest(regexp_split_to_array(upper(name), '[ \-(),/._]')) AS token FROM names),
scored AS (SELECT w.p_brand, typed, name, sum(length(token)) AS score FROM words w JOIN held h USING (p_brand, token)
  WHERE token <> '' GROUP BY ALL),
picks AS (SELECT p_brand, typed, name, row_number() OVER (PARTITION BY p_brand, typed ORDER BY score DESC, name) AS rank
    FROM scored UNION ALL
  SELECT t.p_brand, t.typed, name, row_number() OVER (PARTITION BY t.p_brand, t.typed ORDER BY name)
    FROM typed t JOIN names n USING (p_brand) WHERE NOT EXISTS (
      SELECT 1 FROM scored s WHERE s.p_brand = t.p_brand AND s.typed = t.typed))"""


@query("suggest_names", with_sql(_NAMES, select="""
SELECT p_brand, typed, CAST(rank AS INTEGER) AS rank, name,
  (SELECT count(*) FROM names n WHERE n.p_brand = p.p_brand) - count(*) OVER (PARTITION BY p_brand, typed) AS more
FROM picks p WHERE rank <= 8"""))
def suggest_names(spark, d):
    p = t.table(spark, d, "part")
    typed = p.select("p_brand", F.concat_ws("-", "p_type", F.substring_index("p_name", " ", -1)).alias("typed"))
    return names.suggest_names(typed, p.select("p_brand", F.col("p_name").alias("name")), ["p_brand"])


@query("split_known", """
SELECT p_partkey, (upper(p_brand), p_size, upper(p_name)) IN (SELECT (upper(p_brand), p_size, upper(p_name))
  FROM part WHERE p_retailprice > 1000) AS known FROM part""")
def split_known(spark, d):
    """Parts above a price are the listed models."""
    p = t.table(spark, d, "part").select(
        "p_partkey", F.upper("p_brand").alias("make"), F.col("p_size").alias("model_year"),
        F.col("p_name").alias("model"), "p_retailprice",
    )
    listed = p.where("p_retailprice > 1000").select("make", "model_year", F.upper("model").alias("model"))
    known, unknown = names.split_known(p, listed)
    return known.select("p_partkey", F.lit(True).alias("known")).unionByName(
        unknown.select("p_partkey", F.lit(False).alias("known"))
    )


@query("listed_model_names", """
SELECT p_brand AS make, p_size AS model_year, min(p_name) AS model FROM part GROUP BY 1, 2, upper(p_name)""")
def listed_model_names(spark, d):
    p = t.table(spark, d, "part")
    return names.model_names(p.select(
        F.col("p_brand").alias("make"), F.col("p_size").alias("model_year"), F.col("p_name").alias("model")
    ))


# --- composite jobs --------------------------------------------------------------


def _by_descriptor(asked: list[tuple[str, int]]) -> list[tuple]:
    return [("T" + descriptor[0], 2.5, None) for descriptor, _ in asked]


@query("decode_records", with_sql(_VINS, select="""
SELECT document_id, CASE WHEN descriptor IS NOT NULL THEN 'T' || left(descriptor, 1) END AS trim,
  CASE WHEN descriptor IS NOT NULL THEN 2.5 END AS engine_litres, CAST(NULL AS INTEGER) AS engine_cylinders
FROM described"""))
def decode_records(spark, d):
    fitted, _ = decode.decode_records(
        _vin_documents(spark, d), _nations(spark, d), f"{scratch_folder(spark)}/decodes", _by_descriptor
    )
    return fitted.select("document_id", "trim", "engine_litres", "engine_cylinders")


_LOADED = DOCS + ", " + _FLAT + r""", paired AS (SELECT *, CAST(substr(subject, 4) AS BIGINT) AS vehicle_id FROM flat),
summaries AS (SELECT vehicle_id, action_number, min_by(summary, feed_order) AS summary FROM paired WHERE summary <> ''
  AND model_year = 2000 + vehicle_id GROUP BY ALL)"""


@query("load_records", with_sql(_LOADED, select="""
SELECT vehicle_id, count(*) FILTER (kind = 'complaint') AS complaints_fetched,
  count(*) FILTER (kind = 'complaint' AND trim(body) <> '') AS complaints_new,
  count(*) FILTER (kind = 'recall' AND trim(body) <> '') AS recalls_new,
  (SELECT count(*) FROM flat WHERE subject = 'src' || vehicle_id AND model_year = 2000 + vehicle_id) AS investigation_rows,
  (SELECT count(DISTINCT action_number) FROM flat WHERE subject = 'src' || vehicle_id AND summary <> ''
    AND model_year = 2000 + vehicle_id) AS investigations_new,
  (SELECT count(DISTINCT (action_number, campaign_number, component)) FROM flat WHERE subject = 'src' || vehicle_id
    AND summary <> '' AND model_year = 2000 + vehicle_id) AS links_created
FROM docs WHERE kind <> 'investigation' GROUP BY ALL"""))
def load_records(spark, d):
    """A first load of every vehicle into an empty store."""
    return _load(spark, d, scratch_folder(spark), "first").select(
        "vehicle_id", "complaints_fetched", "complaints_new", "recalls_new", "investigation_rows",
        "investigations_new", "links_created",
    )


@query("load_records_again", with_sql(DOCS, _FLAT, select="""
SELECT vehicle_id, count(*) FILTER (kind = 'complaint') AS complaints_fetched, 0 AS complaints_new,
  count(*) FILTER (kind = 'complaint' AND trim(body) <> '') AS complaints_unchanged, 0 AS recalls_new,
  count(*) FILTER (kind = 'recall' AND trim(body) <> '') AS recalls_unchanged,
  (SELECT count(*) FROM flat WHERE subject = 'src' || vehicle_id AND model_year = 2000 + vehicle_id) AS investigation_rows,
  0 AS investigations_new, 0 AS links_created, 0 AS chunks_created
FROM docs WHERE kind <> 'investigation' GROUP BY ALL"""))
def load_records_again(spark, d):
    """A second load of the same feeds: nothing is new and nothing is rewritten."""
    root = scratch_folder(spark)
    _load(spark, d, root, "first")
    return _load(spark, d, root, "second").select(
        "vehicle_id", "complaints_fetched", "complaints_new", "complaints_unchanged", "recalls_new", "recalls_unchanged",
        "investigation_rows", "investigations_new", "links_created", "chunks_created",
    )


@query("load_stored_chunks", with_sql(_LOADED, select="""
SELECT vehicle_id, kind, external_id, count(*) AS documents, sum(chars) AS body_chars, bool_and(whole) AS whole
FROM (SELECT vehicle_id, kind, external_id, length(body) AS chars, TRUE AS whole FROM docs
    WHERE kind <> 'investigation' AND trim(body, ' ' || chr(9) || chr(10) || chr(13)) <> ''
  UNION ALL SELECT vehicle_id, 'investigation', action_number, length(summary), TRUE FROM summaries
    WHERE vehicle_id IN (SELECT vehicle_id FROM docs))
GROUP BY ALL"""))
def load_stored_chunks(spark, d):
    """What a first load stored: each record's body, and whether its passages hold all of its characters but white space."""
    root = scratch_folder(spark)
    _load(spark, d, root, "first")
    tables_ = load.stored_tables(spark, root)
    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    texts = tables_["chunks"].groupBy("document_id").agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "text"))).alias("parts")
    ).select("document_id", bare(F.array_join(F.transform("parts", lambda p: p["text"]), "")).alias("held"))
    return tables_["documents"].join(texts, "document_id", "left").groupBy("vehicle_id", "kind", "external_id").agg(
        F.count(F.lit(1)).alias("documents"), F.sum(F.length("body")).alias("body_chars"),
        F.bool_and(bare(F.col("body")) == F.col("held")).alias("whole"),
    )


@query("load_after_failed_feed", with_sql(DOCS, select="""
SELECT vehicle_id, count(*) FILTER (kind = 'complaint') AS complaints_fetched,
  count(*) FILTER (kind = 'complaint' AND trim(body) <> '') AS complaints_new, 0 AS complaints_unchanged,
  'nothing was stored by the failed load' AS before
FROM docs WHERE kind <> 'investigation' GROUP BY ALL"""))
def load_after_failed_feed(spark, d):
    """A load with one response that is no JSON is refused and stores nothing; with that response read again it loads all."""
    root = scratch_folder(spark)
    try:
        _load(spark, d, root, "first", broken=True)
        before = "the failed load went through"
    except load.FeedFailed:
        rows = load.stored_tables(spark, root)["documents"].count()
        before = f"{rows} documents of the failed load" if rows else "nothing was stored by the failed load"
    return _load(spark, d, root, "second").select(
        "vehicle_id", "complaints_fetched", "complaints_new", "complaints_unchanged", F.lit(before).alias("before"))


def _responses(docs: DataFrame, kind: str, element: Column, broken: bool) -> DataFrame:
    """The landed responses of one kind, eight records each at most, with the vehicle that asked and the status."""
    asked = docs.where(F.col("kind") == kind).withColumn("doc_id", F.col("document_id"))
    key = F.concat_ws("/", F.lit(kind), "vehicle_id", F.floor(F.col("document_id") / 160).cast("string"))
    landed = _envelopes(asked, element, key).select(
        "path", F.split("path", "/")[1].cast("long").alias("vehicle_id"), F.lit(200).alias("status"), "body")
    if not broken:
        return landed
    first = landed.agg(F.min("path").alias("path")).first()["path"]
    hit = F.col("path") == F.lit(first)
    return landed.withColumn("body", F.when(hit, F.lit("<html>busy</html>")).otherwise(F.col("body"))).withColumn(
        "status", F.when(hit, F.lit(503)).otherwise(F.col("status")))


def _load(spark, d, root: str, load_id: str, broken: bool = False) -> DataFrame:
    docs = t.documents(spark, d)
    filed = F.date_format("filed_on", "MM/dd/yyyy")
    complaints = _responses(docs, "complaint", F.struct(
        F.col("external_id").alias("odiNumber"), F.col("component").alias("components"), F.col("body").alias("summary"),
        filed.alias("dateComplaintFiled"),
    ), broken)
    recalls = _responses(docs, "recall", F.struct(
        F.col("external_id").alias("NHTSACampaignNumber"), F.col("component").alias("Component"), F.col("body").alias("Summary"),
        filed.alias("ReportReceivedDate"),
    ), broken)
    # Landed once: the outcomes and the records are read from the same bodies.
    landed = cut_lineage(complaints.unionByName(recalls))
    outcomes = feeds.classify_envelopes(landed).select("path", "outcome")
    of = lambda kind: landed.where(F.col("path").startswith(kind)).drop("status")
    rows = flatfile.parse_investigations(_flat_lines(spark, d))
    return load.load_records(spark, root, load_id, t.vehicles(spark, d), feeds.complaints_from(of("complaint")),
                             feeds.recalls_from(of("recall")), rows, outcomes)
