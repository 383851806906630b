"""Ground truth from the links already present in the records."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.dates import covers
from ..functions.text import COMPONENT_PREFIX_LENGTH, case_id, component_prefix
from ..session import cut_lineage
from .ranking import top_k
from .sizing import hot_vehicles, keep_ids, replicated, salted

# Fixed value: complaints taken as queries per link.
MAX_QUERIES_PER_LINK = 20
# Links of one vehicle that may meet its days in one task.
LINKS_PER_SALT = 200_000
LINK_KEY = ["vehicle_id", "investigation_external_id", "component", "campaign_number",
            "investigation_document_id"]


def scoped_links(links: DataFrame, documents: DataFrame) -> DataFrame:
    """Links that name a campaign, with the vehicle and id of their investigation and a ``link_id``."""
    investigations = documents.where(F.col("kind") == "investigation").select(
        F.col("document_id").alias("investigation_document_id"),
        F.col("vehicle_id"),
        F.col("external_id").alias("investigation_external_id"),
    )
    return (
        links.drop("vehicle_id").where(F.col("campaign_number") != "")
        .join(investigations, "investigation_document_id")
        .withColumn("link_id", F.xxhash64(*LINK_KEY))
    )


def ordered_links(links: DataFrame, documents: DataFrame) -> DataFrame:
    """Scoped links sorted by investigation and component, ties settled by the rest of the key.

    ``pos`` rises with that order; a sort over ranges numbers it without
    bringing the links into one task, so it has gaps.
    """
    return (
        scoped_links(links, documents)
        .orderBy("investigation_external_id", "component", "campaign_number",
                 "vehicle_id", "investigation_document_id")
        .withColumn("pos", F.monotonically_increasing_id())
    )


def link_recalls(links: DataFrame, documents: DataFrame) -> DataFrame:
    """``link_id, recall_document_id``: the recall of the link's campaign, null when not stored."""
    recalls = documents.where(F.col("kind") == "recall").select(
        "vehicle_id", F.col("external_id").alias("campaign_number"),
        F.col("document_id").alias("recall_document_id"),
    )
    return links.select("link_id", "vehicle_id", "campaign_number").join(
        recalls, ["vehicle_id", "campaign_number"], "left"
    ).select("link_id", "recall_document_id")


def qrels(links: DataFrame, documents: DataFrame) -> DataFrame:
    """``link_id, document_id`` of the relevant set: the investigation and its recalls."""
    own = links.select("link_id", F.col("investigation_document_id").alias("document_id"))
    recalls = link_recalls(links, documents).where("recall_document_id IS NOT NULL").select(
        "link_id", F.col("recall_document_id").alias("document_id")
    )
    return own.unionByName(recalls).distinct()


def _windows(links: DataFrame, prefix_len: int, *more: str) -> DataFrame:
    """``link_id, vehicle_id, prefix, opened_on, closed_on`` of the links whose component says anything."""
    return links.select(
        "link_id", "vehicle_id", "opened_on", "closed_on", component_prefix(F.col("component"), prefix_len).alias("prefix"), *more,
    ).where(F.col("prefix") != "")


def _offered(windows: DataFrame, complaints: DataFrame, prefix_len: int, *more: str) -> DataFrame:
    """Dated complaints, once for each length of prefix that the links have: a link's prefix is then a join key."""
    lengths = [F.length("prefix") == k for k in range(1, prefix_len)]
    found = windows.agg(*[F.bool_or(has).alias(str(k)) for k, has in enumerate(lengths, 1)]).first() if lengths else {}
    used = [k for k in range(1, prefix_len) if found[str(k)]] + [prefix_len]
    prefixes = F.array_distinct(F.array(*[F.substring("component", 1, k) for k in used]))
    return complaints.where(F.col("filed_on").isNotNull()).select(
        "vehicle_id", "document_id", "external_id", "filed_on", *more, F.explode(prefixes).alias("prefix"))


def window_matches(
    links: DataFrame, complaints: DataFrame, prefix_len: int = COMPONENT_PREFIX_LENGTH,
    hot: DataFrame | None = None,
) -> DataFrame:
    """``link_id, document_id, external_id`` of all complaints inside each link's window.

    The month is a join key beside vehicle and prefix: a link offers the months of its
    window, an open window those up to the newest complaint.  Complaints of the vehicles
    in ``hot`` are spread over salts that those vehicles' links follow.  Every match is
    a row; ``first_in_window`` finds the first few without making them.
    """
    windows = _windows(links, prefix_len)
    offered = _offered(windows, complaints, prefix_len).withColumn("month", F.trunc("filed_on", "month"))
    newest = complaints.agg(F.max("filed_on")).first()[0]
    last = F.least(F.coalesce("closed_on", F.lit(newest)), F.lit(newest))
    windows = windows.where(F.col("opened_on") <= last).withColumn(
        "month", F.explode(F.sequence(F.trunc("opened_on", "month"), F.trunc(last, "month"), F.expr("INTERVAL 1 MONTH"))))
    keys = ["vehicle_id", "prefix", "month"]
    if hot is not None:
        offered, windows = salted(offered, F.col("document_id"), hot), replicated(windows, hot)
        keys.append("salt")
    return (
        offered.join(windows, keys)
        .where(covers(F.col("opened_on"), F.col("closed_on"), F.col("filed_on")))
        .select("link_id", "document_id", "external_id")
    )


def _days_met(
    links: DataFrame, complaints: DataFrame, prefix_len: int, daily: Callable[[DataFrame], DataFrame], work: Callable, schema: T.StructType,
) -> DataFrame:
    """``work`` over the windows and the days of each vehicle and prefix.

    ``daily`` makes a bounded number of rows of each day of complaints, so a vehicle of
    any size is a bounded table here; the links of a vehicle with many are spread over
    salts that its days follow.
    """
    windows = _windows(links, prefix_len, *[c for c in links.columns if c == "weight"])
    hot = windows.groupBy("vehicle_id").agg(F.count(F.lit(1)).alias("links")).where(F.col("links") > LINKS_PER_SALT).select(
        "vehicle_id", F.ceil(F.col("links") / LINKS_PER_SALT).cast("int").alias("salts"))
    # A complaint whose vehicle and prefix no link names is in no window.
    named = windows.select("vehicle_id", "prefix").distinct()
    offered = _offered(windows, complaints, prefix_len).join(named, ["vehicle_id", "prefix"], "left_semi")
    keys = ["vehicle_id", "prefix", "salt"]
    asked = salted(windows.where("opened_on IS NOT NULL"), F.col("link_id"), hot)
    # Both sides may stem from one table: columns of their own tell them apart.
    asked = asked.select(*[F.col(name).alias(name) for name in asked.columns])
    return asked.groupBy(keys).cogroup(replicated(daily(offered), hot).groupBy(keys)).applyInArrow(work, schema)


def _spans(windows: pa.Table, days: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place and end of each window in the sorted days."""
    opened, closed = (windows.column(name).cast(pa.int32()) for name in ("opened_on", "closed_on"))
    first = np.searchsorted(days, opened.to_numpy(), "left")
    return first, np.maximum(first, np.searchsorted(days, closed.fill_null(np.iinfo(np.int32).max).to_numpy(), "right"))


def first_in_window(
    links: DataFrame, complaints: DataFrame, n: int = MAX_QUERIES_PER_LINK, prefix_len: int = COMPONENT_PREFIX_LENGTH,
) -> DataFrame:
    """``link_id, document_id, external_id, pick`` of the first ``n`` complaints in each link's window, by external id as text.

    Only the first ``n`` of a day can be among the first of a window, so that many of each
    day meet the windows; matches are never rows.  Ties go by the document's id, as text if
    it is no whole number.
    """
    kind = complaints.schema["document_id"].dataType
    tie = F.col("document_id") if isinstance(kind, T.IntegralType) else F.col("document_id").cast("string")
    schema = T.StructType([links.schema["link_id"], complaints.schema["document_id"], complaints.schema["external_id"], T.StructField("pick", T.IntegerType())])

    def daily(offered: DataFrame) -> DataFrame:
        found = top_k(offered.withColumn("tie", tie), ["vehicle_id", "prefix", "filed_on"], [F.asc("external_id"), F.asc("tie")], n, "pick")
        return found.select("vehicle_id", "prefix", "filed_on", "external_id", "tie", "document_id")

    def work(windows: pa.Table, records: pa.Table) -> pa.Table:
        order = pc.sort_indices(records, sort_keys=[("external_id", "ascending"), ("tie", "ascending")])
        records = records.take(order)
        days = records.column("filed_on").cast(pa.int32()).to_numpy()
        by_day = np.argsort(days, kind="stable")  # the places in order of id, gathered by day
        firsts, ends = _spans(windows, days[by_day])
        spans, same = np.unique(np.stack([firsts, ends], axis=1), axis=0, return_inverse=True)
        picked = []
        for first, end in spans.tolist():
            inside = by_day[first:end]
            picked.append(np.sort(np.partition(inside, n - 1)[:n] if len(inside) > n else inside))
        sizes = np.array([*map(len, picked)], np.int64)
        starts, found = np.cumsum(sizes) - sizes, np.concatenate([np.zeros(0, np.int64), *picked])
        many = sizes[same.ravel()]
        link = np.repeat(np.arange(windows.num_rows), many)
        pick = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        rows = records.take(pa.array(found[np.repeat(starts[same.ravel()], many) + pick]))
        return pa.table([windows.column("link_id").take(pa.array(link)), rows.column("document_id"), rows.column("external_id"),
                         pa.array((pick + 1).astype(np.int32))], names=schema.names)

    return _days_met(links, complaints, prefix_len, daily, work, schema)


def count_in_window(links: DataFrame, complaints: DataFrame, prefix_len: int = COMPONENT_PREFIX_LENGTH) -> DataFrame:
    """``link_id, matches``: how many complaints each link's window holds; a match is no row."""
    schema = T.StructType([links.schema["link_id"], T.StructField("matches", T.LongType())])

    def daily(offered: DataFrame) -> DataFrame:
        return offered.groupBy("vehicle_id", "prefix", "filed_on").agg(F.count(F.lit(1)).alias("matches"))

    def work(windows: pa.Table, counts: pa.Table) -> pa.Table:
        counts = counts.sort_by("filed_on")
        firsts, ends = _spans(windows, counts.column("filed_on").cast(pa.int32()).to_numpy())
        before = np.append(0, np.cumsum(counts.column("matches").to_numpy()))
        return pa.table([windows.column("link_id"), pa.array(before[ends] - before[firsts])], names=schema.names)

    return _days_met(links, complaints, prefix_len, daily, work, schema)


def windows_of_days(links: DataFrame, complaints: DataFrame, prefix_len: int = COMPONENT_PREFIX_LENGTH) -> DataFrame:
    """``vehicle_id, prefix, filed_on, cases``: how many windows hold a day on which a complaint is offered, each as often
    as its ``weight`` says; a match is no row."""
    schema = T.StructType([complaints.schema["vehicle_id"], T.StructField("prefix", T.StringType()), complaints.schema["filed_on"], T.StructField("cases", T.LongType())])

    def daily(offered: DataFrame) -> DataFrame:
        return offered.select("vehicle_id", "prefix", "filed_on").distinct()

    def work(windows: pa.Table, days: pa.Table) -> pa.Table:
        days = days.sort_by("filed_on")
        firsts, ends = _spans(windows, days.column("filed_on").cast(pa.int32()).to_numpy())
        weights = windows.column("weight").to_numpy()
        change = np.zeros(days.num_rows + 1, np.int64)
        np.add.at(change, firsts, weights)
        np.subtract.at(change, ends, weights)
        return pa.table([*(days.column(name) for name in schema.names[:3]), pa.array(np.cumsum(change)[:-1])], names=schema.names)

    met = _days_met(links, complaints, prefix_len, daily, work, schema)
    return met.groupBy("vehicle_id", "prefix", "filed_on").agg(F.sum("cases").alias("cases"))


def asked_in_windows(
    links: DataFrame, documents: DataFrame, vehicle_id: int | None = None, prefix_len: int = COMPONENT_PREFIX_LENGTH,
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What ``build_ground_truth`` gives with ``per_link=None``, without a row for each case: its number grows with
    links times complaints of a window.

    ``asked``: ``vehicle_id, document_id, cases``, each complaint that is in a window and how many cases ask it.
    ``windows``: ``link_id, vehicle_id, prefix, opened_on, closed_on, weight``, and ``dated``: ``vehicle_id, document_id,
    component, filed_on, weight``, of which ``in_window`` tells the cases of a link and a complaint.  ``qrels`` as there.
    A weight is how many rows a link or complaint has, which a case is repeated for.
    """
    scoped, complaints = _scoped(links, documents, vehicle_id)
    scoped = cut_lineage(scoped)
    heads = scoped.groupBy("link_id").agg(F.count(F.lit(1)).alias("weight"))
    weighed = cut_lineage(scoped.select("link_id", "vehicle_id", "component", "opened_on", "closed_on").join(heads, "link_id"))
    told = complaints.where("document_id IS NOT NULL").select("vehicle_id", "document_id", "external_id", "component", "filed_on")
    rows = told.groupBy("document_id").agg(F.count(F.lit(1)).alias("weight"))
    dated = cut_lineage(told.where("vehicle_id IS NOT NULL AND filed_on IS NOT NULL").join(rows, "document_id"))
    days = windows_of_days(weighed, dated, prefix_len).where("cases > 0")
    offered = _offered(_windows(weighed, prefix_len), dated, prefix_len, "weight")
    asked = offered.join(days, ["vehicle_id", "prefix", "filed_on"]).groupBy("vehicle_id", "document_id").agg(
        F.sum(F.col("cases") * F.col("weight")).alias("cases"))
    windows = _windows(weighed, prefix_len, "weight").where("opened_on IS NOT NULL")
    return asked, windows, dated.drop("external_id"), qrels(scoped, documents)


def in_window(window: str, complaint: str) -> Column:
    """Whether a link's window holds a complaint of its vehicle, for rows already joined on the vehicle."""
    w, c = (lambda name: F.col(f"{window}.{name}")), (lambda name: F.col(f"{complaint}.{name}"))
    return F.startswith(c("component"), w("prefix")) & covers(w("opened_on"), w("closed_on"), c("filed_on"))


def cap_queries(matches: DataFrame, n: int = MAX_QUERIES_PER_LINK) -> DataFrame:
    """The first ``n`` complaints of each link by external id as text, of matches that are rows."""
    return top_k(
        matches, "link_id", [F.asc("external_id"), F.asc("document_id")], n, "pick"
    )


def _scoped(links: DataFrame, documents: DataFrame, vehicle_id: int | None) -> tuple[DataFrame, DataFrame]:
    """The scoped links, of one vehicle if asked, and all complaints."""
    scoped = scoped_links(links, documents)
    return scoped if vehicle_id is None else scoped.where(F.col("vehicle_id") == vehicle_id), documents.where(F.col("kind") == "complaint")


def count_matches(
    links: DataFrame, documents: DataFrame, vehicle_id: int | None = None, prefix_len: int = COMPONENT_PREFIX_LENGTH,
) -> int:
    """How many cases there are when no link's complaints are cut off."""
    counts = count_in_window(*_scoped(links, documents, vehicle_id), prefix_len)
    return counts.agg(F.coalesce(F.sum("matches"), F.lit(0))).first()[0]


def build_ground_truth(
    links: DataFrame, documents: DataFrame, vehicle_id: int | None = None,
    per_link: int | None = MAX_QUERIES_PER_LINK, prefix_len: int = COMPONENT_PREFIX_LENGTH,
) -> tuple[DataFrame, DataFrame]:
    """Cases and their relevant sets.

    ``cases``: ``case_row, case_id, link_id, vehicle_id, document_id, query_text``;
    one complaint under two links is two cases with one ``case_id``, so rows are
    told apart by ``case_row``.  ``qrels``: ``link_id, document_id``.  A link asks
    ``per_link`` complaints, or all of its window with None.
    """
    scoped, complaints = _scoped(links, documents, vehicle_id)
    # Ids alone: written, so their bodies can be picked by id.
    picked = window_matches(scoped, complaints, prefix_len, hot_vehicles(complaints)) if per_link is None else first_in_window(
        scoped, complaints, per_link, prefix_len)
    picked = cut_lineage(picked.select("link_id", "document_id"))
    heads = scoped.select("link_id", "vehicle_id", "investigation_external_id")
    bodies = keep_ids(
        complaints.select("document_id", "external_id", F.col("body").alias("query_text")),
        picked, "document_id",
    )
    cases = (
        picked.join(heads, "link_id").join(bodies, "document_id")
        .select(
            F.xxhash64("link_id", "document_id").alias("case_row"),
            case_id(F.col("investigation_external_id"), F.col("external_id")).alias("case_id"),
            "link_id", "vehicle_id", "document_id", "query_text",
        )
    )
    return cases, qrels(scoped, documents)

