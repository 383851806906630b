"""From feed rows to the documents, passages and links that will be stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import is_blank, single_line, trim_ws
from .passages import numbered, passage_texts, whole_passage_array

TITLE_CHARACTERS = 80
COMPONENT_SEPARATOR = "; "
SECTION_SEPARATOR = "\n\n"
INVESTIGATION_KEY = ["vehicle_id", "external_id"]

_PLAN = [
    "vehicle_id", "kind", "external_id", "component", "filed_on", "title", "body",
    "raw_payload", "passages",
]


def dedupe_first(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key in the given order.

    An ordered ``min_by`` combines before the shuffle, so a key that holds a
    large share of the rows sends one row per task.
    """
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("first")).select(
        *keys, "first.*"
    )


def passages_of(kind: Column, body: Column) -> Column:
    """The passages that a stored document of that kind is cut into."""
    return F.when(kind == "investigation", numbered(passage_texts(body))).otherwise(whole_passage_array(body))


def keyed_complaints(feed: DataFrame) -> DataFrame:
    """Complaints with their trimmed id as ``external_id``, null where the id or the text is blank."""
    return feed.withColumn("external_id", F.when(
        ~is_blank(F.col("summary")) & ~is_blank(F.col("odi_number")), trim_ws(F.col("odi_number"))))


def plan_complaints(feed: DataFrame) -> DataFrame:
    """Complaint documents, one per (vehicle, trimmed id), first in feed order."""
    usable = keyed_complaints(feed).where(F.col("external_id").isNotNull()).select(
        "vehicle_id", "feed_order", "external_id", "components", "filed_on", "summary", "raw",
    )
    return dedupe_first(usable, ["vehicle_id", "external_id"], "feed_order").select(
        "vehicle_id",
        F.lit("complaint").alias("kind"),
        "external_id",
        F.col("components").alias("component"),
        "filed_on",
        F.substring(single_line(F.col("summary")), 1, TITLE_CHARACTERS).alias("title"),
        F.col("summary").alias("body"),
        F.col("raw").alias("raw_payload"),
        whole_passage_array(F.col("summary")).alias("passages"),
    ).select(*_PLAN)


def recall_body() -> Column:
    """The non-blank sections of a recall, a blank line between them."""
    return F.array_join(
        F.filter(F.array("summary", "consequence", "remedy"), lambda s: ~is_blank(s)),
        SECTION_SEPARATOR,
    )


def keyed_recalls(feed: DataFrame) -> DataFrame:
    """Recalls with their ``body`` and trimmed campaign as ``external_id``, null where either is blank."""
    return feed.withColumn("body", recall_body()).withColumn("external_id", F.when(
        ~is_blank(F.col("campaign_number")) & ~is_blank(F.col("body")), trim_ws(F.col("campaign_number"))))


def plan_recalls(feed: DataFrame) -> DataFrame:
    """Recall documents, one per (vehicle, trimmed campaign), first in feed order."""
    usable = keyed_recalls(feed).where(F.col("external_id").isNotNull()).select(
        "vehicle_id", "feed_order", "external_id", "campaign_number", "component", "received_on", "body", "raw",
    )
    return dedupe_first(usable, ["vehicle_id", "external_id"], "feed_order").select(
        "vehicle_id",
        F.lit("recall").alias("kind"),
        "external_id",
        "component",
        F.col("received_on").alias("filed_on"),
        trim_ws(F.concat_ws(" ", "campaign_number", "component")).alias("title"),
        "body",
        F.col("raw").alias("raw_payload"),
        whole_passage_array(F.col("body")).alias("passages"),
    ).select(*_PLAN)


def joined_components(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct non-empty components per group, in first-seen order, as one text.

    Repeats are reduced to their first position before anything is collected, so
    a group collects its vocabulary of components, not its rows.
    """
    first_seen = (
        rows.where(F.col("component") != "")
        .groupBy(*keys, "component").agg(F.min("feed_order").alias("seen"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("seen", "component")))
    return first_seen.groupBy(*keys).agg(
        F.array_join(F.transform(ordered, lambda s: s["component"]), COMPONENT_SEPARATOR)
        .alias("component")
    )


def distinct_links(rows: DataFrame, keys: list[str]) -> DataFrame:
    """First row of each (campaign, component) per group, campaign and open date present."""
    usable = rows.where(~is_blank(F.col("campaign_number")) & F.col("opened_on").isNotNull()).select(
        *keys, trim_ws(F.col("campaign_number")).alias("campaign_number"), "component",
        "feed_order", "opened_on", "closed_on",
    )
    return dedupe_first(usable, [*keys, "campaign_number", "component"], "feed_order")


def collapse_investigations(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per group: first subject, summary and open date, and the joined components."""
    head = rows.groupBy(*keys).agg(
        F.min_by(F.struct("subject", "summary", "opened_on"), "feed_order").alias("first")
    )
    return (
        head.join(joined_components(rows, keys), keys, "left")
        .select(*keys, "first.*", F.coalesce("component", F.lit("")).alias("component"))
    )


def keyed_rows(rows: DataFrame) -> DataFrame:
    """Rows with their trimmed action number as ``external_id``, null where it or the summary is blank."""
    return rows.withColumn("external_id", F.when(
        ~is_blank(F.col("action_number")) & ~is_blank(F.col("summary")), trim_ws(F.col("action_number"))))


def usable_rows(rows: DataFrame) -> DataFrame:
    """Rows with an action number and a summary."""
    return keyed_rows(rows).where(F.col("external_id").isNotNull())


def plan_investigations(rows: DataFrame) -> DataFrame:
    """Investigation documents, one per (vehicle, action number), with their passages.

    Links and verbatim lines stay rows of their own (``investigation_links``,
    ``investigation_lines``): one action number may hold any number of them.
    """
    return (
        collapse_investigations(usable_rows(rows), INVESTIGATION_KEY).select(
            "vehicle_id",
            F.lit("investigation").alias("kind"),
            "external_id",
            "component",
            F.col("opened_on").alias("filed_on"),
            F.col("subject").alias("title"),
            F.col("summary").alias("body"),
            F.lit("").alias("raw_payload"),
            numbered(passage_texts(F.col("summary"))).alias("passages"),
        ).select(*_PLAN)
    )


def investigation_lines(rows: DataFrame) -> DataFrame:
    """The verbatim flat-file lines behind each investigation, with their order."""
    return usable_rows(rows).select(*INVESTIGATION_KEY, "feed_order", "raw_line")


def investigation_links(rows: DataFrame) -> DataFrame:
    """``vehicle_id, external_id`` and the distinct links of each investigation, in feed order."""
    return distinct_links(usable_rows(rows), INVESTIGATION_KEY)


def match_family(rows: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Investigation rows × vehicles: same year and make, and the row's model is the
    vehicle's model or the start of it up to a blank, in any case.

    Each vehicle lists the starts of its model that end before a blank, which
    turns the prefix test into an equality.
    """
    model = F.upper("model")
    starts = F.transform(
        F.filter(
            F.sequence(F.lit(1), F.length(model)), lambda i: F.substring(model, i, F.lit(1)) == " "
        ),
        lambda i: F.substring(model, F.lit(1), i - 1),
    )
    families = vehicles.where(F.length("model") > 0).select(
        "vehicle_id", F.upper("make").alias("make_key"), F.col("model_year").alias("year_key"),
        F.explode(F.array_distinct(F.concat(F.array(model), starts))).alias("model_key"),
    )
    keyed = rows.withColumns({
        "make_key": F.upper("make"), "year_key": F.col("model_year"), "model_key": F.upper("model"),
    })
    return keyed.join(families, ["make_key", "year_key", "model_key"]).drop(
        "make_key", "year_key", "model_key"
    )
