"""Remove what repeats in runs of three lines: the first occurrence of a run in the corpus stays.

Every three consecutive lines that hold a word (blank lines are passed over) are
one window, known by a 128-bit hash.  A window found more than once keeps its first
place, by document and line; all its later places are covered, and the covered
stretches of a document are merged and cut out.  Only hashes are shuffled until
then: the texts meet their stretches once.  DataFrame functions alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut_lineage
from .common import kept_columns

WINDOW = 3
HAS_WORD = r"[^\x20\x09-\x0D]"


def _windows(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """``_id, _hash`` (of the text), the window's number ``k``, its first and last line and its two hashes."""
    lines = docs.select(
        F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_hash"),
        F.filter(
            F.transform(F.split(text, "\n"), lambda line, i: F.struct(
                i.alias("at"), F.regexp_like(line, F.lit(HAS_WORD)).alias("full"),
                F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))),
            lambda line: line["full"]).alias("_lines"),
    ).where(F.size("_lines") >= WINDOW)

    def window(k: Column) -> Column:
        three = [F.get("_lines", k + j) for j in range(WINDOW)]
        return F.struct(k.alias("k"), three[0]["at"].alias("lo"), three[-1]["at"].alias("hi"),
                        F.xxhash64(*(x["a"] for x in three)).alias("a"), F.xxhash64(*(x["b"] for x in three)).alias("b"))

    numbers = F.sequence(F.lit(0), F.size("_lines") - WINDOW)
    return lines.select("_id", "_hash", F.explode(F.transform(numbers, window)).alias("w")).select("_id", "_hash", "w.*")


def repeated_stretches(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``_id, _hash, _cut``: the merged stretches of lines (from, to) that later occurrences of windows cover."""
    windows = cut_lineage(_windows(docs, text, doc_id))
    place = F.struct("_id", "_hash", "k")
    # Written, so that the join deals both sides out itself and can split a window that a third of all documents share.
    repeated = cut_lineage(
        windows.groupBy("a", "b").agg(F.min(place).alias("_first"), F.max(place).alias("_last"))
        .where(F.col("_first") != F.col("_last")).select("a", "b", "_first"))
    later = windows.join(repeated, ["a", "b"]).where(~place.eqNullSafe(F.col("_first"))).select("_id", "_hash", "lo", "hi").distinct()
    document = Window.partitionBy("_id", "_hash").orderBy("lo")
    reach = F.max("hi").over(document.rowsBetween(Window.unboundedPreceding, -1))
    islands = later.withColumn("_new", (reach.isNull() | (F.col("lo") > reach + 1)).cast("int")).withColumn(
        "_island", F.sum("_new").over(document.rowsBetween(Window.unboundedPreceding, 0)))
    merged = islands.groupBy("_id", "_hash", "_island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return cut_lineage(merged.groupBy("_id", "_hash").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("_cut")))


def dedup_lines(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", counts: bool = True) -> DataFrame:
    """Every row with its text less the repeated stretches, and ``n_lines``, ``n_removed`` unless ``counts`` is off.

    A null text stays null with no lines; an empty one has one (blank) line.  A row
    whose lines all repeat stays, with an empty text.  Rows with equal id and text are
    one document and have one result; with equal ids alone, the texts' hashes settle
    which comes first; a null id comes before all others.  Within a document a later
    repeat goes too.  Columns named like a count are replaced.  An empty table gives
    an empty table.  A document's stretches are gathered in its own row alone.
    """
    made = ["n_lines", "n_removed"] if counts else []
    keep = [c for c in kept_columns(docs, made) if c != text]
    cuts = repeated_stretches(docs, text=text, doc_id=doc_id).select(
        F.col("_id").alias("_cut_id"), F.col("_hash").alias("_cut_hash"), "_cut")
    # The same join at every size: whether the cuts would fit a broadcast depends on the corpus.
    joined = docs.select(
        F.struct(*keep).alias("_row"), F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_hash"), F.col(text).alias("_text"),
    ).join(cuts.hint("merge"), F.col("_id").eqNullSafe(F.col("_cut_id")) & (F.col("_hash") == F.col("_cut_hash")), "left")
    parts = joined.withColumn("_lines", F.split("_text", "\n"))
    # What lies between the cuts, as (first line, end) pairs.
    begin = F.concat(F.array(F.lit(0)), F.transform("_cut", lambda c: c["hi"] + 1))
    end = F.concat(F.transform("_cut", lambda c: c["lo"]), F.array(F.size("_lines")))
    between = F.zip_with(begin, end, lambda a, b: F.slice("_lines", a + 1, b - a))
    lost = F.aggregate("_cut", F.lit(0), lambda total, c: total + c["hi"] - c["lo"] + 1)
    columns = {
        "n_lines": F.when(F.col("_text").isNull(), 0).otherwise(F.size("_lines")).cast("long"),
        "n_removed": F.coalesce(lost, F.lit(0)).cast("long"),
    }
    out = F.when(F.col("_cut").isNull(), F.col("_text")).otherwise(F.array_join(F.flatten(between), "\n"))
    order = [F.col(f"_row.{c}") if c != text else out.alias(text) for c in docs.columns if c in keep or c == text]
    return parts.select(*order, *(columns[c].alias(c) for c in made))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE text IS NOT NULL),
windows AS (
  SELECT doc_id, i AS lo, lead(i, 2) OVER w AS hi, line AS l1, lead(line, 1) OVER w AS l2, lead(line, 2) OVER w AS l3
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
  WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
later AS (
  SELECT doc_id, lo, hi FROM windows WHERE hi IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY l1, l2, l3 ORDER BY doc_id, lo) > 1),
covered AS (SELECT DISTINCT doc_id, unnest(generate_series(lo, hi)) AS i FROM later),
kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(c.i) AS n_removed,
         coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE c.i IS NULL), '') AS text
  FROM lines l LEFT JOIN covered c USING (doc_id, i) GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, k.text
FROM documents d LEFT JOIN kept k USING (doc_id)
"""
