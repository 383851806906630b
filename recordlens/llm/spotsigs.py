"""Document fingerprints from common-word anchors (SpotSigs), with DataFrame functions alone.

A signature is a common word with the two content words that follow it, other
common words skipped.  Common words sit in running text and hardly in menus,
tables or markup, so the set of signatures follows the prose.  So that lists and
tables have signatures too, one content word in ``SPARE``, picked by its hash, starts a
chain without a common word.  Sets are compared by Jaccard, and only where their
lengths allow the wanted likeness.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Common words of four languages.
ANCHORS = (
    "a an the is was are be of and to in that it for with as by on at from this "
    "der die das und ist ein eine den dem des von zu mit für auf im nicht "
    "le la les un une des est et de du que en dans pour par sur "
    "el los las una es y del se con al su"
).split()
_ANY = "(?:" + "|".join(sorted(set(ANCHORS), key=lambda w: (-len(w), w))) + ")"
# One content word in so many starts a chain by itself.
SPARE = 8
# Documents that stand in one group while neighbours are looked up, and groups at most.
DOCUMENTS_A_GROUP = 512
MOST_GROUPS = 16_384


def with_signatures(df: DataFrame, text: str, made: str) -> DataFrame:
    """Every row with ``made``: the sorted set of its text's signatures, as 32-bit hashes.

    A text without any start has a signature for each word and the one after it;
    a null text, or one without letters or digits, has none.
    """
    words = F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    last_anchor = F.regexp_replace(F.concat(F.lit(" "), F.trim(words), F.lit(" ")), f" {_ANY}(?= {_ANY} | $)", "")
    # A content word carries the common word before it: "the:cat".
    tokens = F.split(F.trim(F.regexp_replace(last_anchor, f" ({_ANY}) ", " $1:")), " ")
    follower = F.concat(F.slice("_tokens", 2, F.greatest(F.size("_tokens") - 1, F.lit(0))), F.array(F.lit("")))
    starts = lambda a: F.contains(a, F.lit(":")) | (F.pmod(F.hash(a), F.lit(SPARE)) == 0)
    chains = F.zip_with("_tokens", follower, lambda a, b: F.when(starts(a), F.hash(a, F.substring_index(b, ":", -1))))
    plain = F.zip_with("_tokens", follower, lambda a, b: F.hash(a, b))
    empty = F.array().cast("array<int>")
    return (
        df.withColumn("_tokens", tokens)
        .withColumn("_chains", F.array_compact(chains))
        .withColumn(made, F.when(F.get("_tokens", F.lit(0)) == "", empty).otherwise(
            F.array_sort(F.array_distinct(F.when(F.size("_chains") > 0, F.col("_chains")).otherwise(plain)))))
        .drop("_tokens", "_chains")
    )


def fingerprint(signatures: Column) -> Column:
    """A set of signatures as text: eight hexadecimal digits each, in order."""
    return F.array_join(F.transform(signatures, lambda s: F.lpad(F.hex(s.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def length_partition(signatures: Column, least: float) -> Column:
    """Sets whose partitions differ by more than one cannot be ``least`` alike."""
    return F.floor(F.log(F.greatest(F.size(signatures), F.lit(1)).cast("double")) / F.log(F.lit(1 / least))).cast("int")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard of two sets; 0 without looking at them where their lengths rule ``least`` out.  Two empty sets are equal."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b))
    return (
        F.when(large == 0, 1.0)
        .when((small == 0) | (small < least * large), 0.0)
        .otherwise(shared / (F.size(a) + F.size(b) - shared))
    )


def near_pairs(docs: DataFrame, *, least: float = 0.8, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Membership ``doc_id, class_id`` and pairs ``class_id, other_id, likeness`` of classes that are ``least`` alike.

    Documents with one fingerprint are a class, named by its least id; copies are not
    expanded into pairs.  Classes meet in an index over their rarest signatures (as
    many as any set alike enough must share one of), within their partition of set
    lengths or the next.  Texts without signatures are one class and pair with none.
    """
    prints = with_signatures(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")), "_text", "sigs").select("doc_id", "sigs")
    classes = prints.groupBy("sigs").agg(F.min("doc_id").alias("class_id"))
    members = prints.join(classes, "sigs").select("doc_id", "class_id")
    classes = classes.where(F.size("sigs") > 0).withColumn("part", length_partition(F.col("sigs"), least))
    entries = classes.select("class_id", F.size("sigs").alias("n"), F.explode("sigs").alias("sig"))
    often = entries.groupBy("sig").agg(F.count(F.lit(1)).alias("often"))
    ranked = entries.join(often, "sig").withColumn(
        "rank", F.row_number().over(Window.partitionBy("class_id").orderBy("often", "sig")))
    index = ranked.where(F.col("rank") <= F.col("n") - F.ceil(F.lit(least) * F.col("n")) + 1).join(
        classes.select("class_id", "part"), "class_id").select("class_id", "part", "n", "sig")
    probe = index.select(F.col("class_id").alias("other_id"), F.col("n").alias("m"), "sig",
                         F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    candidates = index.join(probe, ["sig", "part"]).where(
        (F.col("class_id") != F.col("other_id")) & (F.least("n", "m") >= least * F.greatest("n", "m"))
    ).select(F.least("class_id", "other_id").alias("class_id"), F.greatest("class_id", "other_id").alias("other_id")).distinct()
    sets = classes.select("class_id", "sigs")
    others = sets.select(F.col("class_id").alias("other_id"), F.col("sigs").alias("other_sigs"))
    pairs = candidates.join(sets, "class_id").join(others, "other_id").select(
        "class_id", "other_id", likeness(F.col("sigs"), F.col("other_sigs"), least).alias("likeness"))
    return members, pairs.where(F.col("likeness") >= least)


def with_next_text(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, text, _group, _guest, _tie``: every row, grouped by ranges of ids, each group with the row that follows it.

    In descending order of ids the row after the last is the first.  Equal ids are in
    the order of their texts' hashes; null ids come last.  The driver holds the
    groups' borders, at most ``MOST_GROUPS`` numbers; beyond that groups grow.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("_tie"))
    total = rows.count()
    groups = max(1, min(MOST_GROUPS, -(-total // DOCUMENTS_A_GROUP)))
    cuts = rows.agg(F.percentile_approx("doc_id", [k / groups for k in range(1, groups)] or [0.5], F.lit(max(10_000, 4 * groups)))).first()[0]
    cuts = sorted(set(cuts or [])) if groups > 1 else []
    wide = max(1, int(len(cuts) ** 0.5))
    blocks = [cuts[k:k + wide] for k in range(0, len(cuts), wide)]
    group = F.lit(0)
    if blocks:
        # Two short searches instead of one long: first the block of borders, then the border in it.
        tops = F.array(*(F.lit(b[0]) for b in blocks))
        inner = F.array(*(F.array(*map(F.lit, b)) for b in blocks))
        block = F.size(F.filter(tops, lambda t: t <= F.col("doc_id")))
        within = F.size(F.filter(F.coalesce(F.get(inner, block - 1), F.array(F.lit(cuts[0]))), lambda t: t <= F.col("doc_id")))
        group = F.greatest(block - 1, F.lit(0)) * wide + within
    grouped = rows.withColumn("_group", F.coalesce(group, F.lit(0)).cast("int"))
    firsts = sorted((r["_group"], r["first"]) for r in grouped.groupBy("_group").agg(F.max(F.struct("doc_id", "_tie")).alias("first")).collect())
    spark = docs.sparkSession
    schema = f"_guest_id {rows.schema['doc_id'].dataType.simpleString()}, _guest_tie long, _to int"
    # The first row of a group follows the last of the group above it; the very first follows the very last.
    guests = spark.createDataFrame([(first[0], first[1], firsts[(k + 1) % len(firsts)][0]) for k, (_, first) in enumerate(firsts)], schema)
    found = rows.join(F.broadcast(guests), F.col("doc_id").eqNullSafe(F.col("_guest_id")) & (F.col("_tie") == F.col("_guest_tie"))) \
        .groupBy("_to").agg(F.any_value(F.struct("doc_id", "text", "_tie")).alias("row"))
    return grouped.withColumn("_guest", F.lit(False)).unionByName(
        found.select("row.doc_id", "row.text", "row._tie", F.col("_to").alias("_group"), F.lit(True).alias("_guest")))


def fingerprints(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id``, its text's ``n_chars`` and signatures ``sigs``, the text ``edited`` with ``edited_sigs``, and the next
    document's ``next_sigs``.

    The edited text has its last third replaced by as many first characters of the
    next document, in descending order of ids.  A null text counts as empty.
    Repeated rows stay; other columns are not read.  An empty table gives an empty
    table; a single document follows itself.
    """
    grouped = with_next_text(docs, text=text, doc_id=doc_id).withColumn("text", F.coalesce("text", F.lit("")))
    own = with_signatures(grouped.repartition("_group"), "text", "sigs")
    order = Window.partitionBy("_group").orderBy("_guest", F.col("doc_id").desc_nulls_last(), F.col("_tie").desc())
    both = own.withColumn("_next", F.lead(F.struct("text", "sigs")).over(order)).where(~F.col("_guest"))
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("_next.text", F.lit(1), cut))
    rows = both.select("doc_id", n.cast("long").alias("n_chars"), "sigs", edited.alias("edited"), F.col("_next.sigs").alias("next_sigs"))
    return with_signatures(rows, "edited", "edited_sigs")
