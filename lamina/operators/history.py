"""Versions of changing entity attributes (problem 2), with affected-chain rebuild.

Rows of one entity are folded to one state change per (entity, date, attribute)
before anything is shuffled by entity, so that an entity holding a third of all
rows still reaches its window as at most one row per calendar day and attribute.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lamina.session import ensure_checkpoint_dir
from lamina.sources.buckets import BucketedTable

OPEN_END = "9999-12-31"
#: Keys that describe a version and aren't attributes of the entity (fixed values).
VALIDITY_KEYS = ("valid_from", "valid_to", "is_current")


def squeeze(c: Column) -> Column:
    """Lower case, inner white space to one blank, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)\s+", " "), r"^ | $", "")


def stated(c: Column) -> Column:
    """The squeezed value, or null where it is absent, blank, ``none`` or ``null``."""
    v = squeeze(c)
    return F.when(~v.isin("", "none", "null"), v)


def day(c: Column) -> Column:
    """``YYYY`` (1 January) or ``YYYY-MM-DD`` as ``YYYY-MM-DD``; anything else is not stated."""
    v = stated(c)
    return F.when(v.rlike(r"^\d{4}$"), F.concat(v, F.lit("-01-01"))).when(v.rlike(r"^\d{4}-\d{2}-\d{2}$"), v)


def dated_changes(raw: DataFrame) -> DataFrame:
    """(stable_id, on_day, ord, valid_to, properties): each raw row under its date.

    Rows without stable_id name no entity and are left out, as are rows with neither
    a valid_from nor a recorded_at. Null properties state nothing.
    """
    props = F.col("properties")
    return raw.select(
        "stable_id",
        F.coalesce(day(props["valid_from"]), F.date_format("recorded_at", "yyyy-MM-dd")).alias("on_day"),
        F.struct(F.coalesce(F.col("recorded_at"), F.timestamp_seconds(F.lit(0))).alias("r"), F.col("snap_id").alias("s")).alias("ord"),
        day(props["valid_to"]).alias("valid_to"),
        props.alias("properties"),
    ).filter("stable_id is not null and on_day is not null")


def build_chains(raw: DataFrame) -> DataFrame:
    """All versions of every entity in ``raw``: stable_id, valid_from, valid_to.

    Nulls: see dated_changes. Ties: by recorded_at, then snap_id. Repeated rows
    state the same values again and change nothing. An empty table gives no rows.
    """
    rows = dated_changes(raw)
    keys = F.map_filter(F.coalesce("properties", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(*VALIDITY_KEYS))
    attrs = rows.select("stable_id", "on_day", "ord", F.explode(keys).alias("attr", "given")).withColumn("value", stated("given")).filter("value is not null")
    # One state change per entity, date and attribute; combined map-side.
    last = attrs.groupBy("stable_id", "on_day", squeeze(F.col("attr")).alias("attr")).agg(F.max_by("value", "ord").alias("value"))
    before = F.lag("value").over(W.partitionBy("stable_id", "attr").orderBy("on_day"))
    changed = last.withColumn("differs", ~F.col("value").eqNullSafe(before)).groupBy("stable_id", "on_day").agg(F.max("differs").alias("differs"))
    days = rows.groupBy("stable_id", "on_day").agg(F.max_by("valid_to", "ord").alias("stop"))
    chain = W.partitionBy("stable_id").orderBy("on_day")
    upto = chain.rowsBetween(W.unboundedPreceding, 0)
    steps = (
        days.join(changed, ["stable_id", "on_day"], "left")
        .withColumn("next_day", F.lead("on_day").over(chain))
        .withColumn("stop", F.when((F.col("stop") > F.col("on_day")) & (F.col("next_day").isNull() | (F.col("next_day") >= F.col("stop"))), F.col("stop")))
        .withColumn("differs", F.coalesce("differs", F.lit(False)))
        .withColumn("known", F.max("differs").over(upto))
        .withColumn("starts", F.col("known") & (F.col("differs") | F.lag("stop").over(chain).isNotNull()))
        .withColumn("version", F.sum(F.col("starts").cast("int")).over(upto))
        .filter("version > 0")
    )
    versions = steps.groupBy("stable_id", "version").agg(F.min("on_day").alias("valid_from"), F.max("stop").alias("stop"))
    following = F.lead("valid_from").over(W.partitionBy("stable_id").orderBy("valid_from"))
    return versions.select("stable_id", "valid_from", F.coalesce("stop", following, F.lit(OPEN_END)).alias("valid_to"))


def rebuild_affected(table: BucketedTable, raw: DataFrame, updates: DataFrame) -> None:
    """The chains of ``table`` that ``updates`` touch, replaced at once by ones rebuilt from all their raw changes.

    ``raw`` holds every change, the updates included. Only touched entities' rows are retrieved (semi join)
    and rebuilt, and only the buckets that hold them are rewritten; all other chains stay where they lie.
    """
    touched = updates.select("stable_id").filter("stable_id is not null").distinct()
    numbers = table.numbers(touched)
    if not numbers:
        return
    fresh, held = build_chains(raw.join(touched, "stable_id", "left_semi")), table.read(numbers)
    table.replace(fresh if held is None else held.join(touched, "stable_id", "left_anti").unionByName(fresh), numbers)


def chain_table(spark, folder: str) -> BucketedTable:
    return BucketedTable(spark, folder, ["stable_id"])


def versions_with_late_updates(raw: DataFrame, settled: float = 0.95, folder: str | None = None) -> DataFrame:
    """Chains of the rows that had arrived first, then those rebuilt that the later arrivals touch, read from the table so written.

    Arrival is by snap_id; ``settled`` is the share of its range that counts as there. The result doesn't depend on it.
    The table lies in ``folder``, or under the session's checkpoint folder.
    """
    spark = raw.sparkSession
    table = chain_table(spark, folder or f"{ensure_checkpoint_dir(spark)}/chains-{uuid.uuid4().hex}")
    lo, hi = raw.agg(F.min("snap_id"), F.max("snap_id")).first()
    late = F.lit(False) if lo is None else F.coalesce(F.col("snap_id") > int(lo + (hi - lo) * settled), F.lit(True))
    table.replace(build_chains(raw.filter(~late)))
    rebuild_affected(table, raw, raw.filter(late))
    return table.read()
