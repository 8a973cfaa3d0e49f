"""Triples: validation, direction, and the graph they make.

A triple has seq, s_class, s_props, predicate, o_class, o_props, temporal (maps of strings).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, Window as W

from lamina.functions import text as t
from lamina.operators import ontology

#: The stand-in ontology of events: what each event type says (fixed values).
SAID = {"view": ("claims", "SustainabilityClaim"), "purchase": ("reportsKPI", "KPIObservation"), "error": ("subjectToPenalty", "Penalty"), "click": ("setsGoal", "Goal"), "signup": ("holdsCertification", "Certification")}


def from_events(events: DataFrame) -> DataFrame:
    """Triples told by events: every tenth one reversed, every 17th without times, every 23rd with an unknown predicate."""
    e, kind = F.col("event_id"), F.col("event_type")
    pick = lambda k: F.create_map(*[F.lit(x) for a, v in SAID.items() for x in (a, v[k])])[kind]
    day = F.date_format("ts", "yyyy-MM-dd")
    life = [F.lit("valid_from"), day, F.lit("valid_to"), F.lit(None).cast("string"), F.lit("is_current"), F.lit("true")]
    org = F.create_map(F.lit("name"), F.concat(F.lit("user_"), F.col("user_id").cast("string")), *life)
    other = F.create_map(F.lit("id"), F.concat(kind, F.lit("_"), (e % 50).cast("string")), *life)
    turned = e % 10 == 0
    either = lambda a, b: F.when(turned, b).otherwise(a)
    return events.select(
        e.alias("seq"),
        either(F.lit("Organization"), pick(1)).alias("s_class"), either(org, other).alias("s_props"),
        F.when(e % 23 == 0, F.lit("knows")).otherwise(pick(0)).alias("predicate"),
        either(pick(1), F.lit("Organization")).alias("o_class"), either(other, org).alias("o_props"),
        F.when(e % 17 != 0, F.create_map(F.lit("valid_from"), day, F.lit("valid_to"), F.lit(None).cast("string"), F.lit("recorded_at"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))).alias("temporal"),
    )


def fix_direction(triples: DataFrame) -> DataFrame:
    """V1: swapped where only the reverse is legal; adds ``fixed``. Two joins to the rules, which are few."""
    rules = ontology.rule_table(triples.sparkSession)
    fwd = rules.select(F.col("label").alias("predicate"), F.col("src").alias("s_class"), F.col("dst").alias("o_class"), F.lit(True).alias("fwd"))
    rev = rules.select(F.col("label").alias("predicate"), F.col("dst").alias("s_class"), F.col("src").alias("o_class"), F.lit(True).alias("rev"))
    on = ["predicate", "s_class", "o_class"]
    j = triples.join(F.broadcast(fwd), on, "left").join(F.broadcast(rev), on, "left")
    swap = F.col("fwd").isNull() & F.col("rev").isNotNull()
    pick = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a)).alias(a)
    return j.select("seq", pick("s_class", "o_class"), pick("s_props", "o_props"), "predicate", pick("o_class", "s_class"), pick("o_props", "s_props"), "temporal", swap.alias("fixed"))


def errors(spark: SparkSession) -> Column:
    """V2: messages in the rules' order; keys must be there, null values are fine."""
    labels = sorted({r[0] for r in ontology.rules()})
    found = []
    for side, name in (("s", "subject"), ("o", "object")):
        cls, props = F.col(f"{side}_class"), F.col(f"{side}_props")
        found.append(F.when(cls.isNull(), f"{name}: class missing"))
        found.append(F.when(cls.isNotNull() & ~cls.isin(*ontology.IDENTITY_KEYS), F.concat(F.lit(f"{name}: unknown class "), cls)))
        found.append(F.when(props.isNull(), f"{name}: properties missing"))
        found += [F.when(props.isNotNull() & ~F.map_contains_key(props, k), f"{name}: {k} missing") for k in ontology.TEMPORAL]
    p = F.col("predicate")
    found.append(F.when(p.isNull(), "predicate missing").when(~p.isin(*labels), F.concat(F.lit("unknown predicate "), p)))
    legal = F.concat_ws(" ", p, "s_class", "o_class").isin(*(" ".join(r) for r in ontology.rules()))
    found.append(F.when(p.isin(*labels) & F.col("s_class").isNotNull() & F.col("o_class").isNotNull() & ~legal, F.concat(F.lit("illegal direction "), F.col("s_class"), F.lit(" -> "), F.col("o_class"))))
    m = F.col("temporal")
    found.append(F.when(m.isNull(), "times missing"))
    found += [F.when(m.isNotNull() & ~F.map_contains_key(m, k), f"times: {k} missing") for k in ("valid_from", "valid_to", "recorded_at")]
    return F.array_compact(F.array(*found))


def page_valid() -> Column:
    """V3: what a page's extraction must hold: classes of the ontology, properties on both ends, a known predicate."""
    labels = sorted({r[0] for r in ontology.rules()})
    ends = [F.col(f"{s}_class").isin(*ontology.IDENTITY_KEYS) & F.col(f"{s}_props").isNotNull() for s in "so"]
    return F.coalesce(ends[0] & ends[1] & F.col("predicate").isin(*labels), F.lit(False))


def without_bookkeeping(props: Column) -> Column:
    """No keys that begin with an underscore."""
    return F.map_filter(props, lambda k, _: ~k.startswith("_"))


def accepted(finish: Column) -> Column:
    """Whether an answer that ended so is taken."""
    return F.coalesce(finish.isin("", "STOP", "MAX_TOKENS"), F.lit(True))


def _told(props: Column, key: Column) -> Column:
    """A property as a key's part: empty where absent, None where null."""
    return F.when(F.map_contains_key(props, key), F.coalesce(props[key], F.lit("None"))).otherwise("")


def stable_id(cls: Column, props: Column) -> Column:
    """class and identity values, each trimmed and lower-case, joined by bars."""
    keys = F.create_map(*[F.lit(x) if k == 0 else F.array(*map(F.lit, x)) for pair in ontology.IDENTITY_KEYS.items() for k, x in enumerate(pair)])[cls]
    parts = F.transform(keys, lambda k: F.when(F.map_contains_key(props, k), F.coalesce(F.lower(F.trim(props[k])), F.lit("None"))).otherwise(""))
    return F.concat_ws("|", cls, F.array_join(parts, "|"))


def version_key(cls: Column, props: Column) -> Column:
    """the stable id with, of an observation, all its properties, of an entity, its validity."""
    e = stable_id(cls, props)
    span = F.concat_ws("|", e, _told(props, F.lit("valid_from")), _told(props, F.lit("valid_to")))
    return F.when(cls.isin(*ontology.OBSERVATIONS), F.concat_ws("|", e, props_text(props))).otherwise(span)


def validate(triples: DataFrame) -> DataFrame:
    """V4: direction fixed, then validated: adds ``errors``."""
    return fix_direction(triples).withColumn("errors", errors(triples.sparkSession))


def props_text(props: Column) -> Column:
    """Properties in one order, as a key: sorted entries with None for null."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(props)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("None")))), ";")


def nodes(triples: DataFrame) -> DataFrame:
    """G1: one node per class and properties, the first seen; seq orders subjects before objects of a triple."""
    sides = [triples.select((F.col("seq") * 2 + k).alias("seq"), F.col(f"{s}_class").alias("class"), props_text(F.col(f"{s}_props")).alias("props")) for k, s in enumerate("so")]
    return sides[0].unionAll(sides[1]).groupBy("class", "props").agg(F.min("seq").alias("node"))


def edges(triples: DataFrame, node_table: DataFrame) -> DataFrame:
    """Each triple as an edge between node numbers."""
    s = node_table.select(F.col("class").alias("s_class"), F.col("props").alias("s_text"), F.col("node").alias("src"))
    o = node_table.select(F.col("class").alias("o_class"), F.col("props").alias("o_text"), F.col("node").alias("dst"))
    told = triples.withColumns({"s_text": props_text(F.col("s_props")), "o_text": props_text(F.col("o_props"))})
    return told.join(s, ["s_class", "s_text"]).join(o, ["o_class", "o_text"]).select("seq", "src", "predicate", "dst", "temporal")


def edge_key(src: Column, predicate: Column, dst: Column, temporal: Column) -> Column:
    """F44."""
    return F.sha1(t.key_of(src, predicate, dst, temporal["valid_from"], temporal["valid_to"], temporal["recorded_at"]))


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")
