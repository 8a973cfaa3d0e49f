"""Entity resolution: signatures, completeness, consolidation, similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lamina.functions import text as t
from lamina.operators import graph
from lamina.operators.ontology import IDENTITY_KEYS, OBSERVATIONS, TEMPORAL
from lamina.session import cut

#: Values that state nothing, in lower case (fixed values).
UNSTATED = ("", "none", "null")


def signature(cls: Column, props: Column, normal: bool = False) -> Column:
    """a class's identity values, trimmed, joined by bars, with ``normal`` in normal form; null where all are empty or the class has no keys."""
    keys = F.create_map(*[F.lit(x) if k == 0 else F.array(*map(F.lit, x)) for pair in IDENTITY_KEYS.items() for k, x in enumerate(pair)])[cls]

    def part(k: Column) -> Column:
        v = t.trim_all(F.coalesce(props[k], F.lit("")))
        v = F.when(F.lower(v).isin(*UNSTATED), "").otherwise(v)
        return t.normalize_name(v) if normal else v

    parts = F.transform(keys, part)
    return F.when(F.exists(parts, lambda p: p != ""), F.array_join(parts, "|"))


def signature_sql(wrap=str) -> str:
    """The same in SQL over node_class and properties; ``wrap`` puts each value's SQL in normal form."""
    def part(k: str) -> str:
        v = f"regexp_replace(coalesce(properties['{k}'], ''), '^\\s+|\\s+$', '', 'g')"
        return wrap(f"CASE WHEN lower({v}) IN ('', 'none', 'null') THEN '' ELSE {v} END")

    told = (f"WHEN '{c}' THEN CASE WHEN {' || '.join(map(part, ks))} <> '' THEN concat_ws('|', {', '.join(map(part, ks))}) END" for c, ks in IDENTITY_KEYS.items())
    return "CASE node_class " + " ".join(told) + " END"


SIGNATURE_SQL = signature_sql()


def stated(props: Column) -> Column:
    """Properties that aren't times and aren't empty."""
    return F.map_filter(props, lambda k, v: ~k.isin(*TEMPORAL) & (F.coalesce(v, F.lit("")) != ""))


def completeness(props: Column) -> Column:
    """A25."""
    return F.when(props.isNull(), 0).otherwise(F.size(stated(props)))


def consolidate(rows: DataFrame) -> DataFrame:
    """(stable_id, properties): of each entity every property from its best row, else from the first row that states it.

    Best: most stated properties, then the longest name, then the first. Only (entity, key)
    aggregates are shuffled, combined map-side, so a large entity stays small.
    """
    r = rows.filter("stable_id is not null").select("stable_id", "snap_id", stated(F.coalesce("properties", F.create_map().cast("map<string,string>"))).alias("p"), F.coalesce(F.length(F.col("properties")["name"]), F.lit(0)).alias("l"))
    order = F.struct(F.size("p").alias("f"), F.col("l"), (-F.col("snap_id")).alias("o"))
    best = r.groupBy("stable_id").agg(F.max_by("p", order).alias("best"))
    spread = r.select("stable_id", "snap_id", F.explode("p").alias("key", "value"))
    filled = spread.groupBy("stable_id", "key").agg(F.min_by("value", "snap_id").alias("value"))
    chosen = filled.join(best, "stable_id").select("stable_id", "key", F.coalesce(F.col("best")[F.col("key")], "value").alias("value"))
    return chosen.groupBy("stable_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("key", "value"))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("properties"))


def similar_pairs(vectors: DataFrame, threshold: float, block: int = 500) -> DataFrame:
    """(a, b, cosine) of pairs a < b of one label with a cosine of ``threshold`` or more.

    Each label's vectors are dealt to blocks of about ``block``; every pair of blocks meets
    once as two stacked matrices, so no task holds a whole label and all pairs are seen.
    """
    import numpy as np
    import pandas as pd

    v = vectors.select(F.col("vec_id"), "label", F.col("embedding"))
    sizes = v.groupBy("label").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = v.join(sizes, "label").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = met.select("vec_id", "embedding", "block", "label", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.stack(pdf.embedding.to_numpy()).astype(np.float64)
        m /= np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-300)
        ids, side, lo, hi = pdf.vec_id.to_numpy(), pdf.block.to_numpy(), pdf.lo.iloc[0], pdf.hi.iloc[0]
        x, y = (np.flatnonzero(side == lo), np.flatnonzero(side == hi)) if lo != hi else (np.arange(len(ids)),) * 2
        c = m[x] @ m[y].T
        i, j = np.nonzero(c >= threshold)
        a, b, s = ids[x[i]], ids[y[j]], c[i, j]
        keep = a < b if lo == hi else a != b
        return pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "cosine": np.round(s[keep], 4)})

    return cells.groupBy("label", "lo", "hi").applyInPandas(compare, "a bigint, b bigint, cosine double")


def resolve_graph(nodes: DataFrame, edges: DataFrame, anchors: DataFrame, confirmed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, class, props) and edges (seq, src, predicate, dst, valid_from, recorded_at) to resolved ones.

    Merged are nodes of equal identity (observations only where their titles agree too), entities
    whose identity agrees in normal form, and organisations that are an issuer's reviewed alias
    (anchors: name, ticker), which nothing else may merge; ``confirmed`` adds pairs (a, b) that an
    adjudicator accepted. Nodes keep the least number of their cluster; edges are carried over,
    loops dropped, and of one pair, predicate and year the first stays.
    """
    title = F.lower(F.coalesce(F.col("props")["title"], F.col("props")["name"], F.lit("")))
    told = cut(nodes.select("node", "class", signature(F.col("class"), F.col("props")).alias("sig"), signature(F.col("class"), F.col("props"), normal=True).alias("norm"), F.when(F.col("class").isin(*OBSERVATIONS), title).otherwise("").alias("title"), t.normalize_name(F.col("props")["name"]).alias("plain")))
    issuer = cut(told.filter(F.col("class") == "Organization").join(anchors.select(t.normalize_name(F.col("name")).alias("plain"), "ticker").distinct(), "plain").select("node", "ticker"))

    def stars(df: DataFrame, *keys: str) -> DataFrame:
        least = df.groupBy(*keys).agg(F.min("node").alias("a"))
        return df.join(least, list(keys)).select("a", F.col("node").alias("b"))

    free = told.join(issuer, "node", "left_anti").filter("sig is not null")
    pairs = stars(free, "class", "sig", "title").unionByName(stars(free.filter(~F.col("class").isin(*OBSERVATIONS)).filter("norm is not null"), "class", "norm")).unionByName(stars(issuer, "ticker"))
    if confirmed is not None:
        loose = confirmed.join(issuer.select(F.col("node").alias("a")), "a", "left_anti").join(issuer.select(F.col("node").alias("b")), "b", "left_anti")
        pairs = pairs.unionByName(loose.select("a", "b"))
    roots = cut(graph.components(cut(pairs.unionByName(nodes.select(F.col("node").alias("a"), F.col("node").alias("b"))))))
    merged = consolidate(nodes.join(roots, "node").select(F.col("root").cast("string").alias("stable_id"), F.col("node").alias("snap_id"), F.col("props").alias("properties")))
    clusters = nodes.join(roots, "node").groupBy(F.col("root").alias("node")).agg(F.min_by("class", "node").alias("class"), F.count("*").alias("members"))
    out = clusters.join(merged.withColumn("node", F.col("stable_id").cast("bigint")).drop("stable_id"), "node", "left").join(issuer.join(roots, "node").groupBy(F.col("root").alias("node")).agg(F.min("ticker").alias("ticker")), "node", "left")
    r = roots.select(F.col("node").alias("k"), "root")
    wired = edges.join(r.select(F.col("k").alias("src"), F.col("root").alias("s")), "src").join(r.select(F.col("k").alias("dst"), F.col("root").alias("d")), "dst").filter("s <> d")
    wired = wired.withColumn("year", t.year_of(F.col("valid_from"), F.col("recorded_at")))
    kept = graph.dedup_by_year(wired, ["s", "predicate", "d"], "seq").select("seq", F.col("s").alias("src"), "predicate", F.col("d").alias("dst"), "year")
    return out, kept
