"""Queries of the stages between triples and a loaded graph: repair, identity, resolution, versions; each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from lamina.functions import text as t
from lamina.operators import ontology, resolve, triples as tr
from lamina.plans import graphs
from lamina.sources.tables import table


def repaired(triples: DataFrame) -> DataFrame:
    """A stand-in for the model that repairs triples: (seq, answer, predicate, temporal). Every third one it gives up (a null
    answer); it sets unknown predicates right; and of the rest it fills the times of every second one."""
    i = F.col("seq")
    known = sorted({r[0] for r in ontology.rules()})
    right = F.when(F.col("predicate").isin(*known), F.col("predicate")).otherwise(F.create_map(*[F.lit(x) for k in tr.SAID.values() for x in (k[1], k[0])])[F.when(F.col("s_class") == "Organization", F.col("o_class")).otherwise(F.col("s_class"))])
    times = F.create_map(*[F.lit(x) for x in ("valid_from", "", "valid_to", "", "recorded_at", "")])
    return triples.select("seq", (i % 3 != 0).alias("answer"), right.alias("predicate"), F.when((i % 2 == 0) & F.col("temporal").isNull(), times).otherwise(F.col("temporal")).alias("temporal"))


def triple_repair(spark, folder):
    """Invalid triples go to the repairer in batches of 25 without their bookkeeping keys; its answers are put
    to them by position; no answer means unfixable, and only what is valid afterwards is kept."""
    x = tr.validate(graphs.events_as_triples(spark, folder)).filter(F.size("errors") > 0)
    batches = x.withColumns({"batch": F.floor(F.col("seq") / 25), "pos": F.col("seq") % 25, "s_props": tr.without_bookkeeping(F.map_concat("s_props", F.create_map(F.lit("_batch"), F.lit("b"))))})
    asked = repaired(batches.select("seq", "s_class", "o_class", "predicate", "temporal")).withColumns({"batch": F.floor(F.col("seq") / 25), "pos": F.col("seq") % 25}).drop("seq")
    j = batches.drop("predicate", "temporal", "fixed", "errors").join(asked, ["batch", "pos"], "left")
    again = tr.validate(j.filter("answer").select("seq", "s_class", "s_props", "predicate", "o_class", "o_props", "temporal"))
    kept = again.select("seq", F.when(F.size("errors") == 0, "kept").otherwise("still invalid").alias("state"))
    lost = j.filter(~F.coalesce("answer", F.lit(False))).select("seq", F.lit("unfixable").alias("state"))
    return kept.unionAll(lost)


REPAIR = f"""
WITH {graphs.TRIPLES}, bad AS (SELECT seq, timed FROM fix WHERE predicate NOT IN (SELECT label FROM rules) OR NOT timed)
SELECT seq, CASE WHEN seq % 3 = 0 THEN 'unfixable' WHEN timed OR seq % 2 = 0 THEN 'kept' ELSE 'still invalid' END AS state FROM bad"""


def page_partition(spark, folder):
    """V3: triples of pages valid or bugged: both ends with a class of the ontology and properties, and a known predicate; direction and times don't matter yet."""
    x = graphs.events_as_triples(spark, folder)
    x = x.withColumn("o_class", F.when(F.col("seq") % 31 == 0, "Thing").otherwise(F.col("o_class"))).withColumn("s_props", F.when(F.col("seq") % 37 != 0, F.col("s_props")))
    return x.select("seq", tr.page_valid().alias("valid"))


PARTITION = f"""
WITH {graphs.TRIPLES} SELECT seq, seq % 31 <> 0 AND seq % 37 <> 0 AND predicate IN (SELECT label FROM rules) AS valid FROM tri"""


def stable_ids(spark, folder):
    """each row's stable id (class and identity values, lower case) and the key of its version: of observations all
    properties, of entities the validity."""
    s = table(spark, folder, "entity_snapshots")
    return s.select("snap_id", F.md5(tr.stable_id(F.col("node_class"), F.col("properties"))).alias("entity"), F.md5(tr.version_key(F.col("node_class"), F.col("properties"))).alias("version"))


def _text(k: str) -> str:
    return f"CASE WHEN list_contains(map_keys(properties), '{k}') THEN coalesce(lower(trim(properties['{k}'], ' ')), 'None') ELSE '' END"


_IDS = "CASE node_class " + " ".join(f"WHEN '{c}' THEN concat_ws('|', '{c}', {', '.join(map(_text, ks))})" for c, ks in ontology.IDENTITY_KEYS.items()) + " END"
STABLE = f"""
WITH s AS (SELECT snap_id, node_class, properties, {_IDS} AS sid FROM entity_snapshots),
p AS (SELECT *, array_to_string(list_transform(list_sort(list_transform(map_entries(properties), lambda e: {{'k': e.key, 'v': coalesce(e.value, 'None')}})), lambda e: e.k || '=' || e.v), ';') AS p FROM s)
SELECT snap_id, md5(sid) AS entity, md5(CASE WHEN node_class IN ('KPIObservation', 'Emission', 'Waste', 'SustainabilityClaim', 'Controversy', 'Penalty', 'MediaReport', 'Investment', 'ThirdPartyVerification', 'ScienceBasedTarget', 'CarbonOffsetProject') THEN sid || '|' || p
  ELSE sid || '|' || CASE WHEN list_contains(map_keys(properties), 'valid_from') THEN coalesce(properties['valid_from'], 'None') ELSE '' END || '|' || CASE WHEN list_contains(map_keys(properties), 'valid_to') THEN coalesce(properties['valid_to'], 'None') ELSE '' END END) AS version FROM p"""


def primary_names(spark, folder):
    """each row's name: the first of name, term, title and claim_id that isn't empty."""
    s = table(spark, folder, "entity_snapshots")
    p = F.when(F.col("snap_id") % 5 == 0, F.map_concat(F.map_filter("properties", lambda k, _: k != "name"), F.create_map(F.lit("title"), F.concat(F.lit("t"), F.col("snap_id").cast("string"))))).otherwise(F.col("properties"))
    return s.select("snap_id", t.primary_name(p).alias("name"))


PRIMARY = "SELECT snap_id, CASE WHEN snap_id % 5 = 0 AND properties IS NOT NULL THEN coalesce(nullif(properties['term'], ''), 't' || snap_id) ELSE coalesce(nullif(properties['name'], ''), nullif(properties['term'], ''), nullif(properties['title'], ''), nullif(properties['claim_id'], ''), '') END AS name FROM entity_snapshots"


def _graph(spark, folder):
    """Rows of reports and harvested names as nodes, and edges from each to the next."""
    s = table(spark, folder, "entity_snapshots").select(F.col("snap_id").alias("node"), F.col("node_class").alias("class"), F.col("properties").alias("props"), F.date_format("recorded_at", "yyyy-MM-dd").alias("recorded_at"))
    a = table(spark, folder, "issuer_aliases").filter("alias_name is not null").select((-F.col("alias_id")).alias("node"), F.lit("Organization").alias("class"), F.create_map(F.lit("name"), F.col("alias_name")).alias("props"), F.lit("2020").alias("recorded_at"))
    nodes = s.unionByName(a)
    edges = nodes.select(F.col("node").alias("seq"), F.col("node").alias("src"), F.lit("listedWith").alias("predicate"), (F.col("node") + 1).alias("dst"), nodes["props"]["valid_from"].alias("valid_from"), "recorded_at")
    r = table(spark, folder, "issuer_registry")
    barred = r.select(F.explode("exclusions").alias("e")).select(t.normalize_name(F.col("e.name")).alias("plain")).distinct()
    known = r.select("ticker", F.explode(F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), F.array("canonical_name"))).alias("name")).withColumn("plain", t.normalize_name(F.col("name"))).filter("plain <> ''")
    return nodes, edges, known.join(barred, "plain", "left_anti").groupBy("plain").agg(F.min("ticker").alias("ticker"), F.min("name").alias("name")).select("name", "ticker")


def resolved_nodes(spark, folder):
    """Nodes merged by identity, by normal form and by the issuer's reviewed names; members and ticker of each."""
    nodes, edges, anchors = _graph(spark, folder)
    return resolve.resolve_graph(nodes, edges, anchors)[0].select("node", "class", "members", "ticker")


def resolved_edges(spark, folder):
    """Edges between merged nodes, loops dropped, the first of each pair, predicate and year."""
    nodes, edges, anchors = _graph(spark, folder)
    return resolve.resolve_graph(nodes, edges, anchors)[1].select("seq", "src", "dst", "year")


_CLUSTERS = f"""
WITH g AS (SELECT snap_id AS node, node_class, properties, strftime(recorded_at, '%Y-%m-%d') AS recorded_at FROM entity_snapshots
  UNION ALL SELECT -alias_id, 'Organization', MAP {{'name': alias_name}}, '2020' FROM issuer_aliases WHERE alias_name IS NOT NULL),
b AS (SELECT {graphs._normal_sql('e.name')} AS plain FROM (SELECT unnest(exclusions) AS e FROM issuer_registry)),
k AS (SELECT ticker, {graphs._normal_sql('n')} AS plain FROM (SELECT ticker, unnest(list_concat(coalesce(aliases, []), [canonical_name])) AS n FROM issuer_registry) WHERE n IS NOT NULL),
a AS (SELECT plain, min(ticker) AS ticker FROM k WHERE plain <> '' AND plain NOT IN (SELECT plain FROM b) GROUP BY 1),
s AS (SELECT node, node_class, properties, recorded_at, {resolve.SIGNATURE_SQL} AS sig, {resolve.signature_sql(graphs._normal_sql)} AS norm, {graphs._normal_sql("properties['name']")} AS plain FROM g),
c AS (SELECT s.*, a.ticker, CASE WHEN a.ticker IS NOT NULL THEN 'issuer ' || a.ticker WHEN sig IS NULL THEN 'node ' || node
  WHEN node_class IN ('KPIObservation', 'Emission', 'Waste', 'SustainabilityClaim', 'Controversy', 'Penalty', 'MediaReport', 'Investment', 'ThirdPartyVerification', 'ScienceBasedTarget', 'CarbonOffsetProject') THEN node_class || ' ' || sig || ' ' || lower(coalesce(properties['title'], properties['name'], ''))
  ELSE node_class || ' ' || coalesce('norm ' || norm, 'sig ' || sig) END AS cluster FROM s LEFT JOIN a ON node_class = 'Organization' AND a.plain = s.plain),
r AS (SELECT *, min(node) OVER (PARTITION BY cluster) AS root FROM c)"""
RESOLVED = _CLUSTERS + " SELECT root AS node, arg_min(node_class, node) AS class, count(*) AS members, min(ticker) AS ticker FROM r GROUP BY 1"
RESOLVED_EDGES = _CLUSTERS + """,
e AS (SELECT x.node AS seq, x.root AS src, y.root AS dst, coalesce(nullif(regexp_extract(x.properties['valid_from'], '[0-9]{4}', 0), ''), nullif(regexp_extract(x.recorded_at, '[0-9]{4}', 0), ''), '') AS year FROM r x JOIN r y ON y.node = x.node + 1 WHERE x.root <> y.root)
SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY src, dst, year ORDER BY seq) = 1"""


def payload_versions(spark, folder):
    """The nodes to load for classes that supersede themselves and have more than one distinct version:
    newest first by year key, none of them current, nulls empty, each linked from the newer one and the newest from the entity's head."""
    s = table(spark, folder, "entity_snapshots").filter(F.col("stable_id").isNotNull() & F.col("node_class").isin(*ontology.versioned_classes()))
    stored = F.transform_values(F.map_filter(F.coalesce("properties", F.create_map().cast("map<string,string>")), lambda k, _: k != "is_current"), lambda _, v: F.coalesce(v, F.lit("")))
    d = s.groupBy("stable_id", "node_class", tr.props_text(F.col("properties")).alias("state")).agg(F.min("snap_id").alias("snap_id"), F.min_by("properties", "snap_id").alias("properties"))
    d = d.withColumn("n", F.count("*").over(W.partitionBy("stable_id"))).filter("n > 1")
    since = F.coalesce(d["properties"]["valid_from"], F.lit(""))
    year = F.coalesce(F.regexp_extract(since, r"^\s*(\d{4})", 1).try_cast("int"), F.lit(-1))
    w = W.partitionBy("stable_id").orderBy(year.desc(), since.desc(), "snap_id")
    d = d.withColumn("j", F.row_number().over(w) - 1)
    key = lambda j: F.concat(F.lit("n"), F.col("stable_id"), F.lit("__v"), j.cast("string"))
    newer = F.when(F.col("j") == 0, F.concat(F.lit("n"), F.col("stable_id"))).otherwise(key(F.col("j") - 1))
    return d.select(key(F.col("j")).alias("node_key"), newer.alias("superseded_by"), t.safe_name(F.col("node_class")).alias("label"), F.md5(F.concat(tr.props_text(stored), F.lit(";is_current=false"))).alias("properties"))


_VERSIONED = ("Organization", "Facility", "Person", "Goal", "Standard", "Product", "Material", "Certification", "Regulation")
PAYLOAD_VERSIONS = f"""
WITH s AS (SELECT stable_id, node_class, snap_id, properties, array_to_string(list_transform(list_sort(list_transform(map_entries(properties), lambda e: {{'k': e.key, 'v': coalesce(e.value, 'None')}})), lambda e: e.k || '=' || e.v), ';') AS state
  FROM entity_snapshots WHERE stable_id IS NOT NULL AND node_class IN {_VERSIONED}),
d AS (SELECT stable_id, node_class, state, min(snap_id) AS snap_id, arg_min(properties, snap_id) AS properties FROM s GROUP BY ALL),
m AS (SELECT *, coalesce(properties['valid_from'], '') AS v FROM d QUALIFY count(*) OVER (PARTITION BY stable_id) > 1),
j AS (SELECT *, row_number() OVER (PARTITION BY stable_id ORDER BY coalesce(try_cast(nullif(regexp_extract(v, '^\\s*([0-9]{{4}})', 1), '') AS INT), -1) DESC, v DESC, snap_id) - 1 AS j FROM m)
SELECT 'n' || stable_id || '__v' || j AS node_key, CASE WHEN j = 0 THEN 'n' || stable_id ELSE 'n' || stable_id || '__v' || (j - 1) END AS superseded_by, node_class AS label,
  md5(array_to_string(list_transform(list_sort(list_transform(list_filter(coalesce(map_entries(properties), []), lambda e: e.key <> 'is_current'), lambda e: {{'k': e.key, 'v': coalesce(e.value, '')}})), lambda e: e.k || '=' || e.v), ';') || ';is_current=false') AS properties FROM j"""


def finish_gate(spark, folder):
    """Answers by why the model ended: only ends by itself, by its length or untold are taken; any other gives no indicators."""
    e = table(spark, folder, "events")
    reason = F.create_map(*[F.lit(x) for x in ("view", "STOP", "click", "MAX_TOKENS", "error", "SAFETY", "signup", "")])[F.col("event_type")]
    told = e.select(reason.alias("finish"), tr.accepted(reason).alias("accepted"))
    return told.groupBy("finish", "accepted").agg(F.count("*").alias("n"))


FINISH = """
WITH e AS (SELECT CASE event_type WHEN 'view' THEN 'STOP' WHEN 'click' THEN 'MAX_TOKENS' WHEN 'error' THEN 'SAFETY' WHEN 'signup' THEN '' END AS finish FROM events)
SELECT finish, finish IS NULL OR finish IN ('', 'STOP', 'MAX_TOKENS') AS accepted, count(*) AS n FROM e GROUP BY ALL"""


def document_scope(spark, folder):
    """Documents in the order they first appear: those whose name holds a text, all, the first three, the first one."""
    first = table(spark, folder, "sentences").groupBy(F.coalesce("source_pdf", F.lit("unknown.pdf")).alias("doc")).agg(F.min("seq").alias("seq"))
    parts = [("contains", first.filter(F.contains("doc", F.lit("2022")))), ("all", first), ("limit", first.orderBy("seq").limit(3)), ("first", first.orderBy("seq").limit(1))]
    out = None
    for name, d in parts:
        d = d.select(F.lit(name).alias("scope"), "doc")
        out = d if out is None else out.unionAll(d)
    return out


DOCUMENT_SCOPE = """
WITH f AS (SELECT coalesce(source_pdf, 'unknown.pdf') AS doc, min(seq) AS seq FROM sentences GROUP BY 1)
SELECT 'contains' AS scope, doc FROM f WHERE contains(doc, '2022') UNION ALL SELECT 'all', doc FROM f UNION ALL SELECT 'limit', doc FROM (SELECT doc FROM f ORDER BY seq LIMIT 3) UNION ALL SELECT 'first', doc FROM (SELECT doc FROM f ORDER BY seq LIMIT 1)"""


def extension_counts(spark, folder):
    """Distinct files by the extension of their names."""
    s = table(spark, folder, "sentences").select("source_pdf").union(table(spark, folder, "page_texts").select(F.concat("doc", F.lit(".TXT")))).filter("source_pdf is not null").distinct()
    return s.groupBy(t.extension(F.col("source_pdf")).alias("extension")).agg(F.count("*").alias("n"))


EXTENSIONS = r"""
WITH s AS (SELECT source_pdf AS f FROM sentences UNION SELECT doc || '.TXT' FROM page_texts)
SELECT CASE WHEN strpos(f, '.') > 0 THEN '.' || lower(string_split(f, '.')[-1]) ELSE '' END AS extension, count(*) AS n FROM s WHERE f IS NOT NULL GROUP BY 1"""

QUERIES = {
    "triple_repair": (triple_repair, REPAIR), "page_partition": (page_partition, PARTITION), "stable_ids": (stable_ids, STABLE), "primary_names": (primary_names, PRIMARY), "resolved_nodes": (resolved_nodes, RESOLVED),
    "resolved_edges": (resolved_edges, RESOLVED_EDGES), "payload_versions": (payload_versions, PAYLOAD_VERSIONS), "finish_gate": (finish_gate, FINISH), "document_scope": (document_scope, DOCUMENT_SCOPE), "extension_counts": (extension_counts, EXTENSIONS),
}
