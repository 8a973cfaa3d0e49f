"""Queries over triples, graphs, versions and registries, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from lamina.functions import text as t
from lamina.operators import graph, history, ontology, resolve, triples as tr
from lamina.sources.tables import table


def _rules() -> str:
    return "rules(label, src, dst) AS (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in ontology.rules()) + ")"


def _case(k: int) -> str:
    return "CASE event_type " + " ".join(f"WHEN '{a}' THEN '{v[k]}'" for a, v in tr.SAID.items()) + " END"


TRIPLES = f"""ev AS (SELECT event_id AS seq, event_id % 10 = 0 AS turned, CASE WHEN event_id % 23 = 0 THEN 'knows' ELSE {_case(0)} END AS predicate, {_case(1)} AS cls,
  strftime(ts, '%Y-%m-%d') AS d, 'is_current=true;name=user_' || user_id || ';valid_from=' || strftime(ts, '%Y-%m-%d') || ';valid_to=None' AS org,
  'id=' || event_type || '_' || (event_id % 50) || ';is_current=true;valid_from=' || strftime(ts, '%Y-%m-%d') || ';valid_to=None' AS oth,
  event_id % 17 <> 0 AS timed, strftime(ts, '%Y-%m-%d %H:%M:%S') AS rec FROM events),
tri AS (SELECT seq, predicate, timed, d, rec, CASE WHEN turned THEN cls ELSE 'Organization' END AS s_class, CASE WHEN turned THEN oth ELSE org END AS s_text,
  CASE WHEN turned THEN 'Organization' ELSE cls END AS o_class, CASE WHEN turned THEN org ELSE oth END AS o_text FROM ev),
{_rules()},
fix AS (SELECT t.*, f.label IS NULL AND r.label IS NOT NULL AS fixed FROM tri t LEFT JOIN rules f ON f.label = t.predicate AND f.src = t.s_class AND f.dst = t.o_class
  LEFT JOIN rules r ON r.label = t.predicate AND r.dst = t.s_class AND r.src = t.o_class)"""


def events_as_triples(spark, folder):
    return tr.from_events(table(spark, folder, "events"))


def greenwash_candidates(spark, folder):
    """Claims of a user and day that nothing verifies and something contradicts."""
    e = table(spark, folder, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    of = lambda k: e.filter(F.col("event_type") == k).select("user_id", "day")
    claims = of("view").groupBy("user_id", "day").agg(F.count("*").alias("n_claims"))
    return graph.unsupported_claims(claims, of("purchase").distinct(), of("error").distinct(), ["user_id", "day"])


GREENWASH = """
WITH e AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_type FROM events)
SELECT user_id, day, count(*) AS n_claims FROM e WHERE event_type = 'view' AND (user_id, day) NOT IN (SELECT (user_id, day) FROM e WHERE event_type = 'purchase')
  AND (user_id, day) IN (SELECT (user_id, day) FROM e WHERE event_type = 'error') GROUP BY ALL"""


def triple_direction_fix(spark, folder):
    """V1, J8."""
    return tr.fix_direction(events_as_triples(spark, folder)).select("seq", "s_class", "predicate", "o_class", "fixed")


DIRECTION = f"WITH {TRIPLES} SELECT seq, CASE WHEN fixed THEN o_class ELSE s_class END AS s_class, predicate, CASE WHEN fixed THEN s_class ELSE o_class END AS o_class, fixed FROM fix"


def triple_validation_errors(spark, folder):
    """V2."""
    return tr.validate(events_as_triples(spark, folder)).filter(F.size("errors") > 0).select("seq", F.array_join("errors", "; ").alias("errors"))


ERRORS = f"""WITH {TRIPLES},
d AS (SELECT seq, predicate, timed, CASE WHEN fixed THEN o_class ELSE s_class END AS s, CASE WHEN fixed THEN s_class ELSE o_class END AS o FROM fix),
e AS (SELECT seq, concat_ws('; ', CASE WHEN predicate NOT IN (SELECT label FROM rules) THEN 'unknown predicate ' || predicate END,
  CASE WHEN predicate IN (SELECT label FROM rules) AND (predicate, s, o) NOT IN (SELECT (label, src, dst) FROM rules) THEN 'illegal direction ' || s || ' -> ' || o END,
  CASE WHEN NOT timed THEN 'times missing' END) AS errors FROM d)
SELECT * FROM e WHERE errors <> ''"""


def validation_stats(spark, folder):
    """Totals, fixed, valid and invalid, with the rate."""
    v = tr.validate(events_as_triples(spark, folder))
    ok = (F.size("errors") == 0).cast("bigint")
    return v.agg(F.count("*").alias("total"), F.sum(F.col("fixed").cast("bigint")).alias("direction_fixed"), F.sum(ok).alias("valid"), F.sum(1 - ok).alias("invalid"), F.round(F.try_divide(F.sum(ok), F.count("*")), 4).alias("rate"))


STATS = ERRORS.replace("SELECT * FROM e WHERE errors <> ''", """SELECT count(*) AS total, (SELECT count(*) FROM fix WHERE fixed) AS direction_fixed, count(*) FILTER (errors = '') AS valid,
  count(*) FILTER (errors <> '') AS invalid, round(count(*) FILTER (errors = '') / count(*), 4) AS rate FROM e""")


def graph_nodes(spark, folder):
    """Nodes by class and properties, named by their first place."""
    return tr.nodes(events_as_triples(spark, folder))


NODES = f"""WITH {TRIPLES}, n AS (SELECT seq * 2 AS seq, s_class AS class, s_text AS props FROM tri UNION ALL SELECT seq * 2 + 1, o_class, o_text FROM tri)
SELECT class, props, min(seq) AS node FROM n GROUP BY ALL"""


def graph_edges(spark, folder):
    """Edges between nodes with their keys."""
    x = events_as_triples(spark, folder)
    e = tr.edges(x, tr.nodes(x))
    return e.select("seq", "src", "predicate", "dst", tr.edge_key(F.col("src"), F.col("predicate"), F.col("dst"), F.col("temporal")).alias("edge_key"))


EDGES = NODES.replace("SELECT class, props, min(seq) AS node FROM n GROUP BY ALL", "") + """, k AS (SELECT class, props, min(seq) AS node FROM n GROUP BY ALL)
SELECT t.seq, s.node AS src, predicate, o.node AS dst, sha1(concat_ws('|', s.node::VARCHAR, predicate, o.node::VARCHAR, CASE WHEN timed THEN d ELSE 'None' END, 'None', CASE WHEN timed THEN rec ELSE 'None' END)) AS edge_key
FROM tri t JOIN k s ON s.class = t.s_class AND s.props = t.s_text JOIN k o ON o.class = t.o_class AND o.props = t.o_text"""


def triples_roundtrip(spark, folder):
    """Triples to a graph and back; every triple returns."""
    x = events_as_triples(spark, folder)
    n = tr.nodes(x)
    s, o = (n.select(F.col("node").alias(k), F.col("class").alias(f"{k}_class"), F.col("props").alias(f"{k}_props")) for k in ("src", "dst"))
    return tr.edges(x, n).join(s, "src").join(o, "dst").select("seq", "src_class", "src_props", "predicate", "dst_class", "dst_props")


ROUNDTRIP = f"WITH {TRIPLES} SELECT seq, s_class AS src_class, s_text AS src_props, predicate, o_class AS dst_class, o_text AS dst_props FROM tri"


def stage_partition(spark, folder):
    """Triples by predicate, well formed or not, and whether they tell an observation."""
    x = events_as_triples(spark, folder)
    known = F.col("predicate").isin(*sorted({r[0] for r in ontology.rules()}))
    observed = F.col("o_class").isin("KPIObservation", "Emission", "Waste") | F.col("s_class").isin("KPIObservation", "Emission", "Waste")
    return x.groupBy("predicate", known.alias("known"), observed.alias("observation")).agg(F.count("*").alias("n"), F.countDistinct("s_class").alias("subject_classes"))


STAGE = f"""WITH {TRIPLES} SELECT predicate, predicate IN (SELECT label FROM rules) AS known, o_class IN ('KPIObservation', 'Emission', 'Waste') OR s_class IN ('KPIObservation', 'Emission', 'Waste') AS observation,
  count(*) AS n, count(DISTINCT s_class) AS subject_classes FROM tri GROUP BY ALL"""


def identity_merge(spark, folder):
    """Entities by class and identity signature, with what merging saves."""
    s = table(spark, folder, "entity_snapshots")
    sig = resolve.signature(F.col("node_class"), F.col("properties"))
    return s.select("node_class", sig.alias("signature")).filter("signature is not null").groupBy("node_class", "signature").agg(F.count("*").alias("n"))


IDENTITY = "WITH " + """s AS (SELECT node_class, """ + resolve.SIGNATURE_SQL + """ AS signature FROM entity_snapshots)
SELECT node_class, signature, count(*) AS n FROM s WHERE signature IS NOT NULL GROUP BY ALL"""


def resolution_stage_counts(spark, folder):
    """Nodes before and after merging by signature, per class, with the reduction in percent."""
    s = table(spark, folder, "entity_snapshots")
    sig = F.coalesce(resolve.signature(F.col("node_class"), F.col("properties")), F.concat(F.lit("#"), F.col("snap_id").cast("string")))
    return s.groupBy("node_class").agg(F.count("*").alias("raw"), F.countDistinct(sig).alias("merged")).withColumn("reduction_pct", F.round((1 - F.col("merged") / F.col("raw")) * 100, 1))


RESOLUTION = "WITH s AS (SELECT node_class, snap_id, " + resolve.SIGNATURE_SQL + """ AS signature FROM entity_snapshots),
c AS (SELECT node_class, count(*) AS raw, count(DISTINCT coalesce(signature, '#' || snap_id)) AS merged FROM s GROUP BY 1) SELECT *, round((1 - merged / raw) * 100, 1) AS reduction_pct FROM c"""


def cluster_rep(spark, folder):
    """Of each entity the row with most stated properties, the first of equal ones."""
    s = table(spark, folder, "entity_snapshots").withColumn("full", resolve.completeness(F.col("properties")))
    return s.filter("stable_id is not null").groupBy("stable_id").agg(F.max_by("snap_id", F.struct("full", (-F.col("snap_id")).alias("o"))).alias("rep"), F.max("full").alias("completeness"), F.count("*").alias("members"))


CLUSTER_REP = """
WITH s AS (SELECT stable_id, snap_id, len(list_filter(map_entries(properties), lambda e: e.key NOT IN ('valid_from', 'valid_to', 'is_current') AND coalesce(e.value, '') <> '')) AS f FROM entity_snapshots WHERE stable_id IS NOT NULL)
SELECT stable_id, arg_max(snap_id, (coalesce(f, 0), -snap_id)) AS rep, max(coalesce(f, 0))::INT AS completeness, count(*) AS members FROM s GROUP BY 1"""


def consolidate_nodes(spark, folder):
    """Each entity's properties, the best row's first and what it lacks from the others in order."""
    return resolve.consolidate(table(spark, folder, "entity_snapshots"))


CONSOLIDATE = """
WITH s AS (SELECT stable_id, snap_id, properties, coalesce(len(list_filter(map_entries(properties), lambda e: e.key NOT IN ('valid_from', 'valid_to', 'is_current') AND coalesce(e.value, '') <> '')), 0) AS f, coalesce(length(properties['name']), 0) AS l
  FROM entity_snapshots WHERE stable_id IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY stable_id ORDER BY f DESC, l DESC, snap_id) AS k FROM s),
e AS (SELECT stable_id, k, snap_id, unnest(map_entries(properties)) AS e FROM r),
b AS (SELECT stable_id, e.key AS key, arg_min(e.value, CASE WHEN k = 1 THEN -1 ELSE snap_id END) AS value FROM e WHERE e.key NOT IN ('valid_from', 'valid_to', 'is_current') AND e.value <> '' GROUP BY ALL)
SELECT stable_id, string_agg(key || '=' || value, ';' ORDER BY key) AS properties FROM b GROUP BY 1"""


def payload_nodes(spark, folder):
    """Nodes to load: key, label, current row by year; older versions only for classes with a chain."""
    s = table(spark, folder, "entity_snapshots").filter("stable_id is not null")
    year = F.coalesce(F.regexp_extract(s["properties"]["valid_from"], r"^(\d{4})", 1).try_cast("int"), F.lit(-1))
    g = s.groupBy("stable_id", "node_class").agg(F.max_by("snap_id", F.struct(year.alias("y"), F.coalesce(s["properties"]["valid_from"], F.lit("")).alias("v"), (-F.col("snap_id")).alias("o"))).alias("current"), F.countDistinct(tr.props_text(F.col("properties"))).alias("states"))
    return g.select("stable_id", t.safe_name(F.col("node_class")).alias("label"), "current", "states", (F.col("node_class").isin(*ontology.versioned_classes()) & (F.col("states") > 1)).alias("chained"))


PAYLOAD = f"""
WITH s AS (SELECT stable_id, node_class, snap_id, coalesce(try_cast(nullif(regexp_extract(properties['valid_from'], '^([0-9]{{4}})', 1), '') AS INT), -1) AS y, coalesce(properties['valid_from'], '') AS v,
  array_to_string(list_transform(list_sort(list_transform(map_entries(properties), lambda e: {{'k': e.key, 'v': coalesce(e.value, 'None')}})), lambda e: e.k || '=' || e.v), ';') AS p FROM entity_snapshots WHERE stable_id IS NOT NULL),
g AS (SELECT stable_id, node_class, arg_max(snap_id, (y, v, -snap_id)) AS current, count(DISTINCT p) AS states FROM s GROUP BY ALL)
SELECT stable_id, regexp_replace(node_class, '[^A-Za-z0-9_]', '_', 'g') AS label, current, states, node_class IN ({", ".join(f"'{c}'" for c in ontology.versioned_classes())}) AND states > 1 AS chained FROM g"""


def node_versions(spark, folder):
    """Distinct versions of each entity by dates and name, where there is more than one."""
    s = table(spark, folder, "entity_snapshots").filter("stable_id is not null")
    p = s["properties"]
    v = s.groupBy("stable_id", *[F.coalesce(p[k], F.lit("")).alias(k) for k in ("valid_from", "valid_to", "name")]).agg(F.min("snap_id").alias("snap_id"))
    return v.withColumn("versions", F.count("*").over(W.partitionBy("stable_id"))).filter("versions > 1")


NODE_VERSIONS = """
WITH v AS (SELECT stable_id, coalesce(properties['valid_from'], '') AS valid_from, coalesce(properties['valid_to'], '') AS valid_to, coalesce(properties['name'], '') AS name, min(snap_id) AS snap_id FROM entity_snapshots WHERE stable_id IS NOT NULL GROUP BY ALL)
SELECT *, count(*) OVER (PARTITION BY stable_id) AS versions FROM v QUALIFY versions > 1"""


def embedding_text(spark, folder):
    """Entities as one text, properties in order of their keys."""
    s = table(spark, folder, "entity_snapshots")
    kept = F.filter(F.array_sort(F.map_entries("properties")), lambda e: ~e["key"].isin(*ontology.TEMPORAL) & (F.coalesce(e["value"], F.lit("")) != ""))
    return s.select("snap_id", F.concat(F.lit("Type: "), F.col("node_class"), F.lit(". "), F.array_join(F.transform(kept, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), ", ")).alias("told"))


EMBEDDING_TEXT = """
SELECT snap_id, 'Type: ' || node_class || '. ' || array_to_string(list_transform(list_sort(list_filter(list_transform(map_entries(properties), lambda e: {'k': e.key, 'v': e.value}), lambda e: e.k NOT IN ('valid_from', 'valid_to', 'is_current') AND coalesce(e.v, '') <> '')), lambda e: e.k || ': ' || e.v), ', ') AS told FROM entity_snapshots"""


def connected_components(spark, folder):
    """Orders and parts joined by large items, by least member."""
    e = table(spark, folder, "lineitem").filter("l_quantity >= 49").select((F.col("l_orderkey") * 2).alias("a"), (F.col("l_partkey") * 2 + 1).alias("b"))
    c = graph.components(e)
    return c.groupBy("root").agg(F.count("*").alias("members"))


COMPONENTS = """
WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey * 2 AS a, l_partkey * 2 + 1 AS b FROM lineitem WHERE l_quantity >= 49), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, root) AS (SELECT a, a FROM s UNION SELECT s.b, r.root FROM r JOIN s ON s.a = r.node WHERE r.root < s.b),
m AS (SELECT node, min(root) AS root FROM r GROUP BY 1) SELECT root, count(*) AS members FROM m GROUP BY 1"""

ORDERS = "o AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders)"


def _orders(spark, folder):
    return table(spark, folder, "orders").withColumn("d", F.date_format("o_orderdate", "yyyy-MM-dd")).withColumn("year", t.year_of(F.date_format("o_orderdate", "yyyy-MM-dd")))


def edge_year_dedup(spark, folder):
    """Of the edges of one pair, kind and year the first."""
    return graph.dedup_by_year(_orders(spark, folder), ["o_custkey", "o_orderstatus", "o_orderpriority"], "o_orderkey").select("o_orderkey", "year")


EDGE_YEAR = f"WITH {ORDERS} SELECT o_orderkey, substr(d, 1, 4) AS year FROM o QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus, o_orderpriority, substr(d, 1, 4) ORDER BY o_orderkey) = 1"


def version_chain(spark, folder):
    """Each customer's orders as versions, newest first, linked from the newer one."""
    v = _orders(spark, folder).withColumn("version", F.concat(F.lit("n"), F.col("o_custkey").cast("string"), F.lit("__v"), F.col("o_orderkey").cast("string")))
    return graph.version_chain(v, "o_custkey", [F.desc("year"), F.desc("d"), F.col("o_orderkey")]).select("o_custkey", "version", "newer", "place")


CHAIN = f"""WITH {ORDERS}, v AS (SELECT *, 'n' || o_custkey || '__v' || o_orderkey AS version FROM o)
SELECT o_custkey, version, coalesce(lag(version) OVER w, 'n' || o_custkey) AS newer, (row_number() OVER w)::INT AS place FROM v WINDOW w AS (PARTITION BY o_custkey ORDER BY substr(d, 1, 4) DESC, d DESC, o_orderkey)"""


def supersedes_path(spark, folder):
    """How many versions lie behind each one: the longest path of supersedes edges."""
    v = _orders(spark, folder)
    w = W.partitionBy("o_custkey").orderBy(F.desc("d"), "o_orderkey")
    return v.select("o_custkey", "o_orderkey", (F.count("*").over(W.partitionBy("o_custkey")) - F.row_number().over(w)).alias("behind"))


PATH = """
WITH RECURSIVE v AS (SELECT o_custkey, o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate::DATE DESC, o_orderkey) AS older FROM orders),
p(o_custkey, o_orderkey, behind) AS (SELECT o_custkey, o_orderkey, 0 FROM v WHERE older IS NULL UNION ALL SELECT v.o_custkey, v.o_orderkey, p.behind + 1 FROM v JOIN p ON v.older = p.o_orderkey AND v.o_custkey = p.o_custkey)
SELECT o_custkey, o_orderkey, behind::BIGINT AS behind FROM p"""


def bitemporal_asof(spark, folder):
    """J21, ST6: items valid at mid-1997 as known at its end: valid from the order, recorded when shipped, closed after a year."""
    o, l = _orders(spark, folder), table(spark, folder, "lineitem")
    j = l.join(o, l["l_orderkey"] == o["o_orderkey"])
    valid = graph.valid_at(F.col("o_orderdate"), F.when(F.col("o_orderstatus") == "F", F.expr("o_orderdate + interval 1 year")), F.col("l_shipdate"), F.lit("1997-07-01 00:00:00").cast("timestamp_ntz"), F.lit("1997-12-31 23:59:59").cast("timestamp_ntz"))
    return j.filter(valid).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"))


ASOF = """
SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WHERE o_orderdate <= TIMESTAMP '1997-07-01' AND (o_orderstatus <> 'F' OR TIMESTAMP '1997-07-01' < o_orderdate + INTERVAL 1 YEAR) AND l_shipdate <= TIMESTAMP '1997-12-31 23:59:59' GROUP BY 1"""


def edge_rewire(spark, folder):
    """Edges carried over to merged nodes (customers of one nation and segment), loops dropped, first of equal ones."""
    c = table(spark, folder, "customer")
    root = c.withColumn("root", F.min("c_custkey").over(W.partitionBy("c_nationkey", "c_mktsegment"))).select("c_custkey", "root")
    e = table(spark, folder, "orders").select("o_orderkey", F.col("o_custkey").alias("a"))
    near = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_suppkey").alias("b"))  # the customer numbered like the order's least supplier
    e = e.join(near, "o_orderkey")
    j = e.join(root.select(F.col("c_custkey").alias("a"), F.col("root").alias("src")), "a").join(root.select(F.col("c_custkey").alias("b"), F.col("root").alias("dst")), "b")
    return j.filter("src <> dst").groupBy("src", "dst").agg(F.min("o_orderkey").alias("first_edge"), F.count("*").alias("n"))


REWIRE = """
WITH r AS (SELECT c_custkey, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS root FROM customer)
SELECT s.root AS src, d.root AS dst, min(o_orderkey) AS first_edge, count(*) AS n FROM orders JOIN (SELECT l_orderkey, min(l_suppkey) AS b FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey JOIN r s ON s.c_custkey = o_custkey JOIN r d ON d.c_custkey = b WHERE s.root <> d.root GROUP BY ALL"""


def multi_hop(spark, folder):
    """Item to order to customer to nation to region."""
    l, o, c, n, r = (table(spark, folder, x) for x in ("lineitem", "orders", "customer", "nation", "region"))
    j = l.join(o, l["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return j.groupBy("r_name", "c_mktsegment").agg(F.count("*").alias("items"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("value"), F.countDistinct("c_custkey").alias("customers"))


HOPS = """
SELECT r_name, c_mktsegment, count(*) AS items, round(sum(l_extendedprice * (1 - l_discount)), 2) AS value, count(DISTINCT c_custkey) AS customers
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL"""


def ffill(spark, folder):
    """Merged cells of the company book filled from above, tickers typed alike, the first row of each."""
    c = table(spark, folder, "companies")
    down = W.orderBy("seq").rowsBetween(W.unboundedPreceding, 0)  # the book has some hundred rows
    f = c.withColumn("sector", F.last("sector", True).over(down)).withColumn("ticker", F.upper(F.trim("ticker"))).filter("ticker <> ''")
    return f.groupBy("ticker").agg(F.min_by(F.struct("full_name", "sector", "seq"), "seq").alias("r")).select("ticker", "r.*")


FFILL = """
WITH c AS (SELECT seq, upper(trim(ticker, ' ')) AS ticker, full_name, last_value(sector IGNORE NULLS) OVER (ORDER BY seq) AS sector FROM companies)
SELECT ticker, full_name, sector, seq FROM c WHERE ticker <> '' QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY seq) = 1"""


def dup_numbering(spark, folder):
    """Equal paths, case aside, numbered _v2, _v3 and so on."""
    p = table(spark, folder, "part").withColumn("path", F.concat_ws("/", F.lower("p_brand"), t.file_name(F.lower("p_type"))))
    n = F.row_number().over(W.partitionBy("path").orderBy("p_partkey"))
    return p.select("p_partkey", F.concat("path", F.when(n > 1, F.concat(F.lit("_v"), n.cast("string"))).otherwise("")).alias("target"))


DUPS = r"""
WITH p AS (SELECT p_partkey, lower(p_brand) || '/' || trim(regexp_replace(lower(p_type), '[\\/:*?"<>|\n\r\t]+', '_', 'g'), ' ') AS path FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY p_partkey) AS n FROM p)
SELECT p_partkey, path || CASE WHEN n > 1 THEN '_v' || n ELSE '' END AS target FROM n"""


def set_ops(spark, folder):
    """Customers with finished orders, with open ones, with both, with neither."""
    o, c = table(spark, folder, "orders"), table(spark, folder, "customer")
    f, p = (o.filter(F.col("o_orderstatus") == s).select("o_custkey").distinct() for s in "FO")
    every = c.select(F.col("c_custkey").alias("o_custkey"))
    parts = [("both", f.intersect(p)), ("finished only", f.exceptAll(p)), ("open only", p.exceptAll(f)), ("neither", every.join(f.union(p), "o_custkey", "left_anti"))]
    out = None
    for name, d in parts:
        d = d.select(F.lit(name).alias("part"), "o_custkey")
        out = d if out is None else out.unionByName(d)
    return out


SETS = """
WITH f AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F'), p AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O')
SELECT 'both' AS part, o_custkey FROM (SELECT * FROM f INTERSECT SELECT * FROM p) UNION ALL SELECT 'finished only', o_custkey FROM (SELECT * FROM f EXCEPT SELECT * FROM p)
UNION ALL SELECT 'open only', o_custkey FROM (SELECT * FROM p EXCEPT SELECT * FROM f) UNION ALL SELECT 'neither', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM f UNION SELECT o_custkey FROM p)"""


def dense_ids(spark, folder):
    """Customers numbered by their first order, within the year they came; no global order is needed."""
    o = _orders(spark, folder)
    first = o.groupBy("o_custkey").agg(F.min(F.struct("year", "o_orderkey")).alias("f"))
    return first.select("o_custkey", "f.year", F.row_number().over(W.partitionBy("f.year").orderBy("f.o_orderkey")).alias("number"))


DENSE = f"""WITH {ORDERS}, f AS (SELECT o_custkey, min((substr(d, 1, 4), o_orderkey)) AS f FROM o GROUP BY 1)
SELECT o_custkey, f[1] AS year, (row_number() OVER (PARTITION BY f[1] ORDER BY f[2]))::INT AS number FROM f"""


def rate_window(spark, folder):
    """Each user's events in the 60 seconds up to each one."""
    e = table(spark, folder, "events").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")))
    w = W.partitionBy("user_id").orderBy("s").rangeBetween(-60_000_000, 0)
    return e.select("event_id", F.count("*").over(w).alias("n"))


RATE = "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) AS n FROM events"


def resume_antijoin(spark, folder):
    """Orders without a shipped item up to 1997: the work still to do."""
    o, l = table(spark, folder, "orders"), table(spark, folder, "lineitem").filter("l_shipdate < timestamp'1997-01-01'")
    return o.join(l, o["o_orderkey"] == l["l_orderkey"], "left_anti").select("o_orderkey")


RESUME = "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01')"


def positional_join(spark, folder):
    """Each event with the repaired one of its batch of 25 and place."""
    e = table(spark, folder, "events")
    b = e.select(F.floor(F.col("event_id") / 25).alias("batch"), (F.col("event_id") % 25).alias("pos"), "event_id", "event_type")
    fixed = b.filter("event_type <> 'error'").select("batch", "pos", F.upper("event_type").alias("repaired"))
    return b.join(fixed, ["batch", "pos"], "left").select("event_id", "batch", "pos", "repaired")


POSITION = "SELECT event_id, event_id // 25 AS batch, event_id % 25 AS pos, CASE WHEN event_type <> 'error' THEN upper(event_type) END AS repaired FROM events"


def kpi_normalize(spark, folder):
    """values of events as texts, some with a percent sign, some with a unit, some no numbers; years as texts."""
    e, i = table(spark, folder, "events"), F.col("event_id") % 4
    raw = F.when(i == 0, F.concat(F.round("value", 2).cast("string"), F.lit("%"))).when(i == 1, F.lit("n/a")).when(i == 2, F.lit("about 5%")).otherwise(F.get_json_object("props", "$.k"))
    unit, year = F.when(F.col("event_id") % 3 == 0, "ratio").when(F.col("event_id") % 3 == 1, ""), F.when(F.col("event_id") % 5 == 0, "FY24").otherwise(F.date_format("ts", "yyyy"))
    told = e.select("event_id", t.kpi_value(raw, unit).alias("v"), t.year_value(year).alias("year"))
    return told.select("event_id", F.round("v.number", 4).alias("number"), "v.text", "v.unit", "year")


KPI = """
WITH e AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN round(value, 2)::VARCHAR || '%' WHEN 1 THEN 'n/a' WHEN 2 THEN 'about 5%' ELSE props::JSON ->> '$.k' END AS raw,
  CASE event_id % 3 WHEN 0 THEN 'ratio' WHEN 1 THEN '' END AS unit, CASE WHEN event_id % 5 = 0 THEN 'FY24' ELSE strftime(ts, '%Y') END AS y FROM events),
n AS (SELECT *, suffix(raw, '%') AS pct, try_cast(rtrim(raw, '%') AS DOUBLE) AS number FROM e)
SELECT event_id, round(number, 4) AS number, CASE WHEN number IS NULL THEN raw END AS text, CASE WHEN pct THEN coalesce(nullif(unit, ''), '%') ELSE unit END AS unit, CASE WHEN regexp_full_match(y, '[0-9]+') THEN y::INT END AS year FROM n"""


def json_recovery(spark, folder):
    """props wrapped in fences, comments and trailing commas, read again."""
    e = table(spark, folder, "events")
    dirty = F.concat(F.lit("Here it is:\n```json\n"), F.regexp_replace("props", r"\}$", ', "u": "https://a.example/b", }'), F.lit(" // done\n```"))
    return e.select("event_id", F.get_json_object(t.recover_json(dirty), "$.k").alias("k"), F.get_json_object(t.recover_json(dirty), "$.u").alias("u"))


JSONS = "SELECT event_id, props::JSON ->> '$.k' AS k, 'https://a.example/b' AS u FROM events"


def normalize_name(spark, folder):
    """harvested names in normal form, counted."""
    a = table(spark, folder, "issuer_aliases").filter("alias_name is not null")
    return a.groupBy(t.normalize_name(F.col("alias_name")).alias("name")).agg(F.count("*").alias("n"))


def _normal_sql(c: str) -> str:
    """F1 in SQL, its lists spelt out apart from the Spark side's."""
    forms = "['cong ty trach nhiem huu han', 'joint stock company', 'cong ty co phan', 'tong cong ty', 'cong ty tnhh', 'joint stock', 'corporation', 'cong ty cp', 'tap doan', 'cong ty', 'company', 'co ltd', 'j s c', 'ctcp', 'tnhh', 'ltd', 'jsc', 'plc', 'inc']"
    plain = f"' ' || trim(regexp_replace(strip_accents(lower(replace(replace(replace(replace({c}, 'Ƣ', 'U'), 'ƣ', 'u'), 'Đ', 'd'), 'đ', 'd'))), '[^a-z0-9]+', ' ', 'g'), ' ') || ' '"
    bare = f"list_reduce(list_prepend({plain}, {forms}), lambda x, f: replace(x, ' ' || f || ' ', ' '))"
    return f"trim(regexp_replace(replace(replace({bare}, ' green ', ' xanh '), ' plastics ', ' plastic '), ' +', ' ', 'g'), ' ')"


NORMAL = f"SELECT {_normal_sql('alias_name')} AS name, count(*) AS n FROM issuer_aliases WHERE alias_name IS NOT NULL GROUP BY 1"


def issuer_anchor(spark, folder):
    """Harvested names that are a reviewed alias in normal form and nobody's exclusion."""
    r = table(spark, folder, "issuer_registry")
    known = r.select("ticker", F.explode(F.array_union(F.coalesce("aliases", F.array().cast("array<string>")), F.array("canonical_name"))).alias("a")).select("ticker", t.normalize_name(F.col("a")).alias("name")).filter("name <> ''").distinct()
    barred = r.select(F.explode("exclusions").alias("e")).select(t.normalize_name(F.col("e.name")).alias("name")).distinct()
    index = known.join(barred, "name", "left_anti")  # a reviewed list of a hundred issuers
    return table(spark, folder, "issuer_aliases").withColumn("name", t.normalize_name(F.col("alias_name"))).join(index, "name").select("alias_id", "ticker")


ANCHOR = f"""
WITH k AS (SELECT ticker, unnest(list_concat(coalesce(aliases, []), [canonical_name])) AS a FROM issuer_registry), n AS (SELECT DISTINCT ticker, {_normal_sql('a')} AS name FROM k WHERE a IS NOT NULL),
b AS (SELECT {_normal_sql('e.name')} AS name FROM (SELECT unnest(exclusions) AS e FROM issuer_registry))
SELECT alias_id, ticker FROM (SELECT alias_id, {_normal_sql('alias_name')} AS name FROM issuer_aliases) JOIN n USING (name) WHERE name <> '' AND name NOT IN (SELECT name FROM b)"""


def registry_merge(spark, folder):
    """Reviewed aliases and the names harvested at least twice from the issuer's reports; reviewed ones and exclusions win."""
    r = table(spark, folder, "issuer_registry")
    old = r.select("ticker", F.explode("aliases").alias("name")).distinct().withColumn("reviewed", F.lit(True))
    fresh = table(spark, folder, "issuer_aliases").filter("alias_name is not null").groupBy(F.split_part("source_pdf", F.lit("_"), F.lit(1)).alias("ticker"), F.col("alias_name").alias("name")).agg(F.count("*").alias("n")).filter("n > 1")
    barred = r.select("ticker", F.explode("exclusions").alias("e")).select("ticker", F.col("e.name").alias("name")).distinct()
    return old.join(fresh, ["ticker", "name"], "full").join(barred, ["ticker", "name"], "left_anti").select("ticker", "name", F.coalesce("reviewed", F.lit(False)).alias("reviewed"), F.coalesce("n", F.lit(0)).alias("n"))


MERGE = """
WITH o AS (SELECT DISTINCT ticker, unnest(aliases) AS name FROM issuer_registry), f AS (SELECT split_part(source_pdf, '_', 1) AS ticker, alias_name AS name, count(*) AS n FROM issuer_aliases WHERE alias_name IS NOT NULL GROUP BY ALL HAVING count(*) > 1),
b AS (SELECT DISTINCT ticker, e.name AS name FROM (SELECT ticker, unnest(exclusions) AS e FROM issuer_registry))
SELECT ticker, name, o.name IS NOT NULL AS reviewed, coalesce(n, 0) AS n FROM o FULL JOIN f USING (ticker, name) WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.ticker = ticker AND b.name = name)"""
MERGE = MERGE.replace("AS e FROM issuer_registry))\nSELECT ticker, name, o.name IS NOT NULL AS reviewed, coalesce(n, 0) AS n FROM o FULL JOIN f USING (ticker, name) WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.ticker = ticker AND b.name = name)", """AS e FROM issuer_registry)),
m AS (SELECT coalesce(o.ticker, f.ticker) AS ticker, coalesce(o.name, f.name) AS name, o.name IS NOT NULL AS reviewed, coalesce(n, 0) AS n FROM o FULL JOIN f ON o.ticker = f.ticker AND o.name = f.name)
SELECT m.* FROM m ANTI JOIN b USING (ticker, name)""")


def filename_parse(spark, folder):
    """company and year of the reports' file names: a trailing year, else the rightmost four digits."""
    s = table(spark, folder, "sentences").select("source_pdf").filter("source_pdf is not null").distinct()
    stem = F.regexp_replace("source_pdf", r"\.[A-Za-z]+$", "")
    tail, last = F.regexp_extract(stem, r"(\d{4})$", 1), F.regexp_extract(stem, r".*(?:^|[^0-9])(\d{4})(?:[^0-9]|$)", 1)
    return s.select("source_pdf", F.split_part("source_pdf", F.lit("_"), F.lit(1)).alias("company"), F.coalesce(F.nullif(tail, F.lit("")), F.nullif(last, F.lit("")), F.lit("unknown")).alias("year"))


FILES = r"""
WITH s AS (SELECT DISTINCT source_pdf, regexp_replace(source_pdf, '\.[A-Za-z]+$', '') AS stem FROM sentences WHERE source_pdf IS NOT NULL)
SELECT source_pdf, split_part(source_pdf, '_', 1) AS company, coalesce(nullif(regexp_extract(stem, '([0-9]{4})$', 1), ''), nullif(regexp_extract(stem, '.*(?:^|[^0-9])([0-9]{4})(?:[^0-9]|$)', 1), ''), 'unknown') AS year FROM s"""


def similar_pairs(spark, folder):
    """Pairs of one class whose cosine is 0.3 or more; blocked by class and salted, exact."""
    return resolve.similar_pairs(table(spark, folder, "embeddings"), 0.3)


PAIRS = """
WITH e AS (SELECT vec_id, label, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings)
SELECT a.vec_id AS a, b.vec_id AS b, round(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE)) / (a.n * b.n), 4) AS cosine
FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: a.embedding[i]::DOUBLE * b.embedding[i]::DOUBLE)) >= 0.3 * a.n * b.n"""

QUERIES = {
    "greenwash_candidates": (greenwash_candidates, GREENWASH), "triple_direction_fix": (triple_direction_fix, DIRECTION), "triple_validation_errors": (triple_validation_errors, ERRORS),
    "validation_stats": (validation_stats, STATS), "graph_nodes": (graph_nodes, NODES), "graph_edges": (graph_edges, EDGES), "triples_roundtrip": (triples_roundtrip, ROUNDTRIP), "stage_partition": (stage_partition, STAGE),
    "identity_merge": (identity_merge, IDENTITY), "resolution_stage_counts": (resolution_stage_counts, RESOLUTION), "cluster_rep": (cluster_rep, CLUSTER_REP),
    "consolidate_nodes": (consolidate_nodes, CONSOLIDATE), "payload_nodes": (payload_nodes, PAYLOAD), "node_versions": (node_versions, NODE_VERSIONS), "embedding_text": (embedding_text, EMBEDDING_TEXT),
    "connected_components": (connected_components, COMPONENTS), "edge_year_dedup": (edge_year_dedup, EDGE_YEAR), "version_chain": (version_chain, CHAIN), "supersedes_path": (supersedes_path, PATH),
    "bitemporal_asof": (bitemporal_asof, ASOF), "edge_rewire": (edge_rewire, REWIRE), "multi_hop": (multi_hop, HOPS), "ffill": (ffill, FFILL), "dup_numbering": (dup_numbering, DUPS), "set_ops": (set_ops, SETS),
    "dense_ids": (dense_ids, DENSE), "rate_window": (rate_window, RATE), "resume_antijoin": (resume_antijoin, RESUME), "positional_join": (positional_join, POSITION), "kpi_normalize": (kpi_normalize, KPI),
    "json_recovery": (json_recovery, JSONS), "normalize_name": (normalize_name, NORMAL), "issuer_anchor": (issuer_anchor, ANCHOR), "registry_merge": (registry_merge, MERGE),
    "filename_parse": (filename_parse, FILES), "similar_pairs": (similar_pairs, PAIRS),
}
