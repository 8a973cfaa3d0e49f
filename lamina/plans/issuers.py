"""Queries over issuers' names: normal forms, registry, classification and search texts, each with the SQL that says the same.

The SQL spells its lists out by itself, so that a wrong list on one side shows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lamina.functions import text as t
from lamina.operators import triples as tr
from lamina.plans import graphs
from lamina.sources.tables import table

#: Predicates whose subject is the company that a report is about (fixed values).
ISSUER_PREDICATES = (
    "reportsKPI", "claims", "setsGoal", "ownsFacility", "holdsCertification", "subjectToRegulation", "adoptsStandard", "takesPartIn", "generatesEmission",
    "subjectToPenalty", "offsetsWith", "targetsScienceBased", "generatesWaste", "impactsCommunity", "publishesReport", "locatedIn",
)
#: Words of other members of a company's family, folded (fixed values).
QUALIFIERS = ("holdings", "yen", "bai", "khoang", "bao", "bi", "tien", "noi", "vinh", "thakhek", "hung", "anh", "duong")
#: Parts of normal forms of entities known to be others, with the note that tells so (fixed values).
SEEDS = {
    "an phat holdings": "An Phát Holdings — parent group (ticker APH), a separate listed entity",
    "an tien": "An Tiến Industries (HII) — affiliate, separate listed entity",
    "nhua ha noi": "Nhựa Hà Nội (NHH) — affiliate, separate listed entity",
}
#: Edges from which on a name's structural support counts as strong.
LEAST_EDGES = 10
#: Keyword groups and sites of searches (fixed values).
KEYWORD_GROUPS = (
    ("ESG", "phát triển bền vững", "báo cáo phát triển bền vững", "công trình xanh"),
    ("môi trường", "xả thải", "ô nhiễm", "xử phạt môi trường"),
    ("phát thải", "năng lượng tái tạo", "Net Zero", "giảm phát thải"),
    ("tai nạn lao động", "nợ bảo hiểm", "thao túng", "kiểm toán ngoại trừ"),
)
SITES = (
    "cafef.vn", "vietstock.vn", "tinnhanhchungkhoan.vn", "vneconomy.vn", "baodautu.vn", "theleader.vn", "nhadautu.vn", "ndh.vn",
    "vnexpress.net", "tuoitre.vn", "thanhnien.vn", "dantri.com.vn", "plo.vn", "laodong.vn", "baotainguyenmoitruong.vn", "moitruong.net.vn",
)

normal_sql = graphs._normal_sql


def officials(spark, folder) -> DataFrame:
    """(ticker, full_name): the first name of each ticker in the company book, tickers trimmed and upper-case."""
    c = table(spark, folder, "companies").filter("trim(ticker) <> '' and trim(full_name) <> ''")
    return c.groupBy(F.upper(F.trim("ticker")).alias("ticker")).agg(F.trim(F.min_by("full_name", "seq")).alias("full_name"))


OFFICIALS = "o AS (SELECT upper(trim(ticker, ' ')) AS ticker, trim(arg_min(full_name, seq), ' ') AS full_name FROM companies WHERE trim(ticker, ' ') <> '' AND trim(full_name, ' ') <> '' GROUP BY 1)"


def _listed(c: Column) -> Column:
    return F.concat(F.lit("['"), F.array_join(c, "', '"), F.lit("']"))


def classify(names: DataFrame, issuers: DataFrame, seeds: dict[str, str], qualifiers: tuple[str, ...], least_edges: int = LEAST_EDGES) -> DataFrame:
    """Names (name, edges) against issuers (ticker, full_name), a reviewed list: (ticker, name, kind, suggest, reason, edges, place).

    A seeded part excludes a name for every issuer; the ticker, or the whole core without a qualifier, makes it an
    alias; two core words send it to review. Names meet issuers by the words they share, never all by all. Aliases
    and reviews are ordered by falling edges, then by name. Null and wordless names are left out; repeated names are
    one, their edges added up.
    """
    n = names.filter(F.trim("name") != "").groupBy(F.trim("name").alias("name"), t.normalize_name(F.trim("name")).alias("norm")).agg(F.sum(F.coalesce("edges", F.lit(0))).cast("int").alias("edges"))
    n = n.filter("norm <> ''").withColumn("tokens", F.array_distinct(F.split("norm", " ")))
    note = F.coalesce(*[F.when(F.contains("norm", F.lit(k)), F.lit(v)) for k, v in seeds.items()]) if seeds else F.lit(None).cast("string")
    n = n.withColumn("note", note).withColumn("quals", F.array_sort(F.array_intersect("tokens", F.array(*map(F.lit, qualifiers)))))
    tickers = [r[0] for r in issuers.select("ticker").distinct().collect()]  # the registry's issuers
    seeded = n.filter("note is not null").select(F.explode(F.array(*map(F.lit, tickers)).cast("array<string>")).alias("ticker"), "name", F.lit("exclude").alias("kind"), F.lit(None).cast("string").alias("suggest"), F.col("note").alias("reason"), "edges")
    core = issuers.groupBy("ticker").agg(F.first(t.core_tokens(F.col("full_name"))).alias("core"))
    index = core.select("ticker", "core", F.explode(F.array_union("core", F.array(F.lower("ticker")))).alias("token"))
    index = index.select("ticker", "token", F.size("core").alias("whole"), F.array_contains("core", F.col("token")).alias("is_core"), (F.col("token") == F.lower("ticker")).alias("is_ticker"))
    met = n.filter("note is null").select("name", F.explode("tokens").alias("token")).join(index, "token")
    hits = met.groupBy("name", "ticker").agg(F.array_sort(F.collect_list(F.when(F.col("is_core"), F.col("token")))).alias("shared"), F.max("is_ticker").alias("by_ticker"), F.first("whole").alias("whole"))
    j = hits.join(n, "name").withColumn("k", F.size("shared"))
    alias = F.col("by_ticker") | ((F.col("whole") > 0) & (F.col("k") == F.col("whole")) & (F.size("quals") == 0))
    qualified, strong = F.size("quals") > 0, F.col("edges") >= least_edges
    begin = F.concat(F.lit("shares issuer core "), _listed(F.col("shared")))
    reason = (
        F.when(qualified, F.concat(begin, F.lit(" but qualifier "), _listed(F.col("quals")), F.lit(" → likely related-but-separate entity")))
        .when(strong, F.concat(begin, F.lit(" and is subject of "), F.col("edges").cast("string"), F.lit(" report edges → likely an issuer shorthand")))
        .otherwise(F.concat(begin, F.lit(" but weak structural support ("), F.col("edges").cast("string"), F.lit(" report edges)")))
    )
    told = j.filter(alias | (F.col("k") >= 2)).select(
        "ticker", "name", F.when(alias, "alias").otherwise("review").alias("kind"), F.when(~alias, F.when(~qualified & strong, "include").otherwise("exclude")).alias("suggest"), F.when(~alias, reason).alias("reason"), "edges",
    )
    w = W.partitionBy("ticker", "kind").orderBy(F.when(F.col("kind") == "exclude", 0).otherwise(-F.col("edges")), "name")
    return told.unionByName(seeded).withColumn("place", F.row_number().over(w))


def registry_classify(spark, folder):
    """All harvested names against every registered issuer that the company book names."""
    registered = table(spark, folder, "issuer_registry").select("ticker").distinct()
    a = table(spark, folder, "issuer_aliases").select(F.col("alias_name").alias("name"), F.col("subject_edges").alias("edges"))
    return classify(a, officials(spark, folder).join(registered, "ticker", "left_semi"), SEEDS, QUALIFIERS)


CLASSIFY = f"""
WITH {OFFICIALS}, c AS (SELECT ticker, list_filter(list_distinct(string_split({normal_sql('full_name')}, ' ')), lambda w: w <> '' AND w NOT IN ('nhua', 'plastic', 'vat', 'lieu', 'xay', 'dung', 'material', 'materials', 'industry', 'industries', 'viet', 'nam', 'vietnam', 'san', 'xuat', 'the', 'and')) AS core FROM o SEMI JOIN issuer_registry USING (ticker)),
n AS (SELECT trim(alias_name, ' ') AS name, sum(coalesce(subject_edges, 0))::INT AS edges FROM issuer_aliases WHERE trim(alias_name, ' ') <> '' GROUP BY 1),
m AS (SELECT name, edges, norm, list_distinct(string_split(norm, ' ')) AS toks FROM (SELECT *, {normal_sql('name')} AS norm FROM n) WHERE norm <> ''),
x AS (SELECT ticker, name, edges, core, toks, list_sort(list_intersect(core, toks)) AS shared,
  list_sort(list_intersect(toks, ['holdings', 'yen', 'bai', 'khoang', 'bao', 'bi', 'tien', 'noi', 'vinh', 'thakhek', 'hung', 'anh', 'duong'])) AS quals,
  CASE WHEN contains(norm, 'an phat holdings') THEN 'An Phát Holdings — parent group (ticker APH), a separate listed entity' WHEN contains(norm, 'an tien') THEN 'An Tiến Industries (HII) — affiliate, separate listed entity'
    WHEN contains(norm, 'nhua ha noi') THEN 'Nhựa Hà Nội (NHH) — affiliate, separate listed entity' END AS note FROM m, c),
k AS (SELECT *, CASE WHEN note IS NOT NULL THEN 'exclude' WHEN list_contains(toks, lower(ticker)) OR (len(core) > 0 AND len(shared) = len(core) AND len(quals) = 0) THEN 'alias' WHEN len(shared) >= 2 THEN 'review' END AS kind FROM x)
SELECT ticker, name, kind, CASE WHEN kind = 'review' THEN CASE WHEN len(quals) = 0 AND edges >= 10 THEN 'include' ELSE 'exclude' END END AS suggest,
  CASE kind WHEN 'exclude' THEN note WHEN 'review' THEN 'shares issuer core [''' || array_to_string(shared, ''', ''') || ''']' || CASE WHEN len(quals) > 0 THEN ' but qualifier [''' || array_to_string(quals, ''', ''') || '''] → likely related-but-separate entity'
    WHEN edges >= 10 THEN ' and is subject of ' || edges || ' report edges → likely an issuer shorthand' ELSE ' but weak structural support (' || edges || ' report edges)' END END AS reason,
  edges, (row_number() OVER (PARTITION BY ticker, kind ORDER BY CASE WHEN kind = 'exclude' THEN 0 ELSE -edges END, name))::INT AS place FROM k WHERE kind IS NOT NULL"""


def org_subject_counts(spark, folder):
    """Organisations by how often they are the subject of an issuer's predicate."""
    x = tr.fix_direction(graphs.events_as_triples(spark, folder)).filter((F.col("s_class") == "Organization") & F.col("predicate").isin(*ISSUER_PREDICATES))
    return x.groupBy(F.trim(x["s_props"]["name"]).alias("name")).agg(F.count("*").alias("n")).filter("name <> ''")


ORG = f"""WITH {graphs.TRIPLES} SELECT trim(regexp_extract(CASE WHEN fixed THEN o_text ELSE s_text END, 'name=([^;]*)', 1), ' ') AS name, count(*) AS n FROM fix WHERE (CASE WHEN fixed THEN o_class ELSE s_class END) = 'Organization'
  AND predicate IN ('reportsKPI', 'claims', 'setsGoal', 'ownsFacility', 'holdsCertification', 'subjectToRegulation', 'adoptsStandard', 'takesPartIn', 'generatesEmission', 'subjectToPenalty', 'offsetsWith', 'targetsScienceBased', 'generatesWaste', 'impactsCommunity', 'publishesReport', 'locatedIn') GROUP BY 1"""


def corpus_names(spark, folder):
    """A10: the distinct names of organisations on either side of a triple, and the tickers that reports' names begin with."""
    x = graphs.events_as_triples(spark, folder)
    sides = [x.filter(F.col(f"{s}_class") == "Organization").select(F.trim(x[f"{s}_props"]["name"]).alias("value")) for s in "so"]
    names = sides[0].unionAll(sides[1]).filter("value <> ''").distinct().select(F.lit("name").alias("kind"), "value")
    stem = F.upper(F.regexp_extract("source_pdf", r"(?i)^([A-Za-z0-9]{2,5})_Baocaothuongnien", 1))
    tickers = table(spark, folder, "issuer_aliases").select(stem.alias("value")).filter("value <> ''").distinct()
    return names.unionAll(tickers.select(F.lit("ticker").alias("kind"), "value"))


CORPUS = f"""WITH {graphs.TRIPLES}, s AS (SELECT s_text AS p FROM tri WHERE s_class = 'Organization' UNION SELECT o_text FROM tri WHERE o_class = 'Organization')
SELECT DISTINCT 'name' AS kind, regexp_extract(p, 'name=([^;]*)', 1) AS value FROM s
UNION ALL SELECT DISTINCT 'ticker', upper(regexp_extract(source_pdf, '(?i)^([a-z0-9]{{2,5}})_baocaothuongnien', 1)) FROM issuer_aliases WHERE regexp_matches(source_pdf, '(?i)^[a-z0-9]{{2,5}}_baocaothuongnien')"""


def query_builder(spark, folder):
    """The searches for each company: plain ones, its name with each group of keywords, and on each site with the first."""
    c = officials(spark, folder)
    short = t.short_name(F.col("full_name"))
    who = F.when(t.vague_name(short), F.concat(short, F.lit(" "), F.col("ticker"))).otherwise(short)
    either = [" OR ".join(g) for g in KEYWORD_GROUPS]
    q = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("query"))
    made = [q("plain", F.col("full_name")), q("plain", F.concat("ticker", F.lit(" cổ phiếu")))]
    made += [q("keyword", F.concat("who", F.lit(f" ({e})"))) for e in either]
    made += [q("site", F.concat(F.lit(f"site:{d} "), "who", F.lit(f" ({either[0]})"))) for d in SITES]
    return c.withColumn("who", who).select("ticker", F.explode(F.array(*made)).alias("q")).select("ticker", "q.kind", "q.query")


BUILDER = f"""
WITH {OFFICIALS}, a AS (SELECT *, CASE WHEN starts_with(full_name, 'Ngân hàng TMCP ') THEN full_name ELSE regexp_replace(regexp_replace(full_name, '^(Tổng Công ty cổ phần |Tổng công ty cổ phần |Tổng Công ty |Tổng công ty |CTCP - Tổng Công ty |Công ty Tài chính Tổng hợp Cổ phần |CTCP Tập đoàn |Tập đoàn |CTCP |Công ty cổ phần |Công ty )', ''), '( - CTCP| CTCP)$', '') END AS b FROM o),
s AS (SELECT ticker, full_name, CASE WHEN starts_with(b, 'Ngân hàng TMCP ') THEN 'Ngân hàng ' || substr(b, 16) ELSE trim(b, ' ') END AS s FROM a),
w AS (SELECT ticker, full_name, CASE WHEN length(s) <= 3 OR regexp_full_match(replace(replace(s, '-', ''), ' ', ''), '[0-9]+') OR (NOT contains(s, ' ') AND length(s) <= 6) THEN s || ' ' || ticker ELSE s END AS who FROM s)
SELECT ticker, 'plain' AS kind, full_name AS query FROM w UNION ALL SELECT ticker, 'plain', ticker || ' cổ phiếu' FROM w
UNION ALL SELECT ticker, 'keyword', who || ' (' || g || ')' FROM w, unnest(['ESG OR phát triển bền vững OR báo cáo phát triển bền vững OR công trình xanh', 'môi trường OR xả thải OR ô nhiễm OR xử phạt môi trường', 'phát thải OR năng lượng tái tạo OR Net Zero OR giảm phát thải', 'tai nạn lao động OR nợ bảo hiểm OR thao túng OR kiểm toán ngoại trừ']) u(g)
UNION ALL SELECT ticker, 'site', 'site:' || d || ' ' || who || ' (ESG OR phát triển bền vững OR báo cáo phát triển bền vững OR công trình xanh)' FROM w,
  unnest(['cafef.vn', 'vietstock.vn', 'tinnhanhchungkhoan.vn', 'vneconomy.vn', 'baodautu.vn', 'theleader.vn', 'nhadautu.vn', 'ndh.vn', 'vnexpress.net', 'tuoitre.vn', 'thanhnien.vn', 'dantri.com.vn', 'plo.vn', 'laodong.vn', 'baotainguyenmoitruong.vn', 'moitruong.net.vn']) v(d)"""


def ticker_scope(spark, folder, wanted: tuple[str, ...] = ("AAAA",), first: int = 20):
    """P10: companies of an allow-list, or without one the first so many of the book, here both: the list's and the first ones."""
    c = table(spark, folder, "companies").filter("trim(ticker) <> '' and trim(full_name) <> ''").groupBy(F.trim("ticker").alias("ticker")).agg(F.min("seq").alias("seq"))
    head = c.orderBy("seq").limit(first)
    listed = c.filter(F.upper("ticker").isin(*wanted) | F.upper("ticker").startswith("S"))
    return head.select("ticker", F.lit("first").alias("scope")).unionAll(listed.select("ticker", F.lit("listed").alias("scope")))


SCOPE = """
WITH c AS (SELECT trim(ticker, ' ') AS ticker, min(seq) AS seq FROM companies WHERE trim(ticker, ' ') <> '' AND trim(full_name, ' ') <> '' GROUP BY 1)
SELECT ticker, 'first' AS scope FROM (SELECT * FROM c ORDER BY seq LIMIT 20) UNION ALL SELECT ticker, 'listed' FROM c WHERE upper(ticker) = 'AAAA' OR upper(ticker) LIKE 'S%'"""

QUERIES = {
    "registry_classify": (registry_classify, CLASSIFY), "org_subject_counts": (org_subject_counts, ORG), "corpus_names": (corpus_names, CORPUS), "query_builder": (query_builder, BUILDER), "ticker_scope": (ticker_scope, SCOPE),
}
