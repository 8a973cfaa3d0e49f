"""Queries over indicators and headings, sentence splitting and point-in-time reads, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.functions import definitions, text as t
from lamina.operators import history
from lamina.plans import graphs
from lamina.sources.tables import table

#: Pillars by the letter of a definition's number (fixed values).
PILLARS = {"E": "Môi trường", "S": "Xã hội", "G": "Quản trị"}


def definitions_of(spark, folder):
    """(id, pillar, definition, document, doc_id) told by the documents that define indicators: a number, a colon, a sentence."""
    d = table(spark, folder, "documents").filter("doc_type = 'kpi_definition'")
    pattern = r"(?s)^\s*(KX-([A-Z])\.\d+):\s*([^.\n]*)"
    told = d.select(*[F.regexp_extract("text", pattern, k).alias(n) for k, n in ((1, "id"), (2, "letter"), (3, "definition"))], F.coalesce("source", F.lit("")).alias("document"), "doc_id").filter("id <> ''")
    pillar = F.coalesce(*[F.when(F.col("letter") == k, v) for k, v in PILLARS.items()], F.lit(""))
    return told.select("id", pillar.alias("pillar"), definitions.fixed(F.concat(F.lit("Báo cáo "), F.col("definition"))).alias("definition"), "document", "doc_id")


def kpi_vocabulary(spark, folder):
    """Each indicator's first definition, its name, and whether its number is used again."""
    d = definitions_of(spark, folder)
    first = d.groupBy("id").agg(F.min_by(F.struct("pillar", "definition"), "doc_id").alias("f"), F.count("*").alias("n"))
    return first.select("id", "f.pillar", F.md5(definitions.label_name(F.col("f.definition"))).alias("name"), (F.col("n") > 1).alias("again"))


_DEFINED = r"""d AS (SELECT doc_id, regexp_extract(text, '^\s*(KX-[A-Z]\.[0-9]+):\s*([^.\n]*)', 1) AS id, CASE regexp_extract(text, '^\s*KX-([A-Z])\.[0-9]+:', 1) WHEN 'E' THEN 'Môi trường' WHEN 'S' THEN 'Xã hội' WHEN 'G' THEN 'Quản trị' ELSE '' END AS pillar,
  regexp_replace(regexp_extract(text, '^\s*(KX-[A-Z]\.[0-9]+):\s*([^.\n]*)', 2), '[\s\p{Z}]+$', '') AS s, coalesce(source, '') AS document FROM documents WHERE doc_type = 'kpi_definition' AND regexp_matches(text, '^\s*KX-[A-Z]\.[0-9]+:'))"""
KPI_VOCABULARY = f"WITH {_DEFINED} SELECT id, arg_min(pillar, doc_id) AS pillar, md5(upper(substr(arg_min(s, doc_id), 1, 1)) || substr(arg_min(s, doc_id), 2)) AS name, count(*) > 1 AS again FROM d GROUP BY id"


def kpi_counts(spark, folder):
    """Indicators by pillar and by the document's name before a dash."""
    d = definitions_of(spark, folder)
    by = lambda kind, c: d.groupBy(c.alias("value")).agg(F.countDistinct("id").alias("n")).select(F.lit(kind).alias("by"), "value", "n")
    return by("pillar", F.col("pillar")).unionAll(by("document", F.split_part("document", F.lit("-"), F.lit(1))))


KPI_COUNTS = f"WITH {_DEFINED} SELECT 'pillar' AS by, pillar AS value, count(DISTINCT id) AS n FROM d GROUP BY 2 UNION ALL SELECT 'document', split_part(document, '-', 1), count(DISTINCT id) FROM d GROUP BY 2"


def kpi_enrich(spark, folder):
    """Definitions joined to a second source's (here the news that name their numbers' letters): gaps on either side told, thin ones marked."""
    d = definitions_of(spark, folder).groupBy("id").agg(F.min_by("definition", "doc_id").alias("name"))
    e = definitions_of(spark, folder).filter(F.col("doc_id") % 3 != 0).groupBy("id").agg(F.max_by("definition", "doc_id").alias("definition")).unionAll(spark.range(1).select(F.lit("KX-Z.0").alias("id"), F.lit("not defined").alias("definition")))
    j = d.join(e, "id", "full")
    return j.select("id", F.when(F.col("name").isNull(), "no definition").when(F.col("definition").isNull(), "not enriched").otherwise("both").alias("state"), F.coalesce(F.col("definition") == F.col("name"), F.lit(False)).alias("thin"))


KPI_ENRICH = f"""WITH {_DEFINED}, a AS (SELECT id, arg_min(s, doc_id) AS name FROM d GROUP BY 1), e AS (SELECT id, arg_max(s, doc_id) AS definition FROM d WHERE doc_id % 3 <> 0 GROUP BY 1 UNION ALL SELECT 'KX-Z.0', 'not defined')
SELECT coalesce(a.id, e.id) AS id, CASE WHEN name IS NULL THEN 'no definition' WHEN definition IS NULL THEN 'not enriched' ELSE 'both' END AS state, coalesce(definition = name, false) AS thin FROM a FULL JOIN e ON a.id = e.id"""


def bilingual_split(spark, folder):
    """Headings with lettered items in two languages, here made of two documents' first words: the Vietnamese phrases of each section."""
    d = table(spark, folder, "documents").filter("lang in ('vi', 'en') and text is not null")
    head = F.regexp_replace(F.regexp_extract("text", r"^[^\n./:]{12,60}", 0), r"\s+", " ")
    told = d.withColumn("h", head).filter(F.length("h") >= 12)
    text = F.concat(F.lit("6. 1 . Tiêu đề: a) "), F.col("h"), F.lit(" / english words ; b) "), F.col("h"), F.lit(". / other words\n6.2. "), F.col("h"), F.lit(" / last"))
    s = told.select("doc_id", F.explode(definitions.sections(text)).alias("s"))
    return s.select("doc_id", F.col("s.code").alias("code"), F.size(definitions.vietnamese_indicators(F.col("s.body"))).alias("phrases"))


BILINGUAL = r"""
WITH d AS (SELECT doc_id, regexp_replace(regexp_extract(text, '^[^\n./:]{12,60}', 0), '\s+', ' ', 'g') AS h FROM documents WHERE lang IN ('vi', 'en') AND text IS NOT NULL),
k AS (SELECT doc_id, trim(regexp_replace(trim(h, ' .;:-'), '^[a-eA-E]\)\s*', ''), ' .;:-') AS h, h AS raw FROM d WHERE length(h) >= 12),
v AS (SELECT doc_id, length(h) >= 5 AND NOT starts_with(h, '(') AND regexp_matches(h, '[ăâđêôơưĂÂĐÊÔƠƯáàảãạấầẩẫậắằẳẵặéèẻẽẹếềểễệíìỉĩịóòỏõọốồổỗộớờởỡợúùủũụứừửữựýỳỷỹỵÁÀẢÃẠẤẦẨẪẬẮẰẲẴẶÉÈẺẼẸẾỀỂỄỆÍÌỈĨỊÓÒỎÕỌỐỒỔỖỘỚỜỞỠỢÚÙỦŨỤỨỪỬỮỰÝỲỶỸỴ]') AS vn FROM k)
SELECT doc_id, '6.1' AS code, CASE WHEN vn THEN 2 ELSE 0 END AS phrases FROM v UNION ALL SELECT doc_id, '6.2', CASE WHEN vn THEN 1 ELSE 0 END FROM v"""


def sentence_split(spark, folder):
    """Page texts as sentences: blocks at empty lines, wrapped lines joined, split before a capital, bullets and noise dropped, numbered from 1."""
    p = table(spark, folder, "page_texts").filter("text is not null")
    clean = F.replace(F.col("text"), F.lit("­"), F.lit(""))
    blocks = F.transform(F.split(clean, r"\n\s*\n"), lambda b: t.merge_wrapped_lines(b))
    cut = F.flatten(F.transform(blocks, lambda b: F.split(b, r"(?<=[.!?])\s+(?=[A-ZÀ-ỹ])")))
    bare = F.transform(cut, lambda s: F.trim(F.regexp_replace(F.trim(s), r"^[•●▪*–-]+\s*", "")))
    kept = F.filter(bare, lambda s: (s != "") & ~t.is_noise(s))
    return p.select("seq", F.posexplode(kept).alias("p", "s")).select("seq", (F.col("p") + 1).alias("sentence_index"), F.md5("s").alias("digest"))


SENTENCE_SPLIT = r"""
WITH b AS (SELECT seq, unnest(string_split(regexp_replace(replace(text, chr(173), ''), '\n\s*\n', chr(2), 'g'), chr(2))) AS b, unnest(range(len(string_split(regexp_replace(replace(text, chr(173), ''), '\n\s*\n', chr(2), 'g'), chr(2))))) AS bi FROM page_texts WHERE text IS NOT NULL),
m AS (SELECT seq, bi, replace(replace(regexp_replace(regexp_replace(regexp_replace(b, '[ \t]*\n[ \t]*', chr(10), 'g'), '([.!?:;…])\n', '\1' || chr(1), 'g'), '\n([0-9])', chr(1) || '\1', 'g'), chr(10), ' '), chr(1), chr(10)) AS b FROM b),
c AS (SELECT seq, bi, string_split(regexp_replace(b, '([.!?])\s+([A-ZÀ-ỹ])', '\1' || chr(3) || '\2', 'g'), chr(3)) AS l FROM m),
u AS (SELECT seq, bi, unnest(l) AS s, unnest(range(len(l))) AS si FROM c),
s AS (SELECT seq, bi, si, trim(regexp_replace(trim(s, ' '), '^[•●▪*–-]+\s*', ''), ' ') AS s FROM u),
k AS (SELECT * FROM s WHERE s <> '' AND NOT regexp_matches(s, '^\s*[0-9]{1,4}\s*$') AND NOT regexp_matches(s, '\.{6,}') AND NOT regexp_matches(s, '^[0-9.,%()\s-]+$') AND NOT (length(s) < 25 OR len(regexp_split_to_array(trim(s, ' '), ' +')) < 4))
SELECT seq, (row_number() OVER (PARTITION BY seq ORDER BY bi, si))::INT AS sentence_index, md5(s) AS digest FROM k"""


def page_kpi_join(spark, folder):
    """Every page with its indicators, those without any too: here the sentences of the same report and page that hold a percentage."""
    p = table(spark, folder, "page_texts").select("seq", F.col("doc").alias("source_pdf"), "page")
    k = table(spark, folder, "sentences").filter(F.col("text").rlike("[0-9]%")).groupBy("source_pdf", "page").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    return p.join(k, ["source_pdf", "page"], "left").select("seq", F.coalesce("n", F.lit(0)).alias("indicators"), "first")


PAGE_KPI = """
WITH k AS (SELECT source_pdf, page, count(*) AS n, min(seq) AS first FROM sentences WHERE regexp_matches(text, '[0-9]%') GROUP BY ALL)
SELECT p.seq, coalesce(n, 0) AS indicators, first FROM page_texts p LEFT JOIN k ON k.source_pdf = p.doc AND k.page = p.page"""


def kpi_observations(spark, folder):
    """Figures told in sentences: value as written, its unit and year, counted by unit and year."""
    s = table(spark, folder, "sentences")
    pattern = r"(\d+(?:[.,]\d+)*)\s?(%|kg|MWh|m³|mg/l|giờ|người|tấn|hecta|hours|tonnes|percent|hectares)"
    found = s.select("seq", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("told"), F.regexp_extract("text", r"(?:năm|in) (\d{4})", 1).alias("year"))
    unit = F.regexp_extract("told", pattern, 2)
    return found.groupBy(unit.alias("unit"), "year").agg(F.count("*").alias("n"), F.countDistinct("seq").alias("sentences"), F.sum(F.length(F.regexp_extract("told", pattern, 1))).alias("digits"))


KPI_OBSERVATIONS = r"""
WITH f AS (SELECT seq, unnest(regexp_extract_all(text, '([0-9]+(?:[.,][0-9]+)*)\s?(%|kg|MWh|m³|mg/l|giờ|người|tấn|hecta|hours|tonnes|percent|hectares)', 0)) AS told, regexp_extract(text, '(?:năm|in) ([0-9]{4})', 1) AS year FROM sentences WHERE text IS NOT NULL)
SELECT regexp_extract(told, '([0-9]+(?:[.,][0-9]+)*)\s?(%|kg|MWh|m³|mg/l|giờ|người|tấn|hecta|hours|tonnes|percent|hectares)', 2) AS unit, year, count(*) AS n, count(DISTINCT seq) AS sentences,
  sum(length(regexp_extract(told, '([0-9]+(?:[.,][0-9]+)*)\s?(%|kg|MWh|m³|mg/l|giờ|người|tấn|hecta|hours|tonnes|percent|hectares)', 1)))::BIGINT AS digits FROM f GROUP BY ALL"""


def point_in_time(spark, folder):
    """Entity versions valid in the middle of each year from 2005 to 2024, by class."""
    v = history.build_chains(table(spark, folder, "entity_snapshots"))
    years = v.withColumn("year", F.explode(F.sequence(F.lit(2005), F.lit(2024))))
    at = F.concat("year", F.lit("-07-01"))
    return years.filter((F.col("valid_from") <= at) & (at < F.col("valid_to"))).groupBy(F.split_part("stable_id", F.lit("|"), F.lit(1)).alias("class"), "year").agg(F.count("*").alias("n"))


def seed_substring(spark, folder):
    """Names that hold a word of strangers, the first such word counting."""
    words = ["quy dau tu", "chung khoan", "ngan hang", "bao bi", "khoang san", "logistics", "land", "holdings"]
    a = table(spark, folder, "issuer_aliases").filter("alias_name is not null").withColumn("name", t.normalize_name(F.col("alias_name")))
    seed = F.coalesce(*[F.when(F.contains("name", F.lit(w)), w) for w in words])
    return a.withColumn("seed", seed).filter("seed is not null").groupBy("seed").agg(F.count("*").alias("n"), F.countDistinct("name").alias("names"))


def queries_with(versions: str):
    """The queries of this module; ``versions`` is the SQL of all entity versions."""
    when = " ".join(f"WHEN contains(name, '{w}') THEN '{w}'" for w in ("quy dau tu", "chung khoan", "ngan hang", "bao bi", "khoang san", "logistics", "land", "holdings"))
    seeds = f"WITH a AS (SELECT {graphs._normal_sql('alias_name')} AS name FROM issuer_aliases WHERE alias_name IS NOT NULL), s AS (SELECT name, CASE {when} END AS seed FROM a) SELECT seed, count(*) AS n, count(DISTINCT name) AS names FROM s WHERE seed IS NOT NULL GROUP BY 1"
    at = f"WITH v AS ({versions}) SELECT split_part(stable_id, '|', 1) AS class, year::INT AS year, count(*) AS n FROM v, range(2005, 2025) y(year) WHERE valid_from <= year || '-07-01' AND year || '-07-01' < valid_to GROUP BY ALL"
    return {
        "kpi_enrich": (kpi_enrich, KPI_ENRICH), "kpi_vocabulary": (kpi_vocabulary, KPI_VOCABULARY), "kpi_counts": (kpi_counts, KPI_COUNTS), "bilingual_split": (bilingual_split, BILINGUAL), "sentence_split": (sentence_split, SENTENCE_SPLIT), "page_kpi_join": (page_kpi_join, PAGE_KPI),
        "kpi_observations": (kpi_observations, KPI_OBSERVATIONS), "point_in_time": (point_in_time, at), "seed_substring": (seed_substring, seeds),
    }

