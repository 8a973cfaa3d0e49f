"""Queries over sentences, pages and articles, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from lamina.functions import text as t, web
from lamina.sources.tables import table

TERMS = ["môi trường", "khí thải", "nước thải", "chỉ số quản trị", "water permit", "emissions ledger"]


def sentences_with_defaults(spark, folder):
    """Missing source unknown.pdf, page and index 0, text empty, esg false."""
    return table(spark, folder, "sentences").select(
        "seq", F.coalesce("source_pdf", F.lit("unknown.pdf")).alias("source_pdf"), F.coalesce("page", F.lit(0)).alias("page"),
        F.coalesce("sentence_index", F.lit(0)).alias("sentence_index"), F.coalesce("text", F.lit("")).alias("text"), "labels", "scores", F.coalesce("esg", F.lit(False)).alias("esg"),
    )


#: Sentences of a page put together at once.
PAGE_PART = 1000


def page_rebuild(spark, folder):
    """The text of each page with an esg sentence, its sentences in order, blanks dropped.

    What calls itself a page may be a heap of rows (no source, no index): sentences are put together in parts of at
    most PAGE_PART rows, dealt by rank within their index, and then the parts; so no list of rows grows with the data,
    only the page's text does. Ranks are taken within a page and index, and salted stretches of indexes keep order.
    """
    s = sentences_with_defaults(spark, folder).withColumn("text", t.trim_all(F.col("text")))
    pages = s.groupBy("source_pdf", "page").agg(F.bool_or("esg").alias("gate"), F.count("*").alias("n_sentences")).filter("gate").drop("gate")
    told = s.filter("text <> ''").select("source_pdf", "page", "sentence_index", "seq", "text")
    # Order within a page is (sentence_index, seq); seq follows arrival, so a stretch of seq bounds the rows of one index.
    part = told.withColumn("stretch", F.floor(F.col("seq") / PAGE_PART))
    parts = part.groupBy("source_pdf", "page", "sentence_index", "stretch").agg(F.sort_array(F.collect_list(F.struct("seq", "text"))).alias("l"))
    lines = parts.select("source_pdf", "page", "sentence_index", "stretch", F.array_join(F.transform("l", lambda x: x["text"]), " ").alias("x"))
    whole = lines.groupBy("source_pdf", "page").agg(F.sort_array(F.collect_list(F.struct("sentence_index", "stretch", "x"))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: x["x"]), " ")
    return pages.join(whole, ["source_pdf", "page"], "left").select("source_pdf", "page", "n_sentences", F.coalesce(text, F.lit("")).alias("page_text"))


PAGE_REBUILD = r"""
WITH s AS (SELECT seq, coalesce(source_pdf, 'unknown.pdf') AS source_pdf, coalesce(page, 0) AS page, coalesce(sentence_index, 0) AS i, regexp_replace(coalesce(text, ''), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS text, coalesce(esg, false) AS esg FROM sentences),
g AS (SELECT source_pdf, page FROM s GROUP BY ALL HAVING bool_or(esg))
SELECT source_pdf, page, count(*) AS n_sentences, coalesce(string_agg(text, ' ' ORDER BY i, seq) FILTER (text <> ''), '') AS page_text FROM s SEMI JOIN g USING (source_pdf, page) GROUP BY ALL"""


def esg_rule(spark, folder):
    """Pillars scored 0.45 or more and neutrality under 0.5, on scores rounded to four places; missing scores give none."""
    s = table(spark, folder, "sentences")
    score = lambda k: F.round(s["scores"][k], 4)
    pillars = F.array_compact(F.array(*[F.when(score(k) >= 0.45, k) for k in ("Environmental", "Social", "Governance")]))
    return s.select("seq", F.array_join(pillars, ",").alias("pillars"), F.coalesce(score("Neutral") < 0.5, F.lit(False)).alias("is_esg"))


ESG_RULE = """
SELECT seq, concat_ws(',', CASE WHEN round(scores['Environmental'], 4) >= 0.45 THEN 'Environmental' END, CASE WHEN round(scores['Social'], 4) >= 0.45 THEN 'Social' END,
  CASE WHEN round(scores['Governance'], 4) >= 0.45 THEN 'Governance' END) AS pillars, coalesce(round(scores['Neutral'], 4) < 0.5, false) AS is_esg FROM sentences"""


def esg_extract_stats(spark, folder):
    """Per document the sentences read and kept (with labels) and the labels counted; zero counts stay."""
    s = sentences_with_defaults(spark, folder)
    n = F.coalesce(F.size("labels"), F.lit(0))
    count = lambda k: F.sum(F.coalesce(F.array_contains("labels", k), F.lit(False)).cast("bigint"))
    return s.groupBy("source_pdf").agg(F.count("*").alias("n_rows"), F.sum((n > 0).cast("bigint")).alias("n_kept"), *[count(k).alias(f"n_{k.lower()}") for k in ("Environmental", "Social", "Governance")])


ESG_EXTRACT_STATS = """
SELECT coalesce(source_pdf, 'unknown.pdf') AS source_pdf, count(*) AS n_rows, count(*) FILTER (len(labels) > 0) AS n_kept, count(*) FILTER (list_contains(labels, 'Environmental')) AS n_environmental,
  count(*) FILTER (list_contains(labels, 'Social')) AS n_social, count(*) FILTER (list_contains(labels, 'Governance')) AS n_governance FROM sentences GROUP BY 1"""


def classify_summary(spark, folder):
    """Sentences and esg sentences per document, with the grand total."""
    s = sentences_with_defaults(spark, folder)
    return s.rollup("source_pdf").agg(F.count("*").alias("n"), F.sum(F.col("esg").cast("bigint")).alias("n_esg"), F.round(F.avg(s["scores"]["Neutral"]), 4).alias("mean_neutral")).select(F.coalesce("source_pdf", F.lit("(all)")).alias("source_pdf"), "n", "n_esg", "mean_neutral")


CLASSIFY_SUMMARY = """
WITH s AS (SELECT coalesce(source_pdf, 'unknown.pdf') AS source_pdf, coalesce(esg, false) AS esg, scores['Neutral'] AS v FROM sentences)
SELECT coalesce(source_pdf, '(all)') AS source_pdf, count(*) AS n, count(*) FILTER (esg) AS n_esg, round(avg(v), 4) AS mean_neutral FROM s GROUP BY ROLLUP (source_pdf)"""


def score_flatten(spark, folder):
    """One column per score, labels in one text, Neural read as Neutral."""
    s = table(spark, folder, "sentences")
    return s.select("seq", F.array_join("labels", ", ").alias("labels_text"), *[F.round(s["scores"][k], 4).alias(f"score_{k.lower()}") for k in ("Environmental", "Social", "Governance")], F.round(F.coalesce(s["scores"]["Neutral"], s["scores"]["Neural"]), 4).alias("score_neutral"))


SCORE_FLATTEN = """
SELECT seq, array_to_string(labels, ', ') AS labels_text, round(scores['Environmental'], 4) AS score_environmental, round(scores['Social'], 4) AS score_social,
  round(scores['Governance'], 4) AS score_governance, round(coalesce(scores['Neutral'], scores['Neural']), 4) AS score_neutral FROM sentences"""


def sentence_first(spark, folder):
    """Of repeated sentences the first to arrive."""
    s = table(spark, folder, "sentences")
    key = ["source_pdf", "page", "sentence_index", "text"]
    return s.groupBy(*key).agg(F.min("seq").alias("seq"), F.count("*").alias("copies")).select("seq", "copies")


SENTENCE_FIRST = "SELECT min(seq) AS seq, count(*) AS copies FROM sentences GROUP BY source_pdf, page, sentence_index, text"


def line_merge(spark, folder):
    """Wrapped lines of pages joined."""
    return table(spark, folder, "page_texts").select("seq", F.md5(t.merge_wrapped_lines(F.replace(F.col("text"), F.lit("­"), F.lit("")))).alias("merged_md5"))


LINE_MERGE = r"""
SELECT seq, md5(replace(replace(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(173), ''), '[ \t]*\n[ \t]*', chr(10), 'g'), '([.!?:;…])\n', '\1' || chr(1), 'g'), '\n([0-9])', chr(1) || '\1', 'g'), chr(10), ' '), chr(1), chr(10))) AS merged_md5 FROM page_texts"""


def sentence_noise_profile(spark, folder):
    """Lines of pages by the reason to drop them."""
    lines = table(spark, folder, "page_texts").select(F.explode(F.split("text", "\n")).alias("line"))
    reason = F.when(F.trim("line") == "", "blank").when(t.page_number(F.col("line")), "page number").when(t.dot_leader(F.col("line")), "dot leader").when(t.numeric_row(F.col("line")), "numeric").when(t.too_short(F.col("line")), "short").otherwise("kept")
    return lines.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("chars"))


SENTENCE_NOISE_PROFILE = r"""
WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM page_texts)
SELECT CASE WHEN trim(line, ' ') = '' THEN 'blank' WHEN regexp_matches(line, '^\s*[0-9]{1,4}\s*$') THEN 'page number' WHEN regexp_matches(line, '\.{6,}') THEN 'dot leader'
  WHEN regexp_matches(line, '^[0-9.,%()\s-]+$') THEN 'numeric' WHEN length(line) < 25 OR len(regexp_split_to_array(trim(line, ' '), ' +')) < 4 THEN 'short' ELSE 'kept' END AS reason,
  count(*) AS n, sum(length(line))::BIGINT AS chars FROM l GROUP BY 1"""


def url_canonical(spark, folder):
    """Canonical url, domain and document id of articles, with unwanted addresses marked."""
    a = table(spark, folder, "articles")
    url = F.col("url")
    return a.select("article_id", t.canonical_url(url).alias("canonical"), t.domain(url).alias("domain"), t.document_id(F.col("ticker"), url).alias("doc_key"), (~web.wanted_link(url)).alias("skip"))


URL_CANONICAL = r"""
SELECT article_id, regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '') AS canonical,
  regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), '^www\.', '') AS domain,
  concat_ws('__', ticker, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), '^www\.', ''), substr(sha1(url), 1, 10)) AS doc_key,
  NOT coalesce(starts_with(lower(url), 'http') AND NOT regexp_matches(lower(url), 'google\.com|youtube\.com|youtu\.be|facebook\.com|fb\.com|tiktok\.com|twitter\.com|x\.com|instagram\.com|linkedin\.com|/video/|/videos/|/photo/|/gallery/|/tag/|/chuyen-muc/|\.pdf|\.zip|\.doc|\.xls|/du-lieu/|studocu|staticfile\.hsx|static2\.vietstock'), false) AS skip FROM articles"""


def keyword_match(spark, folder):
    """Terms found in each article, sorted, and whether the company is named."""
    a = table(spark, folder, "articles")
    low = F.lower(F.concat_ws(" ", "title", "text"))
    found = F.array_sort(F.array_compact(F.array(*[F.when(F.contains(low, F.lit(x)), F.lit(x)) for x in TERMS])))
    named = F.coalesce(F.contains(low, F.lower("ticker")), F.lit(False)) | F.coalesce(F.contains(low, F.lower("company")), F.lit(False))
    return a.select("article_id", F.array_join(found, "|").alias("terms"), named.alias("company_mentioned"))


KEYWORD_MATCH = f"""
WITH a AS (SELECT article_id, ticker, company, lower(concat_ws(' ', title, text)) AS low FROM articles)
SELECT article_id, array_to_string(list_sort(list_filter({TERMS}, lambda x: contains(low, x))), '|') AS terms,
  coalesce(contains(low, lower(ticker)), false) OR coalesce(contains(low, lower(company)), false) AS company_mentioned FROM a"""


def candidate_rank(spark, folder):
    """Per ticker the first article of each canonical url, those naming the company first, then those with terms; the 40 best."""
    a = table(spark, folder, "articles").withColumn("canonical", t.canonical_url(F.col("url")))
    first = a.groupBy("ticker", "canonical").agg(F.min_by(F.struct("article_id", "title", "company", "matched_terms"), "article_id").alias("r")).select("ticker", "r.*")
    names = F.coalesce(F.contains(F.lower("title"), F.lower("company")), F.lit(False))
    w = W.partitionBy("ticker").orderBy(names.desc(), (F.coalesce(F.size("matched_terms"), F.lit(0)) > 0).desc(), "article_id")
    return first.withColumn("place", F.row_number().over(w)).filter("place <= 40").select("ticker", "place", "article_id")


CANDIDATE_RANK = r"""
WITH a AS (SELECT *, regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '') AS canonical FROM articles),
f AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY ticker, canonical ORDER BY article_id) = 1),
r AS (SELECT ticker, article_id, row_number() OVER (PARTITION BY ticker ORDER BY coalesce(contains(lower(title), lower(company)), false) DESC, coalesce(len(matched_terms), 0) > 0 DESC, article_id) AS place FROM f)
SELECT ticker, place::INT AS place, article_id FROM r WHERE place <= 40"""


def top_domains(spark, folder):
    """The five most frequent domains of each ticker, as k:v."""
    counts = table(spark, folder, "articles").groupBy("ticker", "source_domain").agg(F.count("*").alias("n"))
    w = W.partitionBy("ticker").orderBy(F.desc("n"), "source_domain")
    top = counts.withColumn("k", F.row_number().over(w)).filter("k <= 5")
    return top.groupBy("ticker").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", F.concat_ws(":", "source_domain", F.col("n").cast("string")).alias("kv")))), lambda x: x["kv"]), " ").alias("top"))


TOP_DOMAINS = """
WITH c AS (SELECT ticker, source_domain, count(*) AS n FROM articles GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY n DESC, source_domain) AS k FROM c)
SELECT ticker, string_agg(source_domain || ':' || n::VARCHAR, ' ' ORDER BY k) AS top FROM k WHERE k <= 5 GROUP BY ticker"""


def coverage_report(spark, folder):
    """Per company candidates, fetched texts, articles of 120 characters or more, lines and terms."""
    a = table(spark, folder, "articles")
    long = F.coalesce(F.length("text") >= 120, F.lit(False))
    return a.groupBy("ticker").agg(
        F.count("*").alias("candidates"), F.sum(F.coalesce(F.length("text") > 0, F.lit(False)).cast("bigint")).alias("fetched_ok"), F.sum(long.cast("bigint")).alias("articles"),
        F.sum(F.when(long, F.size(F.split("text", "\n"))).otherwise(0)).alias("lines"), F.countDistinct("source_domain").alias("domains"),
    )


COVERAGE_REPORT = """
SELECT ticker, count(*) AS candidates, count(*) FILTER (length(text) > 0) AS fetched_ok, count(*) FILTER (length(text) >= 120) AS articles,
  coalesce(sum(len(string_split(text, chr(10)))) FILTER (length(text) >= 120), 0)::BIGINT AS lines, count(DISTINCT source_domain) AS domains FROM articles GROUP BY ticker"""


def date_normalize(spark, folder):
    """Publishing dates in one form (some made day first, with a word before), and the year of the date, the address or the crawl."""
    a, i = table(spark, folder, "articles"), F.col("article_id") % 5
    y, m, d = (F.substring("publish_date", p, n) for p, n in ((1, 4), (6, 2), (9, 2)))
    raw = F.when(i == 0, F.concat(F.lit("Đăng ngày "), d, F.lit("-"), m, F.lit("-"), y, F.lit(" 07:15"))).when(i == 1, F.concat_ws("/", d.try_cast("int").cast("string"), m, y)).when(i == 2, F.lit("")).otherwise(F.col("publish_date"))
    url = F.when(F.col("article_id") % 7 == 0, F.concat("url", F.lit("-20190412093000123.htm"))).when(F.col("article_id") % 7 == 1, F.concat("url", F.lit("/2016/x"))).when(F.col("article_id") % 7 == 2, F.concat("url", F.lit("-185180921104500.htm"))).otherwise(F.col("url"))
    return a.select("article_id", F.coalesce(t.normalize_date(raw), F.lit("")).alias("published"), t.article_year(raw, url, F.date_format("date_crawled", "yyyy")).alias("year"))


DATE_NORMALIZE = r"""
WITH a AS (SELECT article_id, strftime(date_crawled, '%Y') AS c, substr(publish_date, 1, 4) AS y, substr(publish_date, 6, 2) AS m, substr(publish_date, 9, 2) AS d, publish_date, url FROM articles),
r AS (SELECT article_id, c, trim(CASE article_id % 5 WHEN 0 THEN 'Đăng ngày ' || d || '-' || m || '-' || y || ' 07:15' WHEN 1 THEN concat_ws('/', try_cast(d AS INT)::VARCHAR, m, y) WHEN 2 THEN '' ELSE publish_date END, ' ') AS d,
  CASE article_id % 7 WHEN 0 THEN url || '-20190412093000123.htm' WHEN 1 THEN url || '/2016/x' WHEN 2 THEN url || '-185180921104500.htm' ELSE url END AS u FROM a),
n AS (SELECT article_id, c, u, CASE WHEN regexp_matches(d, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN substr(d, 1, 10)
  WHEN regexp_matches(d, '([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{4})') THEN regexp_extract(d, '([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{4})', 3) || '-' || lpad(regexp_extract(d, '([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{4})', 2), 2, '0') || '-' || lpad(regexp_extract(d, '([0-9]{1,2})[/-]([0-9]{1,2})[/-]([0-9]{4})', 1), 2, '0')
  WHEN regexp_matches(d, '^[0-9]{4}-[0-9]{2}$') THEN d || '-01' ELSE d END AS d FROM r)
SELECT article_id, coalesce(d, '') AS published, coalesce(nullif(regexp_extract(coalesce(d, ''), '20[0-2][0-9]', 0), ''),
  CASE WHEN try_cast(regexp_extract(u, '-([0-9]{4})[0-9]{4}[0-9]{6,}\.htm', 1) AS INT) BETWEEN 2005 AND 2030 THEN regexp_extract(u, '-([0-9]{4})[0-9]{4}[0-9]{6,}\.htm', 1)
    WHEN regexp_matches(u, '185([0-9]{2})[0-9]{4}[0-9]+\.htm') THEN '20' || regexp_extract(u, '185([0-9]{2})[0-9]{4}[0-9]+\.htm', 1) WHEN regexp_matches(u, '/(20[0-2][0-9])/') THEN regexp_extract(u, '/(20[0-2][0-9])/', 1) END, c) AS year FROM n"""


#: Words that tell that an article is about the company it was sought for, lower case; here a stand-in company of the articles.
RELATED = ("nước", "khí", "rừng", "water", "emission")


def legacy_article(spark, folder):
    """Older article rows: source by address, summary, site names as authors dropped, relevance by keyword."""
    a = table(spark, folder, "articles")
    low = F.lower(F.concat_ws(" ", "title", "text"))
    related = F.lit(False)
    for w in RELATED:
        related = related | F.contains(low, F.lit(w))
    host = F.when(F.col("article_id") % 3 == 0, F.concat(F.lit("https://TuoiTre.example/"), "url")).when(F.col("article_id") % 3 == 1, F.concat("url", F.lit("?from=vietnamnet"))).otherwise(F.col("url"))
    writer = F.when(F.col("article_id") % 11 == 0, " TuoiTre.VN ").otherwise(F.col("author"))
    return a.filter(F.length("text") >= 100).select("article_id", web.source_of(host).alias("source"), F.md5(t.summary(F.col("text"))).alias("summary_md5"), web.author_name(writer).alias("author"), related.alias("related"))


LEGACY_ARTICLE = """
WITH a AS (SELECT article_id, text, title, lower(CASE article_id % 3 WHEN 0 THEN 'https://TuoiTre.example/' || url WHEN 1 THEN url || '?from=vietnamnet' ELSE url END) AS u, trim(CASE WHEN article_id % 11 = 0 THEN ' TuoiTre.VN ' ELSE author END, ' ') AS w FROM articles WHERE length(text) >= 100)
SELECT article_id, CASE WHEN contains(u, 'vnexpress') THEN 'VnExpress' WHEN contains(u, 'tuoitre') THEN 'Tuổi Trẻ' WHEN contains(u, 'thanhnien') THEN 'Thanh Niên' WHEN contains(u, 'vietnamnet') THEN 'VietnamNet' ELSE 'Unknown' END AS source,
  md5(CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END) AS summary_md5,
  CASE WHEN lower(w) IN ('vnexpress', 'tuoi tre online', 'vietnamnet news', 'thanhnien.vn', 'tuoitre.vn', 'vietnamnet.vn') THEN '' ELSE coalesce(w, '') END AS author,
  regexp_matches(lower(concat_ws(' ', title, text)), 'nước|khí|rừng|water|emission') AS related FROM a"""


def article_lines(spark, folder):
    """The non-blank lines of articles as rows, numbered from 1, unionable with sentences."""
    a = table(spark, folder, "articles")
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return a.select("article_id", t.document_id(F.col("ticker"), F.col("url")).alias("source_pdf"), F.posexplode(lines).alias("p", "line")).select("article_id", "source_pdf", (F.col("p") + 1).alias("sentence_index"), F.length("line").alias("chars"))


ARTICLE_LINES = r"""
WITH a AS (SELECT article_id, concat_ws('__', ticker, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), '^www\.', ''), substr(sha1(url), 1, 10)) AS source_pdf,
  list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM articles WHERE text IS NOT NULL),
u AS (SELECT article_id, source_pdf, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i FROM a)
SELECT article_id, source_pdf, i::INT AS sentence_index, length(line)::INT AS chars FROM u"""


def document_select(spark, folder):
    """Per language the ten longest documents, then by id."""
    d = table(spark, folder, "documents").filter("lang is not null")
    w = W.partitionBy("lang").orderBy(F.desc_nulls_last("n_chars"), "doc_id")
    return d.withColumn("place", F.row_number().over(w)).filter("place <= 10").select("lang", "place", "doc_id", "n_chars")


DOCUMENT_SELECT = """
SELECT lang, place::INT AS place, doc_id, n_chars FROM (SELECT lang, doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC NULLS LAST, doc_id) AS place FROM documents WHERE lang IS NOT NULL) WHERE place <= 10"""


def document_prompts(spark, folder):
    """F16, P25: prompts of the non-blank documents, as lengths and digests."""
    d = table(spark, folder, "documents").filter(F.trim("text") != "")
    prompt = F.format_string("Document %s, page %s\n---\n%s\n---\nList the facts.", F.coalesce("source", F.lit("?")), F.coalesce(F.col("page").cast("string"), F.lit("0")), F.col("text"))
    return d.select("doc_id", F.length(prompt).alias("chars"), F.md5(prompt).alias("digest"))


DOCUMENT_PROMPTS = """
WITH p AS (SELECT doc_id, 'Document ' || coalesce(source, '?') || ', page ' || coalesce(page::VARCHAR, '0') || chr(10) || '---' || chr(10) || text || chr(10) || '---' || chr(10) || 'List the facts.' AS prompt FROM documents WHERE trim(text, ' ') <> '')
SELECT doc_id, length(prompt)::INT AS chars, md5(prompt) AS digest FROM p"""

QUERIES = {
    "page_rebuild": (page_rebuild, PAGE_REBUILD), "esg_rule": (esg_rule, ESG_RULE), "esg_extract_stats": (esg_extract_stats, ESG_EXTRACT_STATS), "classify_summary": (classify_summary, CLASSIFY_SUMMARY),
    "score_flatten": (score_flatten, SCORE_FLATTEN), "sentence_first": (sentence_first, SENTENCE_FIRST), "line_merge": (line_merge, LINE_MERGE), "sentence_noise_profile": (sentence_noise_profile, SENTENCE_NOISE_PROFILE),
    "url_canonical": (url_canonical, URL_CANONICAL), "keyword_match": (keyword_match, KEYWORD_MATCH), "candidate_rank": (candidate_rank, CANDIDATE_RANK), "top_domains": (top_domains, TOP_DOMAINS),
    "coverage_report": (coverage_report, COVERAGE_REPORT), "date_normalize": (date_normalize, DATE_NORMALIZE), "legacy_article": (legacy_article, LEGACY_ARTICLE), "article_lines": (article_lines, ARTICLE_LINES),
    "ranked_select": (document_select, DOCUMENT_SELECT), "prompt_build": (document_prompts, DOCUMENT_PROMPTS),
}
