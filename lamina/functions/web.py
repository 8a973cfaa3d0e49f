"""Column functions over pages, links and files."""

from __future__ import annotations

import html as _html
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lamina.functions import text as t

#: Parts of links to leave alone (fixed values). The last ones name pages without articles; one has a capital and so never occurs in a lower-case address.
SKIPPED = (
    "google.com", "youtube.com", "youtu.be", "facebook.com", "fb.com", "tiktok.com", "twitter.com", "x.com", "instagram.com", "linkedin.com",
    "/video/", "/videos/", "/photo/", "/gallery/", "/tag/", "/chuyen-muc/", ".pdf", ".zip", ".doc", ".xls",
    "/du-lieu/", "studocu", "staticfile.hsx", "static2.vietstock", "/Handlers/",
)
#: Names of sites that stand where an author should (fixed values).
WEAK_AUTHORS = ("vnexpress", "tuoi tre online", "vietnamnet news", "thanhnien.vn", "tuoitre.vn", "vietnamnet.vn")
#: Sources by a part of the address (fixed values).
SOURCES = {"vnexpress": "VnExpress", "tuoitre": "Tuổi Trẻ", "thanhnien": "Thanh Niên", "vietnamnet": "VietnamNet"}


def source_of(url: Column) -> Column:
    """the source whose part the address holds, the first in order, else Unknown."""
    out = F.lit("Unknown")
    for part, name in reversed(SOURCES.items()):
        out = F.when(F.contains(F.lower(url), F.lit(part)), name).otherwise(out)
    return out


def author_name(c: Column) -> Column:
    """The author, or empty where a site's name stands for one."""
    c = F.trim(c)
    return F.when(F.lower(c).isin(*WEAK_AUTHORS), "").otherwise(F.coalesce(c, F.lit("")))


def wanted_link(url: Column) -> Column:
    """An http address without any of the skipped parts."""
    low = F.lower(url)
    skip = F.lit(False)
    for part in SKIPPED:
        skip = skip | F.contains(low, F.lit(part))
    return F.coalesce(low.startswith("http") & ~skip, F.lit(False))


def annual_report_link(href: Column) -> Column:
    """Links to annual reports, by four patterns."""
    return F.coalesce(F.lower(href).rlike(r"bao-?cao-?thuong-?nien|annual-?report|bctn[-_ ]?\d{4}|\bar[-_ ]?20\d{2}"), F.lit(False))


def html_text(page: Column) -> Column:
    """A page's text: scripts, styles and tags dropped, entities of everyday use resolved, blanks squeezed."""
    c = F.regexp_replace(page, r"(?is)<(script|style|noscript)\b.*?</\1>", " ")
    c = F.regexp_replace(c, r"(?i)<(?:br|/p|/div|/h\d|/li|/tr)[^>]*>", "\n")
    c = F.regexp_replace(c, r"(?s)<[^>]+>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return t.trim_all(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r" ?\n[ \n]*", "\n"))


@F.pandas_udf(T.StringType())
def clean_text(s: pd.Series) -> pd.Series:
    """all HTML entities resolved, NFC, control characters dropped, ends trimmed; whole Arrow batches at a time."""
    whole = s.where(~s.str.contains("&", regex=False, na=False), s.map(_html.unescape, na_action="ignore"))
    return whole.str.normalize("NFC").str.replace(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", regex=True).str.strip()


@F.pandas_udf(T.StringType())
def repair_zip_name(s: pd.Series) -> pd.Series:
    """names in an archive that were read as code page 437: as UTF-8, else as Vietnamese Windows text, else as they are."""

    def one(x):
        if x is None or x.isascii():
            return x
        try:
            raw = x.encode("cp437")
        except UnicodeEncodeError:
            return x
        for charset in ("utf-8", "cp1258"):
            try:
                return unicodedata.normalize("NFC", raw.decode(charset))
            except UnicodeDecodeError:
                pass
        return x

    return s.map(one)


def _meta(page: Column, name: str) -> Column:
    got = F.regexp_extract(page, rf'(?is)<meta[^>]+(?:property|name)=["\']{name}["\'][^>]+content=["\']([^"\']+)', 1)
    return F.when(got != "", got)


def _first(*found: Column) -> Column:
    return F.coalesce(*[F.nullif(t.trim_all(c), F.lit("")) for c in found], F.lit(""))


def _tagged(page: Column, tag: str, cls: str | None) -> Column:
    """The text of the first element with the tag and class."""
    attr = rf'[^>]*class=["\'][^"\']*\b{cls}\b[^"\']*["\'][^>]*' if cls else "[^>]*"
    return F.regexp_replace(F.regexp_extract(page, rf"(?is)<{tag}\b{attr}>(.*?)</{tag}>", 1), r"(?s)<[^>]+>", "")


def page_metadata(page: Column, url: Column) -> Column:
    """title, date, author and site of a page, each from the first place that states it: meta tags
    (a title of more than ten characters, an author who isn't the site), linked data, marked elements, the address."""
    def ld(key):  # a key of the page's linked data
        return F.regexp_extract(page, rf'(?is)<script[^>]*ld\+json[^>]*>(?:(?!</script>).)*?"{key}"\s*:\s*"([^"]+)"', 1)

    og = _meta(page, "og:title")
    time = F.regexp_extract(page, r'(?is)<time[^>]*\bdatetime=["\']([^"\']+)', 1)
    stamp, short = r"-(\d{4})(\d{2})(\d{2})\d{6,}\.htm", r"185(\d{2})(\d{2})(\d{2})\d+\.htm"
    by_address = F.when(url.rlike(stamp), F.concat_ws("-", *[F.regexp_extract(url, stamp, k) for k in (1, 2, 3)])).when(
        url.rlike(short), F.concat(F.lit("20"), F.concat_ws("-", *[F.regexp_extract(url, short, k) for k in (1, 2, 3)])))
    heads = [_tagged(page, "h1", c) for c in ("title-detail", "article-title", "detail__title", "content-detail-title", None)]
    dates = [_tagged(page, tag, c) for tag, c in (("span", "date"), ("div", "date-time"), ("div", "detail__time"), ("div", "bread-crumb-detail__time"))]
    authors = [_tagged(page, tag, c) for tag, c in (("p", "author_mail"), ("span", "author"), ("span", "author-name"), ("div", "detail__author"), ("p", "article-author"))]
    person = F.regexp_extract(page, r'(?is)<script[^>]*ld\+json[^>]*>(?:(?!</script>).)*?"author"\s*:\s*\[?\s*\{[^}]*"name"\s*:\s*"([^"]+)"', 1)
    return F.struct(
        _first(F.when(F.length(og) > 10, og), ld("headline"), *heads).alias("title"),
        t.normalize_date(_first(_meta(page, "article:published_time"), ld("datePublished"), *dates, time, by_address)).alias("date"),
        _first(author_name(_meta(page, "author")), person, *authors).alias("author"),
        _first(_meta(page, "og:site_name"), t.domain(url)).alias("site"),
    )


def context(c: Column, anchor: str, before: int, after: int) -> Column:
    """What stands around the first place of ``anchor``; null where it isn't there."""
    at = F.instr(c, anchor)
    return F.when(at > 0, F.substring(c, F.greatest(F.lit(1), at - before), F.lit(before + len(anchor) + after)))


def first_mirror(mirrors: DataFrame, key: str, needle: str) -> DataFrame:
    """Per key the mirror of least priority that answered 200 with the needle in its body."""
    ok = mirrors.filter((F.col("status") == 200) & F.contains("body", F.lit(needle)))
    return ok.groupBy(key).agg(F.min_by("url", "priority").alias("url"))


def year_text(c: Column) -> Column:
    """whole numbers as text, nothing as NA, anything else as a safe name."""
    n = c.try_cast("double")
    return F.when(c.isNull() | (F.lower(F.trim(c)) == "nan"), "NA").when(n.isNotNull(), F.floor(n).cast("string")).otherwise(t.file_name(c))


def target_path(sheet: Column, ticker: Column, name: Column, year: Column, extension: Column) -> Column:
    """sheet/ticker - name/ticker_year.ext"""
    return F.concat_ws("/", t.file_name(sheet), F.concat(t.file_name(ticker), F.lit(" - "), t.file_name(name)), F.concat(t.file_name(ticker), F.lit("_"), year_text(year), F.lit("."), extension))


def year_bounds(year: Column) -> Column:
    """a year's first and last second, UTC."""
    return F.struct(F.unix_timestamp(F.make_timestamp(year, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0), F.lit("UTC"))).alias("first"), (F.unix_timestamp(F.make_timestamp(year + 1, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0), F.lit("UTC"))) - 1).alias("last"))
