"""Column functions over text: names, lines, urls, dates and keys. All run in the JVM."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F

#: Legal forms and synonyms of organisation names, folded (fixed values).
LEGAL_FORMS = (
    "cong ty trach nhiem huu han", "tong cong ty", "cong ty co phan", "cong ty cp", "cong ty tnhh", "cong ty", "ctcp", "tnhh", "tap doan", "joint stock company",
    "joint stock", "corporation", "company", "co ltd", "ltd", "jsc", "j s c", "plc", "inc",
)
SYNONYMS = {"green": "xanh", "plastics": "plastic"}
#: Words of trades and countries that tell no company from another, folded (fixed values).
GENERIC = (
    "nhua", "plastic", "vat", "lieu", "xay", "dung", "material", "materials", "industry", "industries", "viet", "nam", "vietnam", "san", "xuat", "the", "and",
)
#: Misread letters of scanned reports (fixed values).
MISREAD = {"Ƣ": "U", "ƣ": "u"}
#: What a company's name begins or ends with beside its short name, the first match counting (fixed values).
PREFIXES = (
    "Tổng Công ty cổ phần ", "Tổng công ty cổ phần ", "Tổng Công ty ", "Tổng công ty ", "CTCP - Tổng Công ty ", "Công ty Tài chính Tổng hợp Cổ phần ", "CTCP Tập đoàn ", "Tập đoàn ",
    "CTCP ", "Công ty cổ phần ", "Công ty ",
)
SUFFIXES = (" - CTCP", " CTCP")
BANK = ("Ngân hàng TMCP ", "Ngân hàng ")


@lru_cache(1)
def fold_table() -> tuple[str, str]:
    """Letters with a plain Latin base and those bases, and all combining marks (mapped to nothing), by Unicode's rules."""
    source, target = ["đ"], ["d"]
    for c in range(0xA0, 0x2000):
        parts = unicodedata.normalize("NFD", chr(c))
        if len(parts) > 1 and parts[0].isascii() and all(unicodedata.category(p) == "Mn" for p in parts[1:]) and chr(c).islower():
            source.append(chr(c))
            target.append(parts[0])
    marks = [chr(c) for c in range(0x300, 0x370)]
    return "".join(source + marks), "".join(target)


def fold(c: Column) -> Column:
    """Lower case without accents (F1's first steps)."""
    return F.translate(F.lower(c), *fold_table())


def trim_all(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_name(c: Column) -> Column:
    """folded, only letters and digits, without legal forms, synonyms written out. Null stays null."""
    for a, b in MISREAD.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    c = F.concat(F.lit(" "), F.trim(F.regexp_replace(fold(c), "[^a-z0-9]+", " ")), F.lit(" "))
    for form in sorted(LEGAL_FORMS, key=len, reverse=True):
        c = F.replace(c, F.lit(f" {form} "), F.lit(" "))
    for a, b in SYNONYMS.items():
        c = F.replace(c, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(F.regexp_replace(c, " +", " "))


def name_tokens(c: Column) -> Column:
    """distinct words of the normalized name."""
    n = normalize_name(c)
    return F.when(n == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.split(n, " ")))


def core_tokens(c: Column) -> Column:
    """the words that tell an issuer from others."""
    return F.array_except(name_tokens(c), F.array(*map(F.lit, GENERIC)))


def short_name(c: Column) -> Column:
    """a company's name without the first prefix and the first suffix that it has; a bank keeps its kind."""
    c = F.trim(c)
    ahead = F.lit(None).cast("string")
    for p in reversed(PREFIXES):
        ahead = F.when(c.startswith(p), F.lit(p)).otherwise(ahead)
    bare = F.when(ahead.isNotNull(), F.substring(c, F.length(ahead) + 1, F.length(c))).otherwise(c)
    behind = F.lit(None).cast("string")
    for p in reversed(SUFFIXES):
        behind = F.when(bare.endswith(p), F.lit(p)).otherwise(behind)
    bare = F.trim(F.when(behind.isNotNull(), F.substring(bare, F.lit(1), F.length(bare) - F.length(behind))).otherwise(bare))
    return F.when(c.startswith(BANK[0]), F.concat(F.lit(BANK[1]), F.substring(c, F.lit(len(BANK[0]) + 1), F.length(c)))).otherwise(bare)


def vague_name(c: Column) -> Column:
    """A short name that can't be searched for by itself."""
    bare = F.replace(F.replace(c, F.lit("-"), F.lit("")), F.lit(" "), F.lit(""))
    return (F.length(c) <= 3) | bare.rlike("^[0-9]+$") | (~F.contains(F.trim(c), F.lit(" ")) & (F.length(c) <= 6))


def primary_name(props: Column) -> Column:
    """the first of name, term, title and claim_id that isn't empty, else empty."""
    return F.coalesce(*[F.nullif(props[k], F.lit("")) for k in ("name", "term", "title", "claim_id")], F.lit(""))


def merge_wrapped_lines(c: Column) -> Column:
    """A line break joins to a blank unless a sentence ends before it or a digit follows."""
    return F.regexp_replace(F.regexp_replace(c, r"[ \t]*\n[ \t]*", "\n"), r"(?<![.!?:;…])\n(?!\d)", " ")


def clean_page(c: Column) -> Column:
    """F4 without NFC: no soft hyphens, split words joined, blanks squeezed, at most one empty line."""
    c = F.regexp_replace(F.replace(c, F.lit("\u00ad"), F.lit("")), r"-\n(?=[a-zA-Zà-ỹ])", "")
    c = F.regexp_replace(c, r"[ \t\x{00A0}]+", " ")
    return trim_all(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def is_noise(c: Column) -> Column:
    """Page numbers, dot leaders, numeric rows, short lines."""
    return page_number(c) | dot_leader(c) | numeric_row(c) | too_short(c)


def page_number(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^\s*\d{1,4}\s*$"), F.lit(False))


def dot_leader(c: Column) -> Column:
    return F.coalesce(c.rlike(r"\.{6,}"), F.lit(False))


def numeric_row(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[0-9.,%()\s-]+$"), F.lit(False))


def too_short(c: Column) -> Column:
    return (F.length(c) < 25) | (F.size(F.split(F.trim(c), " +")) < 4)


def canonical_url(c: Column) -> Column:
    """no fragment, no slashes at the end."""
    return F.regexp_replace(F.regexp_replace(c, "#.*$", ""), "/+$", "")


def domain(c: Column) -> Column:
    """lower-case host without www., keeping a port."""
    return F.regexp_replace(F.lower(F.regexp_extract(c, "^[a-zA-Z]+://([^/?#]*)", 1)), r"^www\.", "")


def document_id(ticker: Column, url: Column) -> Column:
    """ticker, domain and ten digits of the url's sha1."""
    return F.concat_ws("__", ticker, domain(url), F.substring(F.sha1(url), 1, 10))


def normalize_date(c: Column) -> Column:
    """F32: an ISO date at the start; else day, month and year, by slashes or dashes, anywhere; else year and month as its first day; anything else trimmed."""
    c = F.trim(c)
    dmy = r"(\d{1,2})[/\-](\d{1,2})[/\-](\d{4})"
    return (
        F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(c, 1, 10))
        .when(c.rlike(dmy), F.concat_ws("-", F.regexp_extract(c, dmy, 3), F.lpad(F.regexp_extract(c, dmy, 2), 2, "0"), F.lpad(F.regexp_extract(c, dmy, 1), 2, "0")))
        .when(c.rlike(r"^\d{4}-\d{2}$"), F.concat(c, F.lit("-01")))
        .otherwise(c)
    )


def year_in_url(url: Column) -> Column:
    """the year that an address states by one of three patterns, or null."""
    stamp = F.regexp_extract(url, r"-(\d{4})\d{4}\d{6,}\.htm", 1)
    short = F.regexp_extract(url, r"185(\d{2})\d{4}\d+\.htm", 1)
    folder = F.regexp_extract(url, r"/(20[0-2]\d)/", 1)
    return F.when(stamp.try_cast("int").between(2005, 2030), stamp).when(short != "", F.concat(F.lit("20"), short)).when(folder != "", folder)


def article_year(date: Column, url: Column, now: Column) -> Column:
    """the year of the date, else of the address, else ``now``."""
    told = F.regexp_extract(normalize_date(F.coalesce(date, F.lit(""))), r"20[0-2]\d", 0)
    return F.coalesce(F.nullif(told, F.lit("")), year_in_url(url), now)


def year_of(*stamps: Column) -> Column:
    """the first four digits in a row found in the stamps in order, else empty."""
    found = [F.when(F.regexp_extract(s, r"\d{4}", 0) != "", F.regexp_extract(s, r"\d{4}", 0)) for s in stamps]
    return F.coalesce(*found, F.lit(""))


def summary(c: Column, n: int = 200) -> Column:
    """F27."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def key_of(*parts: Column) -> Column:
    """parts joined by a bar; a null is written None."""
    return F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("None")) for p in parts))


def safe_name(c: Column) -> Column:
    """anything but letters, digits and _ becomes _."""
    return F.regexp_replace(c, r"(?U)[^\w]", "_")


def file_name(c: Column) -> Column:
    """characters that file systems refuse become _."""
    return F.trim(F.regexp_replace(c, r'[\\/:*?"<>|\n\r\t]+', "_"))


def extension(c: Column) -> Column:
    """What follows the last dot of a file name, lower case with the dot; empty where there is none."""
    return F.lower(F.regexp_extract(c, r"(?<=[^/])(\.[^./]+)$", 1))


def recover_json(c: Column) -> Column:
    """fences and words around the outer brackets, comments outside strings and trailing commas removed."""
    c = F.regexp_replace(c, r"```(?:json)?", "")
    c = F.regexp_extract(c, r"(?s)(\{.*\}|\[.*\])", 1)
    c = F.regexp_replace(c, r'(?m)("(?:[^"\\]|\\.)*")|//[^\n]*|(?s:/\*.*?\*/)', "$1")
    return F.regexp_replace(c, r",\s*([}\]])", "$1")


def kpi_value(value: Column, unit: Column) -> Column:
    """(number, text, unit): a value ending in % gives the unit % where none is stated; what is no number stays text as it was."""
    pct = F.coalesce(value.endswith("%"), F.lit(False))
    bare = F.when(pct, F.regexp_replace(value, "%+$", "")).otherwise(value)
    number = F.when(bare.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), bare.try_cast("double"))
    return F.struct(number.alias("number"), F.when(number.isNull(), value).alias("text"), F.when(pct, F.coalesce(F.nullif(unit, F.lit("")), F.lit("%"))).otherwise(unit).alias("unit"))


def year_value(c: Column) -> Column:
    """a year of digits only as a whole number, else null (the text stays what it was)."""
    return F.when(c.rlike("^[0-9]+$"), c.try_cast("int"))
