"""Sentence units across languages and scripts (problem 6).

Breaks follow the standard sentence-break rules over Unicode's Sentence_Break property: a
terminator of any script (STerm, ATerm), its closing marks (Close), blanks, then a character
that can begin a sentence and doesn't continue one (SContinue). The language of the line
decides which abbreviations suppress a break; initials, list numbers and decimals do in all.
A closing quotation mark keeps the words that name the speaker with the quotation. Scripts
with full-width terminators break right after them; in Thai a blank separates. Line breaks
always separate.

Null and blank texts give no unit; rows that problem 1 finds garbled give no found breaks.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from lamina.llm import garbled
from lamina.llm.lookalike import ALIKE, INVISIBLE
from lamina.session import spread

#: Abbreviations that something always follows, by language, folded to lower case (fixed values).
ABBREVIATIONS = {
    "vi": frozenset("tp tx tt kcn cty q p h tr đ ths ts pgs gs bs ks ls nxb stt mr mrs ms dr".split()),
    "en": frozenset("mr mrs ms dr prof st approx vs cf e.g i.e eg ie ca".split()),
    "fr": frozenset("m mm mme mlle dr st ste ca cf".split()),
    "es": frozenset("sr sra srta dr dra ud uds".split()),
}
#: Abbreviations that only a number follows, in any language (fixed values).
NUMBERED = frozenset("no nos fig figs sec art vol p pp núm nr".split())
#: Words that tell a text's language where its letters don't (fixed values).
TELLING = {"fr": re.compile(r"\b(?:le|les|des|du|une|est|dans)\b", re.I), "es": re.compile(r"\b(?:el|los|las|del|una|por|con)\b|[¿¡ñ]", re.I)}
_vietnamese = re.compile("[ăđơưĂĐƠƯ\u1ea0-\u1ef9]")

#: Forms of address and words of saying that tell that what follows a quotation names its speaker (fixed values).
ADDRESS = re.compile(r"(?:[ÔôBbAaCc](?:ng|à|nh|hị|ô)|ThS|TS|PGS|GS|BS|KS|LS|Mr|Mrs|Ms|Dr|Prof|Mme|Mlle|M|Sr|Sra)\b")
SAYING = re.compile(
    "nói|kể|cho biết|cho hay|khẳng định|nhấn mạnh|chia sẻ|trả lời|hỏi|thừa nhận|phát biểu|giải thích|nhận định|phân trần|cam kết|cảnh báo|lưu ý|"
    r"\b(?:said|says|told|added|asked|replied|explained|noted|wrote|warned|dit|déclar\w*|ajout\w*|dijo|declar\w*|añad\w*)\b|"
    "说|說|表示|指出|称|介绍|述べ|話し|語っ|言っ|말했|밝혔|전했|กล่าว",
    re.I,
)


@lru_cache(1)
def properties() -> dict[str, str]:
    """Characters by the Sentence_Break property, of all planes, as Unicode has them."""
    import regex

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    return {n: "".join(regex.findall(rf"\p{{SB={n}}}", every)) for n in ("STerm", "ATerm", "Close", "SContinue")}


def _kinds(name: str, *kinds: str) -> str:
    return "".join(c for c in properties()[name] if unicodedata.category(c) in kinds)


ATERM = frozenset(properties()["ATerm"])
#: Terminators: STerm and ATerm; an ellipsis ends a sentence too where one can begin after it.
STOPS = properties()["STerm"] + properties()["ATerm"] + "…"
CONTINUES = frozenset(properties()["SContinue"])
#: Of the property Close: marks that open and close, brackets and quotation marks apart; the straight ones do both.
QUOTES_OPENING = frozenset(_kinds("Close", "Pi") + "„‚「『《〈〝｢") - set("»›")
BRACKETS_OPENING = frozenset(_kinds("Close", "Ps")) - QUOTES_OPENING
OPENING = QUOTES_OPENING | BRACKETS_OPENING | set("\"'¿¡")
QUOTES_CLOSING = frozenset(_kinds("Close", "Pf") + "」』》〉〞〟｣")
CLOSING = _kinds("Close", "Pe", "Pf") + "\"'"
WIDE = frozenset("。！？｡")

_class = "".join(f"\\U{ord(c):08x}" for c in STOPS)
_stop = re.compile(f"[{_class}]+[" + re.escape(CLOSING) + r"]*")
_stops = re.compile(f"[{_class}]+")
_thai = re.compile(r"(?<=[฀-๿])[^\S\n]+(?=[฀-๿])")
_before = re.compile(rf"[\w.{INVISIBLE}̀-ͯ]+$")
_list = re.compile(r"[\W_]*(?:[IVXLC]+|\d{1,3}(?:\.\d{1,3})*|\w)[.)]?$")
_fold = str.maketrans(ALIKE | dict.fromkeys(INVISIBLE, ""))


def languages(text: str, line: str) -> list[str]:
    """Languages whose abbreviations count in a line: Vietnamese by its letters (in the line, or in the text where the line has
    no words of another), else French or Spanish by their commonest words, else English."""
    if _vietnamese.search(line):
        return ["vi", "en"]
    told = [k for k, p in TELLING.items() if len(p.findall(line)) > 1]
    return told + ["en"] + (["vi"] if _vietnamese.search(text) else [])


def names_speaker(text: str, at: int) -> bool:
    """Whether the words from ``at`` on, after a quotation, name its speaker: they go on in lower case, with a form of address, or with a word of saying."""
    c = text[at]
    if c.islower() or ADDRESS.match(text, at):
        return True
    end = _stop.search(text, at)
    line = text.find("\n", at)
    stop = min(end.start() if end else len(text), line if line >= 0 else len(text))
    plain = unicodedata.normalize("NFKC", text[at:stop].translate(_fold))
    return c == "と" or bool(SAYING.search(text, at, stop) or ADDRESS.match(plain) or SAYING.search(plain)) or not (c.isupper() or c.isdigit() or unicodedata.category(c) == "Lo")


_any_abbreviation = frozenset().union(*ABBREVIATIONS.values())


def _word_before(text: str, at: int) -> str:
    m = _before.search(text, max(0, at - 16), at)
    w = m[0] if m else ""
    if not w.isascii():
        w = unicodedata.normalize("NFKC", w.translate(_fold))
    return w.lstrip(".")


def _may_begin(text: str, at: int, gap: bool) -> bool:
    """Whether a sentence can begin with the character at ``at``."""
    c = text[at]
    if c in OPENING:
        rest = text[at + 1 : at + 4].lstrip()
        return c not in BRACKETS_OPENING and c != "'" and bool(rest) and (rest[0].isupper() or rest[0].isdigit() or unicodedata.category(rest[0]) == "Lo" or rest[0] in OPENING)
    if c.isupper():
        return True
    if c.isdigit():
        return gap
    return unicodedata.category(c) == "Lo" and c not in "ªº"


def breaks(text: str) -> list[int]:
    """Places in ``text`` where, inside a line, a new sentence begins."""
    out = []
    for m in _stop.finditer(text):
        marks = m[0]
        k = _stops.match(marks).end()
        stop, closers = marks[:k], marks[k:]
        end = m.end()
        if closers:
            line = text.rfind("\n", 0, m.start()) + 1
            quoted = False
            for i, c in enumerate(closers):
                if c == '"' and text.count('"', line, m.start() + k + i) % 2 == 0 or c == "'" and (end == len(text) or text[m.start() + k + i + 1 : m.start() + k + i + 2].isalnum()):
                    closers, end = closers[:i], m.start() + k + i  # it opens what follows
                    break
                quoted |= c in QUOTES_CLOSING or c == '"'
        else:
            quoted = False
        n = len(text)
        at = end
        while at < n and text[at] != "\n" and text[at].isspace():
            at += 1
        if at >= n or text[at] == "\n":
            continue
        gap = at > end
        if not quoted and text[at] in "»”" and gap:  # a closing mark set off by a blank
            continue
        if quoted and text[at] not in QUOTES_OPENING and text[at] != '"' and names_speaker(text, at):
            continue
        if text[at] in CONTINUES:
            continue
        if stop[-1] in WIDE:
            if text[at] not in CLOSING or text[at] == '"':
                out.append(at)
            continue
        if not _may_begin(text, at, gap):
            continue
        if stop[-1] in ATERM:
            if len(stop) > 3 and text[at].isdigit():
                continue  # dot leaders
            word = _word_before(text, m.start())
            bare = word.rpartition(".")[2]
            low = word.lower()
            if low in NUMBERED and text[at].isdigit():
                continue
            if low in _any_abbreviation:
                start = text.rfind("\n", 0, m.start()) + 1
                end_ = text.find("\n", at)
                if any(low in ABBREVIATIONS[k] for k in languages(text, text[start : end_ if end_ >= 0 else n])):
                    continue
            ahead = text[m.start() - len(word) - 1] if m.start() > len(word) else " "
            if len(bare) == 1 and bare.isalpha() and not _east(bare) and ahead not in "/°":
                continue  # an initial, not the end of a unit as in mg/l
            if not word and not closers:
                previous = text[m.start() - 1 : m.start()]
                if not previous or previous.isspace():
                    continue
            line = text.rfind("\n", 0, m.start()) + 1
            if m.start() - line < 12 and _list.match(text, line, m.start()) and _list.match(text, line, m.start()).end() == m.start():
                continue  # a list's number
            if not gap and unicodedata.category(text[at]) == "Lo" and not _east(text[m.start() - 1]):
                continue
            if not gap and len(bare) > 1 and bare.isupper() and text[at].isupper() and not any(c.isdigit() for c in bare):
                continue  # dotted capitals
        elif not gap and m.start() and not text[m.start() - 1].isalnum() and stop[-1] == "…" and text[m.start() - 1].isspace():
            continue
        out.append(at)
    if "฀" <= max(text, default="") and _thai.search(text):
        out = sorted(set(out) | {m.end() for m in _thai.finditer(text)})
    return out


def _east(c: str) -> bool:
    return "฀" <= c


def found_breaks(rows: DataFrame, model: garbled.PairModel | None) -> DataFrame:
    """(key, next_start) of rows (key struct<source_table,row_id>, text)."""
    shared = rows.sparkSession.sparkContext.broadcast((model.pairs, model.chars, model.total)) if model else None

    def run(batches):
        import pyarrow as pa

        own = garbled.PairModel.shared(*shared.value) if shared else None
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            wrong = set()
            if own:
                names = keys.field(0).to_pylist()
                checked = [i for i, t in enumerate(texts) if t and names[i] == "sentences"]
                if checked:
                    hot = garbled.suspicious(own, [texts[i] for i in checked])
                    wrong = {checked[k] for k in np.flatnonzero(hot) if garbled.restore_text(own, texts[checked[k]])[1]}
            at, starts = [], []
            for i, t in enumerate(texts):
                if t and i not in wrong:
                    b = breaks(t)
                    at += [i] * len(b)
                    starts += b
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), pa.array(starts, pa.int32())], ["key", "next_start"])

    return spread(rows.select("key", "text")).mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, next_start int")


def sentence_units(rows: DataFrame) -> DataFrame:
    """(key, unit, start_char, sentence) of rows (key, text): every sentence of every row, from 1."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at, unit, start, out = [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                if not t:
                    continue
                cuts = sorted({0, *breaks(t), *(m.end() for m in re.finditer("\n", t))}) + [len(t)]
                k = 0
                for a, b in zip(cuts, cuts[1:]):
                    s = t[a:b]
                    if s.strip():
                        k += 1
                        at.append(i)
                        unit.append(k)
                        start.append(a + len(s) - len(s.lstrip()))
                        out.append(s.strip())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(unit, pa.int32()), pa.array(start, pa.int32()), pa.array(out, pa.string())], ["key", "unit", "start_char", "sentence"])

    return rows.select("key", "text").mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, unit int, start_char int, sentence string")


def p6_texts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    def of(name, column):
        key = F.struct(F.lit(name).alias("source_table"), F.col(column).alias("row_id")).alias("key")
        return spark.read.parquet(f"{folder}/{name}.parquet").select(key, "text")

    return of("sentences", "seq"), of("articles", "article_id")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    s, a = p6_texts(spark, folder)
    return found_breaks(s.unionAll(a), garbled.count_pairs(garbled.p1_texts(spark, folder).select("text"))).select("key.source_table", "key.row_id", "next_start")


def p6_sentences(spark: SparkSession, folder: str) -> DataFrame:
    s, a = p6_texts(spark, folder)
    return sentence_units(s.unionAll(a)).select("key.source_table", "key.row_id", "unit", "start_char", "sentence")
