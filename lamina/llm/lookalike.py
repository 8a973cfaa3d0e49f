"""Equal-looking text made of different characters (problem 3).

Words with unusual characters are collected once each, exploded to positioned code
points, broadcast-joined to the decomposition and look-alike tables, their combining
marks ordered by class, recomposed and rebuilt; rows get their words back by position.
Texts without any character of the tables can't change and skip all that; the scan for
such characters is one vectorised pass that also leaves out the cases of problem 1.

Null texts stay null, empty texts empty; a row's key (source_table, row_id) is unique.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lamina.llm import garbled
from lamina.session import spread

#: Letters of other scripts and rare Latin letters that look like usual ones (fixed values).
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТХУаеѕіјорсхуһԁԛԝґѵӏүЗ"[:-1], "ABESIJKMHOPCTXYaesijopcxyhdqwrvly"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονιρυκ", "ABEZHIKMNOPTYXovipuk"))
ARMENIAN = dict(zip("օսոհցՕՍ", "ounhgOU"))
LATIN = dict(zip("ƢƣƉÐɑɡʋɩ", "ƯưĐĐagvi"))
ALIKE = CYRILLIC | GREEK | ARMENIAN | LATIN
INVISIBLE = "­᠎​‌‍‎‏⁠﻿\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069"
SPACES = "   -   　"
FULL_WIDTH = "０-９Ａ-Ｚａ-ｚ"
MARKS = "\u0300-\u036f\u3099\u309a"
#: Parts of Korean syllables (leading consonants, vowels, trailing consonants), and letters in the styles of mathematics.
JAMO, STYLED = "\u1100-\u1112\u1161-\u1175\u11a8-\u11c2", "\U0001d400-\U0001d7ff"
LAST = 0x30000


@lru_cache(1)
def singletons() -> str:
    """Letters that canonical composition replaces by another one (Kelvin and Angstrom signs, compatibility ideographs)."""
    return "".join(c for c in map(chr, range(0x80, LAST)) if unicodedata.category(c) in ("Lu", "Ll", "Lo") and unicodedata.normalize("NFC", c) != c and len(unicodedata.normalize("NFC", c)) == 1 and unicodedata.normalize("NFC", c) != "\u03a9")


WORD_CHARS = f"[{INVISIBLE}{FULL_WIDTH}{MARKS}{''.join(ALIKE)}]"
_word = re.compile(f"[\\w{MARKS}{INVISIBLE}]+|[{SPACES}]")
_odd = re.compile(f"[{SPACES}{INVISIBLE}{FULL_WIDTH}{MARKS}{JAMO}{STYLED}{''.join(ALIKE)}{singletons()}]")


@lru_cache(1)
def unusual_codes() -> np.ndarray:
    """Whether each character below LAST is one that the tables change; none beyond is."""
    out = np.zeros(LAST + 1, bool)
    for c in range(0x80, LAST):
        out[c] = bool(_odd.match(chr(c)))
    return out


@lru_cache(1)
def decompositions() -> list[tuple[str, int, str, int, str]]:
    """(character, k, k-th character it stands for, that one's combining class, kind), by Unicode's own rules.

    Kinds: canon, full (full width), styled (in a style of mathematics), single (replaced by composition), mark, jamo,
    hidden, alike:<script>. As many rows as Unicode has such letters.
    """
    rows, jamo, alone = [], re.compile(f"[{JAMO}]"), set(singletons())
    for c in range(0x80, LAST):
        ch = chr(c)
        kind = "canon"
        if ch in alone:
            rows.append((ch, 0, unicodedata.normalize("NFC", ch), 0, "single"))
            continue
        if 0x1D400 <= c < 0x1D800 and unicodedata.category(ch) in ("Lu", "Ll", "Nd") and unicodedata.normalize("NFKC", ch).isascii():
            rows.append((ch, 0, unicodedata.normalize("NFKC", ch), 0, "styled"))
            continue
        if jamo.match(ch):
            rows.append((ch, 0, ch, 0, "jamo"))
            continue
        if ch in INVISIBLE:
            rows.append((ch, 0, "", 0, "hidden"))
            continue
        if ch in ALIKE:
            kind = "alike:" + unicodedata.name(ch).split()[0]
            rows.append((ch, 0, ALIKE[ch], 0, kind))
            continue
        if 0xFF10 <= c <= 0xFF5A and unicodedata.category(ch) in ("Lu", "Ll", "Nd"):
            rows.append((ch, 0, unicodedata.normalize("NFKC", ch), 0, "full"))
            continue
        if unicodedata.combining(ch) and (0x300 <= c <= 0x36F or c in (0x3099, 0x309A)):
            kind = "mark"
        parts = unicodedata.normalize("NFD", ch)
        if kind == "mark" or (len(parts) > 1 and not 0xAC00 <= c <= 0xD7A3):
            rows += [(ch, k, x, unicodedata.combining(x), kind) for k, x in enumerate(parts)]
    return rows


@lru_cache(1)
def compositions() -> str:
    """JSON of (letter + mark) -> composed letter, for all that Unicode composes."""
    out = {}
    for c in range(0xC0, 0x3100):
        parts = unicodedata.decomposition(chr(c))
        if parts and "<" not in parts and " " in parts and unicodedata.normalize("NFC", chr(c)) == chr(c):
            out["".join(chr(int(x, 16)) for x in parts.split())] = chr(c)
    return json.dumps(out)


def recompose(parts: Column) -> Column:
    """The word of ordered parts (out, ccc): each mark joins its letter where a composed form exists."""
    table = F.from_json(F.lit(compositions()), "map<string,string>")
    empty = F.struct(F.lit("").alias("done"), F.lit("").alias("letter"), F.lit("").alias("rest"), F.lit(0).alias("ccc"))

    def step(acc, x):
        # A leading consonant and a vowel make a Korean syllable, a trailing consonant completes it: by arithmetic, as Unicode has it.
        a, b = F.ascii(acc["letter"]), F.ascii(x["out"])
        pair = (acc["rest"] == "") & a.between(0x1100, 0x1112) & b.between(0x1161, 0x1175)
        third = (acc["rest"] == "") & a.between(0xAC00, 0xD7A3) & ((a - 0xAC00) % 28 == 0) & b.between(0x11A8, 0x11C2)
        code = F.when(pair, F.lit(0xAC00) + ((a - 0x1100) * 21 + (b - 0x1161)) * 28).when(third, a + (b - 0x11A7))
        syllable = F.decode(F.unhex(F.hex(code.cast("long"))), "UTF-16BE")
        built = F.struct(acc["done"].alias("done"), syllable.alias("letter"), F.lit("").alias("rest"), F.lit(0).alias("ccc"))
        joined = F.when((acc["rest"] == "") | (acc["ccc"] < x["ccc"]), F.element_at(table, F.concat(acc["letter"], x["out"])))
        started = F.struct(F.concat(acc["done"], acc["letter"], acc["rest"]).alias("done"), x["out"].alias("letter"), F.lit("").alias("rest"), F.lit(0).alias("ccc"))
        grown = F.struct(acc["done"].alias("done"), joined.alias("letter"), acc["rest"].alias("rest"), acc["ccc"].alias("ccc"))
        kept = F.struct(acc["done"].alias("done"), acc["letter"].alias("letter"), F.concat(acc["rest"], x["out"]).alias("rest"), x["ccc"].alias("ccc"))
        return F.when(pair | third, built).when(x["ccc"] == 0, started).when(joined.isNotNull(), grown).otherwise(kept)

    return F.aggregate(parts, empty, step, lambda a: F.concat(a["done"], a["letter"], a["rest"]))


def one_form(words: DataFrame) -> DataFrame:
    """(word, fixed, kind) of distinct words: kind is null where the word is as it should be,
    ``sure``, or the script all of whose letters look like Latin ones (the row decides)."""
    spark = words.sparkSession
    schema = T.StructType([T.StructField(n, t) for n, t in (("ch", T.StringType()), ("k", T.IntegerType()), ("to", T.StringType()), ("ccc", T.IntegerType()), ("why", T.StringType()))])
    table = F.broadcast(spark.createDataFrame(decompositions(), schema))
    points = words.select("word", F.posexplode(F.split("word", "")).alias("pos", "ch")).filter("ch <> ''").join(table, "ch", "left")
    latin = F.col("ch").rlike(r"\p{IsLatin}") & (F.col("why").isNull() | ~F.col("why").startswith("alike"))
    other = F.col("ch").rlike(r"\p{L}") & ~F.col("ch").rlike(r"\p{IsLatin}") & (F.col("why").isNull() | ~F.col("why").startswith("alike"))
    part = F.struct("pos", F.coalesce("k", F.lit(0)).alias("k"), F.coalesce("to", "ch").alias("out"), F.coalesce("ccc", F.lit(0)).alias("ccc"), F.coalesce("why", F.lit("")).alias("why"), F.col("ch"))
    script = F.regexp_extract("why", "alike:(.*)", 1)
    grouped = points.groupBy("word").agg(
        F.sort_array(F.collect_list(part)).alias("parts"),
        F.max(latin).alias("latin"), F.max(other).alias("other"),
        F.max(F.coalesce(F.col("why").isin("full", "single"), F.lit(False))).alias("full"),
        F.max(F.coalesce(F.col("why") == "styled", F.lit(False))).alias("styled"),
        F.max(F.coalesce(F.col("why").isin("mark", "jamo"), F.lit(False))).alias("mark"),
        F.max(F.coalesce(F.col("why") == "alike:LATIN", F.lit(False))).alias("rare"),
        F.max(F.when(F.col("why").startswith("alike:") & (F.col("why") != "alike:LATIN"), script)).alias("script"),
    )
    # Look-alikes are replaced only where the rest of the word is Latin, or where there is no rest.
    apply = F.col("latin") | ~F.col("other")
    mapped = F.transform("parts", lambda x: F.when(x["why"].startswith("alike:") & ~apply, x.withField("out", x["ch"])).otherwise(x))
    # Canonical order: the letter a mark belongs to, then its class, then its place.
    placed = F.aggregate(
        mapped,
        F.struct(F.lit(0).alias("n"), F.expr("cast(array() as array<struct<n:int,ccc:int,pos:int,k:int,out:string>>)").alias("all")),
        lambda acc, x: F.struct(
            (acc["n"] + (x["ccc"] == 0).cast("int")).alias("n"),
            F.concat(acc["all"], F.array(F.struct((acc["n"] + (x["ccc"] == 0).cast("int")).alias("n"), x["ccc"].alias("ccc"), x["pos"].alias("pos"), x["k"].alias("k"), x["out"].alias("out")))).alias("all"),
        ),
        lambda acc: F.sort_array(acc["all"]),
    )
    done = grouped.withColumn("fixed", recompose(placed))
    bare = F.regexp_replace("word", f"[{INVISIBLE}]", "")
    inside = F.regexp_replace("word", f"^[{INVISIBLE}]+|[{INVISIBLE}]+$", "").rlike(f"[{INVISIBLE}]") & ~F.col("word").rlike(r"[\p{IsArabic}\p{IsDevanagari}\p{IsBengali}\p{IsTamil}\p{IsMalayalam}\p{IsKhmer}]")
    composed = F.col("mark") & (F.length("fixed") < F.length(bare))
    sure = F.col("full") | (F.col("styled") & (F.length("word") > 1)) | inside | composed | F.col("rare") | (F.col("script").isNotNull() & F.col("latin") & ~F.col("other"))
    whole = F.col("script").isNotNull() & ~F.col("other") & ~F.col("latin")
    kind = F.when(sure, "sure").when(whole, F.col("script"))
    return done.select("word", "fixed", kind.alias("kind"))


def cut_words(text: str) -> list[str]:
    """The text in pieces, its unusual words and spaces at the odd places."""
    out, at = [], 0
    for m in _word.finditer(text):
        if _odd.search(m[0]):
            out += [text[at : m.start()], m[0]]
            at = m.end()
    out.append(text[at:])
    return out


def cut_unusual(rows: DataFrame, model: garbled.PairModel | None, usual: bool = False) -> DataFrame:
    """(key, pieces) of the rows (key, text) with unusual characters, or with ``usual`` of all the others, whole.

    Sentences that problem 1 finds garbled by ``model`` count as usual.
    """
    sc = rows.sparkSession.sparkContext
    shared = sc.broadcast((model.pairs, model.chars, model.total)) if model else None

    def run(batches):
        import pyarrow as pa

        own = garbled.PairModel.shared(*shared.value) if shared else None
        table = unusual_codes()
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            live = [i for i, t in enumerate(texts) if t]
            cut = {}
            if live:
                codes, starts = garbled.codes_of([texts[i] for i in live])
                odd = np.concatenate([[0], np.cumsum(table[np.minimum(codes, LAST)])])
                ends = np.append(starts[1:] - 1, len(codes))
                picked = [live[i] for i in np.flatnonzero(odd[ends] > odd[starts])]
                if own and picked:
                    names = keys.field(0)
                    checked = [i for i in picked if names[i].as_py() == "sentences"]
                    if checked:
                        hot = garbled.suspicious(own, [texts[i] for i in checked])
                        wrong = {i for i, h in zip(checked, hot) if h and garbled.restore_text(own, texts[i])[1]}
                        picked = [i for i in picked if i not in wrong]
                cut = {i: cut_words(texts[i]) for i in picked}
            at = [i for i in range(len(texts)) if i not in cut] if usual else sorted(cut)
            out = [cut.get(i, None if texts[i] is None else [texts[i]]) for i in at]
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), pa.array(out, pa.list_(pa.string()))], ["key", "pieces"])

    kind = rows.schema["key"].dataType.simpleString()
    return spread(rows.select("key", "text")).mapInArrow(run, f"key {kind}, pieces array<string>")


def judged(cut: DataFrame) -> DataFrame:
    """(key, pos, fixed, case) of the unusual words and spaces of ``cut`` (key, pieces)."""
    genuine = {"CYRILLIC": f"[\\p{{IsCyrillic}}&&[^{''.join(CYRILLIC)}]]", "GREEK": f"[\\p{{IsGreek}}&&\\p{{Ll}}&&[^{''.join(GREEK)}μπΩσαβγδελθ]]", "ARMENIAN": f"[\\p{{IsArmenian}}&&[^{''.join(ARMENIAN)}]]"}
    spread = cut.filter(F.size("pieces") > 1).select("key", "pieces", F.posexplode("pieces").alias("pos", "word")).filter("pos % 2 = 1")
    other = F.array_join("pieces", "")
    whole = F.col("word").rlike("^[" + "".join(CYRILLIC) + "]+$|^[" + "".join(GREEK) + "]+$|^[" + "".join(ARMENIAN) + "]+$")
    beside = F.when(whole, F.array_compact(F.array(*[F.when(other.rlike(p), F.lit(s)) for s, p in genuine.items()])))
    spread = spread.select("key", "pos", "word", beside.alias("beside"))
    words = one_form(spread.select("word").filter(~F.col("word").rlike(f"^[{SPACES}]$")).distinct())
    space = F.col("word").rlike(f"^[{SPACES}]$")
    case = space | (F.col("kind") == "sure") | (F.col("kind").isNotNull() & ~F.coalesce(F.array_contains("beside", F.col("kind")), F.lit(False)))
    fixed = F.when(space, F.lit(" ")).when(case, F.col("fixed")).otherwise(F.col("word"))
    return spread.join(words, "word", "left").select("key", "pos", fixed.alias("fixed"), F.coalesce(case, F.lit(False)).alias("case"))


def unusual_rows(rows: DataFrame, model: garbled.PairModel | None = None) -> DataFrame:
    """Keys of the rows (key, text) with characters that only look like the usual ones."""
    return judged(cut_unusual(rows, model)).filter("case").select("key").distinct()


def normalized(rows: DataFrame, model: garbled.PairModel | None = None) -> DataFrame:
    """All rows (key, text) with the text in one form. Texts without unusual characters pass by as they are read;
    only those with some meet their words' other forms."""
    cut = cut_unusual(rows, model)
    fixes = judged(cut).filter("case").groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("pos", "fixed"))).alias("fixes"))
    pieces = F.transform("pieces", lambda p, i: F.coalesce(F.col("fixes")[i], p))
    changed = cut.join(fixes, "key", "left").select("key", F.when(F.col("fixes").isNull(), F.array_join("pieces", "")).otherwise(F.array_join(pieces, "")).alias("text"))
    return cut_unusual(rows, model, usual=True).select("key", F.col("pieces")[0].alias("text")).unionByName(changed)


def _key(name: str, column: str) -> Column:
    return F.struct(F.lit(name).alias("source_table"), F.col(column).alias("row_id")).alias("key")


def p3_texts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    s = spark.read.parquet(f"{folder}/sentences.parquet").select(_key("sentences", "seq"), "text")
    return s, spark.read.parquet(f"{folder}/articles.parquet").select(_key("articles", "article_id"), "text")


def p3_found(spark, folder):
    s, a = p3_texts(spark, folder)
    return unusual_rows(s.unionAll(a), garbled.count_pairs(garbled.p1_texts(spark, folder).select("text"))).select("key.source_table", "key.row_id")


def p3_normalized(spark, folder):
    s, a = p3_texts(spark, folder)
    return normalized(s.unionAll(a), garbled.count_pairs(garbled.p1_texts(spark, folder).select("text"))).select("key.source_table", "key.row_id", "text")
