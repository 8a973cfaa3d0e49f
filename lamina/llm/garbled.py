"""Text read with a wrong character encoding (problem 1).

Adjacent character pairs are counted over the whole corpus; a text's pairs are scored
by their mutual information, runs of improbable pairs are isolated as maximum-scoring
segments, and only inside such runs are inverse mappings tried. A run is garbled where
a mapping makes it more probable, or where it holds replacement characters.

The pair model is a table of fixed size (hashed pairs and characters), so what is
broadcast doesn't grow with the data.

Null and empty texts are never garbled and stay as they are; repeated rows count each.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lamina.session import spread

PAIR_BITS, CHAR_BITS = 19, 16
#: A pair is improbable from so many bits on; a text is looked into from so many bits beyond that in one run.
PAIR_COST, RUN_COST = 8.5, 2.0
#: Bits that an inverse mapping must gain over a run.
GAIN = 7.0
REPLACEMENT = "�"

SYMBOL, LETTER, ODD, FOREIGN, QUOTE = 1, 2, 3, 4, 5
#: Cost in bits of a run from which a text of any script is looked into.
WHOLE_RUN_COST = 16.0


@lru_cache(1)
def char_classes() -> np.ndarray:
    """Class of each character below 2**16: symbol (no letter, digit, blank or plain punctuation), odd,
    letter, foreign letter (Latin and not Vietnamese, or Cyrillic: what wrong readings give), and quotation mark."""
    out = np.zeros(1 << 16, np.uint8)
    home = set("aăâeêioôơuưy") | {unicodedata.normalize("NFC", v + m) for v in "aăâeêioôơuưy" for m in "̣̀́̉̃"} | {"đ"}
    home |= {c.upper() for c in home}
    plain = set(".,:;!?()[]{}'\"-–—/\\|%&*+=<>@#_~“”‘’«»…·•-‐‑›") | set(map(chr, range(0x2010, 0x2016)))
    for c in range(1 << 16):
        ch = chr(c)
        kind = unicodedata.category(ch)
        if kind[0] == "L" and ch not in "ªº" or kind == "Mn":
            out[c] = FOREIGN if 0xA0 < c < 0x250 and ch not in home or 0x400 <= c < 0x530 else LETTER
        elif 0x80 <= c < 0xA0 or c == 0xFFFD:
            out[c] = ODD
        elif kind[0] in "SP" or ch in "ªº" or kind == "No" or c == 0xAD:
            out[c] = QUOTE if ch in "«»‹›“”" else 0 if ch in plain or c > 0x2E80 else SYMBOL
    return out


def odd_marks(k: np.ndarray) -> np.ndarray:
    """Where classes ``k`` have a mark within a word as only wrong readings give: two symbols in a row beside a letter,
    or a quotation mark after a letter and right before a letter, a symbol or another mark."""
    letter, symbol, quote = (k == LETTER) | (k == FOREIGN), k == SYMBOL, k == QUOTE
    out = np.zeros(len(k), bool)
    if len(k) > 2:
        pair = symbol[1:-1] & symbol[2:]
        out[1:-1] |= pair & letter[:-2]
        out[1:-1] |= quote[1:-1] & letter[:-2] & (letter[2:] | symbol[2:] | quote[2:])
    return out


def codes_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each after a blank, and the place of each text's first character."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer((" " + " ".join(texts)).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.cumsum(lengths + 1) - lengths


def pair_slots(codes: np.ndarray) -> np.ndarray:
    a, b = codes[:-1], codes[1:]
    return ((a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA6B)) ^ (a >> np.uint32(3))) * np.uint32(0xC2B2AE35) >> np.uint32(32 - PAIR_BITS)


def untrusted(codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Texts with a symbol between letters or beside a foreign one, or an odd character; their pairs aren't counted."""
    k = char_classes()[codes & 0xFFFF]
    bad = (k == ODD) | odd_marks(k)
    bad[1:-1] |= (k[1:-1] == SYMBOL) & ((k[:-2] == LETTER) | (k[:-2] == FOREIGN)) & ((k[2:] == LETTER) | (k[2:] == FOREIGN))
    bad[1:] |= (k[1:] == SYMBOL) & (k[:-1] == FOREIGN) | (k[1:] == FOREIGN) & (k[:-1] == SYMBOL)
    total = np.concatenate([[0], np.cumsum(bad)])
    ends = np.append(starts[1:] - 1, len(codes))
    return total[ends] > total[starts]


def _count(batches):
    pairs, chars = np.zeros(1 << PAIR_BITS, np.int64), np.zeros(1 << CHAR_BITS, np.int64)
    for batch in batches:
        texts = [t for t in batch.column(0).to_pylist() if t]
        if not texts:
            continue
        codes, starts = codes_of(texts)
        bad = untrusted(codes, starts)
        if bad.any():
            codes, _ = codes_of([t for t, b in zip(texts, bad) if not b])
        pairs += np.bincount(pair_slots(codes), minlength=1 << PAIR_BITS)
        chars += np.bincount(codes & ((1 << CHAR_BITS) - 1), minlength=1 << CHAR_BITS)
    import pyarrow as pa

    slots = np.concatenate([np.flatnonzero(pairs), np.flatnonzero(chars) + (1 << PAIR_BITS)]).astype(np.int32)
    yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(np.concatenate([pairs[pairs > 0], chars[chars > 0]]))], ["slot", "n"])


class PairModel:
    """log2 P(y|x) of characters: the prior of y plus the pair's mutual information, shrunk to 0 where unseen."""

    def __init__(self, slots: np.ndarray, n: np.ndarray):
        counts = np.zeros((1 << PAIR_BITS) + (1 << CHAR_BITS), np.float64)
        counts[slots] = n
        pairs, self.chars = counts[: 1 << PAIR_BITS], counts[1 << PAIR_BITS :]
        total = self.chars.sum() + 1
        self.total = total
        self.pairs = pairs.astype(np.float32)
        self.chars = self.chars.astype(np.float32)
        self.prior = ((self.chars + 0.05) / total).astype(np.float32)

    @classmethod
    def shared(cls, pairs: np.ndarray, chars: np.ndarray, total: float) -> PairModel:
        own = cls.__new__(cls)
        own.pairs, own.chars, own.total = pairs, chars, total
        own.prior = ((chars + 0.05) / total).astype(np.float32)
        return own

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """Cost in bits of each character after the first."""
        c = codes & ((1 << CHAR_BITS) - 1)
        strength = np.float32(2.0)
        p = (self.pairs[pair_slots(codes)] + strength * self.prior[c[1:]]) / (self.chars[c[:-1]] + strength)
        return -np.log2(p)

    def cost(self, text: str) -> float:
        return float(self.bits(np.frombuffer((" " + text + " ").encode("utf-32-le", "surrogatepass"), np.uint32)).sum())


def count_pairs(texts: DataFrame) -> PairModel:
    """Pair and character counts over the text column of ``texts``, summed per slot before and after one small shuffle."""
    got = spread(texts).mapInArrow(_count, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    return PairModel(got.column("slot").to_numpy(), got.column("n").to_numpy())


# Inverse mappings -------------------------------------------------------------------------


def _bytes_of(charset: str) -> dict[str, int]:
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(charset)] = b
        except UnicodeDecodeError:
            pass
    if charset.startswith("cp12"):
        for b in range(0x80, 0xA0):
            out.setdefault(chr(b), b)
    return out


#: Charsets that UTF-8 bytes were wrongly read in.
READ_AS = ("cp1252", "mac_roman", "cp437", "cp1251", "cp1258", "cp1250", "cp850", "iso8859_2", "koi8_r", "cp874")
#: Double-byte charsets whose bytes were wrongly read as cp1252, and letters they should give.
DOUBLE_BYTE = ("shift_jis", "gb18030", "euc_kr", "big5", "euc_jp", "tis_620", "cp1251", "koi8_r")

#: TCVN3 letters in the Latin-1 places they are read as (fixed values).
TCVN3 = dict(zip(
    "µ¸¶·¹¨»¾¼½Æ©ÇÊÈÉË®ÌÐÎÏÑªÒÕÓÔÖ×ÝØÜÞßãáâä«åèæçé¬êíëìîïóñòô\xadõøö÷ùúýûüþ¡¢§£¤¥¦",
    "àáảãạăằắẳẵặâầấẩẫậđèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵĂÂĐÊÔƠƯ",
))
#: VNI marks after a base letter, as combining marks; single letters (fixed values).
VNI_MARKS = {"ø": "̀", "ù": "́", "û": "̉", "õ": "̃", "ï": "̣", "â": "̂", "á": "̂́", "à": "̂̀", "å": "̂̉", "ã": "̂̃", "ä": "̣̂", "ê": "̆", "é": "̆́", "è": "̆̀", "ú": "̆̉", "ü": "̆̃", "ë": "̣̆"}
VNI_LETTERS = {"ñ": "đ", "Ñ": "Đ", "ö": "ư", "Ö": "Ư", "ô": "ơ", "Ô": "Ơ", "æ": "ỉ", "ó": "ĩ", "ò": "ị", "î": "ỵ", "Æ": "Ỉ", "Ó": "Ĩ", "Ò": "Ị", "Î": "Ỵ"}


@lru_cache(None)
def utf8_reader(charset: str):
    """A function undoing one reading of UTF-8 bytes in ``charset``, wherever whole sequences are found."""
    by = _bytes_of(charset)

    def chars(lo, hi):
        return "[" + re.escape("".join(c for c, b in by.items() if lo <= b <= hi)) + "]"

    tail = chars(0x80, 0xBF)
    pattern = re.compile(f"(?:{chars(0xC2, 0xDF)}{tail}|{chars(0xE0, 0xEF)}{tail}{{2}}|{chars(0xF0, 0xF4)}{tail}{{3}})+")

    def undo(text: str) -> str:
        return pattern.sub(lambda m: bytes(by[c] for c in m[0]).decode("utf-8", "replace"), text)

    return undo


def undo_double_byte(charset: str):
    by = _bytes_of("cp1252")

    def undo(text: str) -> str:
        raw = bytearray()
        for c in text:
            if ord(c) < 0x80:
                raw.append(ord(c))
            elif c in by:
                raw.append(by[c])
            else:
                return text
        try:
            return raw.decode(charset)
        except UnicodeDecodeError:
            return text

    return undo


def undo_gbk(text: str) -> str:
    """UTF-8 bytes that were read as GBK; lost bytes stay replacement characters."""
    raw = bytearray()
    for c in text:
        try:
            raw += c.encode("gb18030") if c != REPLACEMENT else b"\xff"
        except UnicodeEncodeError:
            return text
    return raw.decode("utf-8", "replace")


_tcvn3 = str.maketrans(TCVN3)
_vni = re.compile("([AaEeOoUuYyôöÔÖ])([" + "".join(VNI_MARKS) + "".join(VNI_MARKS).upper() + "])|([" + "".join(VNI_LETTERS) + "])")


def undo_vni(text: str) -> str:
    def one(m):
        if m[3]:
            return VNI_LETTERS[m[3]]
        base = VNI_LETTERS.get(m[1], m[1])
        return unicodedata.normalize("NFC", base + VNI_MARKS[m[2].lower()])

    return _vni.sub(one, text)


@lru_cache(1)
def inverse_mappings():
    """Each mapping by name."""
    out = {}
    for a in READ_AS:
        one = utf8_reader(a)
        out[a] = one
        out[f"{a} twice"] = lambda t, one=one: one(one(t))
    out |= {"tcvn3": lambda t: t.translate(_tcvn3), "vni": undo_vni, "gbk": undo_gbk}
    return out | {f"{c} as cp1252": undo_double_byte(c) for c in DOUBLE_BYTE}


_tcvn3_mark = re.compile("[" + re.escape("".join(c for c in TCVN3 if c != "\xad")) + "]")
_east = re.compile("[\u3400-\u9fff\ue000-\uf8ff]")
_high = re.compile("[\x80-\u2122]")


def readings(run: str):
    """(mapping, text) for each inverse mapping that changes the run."""
    named = inverse_mappings()
    for a in READ_AS:
        once = named[a](run)
        if once != run:
            yield a, once
            if (again := named[a](once)) != once:
                yield f"{a} twice", again
    if _east.search(run):
        yield "gbk", undo_gbk(run)
        return
    for name, pattern in (("tcvn3", _tcvn3_mark), ("vni", _vni)):
        if pattern.search(run):
            yield name, named[name](run)
    high = len(_high.findall(run))
    if high >= 3 and high * 3 > len(run):
        for name in (f"{c} as cp1252" for c in DOUBLE_BYTE):
            if (other := named[name](run)) != run:
                yield name, other


#: Mappings of single letters change so many characters at least, blanks and soft hyphens aside.
LEAST_CHANGED = {"tcvn3": 2, "vni": 3} | dict.fromkeys((f"{c} as cp1252" for c in DOUBLE_BYTE), 3)


# Runs ------------------------------------------------------------------------------------


def suspicious(model: PairModel, texts: list[str]) -> np.ndarray:
    """Which texts hold a segment of improbable pairs scoring RUN_COST or more beside characters that a
    wrong reading gives, one scoring WHOLE_RUN_COST, or odd characters."""
    codes, starts = codes_of(texts)
    score = model.bits(codes).astype(np.float64) - PAIR_COST
    score[starts - 1] = np.minimum(score[starts - 1], 0)  # a text's first character
    score[starts[1:] - 2] = -1e6  # the blank between texts ends any segment
    total = np.cumsum(score)
    best = total - np.minimum.accumulate(np.minimum(total, 0))
    k = char_classes()[codes & 0xFFFF]
    letter = (k == LETTER) | (k == FOREIGN)
    told = odd_marks(k) | (k == FOREIGN) | ((k == SYMBOL) & np.concatenate([[False], letter[:-1]])) | ((k == SYMBOL) & np.concatenate([letter[1:], [False]]))
    ends = np.append(starts[1:] - 1, len(codes))

    def within(mask):
        seen = np.concatenate([[0], np.cumsum(mask)])
        return seen[ends] > seen[starts]

    best = np.concatenate([[0.0], best])
    return within(k == ODD) | within(best > WHOLE_RUN_COST) | (within(best > RUN_COST) & within(told))


def segments(model: PairModel, text: str) -> list[tuple[int, int]]:
    """Maximum-scoring segments of improbable pairs, widened to whole words; near ones are joined."""
    codes = np.frombuffer((" " + text).encode("utf-32-le", "surrogatepass"), np.uint32)
    score = model.bits(codes) - PAIR_COST
    lost = (codes[1:] == 0xFFFD) | ((codes[1:] >= 0x80) & (codes[1:] < 0xA0))
    score[lost] = np.maximum(score[lost], PAIR_COST)
    spans, total, start, top, end = [], 0.0, 0, 0.0, -1
    for i, s in enumerate(score.tolist()):
        if total <= 0:
            if top > 0.5:
                spans.append((start, end + 1))
            total, start, top = 0.0, i, 0.0
        total += s
        if total > top:
            top, end = total, i
    if top > 0.5:
        spans.append((start, end + 1))
    out: list[tuple[int, int]] = []
    for a, b in spans:
        while a > 0 and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        if out and a - out[-1][1] <= 12:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def lossy_share(text: str) -> int:
    return text.count(REPLACEMENT)


def restore_run(model: PairModel, run: str) -> tuple[str, bool, str | None]:
    """The most probable reading of a run, whether the run is garbled, and by which mapping it was undone."""
    before, best, best_cost, by = model.cost(run), run, None, None
    for name, other in readings(run):
        if other == run or lossy_share(other) > lossy_share(run) + (len(other) // 8 if name == "gbk" else 0):
            continue
        if name in LEAST_CHANGED and sum(c not in other and c not in "\xa0\xad" for c in run) < LEAST_CHANGED[name]:
            continue
        cost = model.cost(other)
        if name == "gbk":  # a third of the characters says the same
            cost += 10 + 12 * lossy_share(other)
        if best_cost is None or cost < best_cost:
            best, best_cost, by = other, cost, name
    gains = best_cost is not None and before - best_cost >= GAIN
    return (best if gains else run), gains or REPLACEMENT in run, by if gains else None


def restore_text(model: PairModel, text: str) -> tuple[str, bool]:
    """The text with its garbled runs restored, and whether it has any."""
    runs = [(a, b) for a, b in segments(model, text) if not text[a:b].isascii()]
    told = [restore_run(model, text[a:b]) for a, b in runs]
    hit = [k for k, (_, bad, _) in enumerate(told) if bad]
    if not hit:
        return text, False
    fixed, at = [], 0
    names = sorted({told[k][2] for k in hit} - {None})
    for k in hit:
        a, b = runs[k]
        fixed += [_widened(model, text[at:a], names), told[k][0]]
        at = b
    return "".join(fixed) + _widened(model, text[at:], names), True


_spaced = re.compile("([ \n\r\t]+)")


def _widened(model: PairModel, text: str, names: list[str]) -> str:
    """The words beside the runs, undone too where the runs' mappings make them more probable."""
    if not names or text.isascii():
        return text
    words = _spaced.split(text)
    for i in range(0, len(words), 2):
        w = words[i]
        if w.isascii():
            continue
        best = model.cost(w)
        for name in names:
            other = inverse_mappings()[name](w)
            if other != w and lossy_share(other) <= lossy_share(w) and model.cost(other) < best - 1:
                words[i], best = other, model.cost(other)
    return "".join(words)


def find_garbled(rows: DataFrame, model: PairModel, keep_text: bool = False) -> DataFrame:
    """Garbled rows of ``rows`` (columns key, text): key, and with ``keep_text`` the restored text.

    Other columns are ignored, so clashing names can't arise.
    """
    shared = rows.sparkSession.sparkContext.broadcast((model.pairs, model.chars, model.total))

    def run(batches):
        import pyarrow as pa

        own = PairModel.shared(*shared.value)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            live = [i for i, t in enumerate(texts) if t]
            picked, fixed = [], []
            if live:
                hot = suspicious(own, [texts[i] for i in live])
                for i in np.flatnonzero(hot):
                    text, bad = restore_text(own, texts[live[i]])
                    if bad:
                        picked.append(live[i])
                        fixed.append(text)
            kept = keys.take(pa.array(picked, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept, pa.array(fixed, pa.string())] if keep_text else [kept], ["key", "restored"][: 1 + keep_text])

    kind = dict(rows.dtypes)["key"]
    return spread(rows.select("key", "text")).mapInArrow(run, f"key {kind}" + (", restored string" if keep_text else ""))


def p1_texts(spark, folder: str) -> DataFrame:
    s = spark.read.parquet(f"{folder}/sentences.parquet").select(F.struct(F.lit("sentences").alias("t"), F.col("seq").alias("i")).alias("key"), "text")
    p = spark.read.parquet(f"{folder}/page_texts.parquet").select(F.struct(F.lit("page_texts").alias("t"), F.col("seq").alias("i")).alias("key"), "text")
    return s.unionAll(p)


def p1_found(spark, folder: str) -> DataFrame:
    rows = p1_texts(spark, folder)
    found = find_garbled(rows, count_pairs(rows.select("text")))
    return found.select(F.col("key.t").alias("source_table"), F.col("key.i").alias("row_id"))


def p1_restored(spark, folder: str) -> DataFrame:
    rows = p1_texts(spark, folder)
    found = find_garbled(rows, count_pairs(rows.select("text")), keep_text=True)
    return found.select(F.col("key.t").alias("source_table"), F.col("key.i").alias("row_id"), F.col("restored").alias("text"))
