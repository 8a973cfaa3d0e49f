"""Column functions that read indicator definitions out of documents (P23, P26, F8, F9, F19-F21, W9). All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lamina.functions import text as t

#: Letters that only Vietnamese words have (fixed values).
VIETNAMESE = "ăâđêôơưĂÂĐÊÔƠƯáàảãạấầẩẫậắằẳẵặéèẻẽẹếềểễệíìỉĩịóòỏõọốồổỗộớờởỡợúùủũụứừửữựýỳỷỹỵÁÀẢÃẠẤẦẨẪẬẮẰẲẴẶÉÈẺẼẸẾỀỂỄỆÍÌỈĨỊÓÒỎÕỌỐỒỔỖỘỚỜỞỠỢÚÙỦŨỤỨỪỬỮỰÝỲỶỸỴ"
#: Faults of the printed texts and what they should be (fixed values).
FIXES = {"Chính sách lao độngnhằm": "Chính sách lao động nhằm"}
#: What a label begins with beside the indicator's name (fixed values).
LABELS = ("Báo cáo liên quan đến ", "Báo cáo ")


def is_vietnamese(c: Column) -> Column:
    """Whether a text has a letter that only Vietnamese has."""
    return F.coalesce(c.rlike(f"[{VIETNAMESE}]"), F.lit(False))


def fixed(c: Column) -> Column:
    """known faults replaced, ends trimmed."""
    for bad, good in FIXES.items():
        c = F.replace(c, F.lit(bad), F.lit(good))
    return t.trim_all(c)


def label_name(c: Column) -> Column:
    """F8: a definition's name: without its label, the first one that fits, and then with a capital."""
    out = c
    for p in reversed(LABELS):
        rest = F.substring(c, F.lit(len(p) + 1), F.length(c))
        out = F.when(c.startswith(p), F.concat(F.upper(F.substring(rest, 1, 1)), F.substring(rest, F.lit(2), F.length(rest)))).otherwise(out)
    return out


def squash(c: Column) -> Column:
    """white space to one blank, and no blanks, stops, colons or semicolons at the ends."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), "^[ .;:]+|[ .;:]+$", "")


def between(c: Column, start: str, *ends: str, most: int = 5000) -> Column:
    """from the first place of ``start``, case aside, to the first pattern of ``ends`` that is found, else ``most`` characters; null without a start."""
    at = F.instr(F.lower(c), start.lower())
    tail = F.substring(c, at, F.length(c))
    stop = F.coalesce(*[F.nullif(F.regexp_instr(tail, F.lit(e)), F.lit(0)) - 1 for e in ends], F.lit(most)) if ends else F.lit(most)
    return F.when(at > 0, F.substring(tail, F.lit(1), stop))


def sections(c: Column, number: str = "6") -> Column:
    """(code, body) of each numbered heading's text up to the next heading: from its first lettered item on, else behind the colon that ends its title."""
    one = F.regexp_replace(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), rf"{number}\.\s*(\d)\s*\.", rf"{number}.$1.")
    codes = F.regexp_extract_all(one, F.lit(rf"{number}\.(\d)\."), F.lit(1))
    texts = F.slice(F.split(one, rf"{number}\.\d\."), F.lit(2), F.size(codes))

    def body(s: Column) -> Column:
        lettered = F.regexp_instr(s, F.lit(r"\sa\)\s"))
        return F.when(lettered > 0, F.substring(s, lettered, F.length(s))).when(F.contains(F.substring(s, 1, 120), F.lit(":")), F.regexp_replace(s, "^[^:]*:", "")).otherwise(s)

    return F.transform(F.arrays_zip(codes.alias("code"), texts.alias("text")), lambda x: F.struct(F.concat(F.lit(f"{number}."), x["code"]).alias("code"), body(x["text"]).alias("body")))


def vietnamese_indicators(c: Column) -> Column:
    """the Vietnamese phrases of a body in two languages parted by slashes: what stands before the first slash, and then
    each part from its first Vietnamese word on; the last part is foreign. Item letters and stops at the ends are dropped."""
    pieces = F.split(c, "/")
    n = F.size(pieces)
    tail = lambda p: F.regexp_replace(F.trim(F.regexp_replace(p, r"(?U)\s+", " ")), rf"^(?:[^\s{VIETNAMESE}]+(?:\s|$))+", "")
    told = F.transform(pieces, lambda p, i: F.when(i == 0, p).when(i < n - 1, tail(p)))
    bare = F.transform(told, lambda p: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(p, r"(?U)\s+", " ")), r"^[a-eA-E]\)\s*", ""), "^[ .;:-]+|[ .;:-]+$", ""), " +", " "))
    return F.filter(bare, lambda p: (F.length(p) >= 5) & is_vietnamese(p) & ~p.startswith("("))


def two_columns(c: Column, start: str, end: str, headers: tuple[str, ...] = ()) -> Column:
    """(left, right): a table of two columns printed as alternating lines between two anchors, without its headers; null without both anchors."""
    at = F.instr(c, start)
    tail = F.substring(c, at, F.length(c))
    stop = F.instr(tail, end)
    lines = F.filter(F.transform(F.split(F.substring(tail, F.lit(1), stop - 1), "\n"), lambda x: t.trim_all(x)), lambda x: (x != "") & ~x.isin(*headers, ""))
    pick = lambda k: F.filter(lines, lambda _, i: i % 2 == k)
    return F.when((at > 0) & (stop > 0), F.struct(pick(0).alias("left"), pick(1).alias("right")))
