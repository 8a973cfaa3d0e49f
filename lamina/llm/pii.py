"""Personal information in free text (problem 10).

A character-level bidirectional LSTM with CRF transitions tags names, email addresses,
phone numbers, identity numbers and street addresses. Texts are laid in a row and cut into overlapping
windows, all of which are scored, each character by the window it stands deepest in. Overlapping
windows are then decoded; each gives the mentions that begin in it, and is decoded farther while
one goes on to its end, so no mention is cut. Where the scores themselves prove that the best path
has no mention in a window, it isn't decoded (see ``coverable``). The found spans are then set to the exact ends of what they are: the whole number, address or name.

The network has hard gates, so a step costs few operations; it is trained in numpy by
``python -m lamina.llm.train_pii`` on spans labelled by patterns and kept as a file.

Null and empty texts have no mentions; repeated documents give their mentions each.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from lamina.session import spread

MODEL = Path(__file__).parent / "models" / "pii.npz"
KINDS = ("name", "email", "phone", "id", "address")
TAGS = 1 + 2 * len(KINDS)  # O, then B and I of each kind
STRIDE, MARGIN = 256, 16
WINDOW = STRIDE + 2 * MARGIN
HIDDEN = 16
#: Characters looked at on either side of a window that is decoded.
REACH = 64
#: More than rounding can add to a path's score over a window.
SLACK = 0.1
_outside = np.array([[0.0]] + [[-30.0]] * (TAGS - 1), np.float32)

# Characters ------------------------------------------------------------------------------

_ASCII = {chr(c): i + 8 for i, c in enumerate(range(0x20, 0x7F))}
CLASSES = 8 + 95 + 14


@lru_cache(1)
def char_table() -> np.ndarray:
    """Class of each character below 2**16: 0 padding, 1 other, 2 line break, 3 Han and Kana, 4 Thai, 5 Hangul,
    6 symbol, 7 digit, then ASCII one by one, then accented letters by base letter and case."""
    out = np.ones(1 << 16, np.uint8)
    base = "adeiouy"
    for c in range(1 << 16):
        ch = chr(c)
        if ch.isdigit():
            out[c] = 7
        elif not c:
            out[c] = 0
        elif ch in _ASCII:
            out[c] = _ASCII[ch]
        elif ch in "\n\r":
            out[c] = 2
        elif ch.isspace():
            out[c] = _ASCII[" "]
        elif 0x3040 <= c < 0xA000:
            out[c] = 3
        elif 0xE00 <= c < 0xE80:
            out[c] = 4
        elif 0xAC00 <= c < 0xD7B0:
            out[c] = 5
        elif unicodedata.category(ch)[0] in "PS":
            out[c] = 6
        else:
            plain = unicodedata.normalize("NFD", ch.replace("đ", "d").replace("Đ", "D"))[0]
            if plain.lower() in base and plain != ch:
                out[c] = 103 + base.index(plain.lower()) + 7 * plain.isupper()
    return out


def lay_out(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the texts in a row, each followed by MARGIN of padding, filled up to whole strides; the texts' starts."""
    whole = ("\0" * MARGIN).join([*texts, ""])
    codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    classes = np.zeros(-(-len(codes) // STRIDE) * STRIDE, np.uint8)
    classes[: len(codes)] = np.where(codes < 1 << 16, char_table()[codes & 0xFFFF], 1)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + MARGIN
    return classes, np.cumsum(sizes) - sizes


# Network ---------------------------------------------------------------------------------


#: The ufunc behind np.clip, whose wrapper costs as much as a short pass.
_clip = getattr(getattr(np, "_core", None), "umath", np).clip


class Network:
    """Per direction: gate inputs by character class (CLASSES, 4H), recurrence (H, 4H); then emissions and transitions."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = {k: np.ascontiguousarray(v, np.float32) for k, v in weights.items()}

    def direction(self, x: np.ndarray, side: str) -> np.ndarray:
        """Hidden states (T, N, H) for classes x (T, N), read in order; each gate lies by itself, so a step is a few dense passes."""
        size, (t_max, n) = self.w[f"re_{side}"].shape[0], x.shape
        recur, inputs = (np.ascontiguousarray(self.w[f"{k}_{side}"].reshape(-1, 4, size).transpose(1, 0, 2)) for k in ("re", "in"))
        h, c = np.zeros((n, size), np.float32), np.zeros((n, size), np.float32)
        out = np.empty((t_max, n, size), np.float32)
        g, given = np.empty((4, n, size), np.float32), np.empty((4, n, size), np.float32)
        gates, new, zero, one = g[:3], g[3], np.float32(0), np.float32(1)
        for t in range(t_max):
            np.matmul(h, recur, out=g)
            np.take(inputs, x[t], axis=1, out=given, mode="clip")
            g += given
            _clip(gates, zero, one, out=gates)
            _clip(new, -one, one, out=new)
            new *= g[0]
            c *= g[1]
            c += new
            h = out[t]
            _clip(c, -one, one, out=h)
            h *= g[2]
        return out

    def emissions(self, x: np.ndarray, core: slice = slice(None)) -> np.ndarray:
        """(T, TAGS, N) for classes x (N, T), of the steps in ``core``."""
        xt = np.ascontiguousarray(x.T, dtype=np.int64)
        f = self.direction(xt, "f")[core]
        b = self.direction(xt[::-1], "b")[::-1][core]
        e = np.matmul(self.w["out_f"].T, f.transpose(0, 2, 1))
        e += np.matmul(self.w["out_b"].T, b.transpose(0, 2, 1))
        e += self.w["bias"][:, None]
        return e


def allowed() -> np.ndarray:
    """Transitions that the tags permit: I only after B or I of its kind."""
    ok = np.ones((TAGS, TAGS), bool)
    for k in range(len(KINDS)):
        i = 2 + 2 * k
        ok[:, i] = False
        ok[[i - 1, i], i] = True
    return ok


def viterbi(emissions: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best tags (N, T) of runs padded to one length.

    The forward pass keeps scores only; the way back is found again from them along the best
    path, which costs one column of the transitions a step instead of all of them.
    """
    n, t_max, k = emissions.shape
    e = np.ascontiguousarray(emissions.transpose(1, 2, 0))
    moves = moves.astype(np.float32)
    begin, inside = np.r_[0, 1:k:2], np.arange(2, k, 2)  # O and B follow any tag, I only B and I of its kind
    into = moves[:, begin][:, :, None]
    stay, enter = moves[inside, inside][:, None], moves[inside - 1, inside][:, None]
    scores, least = np.empty((t_max, k, n), np.float32), int(lengths.min(initial=t_max))
    ways = np.empty((k, len(begin), n), np.float32)
    scores[0] = e[0]
    scores[0, inside] = -1e4
    for t in range(1, t_max):
        before, now = scores[t - 1], scores[t]
        now[begin] = np.add(before[:, None, :], into, out=ways).max(0)
        now[inside] = np.maximum(before[inside] + stay, before[inside - 1] + enter)
        now += e[t]
        if t >= least:
            over = lengths <= t
            now[:, over] = before[:, over]
    tags = np.zeros((t_max, n), np.uint8)
    at = scores[-1].argmax(0)
    for t in range(t_max - 1, -1, -1):
        tags[t] = at
        if t:
            came = (scores[t - 1] + moves[:, at]).argmax(0)
            at = came if t < least else np.where(t < lengths, came, at)
    return tags.T


@lru_cache(1)
def network() -> Network:
    with np.load(MODEL) as f:
        return Network(dict(f))


# Windows ---------------------------------------------------------------------------------

UPPER = "A-ZÀ-ÖØ-ÞĂĐĨŨƠƯẠẢẤẦẨẪẬẮẰẲẴẶẸẺẼẾỀỂỄỆỈỊỌỎỐỒỔỖỘỚỜỞỠỢỤỦỨỪỬỮỰỲỴỶỸ"
WORD = f"[{UPPER}][^\\W\\d_]*"
#: Common Vietnamese surnames and forms of address (fixed values).
SURNAMES = "Nguyễn|Trần|Lê|Phạm|Hoàng|Huỳnh|Phan|Vũ|Võ|Đặng|Bùi|Đỗ|Hồ|Ngô|Dương|Lý|Đinh|Mai|Tạ|Trịnh|Thái|Doãn|Khổng|Nghiêm|Giáp|Trương|Lương|Cao|Đoàn|Tô|Lưu|Hà|Châu|Chu|Quách|Tăng|Kiều"
ADDRESSED = "[Ôô]ng|[Bb]à|[Aa]nh|[Cc]hị|[Cc]ô|[Cc]hú|[Bb]ác|[Cc]ụ|[Ee]m|[Dd]ì|[Tt]hầy|ThS\\.|TS\\.|BS\\.|KS\\.|GS\\.|PGS\\.|Mr\\.?|Mrs\\.?|Ms\\.?|Dr\\.?|Prof\\.?|Mme|M\\."


def windows(classes: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    padded = np.concatenate([np.zeros(MARGIN, classes.dtype), classes, np.zeros(MARGIN, classes.dtype)])
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[numbers * STRIDE]


def coverable(core: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Windows of ``core`` (STRIDE, TAGS, N), which follow each other, that a mention may touch on the best path through all of them.

    Mentions side by side that score less than O in their place are on no best path. What they gain is bounded by the
    beginning, what each further character adds at best by any tag and the best way into it, and the best way out; the
    greatest bound over all that cover a character is a running maximum from either side. Where it is below nothing, the
    best path has O for certain.
    """
    stay, (_, _, n) = moves[0, 0], core.shape
    enter, onward, leave = (moves[0, 1::2] - stay)[:, None], (moves[1:, 1:].max(0) - stay)[:, None], moves[1:, 0].max() - stay
    first, further = np.empty((2, n, STRIDE), np.float32)
    for a in range(0, n, 1024):
        e = core[:, :, a : a + 1024]
        first[a : a + 1024] = ((e[:, 1::2] + enter).max(1) - e[:, 0] + leave).T
        further[a : a + 1024] = ((e[:, 1:] + onward).max(1) - e[:, 0]).T
    total = np.cumsum(further, dtype=np.float64)
    reach = np.maximum.accumulate(first.ravel() - total)  # with total: the best that begins at or before and reaches here
    reach += np.maximum.accumulate(total[::-1])[::-1]  # less total: what going on may add
    return (reach > -SLACK).reshape(-1, STRIDE).any(1)


def stretches(core: np.ndarray, numbers: np.ndarray, size: int) -> np.ndarray:
    """``size`` steps (size, TAGS, N) of ``core`` (STRIDE, TAGS, 1 + windows + 1; first and last lie outside) from REACH before the windows ``numbers``."""
    e, done = np.empty((size, TAGS, len(numbers)), np.float32), 0
    while done < size:
        ahead, low = divmod(done - REACH, STRIDE)
        more = min(STRIDE - low, size - done)
        np.take(core[low : low + more], numbers + 1 + ahead, axis=2, out=e[done : done + more], mode="clip")
        done += more
    return e


def tag_texts(texts: list[str], net: Network, moves: np.ndarray, batch: int = 1024) -> list[list[tuple[str, int, int]]]:
    """Spans (kind, start, end) of each text, as decoded."""
    classes, starts = lay_out(texts)
    out: list[list] = [[] for _ in texts]
    n = len(classes) // STRIDE
    if not n:
        return out
    x = windows(classes, np.arange(n))
    core = np.empty((STRIDE, TAGS, n + 2), np.float32)
    core[:, :, [0, -1]] = _outside
    for a in range(0, n, batch):
        part = x[a : a + batch]
        core[:, :, a + 1 : a + 1 + len(part)] = net.emissions(part, slice(MARGIN, MARGIN + STRIDE))
    # Windows are decoded with REACH on either side; each gives the mentions that begin in it. One that goes
    # on to the end of what was decoded is decoded again with twice as much after it.
    todo, size = np.flatnonzero(coverable(core[:, :, 1:-1], moves)), STRIDE + 2 * REACH
    while len(todo):
        longer = []
        for a in range(0, len(todo), 512):
            part = todo[a : a + 512]
            tags = viterbi(stretches(core, part, size).transpose(2, 0, 1), np.full(len(part), size), moves)
            begin = tags[:, REACH : REACH + STRIDE] % 2 == 1
            for g in np.flatnonzero(begin.any(1)).tolist():
                number, t = int(part[g]), tags[g]
                at, begins, ends = number * STRIDE - REACH, (REACH + np.flatnonzero(begin[g])).tolist(), []
                for s in begins:
                    end = s + 1
                    while end < size and t[end] == t[s] + 1:
                        end += 1
                    ends.append(end)
                if ends[-1] == size and at + size < n * STRIDE:
                    longer.append(number)
                    continue
                for s, end in zip(begins, ends):
                    i = int(np.searchsorted(starts, at + s, "right")) - 1
                    first, last = at + s - int(starts[i]), min(len(texts[i]), at + end - int(starts[i]))
                    if first < last:
                        out[i].append((KINDS[(t[s] - 1) // 2], first, last))
        todo, size = np.array(longer, np.int64), 2 * size
    return [sorted(spans, key=lambda x: x[1]) for spans in out]


# Exact ends ------------------------------------------------------------------------------

_PLACE = rf"(?:{WORD}(?:[ ]{WORD}){{0,3}}|\d{{1,3}})"
ADDRESS = re.compile(
    rf"\d+(?:[A-Z]|bis)?(?:/\d+(?:[A-Z]|bis)?)*(?:, ?(?:ngõ|ngách|hẻm|kiệt) \d+(?:/\d+)*)?,? (?:(?:đường|phố|ấp|thôn|tổ|khu phố|Đ\.|Đường|Phố|Ấp) ?)?{WORD}(?: {WORD}){{0,3}}(?:\.(?=,))?"
    rf"(?:, ?(?:(?:phường|xã|thị trấn|quận|huyện|thị xã|thành phố|tỉnh|P\.|X\.|Q\.|H\.|TP\.|TX\.|TT\.|T\.) ?)?{_PLACE})*"
)
EMAIL = re.compile(
    r"[\w.+-]+\s?(?:@|＠|[\[(]\s?(?:at|@|a còng)\s?[\])])\s?[\w-]+(?:(?:\.|\s?[\[(]\s?(?:dot|\.|chấm)\s?[\])]\s?|\s(?:dot|chấm)\s)[\w-]+)+"
    r"|[\w.+-]+\s(?:at|a còng)\s[\w-]+(?:\s?[\[(]\s?dot\s?[\])]\s?[\w-]+|\s(?:dot|chấm)\s[\w-]+)+",
    re.A | re.I,
)
PHONE = re.compile(r"(?:\(\+?\d{1,4}\)|\+\d{1,3}|\d)(?:[ .\-–]?\(?\d+\)?)+")
IDENTITY = re.compile(r"[A-Z]{0,2}\d+(?:[ .\-]\d+)*")
NAME = re.compile(rf"{WORD}(?:[ ]{WORD})*")
_title = re.compile(rf"^(?:(?:{ADDRESSED}|Kính|Gửi) ?)+")
_organisation = re.compile(r"(?:Quỹ|Trường|Công ty|Tập đoàn|Bệnh viện|Viện|Hợp tác xã|Ngân hàng|Đường|Phố|đường|phố|Cty\.|Cty|quỹ|trường)\s(?:\w+ )?$")


def _joined(text: str, at: int) -> bool:
    """Whether the characters before and at ``at`` belong to one word or number."""
    return all(c.isalnum() and c < "\u0e00" or c in "._+-" for c in text[at - 1 : at + 1])


def _covering(pattern: re.Pattern, text: str, a: int, b: int, reach: int) -> tuple[int, int] | None:
    """The match nearest to the span that overlaps it most, looked for ever farther while it meets the end of what was looked at."""
    while True:
        lo, hi, best = max(0, a - reach), min(len(text), b + reach), None
        while lo and _joined(text, lo):
            lo -= 1
        while 0 < hi < len(text) and _joined(text, hi):
            hi += 1
        for m in pattern.finditer(text, lo, hi):
            both = min(b, m.end()) - max(a, m.start())
            if both > 0 and (best is None or both > best[0]):
                best = (both, m.start(), m.end())
        if best is None or not (best[1] == lo > 0 or best[2] == hi < len(text)):
            return best and best[1:]
        reach *= 4


def exact(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans set to the whole of what they are; those that can't be it are left out."""
    out = []
    for kind, a, b in spans:
        if kind == "address":
            hit = _covering(ADDRESS, text, a, b, 60)
        elif kind == "email":
            hit = _covering(EMAIL, text, a, b, 40)
        elif kind == "phone":
            hit = _covering(PHONE, text, a, b, 16)
            digits = [c for c in text[hit[0] : hit[1]] if c.isdigit()] if hit else []
            if not 8 <= len(digits) <= 15 or len(set(digits)) < 3 or text[max(0, hit[0] - 1) : hit[0]].isdigit():
                hit = None
        elif kind == "id":
            hit = _covering(IDENTITY, text, a, b, 16)
            if hit and not 7 <= sum(c.isdigit() for c in text[hit[0] : hit[1]]) <= 14:
                hit = None
        else:
            hit = _covering(NAME, text, a, b, 24)
            if hit:  # the words that the span reaches into
                words = [(m.start() + hit[0], m.end() + hit[0]) for m in re.finditer(r"\S+", text[hit[0] : hit[1]])]
                words = [w for w in words if 2 * (min(b, w[1]) - max(a, w[0])) >= w[1] - w[0]]
                hit = (words[0][0], words[-1][1]) if words else None
            if hit:
                m = _title.match(text[hit[0] : hit[1]])
                if m and m.end() < hit[1] - hit[0]:
                    hit = (hit[0] + m.end(), hit[1])
                if _organisation.search(text, max(0, hit[0] - 24), hit[0]):
                    hit = None
        if hit and hit[1] > hit[0]:
            out.append((kind, *hit))
    out = sorted(set(out), key=lambda s: (s[1], s[1] - s[2]))
    kept: list[tuple[str, int, int]] = []
    for s in out:
        if kept and s[1] < kept[-1][2]:
            if s[2] - s[1] > kept[-1][2] - kept[-1][1]:
                kept[-1] = s
            continue
        kept.append(s)
    return kept


def mentions_of(texts: list[str], net: Network | None = None) -> list[list[tuple[str, int, int]]]:
    net = net or network()
    moves = np.where(allowed(), net.w["moves"], np.float32(-1e4)).astype(np.float32)
    return [exact(t, s) for t, s in zip(texts, tag_texts(texts, net, moves))]


def find_mentions(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, start_char, end_char) of docs (doc_id, text; other columns are ignored)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                texts = [t or "" for t in part.column(1).to_pylist()]
                rows = [(i, *s) for i, spans in enumerate(mentions_of(texts)) for s in spans]
                i, kind, start, end = map(list, zip(*rows)) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(i, pa.int64())), pa.array(kind, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32())],
                    ["doc_id", "kind", "start_char", "end_char"],
                )

    return spread(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, kind string, start_char int, end_char int")


def redact(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with each mention replaced by its kind in square brackets; a null text stays null."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts, out = part.column(1).to_pylist(), []
                for t, spans in zip(texts, mentions_of([t or "" for t in texts])):
                    for kind, a, b in reversed(spans):
                        t = f"{t[:a]}[{kind.upper()}]{t[b:]}"
                    out.append(t)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, text string")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return find_mentions(spark.read.parquet(f"{folder}/documents.parquet"))


def p10_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return redact(spark.read.parquet(f"{folder}/documents.parquet"))
