"""Page furniture in article texts (problem 7).

The lines of a page are the leaves of a small tree: page, zone (before the first running
text, between, after the last), block (neighbouring lines of one shape), line. Gradient-
boosted trees score each line by its own text, its attribute tokens, its depth and place,
its siblings and its block's density, and by how many pages of the corpus have the same
line. Every line gets the same features, whatever its length. Hierarchical decoding then goes
up the tree: a page, zone or block is furniture as a whole, report as a whole, or mixed at a
price, and what lies below a node that isn't mixed can't contradict it.

The trees are fitted by ``python -m lamina.llm.train_boilerplate`` on a bounded sample of
pages and kept as a file. Line counts come from a hashed table of fixed size.
Null and empty texts have no lines; blank lines are never furniture.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from lamina.llm.lookalike import ALIKE, INVISIBLE
from lamina.session import spread

MODEL = Path(__file__).parent / "models" / "boilerplate.json"
SLOT_BITS = 20
#: Cost in logits of a block whose lines differ (by the root of their number), and of a zone or page whose parts differ.
MIXED, PARTS_DIFFER = 0.6, 0.2
#: Characters at a line's end in which an aside is looked for.
ASIDE = 64

#: Attribute tokens by kind, in the languages of the pages, folded (fixed values).
TOKENS = {
    "menu": "trang chu|video|bat dong san|e-magazine|dien dan|doanh nghiep|moi truong|xa hoi|dat bao|kinh doanh|podcasts?|phap luat|chung khoan|nang luong|thoi su|home|news|markets|energy|environment|companies|opinion|newsletters|subscribe|log in|accueil|actualites|inicio|noticias|首页|新闻|环境|企业|ホーム|ニュース|環境|홈|뉴스|환경|기업|หน้าแรก|ข่าว|สิ่งแวดล้อม|บริษัท",
    "cookie": "cookies?|クッキー|쿠키|คุกกี้",
    "rights": "©|ban quyen|giu ban quyen|all rights reserved|giay phep|cam sao chep|ghi ro nguon|phat hanh lai|republishing|written consent|版权|無断転載|무단 전재|tous droits|derechos",
    "share": "chia se|share|in bai|luu tin|copy link|sao chep lien ket|gui cho ban be|e-mail|print|save|like \\d|分享|打印|收藏|印刷|共有|保存|공유|인쇄|저장|แชร์|พิมพ์|บันทึก|a- a a\\+|text size|partager|compartir",
    "comment": "binh luan|comments?|y kien cua ban|go tieng viet co dau|dang nhap de|log in to comment|评论|コメント|댓글|ความคิดเห็น|commentaires|comentarios",
    "ads": "quang cao|advertisement|advertising|广告|広告|광고|โฆษณา|publicite|publicidad|scroll to continue|cuon xuong|premium|days free",
    "related": "tin lien quan|tin moi nhat|cung chuyen muc|bai noi bat|co the ban quan tam|doc nhieu|bai cung chu de|doc them|xem them|related|most read|trending|you may also like|latest|more from|read more|相关|関連|관련|ข่าวที่เกี่ยวข้อง",
    "contact": "lien he|contact|careers|terms|privacy|dieu khoan|ve dau trang|back to top|rss|duong day nong|toa soan|newsroom|hotline|联系|隐私|お問い合わせ|利用規約|문의|이용약관|ติดต่อ|นโยบาย",
    "follow": "theo doi|follow|tai ung dung|in the app|dang ky nhan|sign up|briefing|ban tin|moi ban dat|nhan tin nhanh|doc tiep",
    "tags": "tu khoa|tags?|chu de|标签|タグ|태그|แท็ก|mots-cles|etiquetas",
}
NAMES = tuple(TOKENS)

_menu_parts = frozenset(TOKENS["menu"].replace("podcasts?", "podcast|podcasts").split("|"))
_parts = re.compile(r"\s*[|/›>•·]\s*|\s+[-–—]\s+|\s{3,}")
_separators = ("|", "/", "›", ">", "•", "·", " -", " –", " —", "   ")
_date = re.compile(r"\d{1,4}[/.年-]\s?\d{1,2}[/.月-]\s?\d{1,4}")
_time = re.compile(r"\b\d{1,2}[:h]\d{2}\b")
_closers = "\"”»’」』)" + "".join(c for c in map(chr, range(0x3001)) if c.isspace())
_bullet = re.compile(r"[›>•●\-–▼»*]")
_aside = re.compile(r"\s*(?:\([^()]{1,25}\)|[✔▼]️?|🌿|©|[№§£€±]\s?\d+(?: .?m)?)\s*\.?$")
#: Last characters of an aside.
_aside_ends = frozenset(")✔▼️🌿©m" + "".join(c for c in map(chr, range(0x20000)) if c.isdecimal()))
_digits = re.compile(r"\d+")


def ends_sentence(line: str) -> bool:
    """Whether the line ends like a sentence."""
    return line.rstrip(_closers)[-1:] in tuple(".!?…。！？")


def without_aside(folded: str) -> str:
    if folded.rstrip(" .")[-1:] not in _aside_ends:
        return folded
    m = _aside.search(folded, max(0, len(folded) - ASIDE))
    return folded[: m.start()] if m else folded


@lru_cache(1)
def _automaton():
    """Finds all attribute tokens of a folded line in one pass."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for kind, words in TOKENS.items():
        for w in words.replace("podcasts?", "podcast|podcasts").replace("cookies?", "cookie|cookies").replace("comments?", "comment|comments").replace("tags?", "tag|tags").replace("like \\d", "like ").replace("\\+", "+").split("|"):
            out.add_word(w, (kind, len(w)))
    out.make_automaton()
    return out


def _plain(c: str) -> bool:
    return c.isascii() and c.isalnum()


def tokens_in(folded: str):
    """(kind, start) of the attribute tokens that are whole words."""
    n = len(folded)
    for end, (kind, size) in _automaton().iter(folded):
        a, z = end - size + 1, end + 1
        if not (a and _plain(folded[a - 1]) and _plain(folded[a])) and not (z < n and _plain(folded[z]) and _plain(folded[end])):
            yield kind, a


FOLDED = 0x20000


@lru_cache(1)
def _tables() -> tuple[np.ndarray, dict[int, str], np.ndarray, np.ndarray]:
    """Of the characters below FOLDED: what one folds to (0 for nothing), those that fold to several, digits, capitals."""
    to, several = np.arange(FOLDED, dtype=np.uint32), {}
    digit, upper = np.zeros(FOLDED, bool), np.zeros(FOLDED, bool)
    alike = ALIKE | dict.fromkeys(INVISIBLE, "")
    for c in range(FOLDED):
        ch = chr(c)
        digit[c], upper[c] = ch.isdigit(), ch.isupper()
        s = unicodedata.normalize("NFKD", alike.get(ch, ch).lower()).replace("đ", "d")
        s = unicodedata.normalize("NFC", "".join(x for x in s if not "̀" <= x <= "ͯ"))
        if len(s) > 1:
            several[c], to[c] = s, SEVERAL
        else:
            to[c] = ord(s) if s else 0
    return to, several, digit, upper


SEVERAL = 0xFFFFFFFF


def fold(text: str) -> str:
    """Lower case without accents, look-alikes and invisible characters; line breaks stay."""
    if text.isascii():
        return text.lower()
    to, several, _, _ = _tables()
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    found = np.where(codes < FOLDED, to[np.minimum(codes, FOLDED - 1)], codes)
    more = found == SEVERAL
    if more.any():
        for c in np.unique(codes[more]).tolist():
            text = text.replace(chr(c), several[c])
        return fold(text)
    return found[found != 0].tobytes().decode("utf-32-le", "surrogatepass")


def folded_lines(text: str) -> list[str]:
    return [line.strip() for line in fold(text).split("\n")]


def line_key(folded: str, site: str) -> str:
    if len(site) > 3:
        folded = folded.replace(site, "§")
    return _digits.sub("#", folded)


def slot_of(key: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(key) >> (64 - SLOT_BITS)


OWN = ["chars", "words", "ended", "parts", "longest", "digits", "upper", "date", "time", "bullet", "aside", "site", "domain", "colon", "menu_share", "pages", *NAMES, "first"]
PLACE = ["from_top", "from_end", "share", "zone", "depth", "since_related", "run", "run_chars", "block_ended"]
SIDE = ["chars", "ended", "parts", "menu_share", "pages", "related", "date", "bullet"]
FEATURES = [*OWN, *PLACE, *(f"prev_{s}" for s in SIDE), *(f"next_{s}" for s in SIDE)]


@lru_cache(1 << 15)
def _own(folded: str, site: str, domain: str, numbers: bool) -> tuple[list[float], int]:
    """The values of OWN that a folded line gives (others are 0), and the slot of its key."""
    bare = without_aside(folded)
    parts = [p for p in _parts.split(bare) if p] or [""] if any(x in bare for x in _separators) else [bare]
    found = dict.fromkeys(NAMES, 0)
    first = 0.0
    for kind, a in tokens_in(folded):
        found[kind] += 1
        if a <= 3:
            first = NAMES.index(kind) + 1.0
    values = [
        len(bare), bare.count(" ") + 1, 0.0, len(parts), max(map(len, parts)), 0.0, 0.0, numbers and bool(_date.search(bare)), numbers and bool(_time.search(bare)),
        bool(_bullet.match(bare)), len(folded) - len(bare), len(site) > 3 and site in folded, "@" in folded or (bool(domain) and domain in folded), ":" in bare[:30],
        sum(p in _menu_parts for p in parts) / len(parts), 0.0, *found.values(), first,
    ]
    return [float(v) for v in values], slot_of(line_key(folded, site))


def shape_of(own) -> int:
    """0 blank, 1 running text, 2 headline-like, 3 short."""
    if own[0] < 1:
        return 0
    if own[2]:
        return 1
    return 2 if own[1] >= 7 and own[3] <= 2 else 3


_I = {k: i for i, k in enumerate(OWN)}
_side = [_I[s] for s in SIDE]


def _share_of(flags: np.ndarray, starts: np.ndarray) -> np.ndarray:
    seen = np.concatenate([[0], np.cumsum(flags)])
    sizes = np.diff(np.append(starts, len(flags) + 1)) - 1
    return (seen[starts + sizes] - seen[starts]) / np.maximum(1, sizes)


def page_features(text: str, site: str | None, domain: str | None, pages) -> tuple[np.ndarray, list[int], list[int]]:
    """A row of FEATURES per line, and the numbers of each line's block and zone. ``pages`` counts pages by slot."""
    site, domain = fold(site or "").strip(), (domain or "").lower()
    _, _, digit, upper = _tables()
    lines, codes = text.split("\n"), np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    starts, codes = np.concatenate([[0], np.flatnonzero(codes == 10) + 1]), np.minimum(codes, FOLDED - 1)
    digits, capitals = _share_of(digit[codes], starts).tolist(), _share_of(upper[codes], starts).tolist()
    own, shapes, slots = [], [], []
    for line, folded, d, u in zip(lines, folded_lines(text), digits, capitals):
        values, slot = _own(folded, site, domain, d > 0)
        values = list(values)
        values[_I["ended"]], values[_I["digits"]], values[_I["upper"]] = float(ends_sentence(line)), d, u
        own.append(values)
        slots.append(slot)
        shapes.append(shape_of(values))
    n = len(lines)
    told = np.asarray(own, np.float32).reshape(n, len(OWN))
    told[:, _I["pages"]] = np.log1p(pages[np.asarray(slots, np.int64)])
    running = [i for i in range(n) if shapes[i] == 1 and own[i][0] > 70]
    top, bottom = (running[0], running[-1]) if running else (n, -1)
    zones = [0 if i < top else 2 if i > bottom else 1 for i in range(n)]
    blocks, b = [], -1
    for i in range(n):
        if not i or shapes[i] != shapes[i - 1] or zones[i] != zones[i - 1]:
            b += 1
        blocks.append(b)
    size = np.bincount(blocks, minlength=b + 1)
    chars = np.bincount(blocks, told[:, 0], b + 1) / size
    ends = np.bincount(blocks, told[:, _I["ended"]], b + 1) / size
    since, last, related = [], 99.0, _I["related"]
    for i in range(n):
        since.append(last)
        last = 0.0 if own[i][related] and own[i][0] < 40 else last + 1 if last < 99 and shapes[i] == 2 else 99.0
    out = np.zeros((n, len(FEATURES)), np.float32)
    k, at, own_end, place_end, side = np.asarray(blocks), np.arange(n), len(OWN), len(OWN) + len(PLACE), told[:, _side]
    out[:, :own_end] = told
    for c, v in enumerate((at, n - 1 - at, at / max(1, n - 1), zones, shapes, since, size[k], chars[k], ends[k])):
        out[:, own_end + c] = v
    out[1:, place_end : place_end + len(SIDE)] = side[:-1]
    out[:-1, place_end + len(SIDE) :] = side[1:]
    return out, blocks, zones


class Trees:
    """Boosted regression trees as flat arrays; a leaf's children are itself."""

    def __init__(self, told: dict):
        self.base, self.trees = told["base"], [tuple(np.asarray(t[k]) for k in ("feature", "cut", "left", "right", "value")) for t in told["trees"]]
        self.depth = told["depth"]

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, left, right, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = np.where(x[rows, feature[at]] <= cut[at], left[at], right[at])
            out += value[at]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 120, depth: int = 4, rate: float = 0.2, bins: int = 32, least: float = 4.0) -> dict:
    """Gradient boosting for logistic loss with second-order leaves over quantile bins."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    codes = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    base = float(np.log(y.mean() / (1 - y.mean())))
    score, trees = np.full(len(y), base), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        tree = {"feature": [0], "cut": [0.0], "left": [0], "right": [0], "value": [0.0]}
        level = [(0, np.arange(len(y)))]
        for d in range(depth + 1):
            following = []
            for node, rows in level:
                gs, hs = g[rows].sum(), h[rows].sum()
                tree["value"][node] = float(rate * gs / (hs + 1.0))
                tree["left"][node] = tree["right"][node] = node
                if d == depth or hs < 2 * least:
                    continue
                best = (1e-3, 0, 0)
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    c = codes[rows, f]
                    gl, hl = np.cumsum(np.bincount(c, g[rows], len(e) + 1))[:-1], np.cumsum(np.bincount(c, h[rows], len(e) + 1))[:-1]
                    gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
                    gain[(hl < least) | (hs - hl < least)] = 0
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), f, k)
                if best[0] <= 1e-3:
                    continue
                _, f, k = best
                low = codes[rows, f] <= k
                for side, part in (("left", rows[low]), ("right", rows[~low])):
                    tree[side][node] = len(tree["value"])
                    for key, v in (("feature", 0), ("cut", 0.0), ("left", 0), ("right", 0), ("value", 0.0)):
                        tree[key].append(v)
                    following.append((tree[side][node], part))
                tree["feature"][node], tree["cut"][node] = f, float(edges[f][k])
            level = following
        trees.append(tree)
        score += Trees({"base": 0.0, "trees": [tree], "depth": depth}).logits(x)
    return {"base": base, "depth": depth, "features": FEATURES, "trees": trees}


def _spans(labels: list[int]) -> list[tuple[int, int]]:
    """The stretches of equal neighbours."""
    at = [i for i in range(len(labels)) if not i or labels[i] != labels[i - 1]]
    return list(zip(at, [*at[1:], len(labels)]))


def decode(logits: np.ndarray, blocks: list[int], zones: list[int], chars: np.ndarray) -> np.ndarray:
    """Which lines are furniture, by the best labelling of the tree page, zone, block, line.

    A node is furniture (worth its lines' logits), report (worth 0) or mixed (worth what its children are, less a price).
    """
    worth = np.where(chars < 1, 0.0, logits)
    out = worth > 0
    total = np.concatenate([[0.0], np.cumsum(worth)])

    def settle(a: int, b: int, mixed: float) -> float:
        whole = total[b] - total[a]
        if max(whole, 0.0) >= mixed:
            out[a:b] = whole > 0
        return max(whole, 0.0, mixed)

    page = 0.0
    for a, b in _spans(zones):
        zone, inner = 0.0, _spans(blocks[a:b])
        for x, y in inner:
            lines = worth[a + x : a + y]
            price = MIXED * len(lines) ** 0.5 if len(lines) > 1 else 0.0
            zone += settle(a + x, a + y, float(lines[lines > 0].sum()) - price)
        page += settle(a, b, zone - PARTS_DIFFER * (len(inner) > 1))
    settle(0, len(worth), page - PARTS_DIFFER * (len(set(zones)) > 1))
    out[chars < 1] = False
    return out


@lru_cache(1)
def trees() -> Trees:
    told = json.loads(MODEL.read_text())
    assert told["features"] == FEATURES
    return Trees(told)


@lru_cache(1 << 15)
def _slot(folded: str, site: str) -> int:
    return slot_of(line_key(folded, site))


def _count(batches):
    import pyarrow as pa

    n = np.zeros(1 << SLOT_BITS, np.int32)
    for batch in batches:
        for text, site in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if text:
                site = fold(site or "").strip()
                n[list({_slot(line, site) for line in folded_lines(text)})] += 1
    used = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(n[used])], ["slot", "n"])


def line_counts(pages: DataFrame) -> np.ndarray:
    """Pages per line slot: each distinct line of a page counts once."""
    got = pages.select("text", "sitename").mapInArrow(_count, "slot int, n int").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << SLOT_BITS, np.int32)
    out[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    return out


def relative(counts: np.ndarray, pages: int) -> np.ndarray:
    """Counts as they'd be among 10,000 pages, so that trees see the same at every size."""
    return counts * np.float32(10_000 / max(1, pages))


def furniture(pages: DataFrame) -> DataFrame:
    """(article_id, line_no) of the lines of pages (article_id, text, sitename, source_domain) that aren't the report's."""
    pages = pages.select("article_id", "text", "sitename", "source_domain").filter(F.length("text") > 0)
    shared = pages.sparkSession.sparkContext.broadcast(relative(line_counts(pages), pages.count()))

    def run(batches):
        import pyarrow as pa

        model = trees()
        for batch in batches:
            texts, sites, domains = (batch.column(i).to_pylist() for i in (1, 2, 3))
            made = [page_features(t, s, d, shared.value) for t, s, d in zip(texts, sites, domains)]
            logits = model.logits(np.concatenate([x for x, _, _ in made])) if made else np.zeros(0)
            at, lines, start = [], [], 0
            for i, (x, blocks, zones) in enumerate(made):
                found = np.flatnonzero(decode(logits[start : start + len(x)], blocks, zones, x[:, 0]))
                start += len(x)
                at += [i] * len(found)
                lines += (found + 1).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(lines, pa.int32())], ["article_id", "line_no"])

    return spread(pages).mapInArrow(run, "article_id bigint, line_no int")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return furniture(spark.read.parquet(f"{folder}/articles.parquet").withColumn("article_id", F.col("article_id").cast("bigint")))


def p7_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """Each article's report alone; a null text stays null."""
    a = spark.read.parquet(f"{folder}/articles.parquet").select("article_id", "text")
    dropped = p7_found(spark, folder).groupBy("article_id").agg(F.collect_set("line_no").alias("dropped"))
    lines = F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains(F.coalesce("dropped", F.array().cast("array<int>")), (i + 1).cast("int")))
    return a.join(dropped, "article_id", "left").select("article_id", F.array_join(lines, "\n").alias("text"))
