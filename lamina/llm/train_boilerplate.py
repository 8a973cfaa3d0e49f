"""Fits the trees of problem 7: python -m lamina.llm.train_boilerplate ARTICLES.parquet

The rows are at most SAMPLE pages; their labels come from full-line patterns and from where
a line stands (a headline after the heading of a list of links). The trees see none of the
patterns, only features. Every fifth page is held out and its accuracy printed.
"""

from __future__ import annotations

import json
import re
import sys

import numpy as np

from lamina.llm import boilerplate as b

#: Greatest number of labelled pages.
SAMPLE = 6000

_menu = b.TOKENS["menu"]
_sep = r"\s*(?:[|/›>•·]|\s[-–—]\s|\s{2,}|-)\s*"
#: Whole lines of furniture, folded, asides removed.
LINES = re.compile(
    "|".join([
        rf"(?:{_menu})(?:{_sep}(?:{_menu}))*", rf"(?:{_menu})(?:{_sep}[\w\s]+){{1,3}}(?=$)",
        r"(?:thu \w+|chu nhat|\w+day),? \d+/\d+/\d+ - \d+:\d+", r".*(?:cookies?|クッキー|쿠키|คุกกี้|cookie).*(?:quang cao|trai nghiem|truy cap|lua chon|thong ke|traffic|choices|policy|details|accept|browser|settings|同意|继续|続ける|동의).*",
        r"เว็บไซต์นี้ใช้คุกกี้.*", r"이 사이트는 쿠키를 .*", r".*(?:cookie policy|uses? cookies|needs cookies|nhan cookie|luu cookie|dung cookie).*", r"©.*", r"ban quyen thuoc ve (?!ben ).*", r"ghi ro nguon .*", r"giay phep hoat dong so .*", r"republishing needs .*", r"版权所有.*",
        r"chia se(?: \| .*| bai viet nay)", r"gui cho ban be .*", r"copy link.*", r"like \d+ share \d+", r"print \| save.*", r"share this story", r"a- a a\+", r"text size.*", r"分享 打印 收藏", r"印刷 共有 保存", r"공유 인쇄 저장", r"แชร์ \| .*",
        r"(?:binh luan|comments|评论|コメント|댓글|ความคิดเห็น)\s*[(（]\d+[)）]", r"y kien cua ban se .*", r"dang nhap de .*", r"log in to comment.*",
        r"quang cao(?: – .*)?", r"advertisement(?: – .*)?", r"广告|広告|광고|โฆษณา", r"lien he quang cao:.*", r"get .* premium for .*", r"moi ban dat bao .*",
        r"tin lien quan|tin moi nhat|cung chuyen muc|bai noi bat|co the ban quan tam|doc nhieu|most read|trending now|you may also like|latest|more from .*", r"\W*(?:bai cung chu de|doc them|xem them|related|read more|相关阅读|相关|関連記事|관련 기사|관련|ข่าวที่เกี่ยวข้อง)\s?[:：].*",
        r"rss \| .*", r"terms \| .*", r"back to top", r"contact the newsroom:.*", r"toa soan:.*", r"联系我们.*", r"お問い合わせ.*", r"문의 \| .*", r"ติดต่อเรา.*",
        r"theo doi .* tren ung dung", r"follow .* in the app", r"tai ung dung .*", r"dang ky nhan ban tin .*", r"sign up for our .*", r"doc tiep", r"tu khoa:.*", r"tags?:.*", r"\[anh: .*\]", r"\[photo: .*\]",
    ])
)
HEADS = re.compile(r"tin lien quan|tin moi nhat|cung chuyen muc|bai noi bat|co the ban quan tam|doc nhieu|most read|trending now|you may also like|latest|more from .*")


def labels(text: str) -> list[bool]:
    out, linked = [], False
    for line, folded in zip(text.split("\n"), b.folded_lines(text)):
        bare = b.without_aside(folded)
        hit = bool(LINES.fullmatch(bare) or LINES.fullmatch(folded))
        headline = not b.ends_sentence(line) and len(bare.split()) >= 4
        if linked and headline and not hit:
            out.append(True)
            continue
        linked = bool(HEADS.fullmatch(bare)) or (linked and hit)
        out.append(hit)
    return out


def main(path: str) -> None:
    import pyarrow.parquet as pq

    rows = [r for r in pq.read_table(path, columns=["article_id", "text", "sitename", "source_domain"]).to_pylist() if r["text"]][:SAMPLE]
    n = np.zeros(1 << b.SLOT_BITS, np.int32)
    for r in rows:
        site = b.fold(r["sitename"] or "").strip()
        n[list({b._slot(x, site) for x in b.folded_lines(r["text"])})] += 1
    n = b.relative(n, len(rows))
    made = [(b.page_features(r["text"], r["sitename"], r["source_domain"], n), labels(r["text"])) for r in rows]
    held = [k % 5 == 0 for k in range(len(made))]
    x, y = np.concatenate([m[0][0] for m, h in zip(made, held) if not h]), np.concatenate([m[1] for m, h in zip(made, held) if not h]).astype(float)
    told = b.fit_trees(x, y)
    for t in told["trees"]:
        t["cut"], t["value"] = [round(v, 5) for v in t["cut"]], [round(v, 5) for v in t["value"]]
    b.MODEL.write_text(json.dumps(told, separators=(",", ":")))
    model, wrong, total = b.Trees(told), [], 0
    for (f, truth), h, r in zip(made, held, rows):
        if h:
            got = b.decode(model.logits(f[0]), f[1], f[2], f[0][:, 0])
            total += len(truth)
            wrong += [(bool(t), line) for t, g, line in zip(truth, got, r["text"].split("\n")) if t != g]
    print(f"{total} held-out lines, {len(wrong)} differ from their labels")
    for w in wrong[:60]:
        print(w[0], repr(w[1][:120]))


if __name__ == "__main__":
    main(sys.argv[1])
