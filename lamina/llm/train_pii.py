"""Trains the network of problem 10: python -m lamina.llm.train_pii DOCUMENTS.parquet

The labelled spans are those that patterns find in at most SAMPLE documents: what stands
after or before words that announce a person, a number or a place. Every tenth document is
held out. Loss: negative log likelihood of the CRF; gradients by hand; Adam.
"""

from __future__ import annotations

import re
import sys
import time

import numpy as np

from lamina.llm import pii as p

#: Greatest number of labelled documents.
SAMPLE = 10_000

_full = rf"(?:{p.SURNAMES}|{p.SURNAMES.upper()})(?: {p.WORD}){{2,3}}"
NAMES = [
    re.compile(rf"(?<![\w])({_full})(?![\w])"),
    re.compile(rf"(?<!\w)(?:{p.ADDRESSED}) ?({p.WORD}(?: {p.WORD}){{0,3}})"),
    re.compile(r"(?:taken by|filed by|parcel for|Contact|Dear|went to) (?:M[rs]s?\. )?(?!M[rs]s?\b)([A-Z][A-Za-z]+(?: [A-Z][A-Za-z]+)?)(?=[ ;,.(])"),
    re.compile(r"\bAs ([A-Z][A-Za-z]+)(?=, a )"),
    re.compile(r"([A-Z][A-Za-z]+ [A-Z][A-Za-z]+)(?= told the )"),
]
PHONES = re.compile(rf"(?:gọi lại theo số|phản ánh|điện thoại|ĐT:|[Cc]all|on|電話：|电话：|문의:|ติดต่อ|appeler le|teléfono|[Tt]el\.?:?|answered)\s?({p.PHONE.pattern})")
IDS = re.compile(rf"(?:CMND|CCCD số|CCCD|ID|[Pp]assport|[Hh]ộ chiếu(?: số)?|giấy tờ:|giấy tờ(?: tùy thân)?(?: số)?|giấy (?:CMND |CCCD |chứng minh )?số|căn cước(?: số)?)\s({p.IDENTITY.pattern})|(?:ghi|went to) {p.WORD}(?: {p.WORD})* \(({p.IDENTITY.pattern})\)")
ADDRESSES = re.compile(rf"(?:ở số|tại số|tại|địa chỉ nhận:|well at|went to|living at|địa chỉ:|trú tại số|nhà)\s({p.ADDRESS.pattern})")


def spans(text: str) -> list[tuple[str, int, int]]:
    out = []
    for kind, pattern in (("email", p.EMAIL), ("phone", PHONES), ("id", IDS), ("address", ADDRESSES)):
        for m in pattern.finditer(text):
            g = 0 if kind == "email" else 1 if m.group(1) else 2
            digits = sum(c.isdigit() for c in m.group(g))
            if kind == "email" and "." not in m[0] and "dot" not in m[0] or kind == "phone" and digits < 8 or kind == "id" and digits < 7 or kind == "email" and re.search(r"\bat\b", m[0]) and not re.search(r"dot|[\[(]", m[0]):
                continue
            out.append((kind, m.start(g), m.end(g)))
    taken = sorted(out, key=lambda s: s[1])
    for pattern in NAMES:
        for m in pattern.finditer(text):
            a, b = m.span(1)
            if not p._organisation.search(text, max(0, a - 24), a) and not any(a < e and s < b for _, s, e in taken):
                taken.append(("name", a, b))
    return sorted(taken, key=lambda s: s[1])


def examples(labelled: list[tuple[str, list]]) -> tuple[np.ndarray, np.ndarray]:
    """Classes and tags of all windows of texts with their spans."""
    classes, starts = p.lay_out([t for t, _ in labelled])
    y = np.zeros(len(classes), np.uint8)
    for (_, told), start in zip(labelled, starts):
        for kind, a, b in told:
            k = 1 + 2 * p.KINDS.index(kind)
            y[start + a] = k
            y[start + a + 1 : start + b] = k + 1
    w = np.arange(len(classes) // p.STRIDE)
    return p.windows(classes, w).copy(), p.windows(y, w).copy()


def moved_emails(texts: list[str], rng, n: int = 2500) -> list[str]:
    """Addresses put into other texts, as they may stand anywhere and in any language."""
    found = [t[a:b] for t in texts for kind, a, b in spans(t) if kind == "email"]
    out = []
    while len(out) < n and found:
        t = texts[rng.integers(len(texts))]
        at = int(rng.integers(len(t)))
        if any(a < at < b for _, a, b in spans(t)):
            continue
        gap = "" if t[max(0, at - 1) : at] > "\u2e80" else " "
        out.append(t[max(0, at - 90) : at].rstrip() + gap + found[rng.integers(len(found))] + rng.choice([".", ",", "", " "]) + gap + t[at : at + 60].lstrip())
    return out


#: Surnames beside p.SURNAMES and names of other languages that stand in for labelled ones (fixed values).
UNLISTED = "Lâm Đào Vương Phùng Tống Từ Thân Ông Lại Đồng Văn Triệu Viên Bạch Mạc Kim Âu Trang Ninh Tiêu La Quan".split()
FOREIGN = "Ana Émile Jo Li Max Renée Iñigo Zoë Inés Björn Amélie Tom Mia Raúl Jürgen Céline Ben Eva Sofía Noël Kim Ivo Hélène Peña Müller Côté Ng Wu Roy Núñez Lefèvre Fox Day Ortiz Héroux Weber Sáenz Marín Ruiz Bélanger Cho Pham Bui".split()


#: Roles before a name and what follows it, in the languages of the documents (fixed values).
ROLES = (
    ("kiểm toán viên", "ký biên bản"), ("nhân chứng", "kể lại sự việc"), ("kỹ sư", "đo lại số liệu"), ("kế toán", "gửi hồ sơ"), ("tổ trưởng", "có mặt"), ("giám đốc", "trả lời"),
    ("the auditor", "signed the minutes"), ("the witness", "saw it"), ("our engineer", "measured it"), ("the accountant", "wrote back"), ("foreman", "was there"), ("her neighbour", "agreed"),
    ("l'ingénieur", "a signé"), ("le témoin", "a confirmé"), ("la ingeniera", "firmó el acta"), ("el testigo", "lo confirma"),
)


def introduced(texts: list[str], rng, n: int = 3000) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Texts with a clause put in at a sentence's end in which a role, not a form of address, announces a name; with their spans."""
    found = [t[a:b] for t in texts[:3000] for kind, a, b in spans(t) if kind == "name"]
    out = []
    while len(out) < n and found:
        t = texts[rng.integers(len(texts))]
        m = re.compile(r"(?<=[.;!?]) ").search(t, int(rng.integers(len(t))))
        if not m:
            continue
        words = found[rng.integers(len(found))].split(" ")
        if rng.random() < 0.6:
            words = [str(x) for x in rng.choice(FOREIGN if rng.random() < 0.5 else UNLISTED, 1)] + words[-int(rng.integers(1, 3)) :]
        role, rest = ROLES[rng.integers(len(ROLES))]
        role = role[0].upper() + role[1:] if rng.random() < 0.5 else role
        before, name = t[max(0, m.start() - 200) : m.end()] + role + " ", " ".join(words)
        told = [s for s in spans(before) if s[2] <= len(before) - len(role) - 1]
        after = f" {rest}. " + t[m.end() : m.end() + 100]
        told += [("name", len(before), len(before) + len(name))]
        told += [(k, a + len(before) + len(name), b + len(before) + len(name)) for k, a, b in spans(after)]
        out.append((before + name + after, told))
    return out


def varied(text: str, rng) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with names by unlisted or foreign ones and addresses in disguise, as they stand in the same places; its spans."""
    out, told, at, size = [], [], 0, 0
    for kind, a, b in spans(text):
        if a < at:
            continue
        s = text[a:b]
        if kind == "name":
            words = s.split(" ")
            if rng.random() < 0.5:
                s = " ".join([str(rng.choice(UNLISTED)), *(words[1:] if len(words) > 1 else words)][: int(rng.integers(2, 5))])
            elif rng.random() < 0.8:
                s = " ".join(str(x) for x in rng.choice(FOREIGN, 1 if len(words) == 1 else int(rng.integers(2, 4))))
        elif kind == "email" and "@" in s and s.count("@") == 1:
            user, host = (x.strip(" [()]") for x in s.split("@"))
            sign = str(rng.choice(["＠", " [AT] ", " (at) ", "[at]", " at ", " [a còng] ", " a còng ", "@", " (At) ", " AT "]))
            dot = str(rng.choice([" chấm ", " [dot] ", " dot ", " dot ", " DOT ", "[dot]"] if sign.strip(" ").lower() in ("at", "a còng") else [".", ".", " [dot] ", " chấm ", " (chấm) "]))
            new = user + sign + re.sub(r"\.", dot, host)
            if p.EMAIL.fullmatch(new):
                s = new
        out += [text[at:a], s]
        size += a - at
        told.append((kind, size, size + len(s)))
        size, at = size + len(s), b
    return "".join([*out, text[at:]]), told


def forward(w, x, side):
    """States with what the gradients need; x (T, N)."""
    t_max, n = x.shape
    size = p.HIDDEN
    h, c, kept = np.zeros((n, size), np.float32), np.zeros((n, size), np.float32), []
    out = np.empty((t_max, n, size), np.float32)
    for t in range(t_max):
        g = h @ w[f"re_{side}"] + w[f"in_{side}"][x[t]]
        gate, new = np.clip(g[:, : 3 * size], 0, 1), np.clip(g[:, 3 * size :], -1, 1)
        open_ = np.concatenate([(g[:, : 3 * size] > -0.1) & (g[:, : 3 * size] < 1.1), np.abs(g[:, 3 * size :]) < 1.1], 1)
        before, old = c, h
        c = gate[:, size : 2 * size] * c + gate[:, :size] * new
        squashed = np.clip(c, -1, 1)
        h = gate[:, 2 * size :] * squashed
        kept.append((gate, new, open_, before, c, squashed, old))
        out[t] = h
    return out, kept


def backward(w, x, side, kept, dout, grads):
    size = p.HIDDEN
    dh, dc = np.zeros_like(dout[0]), np.zeros_like(dout[0])
    for t in range(len(x) - 1, -1, -1):
        gate, new, open_, before, c, squashed, old = kept[t]
        dh = dh + dout[t]
        dc = dc + dh * gate[:, 2 * size :] * (np.abs(c) < 1.1)
        dg = np.concatenate([dc * new, dc * before, dh * squashed, dc * gate[:, :size]], 1) * open_
        dc = dc * gate[:, size : 2 * size]
        grads[f"re_{side}"] += old.T @ dg
        np.add.at(grads[f"in_{side}"], x[t], dg)
        dh = dg @ w[f"re_{side}"].T


def crf(e, y, moves):
    """Mean loss of tags y (N, T) under emissions e (N, T, K), and its gradients."""
    n, t_max, k = e.shape
    alpha = np.empty((t_max, n, k), np.float32)
    start = np.zeros(k, np.float32)
    alpha[0] = e[:, 0] + start
    for t in range(1, t_max):
        s = alpha[t - 1][:, :, None] + moves
        top = s.max(1)
        alpha[t] = np.log(np.exp(s - top[:, None]).sum(1)) + top + e[:, t]
    top = alpha[-1].max(1)
    z = np.log(np.exp(alpha[-1] - top[:, None]).sum(1)) + top
    beta = np.zeros((n, k), np.float32)
    de, dm = np.empty_like(e), np.zeros_like(moves)
    de[:, -1] = np.exp(alpha[-1] - z[:, None])
    for t in range(t_max - 1, 0, -1):
        ahead = beta + e[:, t]
        pair = np.exp(alpha[t - 1][:, :, None] + moves + ahead[:, None, :] - z[:, None, None])
        dm += pair.sum(0)
        s = moves + ahead[:, None, :]
        top = s.max(2)
        beta = np.log(np.exp(s - top[:, :, None]).sum(2)) + top
        de[:, t - 1] = np.exp(alpha[t - 1] + beta - z[:, None])
    rows = np.arange(n)[:, None]
    gold = e[rows, np.arange(t_max), y].sum(1) + moves[y[:, :-1], y[:, 1:]].sum(1)
    de[rows, np.arange(t_max), y] -= 1
    np.add.at(dm, (y[:, :-1].ravel(), y[:, 1:].ravel()), -1)
    return float((z - gold).mean()), de / n, dm / n


def main(path: str, minutes: float = 5.0, further: float = 0, out=p.MODEL) -> None:
    """Trains anew, or with ``further`` goes on from the fitted file."""
    import pyarrow.parquet as pq

    texts = [t for t in pq.read_table(path, columns=["text"]).column(0).to_pylist() if t][:SAMPLE]
    held, used = texts[::10], [t for i, t in enumerate(texts) if i % 10]
    rng = np.random.default_rng(1)
    texts = used + moved_emails(used, rng)
    x, y = examples([(t, spans(t)) for t in texts] + [varied(t, rng) for t in texts if spans(t)] + [varied(t, rng) for t in moved_emails(used, rng, 4000)] + introduced(used, rng))
    # Windows without a mention teach less: keep a third of them.
    keep = (y > 0).any(1) | (rng.random(len(y)) < 0.33)
    x, y = x[keep], y[keep]
    print(len(x), "windows,", int((y % 2 == 1).sum()), "spans", flush=True)
    size = p.HIDDEN
    w = {k: v.copy() for k, v in p.network().w.items()} if further else {}
    for s in "" if further else "fb":
        w[f"in_{s}"] = rng.normal(0, 0.15, (p.CLASSES, 4 * size)).astype(np.float32)
        w[f"in_{s}"][:, : 3 * size] += 0.5
        w[f"in_{s}"][:, size : 2 * size] += 0.3  # remember at first
        w[f"re_{s}"] = rng.normal(0, 0.5 / size**0.5, (size, 4 * size)).astype(np.float32)
        w[f"out_{s}"] = rng.normal(0, 0.3, (size, p.TAGS)).astype(np.float32)
    if not further:
        w["bias"] = np.zeros(p.TAGS, np.float32)
        w["bias"][0] = 1
        w["moves"] = np.zeros((p.TAGS, p.TAGS), np.float32)
    ban = np.where(p.allowed(), 0, -30).astype(np.float32)
    ban[0, :] = np.where(p.allowed()[0], 0, -8)  # a window may begin inside a span
    m1, m2, step, began, batch = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0, time.time(), 128
    total = minutes * 60
    while time.time() - began < total:
        order = rng.permutation(len(x))
        losses = []
        for a in range(0, len(order) - batch, batch):
            rows = order[a : a + batch]
            xt, yb = np.ascontiguousarray(x[rows].T), y[rows].astype(np.int64)
            f, kf = forward(w, xt, "f")
            b, kb = forward(w, xt[::-1], "b")
            back = b[::-1]
            e = (f @ w["out_f"] + back @ w["out_b"] + w["bias"]).transpose(1, 0, 2)
            loss, de, dm = crf(np.ascontiguousarray(e), yb, w["moves"] + ban)
            losses.append(loss)
            g = {k: np.zeros_like(v) for k, v in w.items()}
            d = np.ascontiguousarray(de.transpose(1, 0, 2))
            flat = d.reshape(-1, p.TAGS)
            g["out_f"], g["out_b"], g["bias"], g["moves"] = f.reshape(-1, size).T @ flat, back.reshape(-1, size).T @ flat, flat.sum(0), dm * p.allowed()
            backward(w, xt, "f", kf, d @ w["out_f"].T, g)
            backward(w, xt[::-1], "b", kb, (d @ w["out_b"].T)[::-1], g)
            norm = sum(float((v**2).sum()) for v in g.values()) ** 0.5
            step += 1
            left = max(0.02, 1 - (time.time() - began) / total)
            for k in w:
                v = g[k] * min(1.0, 5.0 / (norm + 1e-9))
                m1[k] = 0.9 * m1[k] + 0.1 * v
                m2[k] = 0.999 * m2[k] + 0.001 * v * v
                w[k] -= 0.006 * left * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
            if time.time() - began > total:
                break
        print(f"{time.time() - began:.0f} s, loss {np.mean(losses):.3f}", flush=True)
    np.savez_compressed(out, **{k: v.astype(np.float16) for k, v in w.items()})
    net = p.Network({k: v.astype(np.float16) for k, v in w.items()})
    hit = miss = extra = 0
    shown = []
    for text, got in zip(held, p.mentions_of(held, net)):
        want, found = set(spans(text)), set(got)
        hit, miss, extra = hit + len(want & found), miss + len(want - found), extra + len(found - want)
        shown += [("missed", k, text[max(0, a - 25) : a] + "<" + text[a:b] + ">" + text[b : b + 15]) for k, a, b in want - found]
        shown += [("extra", k, text[max(0, a - 25) : a] + "<" + text[a:b] + ">" + text[b : b + 15]) for k, a, b in found - want]
    print(f"held out: {hit} found as labelled, {miss} missed, {extra} others")
    for s in shown[:70]:
        print(s)


if __name__ == "__main__":
    main(sys.argv[1], *(float(a) for a in sys.argv[2:4]))
