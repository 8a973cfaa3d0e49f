"""Variant spellings of issuers' names (problem 5): a noisy channel.

Frequent spellings that an issuer's reviewed names explain without error are its candidate
forms; their shares are the prior. Every distinct spelling is then given the issuer of
greatest posterior. The channel explains its words one by one: by a word of the issuer's
core (in full, mistyped, in the keystrokes of an input method), by another of its words or
one that goes with them (in full, by initials, glued, split, mistyped), by a legal form or
the like, or not at all. Costs are negative log likelihoods. A spelling is nobody's where a
stranger is more probable: an unexplained word, a missing core or another entity's name (an
exclusion) says so.

The lexicon is learnt from the registry and the harvested names: which words of a core stand
together, and which words go with those of the reviewed names, as a trade's translation does;
a stranger's words (land, holdings) stand beside issuers of every trade and go with none. How
common words are comes from a hashed table of fixed size, in which a spelling counts once
however often it is repeated. Null, blank and wordless names mean no issuer; repeated names
are scored once and count each.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from lamina.session import cut

WORD_BITS = 18
#: Costs in nats: a mistyped letter, initials, all words but the core left out, keystrokes, a mistyped legal form, a word that isn't the issuer's but goes with one.
TYPO, INITIAL, BARE, KEYS, LEGAL_TYPO, AKIN = 3.0, 1.5, 1.0, 0.7, 1.5, 0.3
#: Weight of the prior, and the share that an issuer without a frequent spelling counts with.
PRIOR, UNSEEN = 0.2, 0.002
#: Words of more letters are compared with such marks one by one, as they leave too many parts.
LONG = 30
#: Words go together where so many issuers have both, so great a share of those with the first, and so much more often than by
#: chance (in reviewed names, in any names); or where two have both and hardly another has either.
TOGETHER, SHARE, LIFT = 3, 0.3, (3.0, 4.0)
#: A stranger's cost: where an issuer costs more than this, the name is nobody's.
STRANGER = 9.5
#: A mistyping costs no more than its letters while what it would stand for is so many times as common, itself seen so
#: often more than it was (the smoothing); beyond that, so many nats for each e-fold.
RARER, SEEN, COMMON = 12.0, 12.0, 2.0

#: Legal forms, and what else stands beside a name without changing who is meant (fixed values).
LEGAL = frozenset("cong ty co phan cp ctcp ct cty tong nhom c jsc j s corp corporation company limited ltd joint stock group vn hose hnx upcom baocaothuongnien the and va".split())
#: Those of them that may be mistyped; a word near a mere conjunction is its own.
FORMS = LEGAL - {"and", "the", "va", "vn"}
def fold(text: str) -> str:
    text = unicodedata.normalize("NFKD", text.lower().replace("đ", "d").replace("ƣ", "u").replace("ð", "d"))
    return "".join(c for c in text if not unicodedata.combining(c)).replace("ơ", "o").replace("ư", "u")


_digits = str.maketrans("0156", "olso")


def words_of(name: str) -> list[str]:
    """Folded words; digits among letters are read as the letters they look like."""
    out = re.findall(r"[a-z0-9]+", fold(name))
    return [w.translate(_digits) if re.search("[a-z]", w) and re.search("[0156]", w) else w for w in out]


_tone = re.compile("(?<=[aeiouyw])([a-z]*?)[sfrxj](?![a-z])|[sfrxj](?=[a-z]?$)")


@lru_cache(1 << 14)
def keystrokes(word: str) -> str:
    """The word that an input method's (Telex) keystrokes stand for, without accents."""
    w = re.sub("uow", "uo", word)
    w = re.sub("(aa|ee|oo|dd)", lambda m: m[0][0], w)
    w = re.sub("(?<=[auo])w|w(?=[a-z])", lambda m: "" if m.start() and w[m.start() - 1] in "auo" else "u", w)
    w = re.sub("([aeo])([a-z]*)\\1", lambda m: m[1] + m[2], w) if re.search("([aeo])[ncmptg]*\\1", w) else w
    return re.sub("[sfrxj]$", "", re.sub("(?<=[aeiouy])[sfrxj](?=[a-z])", "", w)) or word


@lru_cache(1 << 16)
def edits(a: str, b: str) -> int:
    """Insertions, deletions, changes and swaps of neighbours from a to b; 3 and more count as 3."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > 2:
        return 3
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            v = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if before and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            new.append(v)
        before, row = row, new
    return min(3, row[-1])


def _slot(word: str) -> int:
    import xxhash

    return xxhash.xxh32_intdigest(word) >> (32 - WORD_BITS)


class Registry:
    """What the reviewed names say by themselves: each issuer's words, and phrases that several issuers share."""

    def __init__(self, tickers: list[str], names: list[list[str]], core_tokens: list[list[str]]):
        self.tickers, self.names = tickers, [[words_of(n) for n in ns] for ns in names]
        pairs = Counter(p for ns in self.names for p in {p for ws in ns for p in zip(ws, ws[1:])})
        shared = {p for p, n in pairs.items() if n >= TOGETHER}
        self.core_tokens = [[fold(w) for w in ws or []] for ws in core_tokens]
        # Core words that many issuers have next to each other tell a quality (international) and no issuer.
        self.distinct = [[w for w in ws if not any((w, x) in shared or (x, w) in shared for x in ws)] or ws for ws in self.core_tokens]
        self.words = [{w for ws in ns for w in ws if w not in LEGAL} | set(core) for ns, core in zip(self.names, self.core_tokens)]
        self.runs = [Counter(r for ws in ns for r in runs_of(ws, core)) for ns, core in zip(self.names, self.distinct)]

    def pairs(self) -> dict[tuple[str, ...], int]:
        """The neighbours among core words, or the one core word, that tell one issuer alone."""
        told: dict[tuple[str, ...], set[int]] = {}
        for k, runs in enumerate(self.runs):
            for r in runs:
                if len(r) == min(2, max(map(len, runs))):
                    told.setdefault(r, set()).add(k)
        return {r: next(iter(ks)) for r, ks in told.items() if len(ks) == 1}


def runs_of(words: list[str], core: list[str]) -> set[tuple[str, ...]]:
    """Stretches of core words in a name."""
    out = set()
    for i in range(len(words)):
        j = i
        while j < len(words) and words[j] in core:
            j += 1
            out.add(tuple(words[i:j]))
    return out


def core_of(runs: Counter, otherwise: list[str]) -> tuple[str, ...]:
    """Of an issuer's core words those that stand together in its names: the longest stretch among the commonest ones.
    Words that only some names have beside them tell a trade or quality (green), not the issuer."""
    most = max((n for r, n in runs.items() if len(r) > 1), default=0) or max(runs.values(), default=0)
    return max((r for r, n in runs.items() if n >= 0.85 * most and len(r) > (max(map(len, runs)) > 1)), key=lambda r: (len(r), runs[r], r), default=tuple(otherwise))


def evidence(wordings: DataFrame, registry: Registry) -> DataFrame:
    """(issuer, kind, said, n): how many wordings (key) that hold words telling an issuer alone have which other
    words (kind word) and which stretches of its core words (kind run)."""
    pairs, distinct = registry.pairs(), registry.distinct

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out: Counter = Counter()
            for key in batch.column(0).to_pylist():
                ws = key.split(" ")
                ks = {pairs[p] for p in zip(ws, ws[1:]) if p in pairs} | {pairs[(w,)] for w in ws if (w,) in pairs}
                for k in ks:
                    out.update((k, "word", w) for w in set(ws) if w not in LEGAL)
                    out.update((k, "run", " ".join(r)) for r in runs_of(ws, distinct[k]))
            k, kind, said = map(list, zip(*out)) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(kind, pa.string()), pa.array(said, pa.string()), pa.array(list(out.values()), pa.int64())], ["issuer", "kind", "said", "n"])

    return wordings.select("key").mapInArrow(run, "issuer int, kind string, said string, n bigint").groupBy("issuer", "kind", "said").agg(F.sum("n").alias("n"))


def akin_words(said: DataFrame, registry: Registry) -> dict[str, dict[str, float]]:
    """Word of reviewed names -> words that go with it, by their share: a trade and its translation. At most the
    registry's words times those that a SHARE of a word's issuers have."""
    spark, issuers = said.sparkSession, max(1, len(registry.words))
    own = spark.createDataFrame([(k, w) for k, ws in enumerate(registry.words) for w in sorted(ws)] or [(-1, "")], "issuer int, v string")
    with_ = said.filter("kind = 'word'").select("issuer", F.col("said").alias("w")).unionByName(own.select("issuer", F.col("v").alias("w"))).distinct()
    common = with_.join(with_.groupBy("w").agg(F.count("*").alias("base")).filter("base > 1"), "w")
    share = F.col("n") / F.col("have")
    found = None
    # An issuer has a word where its reviewed names hold it; and, as those are few, where any name does.
    for lift, given in zip(LIFT, (own, common.join(own.select(F.col("v").alias("w")).distinct(), "w", "left_semi").select("issuer", F.col("w").alias("v")))):
        both = given.join(common, "issuer").filter("v <> w").groupBy("v", "w").agg(F.count("*").alias("n"), F.first("base").alias("base")).filter("n > 1")
        often = (F.col("n") >= TOGETHER) & (share >= SHARE) & (share >= lift * F.col("base") / issuers)
        told = both.join(given.groupBy("v").agg(F.count("*").alias("have")), "v").filter(often | ((share == 1) & (F.col("base") <= F.col("n") + 1))).select("v", "w", share.alias("p"))
        found = told if found is None else found.unionAll(told)
    rows = found.groupBy("v", "w").agg(F.max("p").alias("p")).collect()
    out: dict[str, dict[str, float]] = {}
    for r in rows:
        out.setdefault(r.v, {})[r.w] = r.p
    return out


class Issuer:
    """An issuer's core, its other words with their costs, the initials they may be written by, and one-word brands."""

    def __init__(self, registry: Registry, k: int, runs: Counter, akin: dict[str, dict[str, float]]):
        self.ticker, spelled = registry.tickers[k].lower(), registry.names[k]
        core = registry.core_tokens[k]
        self.core = core_of(registry.runs[k] + runs, registry.distinct[k])
        own = {w for w in registry.words[k] if w not in self.core and w != self.ticker}
        self.lexicon = dict.fromkeys(sorted(own), 0.0)
        for v in sorted(own):
            for w, p in akin.get(v, {}).items():
                if w not in self.core:
                    self.lexicon[w] = min(self.lexicon.get(w, math.inf), AKIN - math.log(p))
        # Neighbours among the issuer's own words: phrases that may be glued or written by their initials.
        self.glued: dict[str, float] = {}
        self.initials: set[str] = set()
        for ws in spelled:
            rest = [w if w in self.lexicon else "" for w in ws]
            for i in range(len(rest)):
                for j in range(i + 1, min(len(rest), i + 3) + 1):
                    part = rest[i:j]
                    if "" in part:
                        break
                    self.initials.add("".join(w[0] for w in part))
                    self.initials.add(part[0][0] * 2)
                    if len(part) > 1:
                        self.glued["".join(part)] = 1.0
        # One word that is nobody's core, no shared word and no legal form is a brand.
        shared = Counter(w for ws in registry.words for w in ws)
        known = set(self.core) | set(core) | LEGAL | {w for w, n in shared.items() if n > 1} | set(akin) | {w for d in akin.values() for w in d}
        self.brands = {ws[0] for ws in ([w for w in ws if w not in LEGAL] for ws in spelled) if len(ws) == 1 and len(ws[0]) >= 5 and ws[0] != self.ticker and ws[0] not in known}
        self.brands = {b for b in self.brands if all(edits(b, k) > (2 if len(k) > 6 else 1) for k in known)}
        for b in self.brands:
            self.lexicon.pop(b, None)


def without_letters(word: str, most: int) -> set[str]:
    """The word with up to ``most`` letters left out."""
    out = last = {word}
    for _ in range(most):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out = out | last
    return out


class Channel:
    def __init__(self, issuers: list[Issuer], strangers: set[tuple], counts: np.ndarray):
        self.issuers, self.strangers, self.counts = issuers, strangers, counts
        self.marks: dict[str, set[int]] = {}
        for k, i in enumerate(issuers):
            for w in (i.ticker, *i.brands, *i.core, "".join(i.core)):
                self.marks.setdefault(w, set()).add(k)
        # Marks by what is left of them without some letters: a word within two edits leaves the same.
        self.left: dict[str, set[str]] = {}
        for m in self.marks:
            for x in without_letters(m, 2 if len(m) > 5 else 1) if len(m) <= LONG else ():
                self.left.setdefault(x, set()).add(m)
        self.long = [m for m in self.marks if len(m) > LONG]
        self._near: dict[str, set[int]] = {}
        self._letters: dict[tuple[str, str], float | None] = {}

    def near(self, word: str) -> set[int]:
        """Issuers one of whose own words ``word`` may stand for."""
        if word not in self._near:
            if len(self._near) > 200_000:
                self._near.clear()
            found = set()
            for typed, certain in ((word, True), (keystrokes(word), False)):
                left = without_letters(typed, 2 if len(typed) > 3 else 1) if len(typed) <= LONG + 2 else ()
                long = [m for m in self.long if abs(len(m) - len(typed)) <= 2] if len(typed) >= LONG - 1 else []
                for m in set(long).union(*(self.left.get(x, ()) for x in left)):
                    if edits(typed, m) <= ((2 if len(m) > 5 else 1) if certain else 1):
                        found |= self.marks[m]
            self._near[word] = found
        return self._near[word]

    def common(self, word: str) -> float:
        return float(self.counts[_slot(word)])

    def own_word(self, given: str, meant: str) -> float:
        """What the likelihood that ``given`` is a word of its own adds to the cost of its being ``meant`` mistyped."""
        return COMMON * max(0.0, math.log(max(1.0, RARER * self.common(given)) / (self.common(meant) + 1 + SEEN)))

    def letter_cost(self, given: str, meant: str) -> float | None:
        """Cost of ``given`` standing for ``meant``, or None."""
        key = given, meant
        if key not in self._letters:
            if len(self._letters) > 500_000:
                self._letters.clear()
            self._letters[key] = self._letter_cost(given, meant)
        return self._letters[key]

    def _letter_cost(self, given: str, meant: str) -> float | None:
        if given == meant:
            return 0.0
        if keystrokes(given) == meant:
            return KEYS
        n = edits(given, meant)
        if n <= (1 if len(meant) <= 5 else 2) and len(meant) > 1:
            return TYPO * n + self.own_word(given, meant)
        n = edits(keystrokes(given), meant)
        if n <= 1 and len(meant) > 3:
            return KEYS + TYPO * n + self.own_word(given, meant)
        return None

    def phrase(self, left: list[str], parts: tuple[str, ...]) -> tuple[float, list[str]] | None:
        """Cost of finding words next to each other in ``left``, and the words then left."""
        best = None
        for i in range(len(left) - len(parts) + 1):
            costs = [self.letter_cost(left[i + k], p) for k, p in enumerate(parts)]
            if None not in costs and (best is None or sum(costs) < best[0]):
                best = (sum(costs), left[:i] + left[i + len(parts) :])
        glued = "".join(parts)
        if best is None and len(parts) > 1:
            for i, w in enumerate(left):
                if (c := self.letter_cost(w, glued)) is not None and (best is None or 1 + c < best[0]):
                    best = (1 + c, left[:i] + left[i + 1 :])
            for i in range(len(left) - len(parts)):  # one word split in two by a stray blank or dot
                if "".join(left[i : i + len(parts) + 1]) == glued and best is None:
                    best = (TYPO, left[:i] + left[i + len(parts) + 1 :])
        return best

    def word_cost(self, w: str, issuer: Issuer, beside: tuple[str, ...]) -> tuple[float, bool]:
        """Cost of a word beside the core, and whether it is one of the issuer's; ``beside`` are its neighbours."""
        if w in LEGAL or keystrokes(w) in LEGAL:
            return 0.0, False
        if w in issuer.lexicon:
            return issuer.lexicon[w], True
        if w in issuer.initials:
            return INITIAL, True
        best = issuer.glued.get(w, STRANGER)
        sure = any(x in issuer.lexicon for x in beside)
        for v, fee in issuer.lexicon.items():
            if abs(len(v) - len(w)) > 4:
                continue
            c = self.letter_cost(w, v)
            if c is not None and sure and edits(w, v) == 1:  # beside a right word one may be mistyped into another common one
                c = min(c, TYPO + 1.5)
            if c is not None or sure and len(v) > 1 and edits(w, v) == 1 and (c := TYPO + 1.5):
                best = min(best, fee + c)
        for v, fee in issuer.glued.items():
            if (c := self.letter_cost(w, v)) is not None:
                best = min(best, fee + c)
        if best < STRANGER:
            return best, True
        near = [x for x in FORMS if len(x) > 1 and edits(w, x) == 1 or edits(keystrokes(w), x) == 1 and len(x) > 2]
        typo = LEGAL_TYPO + min((self.own_word(w, x) for x in near), default=STRANGER)
        if typo < STRANGER:
            return typo, False
        return (2 * LEGAL_TYPO if any(len(x) > 6 and edits(w, x) == 2 for x in FORMS) else STRANGER), False

    def cost(self, words: list[str], issuer: Issuer) -> float:
        best = math.inf
        for mark, fee in [(issuer.ticker, 0.0)] + [(b, 0.2) for b in issuer.brands]:
            for i, w in enumerate(words):
                c = 0.0 if w == mark else TYPO if len(mark) > 4 and edits(w, mark) == 1 else 2 * TYPO if len(mark) > 7 and edits(w, mark) == 2 else None
                if c is not None:
                    if c > TYPO and w not in LEGAL:
                        c += self.own_word(w, mark)
                    best = min(best, fee + c + self.rest(words[:i] + words[i + 1 :], issuer, False))
        found = issuer.core and self.phrase(words, issuer.core)  # without a core only a ticker or brand names it
        if found and found[0] < STRANGER:
            best = min(best, found[0] + self.rest(found[1], issuer, True))
        return best

    def rest(self, left: list[str], issuer: Issuer, by_core: bool) -> float:
        """Cost of the words beside the core, the ticker or a brand."""
        if not by_core and issuer.core and (found := self.phrase(left, issuer.core)):
            left = found[1] if found[0] < STRANGER else left
        total, told, i = 0.0, False, 0
        while i < len(left) and total < STRANGER:
            c, own = self.word_cost(left[i], issuer, (*left[max(0, i - 1) : i], *left[i + 1 : i + 2]))
            step = 1
            if c >= TYPO and i + 1 < len(left) and (left[i] + left[i + 1] in issuer.lexicon or left[i] + left[i + 1] in LEGAL):
                c, own, step = min(c, TYPO), True, 2  # one word split in two
            total, told, i = total + c, told or own, i + step
        return total + (BARE if by_core and issuer.lexicon and not told else 0.0)

    def explained(self, name: str) -> list[tuple[str, float]]:
        """(ticker, cost) of the issuers that explain the name better than a stranger does."""
        words = words_of(name)
        if not words or tuple(w for w in words if w not in LEGAL) in self.strangers:
            return []
        near = sorted(set().union(*map(self.near, words)))
        return [(i.ticker.upper(), c) for i in (self.issuers[k] for k in near) if (c := self.cost(words, i)) < STRANGER]


def _keys(batches):
    import pyarrow as pa

    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([" ".join(words_of(name or "")) for name in batch.column(0).to_pylist()], pa.string())], ["alias_name", "n", "key"])


def _word_counts(batches):
    import pyarrow as pa

    counts = np.zeros(1 << WORD_BITS, np.int64)
    for batch in batches:
        for name in batch.column(0).to_pylist():
            for w in words_of(name or ""):
                counts[_slot(w)] += 1
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used])], ["slot", "n"])


def attribute_names(names: DataFrame, registry: DataFrame) -> DataFrame:
    """(alias_name, ticker) of the distinct spellings of ``names`` (alias_name) that mean an issuer of
    ``registry``, a reviewed list of at most some thousands of rows."""
    rows = registry.select("ticker", "canonical_name", "core_tokens", "aliases", "exclusions").filter("ticker is not null").collect()
    told = [[n for n in (r.canonical_name, *(r.aliases or [])) if n] for r in rows]
    book = Registry([r.ticker for r in rows], told, [r.core_tokens for r in rows])
    strangers = {tuple(w for w in words_of(e["name"] or "") if w not in LEGAL) for r in rows for e in r.exclusions or [] if e} - {()}
    # Copies and mere case or accents make no word more common: each wording counts once.
    spelled = names.filter(F.col("alias_name").rlike(r"\S")).groupBy("alias_name").agg(F.count("*").alias("n")).mapInArrow(_keys, "alias_name string, n bigint, key string")
    spelled = cut(spelled.filter("key <> ''"))
    wordings = spelled.groupBy("key").agg(F.sum("n").alias("n"))
    said = cut(evidence(wordings, book))
    runs: dict[int, Counter] = {}
    for r in said.filter("kind = 'run'").collect():  # at most the stretches of each issuer's few core words
        runs.setdefault(r.issuer, Counter())[tuple(r.said.split(" "))] = r.n
    akin = akin_words(said, book)
    issuers = [Issuer(book, k, runs.get(k, Counter()), akin) for k in range(len(rows))]
    got = wordings.select("key").mapInArrow(_word_counts, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << WORD_BITS, np.int64)
    counts[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    for i in issuers:  # the registry's own words count too
        for w in (*i.core, i.ticker, *i.brands):
            counts[_slot(w)] += 1
    sc = names.sparkSession.sparkContext
    shared = sc.broadcast((issuers, strangers, counts))

    def run(batches):
        import pyarrow as pa

        channel = Channel(*shared.value)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                found = [channel.explained(key) for key in part.column(0).to_pylist()]
                at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]), pa.int64())
                flat = [x for f in found for x in f]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(at), part.column(1).take(at), pa.array([t for t, _ in flat], pa.string()), pa.array([c for _, c in flat], pa.float64())], ["key", "n", "ticker", "cost"]
                )

    # Few bytes and much work: wordings are dealt evenly, each scored once, and what explains them is kept for the posterior.
    explained = cut(wordings.repartition(4 * sc.defaultParallelism, "key").mapInArrow(run, "key string, n bigint, ticker string, cost double"))
    forms = explained.filter((F.col("n") > 1) & (F.col("cost") < TYPO)).groupBy("ticker").agg(F.sum("n").alias("forms"))  # at most a row an issuer
    total = forms.agg(F.sum("forms").alias("total"))
    prior = forms.select("ticker", (F.col("forms") / F.lit(total.first()[0] or 1)).alias("share"))
    scored = explained.join(prior, "ticker", "left").withColumn("score", F.col("cost") - PRIOR * F.log(F.coalesce("share", F.lit(0.0)) + UNSEEN))
    ranked = scored.groupBy("key").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "cost", "ticker"))), 1, 2).alias("r"))  # at most a row an issuer in each
    second = F.when(F.size("r") > 1, F.col("r")[1]["score"] - F.col("r")[0]["score"])
    best = ranked.filter(~(F.coalesce(second < 0.5, F.lit(False)) & (F.col("r")[0]["cost"] > 2 * TYPO)))  # two issuers as probable: nobody's
    return spelled.join(best.select("key", F.col("r")[0]["ticker"].alias("ticker")), "key").select("alias_name", "ticker")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    names = spark.read.parquet(f"{folder}/issuer_aliases.parquet").select("alias_id", "alias_name")
    told = attribute_names(names, spark.read.parquet(f"{folder}/issuer_registry.parquet"))
    return names.join(told, "alias_name").select("alias_id", "ticker")
