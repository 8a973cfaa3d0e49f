"""Models as batch functions (X1-X8): protocols with stand-ins that need no network."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

LABELS = ("Environmental", "Social", "Governance", "Neutral")


def classify(texts: Column, logits: Callable[[list[str]], np.ndarray]) -> Column:
    """Scores by label, rounded to four places; ``logits`` gets a batch and is loaded once per worker."""

    @F.pandas_udf("map<string,double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            s = 1 / (1 + np.exp(-np.asarray(logits(batch.fillna("").tolist()), float)))
            yield pd.Series([dict(zip(LABELS, np.round(r, 4).tolist())) for r in s], dtype=object)

    return run(texts)


def keyword_logits(texts: list[str]) -> np.ndarray:
    """A stand-in classifier: one logit per pillar from words that occur."""
    words = (("khí", "nước", "rừng", "water", "emission"), ("công nhân", "học bổng", "worker", "pension"), ("kiểm toán", "hội đồng", "audit", "board"))
    out = np.full((len(texts), 4), -2.0)
    for i, t in enumerate(texts):
        low = t.lower()
        for k, ws in enumerate(words):
            out[i, k] += 2.5 * sum(w in low for w in ws)
        out[i, 3] = 1.5 if (out[i, :3] < 0).all() else -1.5
    return out


def attempts(call: Callable, given, tries: int, wait: float = 0.0):
    """The call's answer, tried again after an error, with a wait that grows each time; the last error is raised."""
    for k in range(tries):
        try:
            return call(given)
        except Exception:
            if k + 1 == tries:
                raise
            time.sleep(wait * (k + 1))


def extract(pages: DataFrame, extractor: Callable[[str], list[dict]], schema: str, tries: int = 2) -> DataFrame:
    """An extractor over pages (key, text): its rows with the key; a page that fails every time gives a row with its error."""

    def run(batches):
        for pdf in batches:
            rows = []
            for key, text in zip(pdf["key"], pdf["text"]):
                try:
                    rows += [{"key": key, **r, "error": None} for r in attempts(extractor, text or "", tries)]
                except Exception as e:  # the page is retried on the next run
                    rows.append({"key": key, "error": str(e)[:200]})
            yield pd.DataFrame(rows, columns=names)

    names = [f.split(" ")[0] for f in schema.split(", ")]
    names = ["key", *names, "error"]
    return pages.select("key", "text").mapInPandas(run, f"key {dict(pages.dtypes)['key']}, {schema}, error string")


def trigram_vectors(texts: list[str], size: int = 64) -> list[np.ndarray]:
    """A stand-in embedder: hashed character trigrams, of length one; zero for an empty text."""
    import zlib

    out = []
    for t in texts:
        v = np.zeros(size, np.float32)
        for i in range(len(t) - 2):
            v[zlib.crc32(t[i : i + 3].encode()) % size] += 1
        out.append(v / max(1e-9, float(np.linalg.norm(v))))
    return out


def embed(texts: Column, size: int = 64, embedder: Callable[[list[str], int], list] = trigram_vectors, batch: int = 100, tries: int = 4) -> Column:
    """Vectors of texts in batches, each tried again after an error; a batch that fails every time gives zero vectors."""

    @F.pandas_udf("array<float>")
    def run(given: pd.Series) -> pd.Series:
        out, told = [], given.fillna("").tolist()
        for a in range(0, len(told), batch):
            part = told[a : a + batch]
            try:
                out += list(attempts(lambda p: embedder(p, size), part, tries))
            except Exception:  # what can't be embedded is like nothing
                out += [np.zeros(size, np.float32)] * len(part)
        return pd.Series(out)

    return run(texts)


def adjudicate_pairs(pairs: DataFrame, same: Callable[[int, int], bool], budget: int) -> list[tuple[int, int]]:
    """``adjudicate`` over a table of pairs (cosine, a, b), streamed to the driver in order, a part at a time, until the budget is spent."""
    head = pairs.orderBy(F.desc("cosine"), "a", "b").select("cosine", "a", "b")
    return adjudicate(((float(r[0]), int(r[1]), int(r[2])) for r in head.toLocalIterator()), same, budget)


def adjudicate(pairs: Iterable[tuple[float, int, int]], same: Callable[[int, int], bool], budget: int) -> list[tuple[int, int]]:
    """``pairs`` by falling similarity, asked about until the budget is spent; a pair that earlier merges joined costs
    nothing. A judge that fails says no. Pairs are taken one by one, and merges alone are kept."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for _, a, b in sorted(pairs, key=lambda p: (-p[0], p[1], p[2])) if isinstance(pairs, list) else pairs:
        if find(a) == find(b):
            continue
        if budget <= 0:
            break
        budget -= 1
        try:
            agreed = same(a, b)
        except Exception:
            agreed = False
        if agreed:
            root[max(find(a), find(b))] = min(find(a), find(b))
            out.append((a, b))
    return out
