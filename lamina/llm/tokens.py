"""Encoding of the corpus with a public byte-level BPE tokenizer (problem 8).

Texts are cut into content-defined chunks by a rolling hash. The hashes alone are shuffled
to find the chunks that stand in several places of the corpus. Each of those is encoded once,
by the text that owns it, and joined back by its hash to the texts that hold it, which encode
their other chunks themselves; texts without shared chunks are encoded whole. A document's
chunks are then put together and every join is repaired: the text around it is encoded
again, over a growing window, until the new encoding has a piece of the pre-tokenizer
starting where the later chunk has one. What follows such a place doesn't depend on what
came before, so the result is exactly the encoding of the whole text.

A null text gives null, an empty text an empty list; repeated documents give a row each.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from lamina.session import cut

TOKENIZERS = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k"
#: Bits of the rolling hash that must be zero (mean distance 2**bits), and the least and greatest chunk.
CUT_BITS, LEAST, GREATEST = 9, 128, 4096
WINDOW = 8
#: Pieces at a chunk's end and start that are kept beside its ids for repairs.
EDGE = 8


def vocabulary(path: str = TOKENIZERS, name: str = TOKENIZER) -> bytes:
    """The tokenizer's ranks, of fixed size, to ship with the tasks."""
    with open(f"{path}/{name}.tiktoken", "rb") as f:
        return f.read()


#: The pre-tokenizer of the public vocabulary (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(2)
def encoder(vocab: bytes):
    """A function from text to ids; special tokens' strings are ordinary text."""
    return _encoding(vocab).encode_ordinary


@lru_cache(2)
def _encoding(vocab: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocab.splitlines())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _lists(arrays):
    """Arrow lists of arrays of ids, None for null."""
    import pyarrow as pa

    empty = np.zeros(0, np.int32)
    values = [empty if a is None else np.asarray(a, np.int32) for a in arrays]
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    nulls = pa.array(np.array([a is None for a in arrays], bool))
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*values, empty])), mask=nulls)


@lru_cache(1)
def _pieces():
    import regex

    return regex.compile(PATTERN).finditer, regex.compile(r"(?<=\S) (?=\S)").search


def chunk_bounds(text: str) -> list[int]:
    """Ends of the content-defined chunks of a text."""
    n = len(text)
    if n <= LEAST:
        return [n]
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    mixed = codes * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    rolling = np.zeros(n, np.uint64)
    for k in range(WINDOW):  # a sum over the last WINDOW characters, each with its own odd factor
        rolling[k:] += mixed[: n - k] * np.uint64((2 * k + 1) * 0x5851F42D4C957F2D & 0xFFFFFFFFFFFFFFFF)
    cuts = np.flatnonzero(rolling >> np.uint64(64 - CUT_BITS) == 0) + 1
    out, last = [], 0
    for c in cuts.tolist():
        while c - last > GREATEST:
            last += GREATEST
            out.append(last)
        if c - last >= LEAST and c < n:
            out.append(c)
            last = c
    while n - last > GREATEST:
        last += GREATEST
        out.append(last)
    return out + [n]


def cut_chunks(text: str) -> list[str]:
    out, last = [], 0
    for e in chunk_bounds(text):
        out.append(text[last:e])
        last = e
    return out


#: Rows that a worker holds at once.
SLICE = 1000


def _sliced(batches):
    for batch in batches:
        for a in range(0, max(1, batch.num_rows), SLICE):
            yield batch.slice(a, SLICE)


def hashes_of(chunks: list[str]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(c) for c in chunks), np.uint64, len(chunks)).view(np.int64)


def _cut(batches):
    import pyarrow as pa

    for batch in _sliced(batches):
        chunks = [cut_chunks(t) for t in batch.column(2).to_pylist()]
        sizes = [len(c) for c in chunks]
        at = pa.array(np.repeat(np.arange(len(sizes)), sizes))
        pos = np.concatenate([np.arange(n) for n in sizes] or [np.zeros(0, int)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(pos), pa.array(hashes_of([c for cs in chunks for c in cs]))], ["p", "q", "pos", "h"])


class Piece:
    """An encoded stretch of text with its outer pieces as (character, token) starts, inner ones last."""

    __slots__ = ("text", "ids", "head", "tail")

    def __init__(self, text, ids, head, tail):
        self.text, self.ids, self.head, self.tail = text, ids, head, tail


def encoded(text: str, encode) -> Piece:
    """The chunk's ids and the starts of its first and last EDGE pieces."""
    ids = np.asarray(encode(text), np.int32)
    find, boundary = _pieces()
    head, token = [], 0
    for m in islice(find(text), EDGE + 1):
        if m.start():
            head.append((m.start(), token))
        token += len(encode(m[0]))
    near = max(0, len(text) - 24 * EDGE)
    m = boundary(text, near) if near else None  # a blank between two words always starts a piece
    pieces = list(find(text, m.start())) if m else list(find(text))
    tail, token = [], len(ids)
    for m in reversed(pieces[-EDGE:]):
        token -= len(encode(m[0]))
        tail.append((m.start(), token))
    return Piece(text, ids, head, tail)


def join_pieces(a: Piece, b: Piece, encode) -> Piece:
    """``a`` and ``b`` as one, the join repaired until the new encoding agrees with ``b``'s own pieces."""
    find, _ = _pieces()
    for back in range(1, len(a.tail)):
        start, kept = a.tail[back]
        window = a.text[start:] + b.text[: b.head[-1][0]] if b.head else ""
        own = len(a.text) - start
        if len(b.head) < 4:
            break
        pieces = [(m.start(), m[0]) for m in find(window)]
        new = {c for c, _ in pieces[:-2]}  # the last pieces may go on after the window
        for place, token in b.head[:-1]:
            if own + place in new:
                between = [i for c, x in pieces if c < own + place for i in encode(x)]
                ids = np.concatenate([a.ids[:kept], np.asarray(between, np.int32), b.ids[token:]])
                moved = len(ids) - len(b.ids)
                tail = [(p + len(a.text), k + moved) for p, k in b.tail if p >= place]
                return Piece(a.text + b.text, ids, a.head, tail)
    return encoded(a.text + b.text, encode)


def join_all(pieces, encode) -> np.ndarray:
    """Ids of a whole text from its encoded chunks in order."""
    out = []
    current = None
    for piece in pieces:
        if current is None:
            current = piece
            continue
        current = join_pieces(current, piece, encode)
        if len(current.tail) > 4:  # what lies before the outer pieces is final
            place, token = current.tail[-1]
            out.append(current.ids[:token])
            current.text, current.ids = current.text[place:], current.ids[token:]
            current.tail = [(c - place, k - token) for c, k in current.tail]
    return np.concatenate([*out, current.ids]) if current else np.zeros(0, np.int32)


def _flat(pairs) -> list[int]:
    return [x for p in pairs for x in p]


_PIECE = "h bigint, ids array<int>, head array<int>, tail array<int>"


def _encode_owned(vocab):
    """Pieces (h, ids, head, tail) of the chunks that rows (text, owned) own; a text that comes again right after is done already."""

    def run(batches):
        import pyarrow as pa

        encode, last = encoder(vocab.value), None
        for batch in _sliced(batches):
            done = []
            for text, owned in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text != last:
                    last, chunks = text, cut_chunks(text)
                    done += [(o["h"], encoded(chunks[o["pos"]], encode)) for o in owned]
            yield pa.RecordBatch.from_arrays(
                [pa.array([h for h, _ in done], pa.int64()), _lists([p.ids for _, p in done]), _lists([_flat(p.head) for _, p in done]), _lists([_flat(p.tail) for _, p in done])],
                ["h", "ids", "head", "tail"],
            )

    return run


def _stitch(vocab):
    """(doc_id, ids) of rows (doc_id, text, parts): encoded whole where no part is given, else put together from its chunks."""

    def run(batches):
        import pyarrow as pa

        encode, whole = encoder(vocab.value), _encoding(vocab.value).encode_to_numpy
        last, ids = None, None
        for batch in _sliced(batches):
            lists, texts = batch.column(2), batch.column(1).to_pylist()
            flat, sizes = lists.flatten(), lists.value_lengths().fill_null(0).to_numpy()
            ends = np.concatenate([[0], np.cumsum(sizes)])
            places = flat.field("pos").to_numpy()
            table = {}
            for name in ("ids", "head", "tail"):
                column = flat.field(name)
                table[name] = column.flatten().to_numpy(), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy())])

            def piece(k, chunk):
                ids, head, tail = (v[e[k] : e[k + 1]] for v, e in (table[n] for n in ("ids", "head", "tail")))
                return Piece(chunk, ids, *(list(zip(x[::2], x[1::2])) for x in (head.tolist(), tail.tolist())))

            out = []
            for i, text in enumerate(texts):
                if not text:
                    out.append(None if text is None else [])
                    continue
                if text != last:
                    given = {int(places[k]): k for k in range(ends[i], ends[i + 1])}
                    if given:
                        pieces = (piece(given[k], c) if k in given else encoded(c, encode) for k, c in enumerate(cut_chunks(text)))
                        ids = join_all(pieces, encode)
                    else:
                        ids = whole(text, disallowed_special=())
                    last = text
                out.append(ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(out)], ["doc_id", "ids"])

    return run


def shared_chunks(docs: DataFrame) -> DataFrame:
    """(p, q, pos, h, own): where docs (p, q, text) hold chunks that stand in more than one place of the
    distinct texts, and which of each chunk's places owns it. Only hashes are shuffled."""
    cells = cut(docs.filter("text <> ''").mapInArrow(_cut, "p bigint, q bigint, pos int, h bigint").distinct())
    place = F.struct("p", "q", "pos")
    met = cells.groupBy("h").agg(F.count("*").alias("n"), F.min(place).alias("owner")).filter("n > 1").select("h", "owner")
    return cells.join(met, "h").select("p", "q", "pos", "h", (place == F.col("owner")).alias("own"))


def encode_documents(docs: DataFrame, path: str = TOKENIZERS, name: str = TOKENIZER) -> DataFrame:
    """(doc_id, ids) of every row of ``docs`` (doc_id, text; other columns are ignored).

    Texts are named by 128 bits of hash, so copies of a text are one text and a retried task names it alike.
    """
    sc = docs.sparkSession.sparkContext
    kind = dict(docs.dtypes)["doc_id"]
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("p"), F.xxhash64(F.lit(7), "text", F.lit(11)).alias("q"))
    vocab = sc.broadcast(vocabulary(path, name))
    shared = cut(shared_chunks(docs.select("p", "q", "text")))
    owned = shared.filter("own").groupBy("p", "q").agg(F.collect_list(F.struct("pos", "h")).alias("owned"))
    pieces = docs.join(owned, ["p", "q"]).select("text", "owned").mapInArrow(_encode_owned(vocab), _PIECE)
    once = pieces.groupBy("h").agg(*(F.first(c).alias(c) for c in ("ids", "head", "tail")))
    parts = shared.join(once, "h").groupBy("p", "q").agg(F.collect_list(F.struct("pos", "ids", "head", "tail")).alias("parts"))
    return docs.join(parts, ["p", "q"], "left").select("doc_id", "text", "parts").mapInArrow(_stitch(vocab), f"doc_id {kind}, ids array<int>")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{folder}/documents.parquet"))


def p8_decoded(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's ids decoded again: the round trip gives the text itself, null for null."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    vocab = spark.sparkContext.broadcast(vocabulary())

    def run(batches):
        import pyarrow as pa

        decode = _encoding(vocab.value).decode
        for batch in batches:
            for part in _sliced([batch]):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([None if i is None else decode(i) for i in part.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encode_documents(docs).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, text string")
