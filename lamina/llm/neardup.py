"""Near-duplicate articles (problem 4): MinHash banding, verified on the full shingle sets.

Texts become sets of three successive words. Articles with equal sets form classes, so
copies are compared once; one of each class is banded, and candidates of a common band
are verified on their whole sets, taken from the texts again. Buckets too large for one task are dealt to
blocks, and pairs of blocks are compared apart, so a hot bucket is spread and kept whole.

Null and blank texts are left out; a null title counts as empty; texts with fewer than
three words have all their words as their only shingle. Repeated rows pair like others.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from lamina.session import cut, spread

WORDS, THRESHOLD = 3, 0.6
#: 40 bands of 4 rows miss a pair at the threshold with probability (1 - 0.6**4)**40 = 0.004; at 0.65 with 0.0004.
BANDS, ROWS = 40, 4
#: Members of a bucket compared within one task; larger buckets are dealt to blocks of this size.
BLOCK = 256

#: Of BANDS * ROWS minima two bits each are compared before a pair is verified; pairs below so many equal ones
#: lie 4.5 standard deviations under the threshold (of 0.049 in similarity), so 3 of a million are lost by it.
#: None verifies every pair of a common band.
ALIKE_BITS: int | None = 86
#: Texts from which a dictionary for compressing the shuffled texts is made, and its bytes; results don't depend on it.
DICTIONARY_TEXTS, DICTIONARY_BYTES = 2000, 100_000

_factor = np.random.default_rng(4).integers(0, 2**32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
_shift = np.random.default_rng(5).integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
_hashes: dict[str, int] = {}


def _hash(word: str) -> int:
    import xxhash

    h = _hashes.get(word)
    if h is None:
        if len(_hashes) > 500_000:
            _hashes.clear()
        h = _hashes[word] = xxhash.xxh3_64_intdigest(word)
    return h


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    words = text.lower().split()
    if len(words) < WORDS:
        return np.array([_hash(" ".join(words))], np.uint64)
    h = np.fromiter(map(_hash, words), np.uint64, len(words))
    out = np.zeros(len(words) - WORDS + 1, np.uint64)
    for k in range(WORDS):
        out = out * np.uint64(0x9E3779B97F4A7C15) ^ h[k : k + len(out)]
        out ^= out >> np.uint64(31)
    return np.unique(out)


def band_hashes(sh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """BANDS hashes, each over the minima of ROWS permutations; and two bits of every minimum in six words."""
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for part in np.array_split((sh >> np.uint64(32)).astype(np.uint32) ^ sh.astype(np.uint32), -(-len(sh) // 2048)):
        mixed = part[:, None] * _factor
        mixed += _shift
        np.minimum(least, mixed.min(axis=0), out=least)
    rows = least.astype(np.uint64).reshape(BANDS, ROWS)
    out = np.arange(BANDS, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    for k in range(ROWS):
        out = (out ^ rows[:, k]) * np.uint64(0x9FB21C651E98DF25)
        out ^= out >> np.uint64(29)
    two = np.zeros((2, 192), np.uint8)
    mixed = least * np.uint32(0x9E3779B1)
    two[0, : len(least)], two[1, : len(least)] = mixed >> np.uint32(31), mixed >> np.uint32(30) & np.uint32(1)
    return out.view(np.int64), np.packbits(two, axis=1).view(np.int64).ravel()


def signatures(docs: DataFrame) -> DataFrame:
    """(id, p, q, bands, bits) of docs (id, text); p and q are a fingerprint of the set in 128 bits."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        for batch in batches:
            sets = [shingles(t) for t in batch.column(1).to_pylist()]
            prints = np.array([np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64) for s in sets], np.int64).reshape(-1, 2)
            made, kind = [band_hashes(s) for s in sets], pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(prints[:, 0]), pa.array(prints[:, 1]), pa.array([b for b, _ in made], kind), pa.array([t for _, t in made], kind)],
                ["id", "p", "q", "bands", "bits"],
            )

    return spread(docs.select("id", "text")).mapInArrow(run, "id bigint, p bigint, q bigint, bands array<bigint>, bits array<bigint>")


def word_sets(text: str) -> frozenset:
    words = text.lower().split()
    return frozenset(zip(*(words[k:] for k in range(WORDS)))) if len(words) >= WORDS else frozenset([tuple(words)])


def dictionary(docs: DataFrame) -> bytes:
    """A compression dictionary of bounded size from some of the texts; empty where they are too few."""
    import zstandard

    some = [r.text.encode("utf-8", "surrogatepass")[:8192] for r in docs.select("text").limit(DICTIONARY_TEXTS).collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, some).as_bytes() if sum(map(len, some)) > 10 * DICTIONARY_BYTES else b""
    except zstandard.ZstdError:
        return b""


def _coder(kind: str, shared: bytes):
    import zstandard

    more = {"dict_data": zstandard.ZstdCompressionDict(shared)} if shared else {}
    return zstandard.ZstdCompressor(level=6, **more).compress if kind == "pack" else zstandard.ZstdDecompressor(**more).decompress


def _packed(docs: DataFrame, shared) -> DataFrame:
    """(id, z): the texts compressed, as they are shuffled twice."""

    def run(batches):
        import pyarrow as pa

        pack = _coder("pack", shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack(t.encode("utf-8", "surrogatepass")) for t in batch.column(1).to_pylist()], pa.binary())], ["id", "z"])

    return docs.select("id", "text").mapInArrow(run, "id bigint, z binary")


def alike(docs: DataFrame, pairs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``pairs`` (a, b) of docs (id, text) whose sets have the threshold of their union in common."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionary(docs))

    def run(batches):
        import pyarrow as pa

        unpack = _coder("unpack", shared.value)
        last, left = None, frozenset()

        def words(z):
            return word_sets(unpack(z).decode("utf-8", "surrogatepass"))

        for batch in batches:
            keep = []
            for k, (y, x) in enumerate(zip(batch.column(3).to_pylist(), batch.column(2).to_pylist())):
                if y != last:  # the pairs come sorted by b
                    last, left = y, words(y)
                right = words(x)
                both = len(left & right)
                if both >= threshold * (len(left) + len(right) - both):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(keep, pa.int64())) for i in (0, 1)], ["a", "b"])

    texts = _packed(docs, shared)
    one = pairs.join(texts, pairs["a"] == texts["id"]).select("a", "b", F.col("z").alias("x"))
    return one.join(texts, one["b"] == texts["id"]).select("a", "b", "x", F.col("z").alias("y")).mapInArrow(run, "a bigint, b bigint")


def candidates(classes: DataFrame, alike_bits: int | None = None) -> DataFrame:
    """Distinct pairs (a < b) of classes (rep, bands, bits) that share a band and, where told, so many bits."""
    spread = classes.select("rep", F.explode("bands").alias("band"))
    # Only counts and (band, class) pass the shuffle; a band of one class ends here, and a crowded one gets blocks.
    crowded = spread.groupBy("band").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    sized = spread.join(crowded, "band").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    mine = sized.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    # Each member meets every block once: as the pair (lesser block, greater block).
    met = mine.select("rep", "band", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cell = met.select("rep", "band", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    a, b = cell.alias("x"), cell.alias("y")
    on = (F.col("x.band") == F.col("y.band")) & (F.col("x.lo") == F.col("y.lo")) & (F.col("x.hi") == F.col("y.hi")) & (F.col("x.rep") < F.col("y.rep"))
    apart = (F.col("x.lo") == F.col("x.hi")) | (F.col("x.block") != F.col("y.block"))
    pairs = a.join(b, on & apart).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()
    if alike_bits is None:
        return pairs
    bits = classes.select("rep", "bits")
    both = pairs.join(bits.select(F.col("rep").alias("a"), F.col("bits").alias("s")), "a").join(bits.select(F.col("rep").alias("b"), F.col("bits").alias("t")), "b")
    equal = [F.bit_count(F.expr(f"~(s[{k}] ^ t[{k}]) & ~(s[{k + 3}] ^ t[{k + 3}])")) for k in range(3)]
    return both.filter(equal[0] + equal[1] + equal[2] - F.lit(192 - BANDS * ROWS) >= F.lit(alike_bits)).select("a", "b")


def near_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (id, rep) of the classes of equal sets, and the pairs (a, b) of classes, named by their least member, that are alike."""
    signed = cut(signatures(docs))
    classes = signed.groupBy("p", "q").agg(F.min("id").alias("rep"))
    members = signed.select("id", "p", "q").join(classes, ["p", "q"]).select("id", "rep")
    reps = signed.join(classes, (signed["p"] == classes["p"]) & (signed["q"] == classes["q"]) & (signed["id"] == classes["rep"]), "left_semi")
    return members, alike(docs, candidates(reps.select(F.col("id").alias("rep"), "bands", "bits"), ALIKE_BITS))


def article_texts(spark: SparkSession, folder: str) -> DataFrame:
    a = spark.read.parquet(f"{folder}/articles.parquet")
    return a.filter(F.col("text").rlike(r"(?U)\S")).select(F.col("article_id").cast("bigint").alias("id"), F.concat_ws(" ", F.coalesce("title", F.lit("")), "text").alias("text"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    members, pairs = near_classes(article_texts(spark, folder))
    x, y = members.select(F.col("id").alias("i"), F.col("rep").alias("a")), members.select(F.col("id").alias("j"), F.col("rep").alias("b"))
    between = pairs.join(x, "a").join(y, "b")
    within = x.join(y.withColumnRenamed("b", "a"), "a").filter("i < j")
    return between.select("i", "j").unionByName(within.select("i", "j")).select(F.least("i", "j").alias("article_a"), F.greatest("i", "j").alias("article_b"))


def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    """One row per article: its class of equal sets (named by its least article) and the number of classes it is alike with."""
    members, pairs = near_classes(article_texts(spark, folder))
    links = pairs.select(F.col("a").alias("rep")).unionAll(pairs.select("b")).groupBy("rep").agg(F.count("*").alias("links"))
    return members.join(links, "rep", "left").select(F.col("id").alias("article_id"), F.col("rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
