"""Filling containers of fixed capacity with documents (problem 9).

Items are dealt to groups of a bounded number of containers, each packed by itself:
a best-fit start, then local search over the underfull containers, which moves one
document or exchanges one for one or two for one wherever the sum of squared fills
grows, until nothing does. What the groups leave in badly filled containers goes
through the same again in fewer groups.

Documents over the capacity are split into full containers and one remaining part;
no other document is split. Null and empty texts take no room: they are listed with a
null container. Repeated documents are packed each, whatever their ids.
"""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from lamina.llm import tokens
from lamina.session import cut

#: Containers that one group holds on average; bounds a task's memory and search.
GROUP_CONTAINERS = 1000
#: Containers filled less than this go on to the next round.
WELL_FILLED = 0.995
#: By how much each round has fewer groups.
FOLD = 64


def pack(sizes: list[int], capacity: int) -> list[list[int]]:
    """Containers as lists of item numbers. Every size must be 1 to ``capacity``."""
    bins: list[list[int]] = []
    gaps: list[tuple[int, int]] = []  # (room, container), sorted
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        s = sizes[i]
        at = bisect.bisect_left(gaps, (s, -1))
        if at < len(gaps):
            room, b = gaps.pop(at)
            bins[b].append(i)
            if room > s:
                bisect.insort(gaps, (room - s, b))
        else:
            bins.append([i])
            if s < capacity:
                bisect.insort(gaps, (capacity - s, len(bins) - 1))
    improve(bins, sizes, capacity)
    return [b for b in bins if b]


def improve(bins: list[list[int]], sizes: list[int], capacity: int) -> None:
    """Moves and exchanges between underfull containers while they increase the sum of squared fills."""
    fill = [sum(sizes[i] for i in b) for b in bins]
    home = {i: b for b, items in enumerate(bins) if fill[b] < capacity for i in items}
    loose = sorted((sizes[i], i) for i in home)  # items of underfull containers by size

    def best_within(limit: int, b: int, least: int):
        """The largest item of at most ``limit`` and more than ``least`` in another container, if moving helps."""
        at = bisect.bisect_right(loose, (limit, len(sizes))) - 1
        while at >= 0 and loose[at][0] > least:
            s, i = loose[at]
            if home[i] != b:
                return s, i
            at -= 1
        return None

    def settle(b: int):
        if fill[b] == capacity:  # full: out of the search
            for i in bins[b]:
                loose.pop(bisect.bisect_left(loose, (sizes[i], i)))
                del home[i]

    def offers(own: list[int]):
        """What a container may give: nothing, one item or two. Of equal sums one stands for all, as they gain the same;
        a container holds at most about root(2 * capacity) different sizes, so there are no more sums than its capacity."""
        by: dict[int, list[int]] = {}
        for i in own:
            by.setdefault(sizes[i], []).append(i)
        out: dict[int, tuple[int, ...]] = {0: ()} | {s: (items[0],) for s, items in by.items()}
        kinds = sorted(by)
        for x, s in enumerate(kinds):
            for other in kinds[x:]:
                if s + other not in out and (s != other or len(by[s]) > 1):
                    out[s + other] = (by[s][0], by[other][-1])
        return out.items()

    moved = True
    while moved:
        moved = False
        for b in sorted((b for b in range(len(bins)) if bins[b] and fill[b] < capacity), key=lambda b: -fill[b]):
            while bins[b] and fill[b] < capacity:
                room, best = capacity - fill[b], None
                for out, given in offers(bins[b]):
                    got = best_within(out + room, b, out)
                    if got is None:
                        continue
                    gain = got[0] - out
                    if gain <= fill[home[got[1]]] - fill[b]:  # squares wouldn't grow
                        continue
                    if best is None or gain > best[0]:
                        best = (gain, given, got[1])
                        if gain == room:
                            break
                if best is None:
                    break
                gain, given, i = best
                other = home[i]
                bins[other].remove(i)
                for g in given:
                    bins[b].remove(g)
                    bins[other].append(g)
                    home[g] = other
                bins[b].append(i)
                home[i] = b
                fill[b] += gain
                fill[other] -= gain
                moved = True
                settle(b)
                if fill[b] == capacity:
                    break


PACKED = "spec_id int, uid bigint, doc_id bigint, part int, n_tokens int, container_id string, fill int"


def _pack_group(level: int):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        spec, group = int(key[0]), int(key[1])
        pdf = pdf.sort_values(["uid", "part"], kind="stable").reset_index(drop=True)
        sizes = pdf.n_tokens.tolist()
        name, filled = [None] * len(sizes), [0] * len(sizes)
        for k, items in enumerate(pack(sizes, int(pdf.capacity_tokens.iloc[0]))):
            total = sum(sizes[i] for i in items)
            for i in items:
                name[i], filled[i] = f"{spec}-{level}-{group}-{k}", total
        return pdf[["spec_id", "uid", "doc_id", "part", "n_tokens"]].assign(container_id=name, fill=filled)

    return run


def pack_documents(sizes: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_id, doc_id, part, n_tokens, container_id, fill) for sizes (doc_id, n_tokens) and
    specs (spec_id, capacity_tokens); specs are few. Part k of a split document starts at token k * capacity."""
    sizes = cut(sizes.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("n_tokens", F.lit(0)).cast("int").alias("n_tokens")))
    sizes = sizes.withColumn("uid", F.monotonically_increasing_id())  # over a written table, so a retried task numbers its rows alike
    kinds = [(int(r[0]), int(r[1])) for r in specs.filter("capacity_tokens > 0 and spec_id is not null").select("spec_id", "capacity_tokens").distinct().collect()]
    total = sizes.agg(F.sum("n_tokens")).first()[0] or 0
    n, c = F.col("n_tokens"), F.col("capacity_tokens")
    if not kinds:
        return sizes.limit(0).select(F.lit(0).alias("spec_id"), "doc_id", F.lit(0).alias("part"), "n_tokens", F.lit("").alias("container_id"), F.lit(0).alias("fill"))
    of = F.explode(F.array(*[F.struct(F.lit(i).alias("spec_id"), F.lit(c).alias("capacity_tokens")) for i, c in kinds])).alias("kind")
    wanted = sizes.select("uid", "doc_id", "n_tokens", of).select("kind.*", "uid", "doc_id", "n_tokens")  # a row per kind of container, of which there are few
    none = wanted.filter(n == 0).select("spec_id", "doc_id", F.lit(0).alias("part"), "n_tokens", F.lit(None).cast("string").alias("container_id"), F.lit(0).alias("fill"))
    parts = wanted.filter(n > 0).select("spec_id", "capacity_tokens", "uid", "doc_id", F.explode(F.sequence(F.lit(0), F.ceil(n / c).cast("int") - 1)).alias("part"), n.alias("whole"))
    rest, level, out = parts.withColumn("n_tokens", F.least(c, F.col("whole") - F.col("part") * c).cast("int")).drop("whole"), 0, none
    groups = F.greatest(F.lit(1), F.ceil(F.lit(float(total)) / (c * GROUP_CONTAINERS))).cast("int")
    most = max(1, *(-(-total // (c_ * GROUP_CONTAINERS)) for _, c_ in kinds))
    while True:
        shrunk = F.ceil(groups / float(FOLD**level)).cast("int")
        dealt = rest.withColumn("group", F.pmod(F.xxhash64("uid", "part", F.lit(level)), shrunk))
        packed = dealt.groupBy("spec_id", "group").applyInPandas(_pack_group(level), PACKED)
        most = -(-most // FOLD) if level else most
        if most <= 1:
            return out.unionByName(packed.drop("uid"))
        capacity = F.create_map(*[F.lit(x) for k in kinds for x in k])
        packed = cut(packed).withColumn("capacity_tokens", capacity[F.col("spec_id")])
        # One group left: nothing could be repacked with others, so all of it stays.
        open_ = (F.col("fill") < c * WELL_FILLED) & (shrunk > 1)
        out = out.unionByName(packed.filter(~open_).drop("capacity_tokens", "uid"))
        rest, level = packed.filter(open_).select("spec_id", "capacity_tokens", "uid", "doc_id", "part", "n_tokens"), level + 1


def token_sizes(docs: DataFrame) -> DataFrame:
    return tokens.encode_documents(docs).select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).alias("n_tokens"))


def p9_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(token_sizes(spark.read.parquet(f"{folder}/documents.parquet")), spark.read.parquet(f"{folder}/pack_specs.parquet"))


def p9_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Containers used of each kind, their mean fill, and the least number that any packing needs."""
    specs = spark.read.parquet(f"{folder}/pack_specs.parquet")
    used = p9_packing(spark, folder).filter("container_id is not null").groupBy("spec_id", "container_id").agg(F.sum("n_tokens").alias("n"))
    return used.groupBy("spec_id").agg(F.count("*").alias("containers"), F.sum("n").alias("n")).join(specs.select("spec_id", "capacity_tokens"), "spec_id").select(
        "spec_id", "containers", F.ceil(F.col("n") / F.col("capacity_tokens")).alias("least"), F.round(F.col("n") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("mean_fill")
    )


def p9_kept(spark: SparkSession, folder: str) -> DataFrame:
    """What a packing must keep, for each kind of container: documents packed, and how many containers are overfull,
    documents split that fit in one, and documents whose parts don't add up to their size."""
    docs, specs = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/pack_specs.parquet").select("spec_id", "capacity_tokens")
    sizes = cut(token_sizes(docs))
    packed = cut(pack_documents(sizes, specs))
    over = packed.filter("container_id is not null").groupBy("spec_id", "container_id").agg(F.sum("n_tokens").alias("n")).join(specs, "spec_id").groupBy("spec_id").agg(F.sum((F.col("n") > F.col("capacity_tokens")).cast("int")).alias("overfull"))
    whole = packed.groupBy("spec_id", "doc_id").agg(F.sum("n_tokens").alias("got"), F.sum((F.col("part") == 0).cast("int")).alias("times"), F.max("part").alias("parts"))
    j = whole.join(sizes.groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.max("n_tokens").alias("most")), "doc_id").join(specs, "spec_id")
    kept = j.groupBy("spec_id").agg(
        F.sum("times").alias("documents"), F.sum(((F.col("parts") > 0) & (F.col("most") <= F.col("capacity_tokens"))).cast("int")).alias("split_in_vain"), F.sum((F.col("got") != F.col("n")).cast("int")).alias("lost")
    )
    return kept.join(over, "spec_id", "left").select("spec_id", "documents", F.coalesce("overfull", F.lit(0)).cast("int").alias("overfull"), F.col("split_in_vain").cast("int"), F.col("lost").cast("int"))
