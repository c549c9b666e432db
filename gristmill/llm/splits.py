"""Splits that keep related records together.

Records that hang together (see ``components``) form one weight. The weights are packed into many equal bins by largest
differencing (Karmarkar and Karp): the two partial packings with the widest spread are combined, the heaviest bins of one onto
the lightest of the other, until one packing is left; whole bins are then handed to the splits by target proportion.

Only the histogram of weights (how many groups have 1, 2, 3 ... records) goes to the driver. It has at most sqrt(2n) lines for n
records, at ten billion records under 142,000. Groups of equal weight are interchangeable, so the plan is made on the
histogram: of c groups of one weight, every bin takes c // bins, and only the rest, at most sqrt(2 bins n) groups, enters the
differencing: the HEAVIEST of it one by one, the others in runs of one item a bin. That is at most HEAVIEST + sqrt(2n / bins)
vectors of ``bins`` sums: 12,000 vectors or 20 MB at ten billion records. Every group then finds its own bin from its rank
among the groups of its weight.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.components import record_groups
from gristmill.plans.shared import Scratch

SPLITS = ("train", "validation", "test")
BINS = 200
#: Groups of one weight are ranked within buckets of about this many, so that no task ranks them all.
BUCKET = 100_000
#: Left-over groups that enter the differencing each by itself, the heaviest first.
HEAVIEST = 2_000


def difference(weights: list[int], bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest differencing of ``weights`` into ``bins``: (bin of each weight, sum of each bin).

    A partial packing is a vector of bin sums in descending order; only its spread matters for the order in which packings are
    combined. To begin with, each of the HEAVIEST weights is a packing of its own, and each run of ``bins`` of the others, in descending
    order, is one with an item a bin. Ties go to the older packing, so the result is a function of the input.
    """
    bin_of = np.zeros(len(weights), dtype=np.int64)
    if not weights:
        return bin_of, np.zeros(bins, dtype=np.int64)
    falling = np.argsort(-np.asarray(weights, dtype=np.int64), kind="stable")
    cuts = [*range(min(HEAVIEST, len(weights))), *range(HEAVIEST, len(weights), bins), len(weights)]
    sums: list[np.ndarray | None] = []
    #: Of a packing at the start, its members; of a combined one, both parts and how the bins were sorted after.
    made: list[np.ndarray | tuple[int, int, np.ndarray]] = []
    for a, b in zip(cuts, cuts[1:]):
        held = np.zeros(bins, dtype=np.int64)
        held[: b - a] = np.asarray(weights, dtype=np.int64)[falling[a:b]]
        sums.append(held)
        made.append(falling[a:b])
    heap = [(int(s[-1] - s[0]), k) for k, s in enumerate(sums)]
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, i), (_, j) = heapq.heappop(heap), heapq.heappop(heap)
        both = sums[i] + sums[j][::-1]
        order = np.argsort(-both, kind="stable")
        sums[i] = sums[j] = None
        sums.append(both[order])
        made.append((i, j, order.astype(np.int32)))
        heapq.heappush(heap, (int(sums[-1][-1] - sums[-1][0]), len(sums) - 1))
    top = heap[0][1]
    todo = [(top, np.arange(bins))]
    while todo:
        k, places = todo.pop()
        if isinstance(made[k], tuple):
            i, j, order = made[k]
            before = np.empty(bins, dtype=np.int64)
            before[order] = places
            todo += [(i, before), (j, before[::-1])]
        else:
            bin_of[made[k]] = places[: len(made[k])]
    return bin_of, sums[top]


def plan(histogram: dict[int, int], bins: int) -> tuple[dict[int, tuple[int, list[int]]], int, np.ndarray]:
    """({weight: (groups dealt evenly, bin of each further group)}, number of even bins, sum of each bin).

    A weight that is no less than the mean of what is left fills a bin of its own: differencing would add nothing to it until
    all others have caught up. The even bins come first.
    """
    total, even_bins, own = sum(w * c for w, c in histogram.items()), bins, {}
    for w, c in sorted(histogram.items(), reverse=True):
        while own.get(w, 0) < c and even_bins > 1 and w * even_bins >= total and w > 1:
            own[w] = own.get(w, 0) + 1
            total -= w
            even_bins -= 1
    shared = {w: c - own.get(w, 0) for w, c in histogram.items()}
    rest = [(w, c % even_bins) for w, c in sorted(shared.items(), reverse=True)]
    bin_of, sums = difference([w for w, c in rest for _ in range(c)], even_bins)
    sums = np.concatenate([sums + sum(w * (c // even_bins) for w, c in shared.items()), np.zeros(bins - even_bins, dtype=np.int64)])
    taken, at, alone = {}, 0, even_bins
    for w, c in rest:
        further = [int(b) for b in bin_of[at : at + c]]
        at += c
        for _ in range(own.get(w, 0)):
            further.append(alone)
            sums[alone] = w
            alone += 1
        taken[w] = (shared[w] - c, further)
    return taken, even_bins, sums


def allot(sums: np.ndarray, ratios: dict[str, float]) -> list[str]:
    """The split of each bin: the heaviest bin left goes to the split that is furthest below its share."""
    total, names = int(sums.sum()), list(ratios)
    want = {s: ratios[s] / sum(ratios.values()) * total for s in names}
    out = [""] * len(sums)
    for b in sorted(range(len(sums)), key=lambda b: (-int(sums[b]), b)):
        s = max(names, key=lambda s: (want[s], -names.index(s)))
        want[s] -= int(sums[b])
        out[b] = s
    return out


def folded_split(split: Column) -> Column:
    """train, validation or test as written by anyone; null and blank are no split; other words stay as they are."""
    word = F.lower(F.regexp_replace(split, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))
    return F.when(word.isin("val", "valid"), "validation").otherwise(F.nullif(word, F.lit("")))


def balanced_bins(groups: DataFrame, scratch: Scratch, bins: int = BINS) -> tuple[DataFrame, np.ndarray]:
    """((root_id, weight, bin), sums of the bins) of groups (root_id, weight: bigint, at least 1)."""
    spark = groups.sparkSession
    histogram = {int(w): int(c) for w, c in groups.groupBy("weight").count().collect()}  # at most sqrt(2n) lines
    taken, even_bins, sums = plan(histogram, bins)
    buckets = max(1, -(-sum(histogram.values()) // BUCKET))
    dealt = groups.withColumn("bucket", F.pmod(F.xxhash64("root_id"), F.lit(buckets)).cast("int"))
    rank = F.row_number().over(Window.partitionBy("weight", "bucket").orderBy("root_id")) - 1
    ranked = dealt.withColumn("rank", rank.cast("bigint"))
    if buckets > 1:
        # Groups of a weight in the buckets before: at most a row a bucket and weight, each weight's in one task.
        earlier = F.sum("n").over(Window.partitionBy("weight").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
        offsets = dealt.groupBy("weight", "bucket").agg(F.count("*").alias("n")).select("weight", "bucket", F.coalesce(earlier, F.lit(0)).alias("earlier"))
        ranked = ranked.join(offsets, ["weight", "bucket"]).withColumn("rank", F.col("rank") + F.col("earlier")).drop("earlier")
    rest = spark.createDataFrame([(w, e, t) for w, (e, t) in taken.items()], "weight bigint, even bigint, taken array<int>")
    placed = ranked.join(rest, "weight").withColumn(
        "bin",
        F.when(F.col("rank") < F.col("even"), (F.col("rank") % even_bins).cast("int")).otherwise(
            F.element_at("taken", (F.col("rank") - F.col("even") + 1).cast("int"))
        ),
    )
    return placed.select("root_id", "weight", "bin"), sums


def group_splits(docs: DataFrame, links: DataFrame, aliases: DataFrame, preparation: DataFrame, bins: int = BINS) -> DataFrame:
    """(id, root_id, bin, split, torn): one row per distinct record id.

    split follows the ratios of the settings row, counted in distinct ids; all ids of a group get the same one. torn tells
    that the group's rows carry two or more different splits at present. A group heavier than a split's share still goes
    somewhere whole: proportions are then as near as whole groups allow. Null ids are left out; with no settings row, or ratios
    that are all null or not positive, everything is train; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "splits")
    member = scratch.keep(record_groups(docs, links, aliases, preparation), "member")
    row = preparation.select("train_ratio", "validation_ratio", "test_ratio").first()
    ratios = {s: max(0.0, float(r or 0)) for s, r in zip(SPLITS, row or (1, 0, 0))}
    if not sum(ratios.values()):
        ratios = {"train": 1.0, "validation": 0.0, "test": 0.0}
    groups = scratch.keep(member.groupBy("root_id").agg(F.count("*").alias("weight")), "groups")
    placed, sums = balanced_bins(groups, scratch, bins)
    split_of = F.create_map(*[F.lit(x) for b, s in enumerate(allot(sums, ratios)) for x in (b, s)])
    present = docs.select("id", folded_split(F.col("split")).alias("now")).where("id is not null and now is not null")
    # Two numbers a group tell whether its splits differ; both combine before the shuffle, whatever the group's size.
    torn = (
        present.join(member, "id").groupBy("root_id").agg((F.min("now") != F.max("now")).alias("torn"))
    )
    decided = placed.join(torn, "root_id", "left").select(
        "root_id", "bin", F.element_at(split_of, F.col("bin")).alias("split"), F.coalesce("torn", F.lit(False)).alias("torn")
    )
    return member.join(decided, "root_id").select("id", "root_id", "bin", "split", "torn")
