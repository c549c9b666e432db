"""Containers of fixed capacity filled with documents: first-fit decreasing over a tournament tree of the space left.

Documents are dealt to randomised groups of about GROUP by a hash, and each group is packed by itself in one task. What
grouping costs is at most one container that is not quite full for each group and run.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm.encode import token_counts
from gristmill.plans.shared import Scratch

GROUP = 20_000
FILLED = "run_name string, container bigint, doc_id bigint, start bigint, n_tokens bigint"


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container of each size (1 <= size <= capacity): the first, by number, with room. Of equal sizes the first one goes first.

    The tree holds at each node the largest room below it; the leftmost leaf with room is found and updated in O(log n).
    """
    order = np.argsort(-sizes, kind="stable")
    n = len(sizes)
    # Half full at least, but for the last one: that bounds the containers.
    leaves = 1
    while leaves < min(n, 2 * int(sizes.sum()) // capacity + 1):
        leaves *= 2
    room = [capacity] * (2 * leaves)
    out = np.empty(n, dtype=np.int64)
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        at = 1
        while at < leaves:
            at *= 2
            if room[at] < size:
                at += 1
        out[i] = at - leaves
        left = room[at] - size
        room[at] = left
        while at > 1:
            other = room[at ^ 1]
            at >>= 1
            best = left if left > other else other
            if room[at] == best:
                break
            room[at] = left = best
    return out


def _pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    run, group, capacity, number = key
    rows = rows.sort_values(["doc_id", "no_id", "n", "content"], kind="stable")
    # An id is a number and whether there is one: a column with nulls would come as floating point.
    docs = pd.Series(pd.arrays.IntegerArray(rows["doc_id"].to_numpy(dtype=np.int64), rows["no_id"].to_numpy(dtype=bool)))
    n = rows["n"].to_numpy(dtype=np.int64)
    full, rest = n // capacity, n % capacity
    # Whole containers of a document that alone exceeds the capacity, then what is left of it as an item like the others.
    whole = np.repeat(np.arange(len(n)), full)
    start = (np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)) * capacity
    item = np.flatnonzero(rest)
    container = first_fit_decreasing(rest[item], capacity) if len(item) else np.zeros(0, dtype=np.int64)
    used = int(container.max()) + 1 if len(item) else 0
    number = np.concatenate([container, used + np.arange(len(whole))]) + (int(number) << 32)
    row = np.concatenate([item, whole])
    return pd.DataFrame(
        {
            "run_name": run,
            "container": number,
            "doc_id": docs.iloc[row].array,
            "start": np.concatenate([full[item] * capacity, start]),
            "n_tokens": np.concatenate([rest[item], np.full(len(whole), capacity)]),
        }
    )


def filled(documents: DataFrame, packing: DataFrame, folder: str | None = None, group: int = GROUP) -> DataFrame:
    """(run_name, container, doc_id, start, n_tokens): tokens start .. start + n_tokens of the document lie in the container.

    For each row of packing (run_name, tokenizer, sequence_length), every document with a token occurs with all its tokens; it is
    divided only if it alone exceeds the capacity. Documents without tokens are in no container. Repeated rows are packed
    each; runs with a null field or a capacity under 1 are left out; empty tables give an empty result. The settings in packing are
    read to the driver. Which group a document falls to follows from its id and content, so the same rows give the same containers however
    they lie in files and partitions. Runs of one name with other tokenizers or capacities have containers of their own.
    """
    spark = documents.sparkSession
    runs = [
        r for r in packing.select("run_name", "tokenizer", "sequence_length").distinct().toLocalIterator()
        if None not in tuple(r) and r["sequence_length"] >= 1
    ]
    if not runs:
        return spark.createDataFrame([], FILLED)
    scratch = Scratch(spark, "filling")
    names = sorted({r["tokenizer"] for r in runs})
    counts = scratch.keep(token_counts(documents, names, folder), "counts")
    groups = max(1, -(-counts.count() // group))
    items = F.array(
        *[
            F.struct(
                F.lit(k).alias("run"),
                F.lit(r["run_name"]).alias("run_name"),
                F.lit(int(r["sequence_length"])).alias("capacity"),
                F.col(f"n{names.index(r['tokenizer'])}").alias("n"),
            )
            for k, r in enumerate(sorted(runs))
        ]
    )
    group_of = F.pmod(F.xxhash64("doc_id", "content"), F.lit(groups))
    dealt = (
        counts.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNull().alias("no_id"), "content", group_of.alias("grp"), F.explode(items).alias("i"))
        .select("doc_id", "no_id", "content", "grp", "i.run_name", "i.capacity", "i.n", (F.col("i.run") * F.lit(groups) + F.col("grp")).alias("number"))
        .where("n > 0")
    )
    return dealt.groupBy("run_name", "grp", "capacity", "number").applyInPandas(_pack, FILLED)


def fill_report(containers: DataFrame, packing: DataFrame) -> DataFrame:
    """(run_name, containers, tokens, fill): how full the containers of each run are."""
    per_run = containers.groupBy("run_name", "container").agg(F.sum("n_tokens").alias("t")).groupBy("run_name").agg(
        F.count("*").alias("containers"), F.sum("t").alias("tokens")
    )
    return per_run.join(packing.select("run_name", "sequence_length"), "run_name").select(
        "run_name", "containers", "tokens", (F.col("tokens") / (F.col("containers") * F.col("sequence_length"))).alias("fill")
    )


