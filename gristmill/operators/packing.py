"""Packing of token documents into rows of fixed length in document order (next fit), and the order in which rows are read.

Next fit is a recurrence: where a document goes depends on all before it. Only the layout is sequential, and it needs no more than
the lengths; it runs over each split's blocks of documents with an exact hand-over: the state at a block's start is one number
(tokens in the open row), so a first pass finds for each block what it does to every possible state at once. What FAN blocks do one after
the other is again such a table, so tables are chained in a tree on the cluster, and the driver sees FAN of them at most.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.plans.shared import Scratch

LAYOUT = "doc_number bigint, chunk int, row_number bigint, at int, start int, n int"
#: Documents of one block of the layout.
BLOCK = 50_000
#: Tables that are chained by one task, or by the driver at the top of the tree.
FAN = 256


def _walk(lengths: np.ndarray, length: int, filled: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, row from here, place in row, first token, tokens) of every piece; documents under 2 tokens are passed over."""
    row = 0
    for k, n in enumerate(lengths.tolist()):
        if n < 2:
            continue
        if filled and filled + n > length:
            row, filled = row + 1, 0
        start = 0
        if n > length:
            # Whole rows that share one token with the next, so that no pair of neighbours is lost.
            for _ in range(-(-(n - length) // (length - 1))):
                yield k, row, 0, start, length
                row, start = row + 1, start + length - 1
        yield k, row, filled, start, n - start
        filled += n - start
        if filled == length:
            row, filled = row + 1, 0
    yield -1, row, filled, 0, 0


def _effect(lengths: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows closed, tokens left open) of a block, for each number of tokens 0 .. length - 1 open at its start.

    States merge quickly: all that do not fit the next document become the same one, so the walk goes over distinct states.
    """
    state, rows, which = np.arange(length), np.zeros(length, dtype=np.int64), np.arange(length)
    for n in lengths.tolist():
        if n < 2:
            continue
        close = (state > 0) & (state + n > length)
        rows, state = rows + close, np.where(close, 0, state)
        if n > length:
            k = -(-(n - length) // (length - 1))
            rows, n = rows + k, n - k * (length - 1)
        state = state + n
        full = state == length
        rows, state = rows + full, np.where(full, 0, state)
        if len(state) > 1:
            # Equal (state, rows) stay equal for good.
            both, inverse = np.unique(np.stack([state, rows]), axis=1, return_inverse=True)
            if both.shape[1] < len(state):
                state, rows, which = both[0], both[1], inverse.reshape(-1)[which]
    return rows[which], state[which]


STARTS = "block bigint, first_row bigint, filled int"


def _chained(rows: pd.DataFrame) -> pd.DataFrame:
    """What consecutive blocks do one after the other."""
    rows = rows.sort_values("block")
    closed, left = np.array(rows["closed"].iloc[0]), np.array(rows["left"].iloc[0])
    for more, onward in zip(rows["closed"].iloc[1:], rows["left"].iloc[1:]):
        closed, left = closed + np.asarray(more)[left], np.asarray(onward)[left]
    return pd.DataFrame({"block": [int(rows["up"].iloc[0])], "closed": [closed.tolist()], "left": [left.tolist()]})


def _starts(row: int, at: int, rows: pd.DataFrame) -> pd.DataFrame:
    """Row and place at which each of consecutive blocks begins, from those of the first."""
    out = []
    for block, closed, left in zip(rows["block"], rows["closed"], rows["left"]):
        out.append((int(block), row, at))
        row, at = row + int(closed[at]), int(left[at])
    return pd.DataFrame(out, columns=["block", "first_row", "filled"])


def layout(documents: DataFrame, length: int, block: int = BLOCK) -> DataFrame:
    """(doc_number, chunk, row_number, at, start, n) of documents (doc_number, n_tokens): tokens start .. start + n of the document
    lie in row row_number from place at. Numbers follow the order of documents; a document of under 2 tokens keeps its number and
    has no piece."""
    if length < 2:
        raise ValueError("rows have at least two places")
    spark = documents.sparkSession
    lots = documents.select("doc_number", "n_tokens", F.floor(F.col("doc_number") / block).alias("block"))

    def effect(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        closed, left = _effect(rows.sort_values("doc_number")["n_tokens"].to_numpy(), length)
        return pd.DataFrame({"block": [key[0]], "closed": [closed.tolist()], "left": [left.tolist()]})

    table = "block bigint, closed array<bigint>, left array<bigint>"
    scratch = Scratch(spark, "layout")
    levels = [scratch.keep(lots.groupBy("block").applyInPandas(effect, table), "effects")]
    while levels[-1].count() > FAN:
        up = levels[-1].withColumn("up", F.floor(F.col("block") / FAN))
        levels.append(scratch.keep(up.groupBy("up").applyInPandas(_chained, table), "chained"))
    begins = _starts(0, 0, levels[-1].orderBy("block").toPandas())
    starts = spark.createDataFrame(begins, STARTS)
    for lower in reversed(levels[:-1]):
        above = lower.withColumn("up", F.floor(F.col("block") / FAN)).join(starts.withColumnRenamed("block", "up"), "up")
        starts = scratch.keep(above.groupBy("up").applyInPandas(lambda rows: _starts(int(rows["first_row"].iloc[0]), int(rows["filled"].iloc[0]), rows.sort_values("block")), STARTS), "starts")

    def place(_: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("doc_number")
        numbers, first, filled = rows["doc_number"].to_numpy(), int(rows["first_row"].iloc[0]), int(rows["filled"].iloc[0])
        pieces = [p for p in _walk(rows["n_tokens"].to_numpy(), length, filled) if p[0] >= 0]
        out = pd.DataFrame(pieces, columns=["k", "row_number", "at", "start", "n"])
        out["doc_number"], out["row_number"] = numbers[out["k"].to_numpy(dtype=int)], out["row_number"] + first
        out["chunk"] = out.groupby("k").cumcount()
        return out[["doc_number", "chunk", "row_number", "at", "start", "n"]]

    return lots.join(starts, "block").groupBy("block").applyInPandas(place, LAYOUT)


def packed_rows(layout_rows: DataFrame, tokens: DataFrame, length: int, pad: int) -> DataFrame:
    """(row_number, input_ids, document_ids, attention_mask) from a layout and tokens (doc_number, ids)."""
    pieces = layout_rows.join(tokens, "doc_number").select("row_number", "at", "doc_number", F.slice("ids", F.col("start") + 1, F.col("n")).alias("ids"))
    rows = pieces.groupBy("row_number").agg(F.array_sort(F.collect_list(F.struct("at", "doc_number", "ids"))).alias("p"))  # at most `length` pieces
    ids = F.flatten("p.ids")
    owners = F.flatten(F.transform("p", lambda x: F.array_repeat(x["doc_number"], F.size(x["ids"]))))
    rest = F.lit(length) - F.size("ids")
    return rows.select("row_number", ids.alias("ids"), owners.alias("owners")).select(
        "row_number",
        F.concat("ids", F.array_repeat(F.lit(pad), rest)).cast("array<int>").alias("input_ids"),
        F.concat("owners", F.array_repeat(F.lit(-1).cast("bigint"), rest)).alias("document_ids"),
        F.concat(F.array_repeat(F.lit(1), F.size("ids")), F.array_repeat(F.lit(0), rest)).cast("array<tinyint>").alias("attention_mask"),
    )


def unpacked(rows: DataFrame) -> DataFrame:
    """(doc_number, ids) of packed rows: the tokens of each document in order, the one that a row repeats from the row before left out."""
    places = rows.select("row_number", F.posexplode(F.arrays_zip("input_ids", "document_ids")).alias("at", "x")).where("x.document_ids >= 0")
    pieces = places.groupBy(F.col("x.document_ids").alias("doc_number"), "row_number").agg(F.array_sort(F.collect_list(F.struct("at", F.col("x.input_ids").alias("id")))).alias("p"))  # a row's places at most
    whole = pieces.groupBy("doc_number").agg(F.array_sort(F.collect_list(F.struct("row_number", F.col("p.id").alias("ids")))).alias("pieces"))  # one document
    return whole.select("doc_number", F.flatten(F.transform("pieces", lambda p, i: F.when(i == 0, p["ids"]).otherwise(F.slice(p["ids"], 2, F.size(p["ids"]))))).alias("ids"))


def valid_targets(document_ids: Column, attention_mask: Column) -> Column:
    """Neighbours in a row of one document, both unmasked."""
    n = F.size(document_ids) - 1
    pairs = F.zip_with(
        F.arrays_zip(F.slice(document_ids, 1, n).alias("d"), F.slice(attention_mask, 1, n).alias("m")),
        F.arrays_zip(F.slice(document_ids, 2, n).alias("d"), F.slice(attention_mask, 2, n).alias("m")),
        lambda x, y: ((x["d"] == y["d"]) & (x["m"] == 1) & (y["m"] == 1)).cast("int"),
    )
    return F.when(n < 1, F.lit(0)).otherwise(F.aggregate(pairs, F.lit(0), lambda a, x: a + x))


def position_ids(document_ids: Column) -> Column:
    """Places that begin again with each document, whose places stand together; padding (-1) has place 0."""
    return F.transform(document_ids, lambda d, i: F.when(d == -1, 0).otherwise(i + 1 - F.array_position(document_ids, d)).cast("int"))


def epoch_step(size: int, seed: int, epoch: int) -> tuple[int, int]:
    """(stride, shift) of an epoch's affine order of ``size`` rows; the stride shares no factor with the size."""
    if size <= 0 or epoch < 0:
        raise ValueError("an epoch needs rows and a number from 0")
    drawn = int.from_bytes(hashlib.sha256(f"{seed}:{epoch}".encode()).digest(), "big")
    stride = next(s for s in range(drawn % size or 1, 2 * size + 2) if math.gcd(s, size) == 1)
    return stride % size or (1 if size > 1 else 0), drawn // size % size


def epoch_order(cursors: DataFrame, size: int, seed: int) -> DataFrame:
    """(cursor, row) for cursors from 0 on: the row that each reads. A projection: no shuffle, no state, resumed by a filter."""
    spark = cursors.sparkSession
    last = cursors.agg(F.max("cursor")).first()[0]
    steps = [(e, *epoch_step(size, seed, e)) for e in range((last // size + 1) if last is not None else 0)]
    known = F.broadcast(spark.createDataFrame(steps, "epoch bigint, stride bigint, shift bigint"))  # a row an epoch
    product = (F.col("stride").cast("decimal(38,0)") * F.pmod("cursor", F.lit(size)) + F.col("shift")) % F.lit(size).cast("decimal(38,0)")
    return cursors.withColumn("epoch", F.floor(F.col("cursor") / size)).join(known, "epoch").select("cursor", product.cast("bigint").alias("row"))


def batches(rows: DataFrame, size: int) -> DataFrame:
    """(batch, rows): rows by cursor in lots of ``size``."""
    return rows.groupBy(F.floor(F.col("cursor") / size).alias("batch")).agg(F.transform(F.array_sort(F.collect_list(F.struct("cursor", "row"))), lambda x: x["row"]).alias("rows"))
