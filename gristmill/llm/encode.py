"""The whole corpus as token ids of a public tokenizer, and back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.llm import transducer
from gristmill.session import spread

#: Tokens of one Arrow batch that goes back to Spark; a longer document makes a batch of its own.
LOT = 1_000_000


def _encode(name: str, folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder = transducer.load(name, folder)

    def lot(keys: list, found: list[np.ndarray]) -> pa.RecordBatch:
        ends = np.cumsum([0] + [len(x) for x in found]).astype(np.int32)
        values = pa.array(np.concatenate(found) if found else np.zeros(0, np.int32), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.ListArray.from_arrays(ends, values)], names=["doc_id", "ids"])

    for batch in batches:
        keys, found, size = [], [], 0
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = encoder.ids(text.as_py() or "")
            keys.append(key)
            found.append(ids)
            size += len(ids)
            if size >= LOT:
                yield lot(keys, found)
                keys, found, size = [], [], 0
        if keys:
            yield lot(keys, found)


def encoded(documents: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(doc_id, ids: array<int>): one row per row of documents, without special tokens.

    Empty and null texts give an empty list; strings of special tokens are ordinary text; repeated rows and null ids stay. A text
    is encoded whole, whatever its length. An empty table gives an empty result. ``folder`` holds the tokenizer files and must
    exist on every executor.
    """
    at = folder or transducer.folder()
    return spread(documents.select("doc_id", "text")).mapInArrow(lambda b: _encode(tokenizer, at, b), "doc_id bigint, ids array<int>")


def _decode(name: str, folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder = transducer.load(name, folder)
    for batch in batches:
        texts = ["".join(encoder.decode(x.values.to_numpy())) if x.is_valid else None for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])


def decoded(tokens: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids): the inverse of ``encoded`` for byte-level tokenizers; unknown ids are skipped."""
    at = folder or transducer.folder()
    return tokens.select("doc_id", "ids").mapInArrow(lambda b: _decode(tokenizer, at, b), "doc_id bigint, text string")


def _sizes(names: list[str], folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoders = [transducer.load(n, folder) for n in names]
    for batch in batches:
        sizes: list[list[int]] = [[] for _ in names]
        for text in batch.column(1):
            t = text.as_py() or ""
            for k, e in enumerate(encoders):
                sizes[k].append(e.count(t))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).cast(pa.int64()), *[pa.array(s, pa.int64()) for s in sizes], batch.column(2)], names=["doc_id", *[f"n{k}" for k in range(len(names))], "content"]
        )


def token_counts(documents: DataFrame, tokenizers: list[str], folder: str | None = None) -> DataFrame:
    """(doc_id, n0, n1, ..., content): tokens of each document by each of the tokenizers, 0 for empty and null texts, and a hash of the text."""
    at = folder or transducer.folder()
    schema = ", ".join(["doc_id bigint", *[f"n{k} bigint" for k in range(len(tokenizers))], "content bigint"])
    rows = spread(documents.select("doc_id", "text")).withColumn("content", F.xxhash64("text"))
    return rows.mapInArrow(lambda b: _sizes(tokenizers, at, b), schema)
