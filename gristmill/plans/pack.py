"""From clean records of one split to packed rows, their manifest, and rows read back."""

from __future__ import annotations

import dataclasses
import hashlib
import itertools
import json
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators import corpus, packing, preparation
from gristmill.plans.shared import Scratch
from gristmill.sources import files
from gristmill.sources.records import write_report

#: Fixed layout of exported arrays: little endian, row after row.
ARRAYS = {"input_ids": "<i4", "document_ids": "<i8", "attention_mask": "u1"}


def only_split(records: DataFrame, split: str) -> DataFrame:
    """The records, all of which must belong to ``split``; any other fails the query."""
    return records.where(F.when(F.col("split").eqNullSafe(split), True).otherwise(F.raise_error(F.concat(F.lit(f"not of split {split}: "), F.coalesce("split", F.lit("null"))))))


def sound_split(spark: SparkSession, manifest: dict, split: str) -> DataFrame:
    """The records of one split of a prepared corpus, as its manifest names them; files that were changed since are refused."""
    if manifest.get("kind") != "clean_corpus" or split not in manifest.get("splits", {}):
        raise ValueError(f"the manifest names no split {split}")
    held = manifest["splits"][split]
    if files.folder_digest(spark, held["path"]) != held["sha256"]:
        raise ValueError(f"split {split} is not what was prepared")
    return spark.read.format(held["format"]).load(held["path"]).withColumn("split", F.lit(split))


def checked_tokenizer(path: str, sha256: str | None = None, vocab_size: int | None = None, specials: dict[str, int] | None = None) -> dict[str, int]:
    """Ids of the special tokens of a tokenizer file, after its hash, size and special ids are found as expected."""
    raw = Path(path).read_bytes()
    if sha256 and hashlib.sha256(raw).hexdigest() != sha256:
        raise ValueError("the tokenizer file has another hash")
    described = json.loads(raw)
    known = {t["content"]: t["id"] for t in described.get("added_tokens", []) if t.get("special")}
    if vocab_size is not None and len(set(described["model"]["vocab"].values()) | set(known.values())) != vocab_size:
        raise ValueError("the tokenizer has another number of ids")
    for token, number in (specials or {}).items():
        if known.get(token) != number:
            raise ValueError(f"special token {token} has id {known.get(token)}, not {number}")
    return known


def corpus_digest(texts: DataFrame, text: str = "text") -> DataFrame:
    """(documents, digest): a digest of the corpus that does not depend on the order of its documents, each counted with its length."""
    one = F.conv(F.substring(F.sha2(F.concat(F.octet_length(text).cast("string"), F.lit(":"), F.col(text)), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return texts.where(F.col(text).isNotNull()).agg(F.count("*").alias("documents"), F.coalesce(F.sum(one), F.lit(0).cast("decimal(38,0)")).alias("digest"))


def pack_split(clean: DataFrame, split: str, tokenizer: str, length: int, bos: int, eos: int, pad: int) -> DataFrame:
    """(row_number, input_ids, document_ids, attention_mask) of the clean records of one split (content_sha256, split, text), in order of their
    digests, each between its signs of beginning and end. Records of another split fail the query; see ``sound_split`` for files."""
    scratch = Scratch(clean.sparkSession, "pack")
    numbered = preparation.numbered(only_split(clean, split).select("content_sha256", "split", "text"))
    ids = corpus.token_document(corpus.encoder(tokenizer)(F.col("text")), bos, eos)
    tokens = scratch.keep(numbered.select("doc_number", ids.alias("ids")), "tokens")
    return packing.packed_rows(packing.layout(tokens.select("doc_number", F.size("ids").alias("n_tokens")), length), tokens, length, pad)


def packed_manifest(rows: DataFrame, split: str, length: int, **provenance: str) -> dict:
    """Counts of packed rows; rows or targets that are missing are an error."""
    counted = rows.agg(F.count("*").alias("rows"), F.sum(packing.valid_targets(F.col("document_ids"), F.col("attention_mask"))).alias("targets")).first()
    if not counted["rows"] or not counted["targets"]:
        raise ValueError("nothing to predict")
    return {"format_version": 1, "kind": "packed_tokens", "split": split, "rows": counted["rows"], "sequence_length": length, "valid_targets": counted["targets"], **provenance}


#: Rows of one shard of exported arrays.
SHARD = 16_384


def export_arrays(rows: DataFrame, folder: str, length: int, manifest: dict, shard: int = SHARD) -> list[dict]:
    """Packed rows as binary arrays in a folder that the tasks share, on any file system: shard n holds the rows from n x ``shard`` on, one file an
    array. Every attempt of a task writes files of its own name; the manifest, written last and whole, names those that count, with their
    sizes and checksums. An existing folder is refused."""
    if files.exists(folder):
        raise FileExistsError(folder)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, at = files.located(folder)
        system.create_dir(at, recursive=True)
        for number, held in _by_shard(batches, shard):
            attempt, n, opened, about = uuid.uuid4().hex[:12], 0, {}, {}
            for k in ARRAYS:
                about[f"{k}_file"] = f"{number:06d}-{k}-{attempt}.bin"
                opened[k] = (system.open_output_stream(f"{at}/{about[f'{k}_file']}"), hashlib.sha256())
            for frame in held:
                for k, kind in ARRAYS.items():
                    raw = np.stack(frame[k].to_numpy()).astype(kind).tobytes()
                    opened[k][0].write(raw)
                    opened[k][1].update(raw)
                n += len(frame)
            for k, (stream, digest) in opened.items():
                stream.close()
                about[k] = digest.hexdigest()
            yield pd.DataFrame([{"shard": number, "rows": n, **about}])

    last = rows.agg(F.max("row_number")).first()[0]
    shards = 0 if last is None else last // shard + 1
    placed = rows.withColumn("shard", F.floor(F.col("row_number") / shard))
    ordered = placed.repartitionByRange(max(1, shards), "shard").sortWithinPartitions("row_number")
    schema = "shard bigint, rows bigint, " + ", ".join(f"{k}_file string, {k} string" for k in ARRAYS)
    written = [r.asDict() for r in ordered.mapInPandas(write, schema).orderBy("shard").collect()]  # a row a shard
    write_report(f"{folder}/manifest.json", manifest | {"sequence_length": length, "shard_rows": shard, "dtypes": ARRAYS, "shards": written})
    return written


def _by_shard(batches: Iterator[pd.DataFrame], shard: int) -> Iterator[tuple[int, Iterator[pd.DataFrame]]]:
    """(shard, its frames) of frames in order of row numbers; frames are cut where a shard ends."""
    cut = ((int(n), part) for frame in batches for n, part in frame.groupby(frame["row_number"] // shard, sort=True))
    for number, group in itertools.groupby(cut, key=lambda x: x[0]):
        yield number, (part for _, part in group)


def open_packed(folder: str, verify: bool = True) -> Packed:
    """Exported rows for reading by ranges. A manifest of another kind is refused; with ``verify`` so is a file of another size or checksum."""
    manifest = files.read_json(f"{folder}/manifest.json")
    expected = {"kind": "packed_tokens", "format_version": 1, "dtypes": ARRAYS}
    if {k: manifest.get(k) for k in expected} != expected:
        raise ValueError("not a set of packed rows that is known here")
    system, at = files.located(folder)
    width = {k: manifest["sequence_length"] * np.dtype(kind).itemsize for k, kind in ARRAYS.items()}
    for held in manifest["shards"] if verify else []:
        for k in ARRAYS:
            name = held[f"{k}_file"]
            if system.get_file_info(f"{at}/{name}").size != held["rows"] * width[k]:
                raise ValueError(f"{name} has another size")
            if files.sha256(f"{folder}/{name}") != held[k]:
                raise ValueError(f"{name} has another checksum")
    return Packed(manifest, system, at, width)


@dataclasses.dataclass(frozen=True)
class Packed:
    """Exported rows; only the bytes of the rows asked for are read."""

    manifest: dict
    system: fs.FileSystem
    at: str
    width: dict[str, int]

    @property
    def rows(self) -> int:
        return sum(s["rows"] for s in self.manifest["shards"])

    def read(self, first: int, count: int = 1) -> dict[str, np.ndarray]:
        """Rows first, first + 1, ...: an array of ``count`` lines for each kind. Rows that are not there are an error."""
        if first < 0 or count < 0 or first + count > self.rows:
            raise ValueError(f"no rows {first} to {first + count} of {self.rows}")
        per, out = self.manifest["shard_rows"], {k: [] for k in ARRAYS}
        for held in self.manifest["shards"][first // per : -(-(first + count) // per)]:
            begin = max(first - held["shard"] * per, 0)
            n = min(first + count - held["shard"] * per, held["rows"]) - begin
            for k, kind in ARRAYS.items():
                with self.system.open_input_file(f"{self.at}/{held[f'{k}_file']}") as f:
                    out[k].append(np.frombuffer(f.read_at(n * self.width[k], begin * self.width[k]), dtype=kind).reshape(n, -1))
        length = self.manifest["sequence_length"]
        return {k: np.concatenate(v) if v else np.zeros((0, length), ARRAYS[k]) for k, v in out.items()}


def rows_between(rows: DataFrame, first: int, last: int) -> DataFrame:
    """Packed rows of a range of numbers: the filter reaches the Parquet scan."""
    return rows.where(F.col("row_number").between(first, last))


def first_kept(records: DataFrame, n: int, order: str = "ordinal") -> DataFrame:
    """The first n records without a reason against them, in order of arrival."""
    return records.where("reason is null").orderBy(order).limit(n)


def text_chunks(ids, limit: int):
    """Windows of at most ``limit`` ids that share one id with the next, so that every neighbour is scored once. The ids are bound to a name, as
    what stands in a function of windows is evaluated for each of them."""

    def windows(ids):
        starts = F.sequence(F.lit(0), F.greatest(F.size(ids) - 2, F.lit(0)), F.lit(limit - 1))
        return F.when(F.size(ids) < 2, F.array().cast("array<array<int>>")).otherwise(F.transform(starts, lambda s: F.slice(ids, s + 1, F.lit(limit))))

    return F.element_at(F.transform(F.array(ids), windows), 1)
