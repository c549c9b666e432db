"""Corpus reports: vocabularies, tokenizer measurements, samples, mixtures, quality of lines, chat turns."""

from __future__ import annotations

import base64
import hashlib
import json
import os
import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.sources import files

UNKNOWN = "<unk>"
#: Fixed value: how byte-level vocabularies cut a text before they merge.
PRESPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MENU_WORDS = ("목록", "이전 글", "다음 글", "로그인", "회원가입", "닫기", "확인", "메뉴", "Home", "Login", "Sign up", "Menu", "Next", "Previous", "Copyright")


def letters(text: Column) -> Column:
    """Code points of a text."""
    return F.filter(F.split(text, ""), lambda c: c != "")


def character_counts(texts: DataFrame) -> DataFrame:
    """(ch, n) of every character. Counted within each text first, so that what is shuffled is small."""
    per = texts.select(F.explode(letters(F.col("text"))).alias("ch"))
    return per.groupBy("ch").agg(F.count("*").alias("n"))


def character_vocabulary(texts: DataFrame) -> DataFrame:
    """(id, ch): <unk> is 0, the characters follow in code point order. A vocabulary has at most 1.1 million rows."""
    chars = character_counts(texts).select("ch")
    ranked = chars.withColumn("id", F.row_number().over(Window.orderBy(F.encode("ch", "UTF-32")))).select(F.col("id").cast("int").alias("id"), "ch")
    return texts.sparkSession.createDataFrame([(0, UNKNOWN)], "id int, ch string").unionAll(ranked)


def _code_points(vocabulary: DataFrame) -> np.ndarray:
    """Id of each code point, 0 for those a vocabulary (id, ch) does not have. A vocabulary is no larger than Unicode."""
    table = np.zeros(0x110000, dtype=np.int32)
    for row in vocabulary.where(F.col("id") > 0).toLocalIterator():
        table[ord(row["ch"])] = row["id"]
    return table


def _ids(table: np.ndarray, text: str) -> np.ndarray:
    return table[np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)]


def _signs(table: np.ndarray) -> dict[int, str]:
    """Sign of each id; 0 stands for the sign of the unknown."""
    known = np.flatnonzero(table)
    return {int(table[c]): chr(c) for c in known} | {0: UNKNOWN}


def _spelt(signs: dict[int, str], ids: np.ndarray) -> str:
    return "".join(map(signs.__getitem__, ids.tolist()))


def encode_characters(texts: DataFrame, vocabulary: DataFrame, *keys: str) -> DataFrame:
    """(keys, ids) by a vocabulary (id, ch); what it does not have is 0; null and empty texts give an empty list."""
    table = texts.sparkSession.sparkContext.broadcast(_code_points(vocabulary))

    @F.pandas_udf("array<int>")
    def ids(column: pd.Series) -> pd.Series:
        return pd.Series([_ids(table.value, t) for t in column.fillna("")])

    return texts.select(*keys, ids("text").alias("ids"))


def decode_characters(encoded: DataFrame, vocabulary: DataFrame, *keys: str) -> DataFrame:
    """(keys, text) of (keys, ids); id 0 stands for the sign of the unknown."""
    back = encoded.sparkSession.sparkContext.broadcast(_signs(_code_points(vocabulary)))

    @F.pandas_udf("string")
    def text(column: pd.Series) -> pd.Series:
        return pd.Series([_spelt(back.value, ids) for ids in column])

    return encoded.select(*keys, text("ids").alias("text"))


def tokenizer_folder() -> str:
    """Folder of the public tokenizer files."""
    return os.environ.get("GRISTMILL_TOKENIZERS", "/opt/tokenizers")


class Tokenizer:
    """A public tokenizer file: byte-level ranks by their library if there are such, else a described tokenizer. Strings of special tokens are
    ordinary text."""

    def __init__(self, name: str, folder: str):
        if os.path.exists(f"{folder}/{name}.tiktoken"):
            import tiktoken

            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, open(f"{folder}/{name}.tiktoken", "rb"))}
            library = tiktoken.Encoding(name, pat_str=PRESPLIT, mergeable_ranks=ranks, special_tokens={})
            self.encode, self.decode = library.encode_ordinary, library.decode
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer as Described

            library = Described.from_file(f"{folder}/{name}.json")
            library.encode_special_tokens = True
            self.encode = lambda text: library.encode(text, add_special_tokens=False).ids
            self.decode = lambda ids: library.decode(ids, skip_special_tokens=False)


def save_vocabulary(vocabulary: DataFrame, folder: str) -> dict:
    """A vocabulary (id, ch) as a file with its description; a folder that is there already is refused. At most 1.1 million rows."""
    if files.exists(folder):
        raise FileExistsError(folder)
    rows = sorted((r["id"], r["ch"]) for r in vocabulary.toLocalIterator())
    if [i for i, _ in rows] != list(range(len(rows))) or not rows or rows[0][1] != UNKNOWN:
        raise ValueError("ids must run from 0, and 0 be the sign of the unknown")
    content = json.dumps([ch for _, ch in rows], ensure_ascii=True).encode()
    about = {"kind": "character_vocabulary", "sha256": hashlib.sha256(content).hexdigest(), "size": len(rows), "specials": {UNKNOWN: 0}}
    files.write_whole(f"{folder}/vocabulary.json", content)
    files.write_whole(f"{folder}/about.json", json.dumps(about, indent=2).encode())
    return about


def load_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    """(id, ch) as saved. Another checksum, another size, or special signs at other places than described are refused."""
    about = files.read_json(f"{folder}/about.json")
    if files.sha256(f"{folder}/vocabulary.json") != about["sha256"]:
        raise ValueError("the vocabulary has another checksum")
    signs = files.read_json(f"{folder}/vocabulary.json")
    if len(signs) != about["size"]:
        raise ValueError("the vocabulary has another size")
    for sign, at in about["specials"].items():
        if signs[at : at + 1] != [sign]:
            raise ValueError(f"special sign {sign} is not at {at}")
    return spark.createDataFrame(list(enumerate(signs)), "id int, ch string")


def vocabulary_checks(texts: DataFrame, vocabulary: DataFrame, again: DataFrame, *keys: str) -> DataFrame:
    """(check, failures) over texts (keys, text): round trips, equal ids at a second time and by the vocabulary ``again`` (as loaded), one id a
    character, and nothing unknown in texts that the vocabulary was made of. Each row counts by itself, whatever its keys: one pass in which
    the ids of a text, which take more room than the text, leave Python as four counts."""
    one, other = _code_points(vocabulary), _code_points(again)
    sent = texts.sparkSession.sparkContext.broadcast((one, other, _signs(one)))
    names = ("round_trip", "reload", "one_id_a_character", "unknown")

    def failed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, other, signs = sent.value
        for batch in batches:
            counts = np.zeros(len(names), dtype=np.int64)
            for text, length in zip(batch.column(0), batch.column(1)):
                text = text.as_py()
                ids = _ids(one, text)
                counts += (_spelt(signs, ids) != text, not np.array_equal(ids, _ids(other, text)), len(ids) != length.as_py(), not ids.all())
            yield pa.RecordBatch.from_arrays([pa.array([n]) for n in counts], names=list(names))

    text = F.coalesce("text", F.lit(""))
    counted = texts.select(text.alias("text"), F.length(text).alias("length")).mapInArrow(failed, ", ".join(f"{n} bigint" for n in names))
    summed = counted.agg(*[F.coalesce(F.sum(n), F.lit(0).cast("bigint")).alias(n) for n in names])
    return summed.select(F.explode(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])).alias("check", "failures"))


_tokenizers: dict[tuple[str, str], Tokenizer] = {}


def tokenizer(name: str, folder: str) -> Tokenizer:
    """A tokenizer, loaded once a worker."""
    if (name, folder) not in _tokenizers:
        _tokenizers[name, folder] = Tokenizer(name, folder)
    return _tokenizers[name, folder]


def encoder(name: str, folder: str | None = None):
    """Arrow UDF text -> ids by a public tokenizer; null and empty give an empty list."""
    at = folder or tokenizer_folder()

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        encode = tokenizer(name, at).encode
        return pd.Series([np.array(encode(t), dtype=np.int32) for t in texts.fillna("")])

    return ids


def decoder(name: str, folder: str | None = None):
    """Arrow UDF ids -> text, the inverse of ``encoder``."""
    at = folder or tokenizer_folder()

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        decode = tokenizer(name, at).decode
        return pd.Series([decode(x.tolist()) for x in ids])

    return text


def measurer(name: str, folder: str | None = None):
    """Arrow UDF text -> (tokens, seconds of encoding, whether decoding gives the text again), so that no ids leave Python."""
    at = folder or tokenizer_folder()

    @F.pandas_udf("tokens int, seconds double, same boolean")
    def measured(texts: pd.Series) -> pd.DataFrame:
        t, rows = tokenizer(name, at), []
        for text in texts.fillna(""):
            began = time.perf_counter()
            ids = t.encode(text)
            took = time.perf_counter() - began
            rows.append((len(ids), took, t.decode(ids) == text))
        return pd.DataFrame(rows, columns=["tokens", "seconds", "same"])

    return measured


def splitter(pattern: str = r"\s*\S+|\s+$"):
    """Expression that cuts a text into pieces that together are the text; other splitters plug in as any function of a column. No
    Korean morphological analyser is installed, so there is none here."""
    return lambda text: F.regexp_extract_all(text, F.lit(f"(?U)({pattern})"))


def broken_pieces(texts: DataFrame, split, *keys: str) -> DataFrame:
    """Texts, or their keys, whose pieces do not make up the text again: none, for a sound splitter."""
    return texts.withColumn("pieces", split(F.col("text"))).where(F.array_join("pieces", "") != F.col("text")).select(*(keys or ["text"]))


def token_document(ids: Column, bos: int, eos: int) -> Column:
    """Ids between their signs of beginning and end."""
    return F.concat(F.array(F.lit(bos)), ids, F.array(F.lit(eos)))


def tokenizer_report(measured: DataFrame) -> DataFrame:
    """(domain, documents, tokens, utf8_bytes, characters, seconds, roundtrip_failures, tokens_per_byte, bytes_per_second) of rows (domain, text,
    tokens, seconds, same); empty texts are left out. Seconds are of one core: those of all tasks in sum."""
    per = measured.where("text <> ''").groupBy(F.coalesce("domain", F.lit("unknown")).alias("domain")).agg(
        F.count("*").alias("documents"), F.sum("tokens").alias("tokens"), F.sum(F.octet_length("text")).alias("utf8_bytes"), F.sum(F.length("text")).alias("characters"),
        F.sum("seconds").alias("seconds"), F.count_if(~F.col("same")).alias("roundtrip_failures"),
    )
    return per.withColumns({"tokens_per_byte": F.col("tokens") / F.col("utf8_bytes"), "bytes_per_second": F.try_divide("utf8_bytes", "seconds")})


def length_distribution(rows: DataFrame, value: str, limit: int, *keys: str) -> DataFrame:
    """(keys, rows, mean, p50, p95, truncated): how long things are and what share a limit would cut."""
    return rows.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.avg(value).alias("mean"), F.percentile(value, F.lit(0.5)).alias("p50"), F.percentile(value, F.lit(0.95)).alias("p95"),
        F.avg((F.col(value) > limit).cast("double")).alias("truncated"),
    )


def stratified_sample(rows: DataFrame, stratum: str, key: str, size: int = 100) -> DataFrame:
    """``size`` rows a stratum, those with the least SHA-256 of their key. Each task first keeps its own least rows through a window over
    stratum and hash bucket, so no task ranks a whole stratum."""
    hashed = rows.withColumn("_h", F.sha2(F.col(key).cast("string"), 256)).withColumn("_bucket", F.substring("_h", 1, 2))
    order = [F.col("_h"), F.col(key)]
    near = hashed.withColumn("_r", F.row_number().over(Window.partitionBy(stratum, "_bucket").orderBy(*order))).where(F.col("_r") <= size)
    return near.withColumn("_r", F.row_number().over(Window.partitionBy(stratum).orderBy(*order))).where(F.col("_r") <= size).drop("_h", "_bucket", "_r")


def mixture(rows: DataFrame, key: str, weight: str, targets: dict[str, float]) -> DataFrame:
    """(key, weight, share, target, off): actual shares of a weight against targets."""
    total = rows.groupBy(key).agg(F.sum(weight).alias("weight"))
    share = F.col("weight") / F.sum("weight").over(Window.partitionBy())
    table = F.create_map(*[F.lit(x) for k, v in targets.items() for x in (k, float(v))])
    goal = F.coalesce(F.try_element_at(table, F.col(key)), F.lit(0.0))
    return total.select(key, "weight", share.alias("share"), goal.alias("target"), (share - goal).alias("off"))


def line_quality(texts: DataFrame, *keys: str) -> DataFrame:
    """(keys, lines, repeated_lines, menu_lines, letters_share): line-level signs of menus, advertising and repetition."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    menu = lambda x: (F.length(x) < 40) & x.rlike("|".join(MENU_WORDS))
    wordy = F.length(F.regexp_replace("text", r"[^\p{L}\p{N}]", ""))
    return texts.withColumn("_lines", lines).select(
        *keys, F.size("_lines").alias("lines"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).alias("repeated_lines"), F.size(F.filter("_lines", menu)).alias("menu_lines"),
        F.when(F.length("text") > 0, wordy / F.length("text")).otherwise(0.0).alias("letters_share"),
    )


def chat_pairs(turns: DataFrame, conversation: str = "conv", turn: str = "turn") -> DataFrame:
    """(conversation, turn, prompt, response): each user turn that the assistant answers next."""
    w = Window.partitionBy(conversation).orderBy(turn)
    following = turns.withColumns({"_role": F.lead("role").over(w), "response": F.lead("text").over(w)})
    return following.where("role = 'user' and _role = 'assistant'").select(conversation, turn, F.col("text").alias("prompt"), "response")


def composition(records: DataFrame) -> DataFrame:
    """(source, domain, lang, documents, characters) with all subtotals; nulls of the data are named, nulls of the result are totals."""
    named = records.select(*[F.coalesce(c, F.lit("(none)")).alias(c) for c in ("source", "domain", "lang")], F.length("text").cast("bigint").alias("chars"))
    return named.rollup("source", "domain", "lang").agg(F.count("*").alias("documents"), F.sum("chars").alias("characters"))
