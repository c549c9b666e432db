import math
import random

import pytest
from pyspark.sql import functions as F

from gristmill.operators import packing


def next_fit(documents, length):
    """Plain next fit, row by row."""
    rows, row = [], []
    for number, tokens in documents:
        if len(tokens) < 2:
            continue
        if row and len(row) + len(tokens) > length:
            rows.append(row)
            row = []
        while len(tokens) > length:
            rows.append([(number, t) for t in tokens[:length]])
            tokens = tokens[length - 1 :]
        row = row + [(number, t) for t in tokens]
        if len(row) == length:
            rows.append(row)
            row = []
    return rows + ([row] if row else [])


@pytest.mark.parametrize("length, block, seed, fan", [(5, 3, 1, 256), (8, 7, 2, 2), (16, 1000, 3, 256), (2, 4, 4, 3), (7, 1, 5, 4)])
def test_rows_equal_plain_next_fit(spark, length, block, seed, fan, monkeypatch):
    monkeypatch.setattr(packing, "FAN", fan)  # several levels of the tree
    drawn = random.Random(seed)
    sizes = [drawn.choice([0, 1, 2, 3, length - 1, length, length + 1, 3 * length, drawn.randint(0, 4 * length)]) for _ in range(60)]
    documents = [(i, list(range(1000 * i, 1000 * i + n))) for i, n in enumerate(sizes)]
    tokens = spark.createDataFrame(documents, "doc_number bigint, ids array<int>")
    laid = packing.layout(tokens.select("doc_number", F.size("ids").alias("n_tokens")), length, block=block)
    got = packing.packed_rows(laid, tokens, length, pad=-7).orderBy("row_number").collect()
    want = next_fit(documents, length)
    assert [r["row_number"] for r in got] == list(range(len(want)))
    for r, w in zip(got, want):
        rest = length - len(w)
        assert r["input_ids"] == [t for _, t in w] + [-7] * rest
        assert r["document_ids"] == [d for d, _ in w] + [-1] * rest
        assert r["attention_mask"] == [1] * len(w) + [0] * rest


def test_every_pair_once(spark):
    tokens = spark.createDataFrame([(0, list(range(17)))], "doc_number bigint, ids array<int>")
    rows = packing.packed_rows(packing.layout(tokens.select("doc_number", F.size("ids").alias("n_tokens")), 5), tokens, 5, 99).collect()
    pairs = [p for r in rows for p in zip(r["input_ids"], r["input_ids"][1:]) if 99 not in p]
    assert sorted(pairs) == [(i, i + 1) for i in range(16)]


def test_targets_and_positions(spark):
    df = spark.createDataFrame([([0, 0, 0, 0, 1, 1, 1, 1, -1, -1], [1] * 8 + [0] * 2), ([], []), ([3], [1])], "d array<bigint>, m array<tinyint>")
    got = df.select(packing.valid_targets(F.col("d"), F.col("m")).alias("n"), packing.position_ids(F.col("d")).alias("p")).collect()
    assert [r["n"] for r in got] == [6, 0, 0]
    assert got[0]["p"] == [0, 1, 2, 3, 0, 1, 2, 3, 0, 0]


@pytest.mark.parametrize("size", [1, 2, 6, 11, 100])
def test_epoch_order_is_a_permutation(spark, size):
    rows = packing.epoch_order(spark.range(2 * size).withColumnRenamed("id", "cursor"), size, 42).orderBy("cursor").collect()
    order = [r["row"] for r in rows]
    assert sorted(order[:size]) == sorted(order[size:]) == list(range(size))
    tail = packing.epoch_order(spark.range(size, 2 * size).withColumnRenamed("id", "cursor"), size, 42).orderBy("cursor").collect()
    assert [r["row"] for r in tail] == order[size:]
    stride, shift = packing.epoch_step(size, 42, 1)
    assert math.gcd(stride, size) == 1 or size == 1
    assert order[size] == shift % size


def test_bad_arguments(spark):
    with pytest.raises(ValueError):
        packing.layout(spark.createDataFrame([], "doc_number bigint, n_tokens int"), 1)
    with pytest.raises(ValueError):
        packing.epoch_step(0, 1, 0)


def test_export_and_read_back(spark, tmp_path):
    from gristmill.plans import pack

    tokens = spark.createDataFrame([(i, list(range(i + 1))) for i in range(40)], "doc_number bigint, ids array<int>")
    rows = packing.packed_rows(packing.layout(tokens.select("doc_number", F.size("ids").alias("n_tokens")), 16), tokens, 16, 0)
    manifest = pack.packed_manifest(rows, "train", 16)
    assert manifest["valid_targets"] == sum(i for i in range(1, 40))
    out = str(tmp_path / "out")
    written = pack.export_arrays(rows, out, 16, manifest, shard=17)
    assert [w["shard"] for w in written] == list(range(len(written))) and len(written) > 2 and {w["rows"] for w in written[:-1]} == {17}
    held = pack.open_packed(out)
    want = rows.orderBy("row_number").collect()
    assert held.rows == len(want) == manifest["rows"]
    for first, count in ((0, len(want)), (3, 1), (10, 20), (17, 17), (len(want), 0)):
        got = held.read(first, count)
        for k in ("input_ids", "document_ids", "attention_mask"):
            assert got[k].shape == (count, 16) and got[k].tolist() == [r[k] for r in want[first : first + count]]
    for first, count in ((len(want), 1), (-1, 2), (0, len(want) + 1)):
        with pytest.raises(ValueError):
            held.read(first, count)
    with pytest.raises(FileExistsError):
        pack.export_arrays(rows, out, 16, manifest)
    # What another attempt of a task left behind does not count.
    (tmp_path / "out" / "000000-input_ids-0123456789ab.bin").write_bytes(b"half")
    assert pack.open_packed(out).read(0)["input_ids"].tolist() == [want[0]["input_ids"]]
    part = tmp_path / "out" / written[0]["input_ids_file"]
    raw = bytearray(part.read_bytes())
    raw[0] ^= 1
    part.write_bytes(bytes(raw))
    with pytest.raises(ValueError, match="checksum"):
        pack.open_packed(out)
    part.write_bytes(bytes(raw[:-1]))
    with pytest.raises(ValueError, match="size"):
        pack.open_packed(out)
    (tmp_path / "out" / "manifest.json").write_text('{"kind": "other"}')
    with pytest.raises(ValueError, match="known"):
        pack.open_packed(out)
    nothing = str(tmp_path / "none")
    assert pack.export_arrays(rows.where("false"), nothing, 16, manifest) == [] and pack.open_packed(nothing).rows == 0
    with pytest.raises(ValueError):
        pack.packed_manifest(rows.where("false"), "train", 16)


def test_guards(spark):
    from gristmill.operators.corpus import tokenizer_folder
    from gristmill.plans import pack

    with pytest.raises(Exception, match="not of split"):
        pack.only_split(spark.createDataFrame([("train",), ("test",)], "split string"), "train").collect()
    path = f"{tokenizer_folder()}/byte_bpe_50k.json"
    assert pack.checked_tokenizer(path, vocab_size=50257, specials={"<|endoftext|>": 50256}) == {"<|endoftext|>": 50256}
    for bad in ({"sha256": "0"}, {"vocab_size": 1}, {"specials": {"<|endoftext|>": 1}}):
        with pytest.raises(ValueError):
            pack.checked_tokenizer(path, **bad)
    chunks = spark.createDataFrame([(list(range(7)),), ([1],), ([],), ([1, 2],)], "i array<int>").select(pack.text_chunks(F.col("i"), 4).alias("c")).collect()
    assert [r["c"] for r in chunks] == [[[0, 1, 2, 3], [3, 4, 5, 6]], [], [], [[1, 2]]]
    ordered = spark.createDataFrame([(3, None), (1, "bad"), (2, None), (0, None)], "ordinal int, reason string")
    assert [r["ordinal"] for r in pack.first_kept(ordered, 2).collect()] == [0, 2]


def test_ids_are_made_once_a_text_not_once_a_window(spark):
    """Ids out of Python cannot stand in a function of windows at all; those of an expression took the square of the length there."""
    from gristmill.operators.corpus import encoder
    from gristmill.plans import pack

    made = pack.text_chunks(encoder("byte_bpe_50k")(F.col("t")), 4)
    ids, chunks = spark.createDataFrame([(" a b c d e",)], "t string").select(encoder("byte_bpe_50k")("t"), made).first()
    assert len(ids) > 4 and chunks == [ids[k : k + 4] for k in range(0, len(ids) - 1, 3)]
    for n, want in ((0, None), (1, None), (2, [[7, 7]])):
        repeated = F.transform(F.sequence(F.lit(1), F.col("n")), lambda x: F.lit(7))
        assert spark.createDataFrame([(n,)], "n int").select(pack.text_chunks(F.when(F.col("n") > 0, repeated).otherwise(F.array().cast("array<int>")), 4).alias("c")).first()["c"] == (want or [])
