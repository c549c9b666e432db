import random

import pytest
from tokenizers import Tokenizer

from gristmill.llm import encode, filling, transducer


@pytest.fixture(scope="module")
def ours():
    return transducer.load("byte_bpe_50k")


@pytest.fixture(scope="module")
def theirs():
    t = Tokenizer.from_file(f"{transducer.folder()}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


ALPHABETS = ["ab", "abc ", "가나다라마 ", "aeiouthrn'", " \n\t", "=-_*.", "0123 ", "가a1 .é😀", "<|endoftext|>", "'s't're've"]


@pytest.mark.parametrize("seed", range(8))
def test_equals_the_library(ours, theirs, seed):
    drawn = random.Random(seed)
    for _ in range(150):
        letters = drawn.choice(ALPHABETS)
        text = "".join(drawn.choice(letters) for _ in range(drawn.randint(0, 300)))
        assert ours.ids(text).tolist() == theirs.encode(text, add_special_tokens=False).ids
        assert "".join(ours.decode(ours.ids(text))) == text


@pytest.mark.parametrize("text", ["", "<|endoftext|>", "a" * 30_000, "ab" * 9_000, "=" * 20_000, " " * 9_000 + "x", "가" * 5_000, "é́\r\n\x00�"])
def test_edges(ours, theirs, text):
    assert ours.ids(text).tolist() == theirs.encode(text, add_special_tokens=False).ids
    assert "".join(ours.decode(ours.ids(text))) == text


def test_stream_does_not_depend_on_pieces(ours):
    word = ("streaming" * 700 + "=" * 900).encode()
    drawn, cuts = random.Random(3), [0]
    while cuts[-1] < len(word):
        cuts.append(min(len(word), cuts[-1] + drawn.randint(1, 400)))
    whole = ours.merges.word(word)
    assert list(ours.merges.stream(word[a:b] for a, b in zip(cuts, cuts[1:]))) == whole
    assert b"".join(ours.merges.bytes[t] for t in whole) == word


def test_stream_keeps_constant_memory_and_emits_early(ours):
    given = 0

    def pieces():
        nonlocal given
        for _ in range(400):
            given += 1
            yield b"abcdefgh" * 32

    stream = ours.merges.stream(pieces())
    next(stream)
    assert given < 10


def test_decoding_waits_for_whole_characters(ours):
    pieces = list(ours.decode(ours.ids("😀 가")))
    assert "".join(pieces) == "😀 가" and all("�" not in p for p in pieces)


def test_tables(spark):
    rows = [(1, "hello world", "x"), (2, "", "x"), (3, None, "x"), (None, "가 나", "x"), (1, "hello world", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted(((r["doc_id"] or 0), r["ids"]) for r in encode.encoded(df).collect())
    assert len(got) == 5 and [i for k, i in got if k in (2, 3)] == [[], []]
    back = {r["doc_id"]: r["text"] for r in encode.decoded(encode.encoded(df)).collect()}
    assert back == {1: "hello world", 2: "", 3: "", None: "가 나"}
    assert encode.encoded(df.limit(0)).count() == 0


def test_other_tokenizers():
    for name in ("byte_bpe_multi_50k", "word_bpe_49k", "piece_bpe_32k"):
        encoder = transducer.load(name)
        assert encoder.count("hello world 가나") > 0 and encoder.count("") == 0
    with pytest.raises(FileNotFoundError):
        transducer.load("no_such")


def first_fit(sizes, capacity):
    room, out = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        k = next((k for k, r in enumerate(room) if r >= sizes[i]), len(room))
        if k == len(room):
            room.append(capacity)
        room[k] -= sizes[i]
        out[i] = k
    return [out[i] for i in range(len(sizes))]


@pytest.mark.parametrize("seed", range(6))
def test_tournament_tree_is_first_fit_decreasing(seed):
    import numpy as np

    drawn = random.Random(seed)
    for _ in range(40):
        capacity = drawn.randint(1, 60)
        sizes = [drawn.randint(1, capacity) for _ in range(drawn.randint(1, 80))]
        assert filling.first_fit_decreasing(np.array(sizes), capacity).tolist() == first_fit(sizes, capacity)


def test_filling(spark):
    texts = ["a b c d e f g h", "one two", "", None, "x " * 40, "three", "three", "가나다 라마바"]
    docs = spark.createDataFrame([(i if i != 5 else None, t) for i, t in enumerate(texts)] + [(1, "one two")], "doc_id bigint, text string")
    runs = spark.createDataFrame([("r", "byte_bpe_50k", 8), ("big", "byte_bpe_50k", 1000), ("w", "word_bpe_49k", 5), ("none", None, 5), ("zero", "byte_bpe_50k", 0)], "run_name string, tokenizer string, sequence_length int")
    rows = filling.filled(docs, runs, group=4).collect()
    assert {r["run_name"] for r in rows} == {"r", "big", "w"}
    capacity = {"r": 8, "big": 1000, "w": 5}
    counts = {n: sum(transducer.load(t).count(x or "") for x in texts + ["one two"]) for n, t in (("r", "byte_bpe_50k"), ("big", "byte_bpe_50k"), ("w", "word_bpe_49k"))}
    for name, most in capacity.items():
        mine = [r for r in rows if r["run_name"] == name]
        assert sum(r["n_tokens"] for r in mine) == counts[name]
        held = {}
        for r in mine:
            held[r["container"]] = held.get(r["container"], 0) + r["n_tokens"]
        assert max(held.values()) <= most
    divided = [r for r in rows if r["run_name"] == "r" and r["doc_id"] == 4]
    spans = sorted((r["start"], r["n_tokens"]) for r in divided)
    assert [s for s, _ in spans] == [8 * i for i in range(len(spans))] and all(n == 8 for _, n in spans[:-1])
    assert sum(r["doc_id"] is None for r in rows if r["run_name"] == "big") == 1
    assert filling.filled(docs.limit(0), runs).count() == 0 and filling.filled(docs, runs.limit(0)).count() == 0
    assert filling.fill_report(filling.filled(docs, runs, group=4), runs).count() == 3


def test_layout_does_not_matter(spark, data):
    from gristmill.session import table

    docs, runs = table(spark, data, "documents"), table(spark, data, "packing")
    docs = docs.unionAll(docs.limit(20))  # repeated rows too
    plain = lambda df: sorted(map(tuple, df.collect()))
    one = plain(filling.filled(docs, runs, group=50))
    assert one == plain(filling.filled(docs.repartition(7, "text").sortWithinPartitions("n_chars"), runs, group=50))


def test_runs_of_one_name_keep_apart(spark):
    docs = spark.createDataFrame([(i, "one two three four") for i in range(9)], "doc_id bigint, text string")
    runs = spark.createDataFrame([("r", "byte_bpe_50k", 8), ("r", "byte_bpe_50k", 9), ("r", "byte_bpe_multi_50k", 8)], "run_name string, tokenizer string, sequence_length int")
    held = {}
    for r in filling.filled(docs, runs).collect():
        held.setdefault(r["container"], []).append(r["n_tokens"])
    assert sum(map(len, held.values())) == 27 and max(map(sum, held.values())) <= 9


def test_long_texts_in_lots(ours, monkeypatch):
    text = "Some words, and 가나다 more  words\n\n" * 400
    whole = ours.ids(text).tolist()
    monkeypatch.setattr(transducer, "LONG", 100)
    assert ours.ids(text).tolist() == whole
