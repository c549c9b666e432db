import random

import numpy as np
import pytest

from gristmill.llm import leakage

DOCUMENTS, SUITE = "doc_id bigint, text string, item_id string", "id string, type string, text string, prompt string, answers array<string>, choices array<string>"


def shared(a, b):
    """Longest common substring of two code arrays."""
    best, last = 0, [0] * (len(b) + 1)
    for x in a:
        now = [0] * (len(b) + 1)
        for j, y in enumerate(b, 1):
            if x == y:
                now[j] = last[j - 1] + 1
                best = max(best, now[j])
        last = now
    return best


def brute(documents, suite):
    out = {}
    for d, t, *_ in documents:
        if not t:
            continue
        c = leakage.codes(t).tolist()
        for i, _, text, prompt, answers, _ in suite:
            if i is None:
                continue
            run = max([shared(c, leakage.codes(p).tolist()) for p in (text, prompt, *(answers or [])) if p] or [0])
            if run >= leakage.RUN:
                out[d, i] = run
    return out


def made(seed):
    drawn = random.Random(seed)
    text = lambda n: "".join(drawn.choice("가나다라마바사 abcdefg, 012.") for _ in range(n))
    base = [text(drawn.randint(20, 700)) for _ in range(8)]
    suite = [("i0", "text", base[0], None, None, None), ("i1", "text", base[0], None, None, None), ("i2", "qa", None, base[1], [base[2], None, "", " "], None), ("i3", "qa", None, base[3][:40], [], None),
             ("i4", "text", base[4] + base[1], None, None, None), (None, "text", base[5], None, None, None), ("i6", "multiple_choice", None, text(100), None, [base[6]]), ("i7", "text", "short", None, None, None), ("i8", None, None, None, None, None)]
    documents = [(0, None, "x"), (1, "", "x"), (2, text(3000), "x"), (None, text(50) + base[0] + text(9), "x")]
    for k in range(40):
        b = drawn.choice(base)
        a = drawn.randint(0, max(0, len(b) - 20))
        cut = b[a : a + drawn.randint(25, 90)]
        if drawn.random() < 0.3:
            cut = cut.upper().replace(" ", "  ")
        documents.append((10 + k, text(drawn.randint(0, 200)) + cut + text(drawn.randint(0, 200)), "x"))
    return documents + documents[-3:], suite


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed, monkeypatch):
    documents, suite = made(seed)
    if seed == 2:
        monkeypatch.setattr(leakage, "BLOCK", 500)  # several blocks
    found = leakage.leaked(spark.createDataFrame(documents, DOCUMENTS), spark.createDataFrame(suite, SUITE))
    got = {(r["doc_id"], r["item_id"]): r["run"] for r in found.where(f"run >= {leakage.RUN}").collect()}
    want = brute(documents, suite)
    assert got.keys() == want.keys()
    assert all(got[k] <= want[k] for k in got)


def test_alignments_stay_in_their_document(spark):
    drawn = random.Random(4)
    passage = "".join(drawn.choice("abcdefghijklmnop") for _ in range(80))
    documents = [(1, passage[:25], ""), (2, passage[26:80], ""), (3, passage[:25] + "zz", "")]
    found = leakage.leaked(spark.createDataFrame(documents, DOCUMENTS).coalesce(1), spark.createDataFrame([("i", "text", passage, None, None, None)], SUITE))
    assert [(r["doc_id"], r["run"]) for r in found.where("run >= 30").collect()] == [(2, 54)]


def test_edited_copies_score(spark):
    passage = "The quick brown fox jumps over the lazy dog while seventeen purple elephants dance under moonlight"
    edited = passage.replace("lazy", "sleepy").replace("purple", "violet")
    df = spark.createDataFrame([(1, "intro " + edited + " outro", "")], DOCUMENTS)
    (row,) = leakage.leaked(df, spark.createDataFrame([("i", "text", passage, None, None, None)], SUITE)).collect()
    assert row["score"] > leakage.MATCH * row["run"] and leakage.WINDOW <= row["run"] < leakage.RUN


def test_forms_and_case(spark):
    passage = "ＡＢＣ résumé 한국어 문장이 여기에 있습니다 그리고 끝이 납니다 ①②③ 그만"
    copy = "abc - résumé... 한국어\n문장이 여기에 있습니다! 그리고 끝이 납니다, 123 그만"
    df = spark.createDataFrame([(1, copy, ""), (2, copy, "")], DOCUMENTS)
    got = leakage.leaked(df, spark.createDataFrame([("i", "qa", None, None, [passage], None)], SUITE)).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 2]


def test_long_text_and_empty_tables(spark):
    drawn = random.Random(9)
    noise = "".join(drawn.choice("abcdefghij ") for _ in range(300_000))
    passage = "".join(drawn.choice("klmnopqrst") for _ in range(30))
    documents = spark.createDataFrame([(1, noise + passage, "")], DOCUMENTS)
    suite = spark.createDataFrame([("i", "text", passage, None, None, None), ("j", "text", passage[:29], None, None, None)], SUITE)
    assert [(r["item_id"], r["run"]) for r in leakage.leaked(documents, suite).collect()] == [("i", 30)]
    assert leakage.leaked(documents.limit(0), suite).count() == 0 and leakage.leaked(documents, suite.limit(0)).count() == 0


def counted(suite, batch=None, drawn=None):
    out = {}
    for w in (leakage.GRAM, leakage.SHORT):
        seeds = leakage.Seeds(suite.all_grams(w))
        out[w] = seeds.hashes, drawn.integers(0, 9, len(seeds.hashes)) if drawn else np.zeros(len(seeds.hashes), dtype=np.int64)
    return out


def test_every_window_has_a_seed():
    drawn = np.random.default_rng(1)
    part = drawn.integers(97, 110, 400).astype(np.uint32)
    suite = leakage.Suite({part.tobytes(): ["i"]})
    suite.choose(counted(suite, drawn=drawn))
    for width, window in ((leakage.GRAM, leakage.WINDOW), (leakage.SHORT, leakage.SHORT_WINDOW)):
        at = sorted(suite.seeds[width].offset.tolist())
        assert len(at) > 50 and all(any(s <= o <= s + window - width for o in at) for s in range(len(part) - window + 1))


def searched(passages, documents):
    parts = {}
    for k, p in enumerate(passages):
        parts.setdefault(leakage.codes(p).tobytes(), []).append(k)
    suite = leakage.Suite(parts)
    suite.choose(counted(suite))
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(documents)), pa.int64()), pa.array(documents)], names=["doc_id", "text"])
    items = [[str(i) for i in x] for x in suite.items]
    suite.items = items
    return {(r["doc_id"], int(r["item_id"])): (r["score"], r["run"]) for b in leakage._search(suite, [batch]) for r in b.to_pylist()}


@pytest.mark.parametrize("words, change, least", [(20, 0.1, 0.98), (20, 0.3, 0.9), (40, 0.4, 0.9), (40, 5, 0.98), (40, 3, 0.95), (60, 0.5, 0.9)])
def test_recall_of_edited_copies(words, change, least):
    """Passages of made-up words of which some, drawn or every so many-th, are replaced by others."""
    drawn = random.Random(7)
    known = ["".join(drawn.choice("etaoinshrdlucmfwypvbgk") for _ in range(drawn.choice([2, 3, 4, 4, 5, 5, 6, 7, 8, 9]))) for _ in range(3000)]
    some = lambda n: [drawn.choice(known) for _ in range(n)]
    passages = [some(words) for _ in range(150)]
    replaced = lambda k: drawn.random() < change if isinstance(change, float) else k % change == change - 1
    documents = [" ".join(some(40) + [drawn.choice(known) if replaced(k) else w for k, w in enumerate(p)] + some(40)) for p in passages]
    got = searched([" ".join(p) for p in passages], documents)
    assert sum((k, k) in got for k in range(150)) >= least * 150 and all(a == b for a, b in got)


def test_long_copy_has_its_whole_score():
    drawn = random.Random(11)
    passage = "".join(drawn.choice("abcdefghijklmnop") for _ in range(3000))
    assert searched([passage], ["zzz" + passage + "zzz"]) == {(0, 0): (6000, 3000)}
    assert searched([passage], ["zzz" + passage[:1500] + "yy" + passage[1500:]])[0, 0] == (6000 + 2 * leakage.GAP, 1500)


def test_runs_of_one_letter_stay_cheap():
    passages = ["k" * 500 + "end of it all", "ab" * 200, "kkkkkkkkkkkkkkkkkkkkkkkkkkkkkk"]
    got = searched(passages, ["k" * 300_000, "ba" * 100_000, "x" * 50_000])
    assert {k: v[1] for k, v in got.items()} == {(0, 0): 500, (0, 2): 30, (1, 1): 400}
