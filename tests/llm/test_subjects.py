import random

import numpy as np
import pytest

from gristmill.llm import subjects

WORDS = {
    "law": "court ruling statute appeal verdict judge plaintiff 판결 재판부 조항".split(),
    "sport": "match referee goal league striker trophy 경기 심판 득점 감독".split(),
    "software": "compiler buffer thread kernel cache parser 버퍼 커널 캐시 함수".split(),
}
FILLER = "The {a} note is given below.|This remark was rewritten in 19{n}.|Readers may skip this {a}.|이 {a} 글은 간단히 정리한 것이다.".split("|")


def text(drawn, parts, sentences=12):
    out = []
    for _ in range(sentences):
        r = drawn.random()
        if r < 0.3:
            out.append(drawn.choice(FILLER).format(a=drawn.choice(["short", "long", "old"]), n=drawn.randint(10, 99)))
            continue
        w = WORDS[drawn.choice(parts)]
        out.append(f"In 19{drawn.randint(10, 99)}, the {drawn.choice(w)} near place{drawn.randint(0, 99)} changed the {drawn.choice(w)} and {drawn.choice(w)}.")
    return " ".join(out)


def made(n, seed):
    drawn = random.Random(seed)
    names = list(WORDS)
    rows = []
    for _ in range(n):
        parts = drawn.sample(names, drawn.choice([1, 1, 2]))
        rows.append((text(drawn, parts), set(parts)))
    return rows


def test_learns_from_noisy_raters():
    drawn = random.Random(1)
    rows = made(300, 2)
    noisy = [{drawn.choice(list(WORDS))} if drawn.random() < 0.1 else {drawn.choice(sorted(s))} for _, s in rows]
    models = subjects.train([t for t, _ in rows], noisy, sorted(WORDS))
    held = made(200, 3)
    shares = models.shares([t for t, _ in held])
    got = [{models.subjects[k] for k in np.flatnonzero(s >= models.share)} for s in shares]
    assert sum(g == s for g, (_, s) in zip(got, held)) / len(held) > 0.9
    assert 0.1 <= models.share <= 0.35


def test_probabilities_sum_to_one():
    rows = made(60, 4)
    models = subjects.train([t for t, _ in rows], [s for _, s in rows], sorted(WORDS))
    assert np.exp(models.unigram).sum(axis=0) == pytest.approx(np.ones(5), rel=1e-3)
    first = int(models.bigrams[len(models.bigrams) // 2] // models.size)
    every = models.unigram + models.backing[first]
    row = np.exp(every)
    for k, pair in enumerate(models.bigrams):
        if pair // models.size == first:
            row[pair % models.size] = np.exp(models.bigram[k])
    assert row.sum(axis=0) == pytest.approx(np.ones(5), rel=1e-2)


def test_markup_and_empty_texts():
    rows = made(80, 5)
    models = subjects.train([t for t, _ in rows], [s for _, s in rows], sorted(WORDS))
    shares = models.shares(["", "\n\n", "◀ 이전 글   목록   다음 글 ▶", "<script>cache cache cache kernel buffer</script><p>In 1950, the court near place1 changed the ruling and verdict.</p>"])
    assert (shares[:3] == 0).all() and shares[3][models.subjects.index("law")] == 1


def test_tables(spark):
    rows = made(80, 6)
    documents = [(i, t, "x") for i, (t, _) in enumerate(rows)] + [(100, None, "x"), (101, "", "x"), (None, rows[0][0], "x"), (102, rows[0][0] * 200, "x"), (0, rows[0][0], "x")]
    labels = [(i, s.upper() + " " if i % 2 else s) for i, (_, parts) in enumerate(rows) for s in parts] + [(1, None), (None, "law"), (5, "cooking"), (999, "law"), (1, "law"), (1, "law")]
    areas = spark.createDataFrame([(s, s) for s in WORDS] + [(None, "x")], "subject string, title_en string")
    frames = spark.createDataFrame(documents, "doc_id bigint, text string, share string"), spark.createDataFrame(labels, "doc_id bigint, subject string")
    got = subjects.subjects_of(*frames, areas)
    assert got.columns == ["doc_id", "subject", "share"]
    by = {}
    for r in got.collect():
        by.setdefault(r["doc_id"], set()).add(r["subject"])
    assert 100 not in by and 101 not in by and by[None] == by[0] == by[102]
    assert sum(by.get(i) == s for i, (_, s) in enumerate(rows)) > 70
    none = [f.limit(0) for f in frames]
    assert subjects.subjects_of(none[0], frames[1], areas).count() == 0
    assert subjects.subjects_of(frames[0], none[1], areas).count() == 0
    assert subjects.subjects_of(frames[0], frames[1], areas.limit(0)).count() == 0


def test_training_is_bounded_in_characters(spark, data):
    from gristmill.session import table

    docs, labels, areas = (table(spark, data, n) for n in ("documents", "subject_labels", "subject_areas"))
    all_of, none = subjects.fitted(docs, labels, areas), subjects.fitted(docs, labels, areas, chars=0)
    few = subjects.fitted(docs, labels, areas, chars=8000)
    assert none.size == 1 and len(none.bigrams) == 0 and none.size <= few.size <= all_of.size and all_of.size > 1
    assert none.spelled == all_of.spelled
