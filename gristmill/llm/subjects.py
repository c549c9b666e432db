"""Subject areas of documents from subject-specific n-gram language models.

For every subject an interpolated bigram model of word stems (bigram, backed by unigram, backed by the same floor for every stem) is
trained on rated documents, beside two background models: one of sentences about nothing in particular and one of passing mentions and
comparisons. Raters name subjects of documents, not of sentences, and err; so training is expectation maximisation: sentences are
shared out between the subjects of their document's raters, with a small chance for every other one, and the backgrounds.

A sentence goes to the model under which its cross-entropy is lowest, weighed with the document's make-up (models are compared on one and
the same sentence, so whether per token or in sum makes no difference to the order), if its responsibility, backgrounds included, is at
least SURE. A document is about the subjects with at least a share of its sentences that are about any; the share is
calibrated on the rated documents.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.session import spread

#: Rated documents that the models are trained on: those with the smallest hashes of their ids.
RATED = 6_000
#: And characters that they have in all; a document that would exceed it is left out of the training, never of the result.
RATED_CHARS = 40_000_000
#: A stem in fewer of them, or a bigram that occurs less often, is unknown.
LEAST = 3
ROUNDS = 8
#: Occurrences that every stem is taken to have in every model, so that a rare one (a place, a person) speaks for none; and the
#: strength of the unigram behind a bigram, in tokens.
UNIGRAM_FLOOR, BIGRAM_BACK = 1.0, 30.0
#: The least responsibility of a subject for a sentence that is about it.
SURE = 0.99
#: Make-up of a document before it is seen: subject named by a rater, other subject, background, mentions.
NAMED, OTHER, PLAIN, MENTION = 3.0, 0.05, 1.5, 0.25
#: The share from which a document is about a subject, where rated documents are too few to calibrate it.
SHARE = 0.2
FEWEST = 50
#: Tokens of texts that one pass scores.
LOT = 1_000_000

_MARKUP = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|</?[a-z][^<>]*>")
_TOKEN = re.compile(r"[가-힣]+|[A-Za-z]+|[0-9]+|\n+|[.!?。](?=[\s\"')\]]|$)|[^\s\w.!?。,]")
_ENDS = "에서는 에게서 으로는 에서 으로 까지 부터 보다 에는 에게 처럼 이나 이다 은 는 이 가 을 를 의 에 와 과 로 만 도 식 다".split()
_STOP = -1


def stem(token: str) -> str:
    """Lower case, numbers as one, Korean words without their particle."""
    if token[0].isdigit():
        return "#"
    if "가" <= token[0] <= "힣":
        for end in _ENDS:
            if token.endswith(end) and len(token) - len(end) >= 2:
                return token[: -len(end)]
        return token
    return token.lower()


def folded(text: str) -> str:
    """NFKC without markup."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _MARKUP.sub("\n", text) if "<" in text else text


class Vocabulary:
    """Stems and their numbers; 0 is every unknown one."""

    def __init__(self, known: dict[str, int]):
        self.known = known
        self.memory: dict[str, int] = {}

    def numbers(self, text: str) -> list[int]:
        memory, out = self.memory, []
        for t in _TOKEN.findall(text):
            n = memory.get(t)
            if n is None:
                n = self._new(t)
            out.append(n)
        return out

    def _new(self, token: str) -> int:
        n = _STOP if token[0] in "\n.!?。" else self.known.get(stem(token), 0)
        if len(self.memory) > 500_000:
            self.memory.clear()
        self.memory[token] = n
        return n

    def __getstate__(self):
        return {"known": self.known, "memory": {}}


def sentences(numbers: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, token before each or 0, sentence of each, document of each sentence) without empty sentences."""
    flat = np.array([n for x in numbers for n in (*x, _STOP)], dtype=np.int64)
    document = np.repeat(np.arange(len(numbers)), [len(x) + 1 for x in numbers])
    stop = flat == _STOP
    before = np.where(np.concatenate([[True], stop[:-1]]), 0, np.concatenate([[0], flat[:-1]])) if len(flat) else flat
    sentence = np.cumsum(stop) - stop
    tokens, before, sentence, document = flat[~stop], before[~stop], sentence[~stop], document[~stop]
    if not len(tokens):
        return tokens, before, sentence, document
    first = np.concatenate([[True], sentence[1:] != sentence[:-1]])
    return tokens, before, np.cumsum(first) - 1, document[first]


class Models:
    """Log probabilities of all models side by side: one row a stem or bigram, one column a model; the last two are backgrounds."""

    def __init__(self, vocabulary: Vocabulary, subjects: list[str], bigrams: np.ndarray):
        self.vocabulary, self.subjects, self.bigrams = vocabulary, subjects, bigrams
        self.size = len(vocabulary.known) + 1
        self.share = SHARE

    def fit(self, tokens: np.ndarray, before: np.ndarray, weight: np.ndarray) -> None:
        """Estimate from tokens, the one before each, and the weight of each token (row) in each model (column)."""
        models = weight.shape[1]
        one = np.zeros((self.size, models))
        for m in range(models):
            one[:, m] = np.bincount(tokens, weight[:, m], minlength=self.size)
        unigram = (one + UNIGRAM_FLOOR) / (one.sum(axis=0) + UNIGRAM_FLOOR * self.size)
        pair, known = self._pairs(tokens, before)
        two, left = np.zeros((len(self.bigrams), models)), np.zeros((self.size, models))
        for m in range(models):
            two[:, m] = np.bincount(pair[known], weight[known, m], minlength=len(self.bigrams))
            left[:, m] = np.bincount(before, weight[:, m], minlength=self.size)
        first, second = self.bigrams // self.size, self.bigrams % self.size
        backed = BIGRAM_BACK / (left + BIGRAM_BACK)
        self.unigram = np.log(unigram).astype(np.float32)
        self.backing = np.log(backed).astype(np.float32)
        self.bigram = np.log(two / (left[first] + BIGRAM_BACK) + backed[first] * unigram[second]).astype(np.float32)

    def _pairs(self, tokens: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = before * self.size + tokens
        at = np.searchsorted(self.bigrams, key)
        at[at == len(self.bigrams)] = 0
        return at, (self.bigrams[at] == key) if len(self.bigrams) else np.zeros(len(key), dtype=bool)

    def score(self, tokens: np.ndarray, before: np.ndarray, sentence: np.ndarray) -> np.ndarray:
        """Log probability of each sentence (row) under each model (column)."""
        pair, known = self._pairs(tokens, before)
        per_token = self.unigram[tokens] + self.backing[before]
        per_token[known] = self.bigram[pair[known]]
        starts = np.flatnonzero(np.concatenate([[True], sentence[1:] != sentence[:-1]]))
        return np.add.reduceat(per_token, starts, axis=0)

    def made_of(self, scores: np.ndarray, document: np.ndarray, documents: int, prior: np.ndarray, rounds: int = 4) -> np.ndarray:
        """Responsibility of each model for each sentence, with the make-up of each document found along the way."""
        makeup = np.broadcast_to(prior, (documents, scores.shape[1])).copy()
        out = scores
        for _ in range(rounds):
            logs = scores + np.log(makeup / makeup.sum(axis=1, keepdims=True)).astype(np.float32)[document]
            logs -= logs.max(axis=1, keepdims=True)
            out = np.exp(logs)
            out /= out.sum(axis=1, keepdims=True)
            for m in range(scores.shape[1]):
                makeup[:, m] = np.broadcast_to(prior, makeup.shape)[:, m] + np.bincount(document, out[:, m], minlength=documents)
        return out

    def prior(self, named: list[set[str]] | None = None) -> np.ndarray:
        k = len(self.subjects)
        if named is None:
            return np.array([[0.3] * k + [PLAIN, MENTION]])
        rows = np.full((len(named), k + 2), OTHER)
        rows[:, k:] = PLAIN, MENTION
        for d, names in enumerate(named):
            for s in names:
                rows[d, self.subjects.index(s)] = NAMED
        return rows

    def shares(self, texts: list[str]) -> np.ndarray:
        """Of each text (row), the share of each subject (column) in the sentences about any; 0 if there are none."""
        k = len(self.subjects)
        out = np.zeros((len(texts), k))
        tokens, before, sentence, document = sentences([self.vocabulary.numbers(folded(t)) for t in texts])
        if len(tokens):
            scores = self.score(tokens, before, sentence)
            made = self.made_of(scores, document, len(texts), self.prior())
            chosen = made.argmax(axis=1)
            about = (chosen < k) & (made.max(axis=1) >= SURE)
            np.add.at(out, (document[about], chosen[about]), 1.0)
        total = out.sum(axis=1, keepdims=True)
        return np.divide(out, total, out=np.zeros_like(out), where=total > 0)


def train(texts: list[str], named: list[set[str]], subjects: list[str]) -> Models:
    """Models from texts and the subjects that raters named for each."""
    stems, lists = Counter(), []
    for text in texts:
        found = [("\n" if t[0] in "\n.!?。" else stem(t)) for t in _TOKEN.findall(folded(text))]
        stems.update(set(found))
        lists.append(found)
    stems.pop("\n", None)
    known = {s: i for i, s in enumerate(sorted(s for s, n in stems.items() if n >= LEAST), 1)}
    vocabulary = Vocabulary(known)
    tokens, before, sentence, document = sentences([[_STOP if s == "\n" else known.get(s, 0) for s in x] for x in lists])
    size = len(known) + 1
    keys, counts = np.unique(before * size + tokens, return_counts=True)
    models = Models(vocabulary, subjects, keys[counts >= LEAST])
    k = len(subjects)
    # To begin with, sentences belong to the named subjects and the plain background alike; the mentions begin as a mixture.
    weight = np.zeros((len(document), k + 2))
    for d, names in zip(range(len(document)), (named[d] for d in document)):
        for s in names:
            weight[d, subjects.index(s)] = 0.6 / len(names)
    weight[:, k], weight[:, k + 1] = 0.35, 0.05
    prior = models.prior(named)
    for r in range(ROUNDS):
        if not len(tokens):
            models.fit(tokens, before, weight[sentence])
            return models
        models.fit(tokens, before, weight[sentence])
        scores = models.score(tokens, before, sentence)
        weight = models.made_of(scores, document, len(texts), prior)
        if r in (1, 2):
            # What speaks of a subject that nobody named and that the document is not made of is a mention.
            best, makeup = scores[:, :k].argmax(axis=1), np.zeros((len(texts), k))
            np.add.at(makeup, document, weight[:, :k])
            total = np.maximum(makeup.sum(axis=1), 1)
            stray = (prior[document, best] < NAMED) & (makeup[document, best] < 0.15 * total[document]) & (scores[np.arange(len(best)), best] > scores[:, k])
            weight[stray] = 0
            weight[stray, k + 1] = 1
    models.fit(tokens, before, weight[sentence])
    if len(texts) >= FEWEST:
        shares = models.shares(texts)
        truth = models.prior(named)[:, :k] == NAMED
        grid = np.arange(0.1, 0.36, 0.01)
        f1 = [2 * (truth & (shares >= g)).sum() / max(1, truth.sum() + (shares >= g).sum()) for g in grid]
        best = np.flatnonzero(np.array(f1) >= max(f1) - 1e-3)
        models.share = float(grid[best[np.abs(grid[best] - SHARE).argmin()]])
    return models


def folded_subject(column) -> F.Column:
    return F.lower(F.regexp_replace(column, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))


def fitted(documents: DataFrame, labels: DataFrame, areas: DataFrame, rated: int = RATED, chars: int = RATED_CHARS) -> Models:
    """Models trained on at most ``rated`` labelled documents of together at most ``chars`` characters, which come to the driver; the other tables
    stay where they are."""
    spark = documents.sparkSession
    subjects = sorted({r[0].strip().lower(): r[0] for r in areas.select("subject").where("subject is not null").distinct().toLocalIterator()}.items())
    names = [s for s, _ in subjects]
    votes = labels.select("doc_id", folded_subject(F.col("subject")).alias("subject")).where(F.col("subject").isin(names) & F.col("doc_id").isNotNull())
    chosen = votes.groupBy("doc_id").agg(F.sort_array(F.collect_set("subject")).alias("named")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rated)
    kept = {r["doc_id"]: set(r["named"]) for r in chosen.toLocalIterator()}
    if not kept:
        return train([], [], names)
    of = lambda wanted: F.broadcast(spark.createDataFrame([(i,) for i in wanted], "doc_id bigint"))  # noqa: E731  (at most `rated` numbers)
    texts = documents.select("doc_id", "text").where("text is not null")
    sizes = texts.join(of(kept), "doc_id", "left_semi").groupBy("doc_id").agg(F.sum(F.length("text")).alias("n"))
    long = {r[0]: r[1] for r in sizes.toLocalIterator()}
    held, total = [], 0
    for i in kept:
        if total + long.get(i, 0) <= chars:
            held.append(i)
            total += long.get(i, 0)
    rows = sorted(texts.join(of(held), "doc_id", "left_semi").collect()) if held else []
    models = train([r[1] for r in rows], [kept[r[0]] for r in rows], names)
    models.spelled = [s for _, s in subjects]
    return models


def _classify(models: Models, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def done(ids: list, texts: list[str]) -> pa.RecordBatch:
        shares = models.shares(texts)
        d, s = np.nonzero(shares >= models.share)
        return pa.RecordBatch.from_arrays(
            [pa.array([ids[i] for i in d], pa.int64()), pa.array([models.spelled[i] for i in s], pa.string()), pa.array(shares[d, s], pa.float64())],
            names=["doc_id", "subject", "share"],
        )

    ids, texts, size = [], [], 0
    for batch in batches:
        for i, cell in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = cell.as_py()
            ids.append(i)
            texts.append(text)
            size += len(text)
            if size >= LOT:
                yield done(ids, texts)
                ids, texts, size = [], [], 0
    if ids:
        yield done(ids, texts)


def subjects_of(documents: DataFrame, labels: DataFrame, areas: DataFrame, rated: int = RATED) -> DataFrame:
    """(doc_id, subject, share): one row per document and subject that it is about; share is of its sentences about any subject.

    Null and empty texts, menus and filler have no row. Labels with a null or unknown subject are ignored, spelling aside; with no
    usable label there is no model and no row. Repeated documents give repeated rows; texts are read whole.
    """
    models = fitted(documents, labels, areas, rated)
    schema = "doc_id bigint, subject string, share double"
    if not hasattr(models, "spelled"):
        return documents.sparkSession.createDataFrame([], schema)
    texts = spread(documents.select("doc_id", "text").where("text is not null and length(text) > 0"))
    return texts.mapInArrow(lambda b: _classify(models, b), schema)
