"""A semi-Markov conditional random field over candidate segments.

A window is cut into segments: entities, which are candidate spans with their features, and the gaps between them, which score
nothing. Two entities in succession add a feature for their types and how close they stand. The best segmentation, and in
training the expectation over all of them, comes from dynamic programming over the candidates in order of their ends.
"""

from __future__ import annotations

import math
import random
from bisect import bisect_left, bisect_right
from collections import defaultdict

from gristmill.llm.pii_spans import Span

#: Entities further apart than this share no feature.
NEAR = 24


def _pair(first: Span, second: Span) -> str:
    gap = second.start - first.end
    return f"{first.type}>{second.type}|{'touch' if gap < 4 else 'near'}"


class SemiMarkov:
    def __init__(self, weights: dict[str, float] | None = None):
        self.weights = weights or {}

    def score(self, span: Span) -> float:
        get = self.weights.get
        return sum([get(f, 0.0) for f in span.features])

    def best(self, spans: list[Span]) -> list[Span]:
        """The segmentation of highest score; of equal ones the one with fewer entities."""
        if not spans:
            return []
        spans = sorted(spans, key=lambda s: (s.end, s.start, s.type))
        get, ends = self.weights.get, [s.end for s in spans]
        value, back, leader = [], [], []  # leader[i]: the best of the candidates 0 .. i
        for s in spans:
            base, best, came = self.score(s), 0.0, -1
            far, near = bisect_left(ends, s.start - NEAR), bisect_right(ends, s.start)
            if far and value[leader[far - 1]] > 0:
                best, came = value[leader[far - 1]], leader[far - 1]
            for i in range(far, near):
                v = value[i] + get(_pair(spans[i], s), 0.0)
                if v > best:
                    best, came = v, i
            value.append(base + best)
            back.append(came)
            j = len(value) - 1
            leader.append(j if not leader or value[j] > value[leader[-1]] else leader[-1])
        j = max(range(len(spans)), key=lambda j: value[j])
        if value[j] <= 0:
            return []
        out = []
        while j >= 0:
            out.append(spans[j])
            j = back[j]
        return out[::-1]

    def _gradient(self, spans: list[Span], gold: set[tuple[int, int, str]]) -> dict[str, float]:
        """Observed minus expected features of one window."""
        spans = sorted(spans, key=lambda s: (s.end, s.start, s.type))
        n, get = len(spans), self.weights.get
        base = [self.score(s) for s in spans]
        before: list[list[tuple[int, float, str | None]]] = []
        for j, s in enumerate(spans):
            links = []
            for i in range(j):
                if spans[i].end <= s.start:
                    f = _pair(spans[i], s) if s.start - spans[i].end <= NEAR else None
                    links.append((i, get(f, 0.0) if f else 0.0, f))
            before.append(links)
        forward = []
        for j in range(n):
            forward.append(base[j] + _log_sum([0.0] + [forward[i] + w for i, w, _ in before[j]]))
        total = _log_sum([0.0, *forward])
        backward = [0.0] * n
        onward: list[list[float]] = [[0.0] for _ in range(n)]
        for j in range(n - 1, -1, -1):
            backward[j] = _log_sum(onward[j])
            for i, w, _ in before[j]:
                onward[i].append(w + base[j] + backward[j])
        out: dict[str, float] = defaultdict(float)
        last = None
        for j, s in enumerate(spans):
            p = math.exp(min(0.0, forward[j] + backward[j] - total))
            y = (s.start, s.end, s.type) in gold
            if abs(y - p) > 1e-4:
                for f in s.features:
                    out[f] += y - p
            for i, w, f in before[j]:
                if f:
                    out[f] -= math.exp(min(0.0, forward[i] + w + base[j] + backward[j] - total))
            if y:
                if last is not None and last.end <= s.start and s.start - last.end <= NEAR:
                    out[_pair(last, s)] += 1
                last = s
        return out

    def fit(self, examples: list[tuple[list[Span], set[tuple[int, int, str]]]], epochs: int = 8, rate: float = 0.3, decay: float = 2e-4, seed: int = 7) -> SemiMarkov:
        """Stochastic gradient with a step size of its own for each feature (Adagrad), and a little weight decay."""
        drawn, seen = random.Random(seed), defaultdict(float)
        order = [e for e in examples if e[0]]
        for _ in range(epochs):
            drawn.shuffle(order)
            for spans, gold in order:
                for f, g in self._gradient(spans, gold).items():
                    w = self.weights.get(f, 0.0)
                    g -= decay * w
                    seen[f] += g * g
                    self.weights[f] = w + rate * g / (1e-6 + math.sqrt(seen[f]))
        return self


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum([math.exp(v - top) for v in values]))
