"""Evaluation texts that leaked into training text.

Every part of a test item (text, prompt, each answer) is brought to NFKC, lower case, letters and digits only. Seeds are its
rarest grams, counted over the whole corpus: of the 16-grams in every window of 22 characters the one that the fewest documents contain, so
that any 22 characters in common with a document, and so any 30, contain a seed; and of the 8-grams in every window of 10 likewise,
for edited copies, of which a document must hold two on nearby diagonals. A seed, or two short ones, start a Smith-Waterman
alignment along their diagonal over as much of the part as has seeds, and MARGIN more on both sides; it scores paraphrased and
edited copies and counts the longest run without an edit.

The suite is the stated query set: it is taken in blocks of bounded size, each broadcast to the tasks; the corpus is read twice
a block and nothing of it is shuffled but the counts of suite grams and the rows found.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.session import spread

GRAM, SHORT = 16, 8
#: Fewest consecutive characters in common that make a leak, the fewest that are sure to hold a seed, and a short seed.
RUN, WINDOW, SHORT_WINDOW = 30, 22, 10
#: Two short seeds: how far apart they may lie in the part, and by how much their diagonals may differ.
NEAR, SHIFT = 96, 16
#: Alignment: score of a match, a mismatch and a gap. RUN matches alone reach MIN_SCORE, so no exact passage is lost.
MATCH, MISMATCH, GAP = 2, -1, -2
MIN_SCORE = MATCH * RUN
#: Diagonals to either side of a seed's that an alignment may use, and characters of the part before the first and after the last seed.
BAND, MARGIN = 24, 128
#: Of equal seeds closer than this one stands for all, in a part and in a document; twice this is within the band.
STEP = BAND // 2
#: Normalised characters of suite in one broadcast block, of documents in one pass of the seed search, and cells of one lot of alignments.
BLOCK, CHUNK, CELLS = 4_000_000, 2_000_000, 500_000
FOUND = "doc_id bigint, item_id string, score int, run int"

_P = 0x9E3779B97F4A7C15
_alnum: np.ndarray | None = None


def codes(text: str) -> np.ndarray:
    """Code points of the letters and digits of ``text`` in NFKC and lower case."""
    global _alnum
    if _alnum is None:
        _alnum = np.fromiter((chr(c).isalnum() for c in range(0x110000)), dtype=bool, count=0x110000)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    found = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return found[_alnum[found]]


def gram_hashes(c: np.ndarray) -> dict[int, np.ndarray]:
    """Hashes of the SHORT and of the GRAM code points from each position on; built by doubling, so both are powers of two."""
    h = c.astype(np.uint64)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    width, power, out = 1, _P, {}
    while width < GRAM:
        h = h[:-width] * np.uint64(power) + h[width:] if len(h) > width else h[:0]
        width, power = width * 2, power * power % (1 << 64)
        if width in (SHORT, GRAM):
            mixed = h ^ (h >> np.uint64(29))
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            out[width] = mixed
    return out


class Seeds:
    """Hashes to look for, behind a bit filter."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.filter = np.zeros(1 << 22, dtype=bool)
        self.filter[self.hashes >> np.uint64(42)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in h, index of the seed there)."""
        at = np.flatnonzero(self.filter[h >> np.uint64(42)])
        if not len(at) or not len(self.hashes):
            return at[:0], at[:0]
        k = np.searchsorted(self.hashes, h[at])
        k[k == len(self.hashes)] = 0
        same = self.hashes[k] == h[at]
        return at[same], k[same]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Documents in bounded lots; one that is longer than CHUNK alone makes a lot."""
    ids: list[int] = []
    texts: list[np.ndarray] = []
    size = 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
            c = codes(t.as_py())
            if len(c) < RUN:
                continue
            ids.append(i)
            texts.append(c)
            size += len(c)
            if size >= CHUNK:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _joined(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(all texts with a zero, which is no letter, behind each; where each begins)."""
    starts = np.cumsum([0] + [len(t) + 1 for t in texts])
    joined = np.zeros(starts[-1] + GRAM, dtype=np.uint32)
    for s, t in zip(starts, texts):
        joined[s : s + len(t)] = t
    return joined, starts


class Suite:
    """The parts of one block of test items with their grams, and where the seeds among them stand."""

    def __init__(self, parts: dict[bytes, list[str]]):
        self.items = list(parts.values())
        self.parts = [np.frombuffer(k, dtype=np.uint32) for k in parts]
        self.grams = [gram_hashes(t) for t in self.parts]

    def all_grams(self, width: int) -> np.ndarray:
        return np.concatenate([g[width] for g in self.grams]) if self.grams else np.zeros(0, dtype=np.uint64)

    def choose(self, counted: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        """Keep as seeds the rarest gram of every window; of equally rare ones the smallest hash. ``counted``: for each width the
        sorted hashes and how many documents have each."""
        self.seeds = {w: self._seeds(w, window, *counted[w]) for w, window in ((GRAM, WINDOW), (SHORT, SHORT_WINDOW))}
        self.grams = []

    def _seeds(self, width: int, window: int, known: np.ndarray, documents: np.ndarray) -> Postings:
        hashes, parts, offsets = [], [], []
        for k, grams in enumerate(self.grams):
            g = grams[width]
            rank = documents[np.searchsorted(known, g)]
            place = np.empty(len(g), dtype=np.int64)
            place[np.lexsort((g, rank))] = np.arange(len(g))
            windows = np.lib.stride_tricks.sliding_window_view(place, min(len(g), window - width + 1))
            chosen = np.unique(np.arange(len(windows)) + windows.argmin(axis=1))
            order = np.lexsort((chosen, g[chosen]))
            chosen = np.sort(chosen[order][_first_of_each(g[chosen][order], chosen[order] // STEP)])
            hashes.append(g[chosen])
            parts.append(np.full(len(chosen), k))
            offsets.append(chosen)
        return Postings(*[np.concatenate(x) if x else np.zeros(0, dtype=t) for x, t in ((hashes, np.uint64), (parts, np.int64), (offsets, np.int64))])


def _first_of_each(*keys: np.ndarray) -> np.ndarray:
    """Whether each row of sorted keys differs from the row before."""
    out = np.ones(len(keys[0]), dtype=bool)
    if len(out):
        out[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return out


class Postings:
    """Seeds and the places in parts that have them."""

    def __init__(self, hashes: np.ndarray, parts: np.ndarray, offsets: np.ndarray):
        self.seeds = Seeds(hashes)
        where = np.searchsorted(self.seeds.hashes, hashes)
        order = np.argsort(where, kind="stable")
        self.first = np.searchsorted(where[order], np.arange(len(self.seeds.hashes) + 1))
        self.part, self.offset = parts[order], offsets[order]

    def find(self, h: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in h, part, offset in the part) for each place of each seed; of a seed that stands several times within STEP characters of a
        document, as in runs of one letter, the first will do: the others lie in its band."""
        at, seed = self.seeds.find(h)
        document = np.searchsorted(starts, at, side="right")
        order = np.lexsort((at, seed, document))
        first = _first_of_each(document[order], seed[order], at[order] // STEP)
        at, seed = at[order][first], seed[order][first]
        times = self.first[seed + 1] - self.first[seed]
        posting = np.repeat(self.first[seed], times) + (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times))
        return np.repeat(at, times), self.part[posting], self.offset[posting]


def align(
    parts: list[np.ndarray], text: np.ndarray, part_of: np.ndarray, low: np.ndarray, high: np.ndarray, diagonal: np.ndarray, begin: np.ndarray, end: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman along a band around each (part from ``low`` to before ``high``, diagonal = place in text - place in part): (scores,
    longest runs). An alignment stays within its document, from ``begin`` to before ``end`` of the joined text.

    All alignments go row by row together. A band's columns are diagonals: the cell above lies one column to the right, the cell
    diagonally before lies in the same column, and gaps along the row are a running maximum.
    """
    width = 2 * BAND + 1
    n, longest = len(part_of), int((high - low).max())
    own = np.zeros((n, longest), dtype=np.uint32)
    for i, (p, a, b) in enumerate(zip(part_of.tolist(), low.tolist(), high.tolist())):
        own[i, : b - a] = parts[p][a:b]
    reach = (diagonal + low)[:, None] - BAND + np.arange(width)[None, :]
    slope = (-GAP * np.arange(width)).astype(np.int32)
    score = np.zeros((n, width), dtype=np.int32)
    run = np.zeros((n, width), dtype=np.int32)
    best, longest_run = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int32)
    begin, end, last = begin[:, None], end[:, None], len(text) - 1
    for r in range(longest):
        place = reach + r
        there = text[np.clip(place, 0, last)]
        same = (there == own[:, r, None]) & (place >= begin) & (place < end) & (there > 0)
        run = np.where(same, run + 1, 0)
        step = score + np.where(same, MATCH, MISMATCH)
        step[:, :-1] = np.maximum(step[:, :-1], score[:, 1:] + GAP)
        np.maximum(step, 0, out=step)
        score = np.maximum.accumulate(step + slope, axis=1) - slope
        np.maximum(best, score.max(axis=1), out=best)
        np.maximum(longest_run, run.max(axis=1), out=longest_run)
    return best, longest_run


def _hits(suite: Suite, joined: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, part, diagonal, offset) of what may start an alignment, in this order: long seeds, and short ones with another nearby."""
    found = []
    for width, h in gram_hashes(joined).items():
        place, part, offset = suite.seeds[width].find(h, starts)
        document, diagonal = np.searchsorted(starts, place, side="right") - 1, place - offset
        order = np.lexsort((offset, diagonal, part, document))
        hit = np.stack([document[order], part[order], diagonal[order], offset[order]])
        if width == SHORT and hit.shape[1]:
            paired = np.zeros(hit.shape[1], dtype=bool)
            for lag in range(1, 9):
                one, other = hit[:, :-lag], hit[:, lag:]
                apart = np.abs(one[3] - other[3])
                near = (one[0] == other[0]) & (one[1] == other[1]) & (other[2] - one[2] <= SHIFT) & (apart >= SHORT) & (apart <= NEAR)
                paired[:-lag] |= near
                paired[lag:] |= near
            hit = hit[:, paired]
        found.append(hit)
    both = np.concatenate(found, axis=1)
    return tuple(both[:, np.lexsort((both[2], both[1], both[0]))])


def _bands(document: np.ndarray, part: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
    """Where, in sorted hits, a new band of diagonals begins: at another document or part, or more than BAND beyond the band's first one."""
    begins, last = [], None
    for i, key in enumerate(zip(document.tolist(), part.tolist(), diagonal.tolist())):
        if last is None or key[:2] != last[:2] or key[2] - last[2] > BAND:
            begins.append(i)
            last = key
    return np.array(begins, dtype=np.int64)


def _search(suite: Suite, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, texts in _chunks(batches):
        joined, starts = _joined(texts)
        document, part, diagonal, offset = _hits(suite, joined, starts)
        if not len(document):
            continue
        bands = _bands(document, part, diagonal)
        sizes = np.array([len(p) for p in suite.parts])
        low, high = np.maximum.reduceat(-offset, bands), np.maximum.reduceat(offset, bands)
        document, part, diagonal = document[bands], part[bands], diagonal[bands]
        low, high = np.maximum(0, -low - MARGIN), np.minimum(sizes[part], high + GRAM + MARGIN)
        rows = high - low
        order = np.argsort(rows, kind="stable")
        # Lots of alignments of like length, of at most CELLS letters, or of one.
        lots, lot = [], []
        for i in order.tolist():
            if lot and (len(lot) + 1) * rows[i] > CELLS:
                lots.append(np.array(lot))
                lot = []
            lot.append(i)
        lots.append(np.array(lot))
        found: dict[tuple[int, str], list[int]] = {}
        for lot in lots:
            d, p = document[lot], part[lot]
            score, run = align(suite.parts, joined, p, low[lot], high[lot], diagonal[lot], starts[d], starts[d + 1] - 1)
            for d, p, s, r in zip(d.tolist(), p.tolist(), score.tolist(), run.tolist()):
                if s >= MIN_SCORE:
                    for item in suite.items[p]:
                        kept = found.setdefault((d, item), [0, 0])
                        kept[:] = max(kept[0], s), max(kept[1], r)
        if found:
            columns = zip(*[(ids[d], i, s, r) for (d, i), (s, r) in found.items()])
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.int32(), pa.int32()))],
                names=["doc_id", "item_id", "score", "run"],
            )


def _count(grams: dict[int, Seeds], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals = {w: np.zeros(len(s.hashes), dtype=np.int64) for w, s in grams.items()}
    for _, texts in _chunks(batches):
        joined, starts = _joined(texts)
        for w, h in gram_hashes(joined).items():
            at, k = grams[w].find(h)
            document, n = np.searchsorted(starts, at, side="right") - 1, max(1, len(totals[w]))
            totals[w] += np.bincount(np.unique(document * n + k) % n, minlength=len(totals[w]))
    for w, total in totals.items():
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), w), pa.int32()), pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["width", "gram", "n"])


def _blocks(suite: DataFrame) -> Iterator[dict[bytes, list[str]]]:
    """{normalised part: ids of the items that have it}, in blocks of BLOCK characters."""
    parts: dict[bytes, list[str]] = {}
    size = 0
    for row in suite.select("id", "text", "prompt", "answers").toLocalIterator():
        if row["id"] is None:
            continue
        for text in {t for t in (row["text"], row["prompt"], *(row["answers"] or [])) if t}:
            c = codes(text)
            if len(c) >= RUN:
                ids = parts.setdefault(c.tobytes(), [])
                if row["id"] not in ids:
                    ids.append(row["id"])
                size += len(c)
        if size >= BLOCK:
            yield parts
            parts, size = {}, 0
    if parts:
        yield parts


def leaked(documents: DataFrame, suite: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, run): one row per document and test item with an alignment of at least MIN_SCORE.

    score is that of the best alignment of one part of the item within a band of diagonals (an insertion of more than BAND characters
    begins another), run the longest stretch of it without an edit. Null, empty and short
    texts (under RUN letters and digits) give no row; null ids of documents are kept as null, items without an id are left out;
    an item given twice under one id gives one row; copies of a document each give their own. Texts of any length are searched
    whole. Empty tables give an empty result.
    """
    spark = documents.sparkSession
    texts = spread(documents.select("doc_id", "text").where("text is not null and length(text) >= 1"))
    out = None
    for parts in _blocks(suite):
        block = Suite(parts)
        grams = {w: Seeds(block.all_grams(w)) for w in (GRAM, SHORT)}
        counts = texts.mapInArrow(lambda b, g=grams: _count(g, b), "width int, gram bigint, n bigint").groupBy("width", "gram").agg(F.sum("n").alias("n"))
        found = counts.toArrow()  # at most two rows a character of the block, as arrays
        width, gram, n = (found.column(c).to_numpy() for c in ("width", "gram", "n"))
        counted = {}
        for w, s in grams.items():
            documents_with = np.zeros(len(s.hashes), dtype=np.int64)
            documents_with[gram[width == w]] = n[width == w]
            counted[w] = s.hashes, documents_with
        block.choose(counted)
        rows = texts.mapInArrow(lambda b, s=block: _search(s, b), FOUND)
        out = rows if out is None else out.unionAll(rows)
    if out is None:
        return spark.createDataFrame([], FOUND)
    # An item may have parts in two blocks, and a document id may be given twice.
    return out.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.max("run").alias("run"))
