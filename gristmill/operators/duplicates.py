"""Near duplicates by exact Jaccard similarity of shingles, and the groups they make.

Candidates come from banded MinHash, whose shuffle is a few hundred bytes a text whatever its length: enough bands that a pair at the
threshold is missed with a chance below MISS, less than the reference's own eight bands allow. Every candidate is then verified on
its shingles. ``prefix_pairs`` is the lossless way beside it. It began as the prefix filter (AllPairs, PPJoin), whose candidates grow
with the square of the corpus wherever texts share phrases; now it is the pigeonhole over ranges of the hash space (PartEnum), with the
pigeonring's second look at the ranges that follow: no pair is missed either, and hardly any other pair is listed.
"""

from __future__ import annotations

import bisect
import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions import text as X
from gristmill.operators.components import least_labels
from gristmill.plans.shared import Scratch
from gristmill.session import spread

#: Chance to miss a pair whose similarity is just the threshold, and the most bands worth their shuffle.
MISS, MOST_BANDS = 1e-7, 30


def banding(threshold: float) -> tuple[int, int]:
    """(bands, rows of a band): the most selective bands that keep to MISS."""
    for rows in range(8, 0, -1):
        hit = threshold**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(MISS) / math.log(1 - hit))
        if bands <= MOST_BANDS or rows == 1:
            return bands, rows
    raise AssertionError


def shingle_codes(text: str) -> np.ndarray:
    """A 64-bit number for every shingle as it comes, not yet mixed."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    width = min(X.SHINGLE, len(codes))
    base = np.zeros(len(codes) - width + 1, dtype=np.uint64)
    for i in range(width):
        base = base * np.uint64(0x9E3779B97F4A7C15) + codes[i : len(codes) - width + 1 + i]
    return base


def signature(text: str, hashes: int) -> tuple[int, np.ndarray]:
    """(distinct shingles, minimum of each of ``hashes`` 32-bit hash functions over them)."""
    base = np.unique(shingle_codes(text))
    base ^= base >> np.uint64(29)
    base *= np.uint64(0xBF58476D1CE4E5B9)
    mixed = (base >> np.uint64(32)).astype(np.uint32)
    factors = _factors(hashes)
    minima = np.full(hashes, np.iinfo(np.uint32).max, dtype=np.uint32)
    for at in range(0, len(mixed), 512):  # a table of at most hashes x 512, which stays in the cache
        np.minimum(minima, (mixed[None, at : at + 512] * factors).min(axis=1), out=minima)
    return len(base), minima


@functools.cache
def _factors(hashes: int) -> np.ndarray:
    """Odd factors: each permutes the 32-bit numbers, which are well mixed before."""
    return np.random.default_rng(20260101).integers(0, 1 << 32, size=(hashes, 1), dtype=np.uint32) | np.uint32(1)


def band_keys(minima: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key a band from its number and its minima."""
    keys = np.arange(bands, dtype=np.uint64)
    for r in range(rows):
        keys = (keys ^ minima[r::rows].astype(np.uint64)) * np.uint64(0x94D049BB133111EB)
        keys ^= keys >> np.uint64(31)
    return keys.view(np.int64)


class _Near:
    """The steps that pairs and links share: signatures, buckets, and the verification of candidates."""

    def __init__(self, texts: DataFrame, threshold: float, scratch: Scratch, raw: bool):
        self.texts, self.threshold, self.scratch, self.raw = texts, threshold, scratch, raw
        bands, rows = banding(threshold)
        self.hashes = hashes = bands * rows
        likely = threshold + (1 - threshold) / 256
        self.fewest = hashes * likely - 5.4 * math.sqrt(hashes * likely * (1 - likely))

        def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kept, sizes, keys, low = [], [], [], []
                for i, text in enumerate(batch.column(1)):
                    key = X.canonical_text(text.as_py()) if raw else text.as_py()
                    if not key:
                        continue
                    n, minima = signature(key, hashes)
                    kept.append(i)
                    sizes.append(n)
                    keys.append(band_keys(minima, bands, rows))
                    low.append((minima & np.uint32(255)).astype(np.uint8).tobytes())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(kept) + 1) * bands, pa.int32()), pa.array(np.concatenate(keys) if keys else [], pa.int64()))
                columns = [batch.column(0).take(pa.array(kept, pa.int64())).cast(pa.string()), pa.array(sizes, pa.int32()), lists, pa.array(low, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["digest", "n", "keys", "low"])

        signed = spread(texts.select("digest", "key").where("key <> ''")).mapInArrow(sign, "digest string, n int, keys array<bigint>, low binary")
        self.signed = scratch.keep(signed.dropDuplicates(["digest"]).withColumn("id", F.monotonically_increasing_id()), "signed")
        banded = self.signed.select("id", "n", F.explode("keys").alias("k"))
        # Most buckets hold one text. Counts combine before the shuffle; only buckets of several texts get their members.
        sizes = banded.groupBy("k").agg(F.count("*").alias("m"), F.min("id").alias("least")).where("m > 1")
        self.members = scratch.keep(banded.join(scratch.keep(sizes, "sizes"), "k"), "members")

    def fits(self, a: str, b: str):
        return F.least(a, b) >= F.greatest(a, b) * self.threshold - 1e-9

    def within(self, one: DataFrame, other: DataFrame) -> DataFrame:
        """(a, b), a < b, of two members of a bucket, one of each table, that fit in size."""
        side = lambda x, of: of.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), "k")
        joined = side("a", one).join(side("b", other), "k").where(self.fits("na", "nb"))
        return (joined.where("a < b") if one is other else joined.where("a <> b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """(ia, ib, a, b, jaccard), a and b being digests, of candidates (a, b) that are similar enough.

        Candidates must agree in as many low bytes of their minima as a pair at the threshold does but for a chance below MISS; only the rest
        fetch their texts and are compared shingle by shingle."""
        hashes, fewest = self.hashes, self.fewest

        @F.pandas_udf("int")
        def agreeing(x: pd.Series, y: pd.Series) -> pd.Series:
            left, right = (np.frombuffer(b"".join(s), dtype=np.uint8).reshape(-1, hashes) for s in (x, y))
            return pd.Series((left == right).sum(axis=1).astype(np.int32))

        of = lambda x: self.signed.select(F.col("id").alias(x), F.col("digest").alias(f"d{x}"), F.col("low").alias(f"low{x}"))
        likely = pairs.join(of("a"), "a").join(of("b"), "b").where(agreeing("lowa", "lowb") >= fewest)
        kept = self.scratch.keep(likely.select(F.col("a").alias("ia"), F.col("b").alias("ib"), "da", "db"), f"likely-{name}")
        wanted = kept.select(F.col("da").alias("digest")).unionAll(kept.select(F.col("db").alias("digest"))).distinct()
        fetched = self.texts.join(wanted, "digest", "left_semi").dropDuplicates(["digest"])
        if self.raw:  # canonical again, but only for these
            fetched = fetched.withColumn("key", X.canonical(F.col("key")))
        sets = self.scratch.keep(fetched.select("digest", X.shingles(F.col("key")).alias("s")), f"shingles-{name}")
        one, other = sets.select(F.col("digest").alias("da"), F.col("s").alias("sa")), sets.select(F.col("digest").alias("db"), F.col("s").alias("sb"))
        common = F.size(F.array_intersect("sa", "sb"))
        scored = kept.join(one, "da").join(other, "db").select(
            F.least("ia", "ib").alias("ia"), F.greatest("ia", "ib").alias("ib"), F.least("da", "db").alias("a"), F.greatest("da", "db").alias("b"), (common / (F.size("sa") + F.size("sb") - common)).alias("jaccard")
        )
        return scored.where(F.col("jaccard") >= self.threshold)


def near_pairs(texts: DataFrame, threshold: float, scratch: Scratch, raw: bool = False) -> DataFrame:
    """(a, b, jaccard), a < b, for all pairs of different texts (digest, key) of similarity ``threshold`` or more; copies count once. With
    ``raw``, key is the text as it stands, and digest that of its canonical form.

    The result is as large as there are pairs: m texts that are all alike make m (m - 1) / 2. Where only groups matter, ``near_links`` has
    as many rows as there are texts.
    """
    near = _Near(texts, threshold, scratch, raw)
    return near.verified(near.within(near.members, near.members), "all").select("a", "b", "jaccard")


#: Buckets up to this size are compared pair by pair, larger ones by stars first.
DENSE = 64


def near_links(texts: DataFrame, threshold: float, scratch: Scratch, raw: bool = False, dense: int = DENSE) -> DataFrame:
    """(a, b, jaccard): pairs as in ``near_pairs``, enough of them that the same texts hang together.

    In a bucket of more than ``dense`` texts all are first compared with its least one. Those alike hang together by it, which settles all pairs
    among them; each of the others is compared with the whole bucket. So a million copies with small edits make some million comparisons, not
    10^12, and whatever hangs together by pairs does so by these links.
    """
    near = _Near(texts, threshold, scratch, raw)
    small, large = near.members.where(F.col("m") <= dense), near.members.where(F.col("m") > dense)
    tips = near.signed.select(F.col("id").alias("least"), F.col("n").alias("nt"))
    star = large.where("id <> least").join(tips, "least").where(near.fits("n", "nt")).select(F.col("least").alias("a"), F.col("id").alias("b"))
    links = scratch.keep(near.verified(near.within(small, small).unionAll(star).distinct(), "first"), "links")
    alike = links.select(F.col("ia").alias("least"), F.col("ib").alias("id")).withColumn("alike", F.lit(True))
    others = scratch.keep(large.where("id <> least").join(alike, ["least", "id"], "left_anti"), "others")
    if others.isEmpty():
        return links.select("a", "b", "jaccard")
    more = near.verified(near.within(others, large.where("id <> least")), "others")
    return links.unionAll(more).select("a", "b", "jaccard")


class Ranges:
    """The lossless scheme. Two sets of n and m shingles at the threshold t or above differ in at most (1 - t) / (1 + t) (n + m). Sizes fall
    into classes such that the larger of two sets that fit is in the class of the smaller or the next. For a class with at most H differences
    the hash space is cut into H + 1 ranges: some range holds the same shingles in both sets, and it can be chosen such that the next
    ``AHEAD`` ranges together differ in ``AHEAD`` shingles at most (else every range would start a run with more differences than its
    share, and so would the whole ring). Hence a posting for every range: a hash of its shingles, and the parities of what follows."""

    AHEAD = 4

    def __init__(self, threshold: float):
        self.threshold, self.tops = threshold, [1]

    def of_size(self, n: int) -> int:
        """Class of the sets of n shingles."""
        while self.tops[-1] < n:
            self.tops.append(max(self.tops[-1] + 1, int(self.tops[-1] / self.threshold + 1e-9)))
        return bisect.bisect_left(self.tops, n)

    def differences(self, n, m):
        """Most differences of two sets of n and m shingles that are similar enough."""
        return np.floor((1 - self.threshold) / (1 + self.threshold) * (n + m) + 1e-9)

    def postings(self, hashed: np.ndarray, size_class: int) -> tuple[np.ndarray, np.ndarray]:
        """(64-bit keys, 32-bit parities) of sorted hashes for pairs whose smaller set is of the class."""
        top = self.tops[size_class]
        ranges = int(self.differences(top, int(top / self.threshold + 1e-9))) + 1
        starts = (np.arange(1, ranges, dtype=np.uint64) << np.uint64(32)) // np.uint64(ranges)
        at = np.concatenate([[0], np.searchsorted(hashed, starts << np.uint64(32)), [len(hashed)]])
        sums = np.concatenate([_ZERO, np.cumsum(_mixed(hashed))])[at]
        parities = np.concatenate([_ZERO, np.bitwise_xor.accumulate(np.uint64(1) << (hashed & np.uint64(31)))])[at]
        keys = _mixed(_mixed(sums[1:] - sums[:-1] + np.arange(ranges, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) + np.uint64(size_class))
        each, ahead = parities[1:] ^ parities[:-1], np.zeros(ranges, dtype=np.uint64)
        for k in range(1, min(self.AHEAD, ranges - 1) + 1):
            ahead ^= np.roll(each, -k)
        return keys, ahead


_ZERO = np.zeros(1, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(30))


def _hashed(text: str) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    base = shingle_codes(text)
    base ^= base >> np.uint64(29)
    base *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(base ^ (base >> np.uint64(32)))


def _parities(hashed: np.ndarray) -> bytes:
    """A bit for each value of the low bits of a hash: whether an odd number of hashes has it. At least two bits a hash. The bits of two sets
    differ in no more places than the sets in elements; the halves of a wider one, one on the other, are the narrower one."""
    width = 1 << max(6, int(2 * len(hashed) - 1).bit_length())
    return np.packbits(np.bincount((hashed & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1, bitorder="little").tobytes()


def _apart(left: pd.Series, right: pd.Series) -> np.ndarray:
    """Places in which bits of ``_parities`` differ."""
    out = np.zeros(len(left), dtype=np.int64)
    for (n, m), at in pd.DataFrame({"n": left.map(len), "m": right.map(len)}).reset_index(drop=True).groupby(["n", "m"]).indices.items():
        x, y = (np.frombuffer(b"".join(s.iloc[at]), dtype=np.uint64).reshape(len(at), -1) for s in (left, right))
        while x.shape[1] != y.shape[1]:
            fold = lambda z: z[:, : z.shape[1] // 2] ^ z[:, z.shape[1] // 2 :]
            x, y = (fold(x), y) if x.shape[1] > y.shape[1] else (x, fold(y))
        out[at] = np.bitwise_count(x ^ y).sum(axis=1)
    return out


def _marks(ids: DataFrame) -> dict[int, np.ndarray]:
    """Ids of ``monotonically_increasing_id``, as a bit for every row of a partition: what goes to the driver is an eighth of a byte a row."""

    def pack(rows: pa.Table) -> pa.Table:
        at = np.unique(rows.column("at").to_numpy())
        bits = np.zeros(int(at[-1]) + 1, dtype=np.uint8)
        bits[at] = 1
        return pa.table({"part": rows.column("part").slice(0, 1), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    placed = ids.select(F.shiftright("id", 33).alias("part"), F.col("id").bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    return {r["part"]: np.frombuffer(r["bits"], dtype=np.uint8) for r in placed.groupBy("part").applyInArrow(pack, "part bigint, bits binary").collect()}


def _marked(ids: np.ndarray, marks: dict[int, np.ndarray]) -> np.ndarray:
    """Which of the ids have a mark."""
    out, parts, at = np.zeros(len(ids), dtype=bool), ids >> 33, ids & ((1 << 33) - 1)
    for part in np.unique(parts):
        bits = marks.get(int(part))
        if bits is not None:
            here = np.flatnonzero((parts == part) & (at >> 3 < len(bits)))
            out[here] = bits[at[here] >> 3] >> (7 - (at[here] & 7)) & 1
    return out


def _chosen(texts: DataFrame, marks: dict[int, np.ndarray], wanted: bool) -> DataFrame:
    """Rows of texts (id, ...) that have a mark, or those that have none. No text is moved for it."""
    sent = texts.sparkSession.sparkContext.broadcast(marks)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_marked(batch.column(0).to_numpy(), sent.value) == wanted))

    return texts.mapInArrow(choose, texts.schema)


def _sharing(first: DataFrame, ranges: Ranges, buckets: int) -> DataFrame:
    """(a, b), a < b, ids of texts (id, key) that share a posting of ``ranges``. Postings travel as packed arrays of 8 bytes each: one row a batch
    of texts, bucket of keys and role, being the smaller (own class) or the larger (the class before)."""

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.take(pa.array(np.argsort(batch.column(0).to_numpy())))
            roles = ([], [])
            for text in batch.column(1):
                hashed = _hashed(text.as_py())
                own = ranges.of_size(len(hashed))
                roles[0].append(ranges.postings(hashed, own))
                roles[1].append(ranges.postings(hashed, own - 1) if own else (_ZERO[:0], _ZERO[:0]))
            ids = batch.column(0).to_numpy()
            deltas = _narrow(np.diff(ids, prepend=ids[:1]))
            rows = []
            for role, done in enumerate(roles) if len(ids) else ():
                keys = np.concatenate([k for k, _ in done])
                packed = keys << np.uint64(32) | np.concatenate([x for _, x in done])
                owner = np.repeat(np.arange(len(done)), [len(k) for k, _ in done])
                bucket = ((keys >> np.uint64(32)) % np.uint64(buckets)).astype(np.uint16)
                order = np.argsort(bucket, kind="stable")
                ends = np.cumsum(np.bincount(bucket, minlength=buckets))
                for b, (begin, end) in enumerate(zip(np.concatenate([[0], ends[:-1]]), ends)):
                    if end > begin:
                        here = order[begin:end]
                        rows.append((b, role, int(ids[0]), len(ids), deltas, _narrow(np.bincount(owner[here], minlength=len(ids))), packed[here].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["bucket", "role", "first", "texts", "deltas", "counts", "packed"])

    def meet(rows: pa.Table) -> pa.Table:
        ids, keys, ahead, larger = [], [], [], []
        for r in rows.to_pylist():
            packed = np.frombuffer(r["packed"], dtype=np.uint64)
            own = r["first"] + np.cumsum(_wide(r["deltas"], r["texts"]))
            ids.append(np.repeat(own, _wide(r["counts"], r["texts"])))
            keys.append((packed >> np.uint64(32)).astype(np.uint32))
            ahead.append(packed.astype(np.uint32))
            larger.append(np.full(len(packed), r["role"], dtype=np.uint8))
        ids, keys, ahead, larger = map(np.concatenate, (ids, keys, ahead, larger))
        order = np.lexsort((larger, keys))
        keys = keys[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        lengths = np.diff(np.append(starts, len(keys)))
        several = np.repeat(lengths > 1, lengths)
        order, ends = order[several], np.repeat(np.cumsum(lengths[lengths > 1]), lengths[lengths > 1])
        ids, ahead, larger = ids[order], ahead[order], larger[order]
        found, left, step = [], np.flatnonzero(larger == 0), 1
        while len(left := left[left + step < ends[left]]):
            near = left[np.bitwise_count(ahead[left] ^ ahead[left + step]) <= ranges.AHEAD]
            x, y = ids[near], ids[near + step]
            found.append(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1))
            if step % 64 == 0:
                found = [np.unique(np.concatenate(found), axis=0)]
            step += 1
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), dtype=np.int64)
        pairs = pairs[pairs[:, 0] < pairs[:, 1]]
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    posted = first.mapInArrow(post, "bucket int, role int, first bigint, texts int, deltas binary, counts binary, packed binary")
    return posted.groupBy("bucket").applyInArrow(meet, "a bigint, b bigint").distinct()


def _narrow(numbers: np.ndarray) -> bytes:
    return numbers.astype(np.min_scalar_type(int(numbers.max()))).tobytes()


def _wide(content: bytes, n: int) -> np.ndarray:
    return np.frombuffer(content, dtype=f"u{len(content) // n}").astype(np.int64)


def _similar_texts(texts: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """(a, b, jaccard, sa, sb): all pairs of different texts (digest, key) of similarity ``threshold`` or more, a < b, and their shingles."""
    spark, ranges = texts.sparkSession, Ranges(threshold)
    kept = scratch.keep(texts.where("key <> ''").select(F.monotonically_increasing_id().alias("id"), F.unhex("digest").alias("digest"), "key"), "texts", compression="zstd")
    least = kept.groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("copies")).where("copies > 1")
    copies = _marks(kept.select("id", "digest").join(least, "digest").where("id <> least"))
    first = _chosen(kept.select("id", "key"), copies, False)
    buckets = min(4096, max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    pairs = scratch.keep(_sharing(first, ranges, buckets), "pairs")
    ends = lambda df: df.select(F.col("a").alias("id")).unionAll(df.select("b"))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashed = [_hashed(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(h) for h in hashed], pa.int32()), pa.array([_parities(h) for h in hashed], pa.binary())], names=["id", "n", "bits"])

    @F.pandas_udf("boolean")
    def close(na: pd.Series, nb: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(_apart(x, y) <= ranges.differences(na.to_numpy(), nb.to_numpy()))

    sketches = scratch.keep(_chosen(kept.select("id", "key"), _marks(ends(pairs)), True).mapInArrow(sketch, "id bigint, n int, bits binary"), "sketches")
    of = lambda x: sketches.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}"))
    fitting = pairs.join(of("a"), "a").join(of("b"), "b").where(F.least("na", "nb") >= F.greatest("na", "nb") * threshold - 1e-9)
    likely = scratch.keep(fitting.where(close("na", "nb", "bitsa", "bitsb")).select("a", "b"), "likely")
    wanted = _chosen(kept, _marks(ends(likely)), True)
    text = lambda x: wanted.select(F.col("id").alias(x), F.lower(F.hex("digest")).alias(f"d{x}"), F.col("key").alias(f"key{x}"))
    sets = likely.join(text("a"), "a").join(text("b"), "b").select("da", "db", X.shingles(F.col("keya")).alias("sa"), X.shingles(F.col("keyb")).alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    scored = sets.select(F.least("da", "db").alias("a"), F.greatest("da", "db").alias("b"), (common / (F.size("sa") + F.size("sb") - common)).alias("jaccard"), "sa", "sb")
    return scored.where(F.col("jaccard") >= threshold)


def prefix_pairs(texts: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """What ``near_pairs`` gives, without a chance to miss any; texts may come with copies, which count once."""
    return _similar_texts(texts, threshold, scratch).select("a", "b", "jaccard")


def banded_candidates(texts: DataFrame, threshold: float, bands: int = 8) -> DataFrame:
    """(a, b) that share the minimum of one of ``bands`` hash functions and fit in size: the reference's own candidate scheme,
    which misses a pair of similarity s with probability (1 - s) ** bands. The key holds the size class and its neighbour."""
    step = -math.log(threshold)
    sized = texts.withColumn("shingles", X.shingles(F.col("key"))).select("digest", F.size("shingles").alias("n"), X.minhash(F.col("shingles"), bands).alias("minima"))
    sized = sized.withColumn("size_class", F.floor(F.log(F.col("n")) / step))
    keyed = sized.select("digest", "n", "size_class", F.posexplode("minima").alias("band", "least"))
    left = keyed.select(F.col("digest").alias("a"), F.col("n").alias("na"), "band", "least", F.explode(F.array(F.col("size_class") - 1, F.col("size_class"), F.col("size_class") + 1)).alias("size_class"))
    right = keyed.select(F.col("digest").alias("b"), F.col("n").alias("nb"), "band", "least", "size_class")
    fits = (F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * threshold - 1e-9)
    return left.join(right, ["band", "least", "size_class"]).where(fits).select("a", "b").distinct()


def banded_pairs(texts: DataFrame, threshold: float, scratch: Scratch, bands: int = 8) -> DataFrame:
    """(a, b): what is left of ``banded_candidates`` when those that are not similar enough are gone. One minimum in common is so little that most
    candidates are of that kind, and their number grows with the square of the corpus; so the similar pairs come first, and those stay
    that the scheme names."""
    pairs = _similar_texts(texts, threshold, scratch)
    shared = F.zip_with(X.minhash(F.col("sa"), bands), X.minhash(F.col("sb"), bands), lambda x, y: x == y)
    return pairs.where(F.exists(shared, lambda same: same)).select("a", "b")


def membership(arrivals: DataFrame, pairs: DataFrame | None, scratch: Scratch, strict: bool = False) -> DataFrame:
    """(content_sha256, group) for arrivals (content_sha256, external): the least digest of the component over near pairs and
    shared external keys; keys of dropped copies count, so ``arrivals`` has a row for every record, copies included. Null is no key; an
    empty key fails the query if ``strict``, else it is none either."""
    if strict:
        empty = F.raise_error(F.concat(F.lit("empty group key of the record "), "content_sha256"))
        arrivals = arrivals.withColumn("external", F.when(F.trim("external") == "", empty).otherwise(F.col("external")))
    digests = arrivals.select(F.col("content_sha256").alias("node")).distinct()
    keyed = arrivals.where("external <> ''").select("external", "content_sha256").distinct()
    first = keyed.groupBy("external").agg(F.min("content_sha256").alias("a"))
    edges = keyed.join(first, "external").select("a", F.col("content_sha256").alias("b")).where("a <> b")
    if pairs is not None:
        edges = edges.unionAll(pairs.select("a", "b"))
    labels = least_labels(edges, scratch)
    return digests.join(labels, "node", "left").select(F.col("node").alias("content_sha256"), F.coalesce("label", "node").alias("group"))


def torn_groups(assigned: DataFrame, group: str = "group_id", split: str = "split") -> DataFrame:
    """(group, splits) of groups that lie in more than one split: none, if the assignment is sound."""
    return assigned.groupBy(group).agg(F.count_distinct(split).alias("splits")).where("splits > 1")
