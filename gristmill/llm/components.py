"""Groups of records from pairwise ties: connected components by low-diameter decomposition.

One level of ``components``: every vertex draws an exponentially distributed head start and clusters grow from the vertices
in order of their start, one hop a round, so that vertex v ends with the centre u for which ``hops(u, v) - start(u)`` is least.
The clusters are contracted to super-vertices, the edges between clusters go on to the next level, and the assignments of the
levels are composed from the last one back. A level is one Spark job of ``rounds`` aggregations; the edges shrink by a constant
factor a level, so a chain of n vertices takes O(log n) levels and no job's lineage reaches past its own level.

Growth is cut after ``rounds`` hops. That bounds the diameter of a cluster and cannot change the result: whatever a vertex is
assigned to is connected with it, and every edge whose ends differ is kept for the next level.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.plans.shared import Scratch

#: Rate of the exponential head starts: the smaller, the larger the clusters of one level.
RATE = 0.2
#: Hops that a cluster may grow in one level.
ROUNDS = 3


def _start(v: Column, level: int, rate: float) -> Column:
    """Head start of a vertex: exponential, a fixed function of vertex and level (a lost task draws the same again)."""
    unit = (F.pmod(F.xxhash64(v, F.lit(level)), F.lit(1 << 52)).cast("double") + 1) / float(1 << 52)
    return -F.log(unit) / rate


def components(edges: DataFrame, scratch: Scratch, rate: float = RATE, rounds: int = ROUNDS) -> DataFrame:
    """(v, root) for every vertex of ``edges`` (a, b: bigint); root is one vertex of v's component.

    Repeated and reversed edges, loops and nulls are allowed; a vertex that has only loops is left out, an empty table gives an
    empty result. No vertex, edge or component goes to the driver: it only reads how many edges are left.
    """
    edges = (
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("a").alias("_a"), F.col("b").alias("_b"))
        .where("_a is not null and _b is not null and a < b")
        .select("a", "b")
        .distinct()
    )
    edges = scratch.keep(edges, "edges")
    levels: list[DataFrame] = []
    while not edges.isEmpty():
        level = len(levels)
        assigned = scratch.keep(_grow(edges, level, rate, rounds), f"level{level}")
        levels.append(assigned)
        ends = assigned.select(F.col("v").alias("a"), F.col("centre").alias("ca"))
        more = assigned.select(F.col("v").alias("b"), F.col("centre").alias("cb"))
        between = (
            edges.join(ends, "a").join(more, "b").where("ca <> cb")
            .select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()
        )
        left = scratch.keep(between, f"between{level}")
        scratch.drop(edges)
        edges = left
    if not levels:
        return edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
    composed = levels[-1].select("v", F.col("centre").alias("root"))
    for assigned in reversed(levels[:-1]):
        upper = composed.select(F.col("v").alias("centre"), F.col("root").alias("up"))
        composed = assigned.join(upper, "centre", "left").select("v", F.coalesce("up", "centre").alias("root"))
    return composed


def _grow(edges: DataFrame, level: int, rate: float, rounds: int) -> DataFrame:
    """(v, centre) after ``rounds`` hops of growth. State is two plain numbers, so that every aggregation is by hashes; which of two
    centres at one and the same distance wins does not matter to the result, and head starts of 52 bits hardly ever tie."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    # Hop one needs no join: the head start of a neighbour is a function of its id.
    near = both.select("v", "u", (1 - _start(F.col("u"), level, rate)).alias("at")).groupBy("v").agg(F.min_by("u", "at").alias("centre"), F.min("at").alias("at"))
    own = -_start(F.col("v"), level, rate)
    state = near.select("v", F.when(own <= F.col("at"), F.col("v")).otherwise(F.col("centre")).alias("centre"), F.least(own, F.col("at")).alias("at"))
    for _ in range(rounds - 1):
        sent = both.join(state.withColumnRenamed("v", "u"), "u").select("v", "centre", (F.col("at") + 1).alias("at"))
        state = sent.unionAll(state).groupBy("v").agg(F.min_by("centre", "at").alias("centre"), F.min("at").alias("at"))
    return state.select("v", "centre")


@F.pandas_udf(T.StringType())
def _folded_key(keys: pd.Series) -> pd.Series:
    """NFC, trimmed, lower case; null unless ``<source>:<rest>`` with a rest that is not blank."""

    def fold(s):
        if s is None:
            return None
        s = unicodedata.normalize("NFC", s).strip().lower()
        source, colon, rest = s.partition(":")
        return s if colon and source.strip() and rest.strip() else None

    return keys.map(fold, na_action="ignore").astype(object).where(keys.notna(), None)


def folded_label(label: Column) -> Column:
    """The 64 hex digits of a label in lower case, else null. NFC never turns anything into an ASCII letter or digit of a hex
    number, so it cannot make another label valid, and the whole step stays in the JVM."""
    return F.lower(F.nullif(F.regexp_extract(label, r"(?U)^[\s\x1c-\x1f]*([0-9a-fA-F]{64})[\s\x1c-\x1f]*$", 1), F.lit("")))


def _first_free(tables: list[tuple[DataFrame, str]]) -> tuple[int, int]:
    """(number, step): numbers from there on in steps, which no id of the tables has. Ids may be any 64-bit numbers, but not reach into the
    last quarter of them at both ends."""
    ends = [t.agg(F.min(c).alias("lo"), F.max(c).alias("hi")) for t, c in tables]
    found = ends[0]
    for more in ends[1:]:
        found = found.unionAll(more)
    lo, hi = found.agg(F.min("lo"), F.max("hi")).first()
    lo, hi = min(0, lo or 0), max(0, hi or 0)
    if lo > -(1 << 62):
        return lo - 1, -1
    if hi < 1 << 62:
        return hi + 1, 1
    raise ValueError("ids take up the whole range of 64-bit numbers")


def record_ties(docs: DataFrame, links: DataFrame, aliases: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """(a, b) ties between record ids. A label stands for its smallest record id; a label that no record has gets a number that
    no record and no end of a link has, written once so that it cannot change; an external key ties its labels to the least of
    their numbers."""
    labelled = docs.select("id", folded_label(F.col("group_id")).alias("label")).where("id is not null and label is not null")
    named = aliases.select(_folded_key(F.col("external_group")).alias("key"), folded_label(F.col("group_id")).alias("label"))
    named = scratch.keep(named.where("key is not null and label is not null").distinct(), "named")
    free, step = _first_free([(docs, "id"), (links, "left_id"), (links, "right_id")])
    first = labelled.unionAll(named.select(F.lit(None).cast("bigint").alias("id"), "label")).groupBy("label").agg(F.min("id").alias("rep"))
    first = scratch.keep(first.withColumn("rep", F.coalesce("rep", F.lit(free) + step * F.monotonically_increasing_id())), "labels")
    by_label = labelled.join(first, "label").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    keyed = named.join(first, "label").select("key", "rep").distinct()
    by_key = keyed.join(keyed.groupBy("key").agg(F.min("rep").alias("least")), "key").select(F.col("rep").alias("a"), F.col("least").alias("b"))
    near = (F.col("jaccard") >= threshold) & ~F.isnan("jaccard")
    by_link = links.where(near).select(F.col("left_id").alias("a"), F.col("right_id").alias("b"))
    return by_label.where("a <> b").unionAll(by_key.where("a <> b")).unionAll(by_link.where("a <> b"))


def jaccard_threshold(preparation: DataFrame) -> float:
    """The threshold of the one settings row; infinity, so that no link ties, if it is missing."""
    row = preparation.select(F.max("near_duplicate_jaccard")).first()
    return float("inf") if row is None or row[0] is None else float(row[0])


def record_groups(docs: DataFrame, links: DataFrame, aliases: DataFrame, preparation: DataFrame) -> DataFrame:
    """(id, root_id): one row per distinct record id; root_id is the smallest record id of its group, itself if it is alone.

    Null ids are no records; negative ids are ids like others. Repeated rows, empty tables, further columns and ties through ids without a record are allowed.
    A hot group costs no more than any other: minima are combined before the shuffle and the joins back to the members may be
    split by the adaptive skew join.
    """
    scratch = Scratch(docs.sparkSession, "groups")
    found = components(record_ties(docs, links, aliases, jaccard_threshold(preparation), scratch), scratch)
    ids = docs.where("id is not null").select("id").distinct()
    member = scratch.keep(ids.join(found.withColumnRenamed("v", "id"), "id", "left").select("id", "root"), "member")
    roots = member.where("root is not null").groupBy("root").agg(F.min("id").alias("root_id"))
    return member.join(roots, "root", "left").select("id", F.coalesce("root_id", "id").alias("root_id"))
