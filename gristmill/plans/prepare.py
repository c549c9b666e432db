"""The preparation from raw records to clean, grouped and split ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.operators import duplicates, preparation
from gristmill.operators.preparation import Settings
from gristmill.plans.shared import Scratch


class Prepared:
    """What a preparation yields: ``tagged`` (all records, with reasons), ``clean`` (kept ones), ``pairs`` (near duplicates; of more
    than a few that are all alike, enough links to connect them)."""

    def __init__(self, tagged: DataFrame, clean: DataFrame, pairs: DataFrame | None):
        self.tagged, self.clean, self.pairs = tagged, clean, pairs

    def counters(self) -> DataFrame:
        """(counter, value): records by reason, copies dropped, near links, documents and bytes a split."""
        by_reason = self.tagged.groupBy(F.coalesce("reason", F.lit("_kept")).alias("counter")).agg(F.count("*").alias("value"))
        total = by_reason.agg(F.lit("input").alias("counter"), F.sum("value").alias("value"))
        copies = self.clean.agg(F.lit("exact_duplicates_removed").alias("counter"), F.sum(F.col("copies") - 1).alias("value"))
        split = self.clean.groupBy("split").agg(F.count("*").alias("documents"), F.sum("utf8_bytes").cast("bigint").alias("utf8_bytes"))
        by_split = split.select(F.explode(F.array(*[F.struct(F.concat("split", F.lit(f"_{c}")).alias("counter"), F.col(c).alias("value")) for c in ("documents", "utf8_bytes")])).alias("c")).select("c.*")
        out = total.unionByName(by_reason.where("counter <> '_kept'")).unionByName(copies).unionByName(by_split)
        if self.pairs is not None:
            out = out.unionByName(self.pairs.agg(F.lit("near_duplicate_links").alias("counter"), F.count("*").alias("value")))
        return out.where("value > 0")

    def sources(self) -> DataFrame:
        """(source_domain, documents)."""
        return self.clean.groupBy(F.concat_ws(":", "source", "domain").alias("source_domain")).agg(F.count("*").alias("documents"))


def prepare(records: DataFrame, settings: Settings, html_in_code: str = "error", strict_keys: bool = False) -> Prepared:
    """Tag, drop copies, group and split. Ordinals of records are unique. With ``strict_keys`` an empty group key of a kept record fails.

    The tagged table, the only one that needs Python for every text, is written once and read back. Texts move once more at most, when the
    clean records are read: first arrivals, near duplicates, groups and splits go by digests, ordinals and signatures.
    """
    scratch = Scratch(records.sparkSession, "prepare")
    measured = preparation.tagged(records, settings, html_in_code).drop("key").withColumn("utf8_bytes", F.octet_length("text"))
    tagged = scratch.keep(measured, "tagged")
    kept = tagged.where("reason is null")
    first = kept.groupBy("content_sha256").agg(F.min("ordinal").alias("ordinal"), F.count("*").alias("copies"))
    arrivals = kept.select("content_sha256", F.col("group_id").alias("external"))
    pairs = None
    if settings.near_duplicate_grouping:
        texts = kept.select(F.col("content_sha256").alias("digest"), F.col("text").alias("key"))
        pairs = scratch.keep(duplicates.near_links(texts, settings.near_duplicate_jaccard, scratch, raw=True), "pairs")
    groups = duplicates.membership(arrivals, pairs, scratch, strict_keys).withColumnRenamed("group", "group_id")
    decided = first.join(groups, "content_sha256").withColumn("split", preparation.hash_split(F.col("group_id"), settings))
    clean = kept.drop("reason").withColumnRenamed("group_id", "external_group").join(scratch.keep(decided, "decided"), ["content_sha256", "ordinal"])
    return Prepared(tagged, clean, pairs)
