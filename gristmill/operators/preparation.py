"""Cleaning, rejection and first-arrival deduplication of raw records."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions import text as X

#: The reasons against a record, first match first, and the fields that give provenance.
REASONS = ("missing_provenance", "license_not_allowed", "too_short", "too_long", "broken_text", "repeated_character")
PROVENANCE = ("id", "source", "license", "domain")


@dataclasses.dataclass(frozen=True)
class Settings:
    """Preparation settings; a value that makes no sense is refused."""

    allowed_licenses: tuple[str, ...]
    min_chars: int = 40
    max_chars: int = 200_000
    redact_email_phone: bool = True
    near_duplicate_grouping: bool = True
    near_duplicate_jaccard: float = 0.85
    seed: int = 42
    validation_ratio: float = 0.02
    test_ratio: float = 0.02

    def __post_init__(self) -> None:
        problems = []
        if not self.allowed_licenses:
            problems.append("no licence is allowed")
        if not 1 <= self.min_chars <= self.max_chars:
            problems.append("text lengths")
        if not 0 < self.near_duplicate_jaccard <= 1:
            problems.append("similarity threshold")
        if not (0 < self.validation_ratio < 1 and 0 < self.test_ratio < 1 and self.validation_ratio + self.test_ratio < 1):
            problems.append("split ratios")
        if problems:
            raise ValueError("invalid settings: " + ", ".join(problems))

    @classmethod
    def of(cls, preparation: DataFrame) -> Settings:
        """From the one row of the settings table; columns that are no setting are ignored there, see ``strict``."""
        row = preparation.first().asDict()
        names = {f.name for f in dataclasses.fields(cls)}
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in row.items() if k in names})

    @classmethod
    def strict(cls, values: dict) -> Settings:
        """From a dictionary that may hold nothing but settings."""
        unknown = sorted(values.keys() - {f.name for f in dataclasses.fields(cls)})
        if unknown:
            raise ValueError(f"unknown settings: {unknown}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})


def provenance_reason(settings: Settings) -> Column:
    """The reasons that need no text."""
    missing = F.lit(False)
    for c in PROVENANCE:
        missing = missing | (F.coalesce(F.col(c), F.lit("")) == "")
    return F.when(missing, REASONS[0]).when(~F.col("license").isin(*settings.allowed_licenses), REASONS[1])


def text_reason(text: Column, key: Column, settings: Settings) -> Column:
    """The first reason against a text; ``key`` is its canonical form."""
    return (
        F.when((F.coalesce(key, F.lit("")) == "") | (F.length(text) < settings.min_chars), REASONS[2])
        .when(F.length(text) > settings.max_chars, REASONS[3])
        .when(text.contains("�") | text.contains("\x00"), REASONS[4])
        .when(text.rlike(r"(?d)(.)\1{30,}"), REASONS[5])
    )


def tagged(records: DataFrame, settings: Settings, html_in_code: str = "error") -> DataFrame:
    """Records with cleaned ``text``, canonical ``key``, ``content_sha256`` and the ``reason`` against each, null for none.

    Texts are cleaned only where provenance stands, and only HTML passes the Python parser: a UDF inside ``when`` would run on
    every row. A null text is an empty one. HTML in the code domain is an error, or with ``html_in_code="text"`` taken as it stands,
    since its angle brackets may be code.
    """
    if html_in_code not in ("error", "text"):
        raise ValueError(html_in_code)
    checked = records.withColumn("reason", provenance_reason(settings))
    rejected = checked.where("reason is not null").withColumns({"text": F.lit(None).cast("string"), "key": F.lit(None).cast("string")})
    passed = checked.where("reason is null").withColumn("text", F.coalesce("text", F.lit("")))
    html = F.coalesce(F.col("content_type") == "html", F.lit(False))
    if html_in_code == "text":
        html = html & (F.col("domain") != "code")
    pages = passed.where(html).withColumn("text", F.when(F.col("domain") == "code", F.raise_error(F.lit("code cannot be HTML"))).otherwise(F.col("text")))
    cleaned = passed.where(~html).unionByName(pages.withColumn("text", X.html_to_text("text")))
    cleaned = cleaned.withColumn("text", X.plain_newlines(F.col("text")))
    if settings.redact_email_phone:
        cleaned = cleaned.withColumn("text", X.redacted_contacts(F.col("text")))
    cleaned = cleaned.withColumn("key", X.canonical(F.col("text")))
    cleaned = cleaned.withColumn("reason", text_reason(F.col("text"), F.col("key"), settings))
    both = rejected.unionByName(cleaned)
    return both.withColumn("content_sha256", F.when(F.col("reason").isNull(), X.digest(F.col("key"))))


def first_arrivals(kept: DataFrame, key: str = "content_sha256", order: str = "ordinal") -> DataFrame:
    """One row a key: the one with the least ordinal. An aggregate, so that copies combine before the shuffle and a key that
    holds a third of all rows is no larger for its task than any other."""
    others = [c for c in kept.columns if c not in (key,)]
    first = kept.groupBy(key).agg(F.min_by(F.struct(*others), F.col(order)).alias("first"), F.count("*").alias("copies"))
    return first.select(key, *[F.col(f"first.`{c}`").alias(c) for c in others], "copies")


def reason_counts(tagged_records: DataFrame) -> DataFrame:
    """(reason, records); kept ones count under ``kept``."""
    return tagged_records.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("records"))


def hash_split(group: Column, settings: Settings) -> Column:
    """Split of a group from the first 64 bits of SHA-256 of "seed:group"."""
    bits = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{settings.seed}:"), group), 256), 1, 16), 16, 10)
    bucket = bits.cast("decimal(20,0)").cast("double") / F.lit(2.0**64)
    return F.when(bucket < settings.test_ratio, "test").when(bucket < settings.test_ratio + settings.validation_ratio, "validation").otherwise("train")


def held_out_after(rows: DataFrame, cut: Column, group: str = "group_id", time: str = "seen_at") -> DataFrame:
    """Rows with a split: a group that has any row at or after ``cut`` is held out whole, so that no later record has a relative in train. Rows
    without a group stand for themselves; rows without a time do not hold their group out."""
    late = F.col(time) >= cut
    groups = rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.bool_or(late).alias("_late"))
    joined = rows.join(groups, group, "left")
    return joined.withColumn("split", F.when(F.coalesce(F.when(F.col(group).isNotNull(), F.col("_late")).otherwise(late), F.lit(False)), "test").otherwise("train")).drop("_late")


def numbered(clean: DataFrame) -> DataFrame:
    """``doc_number`` in order of digests within each split, from 0.

    Digests are spread evenly, so their first 3 hex digits make 4,096 even ranges: numbers come from ranks within ranges and the
    sizes of the ranges before, and no task sorts a whole split.
    """
    ranged = clean.withColumn("_range", F.substring("content_sha256", 1, 3))
    sizes = ranged.groupBy("split", "_range").agg(F.count("*").alias("n"))  # at most 4,096 rows a split
    before = F.sum("n").over(Window.partitionBy("split").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("split", "_range", F.coalesce(before, F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("split", "_range").orderBy("content_sha256")) - 1
    joined = ranged.withColumn("_rank", rank).join(F.broadcast(offsets), ["split", "_range"])
    return joined.withColumn("doc_number", (F.col("_before") + F.col("_rank")).cast("bigint")).drop("_range", "_before", "_rank")
