"""MediaWiki page dumps, plain or compressed, whole or cut short."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.functions.wikitext import REDIRECTS, wikitext_to_prose

PAGE = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("ns", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("redirect", T.StructType([T.StructField("_title", T.StringType())])),
        T.StructField("revision", T.StructType([T.StructField("id", T.StringType()), T.StructField("text", T.StructType([T.StructField("_VALUE", T.StringType()), T.StructField("_bytes", T.StringType())]))])),
        T.StructField("_broken", T.StringType()),
    ]
)
_XML = {"ignoreSurroundingSpaces": "false", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}


def scan_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, title, ns, redirect, body, broken) of every page; the codec follows the file's extension.

    A dump is read as records that end with ``</page>``, so one file, plain or bzip2, is read by many tasks. A page that a cut-off leaves
    incomplete has no id, is marked ``broken`` and is dropped by ``articles``; so is one row that stands for a compressed stream that ends early,
    whose pages before the cut are kept.
    """
    reader = spark.read.option("lineSep", "</page>")
    pieces = reader.option("ignoreCorruptFiles", "true").text(path).select(F.regexp_extract("value", r"(?s)<page[\s>].*$", 0).alias("page"), F.contains("value", F.lit("</mediawiki>")).alias("last"), F.col("_metadata.file_path").alias("file"))
    # The end of the dump is the one piece without a page. A file without one was cut off.
    read = pieces.where("page <> ''").select(F.from_xml(F.concat("page", F.lit("</page>")), PAGE, _XML).alias("p"), F.col("page").contains("</revision>").alias("whole"))
    whole = F.col("whole") & F.col("p._broken").isNull()
    pages = read.select(
        F.when(whole, F.col("p.id")).alias("page_id"), F.col("p.title").alias("title"), F.col("p.ns").alias("ns"), F.col("p.redirect").isNotNull().alias("redirect"),
        F.col("p.revision.text._VALUE").alias("body"), (~whole).alias("broken"),
    )
    ends = pieces.agg(F.count_if(F.col("last")).alias("ends"), F.count_distinct("file").alias("files")).where("ends < files")
    return pages.unionByName(ends.select(*[F.lit(None).cast("string").alias(c) for c in ("page_id", "title", "ns")], F.lit(False).alias("redirect"), F.lit(None).cast("string").alias("body"), F.lit(True).alias("broken")))


def articles(pages: DataFrame) -> DataFrame:
    """Pages of the article namespace with an id and a body that is no redirect."""
    return pages.where("ns = '0' and not redirect and page_id <> '' and body <> ''").where(~F.col("body").rlike(rf"(?i)^\s*#\s*({REDIRECTS})"))


def to_records(pages: DataFrame, source: str, license: str, domain: str = "korean_general", min_chars: int = 200) -> DataFrame:
    """Raw records of articles, with the reason why one is left out: (id, source, license, domain, text, group_id, content_type,
    reason). Only rows without a reason are records."""
    stripped = articles(pages).withColumn("prose", wikitext_to_prose("body"))
    reason = F.when(F.col("prose") == "", "empty_after_strip").when(F.length("prose") < min_chars, "short")
    return stripped.select(
        F.concat(F.lit(source + "-"), "page_id").alias("id"), F.lit(source).alias("source"), F.lit(license).alias("license"), F.lit(domain).alias("domain"),
        F.concat(F.coalesce("title", F.lit("")), F.lit("\n\n"), "prose").alias("text"), F.concat(F.lit(source + ":"), "page_id").alias("group_id"), F.lit("text").alias("content_type"),
        reason.alias("reason"),
    )


def conversion_counters(pages: DataFrame, records: DataFrame) -> DataFrame:
    """(scanned, empty_after_strip, short, kept, utf8_bytes, truncated)."""
    counted = records.agg(
        F.lit(1).alias("one"), F.count("*").alias("scanned"), F.count_if(F.col("reason") == "empty_after_strip").alias("empty_after_strip"), F.count_if(F.col("reason") == "short").alias("short"),
        F.count_if(F.col("reason").isNull()).alias("kept"), F.coalesce(F.sum(F.when(F.col("reason").isNull(), F.octet_length("text"))), F.lit(0)).alias("utf8_bytes"),
    )
    cut = pages.agg(F.lit(1).alias("one"), F.coalesce(F.bool_or(F.col("broken") | F.col("page_id").isNull()), F.lit(False)).alias("truncated"))
    return counted.join(cut, "one").drop("one")
