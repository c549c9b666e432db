"""Queries of the seven training-data problems over whole tables, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import components, encode, filling, leakage, pii, splits, subjects
from gristmill.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and test items with at least RUN characters in a row in common, among all alignments."""
    return p1_alignments(spark, d).where(F.col("run") >= leakage.RUN).select("doc_id", "item_id")


def p1_alignments(spark: SparkSession, d: str) -> DataFrame:
    """Every alignment of a document with a test item that scores enough, edited copies included."""
    return leakage.leaked(table(spark, d, "documents"), table(spark, d, "suite"))


def _ties(spark: SparkSession, d: str) -> list[DataFrame]:
    return [table(spark, d, n) for n in ("docs", "links", "aliases", "preparation")]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Members of groups of two or more, but for the root itself."""
    return p2_groups(spark, d).where("root_id < id").select("root_id", "id")


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """The group of every record, those alone included."""
    return components.record_groups(*_ties(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Records of groups that the present splits tear apart."""
    return p3_splits(spark, d).where("torn").select("id")


def p3_splits(spark: SparkSession, d: str) -> DataFrame:
    """The new split of every record."""
    return splits.group_splits(*_ties(spark, d))


def p3_placed(spark: SparkSession, d: str) -> DataFrame:
    """Every record with its group and the number of splits that the group's records are given, which must be one."""
    placed = p3_splits(spark, d)
    of_group = placed.groupBy("root_id").agg(F.count_distinct("split").alias("splits"))
    return placed.join(of_group, "root_id").select("id", "root_id", "splits")


def p3_shares(spark: SparkSession, d: str) -> DataFrame:
    """Distinct records and whether their share is within two per cent of the settings' for each split."""
    wanted = F.create_map(*[x for s in splits.SPLITS for x in (F.lit(s), F.col(f"{s}_ratio"))])
    ratios = table(spark, d, "preparation").select(F.explode(wanted).alias("split", "ratio"))
    counted = p3_splits(spark, d).agg(F.count("*").alias("n"), *[F.count_if(F.col("split") == s).alias(s) for s in splits.SPLITS])
    shares = counted.select(F.explode(F.create_map(*[x for s in splits.SPLITS for x in (F.lit(s), F.col(s) / F.col("n"))])).alias("split", "share"))
    return shares.join(ratios, "split").select("split", (F.abs(F.col("share") - F.col("ratio")) < 0.02).alias("near"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Distinct personal values of each document."""
    return pii.personal_values(table(spark, d, "documents"))


def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Every document with placeholders."""
    return pii.redacted(table(spark, d, "documents")).select("doc_id", F.size("spans").alias("spans"), "text")


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    """How often each type occurs in the corpus."""
    return pii.type_counts(table(spark, d, "documents"))


def p4_rest(spark: SparkSession, d: str) -> DataFrame:
    """Every document restored from its redacted text and the values found: each placeholder stands where the value did, and nothing else has
    changed."""
    done = pii.redacted(table(spark, d, "documents"))
    return done.select("doc_id", F.md5(F.aggregate("spans", F.col("text"), _put_back)).alias("digest"))


def _put_back(text, span):
    sign = F.lit(None).cast("string")
    for kind, placeholder in pii.PLACEHOLDER.items():
        sign = F.when(span["pii_type"] == kind, placeholder).otherwise(sign)
    at = span["start"]  # what stands before is restored already
    return F.concat(F.substring(text, F.lit(1), at), span["value"], F.substr(text, at + F.length(sign) + 1))


def p5_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return encode.encoded(table(spark, d, "documents"))


def p5_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Every document decoded again from its ids."""
    return encode.decoded(p5_ids(spark, d))


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    """The place of every document in the containers of every packing run."""
    return filling.filled(table(spark, d, "documents"), table(spark, d, "packing"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are."""
    return filling.fill_report(p6_containers(spark, d), table(spark, d, "packing"))


def p6_sound(spark: SparkSession, d: str) -> DataFrame:
    """Of each packing run, containers that hold too much and documents that were divided without need: none."""
    packing, held = table(spark, d, "packing"), p6_containers(spark, d).join(table(spark, d, "packing").select("run_name", "sequence_length"), "run_name")
    over = held.groupBy("run_name", "container", "sequence_length").agg(F.sum("n_tokens").alias("t")).groupBy("run_name").agg(F.count_if(F.col("t") > F.col("sequence_length")).alias("overfull"))
    parts = held.groupBy("run_name", "doc_id", "sequence_length").agg(F.count("*").alias("parts"), F.sum("n_tokens").alias("t"))
    torn = parts.groupBy("run_name").agg(F.count_if(F.col("parts") > F.ceil(F.col("t") / F.col("sequence_length"))).alias("torn"))
    return packing.select("run_name").join(over, "run_name").join(torn, "run_name")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Subjects of each document."""
    return p7_shares(spark, d).select("doc_id", "subject").distinct()


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Subjects of each document with their shares of its sentences."""
    return subjects.subjects_of(*[table(spark, d, n) for n in ("documents", "subject_labels", "subject_areas")])


def p7_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents and characters of the corpus by subject; subjects without a document are left out."""
    sizes = table(spark, d, "documents").select("doc_id", F.length("text").cast("bigint").alias("chars"))
    return p7_found(spark, d).join(sizes, "doc_id").groupBy("subject").agg(F.count("*").alias("documents"), F.sum("chars").alias("chars"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            p1_found, p1_alignments, p2_found, p2_groups, p3_found, p3_splits, p3_placed, p3_shares, p4_found, p4_redacted, p4_rest, p4_counts, p5_ids, p5_decoded,
            p6_containers, p6_fill, p6_sound, p7_found, p7_shares, p7_composition,
        )
    }


_GROUPS = r"""
WITH RECURSIVE settings AS (SELECT max(near_duplicate_jaccard) AS least FROM preparation),
labelled AS (
  SELECT DISTINCT id, 'l' || lower(regexp_replace(nfc_normalize(group_id), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS node FROM docs
),
keyed AS (
  SELECT DISTINCT 'k' || lower(regexp_replace(nfc_normalize(external_group), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS k,
         'l' || lower(regexp_replace(nfc_normalize(group_id), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS l FROM aliases
),
ties AS (
  SELECT 'd' || id AS a, node AS b FROM labelled WHERE regexp_full_match(node, 'l[0-9a-f]{64}')
  UNION ALL SELECT k, l FROM keyed WHERE regexp_full_match(k, 'k[^:]*[^:\s\p{Z}][^:]*:(?s:.*)[^\s\p{Z}](?s:.*)') AND regexp_full_match(l, 'l[0-9a-f]{64}')
  UNION ALL SELECT 'd' || left_id, 'd' || right_id FROM links, settings WHERE jaccard >= least
),
both_ways AS (SELECT a, b FROM ties UNION SELECT b, a FROM ties),
reach(a, b) AS (
  SELECT 'd' || id, 'd' || id FROM (SELECT DISTINCT id FROM docs)
  UNION SELECT r.a, t.b FROM reach r JOIN both_ways t ON r.b = t.a
),
grouped AS (
  SELECT CAST(substr(r.a, 2) AS BIGINT) AS id, min(d.id) AS root_id
  FROM reach r JOIN (SELECT DISTINCT id FROM docs) d ON r.b = 'd' || d.id GROUP BY 1
)
"""

_TORN = r"""
SELECT g.id FROM grouped g JOIN (
  SELECT root_id FROM grouped JOIN (
    SELECT id, CASE WHEN s IN ('val', 'valid') THEN 'validation' ELSE s END AS now
    FROM (SELECT id, lower(regexp_replace(split, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS s FROM docs) WHERE s <> ''
  ) USING (id) GROUP BY root_id HAVING count(DISTINCT now) > 1
) USING (root_id)
"""


def oracle_sql() -> dict[str, str]:
    """Groups by transitive closure over the ties, quadratic in the size of a group; of the other problems what must hold whatever the model finds."""
    return {
        "p2_found": _GROUPS + "SELECT root_id, id FROM grouped WHERE root_id < id",
        "p2_groups": _GROUPS + "SELECT id, root_id FROM grouped",
        "p3_found": _GROUPS + _TORN,
        "p3_placed": _GROUPS + "SELECT id, root_id, CAST(1 AS BIGINT) AS splits FROM grouped",
        "p3_shares": "SELECT unnest(['train', 'validation', 'test']) AS split, true AS near",
        "p4_rest": "SELECT doc_id, md5(text) AS digest FROM documents",
        "p5_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
        "p6_sound": "SELECT run_name, CAST(0 AS BIGINT) AS overfull, CAST(0 AS BIGINT) AS torn FROM packing",
    }
