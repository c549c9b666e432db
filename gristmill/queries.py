"""Queries of the reference's operators over whole driver tables, each beside SQL that gives the same rows where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gristmill.functions import text as X
from gristmill.operators import corpus, duplicates, evaluation, packing, preparation
from gristmill.operators.preparation import Settings
from gristmill.plans import pack, stages
from gristmill.plans import prepare as plan
from gristmill.plans.shared import Scratch
from gristmill.session import spread, table
from gristmill.sources import files, records, wiki
from gristmill.streaming import events as streams

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_oracles: dict[str, str] = {}

# SQL pieces: white space as Python has it, canonical text, redaction (delimiters are kept, so it is applied twice), code points.
_SPACE = r"[\s\p{Z}\x0b\x{85}\x1c-\x1f]+"
# (NFC there ends at a NUL, which therefore steps aside for it.)
_CANONICAL = rf"trim(regexp_replace(replace(nfc_normalize(replace(%s, chr(0), chr(1114109))), chr(1114109), chr(0)), '{_SPACE}', ' ', 'g'))"
_LF = r"regexp_replace(%s, '\r\n?', chr(10), 'g')"
_MAIL = r"regexp_replace(%s, '[\p{L}\p{M}\p{Nd}\p{Pc}.+-]+@[\p{L}\p{M}\p{Nd}\p{Pc}.-]+\.[A-Za-z]{2,}', '[EMAIL]', 'g')"
_PHONE = r"regexp_replace(%s, '(^|[^\p{Nd}])01[016789][- .]?\p{Nd}{3,4}[- .]?\p{Nd}{4}($|[^\p{Nd}])', '\1[PHONE]\2', 'g')"
_CLEAN = _PHONE % (_PHONE % (_MAIL % (_LF % "text")))


def _grams(source: str, key: str, text: str, k: int, short: bool) -> str:
    """SQL: (key, g), the distinct k-grams of texts; with ``short``, a shorter text is its own."""
    parts = " || ".join(["ch"] + [f"lead(ch, {i}) OVER w" for i in range(1, k)])
    whole = f" UNION ALL SELECT {key}, {text} FROM {source} WHERE length({text}) < {k}" if short else ""
    letters = f"SELECT {key}, generate_subscripts(c, 1) AS i, unnest(c) AS ch FROM (SELECT {key}, string_split({text}, '') AS c FROM {source} WHERE length({text}) >= {k})"
    return f"SELECT DISTINCT {key}, g FROM (SELECT {key}, {parts} AS g FROM ({letters}) WINDOW w AS (PARTITION BY {key} ORDER BY i){whole}) WHERE g IS NOT NULL"




def query(sql: str | None = None):
    def add(f):
        _queries[f.__name__] = f
        if sql:
            _oracles[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)


def _records(spark: SparkSession, d: str) -> DataFrame:
    return records.raw_records(_spread(spark, d))


def _settings(spark: SparkSession, d: str) -> Settings:
    return Settings.of(table(spark, d, "preparation"))


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _spread(spark: SparkSession, d: str) -> DataFrame:
    """Documents for work in Python, on all cores even if they come in one small file."""
    return spread(_documents(spark, d))


# ---- scans and sinks ----------------------------------------------------------------------------------------------------------


@query("SELECT doc_id AS ordinal, record_id AS id, source, license, domain, text, group_id, content_type FROM documents")
def s01_jsonl(spark, d):
    """Records written as JSON lines and scanned again."""
    root = Scratch(spark, "jsonl").root
    _records(spark, d).write.json(root)
    return records.scan_jsonl(spark, root).select(F.get_json_object("raw", "$.ordinal").cast("bigint").alias("ordinal"), "id", "source", "license", "domain", "text", "group_id", "content_type")


@query("SELECT doc_id, 0 AS file FROM documents UNION ALL SELECT doc_id, 1 FROM documents")
def s02_files_in_order(spark, d):
    """Two files in the order given: the ordinal says which came first."""
    root = Scratch(spark, "order").root
    _documents(spark, d).select("doc_id").write.json(root + "/a")
    _documents(spark, d).select("doc_id").write.json(root + "/b")
    both = records.scan_jsonl(spark, [root + "/a", root + "/b"])
    return both.select(F.get_json_object("raw", "$.doc_id").cast("bigint").alias("doc_id"), F.col("ordinal.file").alias("file"))


@query()
def s04_wiki(spark, d):
    """The documents as a compressed page dump, read, stripped and shaped to records."""
    escaped = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    clean = F.regexp_replace(escaped, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x{fffe}\x{ffff}]", " ")
    page = F.concat(F.lit("<page><title>t"), "doc_id", F.lit("</title><ns>0</ns><id>"), "doc_id", F.lit("</id><revision><id>1</id><text bytes=\"1\">"), clean, F.lit("</text></revision></page>"))
    root = Scratch(spark, "dump").root
    pages = _documents(spark, d).where("text <> ''").select(F.pmod(F.xxhash64("doc_id"), F.lit(16)).alias("part"), F.lit(1).alias("place"), page.alias("value"))
    ends = spark.range(16).select(F.col("id").alias("part"), F.explode(F.array(F.struct(F.lit(0).alias("place"), F.lit("<mediawiki>").alias("value")), F.struct(F.lit(2).alias("place"), F.lit("</mediawiki>").alias("value")))).alias("e"))
    lines = pages.unionAll(ends.select("part", "e.place", "e.value")).repartition(16, "part").sortWithinPartitions("part", "place")
    lines.select("part", "value").write.partitionBy("part").option("compression", "bzip2").text(root)
    return wiki.to_records(wiki.scan_pages(spark, root), "dump-1", "cc-by-sa-4.0", min_chars=40).select("id", "group_id", F.length("text").alias("chars"), "reason")


@query("SELECT 'dump-1-' || doc_id AS id, 'dump-1:' || doc_id AS group_id FROM documents WHERE text <> ''")
def s04_pages(spark, d):
    """The pages of that dump, whatever their prose."""
    return s04_wiki(spark, d).select("id", "group_id")


@query("SELECT DISTINCT prompt || chr(10) AS text FROM (SELECT unnest(string_split(prompt, chr(10))) AS prompt FROM suite WHERE prompt IS NOT NULL)")
def s07_lines(spark, d):
    """Prompts written as lines of text and read line by line."""
    root = Scratch(spark, "lines").root
    table(spark, d, "suite").where("prompt is not null").select("prompt").write.text(root)
    return records.scan_lines(spark, root).distinct()


_REJECTED = "SELECT id, reason FROM (SELECT record_id AS id, CASE WHEN coalesce(record_id, '') = '' OR coalesce(source, '') = '' OR coalesce(license, '') = '' OR coalesce(domain, '') = '' THEN 'missing_provenance' WHEN NOT list_contains(allowed_licenses, license) THEN 'license_not_allowed' END AS reason FROM documents, preparation) WHERE reason IS NOT NULL"


@query(_REJECTED)
def s09_rejects(spark, d):
    """Records that provenance rejects, written and read again."""
    root = Scratch(spark, "rejects").root
    records.write_rejects(_records(spark, d).withColumn("reason", preparation.provenance_reason(_settings(spark, d))), root)
    return spark.read.schema("id string, reason string").json(root)


@query("SELECT doc_id, split FROM (SELECT doc_id, CASE WHEN b < 0.05 THEN 'test' WHEN b < 0.1 THEN 'validation' ELSE 'train' END AS split FROM (SELECT doc_id, (('0x' || substr(sha256('42:' || CAST(doc_id AS VARCHAR)), 1, 16))::UBIGINT)::DOUBLE / pow(2, 64) AS b FROM documents)) WHERE split <> 'train'")
def s08_split_sink(spark, d):
    """Splits written as folders; two of them are read again, the third is pruned."""
    s = _settings(spark, d)
    rows = _documents(spark, d).select("doc_id", F.sha2(F.col("doc_id").cast("string"), 256).alias("content_sha256"), preparation.hash_split(F.col("doc_id").cast("string"), s).alias("split"))
    root = Scratch(spark, "splits").root
    records.write_splits(rows, root)
    return spark.read.parquet(root).where("split <> 'train'").select("doc_id", "split")


@query(" UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS rows, true AS same FROM {n}" for n in ("documents", "docs", "links", "aliases", "suite")))
def s17_fingerprint(spark, d):
    """An order-free fingerprint of every table: rows that it covers, and whether the table in another layout has the same."""
    out = None
    for n in ("documents", "docs", "links", "aliases", "suite"):
        t = table(spark, d, n)
        one, other = records.content_fingerprint(t, *t.columns), records.content_fingerprint(t.repartition(7), *t.columns)
        both = one.join(other.select(F.col("fingerprint").alias("other")), F.lit(True)).select(F.lit(n).alias("name"), "rows", (F.col("fingerprint") == F.col("other")).alias("same"))
        out = both if out is None else out.unionByName(both)
    return out


@query("SELECT count(*) AS files, true AS same FROM (SELECT DISTINCT doc_id % 3 FROM documents)")
def s17_checksums(spark, d):
    """Checksums of files, read in pieces: those of one folder written twice agree file by file."""
    roots = [Scratch(spark, f"sums{k}").root for k in (1, 2)]
    for root in roots:
        lines = _documents(spark, d).select((F.col("doc_id") % 3).alias("part"), "doc_id").repartition(3, "part").sortWithinPartitions("part", "doc_id")
        lines.select("part", F.col("doc_id").cast("string")).write.partitionBy("part").text(root)
    one, other = (files.checksums(spark, root).where("file like '%.txt'").select(F.regexp_extract("file", "part=[0-9]+", 0).alias("part"), "sha256") for root in roots)
    return one.groupBy("part").agg(F.min("sha256").alias("x")).join(other.groupBy("part").agg(F.max("sha256").alias("y")), "part").agg(F.count("*").alias("files"), F.bool_and(F.col("x") == F.col("y")).alias("same"))


# ---- texts ----------------------------------------------------------------------------------------------------------------------


@query()
def x01_html(spark, d):
    """HTML documents as text."""
    return _documents(spark, d).where("content_type = 'html'").select("doc_id", X.html_to_text("text").alias("text"))


@query(f"SELECT doc_id, sha256({_LF % 'text'}) AS digest FROM documents")
def x03_newlines(spark, d):
    """One kind of line end."""
    return _documents(spark, d).select("doc_id", X.digest(X.plain_newlines(F.col("text"))).alias("digest"))


@query(f"SELECT doc_id, sha256({_CLEAN}) AS digest FROM documents")
def x05_redaction(spark, d):
    """E-mail addresses and mobile numbers replaced."""
    return _documents(spark, d).select("doc_id", X.digest(X.redacted_contacts(X.plain_newlines(F.col("text")))).alias("digest"))


@query(f"SELECT doc_id, sha256({_CANONICAL % 'text'}) AS digest FROM documents")
def x07_canonical_digest(spark, d):
    """Digest of the canonical text."""
    return _documents(spark, d).select("doc_id", X.digest(X.canonical(F.col("text"))).alias("digest"))


@query(f"WITH t AS (SELECT doc_id, {_CANONICAL % 'text'} AS k FROM documents WHERE text IS NOT NULL), x AS (SELECT * FROM t WHERE k <> '') SELECT doc_id, count(*) AS shingles FROM ({_grams('x', 'doc_id', 'k', 5, True)}) GROUP BY doc_id")
def x16_shingles(spark, d):
    """Number of distinct shingles of each canonical text."""
    keyed = _spread(spark, d).where("text is not null").select("doc_id", X.canonical(F.col("text")).alias("key")).where("key <> ''")
    return keyed.select("doc_id", F.size(X.shingles(F.col("key"))).cast("bigint").alias("shingles"))


@query(f"SELECT sha256(k) AS digest, CAST(1 AS BIGINT) AS signatures, CAST(8 AS INTEGER) AS hashes FROM (SELECT DISTINCT {_CANONICAL % 'text'} AS k FROM documents WHERE text IS NOT NULL) WHERE k <> ''")
def x17_minhash(spark, d):
    """MinHash signatures: all copies of a canonical text have one and the same, of eight hashes."""
    keyed = _spread(spark, d).where("text is not null").select(X.canonical(F.col("text")).alias("key")).where("key <> ''")
    signed = keyed.select(X.digest(F.col("key")).alias("digest"), X.minhash(X.shingles(F.col("key"))).alias("signature"))
    return signed.groupBy("digest").agg(F.count_distinct("signature").alias("signatures"), F.max(F.size("signature")).alias("hashes"))


@query(r"SELECT id, regexp_replace(lower(nfc_normalize(a)), '[\s\p{Z}\x0b\x{85}\x1c-\x1f\p{P}]', '', 'g') AS folded FROM (SELECT id, unnest(answers) AS a FROM suite)")
def x18_folded_answers(spark, d):
    """Reference answers as they are compared."""
    return table(spark, d, "suite").select("id", F.explode("answers").alias("a")).select("id", X.folded_answer(F.col("a")).alias("folded"))


# ---- rejection and preparation -----------------------------------------------------------------------------------------------------

_REASON = f"""CASE WHEN coalesce(record_id, '') = '' OR coalesce(source, '') = '' OR coalesce(license, '') = '' OR coalesce(domain, '') = '' THEN 'missing_provenance'
  WHEN NOT list_contains(allowed_licenses, license) THEN 'license_not_allowed' WHEN {_CANONICAL % 't'} = '' OR length(t) < min_chars THEN 'too_short' WHEN length(t) > max_chars THEN 'too_long'
  WHEN contains(t, chr(65533)) OR contains(t, chr(0)) THEN 'broken_text'
  WHEN list_bool_or(list_transform(list_distinct(string_split(t, '')), lambda x: x <> chr(10) AND contains(t, repeat(x, 31)))) THEN 'repeated_character' END"""


@query(f"SELECT doc_id, coalesce({_REASON}, 'kept') AS reason FROM (SELECT *, {_CLEAN.replace('text', 'u')} AS t FROM (SELECT *, coalesce(text, '') AS u FROM documents), preparation)")
def f06_reasons(spark, d):
    """The first reason against each record, texts taken as they are (no HTML stripping)."""
    s = _settings(spark, d)
    raw = _records(spark, d).withColumn("text", X.redacted_contacts(X.plain_newlines(F.coalesce("text", F.lit("")))))
    reason = F.coalesce(preparation.provenance_reason(s), preparation.text_reason(F.col("text"), X.canonical(F.col("text")), s), F.lit("kept"))
    return raw.select(F.col("ordinal").alias("doc_id"), reason.alias("reason"))


@query()
def f00_tagged(spark, d):
    """The whole cleaning, HTML included: reason and digest of each record."""
    return preparation.tagged(_records(spark, d), _settings(spark, d), html_in_code="text").select(F.col("ordinal").alias("doc_id"), "reason", "content_sha256")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM sources s, preparation p WHERE s.license = d.license AND list_contains(p.allowed_licenses, s.license))")
def f02_unlicensed(spark, d):
    """Records whose licence is not among the allowed ones that any source has: an anti join."""
    s = _settings(spark, d)
    allowed = table(spark, d, "sources").where(F.col("license").isin(*s.allowed_licenses)).select("license").distinct()
    return _documents(spark, d).join(allowed, "license", "left_anti").select("doc_id")


@query(f"SELECT digest, min(doc_id) AS doc_id, count(*) AS copies FROM (SELECT doc_id, sha256({_CANONICAL % 'text'}) AS digest FROM documents WHERE text IS NOT NULL) GROUP BY digest")
def d01_first_arrivals(spark, d):
    """The first record of each canonical text."""
    keyed = _spread(spark, d).where("text is not null").select(F.col("doc_id").alias("ordinal"), X.digest(X.canonical(F.col("text"))).alias("content_sha256"))
    return preparation.first_arrivals(keyed).select(F.col("content_sha256").alias("digest"), F.col("ordinal").alias("doc_id"), "copies")


_PAIRS = f"""WITH RECURSIVE t AS (SELECT sha256(k) AS digest, k FROM (SELECT DISTINCT {_CANONICAL % 'text'} AS k FROM documents WHERE text IS NOT NULL) WHERE k <> ''),
s AS ({_grams('t', 'digest', 'k', 5, True)}),
n AS (SELECT digest, count(*) AS n FROM s GROUP BY digest),
f AS (SELECT g, count(*) AS df FROM s GROUP BY g),
r AS (SELECT s.digest, s.g, n.n, row_number() OVER (PARTITION BY s.digest ORDER BY df, s.g) AS k FROM s JOIN f USING (g) JOIN n USING (digest)),
pre AS (SELECT digest, g, n FROM r WHERE k <= n - ceil(0.85 * n - 1e-9) + 1),
cand AS (SELECT DISTINCT x.digest AS a, y.digest AS b FROM pre x JOIN pre y USING (g) WHERE x.digest < y.digest AND least(x.n, y.n) >= 0.85 * greatest(x.n, y.n) - 1e-9),
common AS (SELECT a, b, count(*) AS i FROM cand JOIN s x ON x.digest = a JOIN s y ON y.digest = b AND y.g = x.g GROUP BY a, b),
pairs AS (SELECT a, b, i / (na.n + nb.n - i) AS jaccard FROM common JOIN n na ON na.digest = a JOIN n nb ON nb.digest = b WHERE i / (na.n + nb.n - i) >= 0.85)
"""


def _keys(spark, d):
    keyed = _spread(spark, d).where("text is not null").select(X.canonical(F.col("text")).alias("key"), F.col("group_id").alias("external")).where("key <> ''")
    return keyed.withColumn("digest", X.digest(F.col("key")))


@query(_PAIRS + "SELECT a, b, jaccard FROM pairs")
def d03_near_pairs(spark, d):
    """Near duplicates among the distinct canonical texts, with their exact similarity."""
    scratch = Scratch(spark, "near")
    return duplicates.near_pairs(scratch.keep(_keys(spark, d).select("digest", "key"), "texts"), 0.85, scratch)


@query(_PAIRS + "SELECT a, b, jaccard FROM pairs")
def d03_prefix_pairs(spark, d):
    """The same by the lossless way."""
    return duplicates.prefix_pairs(_keys(spark, d).select("digest", "key"), 0.85, Scratch(spark, "prefix"))


@query(_PAIRS + "SELECT a, b FROM pairs")
def d02_banded_candidates(spark, d):
    """Candidates by the banded scheme of the reference, of which those are left that are similar enough."""
    return duplicates.banded_pairs(_keys(spark, d).select("digest", "key"), 0.85, Scratch(spark, "banded"))


_MEMBERS = ", e AS (SELECT DISTINCT external, digest FROM (SELECT group_id AS external, sha256(" + _CANONICAL % "text" + ") AS digest FROM documents WHERE text IS NOT NULL AND " + _CANONICAL % "text" + """ <> '') WHERE external <> ''),
tie AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs UNION SELECT 'x' || external, digest FROM e UNION SELECT digest, 'x' || external FROM e),
reach(a, b) AS (SELECT digest, digest FROM n UNION SELECT r.a, t.b FROM reach r JOIN tie t ON r.b = t.a),
grouped AS (SELECT a AS content_sha256, min(b) AS "group" FROM reach WHERE b NOT LIKE 'x%' GROUP BY a) """


@query(_PAIRS + _MEMBERS + 'SELECT content_sha256, "group" FROM grouped')
def g01_groups(spark, d):
    """The group of each distinct text over near duplicates and external keys, keys of copies included."""
    scratch = Scratch(spark, "members")
    keyed = scratch.keep(_keys(spark, d), "keys")
    pairs = duplicates.near_links(keyed.select("digest", "key"), 0.85, scratch)
    return duplicates.membership(keyed.select(F.col("digest").alias("content_sha256"), "external"), pairs, scratch)


_SPLIT = "CASE WHEN b < test_ratio THEN 'test' WHEN b < test_ratio + validation_ratio THEN 'validation' ELSE 'train' END"
_BUCKET = "(('0x' || substr(sha256(seed || ':' || g), 1, 16))::UBIGINT)::DOUBLE / pow(2, 64)"


@query(f"SELECT id, {_SPLIT} AS split FROM (SELECT id, test_ratio, validation_ratio, {_BUCKET} AS b FROM (SELECT DISTINCT id, digest AS g FROM docs), preparation)")
def g02_hash_split(spark, d):
    """Split of each record by the hash of its digest."""
    return table(spark, d, "docs").select("id", "digest").distinct().select("id", preparation.hash_split(F.col("digest"), _settings(spark, d)).alias("split"))


@query("SELECT id, digest, CASE WHEN coalesce(bool_or(seen_at >= TIMESTAMPTZ '2026-08-10 00:00:00+00') OVER (PARTITION BY g), false) THEN 'test' ELSE 'train' END AS split FROM (SELECT *, coalesce(group_id, '#' || row_number() OVER ()) AS g FROM docs)")
def b09_temporal(spark, d):
    """Records held out by time, whole groups at once."""
    rows = table(spark, d, "docs").select("id", "digest", "group_id", "seen_at")
    return preparation.held_out_after(rows, F.to_timestamp(F.lit("2026-08-10 00:00:00+00:00"))).select("id", "digest", "split")


@query("SELECT group_id, count(DISTINCT lower(trim(split))) AS splits FROM docs GROUP BY group_id HAVING count(DISTINCT lower(trim(split))) > 1")
def g03_torn_labels(spark, d):
    """Labels whose rows lie in several splits, as written."""
    return duplicates.torn_groups(table(spark, d, "docs").withColumn("split", F.lower(F.trim("split"))))


def prepared(spark: SparkSession, d: str):
    return plan.prepare(_records(spark, d), _settings(spark, d), html_in_code="text")  # the tables have such rows


def prepared_summary(spark: SparkSession, d: str) -> DataFrame:
    """(section, key, value): counters and sources of the whole preparation."""
    done = prepared(spark, d)
    sources = done.sources().select(F.lit("source").alias("section"), F.col("source_domain").alias("key"), F.col("documents").alias("value"))
    return done.counters().select(F.lit("counter").alias("section"), F.col("counter").alias("key"), "value").unionByName(sources)


@query()
def e01_prepare(spark, d):
    """The flagship: cleaning, near duplicates, groups, splits; counters and sources."""
    return prepared_summary(spark, d)


_PLAIN = "(SELECT * FROM documents WHERE coalesce(content_type, 'text') <> 'html')"
_PREPARED = f"""WITH RECURSIVE tagged AS (SELECT *, {_REASON} AS reason FROM (SELECT *, {_CLEAN.replace('text', 'u')} AS t FROM (SELECT *, coalesce(text, '') AS u FROM {_PLAIN}), preparation)),
kept AS (SELECT doc_id, t AS text, group_id, source, domain, {_CANONICAL % 't'} AS k, sha256({_CANONICAL % 't'}) AS digest FROM tagged WHERE reason IS NULL),
t AS (SELECT DISTINCT digest, k FROM kept),
""" + _PAIRS[_PAIRS.index("s AS (") :].rstrip() + """,
e AS (SELECT DISTINCT group_id AS external, digest FROM kept WHERE group_id <> ''),
tie AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs UNION SELECT 'x' || external, digest FROM e UNION SELECT digest, 'x' || external FROM e),
reach(a, b) AS (SELECT digest, digest FROM n UNION SELECT r.a, t.b FROM reach r JOIN tie t ON r.b = t.a),
grouped AS (SELECT a AS digest, min(b) AS g FROM reach WHERE b NOT LIKE 'x%' GROUP BY a),
first AS (SELECT arg_min(text, doc_id) AS text, min(doc_id) AS doc_id, count(*) AS copies, digest FROM kept GROUP BY digest),
clean AS (SELECT """ + _SPLIT + " AS split, text, doc_id, digest, g, copies FROM (SELECT text, doc_id, digest, g, copies, test_ratio, validation_ratio, " + _BUCKET + """ AS b FROM first JOIN grouped USING (digest), preparation))
"""
_COUNTERS = """SELECT * FROM (SELECT 'input' AS counter, CAST(count(*) AS BIGINT) AS value FROM tagged UNION ALL SELECT reason, count(*) FROM tagged WHERE reason IS NOT NULL GROUP BY reason
UNION ALL SELECT 'exact_duplicates_removed', count(*) - count(DISTINCT digest) FROM kept UNION ALL SELECT split || '_documents', count(*) FROM clean GROUP BY split UNION ALL SELECT split || '_utf8_bytes', sum(strlen(text)) FROM clean GROUP BY split) WHERE value > 0"""


def _plain(spark, d):
    plain = records.raw_records(_spread(spark, d).where(F.coalesce("content_type", F.lit("text")) != "html"))
    return plan.prepare(plain, _settings(spark, d))


@query(_PREPARED + _COUNTERS)
def e01_plain(spark, d):
    """The whole preparation of what is not HTML: counters, but for the number of links."""
    return _plain(spark, d).counters().where("counter <> 'near_duplicate_links'")


@query(_PREPARED + "SELECT doc_id, digest AS content_sha256, sha256(text) AS text_sha256, g AS group_id, split, copies FROM clean")
def e01_plain_clean(spark, d):
    """The clean records of what is not HTML: digest, text, group, split and copies."""
    return _plain(spark, d).clean.select(F.col("ordinal").alias("doc_id"), "content_sha256", X.digest(F.col("text")).alias("text_sha256"), "group_id", "split", "copies")


@query()
def e01_clean(spark, d):
    """The clean records: digest, group, split and copies."""
    return prepared(spark, d).clean.select("content_sha256", "id", "group_id", "split", "copies")


@query(f"SELECT 'by document' AS assigned, group_id, count(DISTINCT split) AS splits FROM (SELECT group_id, {_SPLIT} AS split FROM (SELECT group_id, test_ratio, validation_ratio, {_BUCKET} AS b FROM (SELECT group_id, CAST(doc_id AS VARCHAR) AS g FROM documents), preparation)) GROUP BY group_id HAVING count(DISTINCT split) > 1")
def g03_leaks(spark, d):
    """Groups in more than one split, if documents were assigned one by one; and if groups are, of which there must be none."""
    s, docs = _settings(spark, d), _documents(spark, d)
    one = duplicates.torn_groups(docs.select("group_id", preparation.hash_split(F.col("doc_id").cast("string"), s).alias("split"))).withColumn("assigned", F.lit("by document"))
    other = duplicates.torn_groups(docs.select("group_id", preparation.hash_split(F.col("group_id"), s).alias("split"))).withColumn("assigned", F.lit("by group"))
    clean = duplicates.torn_groups(prepared(spark, d).clean).withColumn("assigned", F.lit("by the preparation"))
    return one.unionByName(other).unionByName(clean).select("assigned", "group_id", "splits")


# ---- aggregates -----------------------------------------------------------------------------------------------------------------


@query(f"SELECT split, count(*) AS documents, sum(strlen(text)) AS utf8_bytes FROM (SELECT text, {_SPLIT} AS split FROM (SELECT text, test_ratio, validation_ratio, {_BUCKET} AS b FROM (SELECT text, CAST(doc_id AS VARCHAR) AS g FROM documents WHERE text IS NOT NULL), preparation)) GROUP BY split")
def a02_split_bytes(spark, d):
    """Documents and bytes of each split."""
    split = preparation.hash_split(F.col("doc_id").cast("string"), _settings(spark, d))
    return _documents(spark, d).where("text is not null").groupBy(split.alias("split")).agg(F.count("*").alias("documents"), F.sum(F.octet_length("text")).cast("decimal(38,0)").alias("utf8_bytes"))


@query("SELECT concat_ws(':', source, domain) AS source_domain, count(*) AS documents FROM documents GROUP BY 1")
def a03_sources(spark, d):
    """Documents by source and domain."""
    return _documents(spark, d).groupBy(F.concat_ws(":", "source", "domain").alias("source_domain")).agg(F.count("*").alias("documents"))


@query("SELECT record_id, count(*) AS n FROM documents GROUP BY record_id HAVING count(*) > 1")
def a10_repeated_ids(spark, d):
    """Record ids that occur more than once."""
    return _documents(spark, d).groupBy("record_id").agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents WHERE text <> '') GROUP BY ch")
def a11_characters(spark, d):
    """How often each character occurs."""
    return corpus.character_counts(_documents(spark, d))


@query("SELECT 0 AS id, '<unk>' AS ch UNION ALL SELECT CAST(row_number() OVER (ORDER BY unicode(ch)) AS INTEGER), ch FROM (SELECT DISTINCT unnest(string_split(text, '')) AS ch FROM documents WHERE text <> '')")
def t01_vocabulary(spark, d):
    """Character vocabulary in code point order."""
    return corpus.character_vocabulary(_documents(spark, d))


@query("""WITH v AS (SELECT row_number() OVER (ORDER BY unicode(ch)) AS id, ch FROM (SELECT DISTINCT unnest(string_split(prompt, '')) AS ch FROM suite WHERE prompt <> '')),
c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents WHERE text <> '')
SELECT d.doc_id, count(c.ch) AS n, CAST(coalesce(sum(v.id), 0) AS BIGINT) AS total FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN v USING (ch) GROUP BY d.doc_id""")
def t01_encoded(spark, d):
    """Every document by the vocabulary of the suite's prompts: number and sum of ids, unknown ones being 0."""
    vocabulary = corpus.character_vocabulary(table(spark, d, "suite").select(F.col("prompt").alias("text")))
    ids = corpus.encode_characters(_documents(spark, d), vocabulary, "doc_id")
    return ids.select("doc_id", F.size("ids").cast("bigint").alias("n"), F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))


@query("SELECT id, prompt AS text FROM suite WHERE prompt IS NOT NULL")
def t01_round_trip(spark, d):
    """Prompts encoded and decoded again."""
    texts = table(spark, d, "suite").where("prompt is not null").select("id", F.col("prompt").alias("text"))
    vocabulary = corpus.character_vocabulary(texts)
    return corpus.decode_characters(corpus.encode_characters(texts, vocabulary, "id"), vocabulary, "id")


@query("SELECT unnest(['round_trip', 'reload', 'one_id_a_character', 'unknown']) AS \"check\", CAST(0 AS BIGINT) AS failures")
def t04_vocabulary_artifact(spark, d):
    """The vocabulary of the documents saved and loaded again, checked over all documents."""
    texts, scratch = _documents(spark, d).select("doc_id", "text"), Scratch(spark, "vocabulary")
    vocabulary = scratch.keep(corpus.character_vocabulary(texts), "vocabulary")  # else it is made anew each time it is read
    corpus.save_vocabulary(vocabulary, f"{scratch.root}/saved")
    return corpus.vocabulary_checks(texts, vocabulary, corpus.load_vocabulary(spark, f"{scratch.root}/saved"), "doc_id")


@query("SELECT doc_id, text FROM documents WHERE text IS NOT NULL")
def t03_round_trip(spark, d):
    """Documents through a public byte-level tokenizer and back."""
    texts = _spread(spark, d).where("text is not null")
    return texts.select("doc_id", corpus.encoder("byte_bpe_50k")(F.col("text")).alias("ids")).select("doc_id", corpus.decoder("byte_bpe_50k")(F.col("ids")).alias("text"))


@query(r"SELECT 'loses what leads' AS splitter, doc_id FROM documents WHERE regexp_matches(text, '^[\s\p{Z}\x0b\x{85}]')")
def t06_broken_pieces(spark, d):
    """Texts that a splitter does not give back: for one that loses leading white space those that begin so, for the sound one none."""
    texts = _documents(spark, d).where("text is not null").select("doc_id", "text")
    lossy = corpus.broken_pieces(texts, corpus.splitter(r"\S+\s*"), "doc_id").select(F.lit("loses what leads").alias("splitter"), "doc_id")
    return lossy.unionByName(corpus.broken_pieces(texts, corpus.splitter(), "doc_id").select(F.lit("sound").alias("splitter"), "doc_id"))


@query()
def a05_tokenizer_report(spark, d):
    """Documents, tokens, bytes, seconds, rates and round-trip failures by domain."""
    return corpus.tokenizer_report(_measured(spark, d))


def _measured(spark, d):
    rows = _spread(spark, d).select("domain", "text", corpus.measurer("byte_bpe_50k")(F.col("text")).alias("m"))
    return rows.select("domain", "text", "m.*")


@query("SELECT coalesce(domain, 'unknown') AS domain, count(*) AS documents, CAST(sum(strlen(text)) AS BIGINT) AS utf8_bytes, CAST(sum(length(text)) AS BIGINT) AS characters, CAST(0 AS BIGINT) AS roundtrip_failures FROM documents WHERE text <> '' GROUP BY 1")
def a05_sizes(spark, d):
    """What of the tokenizer report does not depend on the tokenizer."""
    return corpus.tokenizer_report(_measured(spark, d)).select("domain", "documents", "utf8_bytes", "characters", "roundtrip_failures")


# ---- windows, packing, order ------------------------------------------------------------------------------------------------------


@query(f"SELECT id, split, row_number() OVER (PARTITION BY split ORDER BY content_sha256) - 1 AS doc_number FROM (SELECT id, content_sha256, {_SPLIT} AS split FROM (SELECT id, content_sha256, test_ratio, validation_ratio, {_BUCKET} AS b FROM (SELECT id, sha256(CAST(id AS VARCHAR)) AS content_sha256, CAST(id AS VARCHAR) AS g FROM (SELECT DISTINCT id FROM docs)), preparation))")
def w02_numbers(spark, d):
    """Document numbers in order of digests within each split."""
    key = F.col("id").cast("string")
    rows = table(spark, d, "docs").select("id").distinct().select("id", X.digest(key).alias("content_sha256"), preparation.hash_split(key, _settings(spark, d)).alias("split"))
    return preparation.numbered(rows).select("id", "split", "doc_number")


_ROW = 1024


def _token_lengths(spark, d):
    """Documents in order of digests of their ids, with a length each."""
    rows = _documents(spark, d).select("doc_id", X.digest(F.col("doc_id").cast("string")).alias("content_sha256"), F.lit("all").alias("split"), F.coalesce(F.length("text"), F.lit(0)).alias("n_tokens"))
    return preparation.numbered(rows).select("doc_number", "n_tokens")


_WALK = f"""WITH RECURSIVE x AS (SELECT row_number() OVER (ORDER BY sha256(CAST(doc_id AS VARCHAR))) - 1 AS doc_number, coalesce(length(text), 0) AS n FROM documents),
w AS (SELECT doc_number, n, row_number() OVER (ORDER BY doc_number) AS k, CASE WHEN n > {_ROW} THEN CAST(ceil((n - {_ROW}) / ({_ROW} - 1)) AS BIGINT) ELSE 0 END AS c FROM x WHERE n >= 2),
s(k, doc_number, n, c, first_row, first_at, row, pos) AS (
  SELECT CAST(0 AS BIGINT), CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT)
  UNION ALL
  SELECT k, doc_number, n, c, r, p, CASE WHEN f = {_ROW} THEN r + c + 1 ELSE r + c END, CASE WHEN f = {_ROW} THEN 0 ELSE f END FROM (
    SELECT *, CASE WHEN c > 0 THEN 0 ELSE p END + n - c * ({_ROW} - 1) AS f FROM (
      SELECT w.k, w.doc_number, w.n, w.c, CASE WHEN s.pos > 0 AND s.pos + w.n > {_ROW} THEN s.row + 1 ELSE s.row END AS r, CASE WHEN s.pos > 0 AND s.pos + w.n > {_ROW} THEN 0 ELSE s.pos END AS p
      FROM s JOIN w ON w.k = s.k + 1)))
"""


@query(_WALK + f"""SELECT doc_number, CAST(i AS INTEGER) AS chunk, first_row + i AS row_number, CAST(CASE WHEN i = 0 THEN first_at ELSE 0 END AS INTEGER) AS "at", CAST(i * ({_ROW} - 1) AS INTEGER) AS start,
CAST(CASE WHEN i < c THEN {_ROW} ELSE n - c * ({_ROW} - 1) END AS INTEGER) AS n FROM (SELECT *, unnest(range(0, c + 1)) AS i FROM s WHERE k > 0)""")
def k01_layout(spark, d):
    """Next-fit layout of all documents in rows of 1,024 (one token a character)."""
    return packing.layout(_token_lengths(spark, d), _ROW, block=300)


@query("SELECT CAST(sum(n - 1) AS BIGINT) AS targets FROM (SELECT length(text) AS n FROM documents) WHERE n >= 2")
def a06_valid_targets(spark, d):
    """Targets of all packed rows: neighbours of one document, whatever the rows' borders."""
    numbered = preparation.numbered(_documents(spark, d).select("doc_id", "text", X.digest(F.col("doc_id").cast("string")).alias("content_sha256"), F.lit("all").alias("split")))
    tokens = numbered.select("doc_number", F.transform(corpus.letters(F.coalesce("text", F.lit(""))), lambda c: F.ascii(c)).alias("ids"))
    kept = Scratch(spark, "tokens").keep(tokens, "ids")
    rows = packing.packed_rows(packing.layout(kept.select("doc_number", F.size("ids").alias("n_tokens")), _ROW), kept, _ROW, 0)
    return rows.agg(F.sum(packing.valid_targets(F.col("document_ids"), F.col("attention_mask"))).alias("targets"))


@query()
def k03_packed(spark, d):
    """The clean training records encoded and packed in rows of 1,024."""
    clean = prepared(spark, d).clean.where("split = 'train'")
    return pack.pack_split(clean, "train", "byte_bpe_50k", _ROW, 50256, 50256, 50256).select("row_number", "input_ids", "document_ids")


@query(f"SELECT row_number() OVER (ORDER BY digest) - 1 AS doc_number, text FROM (SELECT sha256(g) AS digest, text, {_SPLIT} AS split FROM (SELECT g, text, test_ratio, validation_ratio, {_BUCKET} AS b FROM (SELECT CAST(doc_id AS VARCHAR) AS g, text FROM documents WHERE text IS NOT NULL), preparation)) WHERE split = 'train'")
def k03_unpacked(spark, d):
    """The documents of one split encoded, packed in rows of 1,024, taken out of them and decoded again."""
    key = F.col("doc_id").cast("string")
    texts = _spread(spark, d).where("text is not null").select(X.digest(key).alias("content_sha256"), preparation.hash_split(key, _settings(spark, d)).alias("split"), "text")
    rows = pack.pack_split(texts.where("split = 'train'"), "train", "byte_bpe_50k", _ROW, 50256, 50256, 50256)
    ids = packing.unpacked(rows).select("doc_number", F.slice("ids", 2, F.size("ids") - 2).alias("ids"))  # without the signs of beginning and end
    return ids.select("doc_number", corpus.decoder("byte_bpe_50k")(F.col("ids")).alias("text"))


@query("SELECT record_id, ordinal FROM (SELECT record_id, doc_id AS ordinal FROM documents, preparation WHERE list_contains(allowed_licenses, license) AND coalesce(record_id, '') <> '' AND coalesce(source, '') <> '' AND coalesce(domain, '') <> '' ORDER BY doc_id LIMIT 50)")
def k08_first_kept(spark, d):
    """The first fifty records that provenance lets pass."""
    passed = _records(spark, d).withColumn("reason", preparation.provenance_reason(_settings(spark, d)))
    return pack.first_kept(passed, 50).select(F.col("id").alias("record_id"), "ordinal")


@query("SELECT doc_id, CASE WHEN n < 2 THEN 0 ELSE CAST(ceil((n - 1) / 63) AS INTEGER) END AS chunks, CAST(CASE WHEN n < 2 THEN 0 ELSE n - 1 END AS BIGINT) AS scored FROM (SELECT doc_id, coalesce(length(text), 0) AS n FROM documents)")
def m03_chunks(spark, d):
    """Windows of 64 in which a text is scored (one token a character), and the neighbours they score."""
    ids = F.transform(corpus.letters(F.coalesce("text", F.lit(""))), lambda c: F.lit(1))
    chunks = _documents(spark, d).select("doc_id", pack.text_chunks(ids, 64).alias("c"))
    return chunks.select("doc_id", F.size("c").alias("chunks"), F.aggregate("c", F.lit(0).cast("bigint"), lambda a, x: a + F.size(x) - 1).alias("scored"))


@query("SELECT s AS split, count(*) FILTER (split = s) AS rows, count(*) FILTER (split IS DISTINCT FROM s) > 0 AS refused FROM docs, (VALUES ('train'), ('val'), ('test')) v(s) GROUP BY s")
def f09_split_guard(spark, d):
    """The guard of each split: how many records of that split pass it, and whether it refuses the whole table, which has others."""
    docs, rows = table(spark, d, "docs"), []
    for split in ("train", "val", "test"):
        passed = pack.only_split(docs.where(F.col("split") == split), split).count()
        try:
            pack.only_split(docs, split).select("id").write.format("noop").mode("overwrite").save()
            refused = False
        except Exception as problem:
            refused = "not of split" in str(problem)
        rows.append((split, passed, refused))
    return spark.createDataFrame(rows, "split string, rows bigint, refused boolean")


@query("SELECT count(*) AS documents, CAST(sum(CAST('0x' || substr(sha256(strlen(text) || ':' || text), 1, 15) AS BIGINT)) AS VARCHAR) AS digest FROM documents WHERE text IS NOT NULL")
def t07_corpus_digest(spark, d):
    """The order-free digest of the corpus."""
    return pack.corpus_digest(_documents(spark, d)).select("documents", F.col("digest").cast("string").alias("digest"))


@query("""WITH n AS (SELECT count(*)::BIGINT AS n FROM docs), h AS (SELECT e, n, list_transform(string_split(sha256('42:' || e), ''), lambda c: (strpos('0123456789abcdef', c) - 1)::BIGINT) AS digits FROM range(2) t(e), n),
f AS (SELECT e, n, list_reduce(digits, lambda a, x: (a * 16 + x) % n) AS r, list_reduce(digits, lambda a, x: (a * 16 + x) % (n * n)) // n AS shift FROM h),
s AS (SELECT e, n, shift, list_filter(range(greatest(r, 1), greatest(r, 1) + 2000), lambda s: gcd(s, n) = 1)[1] AS stride FROM f)
SELECT e * n + c AS cursor, (stride % n * c + shift) % n AS row FROM s, LATERAL (SELECT unnest(range(n)) AS c)""")
def k04_epoch_order(spark, d):
    """Which record each of two epochs' cursors reads."""
    n = table(spark, d, "docs").count()
    return packing.epoch_order(spark.range(2 * n).withColumnRenamed("id", "cursor"), n, 42)


@query("SELECT i AS batch, list(c ORDER BY c) AS rows FROM (SELECT id AS c, id // 64 AS i FROM (SELECT DISTINCT id FROM docs)) GROUP BY i")
def k06_batches(spark, d):
    """Records in lots of 64 by id."""
    rows = table(spark, d, "docs").select("id").distinct()
    return packing.batches(rows.select(F.col("id").alias("cursor"), F.col("id").alias("row")), 64)


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place FROM events")
def w04_positions(spark, d):
    """Places that begin again with each user: events packed to one row a user."""
    packed = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("ids"))
    ids = packed.select("user_id", "ids", packing.position_ids(F.transform("ids", lambda x: F.col("user_id"))).alias("places"))
    return ids.select("user_id", F.explode(F.arrays_zip("ids", "places")).alias("z")).select("user_id", F.col("z.ids").alias("event_id"), F.col("z.places").cast("bigint").alias("place"))


@query("SELECT event_type AS run, event_id AS step, sum(user_id) OVER w AS tokens_seen, min(value) OVER w AS best_ce, event_id % 10 = 0 OR event_id = max(event_id) OVER (PARTITION BY event_type) AS measured FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def w05_log_totals(spark, d):
    """Running totals of a log, here the events by type."""
    log = table(spark, d, "events").select(F.col("event_type").alias("run"), F.col("event_id").alias("step"), F.col("user_id").cast("decimal(28,0)").alias("tokens"), F.col("value").alias("validation_ce"))
    return evaluation.log_totals(log)


@query("SELECT id, CAST(list_position(s, list_max(s)) - 1 AS INTEGER) AS predicted FROM (SELECT id, list_transform(choices, lambda c: length(c)) AS s FROM suite WHERE type = 'multiple_choice')")
def k09_first_best(spark, d):
    """The first of the best choices, scored by length."""
    return table(spark, d, "suite").where("type = 'multiple_choice'").select("id", evaluation.first_best(F.transform("choices", lambda c: F.length(c))).alias("predicted"))


# ---- sets ---------------------------------------------------------------------------------------------------------------------


@query("SELECT DISTINCT digest FROM docs WHERE split = 'train' AND digest IN (SELECT digest FROM docs WHERE split <> 'train')")
def u01_split_overlap(spark, d):
    """Digests that lie in train and in another split."""
    docs = table(spark, d, "docs")
    return evaluation.overlap(docs.where("split = 'train'"), docs.where("split <> 'train'"), "digest")


@query("SELECT count(DISTINCT payload) AS shared, count(*) > 0 AS refused FROM docs WHERE split = 'train' AND payload IN (SELECT payload FROM docs WHERE split <> 'train')")
def u02_prompt_overlap(spark, d):
    """Payloads that train shares with the other splits, and the refusal of such splits."""
    docs = table(spark, d, "docs")
    train, others = docs.where("split = 'train'"), docs.where("split <> 'train'")
    try:
        evaluation.refuse_overlap(train, others, "payload")
        refused = False
    except ValueError:
        refused = True
    return evaluation.overlap(train, others, "payload").agg(F.count("*").alias("shared"), F.lit(refused).alias("refused"))


@query("SELECT 'text-' || record_id AS id, 'text' AS type, domain, text, NULL AS prompt FROM documents WHERE domain = 'traffic' UNION ALL SELECT id, type, domain, NULL, prompt FROM suite WHERE type = 'generation'")
def u03_suite(spark, d):
    """A suite of the traffic documents and the prompts for generation."""
    return evaluation.suite_from(_documents(spark, d).where("domain = 'traffic'").select(F.col("record_id").alias("id"), "domain", "text"), table(spark, d, "suite").where("type = 'generation'").select("id", "type", "domain", "prompt"))


@query("SELECT coalesce(a.source, b.source) AS source, CASE WHEN b.source IS NULL THEN 'before' ELSE 'after' END AS side FROM (SELECT DISTINCT source FROM sources WHERE source IS NOT NULL) a FULL JOIN (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL) b ON a.source = b.source WHERE a.source IS NULL OR b.source IS NULL")
def u04_uneven_sources(spark, d):
    """Sources that only the list or only the corpus has."""
    return evaluation.uneven_keys(table(spark, d, "sources").where("source is not null"), _documents(spark, d).where("source is not null"), "source")


# ---- evaluation ---------------------------------------------------------------------------------------------------------------

_SCORED = "(SELECT domain, n_chars * 0.5 AS nll, n_chars AS tokens, strlen(text) AS utf8_bytes FROM documents WHERE text <> '')"
_TEXT_REPORT = f"SELECT *, nll / tokens AS ce, exp(nll / tokens) AS perplexity, nll / (utf8_bytes * ln(2)) AS bits_per_byte FROM (SELECT coalesce(domain, 'korean_general') AS domain, sum(nll) AS nll, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(utf8_bytes) AS BIGINT) AS utf8_bytes FROM {_SCORED} GROUP BY 1)"


def _scored(spark, d):
    return _documents(spark, d).where("text <> ''").select("domain", (F.col("n_chars") * 0.5).alias("nll"), F.col("n_chars").alias("tokens"), F.octet_length("text").cast("bigint").alias("utf8_bytes"))


@query(_TEXT_REPORT)
def a07_text_metrics(spark, d):
    """Cross-entropy, perplexity and bits per byte by domain, each character costing half a nat."""
    return evaluation.text_metrics(_scored(spark, d))


_FOLD = r"regexp_replace(lower(nfc_normalize(%s)), '[\s\p{Z}\x0b\x{85}\x1c-\x1f\p{P}]', '', 'g')"
_ANSWERED = f"(SELECT id, domain, type, prompt, {_FOLD % 'a'} AS g, {_FOLD % 'prompt'} AS p FROM (SELECT id, domain, type, prompt, unnest(answers) AS a FROM suite WHERE type = 'qa') WHERE a IS NOT NULL)"
_ANSWER_SCORES = f"""SELECT id, any_value(domain) AS domain, max(CASE WHEN p = g THEN 1.0 ELSE 0.0 END)::DOUBLE AS exact_match, max(CASE WHEN length(p) + length(g) = 0 THEN 1.0::DOUBLE ELSE 2 * common / (length(p) + length(g)) END) AS character_f1 FROM (
SELECT *, coalesce(list_sum(list_transform(list_distinct(string_split(p, '')), lambda c: least(length(p) - length(replace(p, c, '')), length(g) - length(replace(g, c, ''))))), 0) AS common FROM {_ANSWERED}) GROUP BY id"""


@query(f"SELECT id, exact_match, character_f1 FROM ({_ANSWER_SCORES})")
def m01_answer_scores(spark, d):
    """Prompts held against the reference answers as if they were predictions."""
    return evaluation.answer_scores(table(spark, d, "suite").where("type = 'qa'").select("id", F.col("prompt").alias("prediction"), "answers"))


def _repeats(source: str, key: str, text: str) -> str:
    """SQL: (key, repetition) of texts."""
    return f"SELECT x.{key}, CASE WHEN length(x.{text}) < 4 THEN 0.0::DOUBLE ELSE 1 - n::DOUBLE / (length(x.{text}) - 3) END AS repetition FROM {source} x LEFT JOIN (SELECT {key}, count(*) AS n FROM ({_grams(source, key, text, 4, False)}) GROUP BY {key}) y USING ({key})"


@query(f"WITH t AS (SELECT doc_id, text FROM documents WHERE text <> '') {_repeats('t', 'doc_id', 'text')}")
def m02_repetition(spark, d):
    """Share of repeated 4-grams in each document."""
    return _documents(spark, d).where("text <> ''").select("doc_id", X.repetition(F.col("text")).alias("repetition"))


_RESULTS = f"""(SELECT s.id, coalesce(s.domain, 'korean_general') || ':' || s.type AS task, s.type,
 CASE WHEN s.type = 'multiple_choice' THEN (list_position(list_transform(choices, lambda c: length(c)), list_max(list_transform(choices, lambda c: length(c)))) - 1 = answer_index)::INT::DOUBLE END AS correct,
 r.exact_match, r.character_f1, z.repetition, (prompt LIKE '%.')::INT::DOUBLE AS eos
 FROM suite s LEFT JOIN ({_ANSWER_SCORES}) r ON s.id = r.id LEFT JOIN ({_repeats("(SELECT id, prompt FROM suite WHERE prompt IS NOT NULL)", "id", "prompt")}) z ON s.id = z.id WHERE s.type <> 'text')"""


def _results(spark, d):
    suite = table(spark, d, "suite")
    best = evaluation.first_best(F.transform("choices", lambda c: F.length(c)))
    base = suite.select("id", "type", "domain", F.when(F.col("type") == "multiple_choice", best == F.col("answer_index")).alias("correct"), X.repetition(F.col("prompt")).alias("repetition"), F.col("prompt").endswith(".").alias("eos"))
    return base.join(m01_answer_scores(spark, d), "id", "left")


@query(f"""SELECT s.id, s.type, coalesce(s.domain, 'korean_general') AS domain, CASE WHEN s.type = 'text' THEN length(text) * 0.5 END::DOUBLE AS nll, CASE WHEN s.type = 'text' THEN length(text) END AS tokens, CASE WHEN s.type = 'text' THEN strlen(text) END AS utf8_bytes,
CASE WHEN s.type = 'multiple_choice' THEN list_position(list_transform(choices, lambda c: length(c)), list_max(list_transform(choices, lambda c: length(c)))) - 1 END::INTEGER AS predicted_index,
CASE WHEN s.type = 'multiple_choice' THEN list_position(list_transform(choices, lambda c: length(c)), list_max(list_transform(choices, lambda c: length(c)))) - 1 = answer_index END AS correct,
CASE WHEN s.type IN ('qa', 'generation') THEN prompt LIKE '%.' END AS eos, CASE WHEN s.type IN ('qa', 'generation') THEN z.repetition END AS repetition, r.exact_match, r.character_f1
FROM suite s LEFT JOIN ({_ANSWER_SCORES}) r ON s.id = r.id LEFT JOIN ({_repeats("(SELECT id, prompt FROM suite WHERE prompt IS NOT NULL)", "id", "prompt")}) z ON s.id = z.id""")
def m05_suite(spark, d):
    """The suite evaluated by types: half a nat a character, choices scored by length, prompts given back as predictions."""
    suite = table(spark, d, "suite")
    half = suite.where("type = 'text'").select("id", F.explode(F.array(F.floor(F.length("text") / 2), F.length("text") - F.floor(F.length("text") / 2))).alias("tokens"))
    windows = half.select("id", (F.col("tokens") * 0.5).alias("nll"), "tokens")
    choices = suite.where("type = 'multiple_choice'").select("id", F.posexplode("choices").alias("choice", "c")).select("id", "choice", F.length("c").cast("double").alias("score"))
    made = suite.where("prompt is not null").select("id", F.col("prompt").alias("prediction"), F.col("prompt").endswith(".").alias("eos"))
    return evaluation.suite_predictions(suite, windows, choices, made).drop("scores", "prediction")


@query(f"""SELECT task, count(*) AS count, avg(correct) FILTER (type = 'multiple_choice') AS accuracy, avg(exact_match) FILTER (type = 'qa') AS exact_match, avg(character_f1) FILTER (type = 'qa') AS character_f1,
avg(repetition) FILTER (type IN ('qa', 'generation')) AS mean_repetition, avg(eos) FILTER (type IN ('qa', 'generation')) AS eos_rate FROM {_RESULTS} GROUP BY task""")
def a08_task_metrics(spark, d):
    """Accuracy, exact match, character F1, repetition and end rate by domain and task."""
    return evaluation.task_metrics(_results(spark, d))


@query(f"SELECT type, avg(e) AS macro FROM (SELECT type, task, avg(eos) AS e FROM {_RESULTS} WHERE type IN ('qa', 'generation') GROUP BY type, task) GROUP BY type")
def b07_macro(spark, d):
    """Macro average of the end rates over domains, by type of task."""
    return evaluation.macro_average(a08_task_metrics(spark, d), "eos_rate")


@query(f"""SELECT 'text' AS section, domain AS key, metric, before, before * 0.5 AS after, before * 0.5 - before AS delta FROM (SELECT domain, unnest(['bits_per_byte']) AS metric, bits_per_byte AS before FROM ({_TEXT_REPORT}))""")
def m06_compare(spark, d):
    """Two reports, the second with half of every value, under different tokenizers: only bits per byte may be compared."""
    none = spark.createDataFrame([], "task string, " + ", ".join(f"{m} double" for m in evaluation.TASK_METRICS))
    before = evaluation.long_report(a07_text_metrics(spark, d), none)
    return evaluation.compare_reports(before, before.withColumn("value", F.col("value") * 0.5), same_tokenizer=False)


@query("SELECT 1.0::DOUBLE AS mean, 1.0::DOUBLE AS low, 1.0::DOUBLE AS high")
def b07_bootstrap(spark, d):
    """Interval of the mean difference between two values of each event; all differ by one, so every round must say so."""
    rows = table(spark, d, "events").where("value is not null").select(F.col("event_id").alias("id"), F.lit(1.0).alias("before"), F.lit(2.0).alias("after"))
    return evaluation.bootstrap_interval(rows, rounds=50)


@query("SELECT event_type, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95 FROM events GROUP BY event_type")
def b08_latency(spark, d):
    """Median and 95th percentile of the events' values."""
    return evaluation.latency(table(spark, d, "events"), "value", "event_type")


@query("""SELECT id, 'repeated id' AS problem FROM suite WHERE type = 'text' UNION ALL SELECT id, 'repeated id' FROM suite WHERE type = 'text' UNION ALL SELECT id || '/a', 'no answers' FROM suite WHERE type = 'qa'
UNION ALL SELECT id || '/i', 'answer index' FROM suite WHERE type = 'multiple_choice' UNION ALL SELECT id || '/p', 'empty prompt' FROM suite WHERE type = 'generation' UNION ALL SELECT id || '/t', 'unknown type' FROM suite WHERE type = 'generation'
UNION ALL SELECT NULL, 'missing id' FROM suite WHERE type = 'generation'""")
def a10_suite_problems(spark, d):
    """Items that an evaluation would not accept, in the suite with spoiled copies of its items beside it."""
    suite = table(spark, d, "suite")
    spoiled = lambda kind, end, **changes: suite.where(F.col("type") == kind).withColumn("id", F.concat("id", F.lit(end))).withColumns(changes)
    parts = [
        suite.where("type = 'text'"), spoiled("qa", "/a", answers=F.lit(None).cast("array<string>")), spoiled("multiple_choice", "/i", answer_index=F.lit(99)), spoiled("generation", "/p", prompt=F.lit("")),
        spoiled("generation", "/t", type=F.lit("essay")), spoiled("generation", "", id=F.lit(None).cast("string")),
    ]
    for part in parts:
        suite = suite.unionByName(part)
    return evaluation.suite_problems(suite)


_PLANS = [("small", 1_000_000_000, 10_000.0, 1.3, 1, 0.5, 1.0, 2.0, 3.0), ("slow", 1_000_000_000, 1_000.0, 1.0, 8, 2.0, 0.0, 0.0, 0.0)]
_PLAN_NAMES = "plan string, tokens bigint, tokens_per_second double, margin double, devices int, hourly_rate double, storage double, transfer double, preparation double"


@query("SELECT p AS plan, t / s / 3600 AS training_hours, t / s / 3600 * m AS run_hours, r * n * (t / s / 3600 * m) AS device_cost, r * n * (t / s / 3600 * m) + a + b + c AS total_cost FROM (SELECT p, t::DOUBLE AS t, s::DOUBLE AS s, m::DOUBLE AS m, n, r::DOUBLE AS r, a::DOUBLE AS a, b::DOUBLE AS b, c::DOUBLE AS c FROM (VALUES " + ", ".join(str(p) for p in _PLANS) + ") t(p, t, s, m, n, r, a, b, c))")
def b10_cost(spark, d):
    """Hours and cost of two plans of training."""
    return evaluation.cost(spark.createDataFrame(_PLANS, _PLAN_NAMES))


_CONFIGS = [("base", 32000, 24, 1024, 16, 8, 64, 2816, "headwise", True), ("debug", 32000, 8, 512, 8, 4, 64, 1408, "headwise", True), ("untied", 50257, 12, 768, 12, 12, 64, 3072, "none", False)]
_CONFIG_NAMES = "profile string, vocab_size bigint, num_hidden_layers bigint, hidden_size bigint, num_attention_heads bigint, num_key_value_heads bigint, head_dim bigint, intermediate_size bigint, qk_norm string, tie_word_embeddings boolean"
_CONFIG_SQL = "(VALUES " + ", ".join(str(c) for c in _CONFIGS) + ") t(profile, v, l, d, q, k, h, f, norm, tied)"


@query(f"""SELECT profile, parameters, 16 * parameters / 1073741824 AS training_state_gib, 2 * parameters / 1073741824 AS weights_gib, 2 * l * 1 * 1024 * k * h * 2 / 1073741824 AS kv_gib, CAST(8192 AS BIGINT) AS tokens_per_update,
CAST(12208 AS BIGINT) AS updates, 6.0::DOUBLE * parameters * 100000000 AS flops, 100000000 / 17000.0::DOUBLE / 3600 AS hours FROM (SELECT *, CAST(v * d * CASE WHEN tied THEN 1 ELSE 2 END + l * (2 * d * q * h + 2 * d * k * h + 3 * d * f + 2 * d + CASE WHEN norm <> 'none' THEN 2 * h ELSE 0 END) + d AS BIGINT) AS parameters FROM {_CONFIG_SQL})""")
def m08_budget(spark, d):
    """Sizes and durations of a training run for three configurations."""
    return evaluation.budget(spark.createDataFrame(_CONFIGS, _CONFIG_NAMES), 100_000_000, 1, 1024, 8, 17_000.0)


@query("SELECT step, CASE WHEN step < 10 THEN (step + 1) / 10 ELSE 0.1::DOUBLE + 0.9 * 0.5 * (1 + cos(pi() * least(1.0::DOUBLE, (step - 10) / 989))) END AS multiplier FROM range(0, 1000) t(step)")
def m10_learning_rate(spark, d):
    """Warm-up and cosine over a thousand steps."""
    return evaluation.learning_rate(spark.range(1000).withColumnRenamed("id", "step"), 1000)


@query("SELECT user_id AS step, sum(value) / sum(event_id) AS ce FROM events WHERE value IS NOT NULL AND event_id > 0 GROUP BY user_id")
def a09_token_weighted(spark, d):
    """Sums before ratios, here of the events' values by user."""
    rows = table(spark, d, "events").where("value is not null and event_id > 0").select(F.col("user_id").alias("step"), F.col("value").alias("ce_sum"), F.col("event_id").cast("decimal(28,0)").alias("tokens"))
    return evaluation.token_weighted(rows).withColumn("ce", F.col("ce").cast("double"))


@query("SELECT id, list_concat([1, 2], list_concat(list_transform(string_split(prompt, ''), lambda c: 9), list_concat([3, 4], list_concat(list_transform(string_split(a, ''), lambda c: 8), [5])))) AS input_ids, list_concat(list_transform(range(0, length(prompt) + 4), lambda i: 0), list_transform(range(0, length(a) + 1), lambda i: 1)) AS loss_mask FROM (SELECT id, prompt, answers[1] AS a FROM suite WHERE type = 'qa') WHERE prompt <> '' AND a <> ''")
def x20_sft_rows(spark, d):
    """Prompt and first answer of each question as a training row, one id a character."""
    pairs = table(spark, d, "suite").where("type = 'qa'").select("id", "prompt", F.try_element_at("answers", F.lit(1)).alias("a")).where("prompt <> '' and a <> ''")
    ids = pairs.select("id", F.transform(corpus.letters(F.col("prompt")), lambda c: F.lit(9)).alias("prompt_ids"), F.transform(corpus.letters(F.col("a")), lambda c: F.lit(8)).alias("response_ids"))
    return evaluation.sft_rows(ids, 1, 2, 3, 4, 5, limit=1_000_000)


_DAYS = "(SELECT user_id AS row, CAST(ts AS DATE) AS document, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place FROM events)"


@query(f"SELECT q.row AS row, q.place AS query, k.place AS key FROM {_DAYS} q JOIN {_DAYS} k ON q.row = k.row AND q.document = k.document AND k.place <= q.place")
def m12_causal_pairs(spark, d):
    """What each event may see: earlier ones of the same user and day."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    rows = table(spark, d, "events").select(F.col("user_id").alias("row"), F.to_date("ts").cast("string").alias("document"), place.cast("bigint").alias("place"))
    return evaluation.causal_pairs(rows)


# ---- corpus reports -------------------------------------------------------------------------------------------------------------


@query(f"""SELECT source, CAST(sum(len(regexp_extract_all(t, '[\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}.+-]+@[\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}.-]+\\.[A-Za-z]{{2,}}'))) AS BIGINT) AS emails,
CAST(sum((length({_PHONE % (_PHONE % (_MAIL % 't'))}) - length(replace({_PHONE % (_PHONE % (_MAIL % 't'))}, '[PHONE]', ''))) // 7 - (length({_MAIL % 't'}) - length(replace({_MAIL % 't'}, '[PHONE]', ''))) // 7) AS BIGINT) AS phones FROM (SELECT source, text AS t FROM documents WHERE text IS NOT NULL) GROUP BY source""")
def b03_contacts(spark, d):
    """E-mail addresses and mobile numbers by source."""
    mails, phones = X.contact_counts(F.col("text"))
    return _documents(spark, d).where("text is not null").groupBy("source").agg(F.sum(mails).alias("emails"), F.sum(phones).alias("phones"))


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256(CAST(doc_id AS VARCHAR)), doc_id) AS r FROM documents) WHERE r <= 100")
def b04_sample(spark, d):
    """A hundred documents of each source."""
    return corpus.stratified_sample(_documents(spark, d).select("source", "doc_id"), "source", "doc_id", 100)


@query("SELECT domain, weight, weight / sum(weight) OVER () AS share, CASE domain WHEN 'korean_general' THEN 0.8 WHEN 'english' THEN 0.1 WHEN 'code' THEN 0.1 ELSE 0.0 END::DOUBLE AS target, weight / sum(weight) OVER () - CASE domain WHEN 'korean_general' THEN 0.8 WHEN 'english' THEN 0.1 WHEN 'code' THEN 0.1 ELSE 0.0 END::DOUBLE AS off FROM (SELECT domain, CAST(sum(n_chars) AS BIGINT) AS weight FROM documents WHERE domain IS NOT NULL GROUP BY domain)")
def b05_mixture(spark, d):
    """Shares of characters by domain against 80, 10 and 10 percent."""
    return corpus.mixture(_documents(spark, d).where("domain is not null"), "domain", "n_chars", {"korean_general": 0.8, "english": 0.1, "code": 0.1})


@query("SELECT source, domain, lang, count(*) AS documents, CAST(sum(length(text)) AS BIGINT) AS characters FROM (SELECT coalesce(source, '(none)') AS source, coalesce(domain, '(none)') AS domain, coalesce(lang, '(none)') AS lang, text FROM documents) GROUP BY ROLLUP (source, domain, lang)")
def b06_composition(spark, d):
    """Documents and characters by source, domain and language with subtotals."""
    return corpus.composition(_documents(spark, d))


@query("SELECT source, count(*) AS rows, avg(n_chars) AS mean, quantile_cont(n_chars, 0.5) AS p50, quantile_cont(n_chars, 0.95) AS p95, avg((n_chars > 1024)::INT) AS truncated FROM documents GROUP BY source")
def b11_lengths(spark, d):
    """Lengths by source and what a limit of 1,024 would cut."""
    return corpus.length_distribution(_documents(spark, d), "n_chars", 1024, "source")


@query(f"""SELECT doc_id, len(l)::INTEGER AS lines, (len(l) - len(list_distinct(l)))::INTEGER AS repeated_lines, len(list_filter(l, lambda x: length(x) < 40 AND regexp_matches(x, '{"|".join(corpus.MENU_WORDS)}')))::INTEGER AS menu_lines,
CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g'))::DOUBLE / length(text) ELSE 0.0 END AS letters_share FROM (SELECT doc_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL)""")
def b02_line_quality(spark, d):
    """Signs of menus and repetition in each document."""
    return corpus.line_quality(_documents(spark, d).where("text is not null"), "doc_id")


@query("SELECT user_id AS conv, event_id AS turn, text AS prompt, answer AS response FROM (SELECT user_id, event_id, event_type AS text, event_id % 3 AS r, lead(event_id % 3) OVER w AS n, lead(event_type) OVER w AS answer FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE r = 0 AND n = 1")
def b12_chat_pairs(spark, d):
    """Turns that are answered next; events play the turns."""
    role = F.when(F.col("event_id") % 3 == 0, "user").when(F.col("event_id") % 3 == 1, "assistant").otherwise("system")
    turns = table(spark, d, "events").select(F.col("user_id").alias("conv"), F.col("event_id").alias("turn"), role.alias("role"), F.col("event_type").alias("text"))
    return corpus.chat_pairs(turns)


# ---- runs -----------------------------------------------------------------------------------------------------------------------


@query("SELECT * FROM (VALUES ('settings', true, ''), ('documents', true, ''), ('suite', true, ''), ('shared folder', true, ''), ('an empty table', false, ''), ('a missing table', false, 'AnalysisException')) t(\"check\", ok, detail)")
def v02_preflight(spark, d):
    """Checks of tables and settings, all reported; two of them must fail."""
    done = stages.preflight(spark, {
        "settings": lambda: _settings(spark, d) is not None, "documents": lambda: not _documents(spark, d).isEmpty(), "suite": lambda: suite_sound(spark, d), "shared folder": lambda: bool(Scratch(spark, "check").root),
        "an empty table": lambda: not _documents(spark, d).where("false").isEmpty(), "a missing table": lambda: table(spark, d, "no_such_table").isEmpty(),
    })
    return done.withColumn("detail", F.regexp_extract("detail", r"^(\w*)", 1))


def suite_sound(spark: SparkSession, d: str) -> bool:
    return evaluation.suite_problems(table(spark, d, "suite")).isEmpty()


# ---- star schema and events: facilities of Spark that the tables make testable --------------------------------------------------------


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, sum(l_extendedprice) AS price, avg(l_discount) AS discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def c01_pricing(spark, d):
    """Sums and means of line items by flag and status."""
    shipped = table(spark, d, "lineitem").where("l_shipdate <= timestamp'1998-09-02'")
    return shipped.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"), F.sum("l_extendedprice").alias("price"), F.avg("l_discount").alias("discount"), F.count("*").alias("n"))


@query("SELECT r_name, n_name, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def c02_revenue_rollup(spark, d):
    """Revenue by region and nation with subtotals over five joined tables."""
    t = lambda n: table(spark, d, n)
    joined = (
        t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return joined.rollup("r_name", "n_name").agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY CUBE (o_orderpriority, o_orderstatus)")
def c03_returned_cube(spark, d):
    """Orders with a returned item by priority and status: a semi join and a cube."""
    returned = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(returned, "o_orderkey", "left_semi").cube("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def c04_idle_customers(spark, d):
    """Customers without an order: an anti join."""
    return table(spark, d, "customer").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("SELECT o_custkey, o_orderkey, k FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 3")
def c05_top_orders(spark, d):
    """The three dearest orders of each customer."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).cast("bigint").alias("k")).where("k <= 3")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS events, sum(value) AS total FROM events GROUP BY 1, 2")
def c06_tumbling(spark, d):
    """Events by hour and type."""
    return streams.tumbling(table(spark, d, "events"))


@query("SELECT w AS start, count(*) AS events FROM (SELECT unnest([time_bucket(INTERVAL '15 minutes', ts) - INTERVAL '45 minutes', time_bucket(INTERVAL '15 minutes', ts) - INTERVAL '30 minutes', time_bucket(INTERVAL '15 minutes', ts) - INTERVAL '15 minutes', time_bucket(INTERVAL '15 minutes', ts)]) AS w FROM events) GROUP BY w")
def c07_sliding(spark, d):
    """Events by overlapping hours."""
    return streams.sliding(table(spark, d, "events"))


@query("SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS finish, count(*) AS events FROM (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL '30 minutes' THEN 0 ELSE 1 END AS n FROM events)) GROUP BY user_id, s")
def c08_sessions(spark, d):
    """Stretches of a user's events without a gap of half an hour."""
    return streams.sessions(table(spark, d, "events"))


@query("SELECT e.event_id, p.event_id AS last_purchase FROM (SELECT * FROM events WHERE event_type <> (SELECT min(event_type) FROM events)) e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY user_id, ts) p ON e.user_id = p.user_id AND e.ts >= p.ts")
def c09_as_of(spark, d):
    """For each event the user's latest event of the first type."""
    events = table(spark, d, "events")
    kind = events.agg(F.min("event_type")).first()[0]
    chosen = events.where(F.col("event_type") == kind).groupBy("user_id", "ts").agg(F.max("event_id").alias("last_purchase")).withColumnRenamed("ts", "at")
    return streams.as_of(events.where(F.col("event_type") != kind).select("event_id", "user_id", "ts"), chosen, "user_id", "ts", "at", "last_purchase").select("event_id", "last_purchase")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS events, sum(value) AS total FROM events GROUP BY 1, 2 HAVING time_bucket(INTERVAL '1 hour', min(ts)) + INTERVAL '1 hour' <= (SELECT max(ts) - INTERVAL '2 hours' FROM events)")
def c10_stream_tumbling(spark, d):
    """The events as a stream through the same windows, appended once the watermark has passed them; the oldest events are delivered again
    after that and must change nothing."""
    scratch = Scratch(spark, "stream")
    events = table(spark, d, "events")
    oldest = events.agg(F.min("ts")).first()[0]
    events.coalesce(1).write.parquet(scratch.root + "/in")  # one file, one batch: what is late does not depend on the order of files
    out, source = scratch.root + "/out", streams.event_stream(spark, scratch.root + "/in", files_per_trigger=1)

    def deliver():
        run = streams.tumbling(source).writeStream.outputMode("append").option("checkpointLocation", scratch.root + "/state").format("parquet").option("path", out).trigger(availableNow=True).start()
        run.awaitTermination()

    deliver()
    events.where(F.col("ts") < F.lit(oldest) + F.expr("interval 1 day")).coalesce(1).write.mode("append").parquet(scratch.root + "/in")
    deliver()
    return spark.read.parquet(out)