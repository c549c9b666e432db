import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from gristmill.operators import duplicates, preparation
from gristmill.operators.components import least_labels
from gristmill.operators.preparation import Settings
from gristmill.plans.prepare import prepare
from gristmill.plans.shared import Scratch
from gristmill.sources import files, records
from gristmill.session import table

SETTINGS = Settings(("cc",), min_chars=5, max_chars=60)
RAW = "id string, source string, license string, domain string, text string, group_id string, content_type string, ordinal bigint"


def raw(spark, rows):
    return spark.createDataFrame([(f"r{i}", "s", "cc", "d", t, g, "text", i) for i, (t, g) in enumerate(rows)], RAW)


def test_reasons(spark):
    texts = ["1234", "12345", "x" * 30, "ab" * 30, "ab" * 30 + "c", "bad � text", "nul \x00 text", "y" * 31, "\n" * 40 + "abcdef", " " * 31 + "abcdef", "😀" * 31, "        ", None, "y" * 30]
    got = preparation.tagged(raw(spark, [(t, None) for t in texts]), SETTINGS)
    by = {r["ordinal"]: r["reason"] for r in got.collect()}
    short, long, broken, repeated = preparation.REASONS[2:]
    assert [by[i] for i in range(len(texts))] == [short, None, None, None, long, broken, broken, repeated, None, repeated, repeated, short, short, None]


def test_provenance_comes_first(spark):
    rows = [("a", "", "cc", "d", "x", None, "text", 0), ("a", "s", "no", None, "x", None, "text", 1), ("a", "s", "no", "d", "x", None, "text", 2), (None, "s", "cc", "d", "x" * 10, None, "text", 3)]
    got = {r["ordinal"]: r["reason"] for r in preparation.tagged(spark.createDataFrame(rows, RAW), SETTINGS).collect()}
    assert got == {0: "missing_provenance", 1: "missing_provenance", 2: "license_not_allowed", 3: "missing_provenance"}


def test_html_code_is_an_error(spark):
    rows = [("a", "s", "cc", "code", "<p>x</p>", None, "html", 0)]
    with pytest.raises(Exception, match="code cannot be HTML"):
        preparation.tagged(spark.createDataFrame(rows, RAW), SETTINGS).collect()
    assert preparation.tagged(spark.createDataFrame(rows, RAW), SETTINGS, "text").first()["text"] == "<p>x</p>"


@pytest.mark.parametrize("bad", [{"allowed_licenses": []}, {"min_chars": 0}, {"min_chars": 9, "max_chars": 8}, {"near_duplicate_jaccard": 0.0}, {"test_ratio": 0.6, "validation_ratio": 0.6}, {"surprise": 1}])
def test_settings_are_checked(bad):
    with pytest.raises(ValueError):
        Settings.strict({"allowed_licenses": ["cc"]} | bad)


def test_copy_bridges_groups(spark):
    done = prepare(raw(spark, [("text number one", "A"), ("another text two", "B"), ("text  number one", "B")]), SETTINGS)
    rows = done.clean.collect()
    assert len(rows) == 2 and len({r["group_id"] for r in rows}) == 1 and len({r["split"] for r in rows}) == 1
    assert sum(r["copies"] for r in rows) == 3 and min(r["content_sha256"] for r in rows) == rows[0]["group_id"]
    assert done.clean.where("ordinal = 2").isEmpty()
    assert {r["counter"]: r["value"] for r in done.counters().collect()}["exact_duplicates_removed"] == 1
    assert duplicates.torn_groups(done.clean).isEmpty()


def test_nfc_forms_are_copies_and_text_stays(spark):
    done = prepare(raw(spark, [("résumé text", None), ("résumé text", None)]), SETTINGS)
    assert [r["text"] for r in done.clean.collect()] == ["résumé text"]


def test_near_pairs_equal_brute_force(spark):
    drawn = random.Random(5)
    base = ["".join(drawn.choice("abcdefg ") for _ in range(drawn.randint(3, 120))) for _ in range(60)]
    texts = list(dict.fromkeys(base + [t[: len(t) - drawn.randint(0, 6)] + "zq"[: drawn.randint(0, 2)] for t in base] + ["ab", "abc", "abcd"]))
    sets = [{t[i : i + 5] for i in range(max(1, len(t) - 4))} for t in texts]
    digests = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
    for threshold in (0.5, 0.85, 1.0):
        want = {}
        for i in range(len(texts)):
            for j in range(len(texts)):
                s = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
                if digests[i] < digests[j] and s >= threshold:
                    want[digests[i], digests[j]] = s
        df = spark.createDataFrame(list(zip(digests, texts)), "digest string, key string")
        for found in (duplicates.near_pairs(df, threshold, Scratch(spark, "t")), duplicates.prefix_pairs(df, threshold, Scratch(spark, "t"))):
            assert {(r["a"], r["b"]): r["jaccard"] for r in found.collect()} == pytest.approx(want)


@pytest.fixture(scope="module")
def phrases(spark):
    """Many texts of few phrases: any two share shingles, hardly any two are alike; among them copies and edits of some."""
    drawn = random.Random(11)
    words = ["".join(drawn.choice("abcdefghijklmnop") for _ in range(9)) for _ in range(60)]
    texts = [" ".join(drawn.choice(words) for _ in range(drawn.randint(4, 30))) for _ in range(700)]
    texts += [t[:-3] + "zq" for t in texts[:40]] + texts[:20]
    folder = Scratch(spark, "phrases").root
    spark.createDataFrame([(hashlib.sha256(t.encode()).hexdigest(), t) for t in texts], "digest string, key string").write.parquet(folder)
    shingles = {hashlib.sha256(t.encode()).hexdigest(): {t[i : i + 5] for i in range(len(t) - 4)} for t in texts}
    alike = {(a, b) for a, x in shingles.items() for b, y in shingles.items() if a < b and len(x & y) >= 0.85 * len(x | y)}
    assert len(alike) >= 40
    return spark.read.parquet(folder), alike


class Written(Scratch):
    """Counts the rows of what is kept."""

    def keep(self, df, name="t", **how):
        kept = super().keep(df, name, **how)
        self.rows = getattr(self, "rows", {}) | {name: kept.count()}
        return kept


def test_lossless_pairs_list_hardly_any_other(spark, phrases):
    texts, alike = phrases
    scratch = Written(spark, "t")
    assert {(r["a"], r["b"]) for r in duplicates.prefix_pairs(texts, 0.85, scratch).collect()} == alike
    assert len(alike) <= scratch.rows["pairs"] < 3 * len(alike) and "shingles" not in scratch.rows


def test_banded_pairs_are_the_candidates_that_are_alike(spark, phrases):
    texts, alike = phrases
    candidates = {(r["a"], r["b"]) for r in duplicates.banded_candidates(texts.distinct(), 0.85).collect()}
    scratch = Written(spark, "t")
    assert len(candidates) > 100 * len(alike)
    assert {(r["a"], r["b"]) for r in duplicates.banded_pairs(texts, 0.85, scratch).collect()} == candidates & alike
    assert scratch.rows["pairs"] < 3 * len(alike)


def grouped(texts, pairs):
    root = {t: t for t in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {t: find(t) for t in texts}


@pytest.mark.parametrize("dense", [1, 3, 64])
@pytest.mark.parametrize("seed", [1, 2])
def test_near_links_make_the_same_groups(spark, dense, seed):
    """Chains of edits, of which the ends are not alike, in buckets larger than what is compared pair by pair."""
    drawn = random.Random(seed)
    texts = []
    for _ in range(5):
        t = "".join(drawn.choice("abcdefghij klmnop") for _ in range(120))
        for _ in range(25):
            texts.append(t)
            at = drawn.randrange(len(t))
            t = t[:at] + drawn.choice("xyz") + t[at + 1 :]
    texts = list(dict.fromkeys(texts))
    digests = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
    df = spark.createDataFrame(list(zip(digests, texts)), "digest string, key string")
    every = {(r["a"], r["b"]) for r in duplicates.near_pairs(df, 0.85, Scratch(spark, "t")).collect()}
    some = [(r["a"], r["b"]) for r in duplicates.near_links(df, 0.85, Scratch(spark, "t"), dense=dense).collect()]
    assert set(some) <= every and grouped(digests, every) == grouped(digests, some)


def test_a_hundred_thousand_near_copies(spark, monkeypatch):
    """All alike but for a number at the end: 5 * 10^9 pairs, of which only a few for each text may be made."""
    text = "One and the same notice is printed on every ticket that is sold at the counter of the old ferry, whoever buys it, in number "
    df = spark.range(100_000).select(F.sha2(F.col("id").cast("string"), 256).alias("digest"), F.concat(F.lit(text), F.col("id").cast("string")).alias("key"))
    made = []
    verified = duplicates._Near.verified

    def counted(self, pairs, name):
        kept = self.scratch.keep(pairs, f"counted-{name}")
        made.append(kept.count())
        return verified(self, kept, name)

    monkeypatch.setattr(duplicates._Near, "verified", counted)
    scratch = Scratch(spark, "t")
    links = scratch.keep(duplicates.near_links(df, 0.85, scratch), "links")
    # In each of the 28 bands a text is compared with the least of its bucket at most, or with all of a small one.
    assert sum(made) < 40 * 100_000 and links.count() < 40 * 100_000, made
    assert least_labels(links, scratch).agg(F.count_distinct("label"), F.count("*")).first() == (1, 100_000)


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(150)], [(0, i) for i in range(1, 60)], [(3, 1), (1, 3), (5, 4), (4, 9), (9, 1)]])
def test_least_labels(spark, edges):
    got = {r["node"]: r["label"] for r in least_labels(spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark, "t")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert got == {n: find(n) for n in root}


def test_hash_split_is_the_sha_bucket(spark):
    groups = [f"g{i}" for i in range(300)]
    got = {r["g"]: r["s"] for r in spark.createDataFrame([(g,) for g in groups], "g string").select("g", preparation.hash_split(F.col("g"), SETTINGS).alias("s")).collect()}
    for g in groups:
        bucket = int(hashlib.sha256(f"42:{g}".encode()).hexdigest()[:16], 16) / 2**64
        assert got[g] == ("test" if bucket < 0.02 else "validation" if bucket < 0.04 else "train")


def test_numbers_follow_digests(spark):
    rows = [(hashlib.sha256(str(i).encode()).hexdigest(), "ab"[i % 2]) for i in range(500)]
    got = preparation.numbered(spark.createDataFrame(rows, "content_sha256 string, split string")).collect()
    for s in "ab":
        ordered = [r["content_sha256"] for r in sorted((r for r in got if r["split"] == s), key=lambda r: r["doc_number"])]
        assert ordered == sorted(ordered) and sorted(r["doc_number"] for r in got if r["split"] == s) == list(range(250))


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "text": "x", "extra": [1]}\n\n{"id": "2"}\n', encoding="utf-8")
    (tmp_path / "b.jsonl").write_text('{"id": "3"}\n', encoding="utf-8")
    got = records.scan_jsonl(spark, [str(tmp_path / "b.jsonl"), str(tmp_path / "a.jsonl")]).orderBy("ordinal").collect()
    assert [r["id"] for r in got] == ["3", "1", "2"] and json.loads(got[1]["raw"])["extra"] == [1]
    for bad in ("not json\n", "[1]\n", '{"id": \n'):
        (tmp_path / "c.jsonl").write_text(bad, encoding="utf-8")
        with pytest.raises(Exception, match="not a JSON object"):
            records.scan_jsonl(spark, str(tmp_path / "c.jsonl")).collect()


def test_sinks(spark, tmp_path):
    clean = spark.createDataFrame([("b", "train"), ("a", "train"), ("c", "test")], "content_sha256 string, split string")
    records.write_splits(clean, str(tmp_path / "out"))
    assert [r[0] for r in spark.read.parquet(str(tmp_path / "out/split=train")).collect()] == ["a", "b"]
    with pytest.raises(Exception, match="(?i)already exists"):
        records.write_splits(clean, str(tmp_path / "out"))
    records.write_report(str(tmp_path / "r.json"), {"a": 1})
    assert json.loads((tmp_path / "r.json").read_text()) == {"a": 1}
    with pytest.raises(ValueError):
        records.write_report(str(tmp_path / "n.json"), {"a": float("nan")})
    assert not (tmp_path / "n.json").exists()
    with pytest.raises(ValueError):
        records.inside(str(tmp_path), "../x")
    assert files.checksums(spark, str(tmp_path / "r.json")).first()["sha256"] == hashlib.sha256((tmp_path / "r.json").read_bytes()).hexdigest()


def test_whole_preparation(spark, data):
    done = prepare(records.raw_records(table(spark, data, "documents")), Settings.of(table(spark, data, "preparation")))
    counted = {r["counter"]: r["value"] for r in done.counters().collect()}
    kept = done.clean.count()
    assert counted["input"] == table(spark, data, "documents").count()
    assert sum(v for k, v in counted.items() if k.endswith("_documents")) == kept
    rejected = sum(counted.get(r, 0) for r in preparation.REASONS)
    assert counted["input"] == rejected + counted.get("exact_duplicates_removed", 0) + kept
    assert duplicates.torn_groups(done.clean).isEmpty()


def test_splits_are_spread_and_ordered(spark, tmp_path):
    clean = spark.range(3000).select(F.sha2(F.col("id").cast("string"), 256).alias("content_sha256"), F.when(F.col("id") % 100 == 0, "test").otherwise("train").alias("split"))
    out = str(tmp_path / "clean")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        records.write_splits(clean, out)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(list((tmp_path / "clean" / "split=train").glob("*.parquet"))) > 1
    for f in (tmp_path / "clean" / "split=train").glob("*.parquet"):
        digests = [r[0] for r in spark.read.parquet(str(f)).select("content_sha256").collect()]
        assert digests == sorted(digests)
    with pytest.raises(Exception, match="exist"):
        records.write_splits(clean, out)


def test_changed_splits_are_refused(spark, tmp_path):
    from gristmill.plans import pack, stages

    df = spark.createDataFrame([("a", "text", "train")], "content_sha256 string, text string, split string")
    records.write_splits(df, str(tmp_path / "clean"))
    manifest = {"kind": "clean_corpus", "splits": {"train": stages.split_entry(spark, str(tmp_path / "clean" / "split=train"))}}
    assert pack.sound_split(spark, manifest, "train").select("text").collect()[0]["text"] == "text"
    with pytest.raises(ValueError, match="names no split"):
        pack.sound_split(spark, manifest, "test")
    df.drop("split").write.mode("append").parquet(str(tmp_path / "clean" / "split=train"))
    with pytest.raises(ValueError, match="not what was prepared"):
        pack.sound_split(spark, manifest, "train")


def test_checksums_of_folders(spark, tmp_path):
    (tmp_path / "x" / "y").mkdir(parents=True)
    for name, content in (("x/a", b"1"), ("x/y/b", b"2" * 3_000_000)):
        (tmp_path / name).write_bytes(content)
    got = {r["file"]: r["sha256"] for r in files.checksums(spark, str(tmp_path / "x")).collect()}
    assert got == {"a": hashlib.sha256(b"1").hexdigest(), "y/b": hashlib.sha256(b"2" * 3_000_000).hexdigest()}
    one = files.folder_digest(spark, str(tmp_path / "x"))
    (tmp_path / "x" / "a").write_bytes(b"3")
    assert one != files.folder_digest(spark, str(tmp_path / "x"))


def test_empty_group_keys(spark):
    arrivals = spark.createDataFrame([("a", None), ("b", " "), ("c", "k"), ("d", "k")], "content_sha256 string, external string")
    with pytest.raises(Exception, match="empty group key"):
        duplicates.membership(arrivals, None, Scratch(spark, "t"), strict=True).collect()
    fine = arrivals.where("content_sha256 <> 'b'")
    assert {tuple(r) for r in duplicates.membership(fine, None, Scratch(spark, "t"), strict=True).collect()} == {("a", "a"), ("c", "c"), ("d", "c")}


def test_order_within_a_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.jsonl").write_text("".join(json.dumps({"id": f"b{i}"}) + "\n" for i in range(50)))
    (tmp_path / "in" / "a.jsonl").write_text("".join(json.dumps({"id": f"a{i}", "text": "x" * 3000}) + "\n" for i in range(500)))
    got = [r["id"] for r in records.scan_jsonl(spark, str(tmp_path / "in"), keep_raw=False).orderBy("ordinal").collect()]
    assert got == [f"a{i}" for i in range(500)] + [f"b{i}" for i in range(50)]


def test_predictions_and_logs(spark, tmp_path):
    from gristmill.streaming import events

    rows = spark.createDataFrame([("i", "qa", "x")], "id string, task string, prediction string")
    records.write_predictions(rows, str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "p")).collect()[0]["prediction"] == "x"
    with pytest.raises(Exception, match="exist"):
        records.write_predictions(rows, str(tmp_path / "p"))
    for step in (1, 2):
        records.append_log(spark.createDataFrame([("r", "train", step, 0.5, 10)], "run string, event string, step bigint, ce double, tokens bigint"), str(tmp_path / "log"))
    run = events.log_stream(spark, str(tmp_path / "log")).writeStream.format("memory").queryName("log").trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(r["step"] for r in spark.table("log").collect()) == [1, 2]
