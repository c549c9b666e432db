import bz2
import hashlib
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from gristmill.functions import text as X
from gristmill.functions import wikitext
from gristmill.sources import wiki


def column(spark, texts, expression):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[0] for r in rows.select("i", expression(F.col("t")).alias("v")).orderBy("i").select("v").collect()]


def test_newlines(spark):
    assert column(spark, ["a\r\nb\rc\n\r\r\n", None, ""], X.plain_newlines) == ["a\nb\nc\n\n\n", None, ""]


def test_redaction(spark):
    given = ["x é.b+c@ex-a.co.kr, 끝", "010-1234-5678 01012345678 010.123.4567", "1010-1234-5678 010-1234-56789", "011 123 4567/016-123-4567", "a@b", "０１０"]
    assert column(spark, given, X.redacted_contacts) == ["x [EMAIL], 끝", "[PHONE] [PHONE] [PHONE]", "1010-1234-5678 010-1234-56789", "[PHONE]/[PHONE]", "a@b", "０１０"]


def test_canonical_key(spark):
    given = ["  a 　b\x1c\x85c ", "é 한", "", " \n ", None]
    want = [None if t is None else " ".join(unicodedata.normalize("NFC", t).split()) for t in given]
    assert column(spark, given, X.canonical) == want
    assert column(spark, given[:1], lambda t: X.digest(X.canonical(t))) == [hashlib.sha256(want[0].encode()).hexdigest()]


@pytest.mark.parametrize("text", ["", "abc", "abcde", "aaaaaaaa", "가나다라마바", "😀😁😂🤣😃😄 x"])
def test_shingles(spark, text):
    want = {text[i : i + 5] for i in range(max(1, len(text) - 4))}
    (got,) = column(spark, [text], X.shingles)
    assert len(got) == len(want) and set(got) == want


def test_minhash_is_a_set_property(spark):
    one, other = column(spark, ["abcdefgh abcdefgh", "abcdefgh abcdefgh"], lambda t: X.minhash(X.shingles(t)))
    assert one == other and len(one) == 8


def test_repetition(spark):
    assert column(spark, ["", "abc", "abcd", "aaaaa", "abcabcabc"], X.repetition) == [0.0, 0.0, 0.0, 0.5, 1 - 3 / 6]
    with pytest.raises(ValueError):
        X.repetition(F.col("t"), 0)


def test_folded_answer(spark):
    assert column(spark, ["  The, Answer!　가。나 "], X.folded_answer) == ["theanswer가나"]


def test_html(spark):
    pages = ["<p>a &amp; b<br/>c</p><script>x<script>y</script>hidden</script>d", "<style>p{}</style><li>one<li>two", "no markup", None, "<div>open"]
    assert column(spark, pages, X.html_to_text) == ["\na & b\nc\nhiddend", "\none\ntwo", "no markup", None, "\nopen"]


def test_wikitext():
    assert wikitext.prose("[[Target|label]] and [[plain]] and [[File:x.png|thumb|text [[in]] it]]end") == "label and plain and end"
    assert wikitext.prose("before {{a|{{b}} c}} after") == "before  after".replace("  ", " ")
    assert wikitext.prose("kept {{never closed and [[never closed too") == "kept never closed and never closed too"
    assert wikitext.prose("{| table\n| cell\n|}\ntext<ref name=x/> more<ref>note</ref>!") == "text more!"
    assert wikitext.prose("a < b > c <b>bold</b> &lt;tag&gt;") == "a < b > c bold <tag>"
    assert wikitext.prose("== Head ==\n* item\n'''bold'''\n\n\n\nx\n== 각주 ==\nnotes") == "Head\nitem\nbold\n\nx"
    assert wikitext.prose("[http://x.y label] [http://x.y] [http://x.y open") == "label  open".replace("  ", " ")
    assert wikitext.with_labels("[[a|[[b|c]] d]]") == "c]] d"


DUMP = """<mediawiki xmlns="http://www.mediawiki.org/xml/export-0.10/"><siteinfo><sitename>t</sitename></siteinfo>
<page><title>One</title><ns>0</ns><id>1</id><revision><id>9</id><text bytes="3">  Body of one, long enough. [[x|y]]</text></revision></page>
<page><title>Two</title><ns>0</ns><id>2</id><redirect title="One"/><revision><id>8</id><text bytes="3">#REDIRECT [[One]]</text></revision></page>
<page><title>Talk</title><ns>1</ns><id>3</id><revision><id>7</id><text bytes="3">chatter</text></revision></page>
<page><title>Four</title><ns>0</ns><id>4</id><revision><id>6</id><text bytes="3">#넘겨주기 [[One]]</text></revision></page>
<page><title>Five</title><ns>0</ns><id>5</id><revision><id>5</id><text bytes="3">{{only a template}}</text></revision></page>
"""


def test_wiki_dump(spark, tmp_path):
    whole, cut = tmp_path / "whole.xml.bz2", tmp_path / "cut.xml.bz2"
    half = len(DUMP) // 2
    whole.write_bytes(bz2.compress(DUMP[:half].encode()) + bz2.compress((DUMP[half:] + "</mediawiki>").encode()))
    pages = wiki.scan_pages(spark, str(whole))
    got = wiki.to_records(pages, "w-1", "cc", min_chars=10)
    rows = {r["id"]: r.asDict() for r in got.collect()}
    assert rows["w-1-1"]["text"] == "One\n\nBody of one, long enough. y" and rows["w-1-1"]["group_id"] == "w-1:1" and rows["w-1-1"]["reason"] is None
    assert rows["w-1-5"]["reason"] == "empty_after_strip" and len(rows) == 2
    counted = wiki.conversion_counters(pages, got).first()
    assert (counted["scanned"], counted["kept"], counted["empty_after_strip"], counted["truncated"]) == (2, 1, 1, False)
    cut.write_bytes(bz2.compress((DUMP + "<page><title>Six</title><ns>0</ns><id>6").encode()))
    pages = wiki.scan_pages(spark, str(cut))
    assert {r["id"] for r in wiki.to_records(pages, "w-1", "cc", min_chars=10).collect()} == {"w-1-1", "w-1-5"}
    assert wiki.conversion_counters(pages, wiki.to_records(pages, "w-1", "cc")).first()["truncated"]


def test_email_pattern_is_unicode():
    assert re.match(r"[\w.+-]+@", "é@")  # the reference rule, as Python has it


def test_minhash_estimates_similarity(spark):
    import random

    drawn = random.Random(3)
    one = [f"w{i:05d}" for i in range(400)]
    other = one[:300] + [f"v{i:05d}" for i in range(100)]  # 300 of 500 in common
    shuffled = one[:]
    drawn.shuffle(shuffled)
    df = spark.createDataFrame([(1, one), (2, other), (3, shuffled)], "id int, s array<string>")
    a, b, c = (r["m"] for r in df.select("id", X.minhash(F.col("s"), 128).alias("m")).orderBy("id").collect())
    assert a == c and len(set(a)) == 128
    assert abs(sum(x == y for x, y in zip(a, b)) / 128 - 0.6) < 0.15


def dump(pages, chars, seed=1):
    import random

    drawn = random.Random(seed)
    body = lambda: "".join(drawn.choice("abcdefghijklmnop qrstuvwxyz") for _ in range(chars))
    parts = [f"<page><title>t{i}</title><ns>0</ns><id>{i}</id><revision><id>1</id><text bytes=\"1\">{body()}</text></revision></page>" for i in range(pages)]
    return ("<mediawiki>\n  <siteinfo><sitename>x</sitename></siteinfo>\n" + "\n".join(parts) + "\n</mediawiki>\n").encode()


def test_compressed_dump_that_ends_early(spark, tmp_path):
    """Cut within the compressed bytes: the pages of whole blocks are kept, and the cut is told."""
    raw = dump(400, 10_000)
    packed = bz2.compress(raw)
    (tmp_path / "whole.xml.bz2").write_bytes(packed)
    (tmp_path / "cut.xml.bz2").write_bytes(packed[: len(packed) * 7 // 10])
    whole, cut = (wiki.scan_pages(spark, str(tmp_path / n)) for n in ("whole.xml.bz2", "cut.xml.bz2"))
    assert whole.count() == 400 and whole.where("broken").count() == 0
    kept = [r["page_id"] for r in wiki.articles(cut).select("page_id").collect()]
    assert 100 < len(kept) < 300 and set(kept) == {str(i) for i in range(len(kept))}
    counted = lambda pages: wiki.conversion_counters(pages, wiki.to_records(pages, "d", "l")).first()
    assert counted(cut)["truncated"] and counted(cut)["kept"] == len(kept)
    assert not counted(whole)["truncated"] and counted(whole)["kept"] == 400


def test_one_dump_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "one.xml.bz2").write_bytes(bz2.compress(dump(300, 10_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300000")
    try:
        pages = wiki.scan_pages(spark, str(tmp_path / "one.xml.bz2"))
        texts = spark.read.option("lineSep", "</page>").text(str(tmp_path / "one.xml.bz2"))
        assert texts.rdd.getNumPartitions() > 2
        assert sorted(int(r["page_id"]) for r in pages.select("page_id").collect()) == list(range(300))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
