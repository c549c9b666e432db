import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gristmill.operators import corpus, evaluation


def test_answer_scores(spark):
    rows = [("a", " The cat!", ["dog", "the cat"]), ("b", "", ["", "x"]), ("c", "abc", ["xyz"]), ("d", "aabb", ["abbb"]), ("e", "x", []), ("f", "!?", ["..."])]
    got = {r["id"]: (r["exact_match"], r["character_f1"]) for r in evaluation.answer_scores(spark.createDataFrame(rows, "id string, prediction string, answers array<string>")).collect()}
    shared = sum((Counter("aabb") & Counter("abbb")).values())
    assert got == {"a": (1.0, 1.0), "b": (1.0, 1.0), "c": (0.0, 0.0), "d": (0.0, 2 * shared / 8), "e": (0.0, 0.0), "f": (1.0, 1.0)}


def test_bits_per_byte_of_the_published_run(spark):
    row = evaluation.text_metrics(spark.createDataFrame([(None, 4.089040368683042 * 433430, 433430, 1389705)], "domain string, nll double, tokens bigint, utf8_bytes bigint")).first()
    assert row["domain"] == "korean_general" and row["bits_per_byte"] == pytest.approx(1.8398918042697057, rel=1e-12)


def test_perplexity_overflow_is_null(spark):
    row = evaluation.text_metrics(spark.createDataFrame([("x", 700.0, 1, 1)], "domain string, nll double, tokens bigint, utf8_bytes bigint")).first()
    assert row["ce"] == 700.0 and row["perplexity"] is None


def test_compare(spark):
    rows = [("text", "d", "ce", 1.0), ("text", "d", "bits_per_byte", 2.0), ("tasks", "d:qa", "exact_match", 0.5)]
    one = spark.createDataFrame(rows, "section string, key string, metric string, value double")
    two = one.withColumn("value", F.col("value") + 1)
    assert {r["metric"]: r["delta"] for r in evaluation.compare_reports(one, two, True).collect()} == {"ce": 1.0, "bits_per_byte": 1.0, "exact_match": 1.0}
    assert "ce" not in {r["metric"] for r in evaluation.compare_reports(one, two, False).collect()}
    with pytest.raises(Exception, match="cover different"):
        evaluation.compare_reports(one, two.where("section = 'text'"), True).collect()
    facts = {"suite_sha256": "s", "max_new_tokens": 1, "choice_scoring": "c", "qa_scoring": "q", "tokenizer_sha256": "t"}
    assert evaluation.same_protocol(facts, facts) and not evaluation.same_protocol(facts, facts | {"tokenizer_sha256": "u"})
    with pytest.raises(ValueError):
        evaluation.same_protocol(facts, facts | {"max_new_tokens": 2})


def test_first_of_equal_choices_wins(spark):
    assert spark.createDataFrame([([1.0, 3.0, 3.0],)], "s array<double>").select(evaluation.first_best(F.col("s"))).first()[0] == 1


def test_parameter_counts(spark):
    from gristmill.queries import _CONFIG_NAMES, _CONFIGS

    got = {r["profile"]: r for r in evaluation.budget(spark.createDataFrame(_CONFIGS, _CONFIG_NAMES), 100_000_000, 1, 1024, 8).collect()}
    assert got["base"]["parameters"] == 315_936_768 and got["debug"]["parameters"] == 39_986_688 and got["base"]["updates"] == 12_208
    assert got["base"]["training_state_gib"] == pytest.approx(4.708, abs=1e-3) and got["base"]["hours"] is None


def test_learning_rate(spark):
    got = [r["multiplier"] for r in evaluation.learning_rate(spark.range(100).withColumnRenamed("id", "step"), 100).orderBy("step").collect()]
    assert got[0] == 1.0 and got[-1] == pytest.approx(0.1) and all(a >= b for a, b in zip(got[1:], got[2:]))
    assert got[50] == pytest.approx(0.1 + 0.45 * (1 + math.cos(math.pi * 49 / 98)))


def test_sft_rows(spark):
    pairs = spark.createDataFrame([("x", [7, 8], [9])], "id string, prompt_ids array<int>, response_ids array<int>")
    row = evaluation.sft_rows(pairs, 1, 2, 3, 4, 5, limit=8).first()
    assert row["input_ids"] == [1, 2, 7, 8, 3, 4, 9, 5] and row["loss_mask"] == [0] * 6 + [1, 1]
    with pytest.raises(Exception, match="longer than the context"):
        evaluation.sft_rows(pairs, 1, 2, 3, 4, 5, limit=7).collect()


def test_suite_problems(spark):
    schema = "id string, type string, text string, prompt string, choices array<string>, answer_index int, answers array<string>"
    rows = [("1", "text", "t", None, None, None, None), ("2", "text", "", None, None, None, None), ("3", "qa", None, "p", None, None, []), ("4", "multiple_choice", None, "p", ["a", "b"], 2, None),
            ("5", "multiple_choice", None, "p", ["a"], 0, None), ("6", "song", None, None, None, None, None), ("7", "generation", None, "p", None, None, None), ("7", "generation", None, "p", None, None, None)]
    got = {r["id"]: r["problem"] for r in evaluation.suite_problems(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"2": "empty text", "3": "no answers", "4": "answer index", "5": "fewer than two choices", "6": "unknown type", "7": "repeated id"}


def test_bootstrap_covers_the_mean(spark):
    rows = [(i, 0.0, float(i % 3)) for i in range(300)]
    row = evaluation.bootstrap_interval(spark.createDataFrame(rows, "id bigint, before double, after double"), rounds=60).first()
    assert row["low"] < 1.0 < row["high"] and row["high"] - row["low"] < 0.4


def test_keep_mask_and_pairs(spark):
    df = spark.createDataFrame([([0, 0, 1, 1, -1], [1, 1, 1, 1, 0], [0, 1, 1, 1, 0])], "d array<bigint>, m array<int>, l array<int>")
    assert df.select(evaluation.keep_mask(F.col("d"), F.col("m"), F.col("l"))).first()[0] == [1, 0, 1, 0]
    places = spark.createDataFrame([(0, 0, 0), (0, 0, 1), (0, 1, 2), (0, -1, 3)], "row int, document int, place int")
    assert sorted(tuple(r) for r in evaluation.causal_pairs(places).collect()) == [(0, 0, 0), (0, 1, 0), (0, 1, 1), (0, 2, 2)]


def test_characters(spark):
    texts = spark.createDataFrame([("b😀a",), ("",), (None,)], "text string")
    vocabulary = corpus.character_vocabulary(texts)
    assert [r["ch"] for r in vocabulary.orderBy("id").collect()] == ["<unk>", "a", "b", "😀"]
    got = corpus.encode_characters(spark.createDataFrame([(1, "a🚀😀"), (2, None)], "k int, text string"), vocabulary, "k")
    assert {r["k"]: r["ids"] for r in got.collect()} == {1: [1, 0, 3], 2: []}


def test_sample_is_the_least_hashes(spark):
    rows = spark.range(500).select((F.col("id") % 3).alias("s"), "id")
    got = corpus.stratified_sample(rows, "s", "id", 10)
    assert got.groupBy("s").count().where("count = 10").count() == 3
    assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in corpus.stratified_sample(rows.repartition(7), "s", "id", 10).collect())


def test_line_quality(spark):
    row = corpus.line_quality(spark.createDataFrame([(1, "홈\n◀ 이전 글   목록   다음 글 ▶\n본문입니다.\n본문입니다.")], "k int, text string"), "k").first()
    assert (row["lines"], row["repeated_lines"], row["menu_lines"]) == (4, 1, 1)


def test_vocabulary_artifact(spark, tmp_path):
    from gristmill.operators import corpus

    texts = spark.createDataFrame([(1, "가나 ab"), (2, ""), (3, None), (4, "😀b")], "k int, text string")
    vocabulary = corpus.character_vocabulary(texts)
    about = corpus.save_vocabulary(vocabulary, str(tmp_path / "v"))
    held = corpus.load_vocabulary(spark, str(tmp_path / "v"))
    assert sorted(map(tuple, held.collect())) == sorted(map(tuple, vocabulary.collect())) and about["size"] == 7
    assert {r["check"]: r["failures"] for r in corpus.vocabulary_checks(texts, vocabulary, held, "k").collect()} == {"round_trip": 0, "reload": 0, "one_id_a_character": 0, "unknown": 0}
    other = spark.createDataFrame([(1, "zz가")], "k int, text string")
    assert {r["check"]: r["failures"] for r in corpus.vocabulary_checks(other, vocabulary, held, "k").collect()} == {"round_trip": 1, "reload": 0, "one_id_a_character": 0, "unknown": 1}
    with pytest.raises(FileExistsError):
        corpus.save_vocabulary(vocabulary, str(tmp_path / "v"))
    with pytest.raises(ValueError, match="ids"):
        corpus.save_vocabulary(vocabulary.where("id <> 3"), str(tmp_path / "w"))
    path = tmp_path / "v" / "vocabulary.json"
    path.write_text(path.read_text().replace('"a"', '"c"'))
    with pytest.raises(ValueError, match="checksum"):
        corpus.load_vocabulary(spark, str(tmp_path / "v"))
    import hashlib
    import json

    description = tmp_path / "v" / "about.json"
    fine = json.loads(description.read_text()) | {"sha256": hashlib.sha256(path.read_bytes()).hexdigest()}
    for wrong, problem in ((fine | {"size": 3}, "size"), (fine | {"specials": {"<unk>": 2}}, "special")):
        description.write_text(json.dumps(wrong))
        with pytest.raises(ValueError, match=problem):
            corpus.load_vocabulary(spark, str(tmp_path / "v"))


def test_vocabulary_checks_are_one_pass_in_which_each_row_counts(spark):
    from gristmill.operators import corpus

    texts = spark.createDataFrame([(1, "ab"), (1, "ab"), (None, "zz"), (None, None), (2, "b😀"), (2, "<unk>")], "k int, text string")
    vocabulary = corpus.character_vocabulary(texts.where("text <> 'zz'")).localCheckpoint()
    lacking = vocabulary.where("ch <> '😀'")
    checks = corpus.vocabulary_checks(texts, vocabulary, lacking, "k")
    assert {r["check"]: r["failures"] for r in checks.collect()} == {"round_trip": 1, "reload": 1, "one_id_a_character": 0, "unknown": 1}
    plan = checks._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "hashpartitioning" not in plan
    assert checks.schema == corpus.vocabulary_checks(texts.limit(0), vocabulary, vocabulary, "k").schema
    assert {r["failures"] for r in corpus.vocabulary_checks(texts.limit(0), vocabulary, vocabulary, "k").collect()} == {0}


def test_shared_prompts_are_refused(spark):
    from gristmill.operators import evaluation

    one = spark.createDataFrame([("a",), ("b",), (None,)], "prompt string")
    evaluation.refuse_overlap(one, spark.createDataFrame([("c",), (None,)], "prompt string"))
    with pytest.raises(ValueError, match="share 1"):
        evaluation.refuse_overlap(one, spark.createDataFrame([("b",), ("b",)], "prompt string"))


def test_temporal_hold_out(spark):
    from gristmill.operators import preparation

    rows = [(1, "g", "2026-01-01"), (2, "g", "2026-03-01"), (3, None, "2026-03-02"), (4, None, None), (5, "h", None), (6, "h", "2026-01-05")]
    df = spark.createDataFrame(rows, "id int, group_id string, seen_at string").withColumn("seen_at", F.to_timestamp("seen_at"))
    got = {r["id"]: r["split"] for r in preparation.held_out_after(df, F.to_timestamp(F.lit("2026-02-01"))).collect()}
    assert got == {1: "test", 2: "test", 3: "test", 4: "train", 5: "train", 6: "train"}


def test_suite_by_types(spark):
    suite = spark.createDataFrame(
        [("t", "text", None, "abc", None, None, None, None), ("m", "multiple_choice", "code", None, "p", ["a", "b", "c"], 1, None), ("q", "qa", "x", None, "p", None, None, ["A b", "z"]), ("g", "generation", "x", None, "p", None, None, None)],
        "id string, type string, domain string, text string, prompt string, choices array<string>, answer_index int, answers array<string>",
    )
    windows = spark.createDataFrame([("t", 1.0, 2), ("t", 0.5, 1)], "id string, nll double, tokens int")
    choices = spark.createDataFrame([("m", 2, -1.0), ("m", 0, -3.0), ("m", 1, -1.0)], "id string, choice int, score double")
    made = spark.createDataFrame([("q", "a B!", True), ("g", "abcdabcd", False)], "id string, prediction string, eos boolean")
    got = {r["id"]: r for r in evaluation.suite_predictions(suite, windows, choices, made).collect()}
    assert (got["t"]["nll"], got["t"]["tokens"], got["t"]["utf8_bytes"], got["t"]["domain"]) == (1.5, 3, 3, "korean_general")
    assert got["m"]["scores"] == [-3.0, -1.0, -1.0] and got["m"]["predicted_index"] == 1 and got["m"]["correct"] is True and got["m"]["prediction"] is None
    assert (got["q"]["exact_match"], got["q"]["character_f1"], got["q"]["eos"]) == (1.0, 1.0, True)
    assert got["g"]["repetition"] == pytest.approx(1 - 4 / 5) and got["g"]["exact_match"] is None and got["g"]["nll"] is None
    report = evaluation.text_metrics(evaluation.suite_predictions(suite, windows, choices, made).where("type = 'text'")).collect()
    assert report[0]["ce"] == 0.5
    with pytest.raises(ValueError, match="no items"):
        evaluation.suite_predictions(suite.where("false"), windows, choices, made)
    with pytest.raises(ValueError, match="repeated id"):
        evaluation.suite_predictions(suite.unionAll(suite), windows, choices, made)
    for less in ((windows.where("false"), choices, made), (windows, choices.where("choice > 0"), made), (windows, choices, made.where("id = 'q'"))):
        with pytest.raises(Exception, match="nothing was scored"):
            evaluation.suite_predictions(suite, *less).collect()
