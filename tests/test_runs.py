import pytest

import __spark_entry__ as entry
from gristmill.plans import stages
from gristmill.plans.shared import Scratch, shared_folder
from gristmill.session import table
from gristmill.streaming import events


def test_stages_run_once(spark, tmp_path):
    run, calls = stages.Run(str(tmp_path), "run-1"), []
    work = lambda out: calls.append(out) or {"rows": 3}
    assert run.stage("a", work, {"x": 1})["rows"] == 3 and run.stage("a", work, {"x": 1})["rows"] == 3 and len(calls) == 1
    with pytest.raises(ValueError):
        run.stage("a", work, {"x": 2})
    (tmp_path / "run-1" / "b").mkdir()
    with pytest.raises(FileExistsError):
        run.stage("b", work)
    assert [m["stage"] for m in run.done()] == ["a"]
    with pytest.raises(ValueError):
        stages.Run(str(tmp_path), "../x")


def test_fingerprint_ignores_key_order():
    assert stages.fingerprint({"a": 1, "b": [2]}) == stages.fingerprint({"b": [2], "a": 1}) != stages.fingerprint({"a": 1, "b": [3]})
    assert len(stages.short_key("prompt")) == 12


def test_preflight_reports_all(spark):
    got = {r["check"]: r["ok"] for r in stages.preflight(spark, {"good": lambda: None, "bad": lambda: False, "worse": lambda: 1 / 0}).collect()}
    assert got == {"good": True, "bad": False, "worse": False}


def test_scratch(spark):
    scratch = Scratch(spark, "t")
    kept = scratch.keep(spark.range(5), "r")
    assert kept.count() == 5 and scratch.root.startswith(shared_folder(spark))
    scratch.drop(kept)
    with pytest.raises(Exception):
        kept.count()


def test_stream_equals_batch(spark, data, tmp_path):
    batch = table(spark, data, "events").repartition(3)
    batch.write.parquet(str(tmp_path / "in"))
    stream = events.tumbling(events.event_stream(spark, str(tmp_path / "in")), late="10000 days")
    run = stream.writeStream.outputMode("complete").format("memory").queryName("hours").trigger(availableNow=True).start()
    run.awaitTermination()
    key = lambda df: sorted((r["start"], r["event_type"], r["events"]) for r in df.collect())
    assert key(spark.table("hours")) == key(events.tumbling(batch))


def test_running_state(spark, data, tmp_path):
    table(spark, data, "events").repartition(2).write.parquet(str(tmp_path / "in"))
    run = events.running_totals(events.event_stream(spark, str(tmp_path / "in"))).writeStream.outputMode("update").format("memory").queryName("totals").trigger(availableNow=True).start()
    run.awaitTermination()
    last = {r["user_id"]: r["n"] for r in spark.sql("select user_id, max(events) n from totals group by 1").collect()}
    assert last == {r["user_id"]: r["count"] for r in table(spark, data, "events").groupBy("user_id").count().collect()}


def test_late_rows_are_dropped(spark, tmp_path):
    import datetime as dt

    day = dt.datetime(2026, 1, 1)
    one = [(1, day, 1, "a", 1.0, None), (2, day + dt.timedelta(days=1), 1, "a", 1.0, None)]
    spark.createDataFrame(one, events.EVENTS).coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.createDataFrame([(2, day + dt.timedelta(days=1), 1, "a", 1.0, None)], events.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = events.first_deliveries(events.event_stream(spark, str(tmp_path / "in"))).writeStream.outputMode("append").format("memory").queryName("first").trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(r["event_id"] for r in spark.table("first").collect()) == [1, 2]


def test_entry(spark):
    got = entry.entry(spark)
    assert got.count() > 0 and got.columns == ["section", "key", "value"]


def test_queries_have_documents_and_names():
    for name, f in entry.queries().items():
        assert f.__doc__, name
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_corpus_run(spark, data, tmp_path):
    """Prepare and pack as stages: done once, resumed, and refused after the clean files were changed."""
    from gristmill.operators.preparation import Settings
    from gristmill.plans import pack
    from gristmill.sources.records import raw_records

    records, settings = raw_records(table(spark, data, "documents")), Settings.of(table(spark, data, "preparation"))
    call = lambda run: stages.run_corpus(spark, run, records, settings, "byte_bpe_50k", 256, (50256, 50256, 50256), html_in_code="text")
    run = stages.Run(str(tmp_path), "first-run")
    done = call(run)
    assert [m["stage"] for m in done] == ["prepare", "pack"] and call(run) == done
    held = pack.open_packed(f"{run.output('pack')}/train/arrays")
    assert held.rows == done[1]["rows"]["train"] > 0 and held.read(0, held.rows)["input_ids"].shape == (held.rows, 256)
    other = stages.Run(str(tmp_path), "second-run")
    call_prepare = stages.Run.stage
    kept = []
    stages.Run.stage = lambda self, name, work, settings=None: kept.append(name) if name == "pack" else call_prepare(self, name, work, settings)
    try:
        call(other)
    finally:
        stages.Run.stage = call_prepare
    spark.range(1).write.mode("append").parquet(f"{other.output('prepare')}/clean/split=train")
    with pytest.raises(ValueError, match="not what was prepared"):
        call(other)


def test_sources_and_settings_are_sound():
    """Every module compiles, and every JSON file beside them can be read."""
    import json
    from pathlib import Path

    root = Path(entry.__file__).parent
    for path in [*root.glob("*.py"), *root.glob("gristmill/**/*.py"), *root.glob("tests/**/*.py")]:
        compile(path.read_text(encoding="utf-8"), str(path), "exec")
    for path in root.glob("*.json"):
        json.loads(path.read_text(encoding="utf-8"))
