"""Staged runs: each stage leaves a marker when it is done, runs once, and never writes over what a broken run left behind."""

from __future__ import annotations

import datetime
import hashlib
import json
import platform
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gristmill.sources import files
from gristmill.sources.records import write_report, write_splits

#: Names a run may have.
RUN_NAME = re.compile(r"[a-z0-9][a-z0-9-]{2,62}")


def fingerprint(value: object) -> str:
    """SHA-256 of the canonical JSON of a value: the same for equal values whatever the order of their keys."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"), allow_nan=False).encode()).hexdigest()


def short_key(text: str) -> str:
    """First 12 hex digits of a text's SHA-256: the key of a cached result."""
    return hashlib.sha256(text.encode()).hexdigest()[:12]


class Run:
    """Stages of one run under a folder, in order. A finished stage is skipped if its settings are the same, and refused if not."""

    def __init__(self, root: str, name: str):
        if not RUN_NAME.fullmatch(name):
            raise ValueError(f"not a run name: {name!r}")
        self.folder = f"{root.rstrip('/')}/{name}"
        self.markers = f"{self.folder}/done"

    def output(self, stage: str) -> str:
        return f"{self.folder}/{stage}"

    def done(self) -> list[dict]:
        """Markers of the finished stages, oldest first."""
        found = [files.read_json(f"{self.markers}/{name}") for name in files.listed(self.markers, ".json")]
        return sorted(found, key=lambda m: (m["completed_at"], m["stage"]))

    def stage(self, name: str, work: Callable[[str], dict | None], settings: object = None) -> dict:
        """Run ``work`` with the stage's output path, unless it is done; returns the marker."""
        marker, wanted = f"{self.markers}/{name}.json", fingerprint(settings)
        if files.exists(marker):
            known = files.read_json(marker)
            if known["settings"] != wanted:
                raise ValueError(f"stage {name} was done with other settings")
            return known
        if files.exists(self.output(name)):
            raise FileExistsError(f"stage {name} left output but no marker; move it away first")
        about = work(self.output(name)) or {}
        entry = {"stage": name, "completed_at": datetime.datetime.now(datetime.UTC).isoformat(), "settings": wanted, **about}
        write_report(marker, entry)
        return entry


def run_corpus(spark: SparkSession, run: Run, records: DataFrame, settings, tokenizer: str, length: int, specials: tuple[int, int, int], html_in_code: str = "error") -> list[dict]:
    """The stages prepare and pack of a run, in order: clean splits with a manifest, then packed arrays of train and validation. Each stage is done once;
    packing refuses splits that are not what was prepared, and empty splits are left out."""
    import dataclasses

    from gristmill.plans import pack
    from gristmill.plans.prepare import prepare

    def prepared(folder: str) -> dict:
        done = prepare(records, settings, html_in_code)
        write_splits(done.clean, f"{folder}/clean")
        splits = {s: split_entry(spark, f"{folder}/clean/split={s}") for s in ("train", "validation", "test") if files.exists(f"{folder}/clean/split={s}")}
        write_report(f"{folder}/manifest.json", manifest(done, settings, [], splits))
        return {"splits": sorted(splits)}

    def packed(folder: str) -> dict:
        held = files.read_json(f"{run.output('prepare')}/manifest.json")
        counts = {}
        for split in ("train", "validation"):
            if split in held["splits"]:
                rows = pack.pack_split(pack.sound_split(spark, held, split), split, tokenizer, length, *specials)
                rows.write.parquet(f"{folder}/{split}/rows")
                rows = spark.read.parquet(f"{folder}/{split}/rows")
                about = pack.packed_manifest(rows, split, length, corpus=held["splits"][split]["sha256"], tokenizer=tokenizer)
                pack.export_arrays(rows, f"{folder}/{split}/arrays", length, about)
                counts[split] = about["rows"]
        return {"rows": counts}

    wanted = {"settings": dataclasses.asdict(settings), "html_in_code": html_in_code}
    run.stage("prepare", prepared, wanted)
    run.stage("pack", packed, wanted | {"tokenizer": tokenizer, "length": length, "specials": list(specials)})
    return run.done()


def split_entry(spark: SparkSession, path: str, format: str = "parquet") -> dict:
    """What a manifest says of one split: where it is and its checksum."""
    return {"path": path, "format": format, "sha256": files.folder_digest(spark, path)}


def preflight(spark: SparkSession, checks: dict[str, Callable[[], object]]) -> DataFrame:
    """(check, ok, detail): all checks, also those after one that fails. A check passes unless it raises or returns False."""
    rows = []
    for name, check in checks.items():
        try:
            result = check()
            rows.append((name, result is not False, "" if result in (None, True, False) else str(result)))
        except Exception as problem:  # every blocker is reported, whatever it is
            rows.append((name, False, f"{type(problem).__name__}: {problem}"))
    return spark.createDataFrame(rows, "check string, ok boolean, detail string")


def environment(spark: SparkSession) -> dict:
    """Versions that a measurement belongs to."""
    import pandas
    import pyarrow

    return {"python": platform.python_version(), "spark": spark.version, "pyarrow": pyarrow.__version__, "pandas": pandas.__version__, "machine": platform.machine()}


def manifest(prepared, settings, inputs: list[tuple[str, str]], splits: dict[str, dict] | None = None) -> dict:
    """What a preparation did: settings, inputs and splits with checksums, counters, sources. Counters come as a few rows."""
    import dataclasses

    return {
        "format_version": 1,
        "kind": "clean_corpus",
        "config": dataclasses.asdict(settings),
        "inputs": [{"name": n, "sha256": s} for n, s in inputs],
        "splits": splits or {},
        "stats": {r["counter"]: r["value"] for r in prepared.counters().collect()},
        "sources": {r["source_domain"]: r["documents"] for r in prepared.sources().collect()},
        "limitations": ["similarity is decided on 64-bit hashes of shingles", "contact patterns cover e-mail addresses and Korean mobile numbers"],
    }
