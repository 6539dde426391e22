"""Calls and batch jobs of a scripted service."""

import json
import sys
import time
from pathlib import Path

from pyspark import cloudpickle
from pyspark.sql import functions as F

from graphloom.operators import extraction
from graphloom.streaming import jobs

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this file


class Refusal(Exception):
    def __init__(self, status):
        super().__init__(f"status {status}")
        if status:
            self.status_code = status


class Scripted:
    """A service whose failures and jobs lie in a folder: script.json has, by call, the statuses to fail with first (0: another error)."""

    def __init__(self, folder):
        self.folder = Path(folder)

    def _next(self, call):
        script = json.loads((self.folder / "script.json").read_text())
        with (self.folder / "calls.log").open("a") as f:
            f.write(f"{call}\n")
        if script.get(call):
            status = script[call].pop(0)
            (self.folder / "script.json").write_text(json.dumps(script))
            if status is not None:
                raise Refusal(status)

    def submit(self, name, requests):
        self._next(f"submit {name.split('-')[0]}")
        (self.folder / f"{len(name)}-{name[:40]}.job").write_text(json.dumps(requests))
        return f"{len(name)}-{name[:40]}"

    def ended(self, service_id):
        self._next(f"ended {service_id.split('-')[1]}")
        return (self.folder / "open").exists() is False

    def results(self, service_id):
        self._next(f"results {service_id.split('-')[1]}")
        return [(c, None if p == "bad" else p.upper(), "refused" if p == "bad" else None) for c, p in json.loads((self.folder / f"{service_id}.job").read_text()) if c != "lost"]

    def cancel(self, service_id):
        self._next(f"cancel {service_id.split('-')[1]}")


def test_pauses_by_status():
    assert [extraction.pause_after(Refusal(s), 2) for s in (529, 429, 500, 0)] == [(180.0, True), (90.0, True), (10.0, False), (5.0, True)]


def test_calls_are_tried_by_status(spark, tmp_path):
    log = tmp_path / "log"

    def ask(text):
        with log.open("a") as f:
            f.write(f"{text}\n")
        n = log.read_text().split("\n").count(text)
        if text == "busy" and n < 3:
            raise Refusal(529)
        if text == "refused":
            raise Refusal(400)
        if text == "down":
            raise Refusal(0)
        return "" if text == "empty" or text == "second" and n < 2 else "ok"

    slept = tmp_path / "slept"

    def sleep(seconds):
        with slept.open("a") as f:
            f.write(f"{seconds}\n")

    rows = spark.createDataFrame([(t, t) for t in ("busy", "refused", "down", "empty", "second", "good")] + [("null", None)], "chunk_id string, prompt string").coalesce(1)
    got = {r["chunk_id"]: (r["result"], r["error"], r["attempts"]) for r in extraction.called(rows, ask, sleep=sleep).collect()}
    assert got == {"busy": ("ok", None, 3), "refused": (None, "status 400", 1), "down": (None, "status 0", 3), "empty": (None, None, 3), "second": ("ok", None, 2), "good": ("ok", None, 1), "null": ("ok", None, 1)}
    assert slept.read_text().split() == ["90.0", "180.0", "10.0", "5.0", "5.0", "5.0"]


def _run(spark, tmp_path, until, seconds=60):
    """Runs the jobs' stream until enough rows are out; the rows."""
    folder = str(tmp_path / "service")
    stream = spark.readStream.schema("job string, chunk_id string, prompt string, action string").json(str(tmp_path / "in"))
    query = jobs.batch_jobs(stream, lambda: Scripted(folder), poll=0.2, pace=0.02).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="200 milliseconds").start()
    try:
        end = time.time() + seconds
        while time.time() < end and query.isActive:
            rows = spark.read.schema(jobs.OUT).parquet(str(tmp_path / "out")).collect() if (tmp_path / "out" / "_spark_metadata").exists() else []
            if until(rows):
                return rows
            time.sleep(0.3)
        raise AssertionError(f"{query.exception()}: {rows}")
    finally:
        query.stop()


def _put(tmp_path, name, rows):
    (tmp_path / "in").mkdir(exist_ok=True)
    (tmp_path / "in" / f"{name}.json").write_text("\n".join(json.dumps(dict(zip(("job", "chunk_id", "prompt", "action"), r, strict=True))) for r in rows))


def test_jobs_over_failures_and_restarts(spark, tmp_path):
    service = tmp_path / "service"
    service.mkdir()
    (service / "script.json").write_text(json.dumps({"submit a": [529, 429], "submit b": [400], "submit c": [0, 0, 0], "ended a": [529], "results d": [0]}))
    (service / "open").write_text("")
    _put(tmp_path, "one", [("a", "a1", "x", None), ("a", "a2", "bad", "submit"), ("a", "lost", "y", None), ("b", "b1", "x", None), ("c", "c1", "x", None), ("d", "d1", None, None), ("e", "e1", "x", None), (None, "n", "x", None), ("d", None, "x", None)])
    first = _run(spark, tmp_path, lambda rows: len(rows) >= 2 and "ended a" in (service / "calls.log").read_text())
    assert {(r["job"], r["chunk_id"], r["status"], r["error"]) for r in first} == {("b", "b1", "failed", "status 400"), ("c", "c1", "failed", "status 0")}
    _put(tmp_path, "two", [("e", None, None, "cancel"), ("a", "a3", "late", None), ("a", "a1", "again", None)])
    second = _run(spark, tmp_path, lambda rows: any(r["status"] == "cancelled" for r in rows))  # the same jobs, by their state
    assert {(r["job"], r["chunk_id"]) for r in second if r["status"] == "cancelled"} == {("e", "e1")}
    (service / "open").unlink()
    last = _run(spark, tmp_path, lambda rows: len(rows) >= 8)
    assert sorted((r["chunk_id"], r["result"], r["error"]) for r in last if r["status"] == "done") == [("a1", "X", None), ("a2", None, "refused"), ("a3", "LATE", None), ("d1", "", None), ("lost", None, "no result")]
    calls = (service / "calls.log").read_text().split("\n")
    assert calls.count("submit a") == 4  # twice refused, once made, and once for what came later
    assert calls.count("cancel e") == 1
    assert calls.count("submit c") == 3


def test_chunks_dealt_to_jobs(spark):
    rows = jobs.dealt_to_jobs(spark.range(100).select(F.col("id").cast("string").alias("chunk_id"), F.lit("p").alias("prompt")), 4)
    assert rows.select("job").distinct().count() == 4
    assert rows.count() == 100
