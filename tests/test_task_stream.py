"""Task states as a stateful stream, and outer pairing: restarts, late, repeated and missing rows."""

import json
import os
from datetime import datetime

import pytest

from lorebase.operators import monitor
from lorebase.streaming import progress as stream
from lorebase.streaming import tasks


@pytest.mark.parametrize("status, asked, action, want", [
    ("pending", False, "cancel", ("cancelled", 0, False)), ("running", False, "cancel", ("cancel_requested", 0, True)), ("completed", False, "cancel", ("completed", 0, False)),
    ("failed", False, "resume", ("recovering", 1, False)), ("cancel_requested", True, "complete", ("cancelled", 0, False)), ("running", False, "fail", ("failed", 0, False)),
    ("cancelled", False, "start", ("cancelled", 0, False)), ("cancel_requested", True, "start", ("cancel_requested", 0, True)), ("pending", False, "other", ("pending", 0, False)),
])
def test_applied(status, asked, action, want):
    assert tasks.applied(status, 0, asked, action) == want


KIND = "task_id string, action string, at timestamp, seq long"


def put(folder, number, rows):
    (folder / f"{number}.json").write_text("\n".join(json.dumps({"task_id": t, "action": a, "at": f"2024-01-01T{at}:00Z", "seq": s}) for t, a, at, s in rows))
    os.utime(folder / f"{number}.json", (1_700_000_000 + number, 1_700_000_000 + number))


def test_states_go_on_from_a_checkpoint(spark, tmp_path):
    given = tmp_path / "in"
    given.mkdir()

    def run():
        read = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).json(str(given))
        with tasks.typed_states(spark):
            changes = stream.drained(tasks.task_changes(read, "10 minutes", 60), str(tmp_path / "out"))
        return {r.task_id: (r.status, r.retry_count, r.cancel_requested, r.stale) for r in tasks.states(changes).collect()}

    put(given, 0, [("a", "start", "10:00", 1), ("a", "start", "10:00", 1), ("b", "start", "10:00", 2), ("c", "cancel", "10:01", 3), ("b", "cancel", "10:05", 4), (None, "start", "10:06", 5)])
    assert run() == {"a": ("running", 0, False, False), "b": ("cancel_requested", 0, True, False), "c": ("cancelled", 0, False, False)}
    # a new stream from the same checkpoint: repeated rows change nothing, an older one of the same hour neither
    put(given, 1, [("b", "cancel", "10:05", 4), ("a", "fail", "09:58", 0), ("c", "resume", "10:20", 6), ("d", "start", "10:20", 7)])
    assert run() == {"a": ("running", 0, False, False), "b": ("cancel_requested", 0, True, False), "c": ("recovering", 1, False, False), "d": ("running", 0, False, False)}
    # an hour of silence ends what was active; a row behind the watermark is left out
    put(given, 2, [("d", "complete", "11:30", 8), ("e", "start", "11:31", 9)])
    put(given, 3, [("a", "complete", "10:02", 10), ("e", "start", "11:40", 11)])
    got = run()
    assert got["a"] == ("failed", 0, False, True) and got["b"] == ("cancelled", 0, False, True) and got["c"] == ("failed", 1, False, True)
    assert got["d"] == ("failed", 0, False, False) and got["e"] == ("running", 0, False, False)  # d had failed by silence before it completed
    put(given, 4, [("a", "resume", "12:00", 12)])
    assert run()["a"] == ("recovering", 1, False, False)


def test_outer_pairs(spark, tmp_path):
    starts, ends = tmp_path / "s", tmp_path / "e"
    far = "2030-01-01T00:00:00Z"
    said = {
        starts: [("1", "10:00", "tool", "x"), ("1", "10:00", "tool", "x"), ("2", "10:00", "tool", "y"), ("4", "10:00", "skill", "z"), ("end", None, "", "")],
        ends: [("1", "10:30", "done", None), ("1", "10:31", "again", None), ("3", "10:05", None, None), ("4", "12:30", "late", None), ("end", None, "", "")],
    }
    for folder, rows in said.items():
        folder.mkdir()
        (folder / "0.json").write_text("\n".join(json.dumps({"invocation_id": i, "kind": k, "status": k, "name": n, "ts": far if t is None else f"2024-01-01T{t}:00Z"}) for i, t, k, n in rows))
    s = spark.readStream.schema("invocation_id string, kind string, name string, ts timestamp").json(str(starts))
    e = spark.readStream.schema("invocation_id string, status string, ts timestamp").json(str(ends))
    out = stream.drained(monitor.paired_all(s, e), str(tmp_path / "out")).filter("invocation_id <> 'end'")
    got = {(r.invocation_id, r.kind, r.name, r.status, r.latency_ms) for r in out.collect()}
    assert got == {("1", "tool", "x", "done", 1_800_000.0), ("2", "tool", "y", "unfinished", None), ("3", "generic", "unknown", "completed", 0.0), ("4", "skill", "z", "unfinished", None), ("4", "generic", "unknown", "late", 0.0)}
    first = monitor.delivered(out, None, 2).collect()
    rest = monitor.delivered(out, (first[-1].started_at, first[-1].invocation_id), 10).collect()
    assert [r.invocation_id for r in first + rest] == ["1", "2", "4", "3", "4"] and isinstance(first[0].started_at, datetime)
