"""The stream's sessions: what is settled within a micro-batch, what the state holds, and how events land."""

import json

import pyarrow as pa

from jobloom.operators import fulfil
from jobloom.plans import registry
from jobloom.sources.views import NOW_MS
from jobloom.streaming import events
from tests.test_tables import event


def test_sessions_are_told_apart_without_a_call_for_each(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    names = [p.split()[0] for p in events.EVENT_SCHEMA.replace("map<string,string>", "map").split(", ")]
    rows = [event(f"e{i}", session=f"s{i % 500}", at=NOW_MS + i // 500 * (-1 if i % 2 else 1)) for i in range(3000)]
    rows += [(*event(f"n{i}")[:2], None, *event(f"n{i}")[3:6], NOW_MS - i % 7) for i in range(20)]
    for k in range(4):
        (folder / f"{k}.json").write_text("\n".join(json.dumps(dict(zip(names, r))) for r in rows[k::4] + rows[:50]))
    kept = []
    q = events.first_of_sessions(fulfil.payment_fields(events.read_events(spark, f"file://{folder}"))).writeStream
    q = q.foreachBatch(lambda df, _: kept.extend(df.select("session_id", "event_id").collect())).option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    first = {}
    for r in sorted(rows, key=lambda r: (r[6], r[0])):
        first.setdefault(r[2], r[0])
    assert sorted(map(tuple, kept), key=str) == sorted(first.items(), key=str)
    state = q.lastProgress["stateOperators"][0]
    assert state["operatorName"] == "dedupeWithinWatermark" and state["numRowsTotal"] == 501


def test_a_tasks_rows_are_reduced_as_they_come():
    batches = [pa.RecordBatch.from_pydict({"event_id": [f"{b}-{i}" for i in range(9_000)], "session_id": [None if i == 5 else f"s{i % 100}" for i in range(9_000)], "paid_at": [-b] * 9_000}) for b in range(9)]
    out = pa.Table.from_batches(events.first_of_batch(iter(batches))).to_pylist()
    assert len(out) == 101 and {r["paid_at"] for r in out} == {-8} and {r["session_id"]: r["event_id"] for r in out}["s5"] == min(f"8-{i}" for i in range(105, 9_000, 100))
    assert list(events.first_of_batch(iter([]))) == []


def test_streamed_payments_land_from_all_tasks(spark, small, monkeypatch):
    folders = []
    read = events.read_events
    monkeypatch.setattr(events, "read_events", lambda spark, folder: folders.append(folder) or read(spark, folder))
    assert registry.queries()["streamed_payments"](spark, small).count() > 0
    assert len([f for f in spark.read.text(folders[0]).inputFiles()]) > 1
