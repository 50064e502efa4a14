"""Stateful streams: three files, rows out of order and some too late, against a plain fold."""

import os
import subprocess
import sys
from datetime import datetime, timedelta
from pathlib import Path

from tessera.streaming import stateful
from tessera.streaming.events import chain_hash

START = datetime(2024, 1, 1)
ROWS = "user_id long, ts timestamp, event_id long, event_type string, epoch long, seq long"


def at(hours):
    return START + timedelta(hours=hours)


def stream(spark, tmp_path, files):
    for n, rows in enumerate(files):
        spark.createDataFrame(rows, ROWS).coalesce(1).write.parquet(f"{tmp_path}/all/{n}")
        part = next((tmp_path / "all" / str(n)).glob("*.parquet"))
        (tmp_path / "in").mkdir(exist_ok=True)
        part.rename(tmp_path / "in" / f"{n}.parquet")
        # files are taken by the time they were written
        import os

        os.utime(tmp_path / "in" / f"{n}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))
    return spark.readStream.schema(ROWS).option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in"))


def test_chain_in_three_files_with_late_rows(spark, tmp_path):
    files = [
        [(1, at(3), 11, "c", 0, 0), (1, at(1), 10, "a", 0, 0), (2, at(2), 20, "x", 0, 0), (None, at(1), 1, "n", 0, 0)],
        [(1, at(2.5), 12, "b", 0, 0), (1, at(10), 13, "d", 0, 0), (2, at(9.5), 21, "y", 0, 0)],
        [(1, at(1.5), 14, "late", 0, 0), (1, at(4), 16, "in time", 0, 0), (2, at(30), 22, "z", 0, 0), (1, at(29.5), 15, "not yet due", 0, 0)],
    ]
    got, dropped = stateful.drained(stateful.in_order(stream(spark, tmp_path, files), stateful.Chained(), "user_id", "ts", "event_id", "event_type"))
    want, last = [], {}
    for u, e, t in [(1, 10, "a"), (1, 12, "b"), (1, 11, "c"), (1, 16, "in time"), (1, 13, "d"), (2, 20, "x"), (2, 21, "y")]:
        own = chain_hash(last.get(u, ""), e, t)
        want.append((u, e, last.get(u, ""), own))
        last[u] = own
    assert sorted(map(tuple, got.collect())) == sorted(want) and dropped == 1


def test_epochs_and_sequences(spark, tmp_path):
    files = [[(1, at(i), i, "e", ep, sq)] for i, (ep, sq) in enumerate([(1, 1), (1, 2), (1, 2), (2, 1), (1, 9), (2, 5)])] + [[(9, at(99), 99, "end", 1, 1)]]
    got, dropped = stateful.drained(stateful.in_order(stream(spark, tmp_path, files), stateful.Sequenced(), "user_id", "ts", "event_id", epoch="epoch", seq="seq"))
    assert [(r["id"], r["accepted"], r["reason"]) for r in sorted(got.collect(), key=lambda r: r["id"])] == [(0, True, None), (1, True, None), (2, False, "STALE_SEQUENCE"), (3, True, None), (4, False, "STALE_EPOCH"), (5, True, None)]
    assert dropped == 0


def test_a_key_is_woken_once_for_all_that_is_due(spark, tmp_path):
    """Timers cost a call each: one for a key and delivery, not one for every row; a row at the watermark is due."""
    calls = spark.sparkContext.accumulator(0)

    class Counted(stateful.Chained):
        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            calls.add(1)
            return super().handleExpiredTimer(key, timerValues, expiredTimerInfo)

    files = [[(u, at(i / 10), 100 * u + i, "e", 0, 0) for u in range(3) for i in range(50)], [(7, at(9), 700, "end", 0, 0), (1, at(8), 199, "e", 0, 0), (2, at(8.001), 299, "e", 0, 0)]]
    got, dropped = stateful.drained(stateful.in_order(stream(spark, tmp_path, files), Counted(), "user_id", "ts", "event_id", "event_type"))
    want = {(u, 100 * u + i) for u in range(3) for i in range(50)} | {(1, 199)}
    assert {(r["key"], r["id"]) for r in got.collect()} == want and dropped == 0
    assert 0 < calls.value <= 12


def test_rows_that_are_fed_later(spark, tmp_path):
    """The stream goes on from its state, and what comes behind the watermark is dropped."""
    put = lambda rows: spark.createDataFrame(rows, ROWS).repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
    put([(1, at(1), 10, "a", 0, 0), (1, at(5), 11, "b", 0, 0)])
    rows = stateful.in_order(spark.readStream.schema(ROWS).parquet(str(tmp_path / "in")), stateful.Chained(), "user_id", "ts", "event_id", "event_type")
    got, dropped = stateful.drained(rows, [lambda: put([(1, at(2), 12, "late", 0, 0), (1, at(4.5), 13, "c", 0, 0), (2, at(9), 20, "x", 0, 0)])])
    assert [r["id"] for r in sorted(got.collect(), key=lambda r: r["id"])] == [10, 11, 13] and dropped == 1
    assert {r["id"]: r["previous_hash"] for r in got.collect()}[11] == {r["id"]: r["event_hash"] for r in got.collect()}[13]


def test_the_query_runs_from_any_folder(tmp_path, sf):
    """The driver's worker of a stateful stream finds the package although it isn't in the folder of the process."""
    root = str(Path(__file__).resolve().parent.parent)
    code = f"import sys; sys.path.insert(0, {root!r}); import __spark_entry__ as e; from tessera.session import local_session; print('rows', e.queries()['x_stateful_chain'](local_session(4, 4), {sf!r}).count())"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    ran = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows " in ran.stdout, ran.stderr[-3000:]
