"""Stateful sessions as a stream: late rows, a restart in the middle, and the sessions that the watermark closes."""

import datetime as dt

from pyspark.sql import Row
from pyspark.sql import functions as F

from lorewright.sources.log import LoggedTable
from lorewright.streaming import ingest

START = dt.datetime(2024, 1, 1)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def expected(rows, gap, watermark):
    out = []
    for user in {u for u, _ in rows}:
        times, open_ = sorted(t for u, t in rows if u == user), []
        for t in times:
            if open_ and t - open_[-1][1] < gap:
                open_[-1][1:] = [t, open_[-1][2] + 1]
            else:
                open_.append([t, t, 1])
        out += [(user, s, e + gap, n) for s, e, n in open_ if e + gap <= watermark]
    return sorted(out)


def test_sessions_across_a_restart(spark, tmp_path):
    target, folder = LoggedTable(spark, f"{tmp_path}/out"), f"{tmp_path}/in"
    files = [[(1, 0), (1, 10), (2, 5)], [(1, 45), (2, 200), (3, 100)], [(1, 60), (2, 30), (1, 300), (3, 190)], [(2, 600), (1, 20)]]
    # After the second file the watermark is at minute 140, after the third at 240: (1, 60), (2, 30) and (1, 20) are late.
    late = [(1, 60), (2, 30), (1, 20)]

    def run(k):
        spark.createDataFrame([(u, at(m)) for u, m in files[k]], "user_id long, ts timestamp").coalesce(1).write.parquet(f"{folder}/{k}")
        stream = spark.readStream.schema("user_id long, ts timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(folder)
        return ingest.late_rows(ingest.run_available(ingest.stateful_sessions(stream), target, f"{tmp_path}/checkpoint"))

    dropped = [run(k) for k in range(4)]  # each run is a restart from the checkpoint
    assert dropped == [0, 0, 2, 1]
    rows = [(u, at(m)) for f in files for u, m in f if (u, m) not in late]
    found = sorted((r["user_id"], r["start"], r["end"], r["n"]) for r in target.read().where(F.col("n") > 0).collect())
    assert found == expected(rows, dt.timedelta(minutes=30), at(540)) and (1, at(0), at(40), 2) in found


def test_a_key_has_one_timer():
    """A key with many sessions has one timer at a time, and one call gives all that the watermark has passed."""
    gap, minute, timers, state = 30 * 60_000, 60_000, set(), []

    class Open:
        get = staticmethod(lambda: (state[0],) if state else None)
        exists = staticmethod(lambda: bool(state))
        update = staticmethod(lambda value: state.__setitem__(slice(None), [value[0]]))
        clear = staticmethod(state.clear)

    class Handle:
        getValueState = staticmethod(lambda *of: Open)
        registerTimer = staticmethod(timers.add)
        deleteTimer = staticmethod(timers.remove)

    class Now:
        getCurrentWatermarkInMs = staticmethod(lambda: 1_000 * minute)
        getExpiryTimeInMs = staticmethod(lambda: min(timers))

    p = ingest.SessionProcessor(gap)
    p.init(Handle)
    list(p.handleInputRows((5,), iter([Row(ms=k * 100 * minute) for k in range(20)]), Now))
    assert timers == {gap}
    fired = min(timers)
    out = list(p.handleExpiredTimer((5,), Now, Now))
    timers.remove(fired)
    assert [r["start_ms"] for r in out] == [k * 100 * minute for k in range(10)] and timers == {1_000 * minute + gap}
    list(p.handleInputRows((5,), iter([Row(ms=1_010 * minute)]), Now))
    assert timers == {1_010 * minute + gap} and len(state[0]) == 10
