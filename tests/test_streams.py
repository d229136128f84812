"""Streams in several micro-batches against plain Python."""

from proofframe.storage import exists, shared_path
from proofframe.streaming import traces

EVENTS = "event_id bigint, user_id bigint, event_type string"


def test_boundaries_in_several_batches(spark):
    path = shared_path(spark, "events")
    events = [(i, i % 5, "error" if i % 3 == 0 else "view") for i in range(60)]
    for a in range(0, 60, 20):
        spark.createDataFrame(events[a : a + 20], EVENTS).coalesce(1).write.mode("append").parquet(path)
    seen, want = {}, []
    for i, user, kind in events:
        if kind == "error":
            seen[user] = seen.get(user, 0) + 1
            want.append((i, seen[user]))
    assert sorted(map(tuple, traces.boundaries(spark, path, EVENTS).collect())) == want
    got = [tuple(r) for r in traces.boundaries(spark, path, EVENTS, files_per_batch=1).collect()]
    # files come in any order: each user's numbers are 1, 2, ... all the same
    for user in range(5):
        assert sorted(k for i, k in got if i % 5 == user) == list(range(1, seen[user] + 1))


def test_boundaries_go_on_in_the_callers_folder_and_old_counters_go(spark):
    source, folder = shared_path(spark, "source"), shared_path(spark, "folder")
    total = 0
    for turn in range(5):
        rows = [(turn * 100 + i, i % 3, "error") for i in range(6)]
        spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string").coalesce(1).write.mode("append").parquet(source)
        got = sorted(map(tuple, traces.boundaries(spark, source, EVENTS, folder=folder).collect()))
        total += 6
        assert len(got) == total and sorted(k for i, k in got if i % 100 % 3 == 1) == list(range(1, 2 * turn + 3))
    kept = [n for n in range(5) if any(exists(spark, f"{folder}/counters/{n}/part={p}") for p in range(traces.PARTS))]
    assert kept == [3, 4]
