import datetime as dt

import pytest
from pyspark.sql import functions as F

from recordloom.streaming import resume, state

BASE = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SCHEMA = "key string, at timestamp, asked string, status string, payload string"
DAY = 86400


def at(seconds):
    return BASE + dt.timedelta(seconds=seconds)


def run(spark, tmp_path, batches, kind, stop_after=None):
    """Answers of a stream whose micro-batches are the given lists of events."""
    source, out, checkpoint = (f"{tmp_path}/{x}" for x in ("in", "out", "checkpoint"))
    for events in batches:
        spark.createDataFrame([(k, at(t), *rest) for k, t, *rest in events], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = state.cached(spark.readStream.schema(SCHEMA).parquet(source), kind)
        stream.writeStream.option("checkpointLocation", checkpoint).format("parquet").option("path", out).trigger(availableNow=True).start().awaitTermination()
    return {(r.key, r.asked): (r.hit, r.status, r.payload) for r in spark.read.parquet(out).collect()}


def test_entries_expire_at_their_status_age(spark, tmp_path):
    batches = [
        [("a", 0, None, "unverified", "p1"), ("b", 0, None, "verified", "p2"), ("c", 0, None, "unavailable", "p3"), ("a", 0, "q0", None, None)],
        [("a", 3600, "q1", None, None), ("b", 3600, "q1", None, None), ("c", 3600, "q1", None, None), ("d", 3600, "q1", None, None)],
        [("c", 3601, "q2", None, None), ("a", 7 * DAY, "q2", None, None)],
        [("a", 7 * DAY + 1, "q3", None, None), ("b", 30 * DAY, "q3", None, None)],
        [("b", 30 * DAY + 1, "q4", None, None), ("a", 30 * DAY + 1, None, "verified", "new"), ("a", 30 * DAY + 2, "q4", None, None)],
    ]
    found = run(spark, tmp_path, batches, "verification")
    hits = {k for k, v in found.items() if v[0]}
    assert hits == {("a", "q0"), ("a", "q1"), ("b", "q1"), ("c", "q1"), ("a", "q2"), ("b", "q3"), ("a", "q4")}
    assert found["a", "q4"] == (True, "verified", "new") and found["c", "q2"] == (False, None, None) and len(found) == 11


def test_the_last_entry_counts_and_replays_change_nothing(spark, tmp_path):
    first = [("a", 10, None, "abstract_found", "new"), ("a", 5, None, "abstract_found", "old"), ("a", 7, "early", None, None), (None, 10, None, "x", "null's")]
    batches = [first, [("a", 12, None, "abstract_found", "newest"), ("a", 11, "q", None, None), ("a", 12, "r", None, None), (None, 12, "n", None, None)], [("a", 13, None, None, "z"), ("a", 12, None, "abstract_found", "newest"), ("a", 13 + 6 * DAY, "s", None, None)]]
    found = run(spark, tmp_path, batches, "abstract")
    assert {k: v[2] for k, v in found.items()} == {("a", "early"): "old", ("a", "q"): "new", ("a", "r"): "newest", (None, "n"): "null's", ("a", "s"): "z"}


def test_answers_equal_a_walk_through_all_events(spark, tmp_path):
    import random

    rng, batches, t = random.Random(4), [], 0
    for b in range(4):
        events = []
        for i in range(60):
            t += rng.choice([0, 1, 1800, 3600, DAY])
            key = rng.choice("abcde")
            events.append((key, t, f"{b}-{i}", None, None) if rng.random() < 0.6 else (key, t, None, rng.choice(["unavailable", "unverified", "verified", None]), f"{b}-{i}"))
        batches.append(events)
    want, entries = {}, {}
    for key, when, asked, status, payload in sorted((e for b in batches for e in b), key=lambda e: (e[1], e[2] is not None, e[3] or "", e[4] or "")):
        if asked is None:
            entries[key] = (when, status, payload)
        else:
            old = entries.get(key)
            live = old is not None and when - old[0] <= state.seconds("verification", old[1])
            want[key, asked] = (live, *(old[1:] if live else (None, None)))
    assert run(spark, tmp_path, batches, "verification") == want


def test_a_failed_batch_is_done_again_once(spark, tmp_path):
    source, out, checkpoint = (f"{tmp_path}/{x}" for x in ("in", "out", "checkpoint"))
    broken, seen = [True], []

    def work(df):
        rows = [r.k for r in df.collect()]
        seen.append(sorted(rows))
        if broken[0] and 3 in rows:
            raise RuntimeError("stop")
        return df.withColumn("done", F.lit(True))

    def go():
        resume.resumable(spark.readStream.schema("k int, v string").parquet(source), "k", work, out, checkpoint).awaitTermination()

    spark.createDataFrame([(1, "a"), (2, "b"), (1, "a"), (1, "c")], "k int, v string").write.parquet(source)
    go()
    spark.createDataFrame([(2, "x"), (3, "y")], "k int, v string").write.mode("append").parquet(source)
    with pytest.raises(Exception, match="stop"):
        go()
    broken[0] = False
    go()
    spark.createDataFrame([(4, "z")], "k int, v string").write.mode("append").parquet(source)
    go()
    assert seen == [[1, 2], [3], [3], [4]]  # a batch holds its own unseen keys only
    assert sorted((r.k, r.v) for r in spark.read.parquet(out).collect()) == [(1, "a"), (2, "b"), (3, "y"), (4, "z")]


def test_earlier_results_count_as_done(spark, tmp_path):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.createDataFrame([(1,), (2,)], "k int").write.parquet(f"{out}/batch=old")
    for more, checkpoint in (([1, 3], "one"), ([4, 1], "one"), ([5, 4], "two")):
        spark.createDataFrame([(k,) for k in more], "k int").write.mode("append").parquet(source)
        resume.resumable(spark.readStream.schema("k int").parquet(source), "k", lambda df: df, out, f"{tmp_path}/{checkpoint}").awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(out).select("k").collect()) == [1, 2, 3, 4, 5]
