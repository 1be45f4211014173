"""Keyed state of streams: caches whose entries expire by their status, and keys that are done.

State lives in Spark's state store, partitioned by key, so a micro-batch touches the entries of its own keys only. A
batch that is replayed after a failure starts from the state before it, and gives the same rows again.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from recordloom.operators.state import EXPIRY

#: The state store that keeps values and timers on disk.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What is known of a key: when it was saved, in milliseconds, its status and what was found.
ENTRY = "saved long, status string, payload string"
ANSWERS = "key string, asked string, at timestamp, hit boolean, status string, payload string"


def use_store(spark) -> None:
    """Have streams of the session keep their state in STORE, which timers and value states need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def seconds(kind: str, status: str | None) -> int:
    """How long an entry of a status lives."""
    return EXPIRY[kind].get(status, EXPIRY[kind][None])


class Cache(StatefulProcessor):
    """One key's entry: the last saved one counts; it answers questions until it expires, and a timer removes it then."""

    def __init__(self, kind: str):
        self.kind = kind

    def init(self, handle) -> None:
        self.handle, self.entry = handle, handle.getValueState("entry", ENTRY)

    def _save(self, row) -> None:
        old = self.entry.get() if self.entry.exists() else None
        order = (row.at, row.status or "", row.payload or "")
        if old is not None and (old[0], old[1] or "", old[2] or "") >= order:
            return  # a replayed or late entry changes nothing
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.entry.update((row.at, row.status, row.payload))
        self.handle.registerTimer(row.at + 1000 * seconds(self.kind, row.status) + 1)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        # in the order of time, what is saved before what is asked at the same time
        for row in sorted(rows, key=lambda r: (r.at, r.asked is not None, r.asked or "", r.status or "", r.payload or "")):
            if row.asked is None:
                self._save(row)
                continue
            entry = self.entry.get() if self.entry.exists() else None
            hit = entry is not None and entry[0] <= row.at <= entry[0] + 1000 * seconds(self.kind, entry[1])
            yield Row(key=key[0], asked=row.asked, at=row.at, hit=hit, status=entry[1] if hit else None, payload=entry[2] if hit else None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        entry = self.entry.get() if self.entry.exists() else None
        if entry is not None and expiredTimerInfo.getExpiryTimeInMs() > entry[0] + 1000 * seconds(self.kind, entry[1]):
            self.entry.clear()
        return iter(())

    def close(self) -> None:
        pass


def cached(events: DataFrame, kind: str, late: str = "1 hour") -> DataFrame:
    """Answers (ANSWERS) of a stream's questions from the entries that came before them.

    `events` has key, at (a timestamp), asked (the question's name; null for an entry), status and payload. Entries of a
    status live as EXPIRY[kind] says, counted from `at`; the last of a key counts, of equal times that with the largest
    status and payload. Events of `late` or more behind the newest of an earlier batch are dropped by the watermark, as
    Spark does; a question that comes in a later batch than a newer entry is asked of that, and misses. Null keys are a key of their own. A key's events of one micro-batch are sorted together, so batches have to be
    bounded (maxFilesPerTrigger, maxBytesPerTrigger).
    """
    use_store(events.sparkSession)
    marked = events.withWatermark("at", late)
    # times move as milliseconds, which a state holds and timers compare
    rows = marked.select(F.col("key").cast("string"), F.unix_millis("at").alias("at"), F.col("at").alias("time"), F.col("asked").cast("string"), F.col("status").cast("string"), F.col("payload").cast("string"))
    found = rows.groupBy("key").transformWithState(Cache(kind), "key string, asked string, at long, hit boolean, status string, payload string", "append", "eventTime")
    return found.withColumn("at", F.timestamp_millis("at"))


class FirstOfKey(StatefulProcessor):
    """Lets the first row of a key pass, once."""

    def init(self, handle) -> None:
        self.done = handle.getValueState("done", "done boolean")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first = min(rows, key=lambda r: repr(tuple(r)))  # the same one whatever their order
        if not self.done.exists():
            self.done.update((True,))
            yield first

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.done.update((True,))

    def close(self) -> None:
        pass


def _one_of_key(key: str):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            best: dict = {}
            keys, rows = batch.column(batch.schema.get_field_index(key)).to_pylist(), batch.to_pylist()
            for i, row in enumerate(rows):
                text = repr(tuple(row.values()))
                if keys[i] not in best or text < best[keys[i]][0]:
                    best[keys[i]] = (text, i)
            yield batch.take(pa.array(sorted(i for _, i in best.values()), pa.int64()))

    return run


def unseen(stream: DataFrame, key: str, done: DataFrame | None = None) -> DataFrame:
    """One row for each key that hasn't come before and isn't among `done`; of a batch's rows of a key the least by its text.

    Tasks reduce what they read to a row for each key before rows move, so a key that many rows have is no hot one. Keys
    are numbers, texts or times; null is one.
    """
    use_store(stream.sparkSession)
    known = None if done is None else done.select(key).distinct().groupBy(key)
    return stream.mapInArrow(_one_of_key(key), stream.schema).groupBy(key).transformWithState(FirstOfKey(), stream.schema, "append", "none", known)
