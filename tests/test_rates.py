"""A source's rate over several tasks."""

from recordloom.sources import candidates


class Clock:
    def __init__(self):
        self.now = 1000.3

    def __call__(self):
        return self.now

    def sleep(self, seconds):
        self.now += seconds


def test_slots_keep_the_spacing(tmp_path):
    clock = Clock()
    limiter = candidates.SlotLimiter("x", 0.5, 1, 3, None, clock, clock.sleep)
    times = []
    for _ in range(4):
        limiter.wait()
        times.append(clock.now)
    assert times == [1001.0 + 0.5 * (3 * i + (1 - 2002) % 3) for i in range(4)]
    # one that is started again in the running slot waits for the next of its own
    again = candidates.SlotLimiter("x", 0.5, 1, 3, None, clock, clock.sleep)
    clock.now += 0.1
    again.wait()
    assert clock.now == times[-1] + 1.5


def test_all_tasks_keep_a_pause(tmp_path):
    clock = Clock()
    pauses = candidates.Pauses(str(tmp_path / "pauses"))
    assert pauses.get("x") == 0.0
    told = candidates.SlotLimiter("x", 0.5, 0, 2, pauses, clock, clock.sleep)
    told.wait()
    told.defer(20.0)
    other = candidates.SlotLimiter("y", 0.5, 1, 2, pauses, clock, clock.sleep)
    began = clock.now
    other.wait()
    assert clock.now - began <= 1.0  # another source's pause
    started_again = candidates.SlotLimiter("x", 0.5, 0, 2, candidates.Pauses(f"file:{tmp_path}/pauses"), clock, clock.sleep)
    started_again.wait()
    assert 20.0 <= clock.now - began <= 21.5

    def told_meanwhile(seconds):
        pauses.put("z", clock.now + 5.0) if not pauses.get("z") else None
        clock.sleep(seconds)

    waiting = candidates.SlotLimiter("z", 0.5, 1, 2, pauses, clock, told_meanwhile)
    began = clock.now
    waiting.wait()
    assert clock.now - began >= 5.0


def test_several_tasks_ask_a_source_together(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()

    def fetch(source, title, record):
        import time

        from pyspark import TaskContext

        now = time.time()
        (log / f"{source}-{now:.6f}-{TaskContext.get().partitionId()}-{record}").touch()
        time.sleep(0.2)  # longer than the spacing: one task alone would be slower
        if record == "3":
            return 404, None, b""
        return 200, None, title.encode()

    asked = spark.createDataFrame([(str(i), "slow", f"title {i}") for i in range(24)] + [(str(i), "other", f"other {i}") for i in range(4)], "record string, source string, title string")
    found = candidates.live_candidates(asked, fetch, 4, candidates.Pauses(str(tmp_path / "pauses")), {"slow": 0.15, "other": 0.15}).collect()
    assert sorted((r.record, r.source, r.payload, r.error) for r in found) == sorted([(str(i), "slow", None if i == 3 else f"title {i}", "HTTP 404" if i == 3 else None) for i in range(24)] + [(str(i), "other", None if i == 3 else f"other {i}", "HTTP 404" if i == 3 else None) for i in range(4)])
    calls = [x.name.split("-") for x in log.iterdir()]
    slow = sorted((float(now), task) for source, now, task, _ in calls if source == "slow")
    assert len(slow) == 24 and len({task for _, task in slow}) >= 2
    slots = [int(now / 0.15) for now, _ in slow]
    assert len(set(slots)) == 24 and min(b[0] - a[0] for a, b in zip(slow, slow[1:])) > 0.05
