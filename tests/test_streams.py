"""Ordered keyed state at any frame size and order, sinks that a batch runs twice on, late rows."""

import datetime as dt
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from attestry.streaming import jobs, sinks

DAY = dt.datetime(2024, 1, 1)


@pytest.fixture
def small_frames(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def shuffled(spark, rows, schema, files=3):
    rows = list(rows)
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, schema).repartition(files)


def test_one_key_over_many_frames(spark, small_frames):
    """One key, hundreds of shuffled rows, frames of ten: the verdicts of a plain pass in order."""
    rows = [("key", f"c{k:04d}", "first" if k == 0 or k % 7 == 3 else f"body {k}", DAY + dt.timedelta(minutes=13 * k)) for k in range(300)]
    found = jobs.in_slices(shuffled(spark, rows, "request_id string, capture_id string, body_hash string, ts timestamp"), lambda x: jobs.stream_conflicts(x, late="2 hours"), flush="3 hours")
    held, want = None, {}
    for _, capture, body, ts in rows:
        if held is None or ts - held[1] >= dt.timedelta(days=1):
            held, want[capture] = (body, ts), "accepted"
        else:
            want[capture] = "replay" if body == held[0] else "conflict"
    assert {r.capture_id: r.verdict for r in found.collect()} == want and len(set(want.values())) == 3


def test_budget_and_chain_over_many_frames(spark, small_frames):
    rows, head = [], "0" * 64
    for k in range(400):
        ts = DAY + dt.timedelta(hours=3 * k, seconds=k % 2)
        own = f"{k:064d}"
        rows.append(("t", k, f"{ts:%Y-%m-%dT%H:%M:%SZ}", ts, 7 + k % 5, k + 1 if k < 200 else k + 3, own, head if k % 50 else "f" * 64))
        head = own
    table = shuffled(spark, rows, "tenant_id string, event_id long, captured_at string, ts timestamp, nano long, chain_height long, receipt_hash string, previous_receipt_hash string")
    spent, want, month, last = 0, [], "", "allow"
    for _, _, at, _, nano, *_ in rows:
        if at[:7] != month:
            month, spent, last = at[:7], 0, "allow"
        spent += nano
        action = "deny" if spent >= 1000 else "throttle" if spent >= 900 else "warn" if spent >= 750 else "allow"
        if action != last:
            want.append((month, action, spent))
            last = action
    found = jobs.in_slices(table, lambda x: jobs.stream_budget(x, 1000), flush="2 hours")
    assert sorted((r.month, r.action, r.spent_nano) for r in found.collect()) == sorted(want) and len(want) > 3
    verdicts = Counter((r.chain_height, r.verdict) for r in jobs.in_slices(table, jobs.stream_chain, flush="2 hours").collect())
    assert verdicts[(202, "gap")] == 1 and verdicts[(203, "broken")] == 1
    assert sum(verdicts.values()) == 401 and {h for h, v in verdicts if v == "broken"} == {1, 51, 101, 151, 203, 253, 303, 353}


def test_prompt_cache_over_many_frames(spark, small_frames):
    rng = random.Random(2)
    rows = sorted(("p", k, int(1.7e9) + rng.randrange(200_000)) for k in range(250))
    table = shuffled(spark, [(p, k, at, dt.datetime.fromtimestamp(at, dt.timezone.utc).replace(tzinfo=None)) for p, k, at in rows], "prompt_key string, event_id long, at_s long, ts timestamp")
    stored, want = None, {}
    for _, k, at in sorted(rows, key=lambda r: (r[2], r[1])):
        want[k] = stored is not None and at - stored < 3600
        stored = stored if want[k] else at
    found = jobs.in_slices(table, jobs.stream_prompt_cache, flush="3 hours")
    assert {r.event_id: r.hit for r in found.collect()} == want


def test_a_batch_that_runs_again_leaves_one_copy(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = spark.range(10)
    for batch in (0, 1, 1, 0):
        sinks.write_once(rows, path, batch)
    assert sinks.read_once(spark, path, "id long").count() == 20
    assert sinks.read_once(spark, f"{path}-none", "id long").count() == 0


def test_a_fanout_that_runs_again_delivers_once(spark, tmp_path):
    """The first sink breaks after it has written, once; then the batch as a whole runs again."""
    from attestry.sources import readers

    broken, path = [True], f"file://{tmp_path}/fan"

    def first(rows):
        sinks.write_once(rows, f"{path}/a", 7)
        if broken.pop() if broken else False:
            raise OSError("the connection was lost after the write")

    for _ in range(2):
        report = readers.export_fanout(spark.range(12), [first, lambda rows: sinks.write_once(rows, f"{path}/b", 7)])
        assert [(ok, n) for _, ok, n, _ in report] == [(True, 12), (True, 12)]
    assert [sinks.read_once(spark, f"{path}/{name}", "id long").count() for name in "ab"] == [12, 12]


def test_ingest_after_a_lost_commit(spark, sf_dir, tmp_path):
    """The last commit of the checkpoint is taken away, as if the job had died before it: the batch runs again."""
    from attestry.jobs.texts import raw_events

    raw_events(spark, sf_dir).limit(300).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    base = f"file://{tmp_path}"
    run = lambda: jobs.stream_ingest(stream(), f"{base}/good", f"{base}/bad", f"{base}/state")
    run()
    for f in (tmp_path / "state" / "commits").iterdir():
        f.unlink()
    run()
    total = sum(sinks.read_once(spark, f"{base}/{name}", "receipt_id string").count() for name in ("good", "bad"))
    assert total == 300


def test_late_rows_and_the_rest_are_the_input(spark, tmp_path):
    """Rows come over six batches, some behind the watermark; downstream windows over what passed drop nothing."""
    rng, path = random.Random(3), f"file://{tmp_path}/gate"
    batch, mark, late, rows = sinks.gate(path), None, set(), []
    for b in range(6):
        some = [(100 * b + k, DAY + dt.timedelta(hours=10 * b, minutes=rng.randrange(-900, 600))) for k in range(40)] + [(100 * b + 99, None)]
        rows += some
        late |= {k for k, ts in some if ts is None or (mark is not None and ts <= mark - dt.timedelta(hours=1))}
        mark = max([ts for _, ts in some if ts] + ([mark] if mark else []))
        for _ in range(2):  # each batch twice
            batch(spark.createDataFrame(some, "id long, ts timestamp"), b)
    read = lambda name: [r.id for r in sinks.read_once(spark, f"{path}/{name}", "id long").collect()]
    assert sorted(read("side")) == sorted(late) and sorted(read("main") + read("side")) == sorted(k for k, _ in rows) and len(late) > 10


def test_approvals_in_time_order(spark):
    hour = lambda h: DAY + dt.timedelta(hours=h)
    epoch = lambda h: int(hour(h).replace(tzinfo=dt.timezone.utc).timestamp())
    asked = [("a", hour(0), epoch(48)), ("b", hour(1), epoch(48)), ("c", hour(2), epoch(10)), ("d", hour(3), epoch(48)), ("e", hour(4), epoch(48))]
    told = [
        ("a", "x", "approve", hour(5), 1), ("a", "x", "approve", hour(6), 2), ("a", "y", "approve", hour(7), 3), ("a", "z", "reject", hour(8), 4),
        ("b", "x", "approve", hour(5), 1), ("b", "y", "reject", hour(6), 2), ("b", "z", "approve", hour(7), 3),
        ("c", "x", "approve", hour(9), 1), ("c", "y", "approve", hour(10), 2), ("d", "x", "approve", hour(9), 1), ("d", "x", "reject", hour(10), 2), ("nobody", "x", "approve", hour(9), 1),
    ]
    one = spark.createDataFrame(asked, "request string, ts timestamp, deadline_s long").withColumn("side", F.lit("asked"))
    two = spark.createDataFrame(told, "request string, approver string, decision string, ts timestamp, seq long").withColumn("side", F.lit("told"))
    side = lambda rows, name: rows.where(f"side = '{name}' or side is null")
    found = jobs.in_slices(one.unionByName(two, allowMissingColumns=True), lambda r: jobs.stream_approvals(side(r, "asked"), side(r, "told"), longest="2 days"), slices=2, flush="9 days", on_disk=False)
    assert {(r.request, r.status, r.seq) for r in found.collect()} == {("a", "approved", 3), ("b", "rejected", 2), ("c", "expired", None), ("d", "expired", None), ("e", "expired", None)}


def test_state_is_called_by_frames_and_buckets():
    """A frame that waits is one entry of the state, held values are read and written by buckets, not by rows or keys."""
    import pandas as pd

    from attestry.streaming.ordered import BUCKETS, InOrder

    class State:
        def __init__(self):
            self.rows, self.values, self.calls = [], {}, 0

        def __getattr__(self, name):
            self.calls += 1
            return {
                "appendList": self.rows.extend, "get": lambda: iter(list(self.rows)), "clear": self.rows.clear, "put": lambda r: self.rows.__setitem__(slice(None), r), "exists": lambda: False, "update": lambda v: None,
                "containsKey": self.values.__contains__, "getValue": self.values.__getitem__, "updateValue": self.values.__setitem__, "iterator": lambda: iter(list(self.values.items())), "removeKey": self.values.pop,
            }[name]

    class Handle:
        def __init__(self):
            self.made = {}

        def _state(self, name, *_):
            return self.made.setdefault(name, State())

        getListState = getMapState = getValueState = _state

        def registerTimer(self, at): ...

    class Times:
        def getCurrentWatermarkInMs(self):
            return 500

    handle = Handle()
    step = lambda held, row: ((row[1],), [(row[0], row[1], held and held[0])])
    job = InOrder("key string, event_ms long", ["key", "at", "last"], step, 0, 1, lambda held: held[0] + 300)
    job.init(handle)
    frame = pd.DataFrame({"key": [f"k{n % 400}" for n in range(1000)][::-1], "event_ms": list(range(1000))[::-1]})
    assert list(job.handleInputRows(0, iter([frame[:600], frame[600:]]), None)) == []
    assert len(handle.made["waiting"].rows) == 2
    (out,) = job.handleExpiredTimer(0, Times(), None)
    assert [tuple(r) for r in out[["key", "at"]].itertuples(index=False)] == [(f"k{n % 400}", n) for n in range(500)]
    assert [r for r in out["last"].tolist() if r == r] == list(range(100))
    assert len(handle.made["waiting"].rows) == 1 and 0 < handle.made["held"].calls <= 4 * BUCKETS


class Kept(dict):
    def __init__(self):
        self.rows, self.added = [], 0

    def appendList(self, rows):
        self.added += 1
        self.rows += rows

    def updateValue(self, key, value):
        self[key] = value

    get = lambda self, *_: iter(list(self.rows))
    put = lambda self, rows: self.rows.__setitem__(slice(None), rows)
    clear = lambda self: self.rows.clear()
    exists = lambda self: False
    update = lambda self, _: None
    getValue, containsKey, removeKey = dict.__getitem__, dict.__contains__, dict.pop
    iterator = lambda self: iter(list(self.items()))


class Handle:
    def __init__(self):
        self.made = {}

    def _state(self, name, *_):
        return self.made.setdefault(name, Kept())

    getListState = getMapState = getValueState = _state

    def registerTimer(self, at): ...


class Times:
    def __init__(self, mark):
        self.mark = mark

    def getCurrentWatermarkInMs(self):
        return self.mark


def test_rows_that_wait_are_not_read_again_when_more_come():
    """The list of what waits holds numbers and times alone, as the store reads it at each addition; rows lie under their frame's number and go by it."""
    import pandas as pd

    from attestry.streaming.ordered import ROWS, InOrder

    handle, n = Handle(), 3 * ROWS
    job = InOrder("key string, event_ms long, note string", ["key", "at", "note"], lambda held, row: ((), [row]), 0, 1, None)
    job.init(handle)
    frame = pd.DataFrame({"key": "k", "event_ms": range(n), "note": [None, "x"] * (n // 2)}).sample(frac=1, random_state=1)
    for half in (frame[: n // 2], frame[n // 2 :]):
        list(job.handleInputRows(0, iter([half[k : k + 1000] for k in range(0, len(half), 1000)]), None))
    waiting, frames = handle.made["waiting"], handle.made["frames"]
    assert waiting.added == 2 and len(waiting.rows) == len(frames) > 40 and all(isinstance(x, int) for row in waiting.rows for x in row)
    told = [list(job.handleExpiredTimer(0, Times(mark), None)) for mark in (n // 2, 10 * n)]
    assert not frames and not waiting.rows and max(len(f) for out in told for f in out) == ROWS
    rows = [tuple(r) for out in told for f in out for r in f.itertuples(index=False)]
    assert rows == [("k", at, "x" if at % 2 else None) for at in range(n)] and sum(map(len, told[0])) == n // 2


def test_approvals_against_a_plain_pass():
    """Random requests and decisions in shuffled frames and several marks: each request is told once, when its time is over, and no row stays that can't count."""
    import pandas as pd

    from attestry.streaming.decided import FIELDS, NONE, WAKE, Decided

    rng, hour = random.Random(4), 3_600_000_000
    asked, told = {}, []
    for k in range(300):
        at = rng.randrange(100) * hour
        asked[f"r{k}"] = (at, at - 5 * hour, at + rng.randrange(-2, 40) * hour, rng.choice([k, NONE]))
    for seq in range(3000):
        told.append((f"r{rng.randrange(330)}", rng.randrange(160) * hour, rng.choice(["x", "y", "z", "w", None]), rng.choice(["approve", "approve", "approve", "reject", "other", None]), rng.choice([seq, 1, NONE])))
    rows = [(r, at, True, low, high, deadline, None, None, NONE) for r, (at, low, high, deadline) in asked.items()] + [(r, at, False, at + 5 * hour, 0, NONE, who, what, seq) for r, at, who, what, seq in told]
    want = {}
    for r, (_, low, high, deadline) in asked.items():
        seen, yes, found = set(), 0, ("expired", NONE)
        own = [d for d in told if d[0] == r and low <= d[1] <= high]
        for _, _, who, what, seq in sorted(own, key=lambda d: (d[1], d[4], d[3] != "reject", d[3] or "")):
            if who not in seen and found[0] == "expired":
                seen.add(who)
                yes += what == "approve"
                found = ("rejected", seq) if what == "reject" else ("approved", seq) if yes >= 2 else found
        want[r] = (deadline, *found)
    handle, job = Handle(), Decided(2)
    job.init(handle)
    got, mark = [], 0
    for until in (0, 30, 60, 90, 200, 400):
        batch = [x for x in rows if mark <= x[1] // 1000 < until * WAKE]
        rng.shuffle(batch)
        frame = pd.DataFrame(batch, columns=list(FIELDS))
        list(job.handleInputRows(0, iter([frame[k : k + 100] for k in range(0, len(frame), 100)]), Times(mark)))
        mark = until * WAKE
        for out in job.handleExpiredTimer(0, Times(mark), None):
            assert all(asked[r][2] < 1000 * mark for r in out["request"])
            got += [tuple(x) for x in out.itertuples(index=False)]
    assert sorted(got) == sorted((r, *w) for r, w in want.items()) and {w[1] for w in want.values()} == {"approved", "rejected", "expired"}
    assert not handle.made["frames"] and not handle.made["waiting"].rows
