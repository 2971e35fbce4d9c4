"""Streams of events that arrive out of order, over several files, give what the batch forms give."""

import random
import uuid
from datetime import datetime, timedelta, timezone

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hushframe.functions.times import millis
from hushframe.plans import event_queries
from hushframe.sources.staging import shared_folder
from hushframe.streaming import sink, state

BEGIN = datetime(2024, 1, 1, 12, tzinfo=timezone.utc)
SCHEMA = "user_id long, event_id long, ts timestamp, kind string, token string, tab string, origin string"


def at(seconds):
    return BEGIN + timedelta(seconds=seconds)


def arriving(spark, files, schema=SCHEMA):
    """A stream of files, one a trigger, and a last one that only tells the time."""
    folder = f"{shared_folder(spark)}/in-{uuid.uuid4().hex}"
    width = len(schema.split(", "))
    for rows in [*files, [(None, None, at(10**6), *[None] * (width - 3))]]:
        spark.createDataFrame([(*r, *[None] * (width - len(r))) for r in rows], schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_a_late_confirmation_is_not_served_by_what_came_after_it(spark):
    files = [[(1, 1, at(0), "put"), (1, 3, at(60), "put")], [(1, 2, at(30), "take"), (1, 4, at(90), "take")]]
    s = arriving(spark, files).withColumn("opens", F.col("kind") == "put")
    got = sink.finished(state.stream_served(s, "user_id", "ts", "event_id", "opens", 120_000, True), "t", "append")
    assert sorted((r.opener, r.closer) for r in got.collect()) == [(1, 2), (3, 4)]


def test_the_rate_limit_never_exceeds_the_gap(spark):
    files = [[(1, 1, at(0)), (1, 4, at(31))], [(1, 3, at(0.6)), (1, 2, at(0.4))]]
    got = sink.finished(state.stream_capture_delays(arriving(spark, files), "user_id", "ts"), "t", "append")
    assert {r.event_id: r.delay_ms for r in got.collect()} == {1: 0, 2: 150, 3: 350, 4: 0}


def slots(seed, n, users=3):
    rng = random.Random(seed)
    kinds = ["put", "take", "take", "deny", "other"]
    return [
        (rng.randrange(users), k, at(rng.randrange(6000)), rng.choice(kinds), rng.choice(["a", "a", "b", None]), rng.choice(["1", "1", "2", None]), rng.choice(["x", "x", "y"]))
        for k in range(n)
    ]


def naive_slots(rows, most):
    out, held = {}, {}
    for user, id_, ts, kind, token, tab, origin in sorted(rows, key=lambda r: (r[2], r[1])):
        slot = held.get(user)
        if kind == "put":
            held[user] = (id_, ts, token, tab, origin)
        elif kind in ("take", "deny"):
            known = slot is not None and token is not None and token == slot[2]
            if kind == "deny":
                verdict = "denied" if known else "ignored"
            elif not known:
                verdict = state.UNKNOWN
            elif (ts - slot[1]).total_seconds() * 1000 > most:
                verdict = state.OVERDUE
            elif tab is None or tab != slot[3]:
                verdict = state.OTHER_TAB
            elif origin != slot[4]:
                verdict = state.OTHER_ORIGIN
            else:
                verdict = "ok"
            done = verdict in ("ok", "denied")
            out[id_] = (kind, slot[0] if done else None, verdict)
            if done:
                del held[user]
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_pending_actions_in_batch_and_in_five_shuffled_files(spark, seed):
    rows = slots(seed, 300)
    want = naive_slots(rows, 30_000)
    assert {v for _, _, v in want.values()} == {"ok", "denied", "ignored", state.UNKNOWN, state.OVERDUE, state.OTHER_TAB, state.OTHER_ORIGIN}
    table = spark.createDataFrame(rows, SCHEMA).withColumn("ms", F.unix_millis("ts"))
    batch = state.pending_actions(table, "user_id", "ms", "event_id", 30_000).collect()
    assert {r.event_id: (r.kind, r.action, r.verdict) for r in batch} == want
    shuffled = rows[:]
    random.Random(seed).shuffle(shuffled)
    s = arriving(spark, [shuffled[k::5] for k in range(5)])
    got = sink.finished(state.stream_pending_actions(s, "user_id", "ts", "event_id", 30_000, "2 hours"), "t", "append").collect()
    assert len(got) == len(want) and {r.event_id: (r.kind, r.action, r.verdict) for r in got} == want


def test_state_is_forgotten_after_its_time(spark):
    """An opener is gone once watermarks have passed it by more than its time; later events start anew."""
    files = [[(1, 1, at(0), "put")], [(1, 2, at(5000), "take")], [(1, 3, at(9000), "put"), (1, 4, at(9001), "take")]]
    s = arriving(spark, files).withColumn("opens", F.col("kind") == "put")
    got = sink.finished(state.stream_served(s, "user_id", "ts", "event_id", "opens", 2_000, False, "1 second"), "t", "append")
    assert [(r.opener, r.closer) for r in got.collect()] == [(3, 4)]


@pytest.mark.parametrize("mode", ["append", "complete"])
def test_a_stream_without_files_gives_an_empty_table(spark, tmp_path, mode):
    s = spark.readStream.schema(SCHEMA).parquet(str(tmp_path))
    df = s.select("event_id") if mode == "append" else state.stream_last_values(s, "user_id", "ts", "event_id")
    assert sink.finished(df, "t", mode).count() == 0


def test_events_of_a_turn_are_one_trigger_however_many_files_they_fill(spark, tmp_path, monkeypatch):
    """Six files with events of all times: none of them may come too late because another has been read before it."""
    rows = [(k, BEGIN.replace(tzinfo=None) + timedelta(minutes=45 * (k // 2), milliseconds=300 * (k % 2)), k // 2 % 7, "view", 1.0, None) for k in range(1200)]
    table = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    table.repartition(6, F.xxhash64("event_id")).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(event_queries, "FILE", 100, raising=False)
    want = event_queries.rate_limit(spark, str(tmp_path)).collect()
    got = event_queries.stream_rate_limit(spark, str(tmp_path)).collect()
    assert len(want) == 1200 and sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_milliseconds_are_rounded_as_in_the_sql(spark, tmp_path):
    """times have microseconds; a difference of cut-off milliseconds is one more or less than that of rounded ones."""
    begin = BEGIN.replace(tzinfo=None)
    rows = [(k, begin + timedelta(minutes=k // 2, microseconds=[400, 500_600][k % 2] + 100 * (k // 2)), 1, "click" if k % 2 else "view", 1.0, None) for k in range(40)]
    rows += [(50, begin + timedelta(hours=2, microseconds=600), 2, "click", 1.0, None), (51, begin + timedelta(hours=3, microseconds=1400), 2, "view", 1.0, None)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    for name in ("rate_limit", "download_window", "stream_rate_limit", "stream_download_window"):
        got = event_queries.QUERIES[name](spark, str(tmp_path))
        cursor = duck.execute(event_queries.ORACLE_SQL[name])
        want = sorted(cursor.fetchall())
        assert sorted(map(tuple, got.select(*(c[0] for c in cursor.description)).collect())) == want, name
        if name == "download_window":
            assert (50, 51) in want
    before = spark.sql("SELECT explode(array(timestamp_micros(-501), timestamp_micros(-500), timestamp_micros(-499))) AS ts")
    assert [r.ms for r in before.select(millis(F.col("ts")).alias("ms")).collect()] == [-1, -1, 0]


def test_rows_that_only_tell_the_time_leave_keys_and_ids_as_they_are(spark):
    """in a file with events one such row made doubles of all keys and ids: keys were lost, ids rounded."""
    big, blank = 2**53 + 1, (None, None, at(5))
    users = [big, big + 1, 7, None]
    files = [[(u, big + 10 * k, at(k), "put", "a", "1", "x") for k, u in enumerate(users)] + [blank], [(u, big + 10 * k + 1, at(k + 0.5), "take", "a", "1", "x") for k, u in enumerate(users)] + [blank]]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        s = arriving(spark, files).withColumn("opens", F.col("kind") == "put")
        served = sink.finished(state.stream_served(s, "user_id", "ts", "event_id", "opens", 120_000, True), "t", "append").collect()
        delays = sink.finished(state.stream_capture_delays(s, "user_id", "ts"), "t", "append").collect()
        actions = sink.finished(state.stream_pending_actions(s, "user_id", "ts", "event_id", 30_000), "t", "append").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    ids = {(u, big + 10 * k): big + 10 * k + 1 for k, u in enumerate(users)}
    assert {(r.user_id, r.opener): r.closer for r in served} == ids and len(served) == 4
    assert {(r.user_id, r.event_id): r.delay_ms for r in delays} == {**dict.fromkeys(ids, 0), **{(u, c): 50 for (u, _), c in ids.items()}}
    assert {(r.user_id, r.action): (r.event_id, r.verdict) for r in actions} == {k: (c, "ok") for k, c in ids.items()}


class CountingState:
    """A state and handle in memory, which counts what would be a message to the JVM."""

    def __init__(self):
        self.calls, self.values, self.timers, self.largest = 0, [], set(), 0

    def getListState(self, name, schema):
        own = CountingState()
        own.count = self.count
        return own

    getValueState = getListState

    def count(self):
        self.calls += 1

    def put(self, values):
        self.count()
        self.values = list(values)

    def appendList(self, values):
        self.count()
        self.values += values

    def update(self, value):
        self.count()
        self.values = [value]

    def clear(self):
        self.put([])

    def exists(self):
        self.count()
        return bool(self.values)

    def get(self):
        self.count()
        return self.values if len(self.values) != 1 or isinstance(self.values[0][0], bytes) else self.values[0]

    def registerTimer(self, at):
        self.count()
        self.timers.add(at)

    def deleteTimer(self, at):
        self.count()
        self.timers.remove(at)


def test_a_batch_makes_a_few_calls_to_the_state_however_many_keys_it_has(monkeypatch):
    """F8, F9: a batch took some ten messages to the JVM for each key."""
    monkeypatch.setattr(state, "CHUNK", 300, raising=False)
    handle = CountingState()
    count = lambda held, e: ((e[0], (held or (0, 0))[1] + 1), [(e[1], (held or (0, 0))[1])])
    fold = state.InOrder(count, [], ["user_id", "event_id", "before"], 1000)
    fold.init(handle)
    rows = [(user if user else None, 10_000 - 1000 * turn + user, turn * 1000 + user) for turn in range(3) for user in range(1000)]
    frames = [pd.DataFrame([(u or 0, u is not None, at_, id_, True) for u, at_, id_ in rows[k::2]], columns=["own", "keyed", "ms", "id", "event"]) for k in range(2)]
    assert list(fold.handleInputRows((7,), iter(frames), None)) == [] and handle.timers == {8001}

    def fired(now):
        (timer,) = handle.timers
        got = list(fold.handleExpiredTimer((7,), type("T", (), {"getCurrentWatermarkInMs": lambda self: now})(), None))
        handle.timers.discard(timer)
        return [tuple(None if pd.isna(v) else int(v) for v in r) for f in got for r in f.itertuples(index=False)]

    first = fired(9500)
    assert sorted(r[0] or 0 for r in first if r[2] == 0) == list(range(1000)) and len(first) == 1500
    assert [r[2] for r in fired(20_000) if (r[0] or 0) >= 500] == [1] * 500 + [2] * 500
    assert handle.timers == set() and fold.held.values == [] and fold.waiting.values == []
    assert handle.calls < 40
