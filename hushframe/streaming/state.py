"""State over time: rate limits, actions that wait for confirmation, expiry, last values, download windows.

Each has a batch form over a table of events and a streaming form over a stream of them that gives the same rows, also
where events arrive out of order. Event times must be TIMESTAMP (not NTZ) on streams, as watermarks need.
"""

from __future__ import annotations

import pickle
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from hushframe.functions.times import millis

CAPTURE_GAP_MS = 550
CONFIRM_MS = 2 * 60 * 1000
PROOF_MS = 10 * 60 * 1000
DOWNLOAD_MS = 3500
#: For state that stays until it is overwritten.
FOREVER = 1 << 52


def capture_delays(events: DataFrame, key: str, ms: str, order: str, gap: int = CAPTURE_GAP_MS) -> DataFrame:
    """Adds delay_ms: what is left of the gap since the key's event before; 0 for its first."""
    before = F.lag(ms).over(Window.partitionBy(key).orderBy(ms, order))
    return events.withColumn("delay_ms", F.coalesce(F.greatest(F.lit(0).cast("bigint"), F.lit(gap) - (F.col(ms) - before)), F.lit(0).cast("bigint")))


def within(openers: DataFrame, closers: DataFrame, keys: list[str], ms: str, most: int) -> DataFrame:
    """Pairs of an opener and a closer of the same keys, at most so many milliseconds later.

    Time is cut into windows of that length: a pair's times lie in the same window or the next, so that the join has
    an equality on the window and a busy key doesn't meet all of its events.
    """
    size = F.lit(most)
    left = openers.withColumn("_w", F.explode(F.array(F.floor(F.col(ms) / size), F.floor(F.col(ms) / size) + 1)))
    right = closers.select(*(F.col(k).alias(f"_{k}") for k in keys), F.floor(F.col(ms) / size).alias("_v"), F.struct(*closers.columns).alias("closer"))
    same = F.col("_w") == F.col("_v")
    for k in keys:
        same &= F.col(k) == F.col(f"_{k}")
    pairs = left.join(right, same & F.col(f"closer.{ms}").between(F.col(ms), F.col(ms) + size))
    return pairs.drop("_w", "_v", *(f"_{k}" for k in keys))


def confirmed(pending: DataFrame, confirms: DataFrame, keys: list[str], ms: str, id_: str, most: int = CONFIRM_MS) -> DataFrame:
    """Adds confirmed_by: the first confirmation of a pending action in time, or null. Taken once: a confirmation
    serves the latest pending action before it."""
    pairs = within(pending, confirms, keys, ms, most)
    last = pairs.groupBy(F.col(f"closer.{id_}").alias("_c"), F.col(f"closer.{ms}").alias("_at")).agg(F.max_by(F.col(id_), F.struct(ms, id_)).alias(id_))
    first = last.groupBy(id_).agg(F.min_by("_c", F.struct("_at", "_c")).alias("confirmed_by"))
    return pending.join(first, id_, "left")


def last_values(events: DataFrame, key: str, ms: str, id_: str) -> DataFrame:
    """By key the id of the last event, and how many there were."""
    return events.groupBy(key).agg(F.max_by(F.col(id_), F.struct(ms, id_)).alias("last_id"), F.count("*").alias("n"))


def unexpired(proofs: DataFrame, reads: DataFrame, key: str, ms: str, id_: str, ttl: int = PROOF_MS) -> DataFrame:
    """By read event the last proof of its key before it, if not older than its time to live; null otherwise."""
    pairs = within(proofs, reads, [key], ms, ttl)
    seen = pairs.groupBy(F.col(f"closer.{id_}").alias(id_)).agg(F.max_by(F.col(id_), F.struct(ms, id_)).alias("proof"))
    return reads.join(seen, id_, "left")


def stream_last_values(events: DataFrame, key: str, ts: str, id_: str) -> DataFrame:
    """For output mode complete or update: the last event of each key so far."""
    return events.groupBy(key).agg(F.max_by(F.col(id_), F.struct(millis(F.col(ts)), id_)).alias("last_id"), F.count("*").alias("n"))


def stream_within(openers: DataFrame, closers: DataFrame, key: str, ts: str, ms: int, late: str = "10 minutes") -> DataFrame:
    """The interval join on streams: state is dropped once watermarks pass the interval. Times are compared in whole
    milliseconds, as in ``within``, for which a pair may be a millisecond nearer than it is."""
    a = openers.select(F.col(key), F.col(ts).alias("opened"), F.col("event_id").alias("opener")).withWatermark("opened", late)
    b = closers.select(F.col(key).alias("_k"), F.col(ts).alias("closed"), F.col("event_id").alias("closer")).withWatermark("closed", late)
    roughly = F.expr(f"{key} = _k AND closed >= opened - interval 1 millisecond AND closed <= opened + interval {ms + 1} milliseconds")
    apart = millis(F.col("closed")) - millis(F.col("opened"))
    return a.join(b, roughly & apart.between(0, ms)).drop("_k")


# Why a confirmation is turned down.
UNKNOWN, OVERDUE = "confirmation token expired or invalid", "confirmation expired"
OTHER_TAB, OTHER_ORIGIN = "confirmation belongs to a different tab", "tab origin changed after confirmation request"


def pending_actions(events: DataFrame, key: str, ms: str, id_: str, most: int = CONFIRM_MS) -> DataFrame:
    """Of each take and deny (kind, token, tab, origin beside key, time and id): action, the put that it serves or removes,
    and verdict.

    A key has one slot: a put overwrites it. A take serves the put in it if token, tab and origin are the put's own and
    it is at most ``most`` milliseconds old, and empties the slot: ``ok``, taken once. A deny of that token empties it:
    ``denied``. A take that is turned down says why and leaves the slot as it is; a deny of another token is ``ignored``.
    Events are ordered by time, then id. Null tokens, tabs and origins match nothing.
    """
    order = Window.partitionBy(key).orderBy(ms, id_)
    put = F.last(F.when(F.col("kind") == "put", F.struct(id_, ms, "token", "tab", "origin")), ignorenulls=True).over(order)
    same = lambda c: F.coalesce(F.col(c) == F.col(f"_put.{c}"), F.lit(False))
    e = events.withColumn("_put", put)
    young = F.col(ms) - F.col(f"_put.{ms}") <= most
    fits = same("token") & young & same("tab") & same("origin")
    e = e.withColumn("_ends", ((F.col("kind") == "take") & fits) | ((F.col("kind") == "deny") & same("token")))
    earlier = Window.partitionBy(key, F.col(f"_put.{id_}")).orderBy(ms, id_).rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("_gone", F.coalesce(F.max("_ends").over(earlier), F.lit(False)))
    known = F.col("_put").isNotNull() & same("token") & ~F.col("_gone")
    verdict = (
        F.when(F.col("kind") == "deny", F.when(known, "denied").otherwise("ignored"))
        .when(~known, UNKNOWN)
        .when(~young, OVERDUE)
        .when(~same("tab"), OTHER_TAB)
        .when(~same("origin"), OTHER_ORIGIN)
        .otherwise("ok")
    )
    e = e.withColumn("verdict", verdict).withColumn("action", F.when(F.col("verdict").isin("ok", "denied"), F.col(f"_put.{id_}")))
    return e.where("kind IN ('take', 'deny')").drop("_put", "_ends", "_gone")


#: How many groups of keys a stream's state is dealt into, and how many rows of it are one value at most.
BUCKETS, CHUNK = 256, 10_000


def _packed(rows: list[tuple]) -> list[tuple[bytes]]:
    return [(pickle.dumps(rows[k : k + CHUNK], pickle.HIGHEST_PROTOCOL),) for k in range(0, len(rows), CHUNK)]


def _unpacked(state) -> list[tuple]:
    return [r for (chunk,) in state.get() for r in pickle.loads(chunk)]


class InOrder(StatefulProcessor):
    """Hands each key's events to a fold in the order of their times, however they arrive.

    The state is that of a bucket of keys, not of one key: each call to it costs a message to the JVM, and a batch makes a
    few calls a bucket however many keys and events there are. Events wait in list state, many in one value, until the
    watermark has passed them: nothing earlier can come any more. A timer of each bucket stands at its first waiting
    event; when it fires, what is due is folded, and what the fold remembers of each key goes to another list, for ``keep``
    milliseconds after the key's last event at least. ``step`` gets the memory (a tuple, or None at first) and an event
    (time, id and further fields), and returns the new memory and rows to add after the key.
    """

    def __init__(self, step, more: list[str], out: list[str], keep: int):
        self.step, self.more, self.out, self.keep = step, more, out, keep

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.held = handle.getListState("held", "rows binary")
        self.clock = handle.getValueState("clock", "timer long")

    def _at(self, old: int, timer: int) -> None:
        """One timer for the bucket, at the given time (0: none)."""
        if old != timer:
            if old:
                self.handle.deleteTimer(old)
            if timer:
                self.handle.registerTimer(timer)
            self.clock.update((timer,))

    @staticmethod
    def _keep(state, rows: list[tuple]) -> None:
        if rows:
            state.put(_packed(rows))
        else:
            state.clear()

    def handleInputRows(self, key, rows, timerValues):
        first = None
        for batch in rows:
            batch = batch[batch["event"]]
            if len(batch):
                owners = [k if there else None for k, there in zip(batch["own"].tolist(), batch["keyed"].tolist())]
                self.waiting.appendList(_packed(list(zip(owners, *(batch[c].tolist() for c in ("ms", "id", *self.more))))))
                earliest = int(batch["ms"].min()) + 1
                first = earliest if first is None else min(first, earliest)
        if first is not None:
            old = self.clock.get()[0] if self.clock.exists() else 0
            self._at(old, min(first, old or first))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        events = _unpacked(self.waiting)
        due, rest = [r for r in events if r[1] < now], [r for r in events if r[1] >= now]
        due.sort(key=itemgetter(1, 2))
        memory = {owner: (last, held) for owner, last, held in _unpacked(self.held)}
        out = []
        for owner, *event in due:
            _, held = memory.get(owner, (0, None))
            held, rows = self.step(held, event)
            memory[owner] = (event[0], held)
            out += [(owner, *r) for r in rows]
        kept = [(owner, last, held) for owner, (last, held) in memory.items() if held is not None and last + self.keep >= now]
        if due:
            self._keep(self.waiting, rest)
        self._keep(self.held, kept)
        timers = [min(r[1] for r in rest) + 1] if rest else []
        if kept and self.keep < FOREVER:
            timers.append(min(last for _, last, _ in kept) + self.keep + 1)
        self.clock.update((0,))
        self._at(0, min(timers, default=0))
        if out:
            yield pd.DataFrame(out, columns=self.out)

    def close(self) -> None:
        pass


def in_order(events: DataFrame, key: str, ts: str, id_: str, late: str, step, more: list[str], rows: str, keep: int, buckets: int = BUCKETS) -> DataFrame:
    """events through an InOrder fold: ``more`` names further fields of an event, ``rows`` what the fold returns. Events up to
    ``late`` behind the latest one seen count; older ones are dropped. An event without an id only tells the time. Needs the
    RocksDB state store (``streaming.sink.finished`` sets it).

    A bucket's waiting events and memories are held by one task at once; ``buckets`` must stay as it is for as long as a
    stream's state is used. Keys, times and ids reach Python without nulls: pandas would make doubles of all that come in
    one batch with a null, in which large numbers are rounded. Integers in ``more`` must not be null.
    """
    kind = dict(events.dtypes)[key]
    told = F.col(id_).isNotNull()
    e = events.withWatermark(ts, late).select(
        F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket"), ts, F.col(key).isNotNull().alias("keyed"), told.alias("event"),
        F.coalesce(F.col(key), F.lit("0").cast(kind)).alias("own"), F.coalesce(F.col(id_).cast("long"), F.lit(0)).alias("id"),
        F.coalesce(millis(F.col(ts)), F.when(told, F.raise_error(F.lit("an event without a time"))).otherwise(F.lit(0)).cast("long")).alias("ms"), *more,
    )
    fold = InOrder(step, more, [key, *(r.split()[0] for r in rows.split(", "))], keep)
    return e.groupBy("bucket").transformWithStateInPandas(fold, f"{key} {kind}, {rows}", "Append", "EventTime")


def stream_capture_delays(events: DataFrame, key: str, ts: str, id_: str = "event_id", gap: int = CAPTURE_GAP_MS, late: str = "10 minutes") -> DataFrame:
    """The rate limit on a stream, events in any order up to ``late``: key, event_id and delay_ms."""

    def step(memory, event):
        delay = max(0, gap - (event[0] - memory[0])) if memory else 0
        return (event[0],), [(event[1], delay)]

    return in_order(events, key, ts, id_, late, step, [], "event_id long, delay_ms long", gap)


def stream_served(events: DataFrame, key: str, ts: str, id_: str, opens: str, most: int, once: bool, late: str = "10 minutes") -> DataFrame:
    """Confirmations and expiry on a stream: key, opener and closer of each closer that an opener serves.

    ``opens`` says of each event whether it opens (an action that waits, a proof) or closes (a confirmation, a read). A
    closer is served by the last opener of its key before it or at the same time, if that is at most ``most``
    milliseconds ago; with ``once`` an opener serves its first closer only. Events may come in any order up to ``late``.
    """
    ordered = events.withColumn("opens", F.coalesce(F.col(opens), F.lit(False)))
    # At equal times openers come first.
    rank = F.col(id_).cast("long") + F.when(F.col("opens"), F.lit(-(2**62))).otherwise(F.lit(0)).cast("long")
    ordered = ordered.withColumn("_rank", rank)

    def step(memory, event):
        at, opener, done = memory or (0, None, False)
        ms, rank, opens_ = event
        if opens_:
            return (ms, rank + 2**62, False), []
        if opener is not None and ms - at <= most and not (once and done):
            return (at, opener, True), [(opener, rank)]
        return (at, opener, done), []

    return in_order(ordered, key, ts, "_rank", late, step, ["opens"], "opener long, closer long", most)


def stream_pending_actions(events: DataFrame, key: str, ts: str, id_: str, most: int = CONFIRM_MS, late: str = "10 minutes") -> DataFrame:
    """``pending_actions`` on a stream, events in any order up to ``late``: key, id, kind, action and verdict."""

    def step(memory, event):
        ms, id__, kind, token, tab, origin = event
        if kind == "put":
            return (id__, ms, token, tab, origin, True), []
        put, at, own_token, own_tab, own_origin, there = memory or (None, 0, None, None, None, False)
        known = there and token is not None and token == own_token
        if kind == "deny":
            verdict = "denied" if known else "ignored"
        elif not known:
            verdict = UNKNOWN
        elif ms - at > most:
            verdict = OVERDUE
        elif tab is None or tab != own_tab:
            verdict = OTHER_TAB
        elif origin is None or origin != own_origin:
            verdict = OTHER_ORIGIN
        else:
            verdict = "ok"
        ended = verdict in ("ok", "denied")
        memory = (put, at, own_token, own_tab, own_origin, there and not ended)
        return memory, [(id__, kind, put if ended else None, verdict)]

    e = events.where("kind IS NULL OR kind IN ('put', 'take', 'deny')")
    # A slot that nobody empties holds its put: a take says that it came too late, not that it is unknown.
    return in_order(e, key, ts, id_, late, step, ["kind", "token", "tab", "origin"], "event_id long, kind string, action long, verdict string", FOREVER)


def stage_of(event: DataFrame) -> DataFrame:
    """Adds stage from the fields of a step's events, in the order in which a step goes through its stages."""
    c = F.col
    return event.withColumn(
        "stage",
        F.when(c("sanitized").isNull(), "SANITIZE")
        .when(c("verdict").isNull(), "VALIDATE")
        .when(c("verdict") == "BLOCK", "DONE")
        .when((c("verdict") == "CONFIRM") & ~F.coalesce(c("confirmed"), F.lit(False)), "CONFIRM")
        .when(c("stale").isNotNull(), "STALE")
        .when(c("executed").isNull(), "EXECUTE")
        .when(c("verified").isNull(), "VERIFY")
        .otherwise("DONE"),
    )
