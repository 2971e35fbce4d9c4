"""Queries on time: latencies, rate limits, confirmations, expiry, downloads; and the same on streams."""

import uuid

from pyspark.sql import functions as F

from hushframe.operators import metrics
from hushframe.plans.inputs import events
from hushframe.sources.staging import shared_folder, staged
from hushframe.sources.versions import KeyedTable
from hushframe.streaming import sink, state

QUERIES, ORACLE_SQL = {}, {}
E = "e AS (SELECT *, epoch_ms(ts) AS ms FROM events)"


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("""WITH w AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events),
   r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM w WHERE k > 2)
   SELECT event_type, n, (min(CASE WHEN i = (n + 1) // 2 THEN value END) + min(CASE WHEN i = n // 2 + 1 THEN value END)) / 2 AS median,
          min(CASE WHEN i = greatest(1, n * 95 // 100) THEN value END) AS p95 FROM r GROUP BY ALL""")
def latency_median_p95(spark, d):
    e = events(spark, d).withColumn("page", F.concat_ws("/", "user_id", "event_type"))
    return metrics.latency(e, "event_type", "page", ["ts", "event_id"], "value", warm=2)


@query(f"""WITH {E} SELECT event_id, CAST(coalesce(greatest(0, 550 - (ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms, event_id))), 0) AS BIGINT) AS delay_ms FROM e""")
def rate_limit(spark, d):
    return state.capture_delays(events(spark, d), "user_id", "ms", "event_id").select("event_id", "delay_ms")


#: Minutes instead of the usual times, as the events are minutes apart.
HOUR = 3_600_000


#: The first confirmation of each click that got one in time.
_CONFIRMED = f"""WITH {E}, p AS (SELECT p.event_id AS id, c.event_id AS c, c.ms AS cms, row_number() OVER (PARTITION BY c.event_id ORDER BY p.ms DESC, p.event_id DESC) AS k
      FROM e p JOIN e c ON c.user_id = p.user_id AND c.event_type = 'purchase' AND c.ms BETWEEN p.ms AND p.ms + 6 * {HOUR} WHERE p.event_type = 'click'),
   f AS (SELECT id, arg_min(c, {{'a': cms, 'b': c}}) AS confirmed_by FROM p WHERE k = 1 GROUP BY id)"""
#: By view the last signup before it, if it has not expired.
_PROVED = f"""WITH {E}, s AS (SELECT r.event_id, p.event_id AS proof, row_number() OVER (PARTITION BY r.event_id ORDER BY p.ms DESC, p.event_id DESC) AS k
      FROM e r JOIN e p ON p.user_id = r.user_id AND p.event_type = 'signup' AND r.ms BETWEEN p.ms AND p.ms + 12 * {HOUR} WHERE r.event_type = 'view')"""


@query(_CONFIRMED + " SELECT event_id, coalesce(confirmed_by, -1) AS confirmed_by FROM e LEFT JOIN f ON f.id = e.event_id WHERE event_type = 'click'")
def pending_confirm(spark, d):
    e = events(spark, d).select("event_id", "user_id", "ms", "event_type")
    return state.confirmed(e.where("event_type = 'click'"), e.where("event_type = 'purchase'"), ["user_id"], "ms", "event_id", 6 * HOUR).select("event_id", F.coalesce("confirmed_by", F.lit(-1)).alias("confirmed_by"))


@query(f"""WITH {E} SELECT p.event_id AS opener, c.event_id AS closer FROM e p JOIN e c ON c.user_id = p.user_id AND c.event_type = 'view'
      AND c.ms BETWEEN p.ms AND p.ms + {HOUR} WHERE p.event_type = 'click'""")
def download_window(spark, d):
    e = events(spark, d).select("event_id", "user_id", "ms", "event_type")
    pairs = state.within(e.where("event_type = 'click'"), e.where("event_type = 'view'"), ["user_id"], "ms", HOUR)
    return pairs.select(F.col("event_id").alias("opener"), F.col("closer.event_id").alias("closer"))


@query(_PROVED + " SELECT e.event_id, coalesce(proof, -1) AS proof FROM e LEFT JOIN s ON s.event_id = e.event_id AND k = 1 WHERE event_type = 'view'")
def proof_expiry(spark, d):
    e = events(spark, d).select("event_id", "user_id", "ms", "event_type")
    return state.unexpired(e.where("event_type = 'signup'"), e.where("event_type = 'view'"), "user_id", "ms", "event_id", 12 * HOUR).select("event_id", F.coalesce("proof", F.lit(-1)).alias("proof"))


@query(f"WITH {E} SELECT user_id, arg_max(event_id, {{'a': ms, 'b': event_id}}) AS last_id, count(*) AS n FROM e GROUP BY user_id")
def last_receipt(spark, d):
    return state.last_values(events(spark, d), "user_id", "ms", "event_id")


@query("""WITH x AS (SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'SANITIZE' WHEN 1 THEN 'VALIDATE' WHEN 2 THEN 'DONE' WHEN 3 THEN 'CONFIRM' WHEN 4 THEN 'STALE' WHEN 5 THEN 'EXECUTE' WHEN 6 THEN 'VERIFY' ELSE 'DONE' END AS stage FROM events)
   SELECT stage, count(*) AS n FROM x GROUP BY stage""")
def stage_trace(spark, d):
    k = F.col("event_id") % 9
    e = events(spark, d).select(
        F.when(k > 0, "x").alias("sanitized"),
        F.when(k == 2, "BLOCK").when(k == 3, "CONFIRM").when(k > 1, "ALLOW").alias("verdict"),
        (k > 3).alias("confirmed"),
        F.when(k == 4, "target role changed").alias("stale"),
        F.when(k > 5, True).alias("executed"),
        F.when(k > 6, True).alias("verified"),
    )
    return state.stage_of(e).groupBy("stage").agg(F.count("*").alias("n"))


#: How far events are out of order in the streams below, and what streams wait for.
JITTER, LATE = 36 * HOUR, "2 days"
#: Events of a stream's file, at most, on the average.
FILE = 250_000


def _stream(spark, d):
    """The events as a stream of files that arrive one after the other, each event up to JITTER late; at the end a row
    without an event tells that later times have come."""
    e = events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    e = staged(e.withColumn("_late", F.col("ms") + F.pmod(F.xxhash64("event_id"), F.lit(JITTER))), "stream-events")
    ends = e.agg(F.min("_late").alias("a"), F.max("_late").alias("b"), F.count("*").alias("n")).first()
    folder = f"{shared_folder(spark)}/stream-in-{uuid.uuid4().hex}"
    turn = F.least(F.floor((F.col("_late") - F.lit(ends["a"] or 0)) * 5 / F.lit(max(1, (ends["b"] or 0) - (ends["a"] or 0)))), F.lit(4))
    rows = e.withColumn("_turn", turn).withColumn("_file", F.xxhash64("event_id", "ms"))
    # A turn is as many files as any other, and one trigger: were its files triggers of their own, the first would push
    # the watermark past what the next ones hold, and each would cost a batch. A row without an event makes each file.
    files = max(1, -(-ends["n"] // (5 * FILE)))
    blank = [F.lit(None).cast(t).alias(c) for c, t in e.drop("_late").dtypes]
    for k in range(5):
        own = rows.where(F.col("_turn") == k).select(*e.drop("_late").columns, F.pmod("_file", F.lit(files)).cast("int").alias("_file"))
        made = spark.range(files).select(*blank, F.col("id").cast("int").alias("_file"))
        own.unionByName(made).repartitionById(files, "_file").drop("_file").write.mode("append").parquet(folder)
    tick = e.agg(F.timestamp_millis(F.max("ms") + 3 * 24 * HOUR).alias("ts")).select(*((F.col(c) if c == "ts" else F.lit(None)).cast(t).alias(c) for c, t in e.drop("_late").dtypes))
    tick.write.mode("append").parquet(folder)
    return spark.readStream.schema(e.drop("_late").schema).option("maxFilesPerTrigger", files).parquet(folder)


@query(ORACLE_SQL["last_receipt"])
def stream_last_receipt(spark, d):
    return sink.finished(state.stream_last_values(_stream(spark, d).where("event_id IS NOT NULL"), "user_id", "ts", "event_id"), "stream_last_receipt", "complete")


@query(ORACLE_SQL["download_window"])
def stream_download_window(spark, d):
    e = _stream(spark, d)
    pairs = state.stream_within(e.where("event_type = 'click'"), e.where("event_type = 'view'"), "user_id", "ts", HOUR, LATE)
    return sink.finished(pairs, "stream_download_window", "append").select("opener", "closer")


@query(ORACLE_SQL["rate_limit"])
def stream_rate_limit(spark, d):
    return sink.finished(state.stream_capture_delays(_stream(spark, d), "user_id", "ts", late=LATE), "stream_rate_limit", "append").select("event_id", "delay_ms")


def _served(spark, d, opener, closer, hours, once):
    e = _stream(spark, d).where(F.col("event_type").isin(opener, closer) | F.col("event_type").isNull()).withColumn("opens", F.col("event_type") == opener)
    return state.stream_served(e, "user_id", "ts", "event_id", "opens", hours * HOUR, once, LATE)


@query(_CONFIRMED + " SELECT id AS event_id, confirmed_by FROM f")
def stream_pending_confirm(spark, d):
    """The clicks that were confirmed in time, and by what."""
    served = sink.finished(_served(spark, d, "click", "purchase", 6, True), "stream_pending_confirm", "append")
    return served.select(F.col("opener").alias("event_id"), F.col("closer").alias("confirmed_by"))


@query(_PROVED + " SELECT event_id, proof FROM s WHERE k = 1")
def stream_proof_expiry(spark, d):
    """The views with a proof that had not expired."""
    served = sink.finished(_served(spark, d, "signup", "view", 12, False), "stream_proof_expiry", "append")
    return served.select(F.col("closer").alias("event_id"), F.col("opener").alias("proof"))


#: Clicks put an action into a user's slot, purchases take it, errors deny it; tokens change every half day.
_SLOT = {
    "kind": "CASE event_type WHEN 'click' THEN 'put' WHEN 'purchase' THEN 'take' WHEN 'error' THEN 'deny' END",
    "token": f"CAST(floor(ms / {12 * HOUR}) AS STRING)",
    "tab": "CASE WHEN event_id % 6 = 0 THEN 'other' ELSE 'tab' END",
    "origin": "CASE WHEN event_id % 7 = 0 THEN 'https://b.org' ELSE 'https://a.org' END",
}
_SLOTS = f"""WITH {E}, s AS (SELECT event_id, user_id, ms, {', '.join(f'{x} AS {n}' for n, x in _SLOT.items())} FROM e WHERE event_type IN ('click', 'purchase', 'error')),
   p AS (SELECT *, last_value(CASE WHEN kind = 'put' THEN {{'id': event_id, 'ms': ms, 'token': token, 'tab': tab, 'origin': origin}} END IGNORE NULLS)
                   OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p FROM s),
   k AS (SELECT *, p.token IS NOT NULL AND token = p.token AND (kind = 'deny' OR (ms - p.ms <= 6 * {HOUR} AND tab = p.tab AND origin = p.origin)) AND kind <> 'put' AS ends FROM p),
   g AS (SELECT k.*, EXISTS (SELECT 1 FROM k b WHERE b.user_id = k.user_id AND b.p.id = k.p.id AND b.ends AND (b.ms < k.ms OR (b.ms = k.ms AND b.event_id < k.event_id))) AS gone FROM k),
   v AS (SELECT event_id, kind, p, CASE WHEN p.id IS NULL OR gone OR token <> p.token THEN CASE kind WHEN 'deny' THEN 'ignored' ELSE 'confirmation token expired or invalid' END
         WHEN kind = 'deny' THEN 'denied' WHEN ms - p.ms > 6 * {HOUR} THEN 'confirmation expired' WHEN tab <> p.tab THEN 'confirmation belongs to a different tab'
         WHEN origin <> p.origin THEN 'tab origin changed after confirmation request' ELSE 'ok' END AS verdict FROM g WHERE kind <> 'put')
   SELECT event_id, kind, CASE WHEN verdict IN ('ok', 'denied') THEN p.id ELSE -1 END AS action, verdict FROM v"""


def _slots(e):
    return e.withColumns({n: F.expr(x) for n, x in _SLOT.items()})


@query(_SLOTS)
def pending_actions(spark, d):
    """Confirmations and denials of a user's pending action: what each of them does, and why not."""
    e = _slots(events(spark, d).select("event_id", "user_id", "ms", "event_type")).where("kind IS NOT NULL")
    return state.pending_actions(e, "user_id", "ms", "event_id", 6 * HOUR).select("event_id", "kind", F.coalesce("action", F.lit(-1)).alias("action"), "verdict")


@query(_SLOTS)
def stream_pending_actions(spark, d):
    e = _slots(_stream(spark, d)).where("kind IS NOT NULL OR event_id IS NULL")
    done = sink.finished(state.stream_pending_actions(e, "user_id", "ts", "event_id", 6 * HOUR, LATE), "stream_pending_actions", "append")
    return done.select("event_id", "kind", F.coalesce("action", F.lit(-1)).alias("action"), "verdict")


@query(f"WITH {E} SELECT user_id, event_type, arg_max(event_id, {{'a': ms, 'b': event_id}}) AS last_id, arg_max(value, {{'a': ms, 'b': event_id}}) AS value FROM e GROUP BY ALL")
def stream_upsert(spark, d):
    """The last event of each user and type, merged batch by batch into a keyed table as they arrive out of order."""
    e = _stream(spark, d).where("event_id IS NOT NULL").select("user_id", "event_type", "ms", F.col("event_id").alias("last_id"), "value")
    table = KeyedTable(spark, f"{shared_folder(spark)}/last-events-{uuid.uuid4().hex}", e.schema, ["user_id", "event_type"], ["ms", "last_id"], buckets=8)
    return sink.upserted(e, "stream_upsert", table).read().select("user_id", "event_type", "last_id", "value")
