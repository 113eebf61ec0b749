"""A machine on a stream in small batches, with late and repeated events and a restart, against the same machine over a table."""

import random

from pyspark.sql import functions as F

from quillon.streaming import machines

HOUR = 3_600_000
LIFE = machines.Machine(
    "new",
    {("new", "send"): "sent", ("sent", "arrive"): "delivered", ("delivered", "reply"): "replied", ("sent", "reply"): "replied", ("timeout", "reply"): "replied", ("replied", "close"): "new"},
    {"sent": (48 * HOUR, "timeout"), "delivered": (240 * HOUR, "timeout"), "replied": (500 * HOUR, "new")},
)
KIND = "k int, ts timestamp, e int, what string"


def walked(rows, until):
    """Moves by key, one event after the other, hour by hour."""
    out = []
    for key in sorted({r[0] for r in rows}):
        mine = sorted({(at, str(e), what) for k, at, e, what in rows if k == key and at <= until})
        state, since, at = "new", 0, min((m[0] for m in mine), default=until)
        times = sorted({m[0] for m in mine} | {until})
        for now in times:
            while state in LIFE.waits and since + LIFE.waits[state][0] < now or (now == until and state in LIFE.waits and since + LIFE.waits[state][0] == now and not any(m[0] == now for m in mine)):
                before, at = state, since + LIFE.waits[state][0]
                state, since = LIFE.waits[state][1], at
                out.append((str(key), at, before, state, "wait"))
            for t, _, what in mine:
                if t == now and (state, what) in LIFE.moves:
                    before, state, since = state, LIFE.moves[state, what], t
                    out.append((str(key), t, before, state, what))
    return sorted(out)


def test_stream_as_table_with_restart(spark, tmp_path):
    rng, rows, e = random.Random(8), [], 0
    for key in range(12):
        at = rng.randint(0, 50) * HOUR
        for _ in range(rng.randint(1, 9)):
            rows.append((key, at, e, rng.choice(["send", "arrive", "reply", "close", "send"])))
            at += rng.choice([1, 5, 30, 60, 260, 600]) * HOUR
            e += 1
    rows.sort(key=lambda r: r[1])
    # out of order by up to 20 hours, which the watermark allows; some twice
    order = sorted(rows, key=lambda r: r[1] + rng.randint(0, 20) * HOUR)
    order = [r for x in order for r in ([x, x] if rng.random() < 0.2 else [x])]
    end = max(r[1] for r in rows) + 2000 * HOUR
    files = [order[i::1][:] for i in ()] or [order[i : i + 12] for i in range(0, len(order), 12)]
    source, sink, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    put = lambda part: spark.createDataFrame(part, "k int, at long, e int, what string").select("k", F.timestamp_millis("at").alias("ts"), "e", "what").coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(source)
        moves = machines.on_stream(stream, LIFE, "24 hours", "k", "ts", "e", "what")
        moves.writeStream.format("parquet").option("path", sink).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination(240)

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    machines.with_rocks(spark)
    try:
        half = len(files) // 2
        for part in files[:half]:
            put(part)
        run()
        for part in files[half:]:
            put(part)
        put([(99, end, 10_000, "send")])  # moves the watermark past everything
        run()
        put([(3, 0, 20_000, "send"), (5, HOUR, 20_001, "send")])  # late: left out
        run()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    until = end - 24 * HOUR
    got = sorted(tuple(r) for r in spark.read.parquet(sink).collect())
    assert got == walked(rows, until)
    table = spark.createDataFrame([*rows, *rows[:5]], "k int, at long, e int, what string").select("k", F.timestamp_millis("at").alias("ts"), "e", "what")
    batch = machines.on_table(table, LIFE, spark.range(1).select(F.lit(until)), "k", "ts", "e", "what")
    assert sorted(tuple(r) for r in batch.collect()) == got


def test_calls_to_the_store_are_a_few_a_key():
    """A thousand events of a key, some repeated and one without an id, and a tick that takes nine hundred: as the machine alone, in few calls."""
    import pandas as pd

    calls = []

    class Store:
        def __init__(self):
            self.held = None

        def __getattr__(self, name):
            def call(*args):
                calls.append(name)
                if name in ("put", "update"):
                    self.held = args[0]
                elif name in ("appendList",):
                    self.held = [*(self.held or []), *args[0]]
                elif name == "clear":
                    self.held = None
                return {"exists": self.held is not None, "get": self.held}.get(name)

            return call

    class Handle(Store):
        getValueState = getListState = lambda self, name, schema: Store()

    class At:
        def __init__(self, now):
            self.now = now

        def getCurrentWatermarkInMs(self):
            return self.now

    rng = random.Random(5)
    events = [(i * HOUR, str(i) if i != 500 else None, rng.choice(["send", "arrive", "reply", "close"])) for i in range(1, 1001)]
    keyed = machines.Keyed(LIFE)
    keyed.init(Handle())
    mixed = rng.sample(events, len(events)) + rng.sample(events, 50)
    frames = [pd.DataFrame(mixed[i : i + 210], columns=["at", "id", "event"]) for i in range(0, 1050, 210)]
    assert not list(keyed.handleInputRows(("k",), iter(frames), At(0)))
    got = [tuple(r) for now in (900 * HOUR, 1000 * HOUR) for f in keyed.handleExpiredTimer(("k",), At(now), None) for r in f.itertuples(index=False)]
    want, state, since = [], "new", 0
    for now, part in ((900 * HOUR, events[:900]), (1000 * HOUR, events[900:])):
        for state, since, *move in LIFE.run(state, since, iter([(e[0], e[2]) for e in part]), now):
            want.append(("k", since, *move))
    assert got == want and len(calls) < 30
