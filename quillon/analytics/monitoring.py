"""Series and stateful analytics over events and yearly or monthly sums."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.analytics.registry import query, table
from quillon.functions import numbers
from quillon.operators import rules, series, stats
from quillon.sources.scratch import shared_dir
from quillon.streaming import machines, monitor

DAILY_SQL = "daily AS (SELECT event_type, ts::DATE AS day, sum(value) AS v, count(*) AS n FROM events GROUP BY ALL)"


def daily(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"), F.count("*").alias("n"))


@query("""
SELECT event_type, event_id, back::INT AS back FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS back FROM events) WHERE back <= 30
""")
def win_tail(spark: SparkSession, sf: str) -> DataFrame:
    return series.tail(table(spark, sf, "events"), ["event_type"], ["ts", "event_id"], 30).select("event_type", "event_id", "back")


@query("""
WITH t AS (SELECT event_type, value FROM events WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 100)
SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(min(value), 6) AS low, round(max(value), 6) AS high FROM t GROUP BY 1
""")
def win_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and population deviation of the last hundred values of each metric."""
    t = series.tail(table(spark, sf, "events").where("value is not null"), ["event_type"], ["ts", "event_id"], 100)
    return t.groupBy("event_type").agg(F.count("*").alias("n"), *[F.round(f("value"), 6).alias(n) for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"), (F.min, "low"), (F.max, "high"))])


@query("""
WITH t AS (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS back, (value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0) AS z FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY event_type))
SELECT event_id, event_type, round(z, 4) AS z, back <= 5 AS recent FROM t WHERE abs(z) > 1.6
""")
def win_zscore(spark: SparkSession, sf: str) -> DataFrame:
    """Values far from their metric's mean; whether among the last five."""
    e = table(spark, sf, "events").where("value is not null").select("event_id", "event_type", "ts", "value")
    moments = e.groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"))
    last = series.last_rows(e, ["event_type"], ["ts", "event_id"], 5).select("event_id", F.lit(True).alias("recent"))
    z = e.join(moments, "event_type").withColumn("z", F.when(F.col("sd") > 0, (F.col("value") - F.col("m")) / F.col("sd"))).where(F.abs("z") > 1.6)
    return z.join(last, "event_id", "left").select("event_id", "event_type", F.round("z", 4).alias("z"), F.coalesce("recent", F.lit(False)).alias("recent"))


@query(f"""
WITH {DAILY_SQL}, o AS (SELECT event_type, v, row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS m FROM daily)
SELECT event_type, round(sum(v * power(0.7, m - 1 - i) * CASE WHEN i = 0 THEN 1 ELSE 0.3 END), 4) AS ewma FROM o GROUP BY 1
""")
def win_ewma(spark: SparkSession, sf: str) -> DataFrame:
    """Exponentially weighted mean of daily sums; the fold against its closed form."""
    got = series.folded(daily(spark, sf), ["event_type"], ["day"], "v")
    return got.select("event_type", F.round(series.ewma(F.col("values")), 4).alias("ewma"))


@query(f"""
WITH {DAILY_SQL}, o AS (SELECT event_type, v, (row_number() OVER (PARTITION BY event_type ORDER BY day) - 1)::DOUBLE AS i FROM daily)
SELECT event_type, count(*) AS n, round(regr_slope(v, i), 6) AS slope, round(regr_r2(v, i), 6) AS r2 FROM o GROUP BY 1
""")
def win_slope(spark: SparkSession, sf: str) -> DataFrame:
    got = series.slope(daily(spark, sf), ["event_type"], ["day"], "v")
    return got.select("event_type", "n", F.round("slope", 6).alias("slope"), F.round("r2", 6).alias("r2"))


@query(f"""
WITH {DAILY_SQL}, o AS (SELECT event_type, v, row_number() OVER (PARTITION BY event_type ORDER BY day DESC) AS b FROM daily),
a AS (SELECT event_type, count(*) AS n, avg(v) FILTER (b <= 5) AS last5, avg(v) FILTER (b BETWEEN 6 AND 10) AS prev5 FROM o GROUP BY 1)
SELECT event_type, round(last5 / prev5, 6) AS ratio, last5 / prev5 < 0.5 AS declining FROM a WHERE n >= 10 AND prev5 > 0
""")
def win_decline(spark: SparkSession, sf: str) -> DataFrame:
    t = series.tail(daily(spark, sf), ["event_type"], ["day"], 10)
    a = t.groupBy("event_type").agg(F.count("*").alias("n"), F.avg(F.when(F.col("back") <= 5, F.col("v"))).alias("last5"), F.avg(F.when(F.col("back") > 5, F.col("v"))).alias("prev5")).where("n >= 10 and prev5 > 0")
    return a.select("event_type", F.round(F.col("last5") / F.col("prev5"), 6).alias("ratio"), (F.col("last5") / F.col("prev5") < 0.5).alias("declining"))


@query(f"""
WITH {DAILY_SQL}, s AS (SELECT *, avg(v) OVER w AS m, stddev_samp(v) OVER w AS sd, lag(v) OVER (PARTITION BY event_type ORDER BY day) AS p FROM daily WINDOW w AS (PARTITION BY event_type))
SELECT event_type, day::VARCHAR AS day, CASE WHEN v > m + 3 * sd OR v < m - 3 * sd THEN 'out' WHEN v > m + 2 * sd OR v < m - 2 * sd THEN 'warn' WHEN v = 0 AND p > 0 THEN 'zero' END AS kind FROM s WHERE v > m + 2 * sd OR v < m - 2 * sd OR (v = 0 AND p > 0)
""")
def win_spc(spark: SparkSession, sf: str) -> DataFrame:
    """Control limits at two and three sample deviations, and sudden zeros."""
    own = Window.partitionBy("event_type")
    s = daily(spark, sf).withColumn("m", F.avg("v").over(own)).withColumn("sd", F.stddev_samp("v").over(own)).withColumn("p", F.lag("v").over(own.orderBy("day")))
    off = F.abs(F.col("v") - F.col("m"))
    return s.select("event_type", F.col("day").cast("string").alias("day"), F.when(off > 3 * F.col("sd"), "out").when(off > 2 * F.col("sd"), "warn").when((F.col("v") == 0) & (F.col("p") > 0), "zero").alias("kind")).where("kind is not null")


@query(f"""
WITH {DAILY_SQL}, f AS (SELECT event_type, day, v > avg(v) OVER (PARTITION BY event_type) AS ok FROM daily),
g AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY event_type ORDER BY day) AS island FROM f)
SELECT event_type, min(day)::VARCHAR AS first, max(day)::VARCHAR AS last, count(*) AS n FROM g WHERE ok GROUP BY event_type, island HAVING count(*) >= 3
""")
def win_run(spark: SparkSession, sf: str) -> DataFrame:
    """Three days or more in a row above the mean."""
    d = daily(spark, sf).withColumn("m", F.avg("v").over(Window.partitionBy("event_type")))
    return series.runs(d, ["event_type"], ["day"], F.col("v") > F.col("m"), 3).select("event_type", F.col("first").cast("string").alias("first"), F.col("last").cast("string").alias("last"), "n")


@query(f"""
WITH {DAILY_SQL}, f AS (SELECT event_type, day, sign(v - lag(v) OVER (PARTITION BY event_type ORDER BY day)) AS mv FROM daily),
g AS (SELECT *, sum(CASE WHEN mv = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY event_type ORDER BY day) AS island FROM f)
SELECT event_type, min(day)::VARCHAR AS first, max(day)::VARCHAR AS last, count(*) AS n FROM g WHERE mv = 1 GROUP BY event_type, island HAVING count(*) >= 2
""")
def win_trend_run(spark: SparkSession, sf: str) -> DataFrame:
    """Rises in a row; ties end a run."""
    m = series.moves(daily(spark, sf), ["event_type"], ["day"], "v")
    return series.runs(m, ["event_type"], ["day"], F.col("move") == 1, 2).select("event_type", F.col("first").cast("string").alias("first"), F.col("last").cast("string").alias("last"), "n")


@query(f"""
WITH {DAILY_SQL}, o AS (SELECT event_type, v, (row_number() OVER (PARTITION BY event_type ORDER BY day) - 1) % 7 AS p, avg(v) OVER (PARTITION BY event_type) AS m FROM daily),
q AS (SELECT event_type, p, count(*) AS n, avg(v) AS pm, first(m) AS m, sum(power(v - m, 2)) AS ss FROM o GROUP BY ALL)
SELECT event_type, round(coalesce(sum(n * power(pm - m, 2)) / nullif(sum(ss), 0), 0), 6) AS strength FROM q GROUP BY 1
""")
def win_season(spark: SparkSession, sf: str) -> DataFrame:
    return series.seasonal(daily(spark, sf), ["event_type"], ["day"], "v", 7).select("event_type", F.round("strength", 6).alias("strength"))


@query(f"""
WITH {DAILY_SQL}, o AS (SELECT event_type, day, avg(v) OVER b AS before, avg(v) OVER a AS after, count(v) OVER b AS nb, count(v) OVER a AS na FROM daily WINDOW b AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))
SELECT event_type, day::VARCHAR AS day, round((after - before) / abs(before), 6) AS change FROM o WHERE nb = 3 AND na = 3 AND abs((after - before) / nullif(abs(before), 0)) > 0.1
""")
def win_change_point(spark: SparkSession, sf: str) -> DataFrame:
    """Days where three-day means before and after differ by a tenth."""
    return series.change_points(daily(spark, sf), ["event_type"], ["day"], "v", 3, 0.1).select("event_type", F.col("day").cast("string").alias("day"), F.round("change", 6).alias("change"))


@query("""
WITH h AS (SELECT event_type, time_bucket(INTERVAL '6 hours', ts) AS start, count(*) AS n, round(sum(value), 4) AS total, round(max(value), 4) AS high FROM events GROUP BY ALL)
SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, event_type, n, total, high FROM h
""")
def win_time_bucket(spark: SparkSession, sf: str) -> DataFrame:
    """Tumbling windows; the same function runs on a stream (ss windows)."""
    got = monitor.windowed(table(spark, sf, "events"), "6 hours", "1 hour")
    return got.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"), F.round("high", 4).alias("high"))


@query("""
WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k
""")
def ss_sessions(spark: SparkSession, sf: str) -> DataFrame:
    got = monitor.sessions(table(spark, sf, "events"), "30 minutes", "1 hour")
    return got.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@query("""
WITH y AS (SELECT o_custkey, year(o_orderdate) AS y, sum(o_totalprice) AS v FROM orders GROUP BY ALL), g AS (SELECT *, lag(y) OVER w AS py, lag(v) OVER w AS pv FROM y WINDOW w AS (PARTITION BY o_custkey ORDER BY y))
SELECT o_custkey, y::INT AS y, round((v - pv) / abs(pv), 4) AS growth, abs((v - pv) / abs(pv)) > 0.5 AS jump FROM g WHERE py = y - 1 AND pv <> 0
""")
def win_yoy(spark: SparkSession, sf: str) -> DataFrame:
    y = table(spark, sf, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.sum("o_totalprice").alias("v"))
    return series.year_on_year(y, ["o_custkey"], "y", "v").where("growth is not null").select("o_custkey", "y", F.round("growth", 4).alias("growth"), (F.abs("growth") > 0.5).alias("jump"))


@query("""
SELECT o_orderkey, o_custkey FROM (SELECT o_orderkey, o_custkey, o_orderdate, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders) WHERE p > o_orderdate
""")
def win_order_violation(spark: SparkSession, sf: str) -> DataFrame:
    """Orders dated before the one numbered before them."""
    before = F.lag("o_orderdate").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    return table(spark, sf, "orders").withColumn("p", before).where("p > o_orderdate").select("o_orderkey", "o_custkey")


@query("""
SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_purchase FROM events
""")
def win_carry_forward(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("last_purchase", F.when(F.col("event_type") == "purchase", F.col("event_id")))
    return series.carried(e, ["user_id"], ["ts", "event_id"], "last_purchase").select("event_id", "last_purchase")


@query("""
WITH RECURSIVE e AS (SELECT o_custkey, o_orderkey || '|' || o_orderstatus AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
h AS (SELECT o_custkey, i, n, left(sha256(c), 16) AS x FROM e WHERE i = 1 UNION ALL SELECT e.o_custkey, e.i, e.n, left(sha256(h.x || e.c), 16) FROM h JOIN e ON e.o_custkey = h.o_custkey AND e.i = h.i + 1)
SELECT o_custkey, n, x AS head FROM h WHERE i = n
""")
def win_chain_hash(spark: SparkSession, sf: str) -> DataFrame:
    """The head of each customer's hash chain."""
    return series.chain_head(table(spark, sf, "orders"), ["o_custkey"], ["o_orderkey"], F.concat_ws("|", "o_orderkey", "o_orderstatus"))


@query("""
WITH RECURSIVE e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE value IS NOT NULL),
s AS (SELECT user_id, avg(value) AS m FROM e GROUP BY 1), z AS (SELECT user_id, i, value - m AS z FROM e JOIN s USING (user_id)),
r(user_id, i, up, down) AS (
  SELECT user_id, 0::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE FROM s
  UNION ALL
  SELECT z.user_id, z.i, greatest(CASE WHEN r.up > 40 THEN 0 ELSE r.up END + z.z - 0.5, 0), greatest(CASE WHEN r.down > 40 THEN 0 ELSE r.down END - z.z - 0.5, 0) FROM r JOIN z ON z.user_id = r.user_id AND z.i = r.i + 1)
SELECT user_id, i AS at, 'up' AS side, round(up, 4) AS sum FROM r WHERE up > 40 UNION ALL SELECT user_id, i, 'down', round(down, 4) FROM r WHERE down > 40
""")
def ss_cusum(spark: SparkSession, sf: str) -> DataFrame:
    """Alarms of the two-sided CUSUM over each user's values against their mean (k .5, h 40), a series read in pieces;
    monitor.cusum_alarms is the same on a stream."""
    e = table(spark, sf, "events").select("user_id", "ts", "event_id", "value")
    means = series.ordered_means(e, "user_id", ["ts", "event_id"], "value")
    got = series.cusum_rows(e.join(means, "user_id"), "user_id", ["ts", "event_id"], "value", "m", 0.5, 40.0)
    return got.select("user_id", "at", "side", numbers.rounded(F.col("sum"), 4).alias("sum"))


@query("""
WITH l AS (SELECT o_orderkey, datediff('day', o_orderdate::DATE, DATE '2000-01-01') AS age, o_orderstatus FROM orders)
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN age > 1500 THEN 'overdue' WHEN age > 700 THEN 'escalated' WHEN age > 350 THEN 'due_soon' ELSE 'open' END AS state FROM l
""")
def ss_lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    """State by age as of a given day."""
    age = F.datediff(F.lit("2000-01-01").cast("date"), "o_orderdate")
    return table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "done").otherwise(rules.bands(age, [(1501, "overdue"), (701, "escalated"), (351, "due_soon")], "open")).alias("state"))


@query("""
WITH s AS (SELECT c_nationkey, c_custkey, c_acctbal FROM customer)
SELECT c_nationkey, c_custkey, rank, round(rrf, 8) AS rrf FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY rrf DESC, c_custkey) AS rank FROM (SELECT c_nationkey, c_custkey, 1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey)) + 1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY c_nationkey ORDER BY -c_custkey DESC, c_custkey)) AS rrf FROM s)) WHERE rank <= 5
""")
def win_rrf(spark: SparkSession, sf: str) -> DataFrame:
    """Rank fusion of two orderings, the five best of each nation."""
    s = table(spark, sf, "customer").select("c_nationkey", "c_custkey", "c_acctbal", (-F.col("c_custkey")).alias("other"))
    got = stats.ranked(series.reciprocal_ranks(s, ["c_nationkey"], "c_custkey", ["c_acctbal", "other"]), ["c_nationkey"], "rrf", "c_custkey", 5)
    return got.select("c_nationkey", "c_custkey", "rank", F.round("rrf", 8).alias("rrf"))


@query("""
SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS cumulative FROM orders
""")
def win_cum_net(spark: SparkSession, sf: str) -> DataFrame:
    """Running sums."""
    by = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.round(F.sum("o_totalprice").over(by), 2).alias("cumulative"))


#: What users do moves their machine; after an error they are stale in two hours, after a click idle in six.
USERS = machines.Machine("start", {(state, what): what for what in ("click", "view", "error", "purchase", "signup") for state in ("start", "stale", "idle", "click", "view", "error", "purchase", "signup")}, {"error": (7_200_000, "stale"), "click": (21_600_000, "idle")})
USERS_SQL = """
WITH e AS (SELECT user_id AS key, epoch_us(ts) // 1000 AS ms, event_id, event_type AS what FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND event_type IS NOT NULL),
u AS (SELECT max(ms) - 3600000 AS until FROM e), p AS (
  SELECT key, ms, what, lag(what) OVER w AS was, lag(ms) OVER w AS since, lead(ms) OVER w AS next FROM e, u WHERE ms <= until WINDOW w AS (PARTITION BY key ORDER BY ms, event_id::VARCHAR)
), x AS (SELECT *, CASE what WHEN 'error' THEN 7200000 WHEN 'click' THEN 21600000 END AS wait, CASE was WHEN 'error' THEN 7200000 WHEN 'click' THEN 21600000 END AS waited FROM p), m AS (
  SELECT key, ms, CASE WHEN was IS NULL THEN 'start' WHEN since + waited < ms THEN CASE was WHEN 'error' THEN 'stale' ELSE 'idle' END ELSE was END AS before_, what AS after_, what AS cause FROM x
  UNION ALL SELECT key, ms + wait, what, CASE what WHEN 'error' THEN 'stale' ELSE 'idle' END, 'wait' FROM x, u WHERE ms + wait < next OR (next IS NULL AND ms + wait <= until)
) SELECT key::VARCHAR AS key, ms AS "at", before_ AS before, after_ AS after, cause FROM m WHERE before_ <> after_
"""


@query(USERS_SQL)
def ss_machine(spark: SparkSession, sf: str) -> DataFrame:
    """Each user's machine over the table of events, up to an hour before the last of them."""
    e = table(spark, sf, "events").where("event_type in ('click', 'view', 'error', 'purchase', 'signup')")
    until = table(spark, sf, "events").agg((F.max(F.unix_millis(F.col("ts").cast("timestamp"))) - 3_600_000))
    return machines.on_table(e, USERS, until, "user_id", "ts", "event_id", "event_type").where("before <> after")


@query(USERS_SQL)
def ss_machine_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same machine on a stream of the events, with an hour's watermark: state in RocksDB, timers of event time. The stream reads
    what is there, ends, and its sink is read. A stream takes a single file by a pattern only."""
    at = f"{shared_dir(spark)}/quillon/{uuid.uuid4().hex}"
    machines.with_rocks(spark)
    known = table(spark, sf, "events")
    moves = machines.on_stream(spark.readStream.schema(known.schema).parquet(f"{sf}/events.parque[t]"), USERS, "1 hour", "user_id", "ts", "event_id", "event_type")
    moves.writeStream.format("parquet").option("path", f"{at}/moves").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(machines.MOVES).parquet(f"{at}/moves").where("before <> after")
