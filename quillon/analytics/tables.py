"""The table store, sources, zones and plans as queries, each beside its SQL."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from quillon.analytics.derive import choice
from quillon.analytics.registry import query, table
from quillon.functions import texts
from quillon.operators import audits, checks
from quillon.plans.steps import Plan, Step, findings, misfits
from quillon.sources import records, store, zones
from quillon.sources.scratch import shared_dir


def _store(spark: SparkSession) -> store.Store:
    return store.Store(spark, f"query_{uuid.uuid4().hex}")


def _nations(spark: SparkSession, sf: str) -> store.Store:
    """A store with a table nation."""
    s = _store(spark)
    n = table(spark, sf, "nation")
    s.create("nation", n.schema)
    s.insert("nation", n)
    return s


@query("SELECT 0::BIGINT AS rows, 'k,name,v' AS columns")
def tbl_create(spark: SparkSession, sf: str) -> DataFrame:
    """A table made twice is made once and is empty."""
    s = _store(spark)
    s.create("t", "k long, name string, v double")
    s.create("t", "other int")
    return s.all("t").agg(F.count("*").alias("rows")).select("rows", F.lit(",".join(s.columns("t"))).alias("columns"))


@query("SELECT 'kept' AS name")
def tbl_drop(spark: SparkSession, sf: str) -> DataFrame:
    """Of two tables one is dropped; dropping what is not there is no error."""
    s = _store(spark)
    s.create("kept", "k long")
    s.create("gone", "k long")
    s.drop("gone")
    s.drop("never")
    return spark.createDataFrame([(n,) for n in s.tables()], "name string")


@query("SELECT * FROM (VALUES (0, 'a'), (1, 'b'), (2, 'c')) AS t(place, name)")
def tbl_list(spark: SparkSession, sf: str) -> DataFrame:
    """The tables of a store in order of their names."""
    s = _store(spark)
    for n in "cab":
        s.create(n, "k long")
    return spark.createDataFrame(list(enumerate(s.tables())), "place int, name string")


@query("SELECT * FROM (VALUES (0, 'n_nationkey'), (1, 'n_name'), (2, 'n_regionkey')) AS t(place, name)")
def tbl_columns(spark: SparkSession, sf: str) -> DataFrame:
    """The columns of a table in their order."""
    return spark.createDataFrame(list(enumerate(_nations(spark, sf).columns("nation"))), "place int, name string")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT 99, 'NEW', NULL")
def insert_one(spark: SparkSession, sf: str) -> DataFrame:
    """One row appended; columns it lacks are null."""
    s = _nations(spark, sf)
    s.insert("nation", {"n_nationkey": 99, "n_name": "NEW"})
    return s.all("nation")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT r_regionkey + 100, r_name, r_regionkey FROM region")
def insert_many(spark: SparkSession, sf: str) -> DataFrame:
    """Many rows appended, their columns in another order."""
    s = _nations(spark, sf)
    s.insert("nation", table(spark, sf, "region").select(F.col("r_name").alias("n_name"), (F.col("r_regionkey") + 100).alias("n_nationkey"), F.col("r_regionkey").alias("n_regionkey")))
    return s.all("nation")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'UP' ELSE n_name END AS n_name, CASE WHEN n_nationkey % 2 = 0 THEN 7 ELSE n_regionkey END AS n_regionkey FROM nation UNION ALL SELECT 50, 'UP', 7")
def upsert(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that replace those with their key, and a new one; of two rows with one key the greater stays."""
    s = _nations(spark, sf)
    up = table(spark, sf, "nation").where("n_nationkey % 2 = 0").select("n_nationkey", F.lit("UP").alias("n_name"), F.lit(7).alias("n_regionkey"))
    more = spark.createDataFrame([(50, "UP", 7), (50, "LOW", 1)], up.schema)
    s.upsert("nation", up.unionAll(more), ["n_nationkey"])
    return s.all("nation")


@query("SELECT n_name FROM nation WHERE n_regionkey = 2 AND n_nationkey > 4 ORDER BY n_nationkey DESC LIMIT 3")
def scan_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Chosen columns of chosen rows, in order, a few."""
    return _nations(spark, sf).query("nation", ["n_name"], "n_regionkey = :r and n_nationkey > :low", {"r": 2, "low": 4}, ["n_nationkey desc"], 3)


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def scan_all(spark: SparkSession, sf: str) -> DataFrame:
    """A whole table."""
    return _nations(spark, sf).all("nation")


@query("SELECT n_name, (SELECT count(*) FROM nation WHERE n_nationkey = -1) AS missing FROM nation WHERE n_nationkey = 3")
def scan_get(spark: SparkSession, sf: str) -> DataFrame:
    """The first row that fits, and none where nothing does."""
    s = _nations(spark, sf)
    one, none = s.get("nation", "n_nationkey = :k", {"k": 3}), s.get("nation", "n_nationkey = -1")
    return spark.createDataFrame([(one["n_name"], 0 if none is None else 1)], "n_name string, missing long")


@query("SELECT (SELECT count(*) FROM nation) AS n, (SELECT count(*) FROM nation WHERE n_regionkey = 1) AS some")
def scan_count(spark: SparkSession, sf: str) -> DataFrame:
    """Rows in all and rows that fit."""
    s = _nations(spark, sf)
    return spark.createDataFrame([(s.count("nation"), s.count("nation", "n_regionkey = :r", {"r": 1}))], "n long, some long")


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN lower(n_name) ELSE n_name END AS n_name, CASE WHEN n_regionkey = 1 THEN 9 ELSE n_regionkey END AS n_regionkey, (SELECT count(*) FROM nation WHERE n_regionkey = 1) AS changed FROM nation")
def update(spark: SparkSession, sf: str) -> DataFrame:
    """Columns set to a value and to an expression where a predicate holds, and how many rows that were."""
    s = _nations(spark, sf)
    n = s.update("nation", {"n_regionkey": 9, "n_name": F.lower("n_name")}, "n_regionkey = 1")
    return s.all("nation").withColumn("changed", F.lit(n).cast("long"))


@query("SELECT n_nationkey, n_name, n_regionkey, (SELECT count(*) FROM nation WHERE n_nationkey < 10) AS gone FROM nation WHERE n_nationkey >= 10")
def delete(spark: SparkSession, sf: str) -> DataFrame:
    """Rows taken away where a predicate holds, and how many."""
    s = _nations(spark, sf)
    n = s.delete("nation", "n_nationkey < 10")
    return s.all("nation").withColumn("gone", F.lit(n).cast("long"))


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/quillon/files/{uuid.uuid4().hex}"


@query("SELECT n_nationkey, n_name FROM nation")
def jsonl_sink(spark: SparkSession, sf: str) -> DataFrame:
    """A table as JSON lines, read as lines of text."""
    s, at = _nations(spark, sf), _folder(spark)
    s.export_json("nation", at)
    line = F.col("value")
    return spark.read.text(at).select(F.get_json_object(line, "$.n_nationkey").cast("int").alias("n_nationkey"), F.get_json_object(line, "$.n_name").alias("n_name"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def jsonl_source(spark: SparkSession, sf: str) -> DataFrame:
    """JSON lines as a table, by a schema."""
    at, s = _folder(spark), _store(spark)
    n = table(spark, sf, "nation")
    n.write.json(at)
    s.import_json("nation", at, n.schema)
    return s.all("nation")


@query("SELECT r_regionkey, r_name FROM region")
def fixture_load(spark: SparkSession, sf: str) -> DataFrame:
    """A fixture in place of the table that was there."""
    at, s = _folder(spark), _store(spark)
    r = table(spark, sf, "region")
    r.write.json(at)
    s.create("fixture", "old int")
    s.load_fixture("fixture", at, r.schema)
    return s.all("fixture")


@query("SELECT 'nation' AS name, (SELECT count(*) FROM nation) AS n UNION ALL SELECT 'region', (SELECT count(*) FROM region)")
def export_import_all(spark: SparkSession, sf: str) -> DataFrame:
    """Every table of a store to a folder and into another store (export_all, import_all)."""
    s, other, at = _nations(spark, sf), _store(spark), _folder(spark)
    r = table(spark, sf, "region")
    s.create("region", r.schema)
    s.insert("region", r)
    s.export_all(at)
    counts = other.import_all(at, {n: s.all(n).schema for n in s.tables()})
    return spark.createDataFrame(sorted(counts.items()), "name string, n long")


VALUES = choice("o_orderkey", ["12", "-3.5", "true", "[1, 2]", '{"a": 1}', "2024-05-01", "2024-05-01T10:00:00", "word", None, "1e3"])


@query(f"WITH v AS (SELECT o_orderkey, {VALUES[1]} AS v FROM orders) SELECT o_orderkey, CASE v WHEN '12' THEN 'INTEGER' WHEN '-3.5' THEN 'REAL' WHEN 'true' THEN 'INTEGER' WHEN '[1, 2]' THEN 'JSON' WHEN '{{\"a\": 1}}' THEN 'JSON' WHEN '2024-05-01' THEN 'DATETIME' WHEN '2024-05-01T10:00:00' THEN 'DATETIME' WHEN '1e3' THEN 'REAL' ELSE 'TEXT' END AS kind FROM v")
def type_infer(spark: SparkSession, sf: str) -> DataFrame:
    """The column type that a value asks for."""
    return table(spark, sf, "orders").select("o_orderkey", store.kind_of(F.expr(VALUES[0])).alias("kind"))


@query("SELECT event_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round(value, 6) AS value FROM events")
def ser_deser(spark: SparkSession, sf: str) -> DataFrame:
    """Nested values as JSON text and times as ISO text, and back (ser, deser)."""
    nested = F.to_json(F.struct("event_type", "value"))
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    written = table(spark, sf, "events").select("event_id", nested.alias("j"), iso.alias("t"))
    back = F.from_json("j", "event_type string, value double")
    return written.select("event_id", back.alias("x"), F.to_timestamp("t", "yyyy-MM-dd'T'HH:mm:ss").alias("t")).select("event_id", "x.event_type", F.date_format("t", "yyyy-MM-dd HH:mm:ss").alias("ts"), F.round("x.value", 6).alias("value"))


@query("SELECT 7::BIGINT AS limited, (SELECT count(*) FROM nation) AS whole")
def src_jsonl_demo(spark: SparkSession, sf: str) -> DataFrame:
    """JSON lines with a limit of rows, and without."""
    at, n = _folder(spark), table(spark, sf, "nation")
    n.write.json(at)
    count = lambda k: store.json_lines(spark, at, n.schema, k).agg(F.count("*").alias("n"))
    return count(7).select(F.col("n").alias("limited")).crossJoin(count(0).select(F.col("n").alias("whole")))


@query("SELECT 'lines' AS name, (SELECT count(*) FROM nation) AS n UNION ALL SELECT 'notes', (SELECT count(*) FROM region)")
def src_dir_demo(spark: SparkSession, sf: str) -> DataFrame:
    """The inputs of an analytic from a folder: JSON lines and text by their endings, other entries left aside."""
    at, n, r = _folder(spark), table(spark, sf, "nation"), table(spark, sf, "region")
    n.write.json(f"{at}/lines.jsonl")
    r.select(F.col("r_name").alias("value")).write.text(f"{at}/notes.txt")
    r.write.parquet(f"{at}/other.parquet")
    frames = store.folder(spark, at, {"lines": n.schema}, 0)
    out = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in sorted(frames.items())]
    return out[0].unionAll(out[1])


CONTENT = [("structured", '{"a": 1.5, "b": 2}'), ("semi_structured", "used 12.5 MWh and 3 kg"), ("semi_structured", "1 2 3 4 5 6 7"), ("text", "share 45 % of all"), ("timeseries", "[1, 2.5, 4]"), ("image_meta", '{"ndvi": 0.31}'), ("structured", "broken"), ("video", "x")]
KIND, BODY = choice("event_id", [k for k, _ in CONTENT]), choice("event_id", [c for _, c in CONTENT])


@query(f"WITH c AS (SELECT event_id, event_id % 8 AS k, {KIND[1]} AS kind FROM events) SELECT event_id, (['1.5,2.0', '12.5,3.0', '1.0,2.0,3.0,4.0,5.0', '45.0', '1.0,2.5,4.0', '0.31', '', ''])[k + 1] AS numbers, CASE WHEN k >= 6 THEN 'nothing to read as ' || kind END AS error FROM c")
def src_parse_multi(spark: SparkSession, sf: str) -> DataFrame:
    """Contents of five kinds read for their numbers; what cannot be read keeps its error."""
    c = table(spark, sf, "events").select("event_id", F.expr(KIND[0]).alias("kind"), F.expr(BODY[0]).alias("content"))
    return zones.parsed(c, "kind", "content").select("event_id", F.concat_ws(",", F.transform("values", lambda x: x.cast("string"))).alias("numbers"), "error")


RAW = ['{"company": "C1", "account": "1001", "amount": "1,200.50", "month": "202401"}', '{"entity": " ", "subject_code": "9999", "value": 7, "period": "2024/2", "image_ref": "s3://x/image1"}', '{"company_code": "C2", "account_name": "own", "account": "6601", "amt": "n/a", "media_uri": "f.bin", "media_mime": "audio/wav"}', "{}"]
RAWS = choice("o_orderkey", RAW)


@query("SELECT o_orderkey, 'B1' AS batch_id, coalesce(nullif((['erp', 'crm', ''])[o_orderkey % 3 + 1], ''), 'unknown') AS source, (['account,amount,company,month', 'entity,image_ref,period,subject_code,value', 'account,account_name,amt,company_code,media_mime,media_uri', ''])[o_orderkey % 4 + 1] AS fields, ([NULL, 'image', 'audio', NULL])[o_orderkey % 4 + 1] AS modality FROM orders")
def src_ods_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Raw records landed as they came, with their source, the names of their fields, and their medium by MIME type or address."""
    o = table(spark, sf, "orders").select("o_orderkey", F.expr(RAWS[0]).alias("raw"), F.nullif(F.expr(choice("o_orderkey", ["erp", "crm", ""])[0]), F.lit("")).alias("source"))
    return zones.landed(o, "raw", "source", "B1").select("o_orderkey", "batch_id", "source", F.concat_ws(",", "raw_schema").alias("fields"), F.col("media_modality").alias("modality"))


EVENT_LINE = "CASE event_id % 8 WHEN 3 THEN '{\"id\": ' WHEN 5 THEN '[1]' WHEN 7 THEN '{\"id\": \"x\"}' ELSE '{\"id\": ' || event_id || '}' END"
RECORDS_SQL = f"""
WITH l AS (SELECT event_id, {EVENT_LINE} AS content FROM events), k AS (SELECT *, CASE event_id % 8 WHEN 3 THEN 'no JSON' WHEN 5 THEN 'no object' WHEN 7 THEN 'another type' END AS error FROM l)
SELECT event_id % 8 AS lot, error, count(*) AS n, coalesce(sum(CASE WHEN error IS NULL THEN event_id END), 0)::BIGINT AS ids, sum(length(content))::BIGINT AS chars FROM k GROUP BY ALL
"""


def _lots(rows: DataFrame) -> DataFrame:
    """Counts by lot, which the file's folder names, and error."""
    lot = F.regexp_extract("file", "lot=([0-9]+)", 1).cast("long")
    return rows.groupBy(lot.alias("lot"), "error").agg(F.count("*").alias("n"), F.coalesce(F.sum("record.id"), F.lit(0)).alias("ids"), F.sum(F.length("content")).alias("chars"))


def _event_lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select((F.col("event_id") % 8).alias("lot"), F.expr(EVENT_LINE).alias("value"))


@query(RECORDS_SQL)
def src_records(spark: SparkSession, sf: str) -> DataFrame:
    """Events as lines of JSON in files, read by the record source in parts of 64 KB: what fits its schema, and beside it what is no JSON,
    no object, or of another type."""
    at = _folder(spark)
    _event_lines(spark, sf).write.partitionBy("lot").text(at)
    rows = records.registered(spark).read.format("quillon_records").options(kind="jsonl", splitBytes=1 << 16).load(at)
    return _lots(records.checked(rows, "id long"))


@query(RECORDS_SQL)
def src_records_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same as a stream into a table that is stopped and started again: files come in two loads, the second run begins where the first
    ended, and a third finds nothing new."""
    at, out = _folder(spark), _folder(spark)
    records.registered(spark)
    lines = _event_lines(spark, sf)
    for part in (lines.where("lot < 4"), lines.where("lot >= 4"), None):
        if part is not None:
            part.write.mode("append").partitionBy("lot").text(at)
        stream = spark.readStream.format("quillon_records").options(kind="jsonl", log=f"{out}/log").load(at)
        stream.writeStream.format("parquet").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start(f"{out}/table").awaitTermination()
    return _lots(records.checked(spark.read.parquet(f"{out}/table"), "id long"))


MASTER = [("1001", "cash"), ("6601", "selling expenses")]


@query("""
SELECT o_orderkey, (['C1', 'UNKNOWN', 'C2', 'UNKNOWN'])[o_orderkey % 4 + 1] AS company_code, (['cash', NULL, 'own', NULL])[o_orderkey % 4 + 1] AS account_name, (['2024-01', '2024-02', NULL, NULL])[o_orderkey % 4 + 1] AS period, ([1200.5, 7.0, 0.0, 0.0])[o_orderkey % 4 + 1]::DOUBLE AS amount,
(['amount_type_converted', 'null_company_code,account_not_in_master', 'null_period,null_amount_defaulted', 'null_company_code,null_account_code,null_period,null_amount_defaulted'])[o_orderkey % 4 + 1] AS flags FROM orders
""")
def c_dwd_standardize(spark: SparkSession, sf: str) -> DataFrame:
    """Landed records in the standard fields by their synonyms, with defaults, names from the chart of accounts, and flags."""
    o = table(spark, sf, "orders").select("o_orderkey", F.expr(RAWS[0]).alias("raw"))
    got = zones.standardised(o, "raw", spark.createDataFrame(MASTER, "code string, name string"))
    return got.select("o_orderkey", "company_code", "account_name", "period", "amount", F.concat_ws(",", "flags").alias("flags"))


@query("""
WITH k AS (SELECT o_custkey, o_orderpriority, first(o_orderkey ORDER BY o_orderdate, o_orderkey) AS kept FROM orders GROUP BY ALL)
SELECT 'ods' AS source_table, o_orderkey AS source_id, 'dwd' AS target_table, kept AS target_id, CASE WHEN o_orderkey = kept THEN 'standardize' ELSE 'dedup:merged_into' END AS transform FROM orders JOIN k USING (o_custkey, o_orderpriority)
""")
def c_lineage(spark: SparkSession, sf: str) -> DataFrame:
    """Where each standardised record comes from: its own raw record, and those that were merged into it."""
    o = table(spark, sf, "orders")
    kept = o.groupBy("o_custkey", "o_orderpriority").agg(F.min(F.struct("o_orderdate", "o_orderkey")).alias("x")).select("o_custkey", "o_orderpriority", F.col("x.o_orderkey").alias("kept"))
    met = o.join(kept, ["o_custkey", "o_orderpriority"])
    return audits.lineage(met, "ods", "o_orderkey", "dwd", "kept", F.when(F.col("o_orderkey") == F.col("kept"), "standardize").otherwise("dedup:merged_into"))


@query("""
WITH c AS (SELECT lower(trim('Field ' || (p_partkey % 50))) AS raw, 'std' || (p_partkey % 7) AS standard, p_partkey AS seq FROM part WHERE p_partkey % 3 = 0), l AS (SELECT raw, arg_max(standard, seq) AS standard FROM c GROUP BY 1), d AS (SELECT 'field ' || i AS raw, 'old' AS standard FROM (SELECT unnest(range(0, 60)) AS i))
SELECT raw, standard FROM d WHERE raw NOT IN (SELECT raw FROM l) UNION ALL SELECT raw, standard FROM l
""")
def ss_feedback_learn(spark: SparkSession, sf: str) -> DataFrame:
    """A dictionary after people confirmed mappings: the last one for a name counts, by its cleaned form."""
    k = F.col("p_partkey")
    c = table(spark, sf, "part").where(k % 3 == 0).select(F.concat(F.lit(" Field "), (k % 50).cast("string")).alias("name"), F.concat(F.lit("std"), (k % 7).cast("string")).alias("standard"), k.alias("seq"))
    d = spark.range(60).select(F.concat(F.lit("field "), F.col("id").cast("string")).alias("raw"), F.lit("old").alias("standard"))
    return zones.learnt(d, c, texts.clean_field(F.col("name")))


def _plan(spark: SparkSession, sf: str) -> tuple[Plan, dict[str, DataFrame]]:
    """Seven steps over orders and events."""
    o, e = table(spark, sf, "orders"), table(spark, sf, "events")
    want = spark.createDataFrame([], "o_orderkey long, o_totalprice double").schema
    steps = [
        Step("report", lambda large, errors: findings({"large": large, "errors": errors}), ["large", "errors"], ["report", "summary"]),
        Step("large", lambda landed: landed.where("o_totalprice > 450000").select(F.col("o_orderkey").alias("ref"), F.lit("high").alias("severity")), ["landed"], ["fraud", "amount"], {"landed": want}),
        Step("errors", lambda events: events.where("event_type = 'error' and value > 90").select(F.col("event_id").alias("ref"), F.lit("low").alias("severity")), ["events"], ["alert"]),
        Step("landed", lambda orders: orders.where("o_orderkey is not null"), ["orders"], ["ingest", "lake"]),
        Step("graph", lambda landed: landed.select("o_custkey").distinct(), ["landed"], ["fraud", "network"]),
        Step("counts", lambda report: report.groupBy("step", "severity").agg(F.count("*").alias("n")), ["report"], ["kpi"]),
        Step("idle", lambda graph: graph, ["graph"], ["nothing"]),
    ]
    return Plan(steps), {"orders": o, "events": e}


@query("SELECT * FROM (VALUES ('fraud network report', 'graph', 0), ('fraud network report', 'large', 1), ('fraud network report', 'report', 2), ('lake kpi', 'counts', 0), ('lake kpi', 'landed', 1)) AS t(asked, step, place)")
def o_keywords(spark: SparkSession, sf: str) -> DataFrame:
    """The steps that a requirement's words ask for, most hits first."""
    plan, _ = _plan(spark, sf)
    return spark.createDataFrame([(t, s, i) for t in ("fraud network report", "lake kpi", "zzz") for i, s in enumerate(plan.asked(t))], "asked string, step string, place int")


@query("SELECT * FROM (VALUES ('counts', 'report'), ('counts', 'large'), ('counts', 'errors'), ('counts', 'landed'), ('counts', 'counts'), ('idle', 'idle'), ('idle', 'graph'), ('idle', 'landed')) AS t(step, needs)")
def o_upstream(spark: SparkSession, sf: str) -> DataFrame:
    """A step and all it needs."""
    plan, _ = _plan(spark, sf)
    return spark.createDataFrame([(s, n) for s in ("counts", "idle") for n in sorted(plan.upstream(s))], "step string, needs string")


@query("SELECT * FROM (VALUES (0, 'errors'), (1, 'landed'), (2, 'graph'), (3, 'idle'), (4, 'large'), (5, 'report'), (6, 'counts')) AS t(place, step)")
def o_topo(spark: SparkSession, sf: str) -> DataFrame:
    """All steps after what they need, ties by name."""
    return spark.createDataFrame(list(enumerate(_plan(spark, sf)[0].order())), "place int, step string")


@query("SELECT * FROM (VALUES ('large', ''), ('errors', 'o_orderkey is missing,o_totalprice is missing')) AS t(step, misfits)")
def o_validate(spark: SparkSession, sf: str) -> DataFrame:
    """What of a contract a step's output does not keep."""
    plan, inputs = _plan(spark, sf)
    want = plan.steps["large"].expects["landed"]
    rows = [("large", ",".join(misfits(inputs["orders"].schema, want))), ("errors", ",".join(misfits(inputs["events"].schema, want)))]
    return spark.createDataFrame(rows, "step string, misfits string")


REPORT = "r AS (SELECT 'large' AS step, o_orderkey AS ref, 'high' AS severity FROM orders WHERE o_totalprice > 450000 UNION ALL SELECT 'errors', event_id, 'low' FROM events WHERE event_type = 'error' AND value > 90)"


@query(f"WITH {REPORT} SELECT step, severity, count(*) AS n FROM r GROUP BY ALL")
def o_execute(spark: SparkSession, sf: str) -> DataFrame:
    """A plan run to its end; a step that fails is an error and nothing takes its place."""
    plan, inputs = _plan(spark, sf)
    return plan.run("counts", inputs)["counts"]


@query("SELECT 'large' AS step, o_orderkey AS ref, 'high' AS severity FROM orders WHERE o_totalprice > 490000 UNION ALL SELECT 'errors', event_id, 'low' FROM events WHERE event_type = 'error' AND value > 90")
def o_route(spark: SparkSession, sf: str) -> DataFrame:
    """What each step is given: results of the steps before it, and a user's own input in place of a step of that name."""
    plan, inputs = _plan(spark, sf)
    own = inputs["orders"].where("o_totalprice > 490000").select(F.col("o_orderkey").alias("ref"), F.lit("high").alias("severity"))
    return plan.run("report", inputs | {"large": own})["report"].select("step", "ref", "severity")


@query(f"WITH {REPORT} SELECT severity, count(*) AS n, count(DISTINCT step) AS steps, min(ref) AS first FROM r GROUP BY 1")
def o_report(spark: SparkSession, sf: str) -> DataFrame:
    """Findings of all steps, counted by severity."""
    plan, inputs = _plan(spark, sf)
    return plan.run("report", inputs)["report"].groupBy("severity").agg(F.count("*").alias("n"), F.countDistinct("step").alias("steps"), F.min("ref").alias("first"))


@query("""
WITH f AS (SELECT o_custkey AS finding, CASE WHEN o_custkey % 2 = 0 THEN c_name ELSE c_custkey::VARCHAR END AS value FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 480000)
SELECT DISTINCT finding, c_custkey AS record FROM f JOIN customer ON value = c_name OR value = c_custkey::VARCHAR
""")
def o_trace_source(spark: SparkSession, sf: str) -> DataFrame:
    """The raw records that findings come from, by any of the values that name them."""
    c = table(spark, sf, "customer")
    f = table(spark, sf, "orders").where("o_totalprice > 480000").join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_custkey").alias("finding"), F.when(F.col("o_custkey") % 2 == 0, F.col("c_name")).otherwise(F.col("c_custkey").cast("string")).alias("value")).distinct()
    keys = c.select(F.col("c_custkey").alias("record"), F.explode(F.array("c_name", F.col("c_custkey").cast("string"))).alias("value"))
    return f.join(keys, "value").select("finding", "record").distinct()


@query("SELECT conv_id, turn, length(text)::DOUBLE AS first, (length(text) - length(replace(text, ' ', '')))::DOUBLE AS second FROM conversations")
def udf_encoder(spark: SparkSession, sf: str) -> DataFrame:
    """An encoder of one's own, registered by name and used in SQL: here a text's length and its blanks, in Arrow batches."""
    def encode(text: pd.Series) -> pd.Series:
        known = text.fillna("")
        return pd.Series([[float(len(t)), float(t.count(" "))] for t in known])

    checks.register_encoder(spark, "text", pandas_udf(encode, "array<double>"))
    table(spark, sf, "conversations").createOrReplaceTempView("quillon_conversations")
    got = spark.sql("select conv_id, turn, quillon_encode_text(text) as v from quillon_conversations")
    return got.select("conv_id", "turn", F.col("v")[0].alias("first"), F.col("v")[1].alias("second"))


@query("SELECT o_custkey, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders WHERE o_totalprice > 0 GROUP BY 1 HAVING count(*) >= 5")
def udf_engine(spark: SparkSession, sf: str) -> DataFrame:
    """An analytic of one's own in three parts: what goes in, what is inferred, what comes out."""
    own = checks.engine(lambda df: df.where("o_totalprice > 0"), lambda df: df.groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count("*").alias("n")), lambda df: df.where("n >= 5"))
    return table(spark, sf, "orders").transform(own)


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 20")
def sort_limit(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty customers with most orders, ties by number."""
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "o_custkey").limit(20)
