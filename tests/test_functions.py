"""Functions and operators on cases whose results are known."""

import datetime
import difflib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.functions import numbers, texts, times
from quillon.operators import graphs, joins, ledgers, rules, series, stats
from quillon.plans.steps import Plan, Step, findings, misfits
from quillon.sources.store import Store


def values(spark, schema, rows, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_amounts(spark):
    rows = [("¥1,234.5",), ("3.2万",), ("2亿",), ("abc",), (None,), ("-7",)]
    assert [r[0] for r in values(spark, "t string", rows, numbers.parse_amount(F.col("t")))] == [1234.5, 32000.0, 2e8, 0.0, 0.0, -7.0]


def test_check_digits(spark):
    rows = [("4111 1111 1111 1111", "11010519491231002X", "91350100M000100Y43"), ("4111111111111112", "110105194912310021", "91350100M000100Y44"), (None, None, None)]
    got = values(spark, "a string, b string, c string", rows, numbers.luhn(F.col("a")), numbers.id18(F.col("b")), numbers.credit_code(F.col("c")))
    assert got == [(True, True, True), (False, False, False), (False, False, False)]


def test_times(spark):
    rows = [("2024-02-29",), ("2024/02/29 10:11:12",), ("20240229",), ("1709164800",), ("2024年2月9日",), ("x",), (None,)]
    days = [r[0] for r in values(spark, "t string", rows, times.parse_date(F.col("t")))]
    leap = datetime.date(2024, 2, 29)
    assert days == [leap, leap, leap, leap, datetime.date(2024, 2, 9), None, None]
    assert [r[0] for r in values(spark, "t string", [("202601",), ("2026/1",), ("2026",)], times.norm_period(F.col("t")))] == ["2026-01", "2026-01", None]
    assert [r[0] for r in values(spark, "t string", [("7",), ("23:10",), ("2024-01-01T05:00:00",), ("?",)], times.parse_hour(F.col("t")))] == [7, 23, 5, 12]
    periods = values(spark, "d date", [(datetime.date(2024, 12, 30),)], *[times.period(F.col("d"), g) for g in ("year", "quarter", "month", "week", "day")])
    assert periods == [("2024", "2024-Q4", "2024-12", "2025-W01", "2024-12-30")]


def test_texts(spark):
    rows = [("Acme Trading Co., Ltd.",), ("北京某某科技有限公司",)]
    assert [r[0] for r in values(spark, "t string", rows, texts.company_stem(F.col("t")))] == ["acme trading co", "北京某某科技"]
    t = F.col("t")
    got = values(spark, "t string", [("abcdef",), ("ab",), ("joe@x.org",)], texts.mask(t), texts.mask_email(t), texts.count_of(t, "b"), texts.bump(F.lit("1.2.3"), F.lit("minor")))
    assert got == [("ab**ef", "ab**ef", 1, "1.3.0"), ("**", "**", 1, "1.3.0"), ("jo*****rg", "j***@x.org", 0, "1.3.0")]
    assert values(spark, "t string", [("Good day. A bad one; good!",)], texts.lexicon_sentiment(t, ["good"], ["bad"]), F.size(texts.clauses(t, 2))) == [(1 / 3, 3)]


def test_irr_has_no_worth_left(spark):
    (rate,) = values(spark, "a double", [(1000.0,)], numbers.irr(F.col("a"), F.array(*[F.lit(300.0)] * 5)))[0]
    assert abs(sum(300 / (1 + rate) ** k for k in range(1, 6)) - 1000) < 1e-6


def test_rules(spark):
    df = spark.createDataFrame([(1, 5000.0, datetime.datetime(2024, 3, 30, 2)), (2, None, None), (3, 999.5, datetime.datetime(2024, 1, 1, 12))], "id int, a double, t timestamp")
    assert [r[0] for r in df.select(rules.pattern({"month_in": [3], "multiple_of": 1000, "hour_outside": (6, 22)}, F.col("a"), F.col("t"))).collect()] == [True, False, False]
    assert not any(r[0] for r in df.select(rules.pattern({}, F.col("a"), F.col("t"))).collect())
    assert [r[0] for r in df.select(rules.bands(F.coalesce("a", F.lit(0.0)), [(1000, "high"), (10, "mid")], "low")).orderBy("id").collect()] == ["high", "low", "mid"]


def test_series(spark):
    df = spark.createDataFrame([("k", i, float(v)) for i, v in enumerate([0, 0, 10, 10, 10, 0, 0])], "k string, i int, v double")
    assert [tuple(r) for r in series.runs(df, ["k"], ["i"], F.col("v") > 5, 3).collect()] == [("k", 2, 4, 3)]
    (alarms,) = series.folded(df, ["k"], ["i"], "v").select(series.cusum(F.col("values"), F.lit(0.0), F.lit(2.0))).first()
    assert [(a["at"], a["side"]) for a in alarms] == [(4, "up")]
    assert series.folded(df, ["k"], ["i"], "v").select(series.ewma(F.col("values"), 0.5)).first()[0] == pytest.approx(0.25 * (10 * (0.5**1 + 0.5**2 + 0.5**3)))


def test_sharing_hubs(spark):
    df = spark.createDataFrame([(i, "same", str(i // 2)) for i in range(6)], "id int, x string, y string")
    got = joins.sharing_pairs(df, "id", ["x", "y"], most=3).collect()
    assert sorted((r.a, r.b) for r in got if r.kind == "y") == [(0, 1), (2, 3), (4, 5)]
    assert sorted((r.a, r.b, r.members) for r in got if r.kind == "x") == [(0, i, 6) for i in range(1, 6)]


def test_isolation_and_benford(spark):
    rows = [(i, float(i % 7), float(i % 5)) for i in range(300)] + [(1000, 90.0, 90.0)]
    got = stats.isolation(spark.createDataFrame(rows, "id long, a double, b double"), "id", ["a", "b"])
    assert got.orderBy(F.desc("iso")).first().id == 1000
    empty = spark.createDataFrame([], "a double")
    assert [(r.n, r.observed) for r in stats.benford(empty, "a").collect()] == [(0, None)] * 9


def test_graphs(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 0.5), (3, 1, 1.0), (4, 5, 1.0)], "src long, dst long, w double")
    assert [tuple(r) for r in graphs.cycles(e, 3).collect()] == [(1, 2, 3)]
    assert dict(map(tuple, graphs.components(e).collect())) == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}
    assert dict(map(tuple, graphs.contagion(e, spark.createDataFrame([(1, 1.0)], "id long, shock double"), 0.5, 3).collect())) == {1: 1.0, 2: 0.5, 3: 0.125}
    assert abs(sum(r.rank for r in graphs.pagerank(e, 6).collect()) - 1) < 1e-9
    tree = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (9, 9)], "id long, parent long")
    assert sorted(map(tuple, graphs.ultimate_parents(tree).collect())) == [(1, 1, 0), (2, 1, 1), (3, 1, 2), (4, 1, 3), (9, 9, 0)]


def test_broken_ledger(spark):
    df = spark.createDataFrame([("k", i, f"c{i}") for i in range(10)], "k string, i int, c string")
    chain = ledgers.linked(ledgers.blocks(df, ["k"], ["i"], F.col("c"), 3), ["k"], ["block"], "root")
    assert ledgers.broken(chain, ["k"], ["block"], "root").count() == 0
    forged = chain.withColumn("root", F.when(F.col("block") == 1, F.lit("x")).otherwise(F.col("root")))
    assert [r.block for r in ledgers.broken(forged, ["k"], ["block"], "root").orderBy("block").collect()] == [1, 2]


def test_similarity_ratio(spark):
    from quillon.functions.similar import ratio

    rows = [("abcd", "bcde"), ("same", "same"), ("", ""), ("x", None)]
    got = [r[0] for r in values(spark, "a string, b string", rows, ratio(F.col("a"), F.col("b")))]
    assert got[:3] == [difflib.SequenceMatcher(None, a, b).ratio() for a, b in rows[:3]] and got[3] == 0.0


def test_plan(spark):
    one = spark.range(3).withColumnRenamed("id", "n")
    want = spark.createDataFrame([], "n double").schema
    plan = Plan([Step("b", lambda a: a.where("n > 0"), ["a"], ["fraud"], {"a": want}), Step("a", lambda x: x, ["x"]), Step("c", lambda b: b.agg(F.count("*").alias("n")), ["b"], ["report"])])
    assert plan.asked("A fraud report on FRAUD") == ["b", "c"] and plan.upstream("c") == {"a", "b", "c"} and plan.order() == ["a", "b", "c"]
    assert plan.run("c", {"x": one})["c"].first().n == 2
    assert misfits(one.schema, spark.createDataFrame([], "m int, n string").schema) == ["m is missing", "n is bigint, not string"]
    with pytest.raises(ValueError, match="need each other"):
        Plan([Step("p", None, ["q"]), Step("q", None, ["p"])]).order()
    with pytest.raises(ValueError, match="cannot read"):
        plan.run("b", {"x": one.withColumn("n", F.lit("s"))})
    assert findings({"p": one, "q": one.withColumn("m", F.lit(1))}).count() == 6


def test_store(spark, tmp_path):
    store = Store(spark, root=str(tmp_path / "store"))
    store.create("t", "id long, name string, v double", True)
    store.insert("t", spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, name string"))
    store.upsert("t", spark.createDataFrame([(2, "B", 2.0), (4, "d", 4.0)], "id long, name string, v double"), ["id"])
    store.update("t", {"v": 9.0}, "name is null")
    store.delete("t", "name = 'a'")
    assert sorted(tuple(r) for r in store.all("t").collect()) == [(2, "B", 2.0), (3, None, 9.0), (4, "d", 4.0)]
    assert store.count("t", "v > :low", {"low": 3}) == 2 and store.get("t", "id = 4")["name"] == "d" and store.get("t", "id = 99") is None
    store.export_json("t", str(tmp_path / "t"))
    store.import_json("t2", str(tmp_path / "t"), "id long, name string, v double")
    assert store.count("t2") == 3 and store.tables() == ["t", "t2"] and store.columns("t2") == ["id", "name", "v"]
    with pytest.raises(ValueError):
        store.insert("t", spark.range(1).withColumnRenamed("id", "other"))
    assert store.insert("t", {"id": 5, "name": "e"}) == 4 and store.update("t", {"v": 0.0}, "id > 3") == 2 and store.delete("t", "id = 99") == 0
    store.upsert("t", spark.createDataFrame([(5, "a", 1.0), (5, "z", 0.0)], "id long, name string, v double"), ["id"])
    assert store.count("t", "id = 5") == 1 and store.get("t", "id = 5")["name"] == "z"
    schema, parts, at = store._version("t")
    with pytest.raises(RuntimeError, match="another writer"):
        store._commit("t", schema, parts, at - 1)
    assert Store(spark, root=str(tmp_path / "store")).count("t") == 4


def test_streams(spark, tmp_path):
    from quillon.streaming import monitor

    rows = pd.DataFrame({"event_type": ["k"] * 9, "ts": pd.date_range("2024-01-01", periods=9, freq="h"), "value": [0.0, 0, 10, 10, 10, 0, 0, 10, 10], "user_id": range(9)})
    for i in range(0, 9, 3):
        spark.createDataFrame(rows[i : i + 3]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("event_type string, ts timestamp, value double, user_id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for name, out, mode in (("alarms", monitor.cusum_alarms(source, 0.0, 2.0), "append"), ("hours", monitor.windowed(source, "3 hours", "1 hour"), "complete")):
        q = out.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(60)
    assert [(r.key, r.side, r.at.hour) for r in spark.table("alarms").orderBy("at").collect()] == [("k", "up", 3), ("k", "up", 7)]
    assert spark.table("hours").agg(F.sum("n")).first()[0] == 9


def test_checks(spark):
    from quillon.operators import checks, ledgers

    df = spark.createDataFrame([(10.0, 4.0, 6.0), (10.0, 4.0, 5.0), (None, 1.0, 1.0)], "a double, b double, c double")
    assert [r[0] for r in df.select(checks.identity("a == b + c", ["a", "b", "c"])).collect()] == [True, False, False]
    for bad in ("a == d", "a", "a == b; drop"):
        with pytest.raises(ValueError):
            checks.identity(bad, ["a", "b", "c"])
    sql = spark.createDataFrame([("INSERT INTO x.y SELECT * FROM a JOIN b.c ON 1=1 JOIN a",)], "q string")
    assert tuple(sql.select(*checks.table_lineage(F.col("q"))).first()) == (["a", "b.c"], ["x.y"])
    assert spark.range(1).select(checks.history_mean(F.array(*map(F.lit, range(12))))).first()[0] == sum(range(2, 12)) / 10
    import hashlib

    import numpy as np

    for n in (1, 2, 3, 5, 8):
        leaves = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
        one = spark.createDataFrame([(leaves, i) for i in range(n)], "h array<string>, i int")
        for r in one.select("h", "i", checks.merkle_proof(F.col("h"), F.col("i"), 3).alias("p"), ledgers.merkle(F.col("h"), 3).alias("root")).collect():
            at = leaves[r.i]
            for step in r.p:
                at = hashlib.sha256(((step.hash + at) if step.left else (at + step.hash)).encode()).hexdigest()
            assert at == r.root
    cost = np.array([[1.0, 9, 9, 1], [9, 1, 1, 9]])
    assert checks.assignment(cost)[0] == [0, 1, 1, 0]


def test_field_map(spark):
    from quillon.functions.similar import field_map

    fields = spark.createDataFrame([("Acct Code",), ("amount",), ("zzzz",)], "field string")
    known = spark.createDataFrame([("account", "account code"), ("account", "acct_code"), ("amount", "amount"), ("amount", "sum")], "standard string, synonym string")
    got = {(r.field, r.rank): (r.standard, r.score) for r in field_map(fields, known).collect()}
    assert got["Acct Code", 1] == ("account", 1.0) and got["amount", 1] == ("amount", 1.0) and ("zzzz", 1) not in got


def test_betweenness_and_modularity(spark):
    import random

    rng = random.Random(3)
    pairs = sorted({(rng.randrange(9), rng.randrange(9)) for _ in range(22)})
    pairs = [p for p in pairs if p[0] != p[1]]
    want: dict[int, float] = {}
    for s in (0, 1, 2):  # all shortest paths by force
        paths, done, level = {s: [[s]]}, {s}, {s}
        while level:
            new: dict[int, list] = {}
            for u in level:
                for a, b in pairs:
                    if a == u and b not in done:
                        new.setdefault(b, []).extend([*p, b] for p in paths[u])
            paths |= new
            level = set(new)
            done |= level
        for t, ways in paths.items():
            for p in ways:
                for v in p[1:-1]:
                    want[v] = want.get(v, 0) + 1 / len(ways)
    e = spark.createDataFrame([(a, b, 1.0) for a, b in pairs], "src long, dst long, w double")
    got = {r.id: r.score for r in graphs.betweenness(e, spark.range(3)).collect()}
    assert all(abs(got.get(v, 0) - want.get(v, 0)) < 1e-9 for v in range(9))
    two = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 1.0), (4, 5, 1.0)], "src long, dst long, w double")
    label = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 4), (5, 4)], "id long, label long")
    assert graphs.modularity(two, label).first()[0] == pytest.approx(1 - (6 / 8) ** 2 - (2 / 8) ** 2)


def test_mined_and_glossary(spark):
    import hashlib

    rows = ledgers.mined(spark.createDataFrame([("a",), (None,)], "t string"), "t", 1).collect()
    assert rows[0].hash == hashlib.sha256(f"a{rows[0].nonce}".encode()).hexdigest() and rows[0].hash[0] == "0" and rows[1].nonce is None
    t = F.col("t")
    got = values(spark, "t string", [("The Net Profit and profit",), ("abcabc",)], texts.glossary(t, {"profit": "gain", "net profit": "net gain"}), texts.ngram_similarity(t, F.lit("abcabd")))
    assert got[0][0] == "The net gain and gain" and got[1][1] == 0.75
