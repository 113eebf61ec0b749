"""Search by words and likeness, marks without labels, and quality of reports, against brute force."""

import datetime
import difflib
import random
import re

from pyspark.sql import functions as F

from quillon.operators import audits, joins, retrieval, stats


def test_search_equals_all_pairs(spark):
    r = random.Random(11)
    word = lambda: r.choice("tax audit data steel law price order ship bank note risk fund".split())
    docs = [(i, " ".join(word() for _ in range(r.choice([1, 3, 8, 40, 120]))), r.choice(["en", "de"])) for i in range(120)] + [(900, None, "en"), (901, "", "de"), (902, "tax", None)]
    queries = [(i, " ".join(word() for _ in range(r.choice([1, 2, 5]))), r.choice(["en", "de", None, "fr"])) for i in range(25)] + [(90, None, None), (91, "nowhere", None)]
    df = lambda rows, key: spark.createDataFrame(rows, f"{key} long, text string, place string")
    for k in (1, 4, 200):
        got = {}
        for row in retrieval.searched(df(queries, "query"), df(docs, "id"), k).collect():
            got.setdefault(row["query"], []).append((row["rank"], row["id"], row["hits"], round(row["score"], 6)))
        want = {}
        for q, text, place in queries:
            a, found = set(re.findall(r"\w+", (text or "").lower())), []
            for i, d, where in docs:
                b = set(re.findall(r"\w+", (d or "").lower()))
                if a & b and (place is None or place == where):
                    found.append((-round(2 * len(a & b) + len(a & b) / len(a | b) + 3 * difflib.SequenceMatcher(None, text, d).ratio(), 9), i, len(a & b)))
            if found:
                want[q] = [(n + 1, i, hits, round(-s, 6)) for n, (s, i, hits) in enumerate(sorted(found)[:k])]
        assert {q: sorted(x) for q, x in got.items()} == want, k


def test_search_of_empty_tables(spark):
    none = spark.createDataFrame([], "id long, text string, place string")
    one = spark.createDataFrame([(1, "tax", None)], "query long, text string, place string")
    assert retrieval.searched(one, none).count() == 0
    assert retrieval.searched(one.where("query > 1"), none).count() == 0


def test_marks_are_the_places_of_both_scores(spark):
    r = random.Random(3)
    rows = [(i, r.gauss(0, 1), r.gauss(5, 2)) for i in range(400)] + [(1000, 40.0, -60.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    got = stats.unsupervised(df, "id", ["a", "b"]).collect()
    assert len(got) == 401
    iso, far = sorted((x.iso for x in got), reverse=True)[19], sorted((x.distance for x in got), reverse=True)[39]
    assert all(x.by_forest == (x.iso > 0.65 or x.iso >= iso) and x.by_centre == (x.distance >= far) and x.flagged == (x.by_forest or x.by_centre) for x in got)
    assert next(x for x in got if x.id == 1000).by_forest
    few = stats.unsupervised(df.limit(7), "id", ["a", "b"]).collect()
    assert len(few) == 7 and not any(x.flagged for x in few)
    same = stats.unsupervised(df.select("id", F.lit(1.0).alias("a"), F.lit(2.0).alias("b")), "id", ["a", "b"]).collect()
    assert not any(x.by_centre for x in same)
    assert stats.unsupervised(df.where("id < 0"), "id", ["a", "b"]).count() == 0


def test_quality_of_reports(spark):
    columns = "mandatory double, filled double, attachments int, external int, related int, patterns int, transactions int, dated int, ranged boolean, named boolean, identified boolean, reason string, narrative string, amount double, alert double"
    full = (1.0, 1.0, 2, 1, 2, 1, 5, 5, True, True, True, "splitting", "Moved 1,020.50 in all. " + "x" * 80, 1000.0, 10.0)
    bare = (None,) * 15
    wrong = (0.5, 0.6, 0, 0, 0, 0, 4, 1, False, True, False, "why", "Moved 2,000 in " + "y" * 40, 1000.0, 1.0)
    silent = (0.0, 0.7, 0, 1, 3, 2, 9, 0, True, False, True, "", ", none", 5.0, 0.0)
    got = [tuple(r) for r in audits.report_quality(spark.createDataFrame([full, bare, wrong, silent], columns)).select("complete", "accurate", "logical", "complies", "total", "grade").collect()]
    assert got == [
        (30.0, 25.0, 25.0, 20.0, 100.0, "excellent"),
        (0.0, 0.0, 0.0, 10.0, 10.0, "poor"),
        (10.0, 10.0, 9.0, 14.0, 43.0, "poor"),
        (0.0, 11.0, 10.0, 17.0, 38.0, "poor"),
    ]


def test_best_records_against_all_pairs(spark):
    r = random.Random(21)
    names = ["acme works", "acme work", "blue sky", "", None, *("".join(r.choice("abcde ") for _ in range(9)) for _ in range(40))]
    schema = "id long, name string, incl double, excl double, tax double, quantity double, date date"
    day = lambda: None if r.random() < 0.1 else datetime.date(2024, 1, 1) + datetime.timedelta(r.randint(0, 40))

    def some(n, start):
        out = []
        for i in range(n):
            x = r.choice([0.0, 100.0, 101.0, 103.9, 250.0]) * r.uniform(0.99, 1.01)
            out.append((start + i, r.choice(names), x, x / 1.13, r.choice([0.0, x * 0.13]), float(r.randint(0, 5)), day()))
        return out

    left, right = some(60, 0), some(80, 1000)
    got = {x.id: (x.match, x.score and round(x.score, 9)) for x in joins.record_matches(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)).collect()}

    def score(a, b):
        total, weight = 0.0, 0.2
        if a[1] and b[1]:
            total = 0.2 * (difflib.SequenceMatcher(None, a[1], b[1]).ratio())
        for i, (w, t) in zip((2, 3, 4, 5), joins.RECORD_PARTS.values(), strict=True):
            if a[i] > 0 and b[i] > 0:
                total, weight = total + w * max(0, 1 - abs(a[i] - b[i]) / a[i] / max(2 * t, 0.01)), weight + w
        if a[6] and b[6]:
            total, weight = total + 0.1 * max(0, 1 - abs((a[6] - b[6]).days) / 30), weight + 0.1
        return total / weight

    for a in left:
        best = max(((score(a, b), -b[0]) for b in right if a[2] > 0 and b[2] > 0), default=(0, 0))
        if best[0] >= 0.7:
            assert got[a[0]][1] == round(best[0], 9) and score(a, next(b for b in right if b[0] == got[a[0]][0])) >= best[0] - 1e-9, a
        else:
            assert got[a[0]] == (None, None), a
