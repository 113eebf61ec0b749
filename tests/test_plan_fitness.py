"""A plan's fitness against one loop over its teams."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quillon.operators import audits

AUDITORS = "auditor long, skills map<string,double>, available double, rate double, lat double, lon double, goals array<string>, level int"
PROJECTS = "project long, required map<string,double>, weeks int, budget double, min_senior int, lat double, lon double, industry string, cluster string"


def _km(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(h))


def _force(teams, auditors, projects, history):
    hours = {}
    for p in projects.values():
        for a in teams.get(p["project"], []):
            hours[a] = hours.get(a, 0) + p["weeks"] * 10
    bad = sum(h > 4 * auditors[a]["available"] for a, h in hours.items())
    parts = {n: [] for n in ("skill", "development", "synergy", "continuity")}
    spent = 0.0
    for k, p in projects.items():
        team = [auditors[a] for a in teams.get(k, [])]
        bad += sum(a["level"] >= 2 for a in team) < p["min_senior"]
        best = {}
        for a in team:
            for s, v in a["skills"].items():
                best[s] = max(best.get(s, 0), v)
        size = math.sqrt(sum(v * v for v in best.values())) * math.sqrt(sum(v * v for v in p["required"].values()))
        parts["skill"].append(100 * sum(v * p["required"].get(s, 0) for s, v in best.items()) / size if size else 0)
        spent += sum(1.5 * _km((a["lat"], a["lon"]), (p["lat"], p["lon"])) + hours[a["auditor"]] * a["rate"] for a in team)
        grows = sum(30 * (p["industry"] in a["goals"] or p["cluster"] in a["goals"]) + 20 * len(set(p["required"]) & set(a["goals"])) + 20 * (a["level"] > 0 and p["min_senior"] > 0) for a in team)
        parts["development"].append(grows / max(len(team), 1))
        pairs = [len(set(a["skills"]) & set(b["skills"])) / (len(set(a["skills"]) | set(b["skills"])) or 1) for i, a in enumerate(team) for b in team[i + 1 :]]
        parts["synergy"].append(100 * sum(pairs) / len(pairs) if pairs else 50)
        past = {a for q, a in history if q == k}
        parts["continuity"].append(100 * len(past & {a["auditor"] for a in team}) / len(past) if past else 50)
    out = {n: sum(v) / len(projects) for n, v in parts.items()}
    mean = sum(hours.values()) / len(hours)
    out["load"] = max(0, 100 - math.sqrt(sum((h - mean) ** 2 for h in hours.values()) / len(hours)) / max(mean, 1) * 100)
    out["cost"] = max(0, 100 - spent / (sum(p["budget"] for p in projects.values()) or 1) * 100)
    out["violations"], out["spent"] = bad, spent
    out["fitness"] = sum(w * out[n] for n, w in audits.PLAN_PARTS.items()) - 15 * bad
    return out


def test_plans_against_a_loop(spark):
    r = random.Random(8)
    some = lambda of, n: r.sample(of, r.randint(0, n))
    skills = ["tax", "it", "law", "bank"]
    auditors = {i: {"auditor": i, "skills": {s: float(r.randint(1, 5)) for s in some(skills, 3)}, "available": float(r.choice([5, 20, 40])), "rate": r.uniform(1, 9), "lat": r.uniform(-60, 60), "lon": r.uniform(-170, 170), "goals": some([*skills, "steel", "north"], 3), "level": r.randint(0, 3)} for i in range(30)}
    projects = {i: {"project": i, "required": {s: float(r.randint(1, 5)) for s in r.sample(skills, 2)}, "weeks": r.randint(1, 6), "budget": r.uniform(1e4, 9e4), "min_senior": r.randint(0, 2), "lat": r.uniform(-60, 60), "lon": r.uniform(-170, 170), "industry": r.choice(["steel", "retail"]), "cluster": r.choice(["north", "south"])} for i in range(9)}
    history = [(p, a) for p in range(0, 9, 2) for a in some(list(auditors), 5)]
    plans = {plan: {p: some(list(auditors), 6) for p in projects if r.random() < 0.8} for plan in range(6)}
    rows = [(plan, p, a) for plan, teams in plans.items() for p, team in teams.items() for a in team]
    strays = [(0, 0, 999), (0, 999, 1), rows[0]]
    df = spark.createDataFrame
    got = audits.plan_fitness(
        df(rows + strays, "plan long, project long, auditor long"), df(list(auditors.values()), AUDITORS), df(list(projects.values()), PROJECTS), df(history + history[:1], "project long, auditor long")
    ).collect()
    assert {x.plan for x in got} == set(plans)
    for x in got:
        want = _force(plans[x.plan], auditors, projects, history)
        for n, v in want.items():
            assert x[n] == pytest.approx(v, abs=1e-6), (x.plan, n)


def test_no_plans(spark):
    df = spark.createDataFrame
    none = df([], "plan long, project long, auditor long")
    assert audits.plan_fitness(none, df([], AUDITORS), df([], PROJECTS), df([], "project long, auditor long")).count() == 0


def test_team_of_many_makes_no_pairs(spark):
    """200 000 auditors in one team, two rows of one of them: synergy by counts, as over all pairs."""
    n = 200_000
    a = F.col("id")
    teams = spark.range(n).withColumn("id", F.when(a == n - 1, 1).otherwise(a)).select(F.lit(1).alias("project"), a.alias("auditor"), F.create_map(F.when(a % 2 == 0, "x").otherwise("y"), F.lit(1.0), F.lit("z"), F.lit(2.0)).alias("skills"), F.lit(1.0).alias("hours"), F.lit(1.0).alias("available"), F.lit(2).alias("level"))
    projects = spark.createDataFrame([(1, {"x": 1.0}, 0)], "project int, required map<string,double>, min_senior int")
    got = audits.team_fitness(teams, projects).first().synergy
    h = n // 2
    same, pairs = h * (h - 1) - 1, n * (n - 1) // 2 - 1  # both rows of auditor 1 have y
    assert abs(got - 100 * (same + h * h / 3) / pairs) < 1e-6
