"""Building blocks of audit work: differences, papers, programs, plans, remediation, environment, claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.rules import bands

# Words that speak for a kind of difference, and the order in which kinds win ties.
DIFFERENCES = {"timing": ["in transit", "cut-off", "next period"], "error": ["wrong", "posted twice", "typo"], "fraud": ["forged", "fictitious"], "policy": ["policy", "method"]}


def difference_kind(text: Column, diff: Column, book: Column, likeness: Column, tolerance: float) -> Column:
    """(kind, score) of a difference between book and reply: .25 for each word, .3 for timing within the tolerance, .2 for an error
    beyond it, .15 for fraud where the two texts are unlike; an error at .1 if nothing speaks."""
    share = F.coalesce(F.try_divide(diff, F.abs(book)), F.lit(0.0))
    scores = {k: sum((F.when(text.contains(w), 0.25).otherwise(0.0) for w in some), F.lit(0.0)) for k, some in DIFFERENCES.items()}
    scores["timing"] = scores["timing"] + F.when(F.abs(share) <= tolerance, 0.3).otherwise(0.0)
    scores["error"] = scores["error"] + F.when((diff != 0) & (F.abs(share) > tolerance), 0.2).otherwise(0.0)
    scores["fraud"] = scores["fraud"] + F.when(likeness < 0.4, 0.15).otherwise(0.0)
    options = F.array(*[F.struct(F.round(s, 9).alias("score"), F.lit(-i).alias("o"), F.lit(k).alias("kind")) for i, (k, s) in enumerate(scores.items())])
    best = F.array_max(options)
    return F.when(best["score"] > 0, F.struct(best["kind"].alias("kind"), F.least(best["score"], F.lit(1.0)).alias("score"))).otherwise(F.struct(F.lit("error").alias("kind"), F.lit(0.1).alias("score")))


def difference_severity(diff: Column, book: Column, materiality: Column, kind: Column) -> Column:
    """Bands of a difference over materiality, one per cent of the book amount where none is set; fraud is high at least."""
    base = F.when(materiality > 0, materiality).otherwise(F.abs(book) * 0.01)
    share = F.when(base > 0, F.abs(diff) / base).otherwise(0.0)
    plain = F.when(share > 0.5, "critical").when(share > 0.1, "high").when(share > 0.02, "medium").otherwise("low")
    return F.when(kind == "fraud", F.when(share > 0.1, "critical").otherwise("high")).otherwise(plain)


def reconciled(left: DataFrame, right: DataFrame, keys: list[str], field: str, value: str, tolerance: float = 0.01) -> DataFrame:
    """(keys, field, audit, bank, kind, diff) of two ledgers' values that differ: a full join on key and field. Numbers differ beyond
    the tolerance (kind amount where the field's name says so, else other), texts by being unequal (account or other); a value that
    one side lacks differs."""
    a = left.select(*keys, field, F.col(value).alias("audit"))
    b = right.select(*keys, field, F.col(value).alias("bank"))
    met = a.join(b, [*keys, field], "full")
    x, y = F.col("audit").try_cast("double"), F.col("bank").try_cast("double")
    numbers = x.isNotNull() & y.isNotNull()
    name = F.lower(F.col(field))
    kind = F.when(numbers, F.when(name.rlike("balance|amount"), "amount").otherwise("other")).otherwise(F.when(name.rlike("account|name"), "account").otherwise("other"))
    differ = F.when(numbers, F.abs(x - y) > tolerance).otherwise(~F.col("audit").eqNullSafe(F.col("bank")))
    return met.where(differ).select(*keys, field, "audit", "bank", kind.alias("kind"), F.when(numbers, y - x).alias("diff"))


def paper_scores(df: DataFrame) -> DataFrame:
    """Rows of working papers (content, mandatory, mandatory_hit, evidences, debit, credit, conclusion, standards, standards_hit) with
    five rubrics from 0 to 100."""
    text = F.col("content")
    clamp = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(100.0))
    off = lambda test, n: F.when(test, float(n)).otherwise(0.0)
    complete = F.when(F.col("mandatory") == 0, 80.0).otherwise(F.least(F.lit(100.0), 60 + 40 * (F.col("mandatory_hit") / F.greatest(F.col("mandatory"), F.lit(1)))) - off(F.col("evidences") < 2, 10))
    unequal = (F.col("debit") != 0) & (F.col("credit") != 0) & (F.abs(F.col("debit") - F.col("credit")) > 0.01)
    accurate = 80.0 - off(unequal, 30) - off(F.regexp_count(text, F.lit("[0-9]+[.][0-9]{3,}")) > 5, 10) - off(text.contains("USD") & text.rlike("-[0-9]+[.][0-9]{2}"), 5)
    logical = 75.0 - off(F.coalesce(F.col("conclusion"), F.lit("")) == "", 25) - off(text.contains("subsequent") & ~text.contains("cut-off"), 8)
    complies = F.least(F.lit(100.0), 50 + 50 * (F.col("standards_hit") / F.greatest(F.col("standards"), F.lit(1))))
    long_ = F.size(F.filter(F.split(text, "[.!?]"), lambda s: F.char_length(s) > 80))
    written = 85.0 - off(text.rlike("[★◆▲]"), 10) - off(long_ > 3, 10) - off(text.contains("the the"), 3) - off((F.char_length("conclusion") > 0) & (F.char_length("conclusion") < 10), 10)
    return df.withColumns({"completeness": clamp(complete), "accuracy": clamp(accurate), "logic": clamp(logical), "compliance": clamp(complies), "quality": clamp(written)})


def lineage(pairs: DataFrame, source: str, source_id: str, target: str, target_id: str, transform: Column) -> DataFrame:
    """(source_table, source_id, target_table, target_id, transform) of rows that hold both ids."""
    return pairs.select(F.lit(source).alias("source_table"), F.col(source_id).cast("long").alias("source_id"), F.lit(target).alias("target_table"), F.col(target_id).cast("long").alias("target_id"), transform.alias("transform"))


def acceleration(rpa: Column, ml: Column) -> Column:
    """What of a task's hours is saved: replaced work, and of the rest what models help with; .95 at most."""
    return F.least(F.lit(0.95), rpa + ml * (1 - rpa))


def failure_risk(severity: Column, complexity: Column, cross: Column, passed: Column, remaining: Column, planned: Column, history: Column) -> Column:
    """The chance that a remediation fails: severity, complexity .25, departments .15, delay, history .17; 1 at most."""
    weight = F.when(severity == 1, 0.05).when(severity == 2, 0.10).when(severity == 3, 0.18).otherwise(0.28)
    late = F.when(remaining < 0, F.least(F.lit(0.30), F.abs(remaining) / 100)).when((passed / F.greatest(planned, F.lit(1.0)) > 0.7) & (remaining > 0), 0.05).otherwise(0.0)
    return F.least(F.lit(1.0), weight + complexity * 0.25 + cross * 0.15 + late + history * 0.17)


def progress(passed: Column, planned: Column, risk: Column) -> Column:
    """Elapsed over planned time, damped by the risk."""
    base = F.least(F.lit(1.0), passed / F.greatest(planned, F.lit(1.0)))
    return base * F.when(risk > 0.6, 0.7).when(risk > 0.3, 0.88).otherwise(1.0)


def spc_risk(high: Column, medium: Column, low: Column, cv: Column) -> Column:
    """Risk of a controlled process by its anomalies and its variation."""
    n = high + medium + low
    score = high * 0.4 + medium * 0.2 + low * 0.05 + F.least(F.lit(0.2), n * 0.02) + F.least(F.lit(0.2), cv * 0.5)
    return F.when(n == 0, F.greatest(F.lit(0.0), 0.3 - F.least(cv, F.lit(0.3)))).otherwise(F.least(F.lit(1.0), score))


# Changes of indices between two slices and what they are called, the most severe first.
CHANGES = {"ndvi": [("deforestation", -0.15), ("degradation", -0.08), ("recovery", 0.08)], "ndwi": [("drought", -0.15), ("pollution_drop", -0.10)], "nbr": [("fire", -0.20), ("partial_burn", -0.10)]}


def slice_changes(df: DataFrame, keys: list[str], order: list[str], least: float = 0.02) -> DataFrame:
    """(keys, order, index, delta, label) of every index that moved by more than ``least`` since the slice before; all thresholds are
    looked at, the most severe first."""
    by = Window.partitionBy(*keys).orderBy(*order)
    rows = df.select(*keys, *order, *CHANGES, *[F.lag(i).over(by).alias(f"_{i}") for i in CHANGES])
    parts = []
    for index, known in CHANGES.items():
        delta = F.col(index) - F.col(f"_{index}")
        label = F.when(delta < 0, "down").otherwise("up")
        for name, bound in reversed(known):
            label = F.when(delta <= bound if bound < 0 else delta >= bound, name).otherwise(label)
        parts.append(F.when(F.abs(delta) > least, F.struct(F.lit(index).alias("index"), delta.alias("delta"), label.alias("label"))))
    return rows.select(*keys, *order, F.explode(F.array_compact(F.array(*parts))).alias("x")).select(*keys, *order, "x.*")


def greenwash(first: Column, last: Column, claims: dict[str, Column]) -> Column:
    """(score, signal): claims of greening, saving carbon and sparing water against what the indices did from ``first`` to ``last``,
    both structs of ndvi and ndwi; claims are flags by name."""
    green, water = last["ndvi"] - first["ndvi"], last["ndwi"] - first["ndwi"]
    tests = [(claims["greening"], green > 0.05, 1.0), (claims["carbon"], green >= 0, 0.5), (claims["water"], water >= -0.05, 1.0)]
    support = sum((F.when(c & ok, w).otherwise(0.0) for c, ok, w in tests), F.lit(0.0))
    against = sum((F.when(c & ~ok, w).otherwise(0.0) for c, ok, w in tests), F.lit(0.0))
    share = F.try_divide(support, support + against)
    signal = F.when(share.isNull(), "no_claim_match").when(share < 0.4, "contradiction").when(share < 0.7, "weak_support").otherwise("supported")
    return F.struct(F.coalesce(share, F.lit(0.5)).alias("score"), signal.alias("signal"))


def versions(changes: DataFrame, program: str, order: str, kind: str, first: tuple[int, int, int] = (1, 0, 0)) -> DataFrame:
    """Each change of a program with the version before and after it: a major change starts minor and patch anew, a minor one patch.

    Counts since the last major and minor change, by windows over the program's log; no fold.
    """
    by = Window.partitionBy(program).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    is_ = lambda k: F.when(F.col(kind) == k, 1).otherwise(0)
    rows = changes.withColumn("_major", F.sum(is_("major")).over(by))
    epoch = Window.partitionBy(program, "_major").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_minor", F.sum(is_("minor")).over(epoch))
    step = Window.partitionBy(program, "_major", "_minor").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_patch", F.sum(is_("patch")).over(step))
    minor = F.col("_minor") + F.when(F.col("_major") == 0, first[1]).otherwise(0)
    patch = F.col("_patch") + F.when((F.col("_major") == 0) & (F.col("_minor") == 0), first[2]).otherwise(0)
    new = F.concat_ws(".", (F.col("_major") + first[0]).cast("string"), minor.cast("string"), patch.cast("string"))
    before = F.lag("new_version").over(Window.partitionBy(program).orderBy(order))
    rows = rows.withColumn("new_version", new).withColumn("old_version", F.coalesce(before, F.lit(".".join(map(str, first)))))
    return rows.drop("_major", "_minor", "_patch")


def rolled_back(log: DataFrame, program: str, order: str, targets: DataFrame) -> DataFrame:
    """(program, version, remaining, status) after going back to each program's target (program, target): the log keeps what came
    before the target; a version that the log does not know is an error and changes nothing."""
    met = log.join(targets, program)
    found = met.groupBy(program, "target").agg(F.min(F.when(F.col("old_version") == F.col("target"), F.col(order) - 1)).alias("_old"), F.min(F.when(F.col("new_version") == F.col("target"), F.col(order))).alias("_new"), F.max_by("new_version", order).alias("now"), F.count("*").alias("n"))
    # the first entry that names the target, by its old version before by its new one
    cut = F.when(F.col("_old").isNotNull() & (F.col("_new").isNull() | (F.col("_old") < F.col("_new"))), F.col("_old")).otherwise(F.col("_new"))
    kept = log.join(found.select(program, cut.alias("_cut")), program).where(F.col(order) <= F.col("_cut")).groupBy(program).agg(F.count("*").alias("kept"))
    out = found.withColumn("_cut", cut).join(kept, program, "left")
    known = F.col("_cut").isNotNull()
    return out.select(program, F.when(known, F.col("target")).otherwise(F.col("now")).alias("version"), F.when(known, F.coalesce("kept", F.lit(0).cast("long"))).otherwise(F.col("n")).alias("remaining"), F.when(known, "success").otherwise("unknown_version").alias("status"))


def quality_of_reply(query: Column, reply: Column, has_cases: Column, structured: Column) -> Column:
    """The weighted mean of four checks: words of the question answered (1.5 times their share, .3), a constant .85 (.25), structure
    (.25) and cases cited (.2)."""
    tokens = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != ""))
    covered = F.size(F.array_intersect(tokens(query), tokens(reply))) / F.greatest(F.size(tokens(query)), F.lit(1))
    return F.least(F.lit(1.0), covered * 1.5) * 0.3 + 0.85 * 0.25 + F.when(structured, 0.8).otherwise(0.4) * 0.25 + F.when(has_cases, 0.7).otherwise(0.4) * 0.2


def solution_score(severity: Column, urgency: Column, success: Column, difficulty: Column) -> Column:
    """Severity .3, urgency .25, success .3, ease .15; whole, from 0 to 100."""
    weight = lambda c: F.when(c == "high", 90).when(c == "medium", 60).otherwise(30)
    penalty = F.when(difficulty == "high", 20).when(difficulty == "medium", 10).otherwise(0)
    raw = weight(severity) * 0.3 + weight(urgency) * 0.25 + success * 100 * 0.3 + (50 - penalty) * 0.15
    return F.floor(F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw)), 9)).cast("int")


def solution_grade(score: Column) -> Column:
    return bands(score, [(85, "strong"), (70, "recommended"), (50, "optional")], "no")


def verified(df: DataFrame, keys: list[str], rules: list[tuple[str, float, Column, Column]]) -> DataFrame:
    """Rows with the weighted share of rules (name, weight, passes, has data) they pass, the share with data, and the verdict."""
    total = sum(w for _, w, _, _ in rules)
    score = sum((F.when(F.coalesce(ok & have, F.lit(False)), w).otherwise(0.0) for _, w, ok, have in rules), F.lit(0.0)) / total
    cover = sum((have.cast("int") for *_, have in rules), F.lit(0)) / len(rules)
    verdict = F.when(F.round(F.col("score"), 9) >= 0.8, "pass").when(F.round(F.col("score"), 9) >= 0.6, "conditional").otherwise("fail")
    return df.withColumn("score", score).withColumn("coverage", cover).withColumn("verdict", verdict)


def _alike_pairs(names: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, alike, pairs): over the pairs of rows with the same keys, the sum of the Jaccard of their sorted ``names``, and their number."""
    sets = names.groupBy(*keys, "names").agg(F.count("*").alias("k"))
    met = sets.join(sets.toDF(*keys, "others", "l"), keys).where("names <= others")
    pairs = F.when(F.col("names") == F.col("others"), F.col("k") * (F.col("k") - 1) / 2).otherwise(F.col("k") * F.col("l").cast("double"))
    alike = F.size(F.array_intersect("names", "others")) / F.greatest(F.size(F.array_union("names", "others")), F.lit(1))
    return met.groupBy(*keys).agg(F.sum(alike * pairs).alias("alike"), F.sum(pairs).alias("pairs"))


def team_fitness(teams: DataFrame, projects: DataFrame) -> DataFrame:
    """(project, skill, load, synergy, violations, fitness) of teams (project, auditor, skills: map, hours, available, level) against
    projects (project, required: map, min_senior): cosine of the team's best skills with those required, balance of hours, shared
    skills of pairs, and 15 less for each violation. Pairs are counted over a team's different sets of skills and how many have
    each, so a team of any size makes no pairs of auditors."""
    from quillon.functions.numbers import cosine

    best = teams.select("project", F.explode("skills").alias("k", "v")).groupBy("project", "k").agg(F.max("v").alias("v")).groupBy("project").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("have"))
    load = teams.groupBy("project").agg(F.avg("hours").alias("m"), F.stddev_pop("hours").alias("s"), F.count_if(F.col("hours") > 4 * F.col("available")).alias("over"), F.count_if(F.col("level") >= 2).alias("seniors"))
    names = teams.where("auditor is not null").select("project", "auditor", F.array_sort(F.map_keys("skills")).alias("names"))
    twice = names.groupBy("project", "auditor").agg(F.count("*").alias("n")).where("n > 1").select("project", "auditor")
    # an auditor's own rows are no pair
    both = _alike_pairs(names, ["project"]).unionAll(_alike_pairs(names.join(twice, ["project", "auditor"]), ["project", "auditor"]).select("project", -F.col("alike"), -F.col("pairs")))
    synergy = both.groupBy("project").agg(F.try_divide(F.sum("alike"), F.sum("pairs")).alias("synergy"))
    met = projects.join(best, "project", "left").join(load, "project", "left").join(synergy, "project", "left")
    every = F.array_union(F.map_keys("have"), F.map_keys("required"))
    at = lambda m: F.transform(every, lambda k: F.coalesce(F.try_element_at(F.col(m), k), F.lit(0.0)))
    skill = F.when(F.col("have").isNull(), 0.0).otherwise(F.coalesce(cosine(at("have"), at("required")), F.lit(0.0)) * 100)
    balance = F.greatest(F.lit(0.0), 100 - F.col("s") / F.greatest(F.col("m"), F.lit(1.0)) * 100)
    bad = F.coalesce("over", F.lit(0)) + F.when(F.coalesce("seniors", F.lit(0)) < F.col("min_senior"), 1).otherwise(0)
    out = met.select("project", skill.alias("skill"), F.coalesce(balance, F.lit(0.0)).alias("load"), F.coalesce(F.col("synergy") * 100, F.lit(50.0)).alias("synergy"), bad.alias("violations"))
    return out.withColumn("fitness", F.col("skill") * 0.35 + F.col("load") * 0.20 + F.col("synergy") * 0.10 - F.col("violations") * 15)


def report_quality(df: DataFrame) -> DataFrame:
    """Rows with ``complete`` (30 at most), ``accurate`` (25), ``logical`` (25), ``complies`` (20), ``total`` and ``grade`` of a filed
    report, from mandatory and filled (shares of fields with a value), attachments, external, related, patterns, transactions and dated
    (counts), ranged, named and identified (booleans), reason, narrative, amount and alert. A missing text is empty, a missing count 0."""
    no = lambda name, of=0.0: F.coalesce(F.col(name).cast(type(of).__name__.replace("float", "double").replace("str", "string").replace("bool", "boolean")), F.lit(of))
    reason, story, amount, patterns = no("reason", ""), no("narrative", ""), no("amount"), no("patterns") > 0
    when = lambda *steps: F.coalesce(*[F.when(test, float(n)) for test, n in steps], F.lit(0.0))
    named = F.replace(F.regexp_extract(story, "[0-9,]+(?:\\.[0-9]+)?", 0), F.lit(","), F.lit("")).try_cast("double")
    said = F.coalesce(named, F.lit(0.0))
    near = F.abs(said - amount) / F.greatest(amount, F.lit(1.0)) < 0.05
    complete = no("mandatory") * 15 + when((no("attachments") > 0, 10)) + when(((reason != "") & (no("external") > 0), 5), (reason != "", 2.5))
    accurate = when(((said != 0) & near, 10), ((said == 0) & (amount > 0), 6)) + when(((no("dated") > 0) & no("ranged", False), 5), (no("dated") > 0, 2.5))
    accurate = accurate + when((no("named", False) & no("identified", False), 5), (no("named", False), 2.5)) + when(((reason != "") | patterns, 5))
    length = F.char_length(reason) + 1 + F.char_length(story)
    depth = when((no("transactions") >= 5, 3)) + when((no("related") + no("external") >= 3, 3)) + when((patterns, 4))
    logical = when(((length >= 100) & patterns, 10), (length >= 50, 6)) + depth + when((patterns & (no("alert") > 0), 5), (no("alert") > 0, 3))
    # in time and confidential: 5 each, as the report is made when it is due and by the system itself
    complies = when((no("filled") >= 0.9, 10), (no("filled") >= 0.7, 7), (no("filled") >= 0.5, 4)) + 10.0
    out = df.withColumns({"complete": complete, "accurate": accurate, "logical": logical, "complies": complies})
    total = F.col("complete") + F.col("accurate") + F.col("logical") + F.col("complies")
    return out.withColumn("total", total).withColumn("grade", bands(F.round("total", 9), [(90, "excellent"), (80, "good"), (70, "fair")], "poor"))


# Weights of the parts of a plan's fitness, what a violation costs, travel by the kilometre, hours by the week.
PLAN_PARTS = {"skill": 0.35, "load": 0.20, "cost": 0.15, "development": 0.15, "synergy": 0.10, "continuity": 0.05}
VIOLATION, TRAVEL, WEEK_HOURS = 15, 1.5, 10


def plan_fitness(assigned: DataFrame, auditors: DataFrame, projects: DataFrame, history: DataFrame) -> DataFrame:
    """(plan, the six parts, violations, spent, fitness) of each plan's assignment of auditors to all projects.

    assigned: plan, project, auditor (repeats count once, unknown auditors and projects not at all); auditors: auditor, skills (map),
    available (hours a week), rate, lat, lon, goals (array), level (0 junior, 2 and more senior); projects: project, required (map),
    weeks, budget, min_senior, lat, lon, industry, cluster; history: project, auditor. A project without a team has skill and
    development 0 and synergy 50; one without history has continuity 50; one auditor alone has synergy 50.

    A team's synergy is counted over its different sets of skills and how many have each, so large teams make no pairs of auditors,
    and projects without a team come from totals, so plans and projects are not multiplied.
    """
    from quillon.functions.numbers import haversine_km

    past = history.select("project", "auditor").distinct()
    # what projects have before there is a team
    norm = F.sqrt(F.aggregate(F.map_values("required"), F.lit(0.0), lambda t, w: t + w * w))
    works = projects.join(past.groupBy("project").agg(F.count("*").alias("_past")), "project", "left").withColumn("_norm", norm).select("*", F.col("lat").alias("_lat"), F.col("lon").alias("_lon")).drop("lat", "lon")
    of = works.agg(F.count("*").alias("_all"), F.sum("budget").alias("_budget"), F.count_if(F.col("_past").isNull()).alias("_new"), F.count_if(F.col("min_senior") > 0).alias("_led"))
    met = assigned.select("plan", "project", "auditor").distinct().join(auditors, "auditor").join(works, "project")
    met = met.join(past.withColumn("_was", F.lit(1)), ["project", "auditor"], "left")
    hours = met.groupBy("plan", "auditor").agg(F.sum(F.col("weeks") * WEEK_HOURS).alias("_hours"), F.first("available").alias("available"))
    load = hours.groupBy("plan").agg(F.avg("_hours").alias("_mean"), F.stddev_pop("_hours").alias("_std"), F.count_if(F.col("_hours") > 4 * F.col("available")).alias("_over"))
    aims = lambda c: F.coalesce(F.array_contains("goals", F.col(c)), F.lit(False))
    grows = F.when(aims("industry") | aims("cluster"), 30).otherwise(0) + 20 * F.size(F.array_intersect(F.map_keys("required"), "goals")) + F.when((F.col("level") > 0) & (F.col("min_senior") > 0), 20).otherwise(0)
    costs = TRAVEL * haversine_km(F.col("lat"), F.col("lon"), F.col("_lat"), F.col("_lon")) + F.col("_hours") * F.col("rate")
    team = met.join(hours.drop("available"), ["plan", "auditor"]).groupBy("plan", "project").agg(
        F.sum(costs).alias("_spent"), F.avg(grows).alias("_grows"), F.count_if(F.col("level") >= 2).alias("_seniors"), F.count("_was").alias("_back"),
        F.first("_past").alias("_past"), F.first("min_senior").alias("_need"), F.count("*").alias("_n"),
    )
    wanted = F.coalesce(F.try_element_at("required", F.col("k")), F.lit(0.0))
    best = met.select("plan", "project", "required", "_norm", F.explode("skills").alias("k", "v")).select("plan", "project", "_norm", "k", "v", wanted.alias("w"))
    best = best.groupBy("plan", "project", "k").agg(F.max("v").alias("v"), F.first("w").alias("w"), F.first("_norm").alias("_norm"))
    fits = best.groupBy("plan", "project").agg(F.coalesce(F.try_divide(F.sum(F.col("v") * F.col("w")), F.sqrt(F.sum(F.col("v") * F.col("v"))) * F.first("_norm")), F.lit(0.0)).alias("_skill"))
    sets = met.groupBy("plan", "project", F.array_sort(F.map_keys("skills")).alias("_s")).agg(F.count("*").alias("_k"))
    other = sets.select("plan", "project", F.col("_s").alias("_t"), F.col("_k").alias("_l"))
    alike = F.size(F.array_intersect("_s", "_t")) / F.greatest(F.size(F.array_union("_s", "_t")), F.lit(1))
    pairs = F.when(F.col("_s") == F.col("_t"), F.col("_k") * (F.col("_k") - 1) / 2).otherwise(F.col("_k") * F.col("_l").cast("double"))
    together = sets.join(other, ["plan", "project"]).where("_s <= _t").groupBy("plan", "project").agg(F.sum(alike * pairs).alias("_alike"))
    team = team.join(fits, ["plan", "project"], "left").join(together, ["plan", "project"], "left")
    synergy = F.when(F.col("_n") < 2, 50.0).otherwise(F.col("_alike") / (F.col("_n") * (F.col("_n") - 1) / 2) * 100)
    kept = F.when(F.col("_past").isNull(), 50.0).otherwise(F.col("_back") / F.col("_past") * 100)
    plans = team.groupBy("plan").agg(
        F.count("*").alias("_teams"), F.sum("_spent").alias("spent"), F.sum("_grows").alias("_grows"), F.sum(F.coalesce("_skill", F.lit(0.0))).alias("_skill"), F.sum(synergy).alias("_synergy"), F.sum(kept).alias("_kept"),
        F.count_if(F.col("_past").isNull()).alias("_had_new"), F.count_if(F.col("_need") > 0).alias("_had_led"), F.count_if((F.col("_need") > 0) & (F.col("_seniors") < F.col("_need"))).alias("_unled"),
    )
    met = plans.join(load, "plan").crossJoin(F.broadcast(of))  # one row
    up = lambda c: F.greatest(F.lit(0.0), c)
    parts = {
        "skill": F.col("_skill") / F.col("_all") * 100,
        "load": up(100 - F.col("_std") / F.greatest(F.col("_mean"), F.lit(1.0)) * 100),
        "cost": up(100 - F.col("spent") / F.when(F.coalesce(F.col("_budget"), F.lit(0)) == 0, 1).otherwise(F.col("_budget")) * 100),
        "development": F.col("_grows") / F.col("_all"),
        "synergy": (F.col("_synergy") + 50 * (F.col("_all") - F.col("_teams"))) / F.col("_all"),
        "continuity": (F.col("_kept") + 50 * (F.col("_new") - F.col("_had_new"))) / F.col("_all"),
    }
    bad = F.col("_over") + F.col("_unled") + F.col("_led") - F.col("_had_led")
    out = met.select("plan", *[c.alias(n) for n, c in parts.items()], bad.alias("violations"), "spent")
    return out.withColumn("fitness", sum((F.col(n) * w for n, w in PLAN_PARTS.items()), F.lit(0.0)) - VIOLATION * F.col("violations"))
