"""Rules as data, compiled to columns: predicates, weights, bands."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPS = {">": operator.gt, ">=": operator.ge, "<": operator.lt, "<=": operator.le, "==": operator.eq, "!=": operator.ne}


def bands(score: Column, steps: list[tuple[float, str]], least: str) -> Column:
    """The label of the first (bound, label), from the top, that the score reaches."""
    out = F.lit(least)
    for low, label in sorted(steps):
        out = F.when(score >= low, label).otherwise(out)
    return out


def compare(column: Column, op: str, value) -> Column:
    """A comparison by name; null compares as false."""
    if op == "in":
        return F.coalesce(column.isin(*value), F.lit(False))
    return F.coalesce(OPS[op](column, value), F.lit(False))


def pattern(conditions: dict, amount: Column, when: Column, kind: Column | None = None, related: Column | None = None) -> Column:
    """The conjunction of named conditions on a transaction. None at all: false. A null operand: false."""
    whole = F.floor(amount)
    known = {
        "month": lambda v: F.month(when) == v, "month_in": lambda v: F.month(when).isin(*v),
        "day_min": lambda v: F.dayofmonth(when) >= v, "day_max": lambda v: F.dayofmonth(when) <= v,
        "hour_min": lambda v: F.hour(when) >= v, "hour_max": lambda v: F.hour(when) <= v,
        "hour_outside": lambda v: (F.hour(when) < v[0]) | (F.hour(when) > v[1]),
        "amount_min": lambda v: amount >= v, "amount_max": lambda v: amount <= v,
        "integer": lambda v: (amount == whole) == v, "multiple_of": lambda v: (whole % v == 0) & (whole > 0),
        "first_digit": lambda v: F.substring(whole.cast("string"), 1, 1) == str(v),
        "type": lambda v: kind == v, "type_in": lambda v: kind.isin(*v), "related_party": lambda v: related == v,
    }
    if not conditions:
        return F.lit(False)
    return F.coalesce(reduce(operator.and_, (known[k](v) for k, v in conditions.items())), F.lit(False))


def apply_rules(df: DataFrame, rules: list[tuple[str, float, Column]], into: str = "rules", score: str = "score", cap: float | None = None) -> DataFrame:
    """Every rule on every row: the names that match, in order, and the sum of their weights, capped."""
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, _, c in rules]))
    total = reduce(operator.add, (F.when(c, w).otherwise(0.0) for _, w, c in rules))
    return df.withColumn(into, names).withColumn(score, F.least(total, F.lit(cap)) if cap is not None else total)


def weighted(parts: list[tuple[float, Column]], low: float = 0.0, high: float = 100.0) -> Column:
    """Weighted sum, clamped."""
    return F.least(F.greatest(reduce(operator.add, (c * w for w, c in parts)), F.lit(low)), F.lit(high))


def metric(name: str | None, columns: list[str], when: str = "ts", value: str = "value") -> Column:
    """A metric of an event by name: its value, its amount, the hour or the weekday (Monday 0) of its time, or a column; else 0."""
    if name is None or (name == "amount" and "amount" not in columns):
        name = value
    if name == "hour":
        return F.hour(when).cast("double")
    if name == "day_of_week":
        return F.weekday(when).cast("double")
    return F.coalesce(F.col(name).try_cast("double"), F.lit(0.0)) if name in columns else F.lit(0.0)


def condition(cond: dict, columns: list[str], when: str = "ts", value: str = "value") -> Column:
    """One condition on a metric. Equality holds for numbers or for texts; what is no number compares as false."""
    name, target, op = cond.get("metric"), cond.get("value", cond.get("threshold")), cond.get("op", "==")
    number = metric(name, columns, when, value)
    if op == "==":
        same = compare(F.col(name).cast("string"), "==", str(target)) if name in columns else F.lit(False)
        return same if isinstance(target, str) else compare(number, "==", target) | same
    return compare(number, op, float(target)) if not isinstance(target, str) else F.lit(False)


def typed(rule: dict, columns: list[str], keys: list[str], order: list[str], when: str = "ts", value: str = "value", baselines: dict[str, Column] | None = None) -> Column:
    """Whether an event sets off a rule: ``threshold``; ``rate``, against the metric's baseline or the threshold itself;
    ``trend``, so many moves one way in a row within ``keys``; ``combo``, conditions joined by AND or OR."""
    kind, name = rule.get("type", "threshold"), rule.get("metric")
    if kind == "combo":
        parts = [condition(c, columns, when, value) for c in rule.get("conditions", [])]
        return reduce(operator.and_ if rule.get("logic", "AND") == "AND" else operator.or_, parts) if parts else F.lit(rule.get("logic", "AND") == "AND")
    now = metric(name, columns, when, value)
    if kind == "threshold":
        return compare(now, rule.get("op", ">"), rule.get("threshold", 0))
    if kind == "rate":
        limit, mean = rule.get("threshold", 100), (baselines or {}).get(name)
        share = F.lit(1.0) if mean is None else F.when(mean != 0, now / F.greatest(mean, F.lit(1.0))).otherwise(1.0)
        return F.coalesce((share > limit / 100 * 3) | (now > limit), F.lit(False))
    by = Window.partitionBy(*keys).orderBy(*order)
    up = rule.get("direction", "up") == "up"
    steps = []
    for k in range(rule.get("consecutive", 3)):
        new, old = (now if not k else F.lag(now, k).over(by)), F.lag(now, k + 1).over(by)
        steps.append(F.coalesce(new > old if up else new < old, F.lit(False)))
    return reduce(operator.and_, steps)


def steps(column: Column, bounds: list[tuple[float, float]], least: float) -> Column:
    """The number of the first (bound, number), from the top, that the column reaches."""
    out = F.lit(float(least))
    for low, number in sorted(bounds):
        out = F.when(column >= low, float(number)).otherwise(out)
    return out


def _clamped(score: Column) -> Column:
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(100.0))


def business_risk(capital: Column, years: Column, status: Column, changes: Column) -> Column:
    """Registered capital .30, age .30, status .25, changes .15; 0 to 100."""
    large = F.greatest(F.lit(0.0), _clamped(10 * (F.log10(F.lit(5e7)) / F.greatest(F.log10(capital), F.lit(1.0))) - 8))
    own = F.when(capital >= 5e7, large).otherwise(steps(capital, [(1e5, 50), (1e6, 25), (5e6, 10)], 80))
    age = steps(years, [(1, 50), (3, 30), (5, 15), (10, 5)], 80)
    state = F.when(status.isin("closed", "revoked", "suspended", "liquidation"), 100.0).when(status == "existing", 0.0).when(status == "operating", 5.0).otherwise(40.0)
    return _clamped(own * 0.30 + age * 0.30 + state * 0.25 + steps(changes, [(1, 15), (3, 30), (6, 50)], 0) * 0.15)


def litigation_risk(cases: Column, executed: Column, dishonest: Column, hits: Column) -> Column:
    """Cases .30, executions .25, defaults on judgments .30, words in the text .15."""
    parts = steps(cases, [(1, 30), (4, 60), (10, 85)], 0) * 0.30 + steps(executed, [(1, 50), (2, 80)], 0) * 0.25
    return _clamped(parts + steps(dishonest, [(1, 100)], 0) * 0.30 + F.least(hits * 5.0, F.lit(40.0)) * 0.15)


def financial_risk(revenue: Column, debt: Column, current: Column, cash: Column) -> Column:
    """Debt ratio .40, current ratio .30, cash flow against revenue .30; what is missing counts as medium or worse."""
    owed = F.when(debt <= 0, 50.0).otherwise(steps(debt, [(0.4, 20), (0.6, 50), (0.8, 85)], 5))
    liquid = F.when(current <= 0, 60.0).when(current < 1, 80.0).when(current < 1.5, 40.0).when(current < 2, 20.0).otherwise(5.0)
    flow = F.when(cash < 0, 80.0).when(cash == 0, 60.0).when((revenue > 0) & (cash < revenue * 0.05), 30.0).otherwise(5.0)
    return _clamped(owed * 0.40 + liquid * 0.30 + flow * 0.30)


def esg_risk(penalties: Column, insured: Column, tax: Column, hits: Column) -> Column:
    """Environmental penalties .30, social insurance .30, tax violations .30, words .10."""
    insurance = F.when(insured == "no", 70.0).when(insured == "yes", 0.0).otherwise(30.0)
    return _clamped(steps(penalties, [(1, 50), (2, 80)], 0) * 0.30 + insurance * 0.30 + steps(tax, [(1, 60), (2, 85)], 0) * 0.30 + F.least(hits * 5.0, F.lit(30.0)) * 0.10)


def sentiment_risk(news: Column, bad: Column, good: Column) -> Column:
    """Bad news .50, the share of bad words .50."""
    mood = F.when(bad + good == 0, F.when(news > 0, 30.0).otherwise(10.0)).otherwise(F.coalesce(F.try_divide(bad * 100.0, bad + good), F.lit(0.0)))
    return _clamped(steps(news, [(1, 30), (4, 60), (10, 85)], 0) * 0.50 + mood * 0.50)


def filtered(df: DataFrame, equal: dict) -> DataFrame:
    """Rows whose columns equal the given values; a value of None asks nothing."""
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def overlay(alerts: DataFrame, customer: str, amount: str, limit: float = 50_000) -> DataFrame:
    """Alerts (pattern, level) with need_review, cross_border and organized, and the level that follows."""
    both = alerts.groupBy(customer).agg((F.bool_or(F.col("pattern") == "smurfing") & F.bool_or(F.col("pattern") == "round_trip")).alias("organized"))
    risky = F.col("pattern") == "high_risk_region"
    return alerts.join(both, customer).withColumns({"need_review": F.col(amount) > limit, "cross_border": risky, "level": F.when(risky, "critical").otherwise(F.col("level"))})


# Standard rates of tax.
TAX_RATES = [0.0, 0.01, 0.03, 0.06, 0.09, 0.13]


def invoice_issues(df: DataFrame, audit_date: Column, tolerance: float = 0.02) -> DataFrame:
    """Invoices (no, rate, excl, tax, incl, l_shipdate as their date, seller) with ``issues``, ``risk`` and ``status``: abnormal where an
    issue is an error, else warning, else passed."""
    c = F.col
    net, due = c("excl") + c("tax"), c("excl") * c("rate")
    known = [
        ("no_empty", 0.3, True, F.coalesce(c("no"), F.lit("")) == ""), ("no_format", 0.2, True, (c("no") != "") & ~c("no").rlike("^[0-9]{8,20}$")), ("rate", 0.15, False, (c("rate") > 0) & ~c("rate").isin(*TAX_RATES)),
        ("total", 0.35, True, (net > 0) & (F.try_divide(F.abs(c("incl") - net), net) > tolerance)), ("tax", 0.2, False, (due > 0) & (c("tax") > 0) & (F.try_divide(F.abs(c("tax") - due), due) > tolerance)),
        ("date", 0.25, True, c("l_shipdate") > audit_date), ("party", 0.15, False, F.coalesce(c("seller"), F.lit("")) == ""), ("amount", 0.3, True, c("incl") <= 0),
    ]
    out = apply_rules(df, [(n, w, F.coalesce(t, F.lit(False))) for n, w, _, t in known], "issues", "risk", 1.0)
    severe = F.arrays_overlap("issues", F.array(*[F.lit(n) for n, _, error, _ in known if error]))
    return out.withColumn("status", F.when(severe, "abnormal").when(F.size("issues") > 0, "warning").otherwise("passed"))
