"""Simulations and small searches: draws as rows, one matrix a unit."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.checks import assignment


def uniform(seed: int, draw: str = "id") -> Column:
    """A number in [0, 1) of each draw, by a hash of its number: the same whatever the cluster and its partitions."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(draw)), 11) / float(1 << 53)


def normal(seed: int, draw: str = "id") -> Column:
    """A standard normal number of each draw, from two uniform ones."""
    return F.sqrt(-2 * F.log(1 - uniform(2 * seed, draw))) * F.cos(2 * F.lit(np.pi) * uniform(2 * seed + 1, draw))


def returns(spark: SparkSession, base: DataFrame, draws: int, seed: int, years: int = 5, rate: float = 0.08) -> DataFrame:
    """One row: mean, tenth, half and nine tenths of the present value over ``draws`` seeded draws of (cost, saving), and the share of
    draws that lose. Draws are rows, so they spread over tasks; what is put in order is ``draws`` numbers."""
    runs = spark.range(draws).select(normal(seed).alias("g"), uniform(-seed).alias("u"), normal(seed + 1).alias("e"))
    yearly = F.col("saving") * (1 + 0.2 * F.col("g")) * (0.7 + 0.6 * F.col("u"))
    worth = sum((yearly / (1 + rate) ** y for y in range(1, years + 1)), -F.col("cost") * (1 + 0.1 * F.col("e")))
    got = runs.crossJoin(F.broadcast(base)).select(worth.alias("npv")).agg(F.count("*").alias("draws"), F.avg("npv").alias("mean"), F.percentile("npv", F.array(*map(F.lit, (0.1, 0.5, 0.9)))).alias("p"), F.avg(F.when(F.col("npv") < 0, 1.0).otherwise(0.0)).alias("losing"))
    return got.select("draws", "mean", F.col("p")[0].alias("p10"), F.col("p")[1].alias("p50"), F.col("p")[2].alias("p90"), "losing")


def cost_of(need: np.ndarray, skill: np.ndarray) -> np.ndarray:
    """Rows are auditors, columns projects: how far a skill is from a need, on a ring of seven."""
    gap = np.abs(skill[:, None] - need[None, :]) % 7
    return np.minimum(gap, 7 - gap).astype(float)


def greedily(cost: np.ndarray) -> list[int]:
    """Project after project the auditor with the best fit less half the load so far; ties to the first."""
    load, out = np.zeros(len(cost)), []
    for j in range(cost.shape[1]):
        best = int(np.argmin(cost[:, j] + 0.5 * load))
        load[best] += 1
        out.append(best)
    return out


def assigned(projects: DataFrame, auditors: DataFrame, greedy: bool) -> DataFrame:
    """(unit, project, auditor): projects (unit, project, need) given to auditors (unit, auditor, skill) of their unit.

    A unit's projects are worked on in one task, as each choice bears on the next; units are what spreads.
    """

    def solve(key, jobs: pd.DataFrame, staff: pd.DataFrame) -> pd.DataFrame:
        if jobs.empty or staff.empty:
            return pd.DataFrame({"unit": jobs["unit"], "project": jobs["project"], "auditor": pd.Series([None] * len(jobs), dtype="Int64")})
        jobs, staff = jobs.sort_values("project"), staff.sort_values("auditor")
        cost = cost_of(jobs["need"].to_numpy(), staff["skill"].to_numpy())
        who = greedily(cost) if greedy else assignment(cost)[0]
        return pd.DataFrame({"unit": jobs["unit"], "project": jobs["project"], "auditor": pd.Series(staff["auditor"].to_numpy()[who], index=jobs.index, dtype="Int64")})

    return projects.groupBy("unit").cogroup(auditors.groupBy("unit")).applyInPandas(solve, "unit int, project long, auditor long")
