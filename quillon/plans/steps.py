"""Plans: which analytics a requirement needs, in which order, and whether their schemas fit."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql.types import DataType, FloatType, DoubleType, IntegerType, LongType, StructType

_NUMBERS = (IntegerType, LongType, FloatType, DoubleType)


@dataclass
class Step:
    """One analytic: what it reads (names of steps or inputs), what it needs of them, and what it does."""

    name: str
    run: Callable[..., DataFrame]
    needs: list[str] = field(default_factory=list)
    keywords: list[str] = field(default_factory=list)
    expects: dict[str, StructType] = field(default_factory=dict)


def compatible(have: DataType, want: DataType) -> bool:
    """The same type, or both numbers."""
    return have == want or (isinstance(have, _NUMBERS) and isinstance(want, _NUMBERS))


def misfits(have: StructType, want: StructType) -> list[str]:
    """What of ``want`` the schema lacks, has in another type, or may leave null."""
    fields = {f.name: f for f in have}
    out = []
    for f in want:
        if f.name not in fields:
            out.append(f"{f.name} is missing")
        elif not compatible(fields[f.name].dataType, f.dataType):
            out.append(f"{f.name} is {fields[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}")
        elif fields[f.name].nullable and not f.nullable:
            out.append(f"{f.name} may be null")
    return out


class Plan:
    def __init__(self, steps: list[Step]) -> None:
        self.steps = {s.name: s for s in steps}

    def asked(self, text: str) -> list[str]:
        """Steps with a keyword in the text, most hits first."""
        low = text.lower()
        hits = {n: sum(k.lower() in low for k in s.keywords) for n, s in self.steps.items()}
        return sorted((n for n, h in hits.items() if h), key=lambda n: (-hits[n], n))

    def upstream(self, name: str) -> set[str]:
        """The step and everything it needs, directly or not."""
        seen, todo = set(), [name]
        while todo:
            at = todo.pop()
            if at in self.steps and at not in seen:
                seen.add(at)
                todo += self.steps[at].needs
        return seen

    def order(self, names: set[str] | None = None) -> list[str]:
        """Steps after what they need, ties by name. A ring is an error."""
        left = {n: {x for x in self.steps[n].needs if x in self.steps} for n in (names if names is not None else self.steps)}
        out: list[str] = []
        while left:
            free = sorted(n for n, needs in left.items() if not needs & left.keys())
            if not free:
                raise ValueError(f"these need each other: {sorted(left)}")
            out.append(free[0])
            del left[free[0]]
        return out

    def run(self, name: str, inputs: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """The lazy results of a step and all before it. Inputs win over steps of the same name; a misfit is an error."""
        got = dict(inputs)
        for at in self.order(self.upstream(name)):
            if at in inputs:
                continue
            step = self.steps[at]
            for need, want in step.expects.items():
                if bad := misfits(got[need].schema, want):
                    raise ValueError(f"{at} cannot read {need}: {'; '.join(bad)}")
            got[at] = step.run(**{n: got[n] for n in step.needs})
        return got


def findings(parts: dict[str, DataFrame]) -> DataFrame:
    """Outputs of several steps under each other, with the step's name in ``step``; columns that one lacks are null."""
    from pyspark.sql import functions as F

    frames = [df.withColumn("step", F.lit(name)) for name, df in parts.items()]
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
