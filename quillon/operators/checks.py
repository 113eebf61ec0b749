"""Checks on configurations, paths, identities and histories, and the smaller optimisers."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.rules import compare

_NAME = re.compile(r"[A-Za-z_]\w*")
_SAFE = re.compile(r"^[\w\s.+\-*/()]+$")


def path_rule(json: Column, path: str, op: str, value=None) -> Column:
    """A rule on a dotted path of a JSON text; ``missing`` and ``present`` ask for the path itself. Another type: false."""
    at = F.get_json_object(json, "$." + path)
    if op in ("missing", "present"):
        return at.isNull() if op == "missing" else at.isNotNull()
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return compare(at.try_cast("double"), op, value)
    return compare(at, op, value)


def config_rule(config: Column, key: str, op: str, value, negate: bool = False) -> Column:
    """A rule on one key of a map of settings: ``contains`` or a comparison. A missing key: false before negation."""
    have = F.try_element_at(config, F.lit(key))
    hit = F.coalesce(have.contains(value), F.lit(False)) if op == "contains" else compare(have if isinstance(value, str) else have.try_cast("double"), op, value)
    return ~hit if negate else hit


def identity(text: str, columns: list[str], tolerance: float = 0.01) -> Column:
    """Whether "a == b + c" (or <, <=, >, >=) holds within a tolerance. Arithmetic over the named columns only; null: violated."""
    m = re.fullmatch(r"(.+?)(==|<=|>=|<|>)(.+)", text)
    if not m or any(not _SAFE.match(side) for side in (m[1], m[3])):
        raise ValueError(f"not a rule: {text}")
    if unknown := {n for n in _NAME.findall(text) if n not in columns}:
        raise ValueError(f"no such accounts: {sorted(unknown)}")
    a, b = F.expr(m[1]), F.expr(m[3])
    test = F.abs(a - b) < tolerance if m[2] == "==" else compare(a, m[2], b)
    return F.coalesce(test, F.lit(False))


def history_mean(history: Column, n: int = 10) -> Column:
    """Mean of the last ``n`` entries of an array; null if it is empty."""
    last = F.slice(history, F.greatest(F.size(history) - n + 1, F.lit(1)), n)
    return F.try_divide(F.aggregate(last, F.lit(0.0), lambda s, x: s + x.cast("double")), F.size(last))


def converted(df: DataFrame, value: str, unit: str, units: DataFrame) -> DataFrame:
    """``base``: the value in its base unit by a small table (unit, factor); unknown units give null."""
    return df.join(F.broadcast(units.select(F.col("unit").alias(unit), "factor")), unit, "left").withColumn("base", F.col(value) * F.col("factor")).drop("factor")


def hash_place(word: Column, dim: int) -> Column:
    """The md5 of a word, read as one number of 128 bits, modulo ``dim`` (below 2**31): 32 bits after 32 bits."""
    digest = F.md5(word.cast("binary"))
    place = F.lit(0).cast("long")
    for k in range(4):
        place = F.pmod(place * (1 << 32) % dim + F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long"), F.lit(dim).cast("long"))
    return place.cast("int")


def hash_vector(words: Column, dim: int = 64) -> Column:
    """Counts of words by the md5 of each, brought to length one; all zero without words."""
    place = F.transform(words, lambda w: hash_place(w, dim))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(place, lambda p: p == i)).cast("double"))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(counts, lambda x: F.coalesce(F.try_divide(x, norm), F.lit(0.0)))


def filled(template: str, columns: list[str], missing: str = "[missing]") -> tuple[Column, Column]:
    """A text with ${name} filled from columns, and the share of names that had a value."""
    names = re.findall(r"\$\{(\w+)\}", template)
    out = F.lit(template)
    for n in dict.fromkeys(names):
        out = F.replace(out, F.lit("${" + n + "}"), F.coalesce(F.col(n).cast("string"), F.lit(missing)) if n in columns else F.lit(missing))
    have = sum((F.col(n).isNotNull().cast("int") for n in names if n in columns), F.lit(0))
    return out, have / max(len(names), 1)


def column_kinds(rows: DataFrame, field: str, value: str, words: dict[str, str]) -> DataFrame:
    """(field, kind, level, confidence): of each column the kind of personal data that its values (.6) and its name (.4) speak
    for most, ``words`` saying what a name holds; ties by kind."""
    from quillon.functions.texts import PERSONAL

    shares = rows.groupBy(field).agg(*[F.avg(F.col(value).rlike(PERSONAL[k][0]).cast("int")).alias(k) for k in words])
    options = [F.struct((0.6 * F.col(k) + F.when(F.col(field).contains(w), 0.4).otherwise(0.0)).alias("confidence"), F.lit(k).alias("kind"), F.lit(PERSONAL[k][1]).alias("level")) for k, w in words.items()]
    best = F.array_sort(F.array(*options), lambda a, b: F.when(a["confidence"] > b["confidence"], -1).when(a["confidence"] < b["confidence"], 1).when(a["kind"] < b["kind"], -1).otherwise(1))[0]
    return shares.select(field, best.alias("x")).select(field, "x.kind", "x.level", "x.confidence").where("confidence > 0")


def table_lineage(sql: Column) -> tuple[Column, Column]:
    """Tables that a statement reads and writes."""
    low = F.regexp_replace(F.lower(sql), "\\s+", " ")
    reads = F.regexp_extract_all(low, F.lit("\\b(?:from|join) ([a-z_][\\w.]*)"), F.lit(1))
    writes = F.regexp_extract_all(low, F.lit("\\b(?:insert into|insert overwrite|update|create table(?: if not exists)?) ([a-z_][\\w.]*)"), F.lit(1))
    return F.array_sort(F.array_distinct(reads)), F.array_sort(F.array_distinct(writes))


def code_findings(df: DataFrame, id_: str, source: str, rules: list[tuple[str, str]]) -> DataFrame:
    """(id, line, rule) of every line of a source text that a rule's pattern matches."""
    lines = df.select(id_, F.posexplode(F.split(source, "\n")).alias("_at", "_line"))
    hits = F.array_compact(F.array(*[F.when(F.col("_line").rlike(p), F.lit(n)) for n, p in rules]))
    return lines.select(id_, (F.col("_at") + 1).alias("line"), F.explode(hits).alias("rule"))


def script_shares(text: Column) -> dict[str, Column]:
    """Share of the letters in each script."""
    letters = F.regexp_count(text, F.lit("\\p{L}"))
    return {k: F.coalesce(F.try_divide(F.regexp_count(text, F.lit(p)), letters), F.lit(0.0)) for k, p in (("latin", "\\p{IsLatin}"), ("han", "\\p{IsHan}"), ("kana", "[\\u3040-\\u30ff]"), ("cyrillic", "\\p{IsCyrillic}"))}


def merkle_proof(hashes: Column, index: Column, levels: int) -> Column:
    """Array of (hash, left) that leads from a leaf (0-based) to the root; the leaf's own place, not the first."""
    start = F.struct(hashes.alias("a"), index.cast("int").alias("i"), F.array().cast("array<struct<hash:string,left:boolean>>").alias("p"))

    def up(s, _):
        other = F.when(s["i"] % 2 == 1, s["i"] - 1).otherwise(F.least(s["i"] + 1, F.size(s["a"]) - 1))
        step = F.struct(F.get(s["a"], other).alias("hash"), (s["i"] % 2 == 1).alias("left"))
        pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(s["a"]) - 1, F.lit(0)), F.lit(2)), lambda k: F.sha2(F.concat(F.get(s["a"], k), F.coalesce(F.get(s["a"], k + 1), F.get(s["a"], k))), 256))
        more = F.size(s["a"]) > 1
        return F.struct(F.when(more, pairs).otherwise(s["a"]).alias("a"), F.when(more, F.floor(s["i"] / 2).cast("int")).otherwise(s["i"]).alias("i"), F.when(more, F.array_append(s["p"], step)).otherwise(s["p"]).alias("p"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(levels)), start, up, lambda s: s["p"])


def assignment(cost: np.ndarray, seed: int = 42, population: int = 40, rounds: int = 60) -> tuple[list[int], float]:
    """For each column the row that takes it, by a seeded elitist search with tournaments and swaps over one small matrix."""
    rng = np.random.Generator(np.random.PCG64(seed))
    n_rows, n = cost.shape
    total = lambda who: float(cost[who, np.arange(n)].sum() + 0.1 * np.bincount(who, minlength=n_rows).max())
    people = [rng.integers(0, n_rows, n) for _ in range(population - 1)] + [cost.argmin(0)]
    best = min(people, key=total)
    for _ in range(rounds):
        young = [best]
        while len(young) < population:
            a, b = (min((people[i] for i in rng.integers(0, population, 3)), key=total) for _ in range(2))
            child = np.where(rng.random(n) < 0.5, a, b)
            flip = rng.random(n) < 0.05
            child[flip] = rng.integers(0, n_rows, int(flip.sum()))
            young.append(child)
        people = young
        best = min(people, key=total)
    return best.tolist(), total(best)


def register_encoder(spark, modality: str, encoder) -> str:
    """A pandas UDF under the name quillon_encode_<modality>, for SQL and expressions."""
    name = f"quillon_encode_{modality}"
    spark.udf.register(name, encoder)
    return name


def engine(before, infer, after):
    """One function over a DataFrame from three, for DataFrame.transform."""
    return lambda df: df.transform(before).transform(infer).transform(after)
