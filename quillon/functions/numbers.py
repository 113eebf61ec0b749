"""Numeric, checksum and finance expressions; all are column expressions that stay inside codegen or higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Check digit weights and characters of the 18-character identity and credit codes.
ID18_WEIGHTS = [7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2]
ID18_CHECKS = "10X98765432"
CREDIT_CODE_CHARS = "0123456789ABCDEFGHJKLMNPQRTUWXY"
CREDIT_CODE_WEIGHTS = [1, 3, 9, 27, 19, 26, 16, 17, 20, 29, 25, 13, 8, 24, 10, 30, 28]


def parse_amount(text: Column, none=0.0) -> Column:
    """A number out of text with currency marks, thousands commas and the units 万 and 亿; ``none`` where there is none."""
    bare = F.regexp_replace(F.trim(text), "[¥$€£,\\s]", "")
    unit = F.when(bare.endswith("万"), 1e4).when(bare.endswith("亿"), 1e8).otherwise(1.0)
    return F.coalesce(F.regexp_replace(bare, "[万亿]$", "").try_cast("double") * unit, F.lit(none).cast("double"))


def luhn(text: Column) -> Column:
    """Whether 13 to 19 digits, with blanks or dashes between, satisfy Luhn's check."""
    bare = F.regexp_replace(text, "[ -]", "")
    return F.when(bare.rlike("^[0-9]{13,19}$"), F.call_function("luhn_check", bare)).otherwise(False)


def _weighted(text: Column, weights: list[int], value) -> Column:
    return sum((value(F.substring(text, i + 1, 1)) * w for i, w in enumerate(weights[1:], 1)), value(F.substring(text, 1, 1)) * weights[0])


def id18(text: Column) -> Column:
    """Whether an 18-character identity code has the right last character."""
    up = F.upper(text)
    total = _weighted(up, ID18_WEIGHTS, lambda c: c.try_cast("int"))
    return F.when(up.rlike("^[0-9]{17}[0-9X]$"), F.substring(F.lit(ID18_CHECKS), total % 11 + 1, F.lit(1)) == F.substring(up, 18, 1)).otherwise(False)


def credit_code(text: Column) -> Column:
    """Whether an 18-character credit code has the right last character, modulo 31."""
    up = F.upper(F.regexp_replace(text, "\\s", ""))
    total = _weighted(up, CREDIT_CODE_WEIGHTS, lambda c: F.call_function("locate", c, F.lit(CREDIT_CODE_CHARS)) - 1)
    check = F.substring(F.lit(CREDIT_CODE_CHARS), (31 - total % 31) % 31 + 1, F.lit(1))
    return F.when(up.rlike(f"^[{CREDIT_CODE_CHARS}]{{18}}$"), check == F.substring(up, 18, 1)).otherwise(False)


def sigmoid(z: Column) -> Column:
    return F.when(z >= 500, 1.0).when(z <= -500, 0.0).otherwise(1 / (1 + F.exp(-z)))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0 * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def npv(initial: Column, yearly: Column, years: int, rate: float) -> Column:
    return sum((yearly / (1 + rate) ** y for y in range(1, years + 1)), -initial)


def irr(initial: Column, flows: Column, low: float = -0.9, high: float = 10.0, steps: int = 200) -> Column:
    """The rate at which the array ``flows`` pays back ``initial``, by bisection."""

    def worth(rate):
        return F.aggregate(F.transform(flows, lambda x, i: x / F.pow(1 + rate, i + 1)), -initial, lambda s, x: s + x)

    start = F.struct(F.lit(low).alias("a"), F.lit(high).alias("b"))

    def halve(s, _):
        m = (s["a"] + s["b"]) / 2
        up = worth(m) > 0
        return F.struct(F.when(up, m).otherwise(s["a"]).alias("a"), F.when(up, s["b"]).otherwise(m).alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: (s["a"] + s["b"]) / 2)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers; 0 where either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def first_digit(amount: Column) -> Column:
    """First digit of the whole part; 0 for amounts under 1."""
    return F.substring(F.floor(F.abs(amount)).cast("string"), 1, 1).cast("int")


def percentile_linear(value: Column, p: float) -> Column:
    """Linear interpolation at (n - 1) p; an aggregate."""
    return F.percentile(value, p)


def percentile_index(value: Column, p: float) -> Column:
    """The value at index int(n p) of the sorted values; an aggregate for small groups."""
    all_ = F.sort_array(F.collect_list(value))
    return F.element_at(all_, F.least(F.floor(F.count(value) * p).cast("int") + 1, F.size(all_)))


def quartile_index(value: Column, k: int) -> Column:
    """The value at index k n div 4 of the sorted values; an aggregate for small groups."""
    return F.element_at(F.sort_array(F.collect_list(value)), F.floor(F.count(value) * k / 4).cast("int") + 1)


# Texts that stand for no amount.
NO_AMOUNT = ["", "-", "--", "n/a", "na", "null", "none", "无"]


def amount_or_null(text: Column) -> Column:
    """An amount; null for the usual ways to write that there is none."""
    return F.when(~F.lower(F.trim(text)).isin(*NO_AMOUNT), parse_amount(text, None))


def default_probability(z: Column, payments: Column) -> Column:
    """Logistic default probability, up to .3 higher for a short payment history of 24 months, between .001 and .99."""
    gap = F.greatest(F.lit(0.0), 1 - payments / 24.0)
    return F.least(F.lit(0.99), F.greatest(F.lit(0.001), sigmoid(z) * (1 + gap * 0.3)))


def vegetation(red: Column, nir: Column, blue: Column, green: Column, swir: Column, swir2: Column) -> dict[str, Column]:
    """The usual indices of satellite bands; 0 where a denominator is."""
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    ndvi = ratio(nir - red, nir + red)
    return {
        "ndvi": ndvi, "evi": ratio(2.5 * (nir - red), nir + 6 * red - 7.5 * blue + 1), "ndwi": ratio(green - nir, green + nir),
        "ndmi": ratio(nir - swir, nir + swir), "nbr": ratio(nir - swir2, nir + swir2), "nirv": ndvi * nir,
    }


def land_use(ndvi: Column, ndwi: Column, nbr: Column, ndmi: Column) -> Column:
    """The class of land by its indices, the first that fits."""
    return F.when(ndwi > 0.15, "water").when((nbr < 0.05) & (ndvi < 0.3), "burnt").when(ndvi < 0.15, "bare").when(ndvi < 0.35, "fields").when(ndmi < 0.05, "shrubs").when(ndvi < 0.65, "mixed forest").otherwise("dense forest")


def laplace(u: Column, scale: float) -> Column:
    """Laplace noise from uniform numbers between 0 and 1."""
    c = u - 0.5
    return -scale * F.signum(c) * F.log(1 - 2 * F.abs(c))


def rounded(value: Column, places: int) -> Column:
    """A double rounded as SQL engines do over binary numbers: the product with 10 ** places to the nearest whole number, halves away
    from 0. Spark's own ``round`` takes the shortest decimals instead, which differs where a fifth digit is a 5 in one of the two."""
    return F.round(value * F.lit(float(10**places)), 0) / F.lit(float(10**places))
