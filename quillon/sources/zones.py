"""Landing, parsing and standardising of raw records, with flags and lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.numbers import amount_or_null
from quillon.functions.times import norm_period

# Names under which sources write the standard fields.
SYNONYMS = {"company_code": ["company_code", "company", "entity"], "account_code": ["account_code", "account", "subject_code"], "account_name": ["account_name", "subject"], "period": ["period", "month"], "amount": ["amount", "value", "amt"], "currency": ["currency", "ccy"]}


def landed(df: DataFrame, raw: str, source: str, batch: str) -> DataFrame:
    """Raw JSON records as they came, with batch, source, the names of their fields, and what medium they speak of: as stated, by its
    MIME type, or by its address."""
    at = lambda *names: F.coalesce(*[F.get_json_object(raw, f"$.{n}") for n in names])
    uri, mime = at("media_uri", "image_ref", "video_ref"), at("media_mime")
    by_mime = F.when(mime.startswith("image"), "image").when(mime.startswith("video"), "video").when(mime.startswith("audio"), "audio")
    by_uri = F.when(F.lower(uri).contains("image"), "image").when(F.lower(uri).contains("video"), "video")
    kind = F.coalesce(at("media_modality"), F.when(uri.isNotNull(), F.when(mime.isNotNull(), by_mime).otherwise(by_uri)))
    return df.withColumns({"batch_id": F.lit(batch), "source": F.coalesce(F.col(source), F.lit("unknown")), "raw_schema": F.array_sort(F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>"))), "media_uri": uri, "media_modality": kind})


def standardised(df: DataFrame, raw: str, master: DataFrame) -> DataFrame:
    """Landed records in the standard fields: the first synonym that a record has, defaults, names looked up in ``master`` (code, name;
    a chart of accounts), and the flags of what was missing or changed."""
    at = lambda field: F.coalesce(*[F.get_json_object(raw, f"$.{n}") for n in SYNONYMS[field]])
    none = lambda c: F.nullif(F.trim(c), F.lit(""))
    rows = df.withColumns({f"_{f}": none(at(f)) for f in SYNONYMS})
    rows = rows.join(F.broadcast(master.select(F.col("code").alias("_account_code"), F.col("name").alias("_found"))), "_account_code", "left")
    amount, period = amount_or_null(F.col("_amount")), norm_period(F.col("_period"))
    written = F.get_json_object(raw, "$").rlike('"(?:amount|value|amt)"\\s*:\\s*"')
    name = F.coalesce("_account_name", "_found")
    flags = [
        ("null_company_code", F.col("_company_code").isNull()), ("null_account_code", F.col("_account_code").isNull()), ("account_not_in_master", F.col("_account_code").isNotNull() & name.isNull()),
        ("null_period", period.isNull()), ("null_amount_defaulted", amount.isNull()), ("amount_type_converted", amount.isNotNull() & written),
    ]
    out = rows.withColumns({"company_code": F.coalesce("_company_code", F.lit("UNKNOWN")), "account_code": F.col("_account_code"), "account_name": name, "period": period, "amount": F.coalesce(amount, F.lit(0.0)), "currency": F.coalesce("_currency", F.lit("CNY")), "flags": F.array_compact(F.array(*[F.when(test, F.lit(n)) for n, test in flags]))})
    return out.drop(*[f"_{f}" for f in SYNONYMS], "_found")


def parsed(df: DataFrame, kind: str, content: str) -> DataFrame:
    """(columns of df, values, error): the numbers that a content holds, by its kind: structured (the numbers of a JSON object),
    semi_structured (numbers with a unit, else the first five), text (numbers after words that ask for one, else as semi_structured),
    timeseries (the values of a JSON array), image_meta (ndvi or area_ha). What cannot be read has no values and an error."""
    c = F.col(content)
    numbers = lambda pattern, group=1: F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double"))
    object_ = F.from_json(c, "map<string,string>")
    structured = F.transform(F.array_sort(F.map_entries(object_)), lambda e: e["value"].try_cast("double"))
    with_unit = numbers("([0-9.]+)\\s*(?:tCO2e?|kg|MWh|GJ|m3|ha|%)")
    semi = F.when(F.size(with_unit) > 0, with_unit).otherwise(F.slice(numbers("([0-9.]+)"), 1, 5))
    asked = F.concat(numbers("([0-9.,]+)\\s*(?:tCO2|kg).{0,8}(?:emissions|CO2)"), numbers("(?:energy)[^0-9]{0,10}([0-9.,]+)\\s*(?:MJ|GJ|kWh)"), numbers("(?:share|rate)[^0-9]{0,10}([0-9.,]+)\\s*%"))
    text = F.when(F.size(asked) > 0, asked).otherwise(semi)
    series = F.transform(F.from_json(c, "array<string>"), lambda x: x.try_cast("double"))
    image = F.array_compact(F.array(F.coalesce(F.get_json_object(c, "$.ndvi"), F.get_json_object(c, "$.area_ha")).try_cast("double")))
    values = F.when(F.col(kind) == "structured", structured).when(F.col(kind) == "semi_structured", semi).when(F.col(kind) == "text", text).when(F.col(kind) == "timeseries", series).when(F.col(kind) == "image_meta", image)
    read = F.array_compact(F.coalesce(values, F.array().cast("array<double>")))
    return df.withColumn("values", read).withColumn("error", F.when(F.size("values") == 0, F.concat(F.lit("nothing to read as "), F.col(kind))))


def learnt(dictionary: DataFrame, confirmed: DataFrame, cleaned: Column) -> DataFrame:
    """A dictionary (raw, standard) with confirmed mappings (raw, standard, seq) added, by cleaned name; of several for one name the
    last confirmed wins, and any confirmed one over the dictionary."""
    new = confirmed.select(cleaned.alias("raw"), "standard", "seq").where("raw <> ''").groupBy("raw").agg(F.max_by("standard", F.struct("seq", "standard")).alias("standard"))
    return dictionary.select("raw", "standard").join(new.select("raw"), "raw", "left_anti").unionByName(new)
