"""Landed feed responses and their flattened records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline import fixed
from seamline.functions.nested import feed_hash
from seamline.functions.text import lit_array

ENVELOPE = (
    "source string, dataset string, indicator string, series_id string, commodity_code string, "
    "country string, year bigint, data string, extracted_at timestamp_ntz"
)
TRUST_RANK = 1

POINTS = "array<struct<country:string,product:string,year:bigint,value:double,unit:string>>"
SERIES_POINTS = "array<struct<period:string,seriesId:string,value:double,units:string>>"
BANK_POINTS = (
    "array<struct<indicator:struct<id:string,value:string>,country:struct<id:string,value:string>,"
    "countryiso3code:string,date:string,value:double,unit:string>>"
)
TRADE_POINTS = (
    "array<struct<period:string,reporterCode:string,reporterDesc:string,partnerCode:string,partnerDesc:string,"
    "cmdCode:string,cmdDesc:string,flowCode:string,flowDesc:string,tradeValue:bigint,netWeight:bigint>>"
)


def land(responses: DataFrame, path: str) -> None:
    """Write responses as JSON lines, one folder per source."""
    responses.write.mode("overwrite").partitionBy("source").json(path)


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    """Landed responses with provenance; unreadable lines go to ``_corrupt_record``."""
    raw = (
        spark.read.schema(ENVELOPE + ", _corrupt_record string")
        .option("mode", "PERMISSIVE")
        .json(path)
    )
    return with_provenance(raw)


def with_provenance(raw: DataFrame) -> DataFrame:
    return raw.withColumns({"provenance_hash": feed_hash(F.col("data")), "trust_rank": F.lit(TRUST_RANK)})


def records(responses: DataFrame, source: str) -> DataFrame:
    """Records of one source; a response without the expected path gives one error row."""
    data = F.col("data")
    if source == "IEA":
        items = F.from_json(data, f"struct<data:{POINTS}>")["data"]
        missing = "No data in response"
    elif source == "EIA":
        items = F.from_json(data, f"struct<response:struct<data:{SERIES_POINTS}>>")["response"]["data"]
        missing = "No data in response"
    elif source == "WorldBank":
        # [metadata, rows]: the two elements differ in type, so the second is cut out first.
        items = F.from_json(F.get_json_object(data, "$[1]"), BANK_POINTS)
        missing = "Invalid data format"
    elif source == "UNComtrade":
        items = F.from_json(data, f"struct<data:{TRADE_POINTS}>")["data"]
        missing = "No data in response"
    else:
        raise ValueError(f"unknown source {source}")
    rows = responses.where(F.col("source") == source).select("source", items.alias("_items"))
    flat = rows.select("source", F.explode_outer("_items").alias("r"), F.when(F.col("_items").isNull(), missing).alias("error"))
    return flat.where(F.col("r").isNotNull() | F.col("error").isNotNull())  # an empty list has no rows


def _uniform(key: Column, period: Column, value: Column, unit: Column) -> list[Column]:
    return [key.alias("key"), period.cast("string").alias("period"), value.cast("double").alias("value"), unit.alias("unit")]


def uniform_records(responses: DataFrame, source: str) -> DataFrame:
    """(source, key, period, value, unit, error) of any array-shaped feed."""
    shapes = {
        "IEA": ("r.country", "r.year", "r.value", "r.unit"),
        "EIA": ("r.seriesId", "r.period", "r.value", "r.units"),
        "WorldBank": ("r.country.id", "r.date", "r.value", "r.unit"),
        "UNComtrade": ("r.reporterCode", "r.period", "r.tradeValue", "r.flowCode"),
    }
    return records(responses, source).select("source", *_uniform(*[F.col(c) for c in shapes[source]]), "error")


def indicator_points(responses: DataFrame) -> DataFrame:
    """indicator → country → points, flattened."""
    parsed = F.from_json("data", "struct<values:map<string,map<string,array<struct<year:bigint,value:double>>>>>")
    return (
        responses.where("source = 'IMF'")
        .select("source", F.explode(parsed["values"]).alias("indicator", "by_country"))
        .select("source", "indicator", F.explode("by_country").alias("country", "points"))
        .select("source", "indicator", "country", F.inline("points"))
    )


RECORD = "array<struct<key:string,period:string,value:double,unit:string>>"
INDICATORS = "map<string,map<string,array<struct<year:bigint,value:double>>>>"
#: Of each array-shaped feed: where its records lie, their type, and what is wrong when they aren't there.
ROUTES = {
    "IEA": ("$.data", POINTS, "No data in response"), "EIA": ("$.response.data", SERIES_POINTS, "No data in response"),
    "WorldBank": ("$[1]", BANK_POINTS, "Invalid data format"), "UNComtrade": ("$.data", TRADE_POINTS, "No data in response"),
}


def _record(key: Column, period: Column, value: Column, unit: Column) -> Column:
    return F.struct(*_uniform(key, period, value, unit))


RECORDS: dict[str, Callable[[Column], Column]] = {
    "IEA": lambda item: _record(item["country"], item["year"], item["value"], item["unit"]),
    "EIA": lambda item: _record(item["seriesId"], item["period"], item["value"], item["units"]),
    "WorldBank": lambda item: _record(item["country"]["id"], item["date"], item["value"], item["unit"]),
    "UNComtrade": lambda item: _record(item["reporterCode"], item["period"], item["tradeValue"], item["flowCode"]),
}


def parsed(responses: DataFrame) -> DataFrame:
    """Each response parsed once, as a variant; null where its text isn't JSON."""
    return responses.withColumn("_v", F.try_parse_json("data"))


def routed(responses: DataFrame) -> DataFrame:
    """(source, key, period, value, unit, error) of all feeds, in one pass over the responses.

    Every response is parsed once; its source says which records are taken out of it.
    A response without them gives one error row, an empty list none.
    """
    by_indicator = F.flatten(F.transform(
        F.map_entries(F.try_variant_get("_v", "$.values", INDICATORS)),
        lambda i: F.flatten(F.transform(F.map_entries(i["value"]), lambda c: F.transform(c["value"], lambda p: _record(c["key"], p["year"], p["value"], i["key"])))),
    ))
    items, missing = F.when(F.col("source") == "IMF", by_indicator.cast(RECORD)), F.when(F.lit(False), "")
    for source, (path, kind, error) in ROUTES.items():
        found = F.transform(F.try_variant_get("_v", path, kind), RECORDS[source])
        items, missing = items.when(F.col("source") == source, found.cast(RECORD)), missing.when(F.col("source") == source, error)
    rows = parsed(responses).select("source", items.alias("_items"), missing.alias("_missing"))
    flat = rows.select("source", F.explode_outer("_items").alias("r"), F.when(F.col("_items").isNull(), F.col("_missing")).alias("error"))
    return flat.where(F.col("r").isNotNull() | F.col("error").isNotNull()).select("source", "r.*", "error")


def quarantined(responses: DataFrame) -> DataFrame:
    """Responses whose text isn't JSON, as they came, with the reason."""
    bad = parsed(responses).where(F.col("_v").isNull()).drop("_v")
    return bad.withColumn("reason", F.when(F.col("data").isNull(), "no text").otherwise("not JSON"))


def merged_records(responses: DataFrame) -> DataFrame:
    """Records of all sources; a source that fails contributes only its error rows."""
    return routed(responses)


def request_plan(countries: DataFrame, years: DataFrame) -> DataFrame:
    """Every request of a run: item lists are literals, the rest comes from tables."""
    def grid(df: DataFrame, source: str, items: list[str], country: Column, year: Column) -> DataFrame:
        return df.select(
            F.lit(source).alias("source"), F.explode(lit_array(items)).alias("item"),
            country.cast("string").alias("country"), year.cast("bigint").alias("year"),
        )

    none = F.lit(None)
    return (
        grid(countries, "IEA", fixed.IEA_DATASETS, F.col("country"), none)
        .unionByName(grid(countries, "WorldBank", fixed.WORLD_BANK_INDICATORS, F.col("country"), none))
        .unionByName(grid(countries, "IMF", fixed.IMF_INDICATORS, F.col("country"), none))
        .unionByName(grid(years, "UNComtrade", fixed.TRADE_CODES, none, F.col("year")))
    )
