"""Domain tables derived from the supplied Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamline import fixed
from seamline.functions import dates
from seamline.session import spread
from seamline.workloads.views import COMPONENTS, FORMULA_INPUTS, GRADES


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def gold_features(spark: SparkSession, sf: str, since=None, until=None) -> DataFrame:
    """One row per entity and day, reduced map-side before the only shuffle.

    ``since`` and ``until`` (first and last day, columns) bound the raw times, so
    that the scan skips what lies outside.
    """
    kind = lambda k: F.when(F.col("event_type") == k, F.col("value"))
    events = table(spark, sf, "events")
    ts_type = events.schema["ts"].dataType
    if since is not None:
        events = events.where(F.col("ts") >= since.cast(ts_type))
    if until is not None:
        events = events.where(F.col("ts") < (until + F.make_dt_interval(F.lit(1))).cast(ts_type))
    return (
        events
        .groupBy(F.col("user_id").alias("mine_id"), F.date_trunc("day", "ts").alias("feature_date"))
        .agg(
            F.count("*").alias("n_events"),
            F.round(F.sum("value"), 4).alias("production_mt"),
            F.round(F.max("value") * F.count("*"), 4).alias("capacity_mt"),
            (F.size(F.collect_set("event_type")) / F.lit(5.0)).alias("feature_freshness_score"),
            F.round(F.avg(kind("error")), 6).alias("esg_score"),
            F.round(F.coalesce(F.sum(kind("purchase")), F.lit(0.0)), 4).alias("revenue"),
            F.round(F.coalesce(F.sum(kind("click")), F.lit(0.0)), 4).alias("operating_cost"),
            F.round(F.coalesce(F.sum(kind("view")), F.lit(0.0)), 4).alias("carbon"),
            F.count_if(F.col("event_type") == "error").alias("incidents"),
            F.round(F.max("value"), 4).alias("reserves"),
        )
    )


def days_before_latest(spark: SparkSession, sf: str, days: int):
    """The day so many days before the newest one of the events.

    A scalar of the type of ``ts``: the scan takes its value as a filter at run time.
    """
    events = table(spark, sf, "events")
    day = F.date_trunc("day", F.max("ts")) - F.make_dt_interval(F.lit(days))
    return events.agg(day.cast(events.schema["ts"].dataType)).scalar()


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents"))


def nations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select("n_nationkey", "n_name")


def entity_country(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "customer")
        .join(nations(spark, sf), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(F.col("c_custkey").alias("mine_id"), F.col("n_name").alias("country_code"))
    )


def metric_definitions(spark: SparkSession, sf: str) -> DataFrame:
    sheets = [*fixed.SHEET_NUMBERS, "Data Sources", "Unlisted Sheet"]
    size = F.col("p_size")
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("definition_id"),
        F.get(F.array(*[F.lit(s) for s in sheets]), size % 12).alias("sheet_name"),
        F.concat_ws(" ", "p_name", "p_type").alias("title"),
        F.concat("p_name", F.lit("-"), "p_type", F.lit(" "), "p_brand").alias("raw_slug"),
        F.when(size % 3 == 0, "Complete").when(size % 3 == 1, "Draft").alias("readiness_status"),
        (F.col("p_partkey") % 10).alias("source_id"),
        *[F.expr(e).cast("bigint").alias(n) for n, e in GRADES.items()],
        F.col("p_retailprice").alias("weighting"),
    )


def metric_values(spark: SparkSession, sf: str, tasks: int | None = None) -> DataFrame:
    """Line items with what their order and its customer say; orders are joined first, being fewer.

    ``tasks`` is how many tasks share the line items and orders.
    """
    dealt = lambda df, key: df.repartition(tasks, key) if tasks else df
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice", "l_discount", "l_suppkey")
    orders = (
        table(spark, sf, "orders")
        .join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(nations(spark, sf), F.col("c_nationkey") == F.col("n_nationkey"))
        .select("o_orderkey", "c_mktsegment", "n_name", "o_orderdate")
    )
    return (
        dealt(lines, "l_orderkey")
        .join(dealt(orders, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            F.col("l_partkey").alias("definition_id"),
            F.col("c_mktsegment").alias("sub_industry"),
            F.col("n_name").alias("country"),
            F.year("o_orderdate").cast("bigint").alias("year"),
            F.quarter("o_orderdate").cast("bigint").alias("quarter"),
            F.col("l_extendedprice").alias("raw_value"),
            F.col("l_discount").alias("normalized_value"),
            F.col("l_suppkey").alias("source_id"),
        )
    )


def data_sources(spark: SparkSession, sf: str) -> DataFrame:
    nation = F.col("s_nationkey") % 4
    return (
        table(spark, sf, "supplier")
        .join(nations(spark, sf), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("s_suppkey").alias("source_id"),
            F.col("s_name").alias("name"),
            F.col("n_name").alias("country"),
            F.when(nation == 0, "yes").when(nation == 1, "1").when(nation == 2, "no").alias("api_available"),
            F.col("s_acctbal").alias("balance"),
        )
    )


def composite_scores(spark: SparkSession, sf: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return (
        table(spark, sf, "orders")
        .join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(nations(spark, sf), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("o_orderkey").alias("score_id"),
            F.col("c_mktsegment").alias("sub_industry"),
            F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.col("n_name")).alias("country"),
            F.when(status == "F", 5).when(status == "O", 10).otherwise(20).cast("bigint").alias("horizon"),
            F.year("o_orderdate").cast("bigint").alias("year"),
            F.least(F.lit(100.0), F.col("o_totalprice") / 5000).alias("score"),
            F.col("o_orderdate").alias("created_at"),
        )
    )


def entity_components(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_orderkey").alias("entity_id"))
        .agg(*[F.round(F.expr(e).cast("double"), 6).alias(n) for n, e in COMPONENTS.items()])
    )


def component_long(spark: SparkSession, sf: str) -> DataFrame:
    return entity_components(spark, sf).unpivot("entity_id", list(COMPONENTS), "metric", "value")


def _sites(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").join(nations(spark, sf), F.col("s_nationkey") == F.col("n_nationkey"))


def crawl_current(spark: SparkSession, sf: str) -> DataFrame:
    return _sites(spark, sf).where("s_nationkey <> 7").select(
        F.col("s_suppkey").alias("site_id"), F.col("s_name").alias("name"),
        F.col("n_name").alias("country"), F.col("s_acctbal").alias("capacity"),
    )


def crawl_previous(spark: SparkSession, sf: str) -> DataFrame:
    earlier = F.when(F.col("s_acctbal") < 1000, F.col("s_acctbal") + 1).otherwise(F.col("s_acctbal"))
    return _sites(spark, sf).where("s_acctbal < 9000").select(
        F.col("s_suppkey").alias("site_id"), F.col("s_name").alias("name"),
        F.col("n_name").alias("country"), earlier.alias("capacity"),
    )


def gappy(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id", "user_id", "ts", F.when(F.col("event_type") != "error", F.col("value")).alias("value")
    )


def formula_inputs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        *[F.expr(e).alias(n) for n, e in FORMULA_INPUTS.items()],
    )


def active_weights(spark: SparkSession) -> DataFrame:
    rows = [("necessity_score", 0.6), ("emissions_score", 0.9), ("economic_score", 0.3),
            ("ecological_score", 0.0), ("monopoly_control_score", 1.4)]
    return spark.createDataFrame(rows, "metric_slug string, weight_value double")


def messages(spark: SparkSession, sf: str) -> DataFrame:
    offset = F.make_dt_interval(F.lit(0), F.col("conv_id").cast("int"), F.lit(0), F.col("turn") * 30)
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", "role", "text",
        (F.length("text") % 500).cast("bigint").alias("response_ms"),
        (dates.stamp("2024-01-01") + offset).alias("created_at"),
    )


def _joined_text(head: str, items, tail: str):
    """Array of texts as one JSON fragment."""
    return F.concat(F.lit(head), F.array_join(items, ","), F.lit(tail))


def _item(template: str, *cols):
    return F.format_string(template, *cols)


def feed_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Raw feed responses in five shapes.

    Points are first reduced to (country, year, series); a response then holds
    at most one point per year or country.
    """
    points = (
        table(spark, sf, "orders")
        .join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(nations(spark, sf), F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy(F.col("n_name").alias("country"), F.year("o_orderdate").alias("y"), F.col("o_orderstatus").alias("series"))
        .agg(F.count("*").alias("n"), F.sum(F.floor("o_totalprice")).alias("amount"))
    )
    by_country = points.groupBy("country", "y").agg(F.sum("n").alias("n"), F.sum("amount").alias("amount"))
    by_series = points.groupBy("series", "y").agg(F.sum("n").alias("n"))

    def collect(df, key, *item):
        return df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*item))).alias("p"))

    def render(fn):
        return F.transform("p", fn)

    none = F.lit(None).cast("string")

    def envelope(df, source, data, dataset=none, indicator=none, series_id=none, commodity=none, country=none, year=F.lit(None)):
        return df.select(
            F.lit(source).alias("source"), dataset.alias("dataset"), indicator.alias("indicator"), series_id.alias("series_id"),
            commodity.alias("commodity_code"), country.alias("country"), year.cast("bigint").alias("year"), data.alias("data"),
        )

    country, series = F.col("country"), F.col("series")
    iea = render(lambda p: _item('{"country":"%s","product":"COAL","year":%d,"value":%d,"unit":"orders"}', country, p["y"], p["n"]))
    eia = render(lambda p: _item('{"period":"%d","seriesId":"%s","value":%d,"units":"orders"}', p["y"], series, p["n"]))
    bank = render(lambda p: _item(
        '{"indicator":{"id":"NY.GDP.MKTP.CD","value":"GDP"},"country":{"id":"%s","value":"%s"},'
        '"countryiso3code":"%s","date":"%d","value":%d,"unit":"USD"}', country, country, country, p["y"], p["amount"]))
    trade = render(lambda p: _item(
        '{"period":"%d","reporterCode":"%s","cmdCode":"2701","flowCode":"X","tradeValue":%d,"netWeight":%d}',
        F.col("y"), p["country"], p["amount"], p["n"]))
    imf = render(lambda p: _item('{"year":%d,"value":%d}', p["y"], p["n"]))
    per_country = collect(by_country, "country", "y", "n", "amount")
    frames = [
        envelope(
            per_country, "IEA", F.when(country == "NATION_3", '{"status":"error"}').otherwise(
                _joined_text('{"data":[', iea, '],"status":"success"}')), dataset=F.lit("COALPROD"), country=country),
        envelope(collect(by_series, "series", "y", "n"), "EIA", _joined_text('{"response":{"data":[', eia, "]}}"), series_id=series),
        envelope(
            per_country, "WorldBank", F.when(country == "NATION_5", "[null]").otherwise(_joined_text("[null,[", bank, "]]")),
            indicator=F.lit("NY.GDP.MKTP.CD"), country=country),
        envelope(
            collect(by_country, "y", "country", "amount", "n"), "UNComtrade", _joined_text('{"data":[', trade, "]}"),
            commodity=F.lit("2701"), year=F.col("y")),
        envelope(
            per_country, "IMF", F.concat(_item('{"values":{"ENDA":{"%s":[', country), F.array_join(imf, ","), F.lit("]}}}")),
            indicator=F.lit("ENDA"), country=country),
    ]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def reference_notes(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")

    def note(divisor, *parts):
        return F.when(size % divisor == 0, F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])).otherwise("")

    details = F.concat(
        F.lit("USGS table "), "p_name", note(2, " R/P Ratio"), note(3, ". Reskilling Cost about ", size, "00 USD"),
        note(5, ". learning rate is ", size, ".5% and HHI current ", size * 3),
        note(7, ". Patents FiveYearCAGR ", size, "%; Asset Life Remaining ", size, " years"),
    )
    return table(spark, sf, "part").select(F.col("p_partkey").alias("definition_id"), details.alias("details"))


def site_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Crawled responses, a hundred consecutive sites at most per page."""
    items = F.transform(
        F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))),
        lambda p: _item('{"name":"%s","site":%d}', p["s_name"], p["s_suppkey"]),
    )
    pages = _sites(spark, sf).groupBy(F.col("n_name").alias("country"), F.floor(F.col("s_suppkey") / 100).alias("page")).agg(items.alias("p"))
    country, joined = F.col("country"), F.array_join("p", ",")
    payload = (
        F.when(country.isin("NATION_2", "NATION_4"), F.concat(F.lit("["), joined, F.lit("]")))
        .when(country == "NATION_6", '{"other":1}')
        .otherwise(F.concat(F.lit('{"mines":['), joined, F.lit("]}")))
    )
    return pages.select("country", "page", payload.alias("payload"))


def chat_prompts(spark: SparkSession, sf: str) -> DataFrame:
    openers = ["Please EXPLAIN this: ", "What if coal falls? ", "Compare emissions: ", "Forecast economic output: ",
               "Best ten: ", "Which methodology? ", "", ""]
    opener = F.get(F.array(*[F.lit(o) for o in openers]), (F.col("turn") % 8).cast("int"))
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", F.concat(opener, "text").alias("message"))
