"""Sinks: table replacement, partitioned and appended writes, keyed changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seamline.functions.nested import merge_maps
from seamline.operators.relational import first_per_key


def replace_table(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialise_by_date(df: DataFrame, path: str, date: str, created_at: Column) -> None:
    """Write by day; a rerun replaces only the days it holds.

    Rows are rebalanced by day: adaptive execution splits a heavy day over as
    many tasks as its size asks for and merges light ones.
    """
    stamped = df.withColumn("created_at", created_at).withColumn("_day", F.to_date(date))
    stamped.hint("rebalance", F.col("_day")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_day").parquet(path)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def export_rows(df: DataFrame, fmt: str) -> DataFrame:
    """Each row rendered as one CSV or JSON line."""
    if fmt == "json":
        return df.select(F.to_json(F.struct(*df.columns)).alias("line"))
    if fmt == "csv":
        return df.select(F.to_csv(F.struct(*df.columns)).alias("line"))
    raise ValueError(f"unsupported export format {fmt}")


def export(df: DataFrame, fmt: str, path: str) -> None:
    if fmt not in ("csv", "json"):
        raise ValueError(f"unsupported export format {fmt}")
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.json(path)


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Last write per key wins."""
    return first_per_key(table.unionByName(changes), keys, [F.col(version)])


def last_change(changes: DataFrame, keys: list[str], order: list[str] | None) -> DataFrame:
    """One change per key: the last by ``order``, or by the values themselves where nothing says which came last."""
    by = order or [c for c in changes.columns if c not in keys and not isinstance(changes.schema[c].dataType, T.MapType)]
    return first_per_key(changes, keys, [F.col(c) for c in by]) if by else changes.dropDuplicates(keys)


def insert_new(table: DataFrame, rows: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Append only the rows whose key is not there yet; of several with one key, the last."""
    fresh = last_change(rows, keys, order).join(table.select(*keys), keys, "left_anti").select(*rows.columns)
    return table.unionByName(fresh, allowMissingColumns=True)


def update_rows(table: DataFrame, changes: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """Columns present and non-null in a key's last change replace the stored value."""
    fields = [c for c in changes.columns if c != key and c in table.columns]
    patch = last_change(changes, [key], order).select(key, *[F.col(c).alias(f"_new_{c}") for c in fields])
    joined = table.join(patch, key, "left")
    return joined.withColumns({c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) for c in fields}).select(*table.columns)


def delete_rows(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti")


def activate_version(registry: DataFrame, model_type: str, version: str) -> DataFrame:
    """Make one version of a type the active one; an unknown version is an error."""
    hit = (F.col("model_type") == model_type) & (F.col("model_version") == version)
    if registry.where(hit).isEmpty():
        raise LookupError(f"no version {version} of {model_type}")
    return registry.withColumn(
        "is_active", F.when(F.col("model_type") == model_type, F.col("model_version") == version).otherwise(F.col("is_active"))
    )


def merge_context(sessions: DataFrame, updates: DataFrame, key: str, context: str, order: list[str] | None = None) -> DataFrame:
    """Merge context maps, the update winning entry by entry; a later update wins over an earlier one.

    Updates are reduced entry by entry before the join, so a session keeps one row
    however often it is updated.
    """
    by = F.struct(*[F.col(c) for c in order or []], F.col("_value"))
    entries = updates.select(key, *(order or []), F.explode(context).alias("_name", "_value"))
    last = entries.groupBy(key, "_name").agg(F.max_by("_value", by).alias("_value"))
    new = last.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("_name", "_value"))).alias("_new"))
    empty = F.create_map().cast("map<string,string>")
    merged = merge_maps(F.coalesce(context, empty), F.coalesce("_new", empty))
    return sessions.join(new, key, "left").withColumn(context, merged).drop("_new")


def store_values(definitions: DataFrame, values: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Get or create the definition of each value, then the values with its id.

    New ids are derived from the name, so they need no counter and no ordering.
    """
    wanted = values.select(name).distinct().withColumn("definition_id", F.sha2(name, 256))
    stored = insert_new(definitions.select(name, "definition_id"), wanted, [name])
    return stored, values.join(stored, name)
