"""Array, map, JSON and hash functions over columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seamline import fixed


def canonical_json(fields: dict[str, Column]) -> Column:
    """Key-sorted JSON text built from already rendered values.

    Values are strings; NULL becomes ``null``. Quotes and backslashes are
    escaped, so the text is byte-equal on every engine.
    """
    def item(name: str, value: Column) -> Column:
        escaped = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
        return F.concat(
            F.lit(f'"{name}": '),
            F.coalesce(F.concat(F.lit('"'), escaped, F.lit('"')), F.lit("null")),
        )

    return F.concat(F.lit("{"), F.concat_ws(", ", *[item(k, fields[k]) for k in sorted(fields)]), F.lit("}"))


def feed_hash(payload: Column) -> Column:
    return F.left(F.sha2(payload, 256), F.lit(16))


def chunk_hash(content: Column, metadata_json: Column) -> Column:
    return F.sha2(F.concat(content, metadata_json), 256)


def content_hash(fields: dict[str, Column], volatile=("scraped_at", "updated_at")) -> Column:
    return F.md5(canonical_json({k: v for k, v in fields.items() if k not in volatile}))


def path_uuid(path: Column, namespace_hex: str = fixed.DNS_NAMESPACE) -> Column:
    """Name-based (version 5) UUID of a path."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), path.cast("binary")))
    variant = F.lower(F.hex(
        F.conv(F.substring(digest, 17, 2), 16, 10).cast("int").bitwiseAND(F.lit(0x3F)).bitwiseOR(F.lit(0x80))
    ))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 19, 2)),
        F.substring(digest, 21, 12),
    )


def chunk_id(document_id: Column, index: Column) -> Column:
    return F.format_string("%s_%04d", document_id, index)


def hash_code(value: Column) -> Column:
    """A stable code from 0 to 0.999; md5 is the same in every engine."""
    return F.conv(F.substring(F.md5(value.cast("string")), 1, 8), 16, 10).cast("long") % 1000 / F.lit(1000.0)


def parse_metrics(text: Column) -> Column:
    parsed = F.from_json(F.nullif(text, F.lit("")), "map<string,double>")
    return F.coalesce(parsed, F.create_map().cast("map<string,double>"))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def feature_vector(features: Column, order: list[str], default: float = 0.0) -> Column:
    return F.array(*[F.coalesce(F.try_element_at(features, F.lit(k)), F.lit(default)) for k in order])


def merge_maps(old: Column, new: Column) -> Column:
    """Union of two maps in which the new value wins."""
    return F.map_zip_with(old, new, lambda _, a, b: F.coalesce(b, a))


SPARK_TYPES: dict[str, T.DataType] = {
    "float": T.DoubleType(),
    "int": T.LongType(),
    "string": T.StringType(),
    "bool": T.BooleanType(),
    "timestamp": T.TimestampType(),
}


def feature_type(name: str) -> T.DataType:
    return SPARK_TYPES.get(name.lower(), T.DoubleType())


def feature_type_column(name: Column) -> Column:
    out = None
    for key, dtype in SPARK_TYPES.items():
        hit = F.lower(name) == key
        out = F.when(hit, dtype.simpleString()) if out is None else out.when(hit, dtype.simpleString())
    return out.otherwise(T.DoubleType().simpleString())


def to_long(df: DataFrame, ids: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(ids, columns, name, value)


def to_wide(df: DataFrame, ids: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    """Long to wide for a known column list, so no pass is spent on finding it."""
    return df.groupBy(*ids).pivot(name, columns).agg(F.first(value))
