"""Schemas of the three entities and the fixed values that belong to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {"string": T.StringType(), "double": T.DoubleType(), "bigint": T.LongType(), "strings": T.ArrayType(T.StringType()), "timestamp": T.TimestampType()}


def _schema(**columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in columns.items()])


PRODUCT = _schema(
    product_id="string", title="string", description="string", category="string", subcategory="string", brand="string",
    price="double", rating="double", rating_count="bigint", tags="strings", created_at="timestamp",
)
USER = _schema(user_id="string", country="string", age_band="string", created_at="timestamp")
EVENT = _schema(event_id="string", user_id="string", product_id="string", event_type="string", timestamp="timestamp", weight="double", session_id="string")

# What an event of each type weighs, and the types that state a preference.
EVENT_WEIGHTS = {"view": 1.0, "wishlist": 2.0, "add_to_cart": 3.0, "rating": 4.0, "purchase": 5.0}
POSITIVE_EVENTS = ("add_to_cart", "purchase", "wishlist")
DEFAULTS = {"country": "US", "age_band": "25-34", "weight": 1.0, "tags": []}
REQUIRED_EVENT_COLUMNS = ("event_id", "user_id", "product_id", "event_type", "timestamp")


def conform(df: DataFrame, schema: T.StructType, defaults: bool = True) -> DataFrame:
    """df in the schema's columns: missing ones null, unparsable values null, then the defaults.

    Documents of a document store carry their key as _id: it stands in where the schema's own key (its first column) is missing or null.
    """
    key = schema.fields[0].name
    if "_id" in df.columns:
        own = F.col("_id").cast("string")
        df = df.withColumn(key, F.coalesce(F.col(key).cast("string"), own) if key in df.columns else own)
    out = []
    for field in schema.fields:
        if field.name not in df.columns:
            column = F.lit(None).cast(field.dataType)
        elif isinstance(field.dataType, T.ArrayType):
            column = F.col(field.name).cast(field.dataType)
        else:
            column = F.col(field.name).try_cast(field.dataType)
        if defaults and field.name == "tags":
            column = F.coalesce(column, F.array().cast(field.dataType))
        elif defaults and field.name in DEFAULTS:
            column = F.coalesce(column, F.lit(DEFAULTS[field.name]))
        out.append(column.alias(field.name))
    return df.select(*out)
