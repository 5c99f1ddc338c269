"""Nested content as variants: parsed once, walked to any depth, made comparable field by field.

A content is an object; each field has a path (the names down to it, joined by dots). Objects are walked, level by level for
all rows at once; lists are values. A field that says where (memory.PRESERVED), at any depth, is a value as it is; other texts
lose what changes from one event to the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamis.operators.memory import PRESERVED, normal_text
from tamis.operators.tables import written


def parsed(text: str) -> Column:
    """A text as a variant; one that isn't JSON as {"raw": text}, null as null."""
    return F.when(F.col(text).isNotNull(), F.coalesce(F.try_parse_json(text), F.to_variant_object(F.struct(F.col(text).alias("raw")))))


def _is_object(value: str) -> Column:
    return F.schema_of_variant(value).startswith("OBJECT")


def leaves(rows: DataFrame, key: str, content: str) -> DataFrame:
    """A row for each field of each content: key, path, kind (text, number, flag, list or null), top (whether it lies in no
    object but the content) and text (the value; normalised, or as JSON where it isn't a text).

    Contents that are no object, or null, have no fields; an empty object within one has none either. Rows whose keys are
    equal or null give fields each.
    """
    spark = rows.sparkSession
    now = rows.select(F.col(key).alias("_key"), F.col(content).alias("_value"), F.lit("").alias("_path")).where(_is_object("_value"))
    found, level = None, 0
    while True:
        fields = now.lateralJoin(spark.tvf.variant_explode(F.col("_value").outer()))
        fields = fields.select("_key", F.when(F.col("_path") == "", F.col("key")).otherwise(F.concat("_path", F.lit("."), "key")).alias("_path"), F.col("key").alias("_name"), F.col("value").alias("_value"), F.lit(level == 0).alias("top"))
        fields = written(fields, f"fields{level}")
        walked = ~F.col("_name").isin(*PRESERVED) & _is_object("_value")
        ends = fields.where(F.coalesce(~walked, F.lit(True)))
        found = ends if found is None else found.unionByName(ends)
        now = fields.where(walked).select("_key", "_value", "_path")
        level += 1
        if now.isEmpty():
            break
    kind = F.schema_of_variant("_value")
    named = F.when(kind == "STRING", "text").when(kind == "BOOLEAN", "flag").when(kind == "VOID", "null").when(kind.startswith("ARRAY"), "list").when(kind.startswith("OBJECT"), "object").otherwise("number")
    text = F.try_variant_get("_value", "$", "string")
    value = F.when(kind == "STRING", F.when(F.col("_name").isin(*PRESERVED), text).otherwise(normal_text(text))).otherwise(F.coalesce(F.to_json("_value"), F.lit("null")))
    return found.select(F.col("_key").alias(key), F.col("_path").alias("path"), named.alias("kind"), "top", value.alias("text"))


def hashes(fields: DataFrame, key: str) -> DataFrame:
    """sha256 of each key's fields, in the order of their paths: equal for contents that say the same."""
    pairs = F.array_sort(F.collect_list(F.struct("path", F.concat("path", F.lit("="), "text").alias("t"))))
    return fields.groupBy(key).agg(F.sha2(F.concat_ws("|", F.transform(pairs, lambda p: p["t"])), 256).alias("content_hash"))


def features(fields: DataFrame, key: str) -> DataFrame:
    """Each content's own numbers (name, value): flags are 1 and 0; what lies in objects and lists isn't one."""
    value = F.when(F.col("kind") == "number", F.col("text").try_cast("double")).when(F.col("kind") == "flag", (F.col("text") == "true").cast("double"))
    return fields.where("top").select(key, F.col("path").alias("name"), value.alias("value")).where("value is not null")
