"""Files of source records as DataFrames, and sinks of state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TRANSACTION_FIELDS = {
    "id": "long", "account_id": "string", "amount": "double", "merchant": "string", "merchant_category": "string", "location": "string", "country": "string", "transaction_type": "string", "channel": "string", "timestamp_offset_hours": "double",
    "is_recurring": "boolean", "is_first_time_merchant": "boolean", "is_first_time_country": "boolean", "velocity_1h": "int", "velocity_24h": "int", "label": "string", "label_detail": "string",
}
STATE_VERSIONS = (2, 3)


def truth(text: Column) -> Column:
    """Whether a text says yes; null and empty say nothing."""
    plain = F.lower(F.trim(text))
    return F.when(plain != "", plain.isin("1", "true", "yes", "y"))


def transactions_csv(spark: SparkSession, path: str) -> DataFrame:
    """Transactions from CSV files, typed; values that don't fit their type are null, missing columns too."""
    raw = spark.read.option("header", True).csv(path)
    made = []
    for name, kind in TRANSACTION_FIELDS.items():
        text = F.col(name) if name in raw.columns else F.lit(None).cast("string")
        made.append((truth(text) if kind == "boolean" else F.nullif(F.trim(text), F.lit("")).try_cast(kind)).alias(name))
    return raw.select(*made)


def json_records(spark: SparkSession, path: str, wrapper: str | None = None) -> DataFrame:
    """Records of files that hold a JSON array, or an object with the array under `wrapper`."""
    rows = spark.read.option("multiLine", True).json(path)
    if wrapper and wrapper in rows.columns:
        rows = rows.where(F.col(wrapper).isNotNull()).select(F.inline(wrapper))
    return rows


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON lines; lines that are no JSON are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def matrix_results(spark: SparkSession, pattern: str, field: str = "matrix") -> DataFrame:
    """Rows of the array `field` of every file that matches a pattern, with the file's name."""
    return spark.read.option("multiLine", True).json(pattern).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("source_file"), F.inline(field))


def metrics_text(spark: SparkSession, path: str) -> DataFrame:
    """Metrics in text exposition format: name, labels, value; comments and values that are no numbers are left out."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    form = r"^(\w+)(?:\{(.*)\})?\s+(\S+).*$"
    pick = lambda k: F.regexp_extract("value", form, k)
    pairs = F.arrays_zip(F.regexp_extract_all(pick(2), F.lit(r'(\w+)="([^"]*)"'), F.lit(1)).alias("k"), F.regexp_extract_all(pick(2), F.lit(r'(\w+)="([^"]*)"'), F.lit(2)).alias("v"))
    made = lines.select(pick(1).alias("name"), F.map_from_entries(pairs).alias("labels"), pick(3).try_cast("double").alias("number"))
    return made.where((F.col("name") != "") & F.col("number").isNotNull()).withColumnRenamed("number", "value")


def markdown_sections(spark: SparkSession, path: str) -> DataFrame:
    """file, pos, title and body of each second-level section of markdown files, front matter left out."""
    whole = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    body = F.regexp_replace("value", r"\A---\n(?s:.*?)\n---\n", "")
    parts = whole.select("file", F.posexplode(F.split(F.concat(F.lit("\n"), body), "\n## ")).alias("pos", "part"))
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    title = F.when(F.col("pos") > 0, bare(F.regexp_extract("part", r"^([^\n]*)", 1))).otherwise("")
    text = bare(F.when(F.col("pos") > 0, F.regexp_replace("part", r"^[^\n]*\n?", "")).otherwise(F.col("part")))
    return parts.select("file", "pos", title.alias("title"), text.alias("body")).where("body <> ''")


def table_after(spark: SparkSession, url: str, table: str, key: str, after: int | None = None, rows: int = 100_000, most: int | None = None, **options: str) -> DataFrame:
    """Rows of a database table whose whole-number key is past a high-water mark (None: all rows with a key), each partition
    a range of keys that the database is asked for.

    The ends of the keys are asked for first, and cut into equal ranges, so a partition holds about `rows` rows where keys are
    spread evenly. What comes while the job runs is left to the next one, which starts after the
    last key of this one (last_key). most: only the rows with the so many least keys, as a page. Columns that are asked for
    and filters on them are pushed to the database as well. A table without such rows gives none.
    """
    at = f"{key} > {int(after)}" if after is not None else f"{key} IS NOT NULL"
    reader = lambda: spark.read.format("jdbc").option("url", url).options(**options)
    if most is not None:
        page = f"(SELECT {key} AS K FROM {table} WHERE {at} ORDER BY {key} FETCH FIRST {int(most)} ROWS ONLY) p"
        low, high, n = reader().option("dbtable", page).load().toDF("k").agg(F.min("k"), F.max("k"), F.count("*")).first()
    else:
        ends = f"(SELECT MIN({key}) AS LOW, MAX({key}) AS HIGH, COUNT(*) AS N FROM {table} WHERE {at}) e"
        low, high, n = reader().option("dbtable", ends).load().first()
    if not n:
        return reader().option("dbtable", table).load().limit(0)
    width = -(-(high - low + 1) // -(-n // rows))
    starts = range(low, high + 1, width)
    ranges = [f"{key} >= {a} AND {key} <= {min(a + width - 1, high)}" for a in starts]
    return spark.read.jdbc(url, table, predicates=ranges, properties={k: str(v) for k, v in options.items()})


def last_key(rows: DataFrame, key: str, before: int | None = None) -> int | None:
    """The high-water mark after rows were taken: their greatest key, or the mark before where there are none."""
    found = rows.agg(F.max(key)).first()[0]
    return before if found is None else int(found)


def new_rows(now: DataFrame, before: DataFrame, key: str) -> DataFrame:
    """Rows whose key wasn't there at the poll before."""
    return now.join(before.select(key).distinct(), key, "left_anti")


def glob(column: Column, pattern: str) -> Column:
    """Whether a text matches a pattern with * and ?."""
    import re

    return column.rlike("^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$")


def allowed(column: Column, include: list[str], exclude: list[str]) -> Column:
    """Whether a name matches an included pattern (none: all) and no excluded one."""
    any_of = lambda ps: F.exists(F.array(*(glob(column, p) for p in ps)), lambda x: x)
    test = any_of(include) if include else F.lit(True)
    return test & ~any_of(exclude) if exclude else test


def save_state(tables: dict[str, DataFrame], path: str, version: int = STATE_VERSIONS[-1]) -> None:
    """State tables in a folder, and the version of their form; the version is written last."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(version,)], "version int").coalesce(1).write.mode("overwrite").json(f"{path}/_state")


def load_state(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame] | None:
    """State tables, or None where their form is one that isn't known, so that everything is found anew."""
    version = spark.read.schema("version int").json(f"{path}/_state").first()
    if version is None or version[0] not in STATE_VERSIONS:
        return None
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def append_latest(log: DataFrame, new: DataFrame, order: str, most: int = 10_000) -> DataFrame:
    """A log with new rows, cut to the latest."""
    return log.unionByName(new).orderBy(F.desc(order)).limit(most)


def array_slice(spark: SparkSession, path: str, offset: int, limit: int, field: str | None = None) -> DataFrame:
    """Elements offset to offset + limit of the arrays in JSON files (an array, or an object with one under `field`), by
    their place in their file."""
    rows = spark.read.option("multiLine", True).json(path)
    if field is not None:
        placed = rows.select(F.input_file_name().alias("_file"), F.posexplode(field).alias("_pos", "_x"))
        return placed.where((F.col("_pos") >= offset) & (F.col("_pos") < offset + limit)).select("_x.*")
    # an array at the top is read as rows, in their order within the file
    whole = spark.read.text(path, wholetext=True)
    items = F.from_json("value", f"array<{rows.schema.simpleString()}>")
    placed = whole.select(F.posexplode(items).alias("_pos", "_x"))
    return placed.where((F.col("_pos") >= offset) & (F.col("_pos") < offset + limit)).select("_x.*")


def front_matter(spark: SparkSession, path: str) -> DataFrame:
    """file, fields (a map of `key: value` lines between the two --- lines at the top) and body of markdown files; files
    without front matter have an empty map."""
    whole = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    head = F.regexp_extract("value", r"\A---\n(?s:(.*?))\n---(?:\n|\z)", 1)
    keys = F.regexp_extract_all(head, F.lit(r"(?m)^([A-Za-z_][\w-]*):[ \t]*(.*)$"), F.lit(1))
    values = F.transform(F.regexp_extract_all(head, F.lit(r"(?m)^([A-Za-z_][\w-]*):[ \t]*(.*)$"), F.lit(2)), lambda v: F.trim(v))
    first = F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda x, i: F.array_position(keys, x["k"]) == i + 1)
    body = F.regexp_replace("value", r"\A---\n(?s:.*?)\n---(?:\n|\z)", "")
    return whole.select("file", F.map_from_entries(first).alias("fields"), body.alias("body"))


_META = "metadata:struct<name:string,namespace:string>"
CLUSTER_SHAPES = {
    "pods": f"struct<{_META},status:struct<phase:string,reason:string,containerStatuses:array<struct<restartCount:int,state:struct<waiting:struct<reason:string>>>>>>",
    "events": f"struct<{_META},reason:string,message:string,count:int>",
    "nodes": f"struct<{_META},status:struct<conditions:array<struct<type:string,status:string>>>>",
}


def cluster_items(spark: SparkSession, path: str, kind: str, most_a_namespace: int | None = None) -> DataFrame:
    """Records, as mappings.kubernetes takes them, of the items of JSON lists of pods, events or nodes.

    most_a_namespace: so many at most of each namespace, the first by name (a quota of the collector; None: all).
    """
    whole = spark.read.text(path, wholetext=True)
    lists = F.from_json("value", f"struct<items:array<{CLUSTER_SHAPES[kind]}>>")
    items = whole.select(F.explode(lists["items"]).alias("i")).select("i.*")
    none = F.lit(None).cast("string")
    reason, message, count, phase, restarts = none, none, F.lit(None).cast("int"), none, F.lit(None).cast("int")
    conditions = {}
    if kind == "pods":
        states = F.coalesce("status.containerStatuses", F.array())
        waiting = F.transform(states, lambda s: s["state"]["waiting"]["reason"])
        reason = F.coalesce(F.try_element_at(F.array_compact(waiting), F.lit(1)), F.col("status.reason"))
        phase = F.col("status.phase")
        restarts = F.aggregate(states, F.lit(0), lambda n, s: n + F.coalesce(s["restartCount"], F.lit(0)))
    elif kind == "events":
        reason, message, count = F.col("reason"), F.col("message"), F.coalesce("count", F.lit(1))
    else:
        by_type = F.map_from_entries(F.transform("status.conditions", lambda c: F.struct(c["type"], c["status"])))
        for name, column in {"Ready": "ready", "MemoryPressure": "memory_pressure", "DiskPressure": "disk_pressure"}.items():
            conditions[column] = F.try_element_at(by_type, F.lit(name))
    rows = items.select(
        F.lit(kind[:-1]).alias("type"),
        F.col("metadata.name").alias("name"),
        F.coalesce("metadata.namespace", F.lit("")).alias("namespace"),
        phase.alias("phase"),
        restarts.alias("restarts"),
        reason.alias("reason"),
        message.alias("message"),
        count.alias("count"),
        *(conditions.get(c, none).alias(c) for c in ("ready", "memory_pressure", "disk_pressure")),
    )
    if most_a_namespace is None:
        return rows
    place = F.row_number().over(Window.partitionBy("namespace").orderBy("name"))
    return rows.withColumn("_r", place).where(F.col("_r") <= most_a_namespace).drop("_r")
