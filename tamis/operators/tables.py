"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_unset: dict[str, str] = {}  # folders of applications that name none


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only in local mode, where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _unset:
            _unset[app] = f"file://{tempfile.mkdtemp(prefix='tamis-')}"
        named = _unset[app]
    return named.rstrip("/")


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df from a table of its own, which cuts the lineage; by: columns that it is stored by."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4().hex}/{name}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    _places[made] = path
    return made


_places: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()  # where written put them


def discard(df: DataFrame) -> None:
    """Deletes the table that written made for df, once nothing that is still to run reads it; others stay."""
    path = _places.pop(df, None)
    if path is not None:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
