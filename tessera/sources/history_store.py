"""Run-history storage in a shared folder.

Layout: ``<path>/runs`` holds JSON-lines files, one batch per append (append
never rewrites earlier runs); ``<path>/deleted`` holds tombstone ids, so a
delete is also an append.  ``read`` is the runs minus the tombstones.
``read_history_json`` reads the single JSON-array file layout.
"""

from __future__ import annotations

import datetime
import os
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.history import HISTORY_SCHEMA

_TOMBSTONE = T.StructType([T.StructField("model_id", T.StringType())])


def read_history_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of runs (parameters of any JSON type are kept as text);
    an empty frame with the history schema when the file is absent."""
    if not _exists(spark, path):
        return spark.createDataFrame([], HISTORY_SCHEMA)
    return spark.read.schema(HISTORY_SCHEMA).option("multiLine", True).json(path)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


class HistoryStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    @property
    def runs_path(self) -> str:
        return os.path.join(self.path, "runs")

    @property
    def deleted_path(self) -> str:
        return os.path.join(self.path, "deleted")

    def read(self) -> DataFrame:
        runs = (self.spark.read.schema(HISTORY_SCHEMA).json(self.runs_path)
                if _exists(self.spark, self.runs_path) else self.spark.createDataFrame([], HISTORY_SCHEMA))
        if _exists(self.spark, self.deleted_path):
            gone = self.spark.read.schema(_TOMBSTONE).json(self.deleted_path)
            runs = runs.join(gone, "model_id", "left_anti")
        return runs.select(*HISTORY_SCHEMA.fieldNames())

    def append_runs(self, runs: DataFrame) -> None:
        """Append a DataFrame of runs (history schema)."""
        runs.select(*[F.col(f.name).cast(f.dataType) for f in HISTORY_SCHEMA.fields]) \
            .write.mode("append").json(self.runs_path)

    def add_model(self, model_info: dict, metrics: dict, dataset_name: str, features: Sequence[str],
                  target: str, model_params: dict | None = None) -> str:
        """Record one run: new uuid, current time, name / type default 'Unknown'."""
        model_id = str(uuid.uuid4())
        row = (model_id, datetime.datetime.now().isoformat(), model_info.get("model_name", "Unknown"),
               model_info.get("model_type", "Unknown"), dataset_name, list(features), target,
               {k: float(v) for k, v in metrics.items()},
               {k: (str(v).lower() if isinstance(v, bool) else str(v)) for k, v in (model_params or {}).items()})
        self.append_runs(self.spark.createDataFrame([row], HISTORY_SCHEMA))
        return model_id

    def delete_model(self, model_id: str) -> bool:
        """True when the id was present (a tombstone is appended), else False."""
        found = self.read().where(F.col("model_id") == model_id).limit(1).count() > 0
        if found:
            self.spark.createDataFrame([(model_id,)], _TOMBSTONE).write.mode("append").json(self.deleted_path)
        return found
