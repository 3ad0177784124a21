"""A run folder: the tables of a run's stages, and a log of those that are whole.

A stage is made once. Its table is written first and its log entry after, so that a run
which is killed goes on from the last whole stage, in any session: what is logged is read,
what is not is made again.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from corpusloom.session import cut

_LOG = "stage string, schema string, about string"


class RunFolder:
    """`about` says what the run is of (its settings, say): a folder holds one run, and
    another one's stages are not taken for its own."""

    def __init__(self, spark: SparkSession, path: str, about: str = ""):
        self.spark, self.path, self.about = spark, path.rstrip("/"), about
        for stage, entry in self.log().items():
            if entry["about"] != about:
                raise ValueError(f"{path} holds another run: its stage {stage} was made with {entry['about']}")

    def log(self) -> dict[str, dict]:
        """The whole stages. Only a missing folder is a run without any."""
        try:
            rows = self.spark.read.schema(_LOG).json(f"{self.path}/log/*").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = []
        return {r.stage: r.asDict() for r in rows}

    def stage(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The table of a stage: read if it is whole, else made and logged."""
        data = f"{self.path}/stages/{name}"
        entry = self.log().get(name)
        if entry is None:
            made = build()
            made.write.mode("overwrite").parquet(data)
            entry = {"stage": name, "schema": made.schema.json(), "about": self.about}
            row = self.spark.createDataFrame([(name, entry["schema"], self.about)], _LOG)
            row.coalesce(1).write.mode("overwrite").json(f"{self.path}/log/{name}")
        return self.spark.read.schema(T.StructType.fromJson(json.loads(entry["schema"]))).parquet(data)


def kept(run: RunFolder | None, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A stage of the run; without a run folder, a table in the shared folder."""
    return cut(build()) if run is None else run.stage(name, build)
