"""Give the tasks this package, as a zip that Spark sends to every executor."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

import corpusloom

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per application. Tasks then import the package by name, so that what a
    Python worker has learnt (the words of a tokenizer) lasts over its tasks."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    top = os.path.dirname(os.path.abspath(corpusloom.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="ship-"), "corpusloom_package.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    file = os.path.join(folder, name)
                    out.write(file, os.path.relpath(file, os.path.dirname(top)))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)
