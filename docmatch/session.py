"""Session settings the library relies on."""

from __future__ import annotations

from types import ModuleType

import docmatch
from pyspark import cloudpickle
from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # A repeated JSON key keeps its last value instead of failing the whole tree.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # Hot join keys are split at run time; every keyed join here has one unique side.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession, *packages: ModuleType) -> SparkSession:
    """Apply the run-time settings to a session; safe to call repeatedly.

    Functions of this package, and of further ``packages`` with model functions, travel to the
    executors by value, so nothing has to be installed there.
    """
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    for package in (docmatch, *packages):
        cloudpickle.register_pickle_by_value(package)
    return spark
