"""A Spark session with the settings that the library is written for."""

from __future__ import annotations

import os
import re
import tempfile
from functools import cache

from pyspark.sql import SparkSession


def session(name: str = "strataform", **settings: str) -> SparkSession:
    """The running session, or a local one. ``settings`` go over the defaults."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    builder = SparkSession.builder.appName(name).config(map=base | settings)
    if not os.environ.get("MASTER") and "spark.master" not in settings:
        builder = builder.master("local[*]")
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset and all runs in this one process (tests), a temporary folder; on a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _local_folder()


@cache
def _local_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="strataform-")
