"""Session defaults and the boundary where NaN becomes null."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def session(app: str = "tidemark", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; conf adds to or replaces settings."""
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    builder = SparkSession.builder.appName(app)
    for k, v in {**base, **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The application's folder for scratch tables, below the session's spark.checkpoint.dir, which driver and executors share.

    Only a local master may name none (tests): then a temporary folder is made and set.  On a cluster a
    session without one is an error, for a folder of the driver's machine isn't the executors'.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
        sc.setCheckpointDir(root)
    return f"{root.rstrip('/')}/tidemark-{sc.applicationId}"


def scratch(spark: SparkSession, kind: str) -> str:
    """A fresh path there."""
    return f"{scratch_root(spark)}/{kind}-{uuid.uuid4().hex}"


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN marks a missing value in the sources; from here on null does, so aggregates skip it."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, DoubleType | FloatType)]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})
