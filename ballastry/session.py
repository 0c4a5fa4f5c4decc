"""Session settings that the engine relies on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "ballastry", **conf: str) -> SparkSession:
    """A session with UTC dates, ANSI semantics and adaptive execution; conf is added to it."""
    builder = SparkSession.builder.appName(app)
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true"}
    return builder.config(map=fixed | conf).getOrCreate()


def kept(df: DataFrame) -> DataFrame:
    """df, written once to the folder of ``spark.checkpoint.dir``, and without its plan.

    What many plans share is kept this way rather than cached: a lost executor costs no recomputation, nothing stays in memory, and
    plans that read several kept tables stay short (the plans of cached tables nest). Only a local session without that
    setting gets a temporary folder.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            named = "file://" + tempfile.mkdtemp(prefix="ballastry-")
        sc.setCheckpointDir(named)
    return df.checkpoint(eager=True)
