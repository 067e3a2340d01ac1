"""Session defaults and the shared working folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_session(app: str = "holdfast", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; values in `conf` win over the defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by `spark.checkpoint.dir`.

    Only where all work is done on one machine (a `local` master, as in tests) and none is
    named, a temporary folder is made, remembered in the session so that later calls see
    the same one, and removed when Python ends. On a cluster a missing name is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not path:
        path = spark.conf.get("holdfast.shared.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="holdfast-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set("holdfast.shared.dir", path)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; nothing is ever overwritten there."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
