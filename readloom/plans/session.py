"""What a session needs before this package's Python functions can run on its executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


#: Bytes of an Arrow batch that goes to a Python worker; Spark's own default is many times that, and the batch is
#: held by the executor and by the worker, for each task.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def reachable(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where it is installed on every machine, in batches of a few MB.
    These are settings of the session, and stay."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    value = spark.conf.get(_BATCH)
    if not value.rstrip("bB").isdigit() or int(value.rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    return spark


def work_dir(spark: SparkSession) -> str:
    """A new folder for files: in the one that spark.checkpoint.dir names, which driver and executors must have
    mounted; only where that is unset and executors are threads of this machine, a temporary one. It goes when the
    interpreter ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        path = base.removeprefix("file://").removeprefix("file:")
        if "://" in path:
            raise ValueError(f"{base} isn't mounted here")
        path = f"{path}/files-{uuid.uuid4().hex}"
        os.makedirs(path)
    elif spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local["):
        path = tempfile.mkdtemp(prefix="readloom-files-")
    else:
        raise ValueError("spark.checkpoint.dir names no folder that the executors share")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path
