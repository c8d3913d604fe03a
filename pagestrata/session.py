"""Session settings and table access shared by every plan."""

from __future__ import annotations

import os
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: AQE does the runtime work (coalescing, skew-join splits); the rest are sizes that hold at any input.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def session(app: str = "pagestrata", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benches; a cluster passes its own session instead."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, by Spark's own reader so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master, as in tests, has one of its own instead."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "checkpoints")


def checkpointed(spark: SparkSession, frame: DataFrame) -> DataFrame:
    """Cuts the lineage in the folder that the cluster shares; a lost executor then costs no rerun of the plan before."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(spark))
    return frame.checkpoint(eager=True)


class Busy(Exception):
    """Another job holds the lock."""


@contextmanager
def single_flight(spark: SparkSession, path: str, lease: int = 3_600) -> Iterator[Callable[[], None]]:
    """Holds a job's lock file; Busy while another job does. Yields a function that renews the lock.

    A lock not renewed for ``lease`` seconds is a dead driver's and is taken over. One of two jobs wins only where the
    store creates files atomically, as HDFS does.
    """
    jvm, owner = spark._jvm, uuid.uuid4().hex
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())

    def holder() -> str:
        stream = fs.open(place)
        try:
            return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    if fs.exists(place):
        if time.time() * 1000 - fs.getFileStatus(place).getModificationTime() <= lease * 1000:
            raise Busy(path)
        fs.delete(place, False)
    try:
        out = fs.create(place, False)
    except Exception as error:
        if fs.exists(place):
            raise Busy(path) from error
        raise
    out.write(owner.encode())
    out.close()
    try:
        yield lambda: fs.setTimes(place, int(time.time() * 1000), -1)
    finally:
        if fs.exists(place) and holder() == owner:
            fs.delete(place, False)
