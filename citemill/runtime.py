"""Session, table access and lineage cuts shared by the whole library."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: list[str] = []
_WRITTEN: list[tuple[SparkSession, str]] = []


def get_session(app: str = "citemill", cpus: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings the library is written for; a cluster passes its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("CITEMILL_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables in a scale-factor folder, read lazily by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as `spark.checkpoint.dir` names it.

    Only where the setting is absent and the whole session is local (tests) a folder of this machine stands in.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="citemill-"))
    return _OWN_DIR[0]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: a lineage cut that outlives any executor."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession, label: str) -> str:
    """A path in the shared folder for a store of this session; `release` deletes it as it does tables."""
    path = f"{shared_dir(spark)}/citemill/{label}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def written() -> int:
    """How many tables `materialize` has written so far and not deleted."""
    return len(_WRITTEN)


def release(since: int = 0, but_last: bool = False) -> None:
    """Delete the tables that `materialize` wrote after the first `since` ones, but for the last one if wanted.

    Only call it once all results that depend on them are written.
    """
    kept = [_WRITTEN.pop()] if but_last and len(_WRITTEN) > since else []
    while len(_WRITTEN) > since:
        spark, path = _WRITTEN.pop()
        try:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may have ended already  # noqa: BLE001
            continue
    _WRITTEN.extend(kept)


atexit.register(release)
