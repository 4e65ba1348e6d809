"""Solver state between iterations: tables in the shared folder, so lineage stays short."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_WRITTEN: list[tuple[SparkSession, str]] = []


def release(keep: int = 0) -> None:
    """Delete the state tables that this process has written, the last ``keep`` excepted (also done at exit)."""
    while len(_WRITTEN) > keep:
        spark, path = _WRITTEN.pop(0)
        try:
            target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may have ended before the process
            return


def state_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where it is unset, a temporary one in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="polefold-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def materialise(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` once and read it back: later plans start from the files."""
    target = path or f"{state_dir(df.sparkSession)}/state-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(target)
    if path is None:
        if not _WRITTEN:
            atexit.register(release)
        _WRITTEN.append((df.sparkSession, target))
    out = df.sparkSession.read.schema(df.schema).parquet(target)
    out.state_path = target if path is None else None
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete the files of tables that ``materialise`` has written and nothing reads any more."""
    for df in tables:
        path = getattr(df, "state_path", None)
        if path and (entry := (df.sparkSession, path)) in _WRITTEN:
            _WRITTEN.remove(entry)
            target = entry[0].sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(entry[0].sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def save_state(tables: dict[str, DataFrame], path: str) -> None:
    """Resumable solver state: one table a folder."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_state(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}
