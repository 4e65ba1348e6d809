"""Dense arrays and long tables: ingestion, densification, sinks."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def from_dense(spark: SparkSession, array: np.ndarray, axes: tuple[str, ...], value: str = "v", keep_zeros: bool = False) -> DataFrame:
    """Long table of an array held by the driver: one int column per axis. Meant for geometry and starts, not bulk data."""
    array = np.asarray(array, np.float64)
    if array.ndim != len(axes):
        raise ValueError(f"{array.ndim} axes, {len(axes)} names")
    at = np.nonzero(np.ones_like(array) if keep_zeros else array)
    import pandas as pd

    frame = pd.DataFrame({**{n: i.astype(np.int32) for n, i in zip(axes, at)}, value: array[at]})
    return spark.createDataFrame(frame, ", ".join([*(f"{n} int" for n in axes), f"{value} double"]))


def read_npy(spark: SparkSession, path: str, axes: tuple[str, ...], value: str = "v") -> DataFrame:
    """NumPy files of one shape, unpacked in parallel: path and one row per non-zero element."""
    import io
    from collections.abc import Iterator

    import pandas as pd

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, content in zip(part["path"], part["content"]):
                array = np.load(io.BytesIO(content)).astype(np.float64)
                at = np.nonzero(array)
                yield pd.DataFrame({"path": name, **{n: i.astype(np.int32) for n, i in zip(axes, at)}, value: array[at]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(work, ", ".join(["path string", *(f"{n} int" for n in axes), f"{value} double"]))


def to_dense(df: DataFrame, shape: tuple[int, ...], axes: tuple[str, ...], value: str = "v", most: int = 50_000_000) -> np.ndarray:
    """A small result as an array on the driver; refuses shapes above ``most`` elements."""
    if math.prod(shape) > most:
        raise ValueError("too large for the driver: write the table instead")
    out = np.zeros(shape)
    rows = df.select(*axes, value).toPandas()
    out[tuple(rows[a].to_numpy() for a in axes)] = rows[value].to_numpy()
    return out


def completed(df: DataFrame, axes: dict[str, int], value: str = "v") -> DataFrame:
    """All cells of the axes, absent ones 0, still as a table."""
    spark, cells = df.sparkSession, None
    for name, n in axes.items():
        axis = spark.range(n).select(F.col("id").cast("int").alias(name))
        cells = axis if cells is None else cells.crossJoin(F.broadcast(axis))
    return cells.join(df.select(*axes, value), list(axes), "left").fillna(0.0, [value])


def append_json(df: DataFrame, path: str) -> None:
    """JSON lines, added to what is there (statistics of runs)."""
    df.write.mode("append").json(path)


def iteration_stats(spark: SparkSession, stats: list[dict]) -> DataFrame:
    """A solver's list of statistics as a table."""
    names = sorted({k for s in stats for k in s})
    kinds = ", ".join(f"`{n}` double" for n in names)
    return spark.createDataFrame([tuple(float(s[n]) if s.get(n) is not None else None for n in names) for s in stats], kinds)
