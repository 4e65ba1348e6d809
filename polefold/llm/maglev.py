"""Operator 5, sharding by a permutation-filled lookup table (Maglev hashing).

Every shard has a preference order over the slots of a table of prime size: from an offset it
goes on by a skip, both taken from digests of its name. The shards take turns; each claims the
first slot of its order that is free. The table's size is a parameter, so it is broadcast, and
placing a row is one hash and one look-up. Adding or losing a shard moves few rows.

Defined cases: a null key is placed as the empty string is; equal keys share a shard; an empty
table gives no rows; other columns pass through (``slot`` and ``shard`` are replaced if present).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TABLE_SIZE = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(128))
MAX_TABLE = 10_000_000


def _digest(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill_table(shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE) -> list[int]:
    """Slot -> index into ``shards``."""
    if not shards or len(set(shards)) != len(shards) or size < len(shards) or size > MAX_TABLE:
        raise ValueError("need distinct shards and a table that is at least as large and bounded")
    if size < 2 or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError("the table's size must be prime")
    at = [_digest(f"offset:{s}") % size for s in shards]
    skip = [_digest(f"skip:{s}") % (size - 1) + 1 for s in shards]
    slots, free = [-1] * size, size
    while True:
        for i in range(len(shards)):
            while slots[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % size
            slots[at[i]] = i
            free -= 1
            if not free:
                return slots


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return (F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % size).cast("int")


def place(df: DataFrame, key: str = "doc_id", shards: tuple[str, ...] = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """``df`` with ``slot`` and ``shard``; the look-up table (at most MAX_TABLE rows) is broadcast."""
    filled = fill_table(shards, size)
    names = F.array(*[F.lit(s) for s in shards])
    lookup = df.sparkSession.createDataFrame(list(enumerate(filled)), "slot int, _shard int")
    lookup = lookup.select("slot", names[F.col("_shard")].alias("shard"))
    return df.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), size)).join(F.broadcast(lookup), "slot", "left")


def write_shards(df: DataFrame, path: str, key: str = "doc_id", files_per_shard: int = 1) -> None:
    """One folder per shard; a shard's rows, alike or not, are spread over ``files_per_shard`` tasks by a row number."""
    salt = common.unused("salt", df.columns)
    placed = place(df, key).withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(files_per_shard)))
    placed.repartition("shard", salt).drop(salt, "slot").write.partitionBy("shard").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(common.table(spark, sf_dir, "documents").select("doc_id")).select("doc_id", "slot", "shard")
