"""Operator 7, SimHash near-duplicates: pigeonhole blocks, join on blocks, verified distance.

Words are runs of bytes other than ASCII white space after A-Z is lower-cased; shingles are
``width`` words joined by a blank, repeats included. Copies collapse to one row per fingerprint
before any pairing. The 64 bits are cut into ``blocks`` parts; two fingerprints that differ in at
most ``distance`` bits agree on ``blocks - distance`` of them, so every choice of that many parts
makes one key. A key's fingerprints are compared in tiles of bounded size and only the links of a
spanning forest leave a tile, so a cluster of m texts gives fewer than m rows per tile, not m*m.

Defined cases: null or blank text has no shingle and fingerprint zero, which links like any
other; fewer than ``width`` words make one shingle; repeated rows share a component; null doc_id
is kept and never chosen as a component's id unless alone; an empty table gives no rows; other
columns pass through ``near_duplicates`` (``fingerprint`` and ``component_id`` are replaced).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

WIDTH, DISTANCE, BLOCKS, TILE = 3, 3, 6, 4096
_CHUNK = 1 << 15


def _hashes(raw: bytes, width: int) -> list[int]:
    words = raw.lower().split()
    if not words:
        return []
    joined = memoryview(b" ".join(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends + 1 - sizes).tolist()
    last = ends[min(width, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], 42) for a, b in zip(starts, last)]


def fingerprint(raw: bytes, width: int = WIDTH) -> int:
    """Bit b is 1 if it is set in more than half of the shingle hashes."""
    hashes = np.array(_hashes(raw, width), dtype="<u8")
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _CHUNK):
        ones += np.unpackbits(hashes[i : i + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, width: int = WIDTH, *keep: str) -> DataFrame:
    """The columns ``keep`` and fp, a signed long with the fingerprint's bits."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(r or b"", width) for r in batch.column("raw").to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(fps, pa.int64())], [*keep, "fp"])

    source = common.with_text_bytes(documents, *keep)
    return common.map_batches(source, work, T.StructType([*source.drop("raw").schema.fields, T.StructField("fp", T.LongType())]))


def _masks(blocks: int, distance: int) -> list[int]:
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(parts, blocks - distance)]


def _forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the pairs within ``distance``, found breadth first."""
    found, rest = [], np.unique(fps).view(np.uint64)  # unsigned: counting bits of signed ones takes their absolute value
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = np.bitwise_count(rest ^ x) <= distance
            if near.any():
                hits, rest = rest[near], rest[~near]
                found += [(int(a), int(b)) for a, b in zip(np.full(len(hits), x).view(np.int64), hits.view(np.int64))]
                front += list(hits)
    return found


def links(distinct: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """Links (a, b) that connect every pair of ``fp`` values within ``distance`` bits."""
    masks = [m - (1 << 64) if m >> 63 else m for m in _masks(blocks, distance)]
    keyed = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("m", "key"))
    sizes = keyed.groupBy("m", "key").agg(F.count("*").alias("size")).where("size > 1")
    small = keyed.join(sizes.hint("merge"), ["m", "key"])
    # a key with more than `tile` fingerprints becomes pairs of parts, each part in several groups
    parts = F.ceil(F.col("size") / tile).cast("int")
    small = small.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    others = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    tiles = small.select("fp", "m", "key", "part", F.explode(others).alias("other"))
    tiles = tiles.select("fp", F.xxhash64("m", "key", F.least("part", "other"), F.greatest("part", "other")).alias("tile"), F.struct("m", "key", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi")).alias("id"))
    shuffled = tiles.repartition(F.col("tile")).sortWithinPartitions("tile", "id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[int] = []
        now = None

        def made(out: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            ids, out = batch.column("id"), []
            fields = [ids.field(k).to_pylist() for k in range(4)]
            for fp, *ident in zip(batch.column("fp").to_pylist(), *fields):
                if ident != now:
                    if len(held) > 1:
                        out += _forest(np.array(held, np.int64), distance)
                    held, now = [], ident
                held.append(fp)
            if out:
                yield made(out)
        if len(held) > 1:
            yield made(_forest(np.array(held, np.int64), distance))

    return common.map_batches(shuffled, work, "a long, b long")


def groups(prints: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """fp and root, the same for all fingerprints that are linked; ``prints`` is read twice."""
    distinct = common.materialise(common.compact(prints.select("fp").distinct(), prints.count()))
    roots = common.connected_components(links(distinct, distance, blocks))
    return distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(documents: DataFrame, width: int = WIDTH, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    prints = common.materialise(fingerprints(documents, width, "doc_id"))
    rows = prints.count()
    named = common.materialise(common.compact(prints.groupBy("fp").agg(F.min("doc_id").alias("first")).join(groups(prints, distance, blocks), "fp"), rows))
    lowest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = common.materialise(common.compact(named.join(lowest, "root").select("fp", "component_id"), rows))
    return prints.join(labels.hint("merge"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))


def keep_first(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of every component one row stays, that with the smallest doc_id.

    Ties are settled by a digest of the text, rows without an id come last, and of rows equal in
    doc_id and text one stays. Texts are shuffled once, by the digest that tells rows apart.
    """
    key = common.unused("key", docs.columns)
    digest = F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("text").isNull().cast("string"), F.coalesce("text", F.lit("")))))
    keyed = docs.select("doc_id", "text", digest.alias(key))
    prints = common.materialise(fingerprints(keyed, WIDTH, "doc_id", key))
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", key)
    first = prints.groupBy("fp").agg(F.min(rank).alias("first")).join(groups(prints), "fp")
    kept = first.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first")[key].alias(key))
    return docs.withColumn(key, digest).join(kept.hint("merge"), key, "left_semi").dropDuplicates([key]).select(*docs.columns)
