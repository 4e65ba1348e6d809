"""Operator 13, centroid clustering by delta Lloyd rounds, in whole numbers.

A vector's components become floor(scale * x). The first centroids are the vectors with the smallest
hashes of their ids. Assignments are a table in the shared folder, written anew each round; sums and
counts of all clusters are kept on the driver (clusters x components numbers) and only changed: a
vector whose owner is as it was is compared with the changed centroids alone, its stored distance
standing for the others; one whose owner has changed is compared with all. Vectors that change
hands add to one cluster's sums and take from another's, as signed whole numbers summed in tasks first.

Distances are matrix products in doubles while these are exact, else in int64, else in Python's
integers, so results are exact at any magnitude; a distance beyond a long is given as the largest long.

Defined cases: vectors of another length, null ones and those with a null, NaN or infinite component
are left out; a null vec_id counts as the empty string in the hash; rows with equal vec_id are vectors
of their own, ordered by their components where they compete as first centroids; fewer vectors than
clusters give fewer clusters; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CLUSTERS, ROUNDS, DIMENSIONS, SCALE, SEED = 16, 3, 64, 64, 1
_EXACT, _LONG, _LIMB, _MOST = 1 << 22, 1 << 27, 40, (1 << 63) - 1


def usable(embeddings: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """vec_id, embedding (doubles) of vectors with all components."""
    inside = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    vector = F.col("embedding").cast("array<double>")
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("embedding")).where((F.size("embedding") == dimensions) & F.forall("embedding", inside))


def _whole(column: pa.Array, dimensions: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * x) as int64, and which rows are too large for it (0 there)."""
    values = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
    with np.errstate(over="ignore"):
        scaled = np.floor(values * scale)
    large = (np.abs(scaled) >= _LONG).any(1)
    return np.where(large[:, None], 0, scaled).astype(np.int64), large


def integers(vector: list[float], scale: float = SCALE) -> list[int]:
    """floor(scale * x), exact in Python's integers."""
    out = []
    for x in vector:
        top, bottom = float(x).as_integer_ratio()
        up, down = float(scale).as_integer_ratio()
        out.append(top * up // (bottom * down))
    return out


def distances(vectors: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """Squared distances [vector, centroid], exact; int64 vectors below ``_LONG``."""
    most = max((abs(x) for c in centroids for x in c), default=0)
    if most >= _LONG:
        return np.array([[sum((int(a) - b) ** 2 for a, b in zip(v, c)) for c in centroids] for v in vectors], object).reshape(len(vectors), len(centroids))
    middle = np.array(centroids, np.int64).reshape(-1, vectors.shape[1])
    if max(most, int(np.abs(vectors).max(initial=0))) < _EXACT and 4 * vectors.shape[1] * _EXACT**2 <= 1 << 53:
        a, b = vectors.astype(np.float64), middle.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((vectors - c) ** 2).sum(1) for c in middle], 1) if len(middle) else np.zeros((len(vectors), 0), np.int64)


def _first_of_least(found: np.ndarray) -> np.ndarray:
    """Column of the least value of each row, the first among equals."""
    return found.argmin(1) if found.dtype != object else np.array([min(range(len(r)), key=lambda i: (r[i], i)) for r in found], np.int64)


def assign(state: DataFrame, centroids: list[list[int]], changed: list[int], scale: float = SCALE) -> DataFrame:
    """vec_id, embedding, owner, distance, before: every vector with its nearest centroid and its last owner (-1: none)."""
    dimensions, all_of = len(centroids[0]), list(range(len(centroids)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors, large = _whole(batch.column("embedding"), dimensions, scale)
            before = batch.column("owner").to_numpy()
            owner, distance = before.copy(), batch.column("distance").to_numpy().copy()
            # these can trust nothing: their owner is new or has changed
            anew = np.isin(before, [-1, *changed]) & ~large
            if anew.any():
                found = distances(vectors[anew], centroids)
                owner[anew] = at = _first_of_least(found)
                distance[anew] = np.minimum(found[np.arange(len(at)), at], _MOST)
            kept = np.flatnonzero(~anew & ~large)
            if len(kept) and changed:
                found = distances(vectors[kept], [centroids[i] for i in changed])
                at = _first_of_least(found)
                value, rival = found[np.arange(len(at)), at], np.array(changed)[at]
                wins = np.array((value < distance[kept]) | ((value == distance[kept]) & (rival < owner[kept])), bool)
                owner[kept[wins]], distance[kept[wins]] = rival[wins], np.minimum(value[wins], _MOST)
            for i in np.flatnonzero(large).tolist():
                vector = integers(batch.column("embedding")[i].as_py(), scale)
                best = min((sum((a - b) ** 2 for a, b in zip(vector, centroids[c])), c) for c in all_of)
                owner[i], distance[i] = best[1], min(best[0], _MOST)
            columns = [batch.column("vec_id"), batch.column("embedding"), pa.array(owner, pa.int32()), pa.array(distance.astype(np.int64)), pa.array(before, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "embedding", "owner", "distance", "before"])

    return common.map_batches(state, work, "vec_id long, embedding array<double>, owner int, distance long, before int")


def transfers(state: DataFrame, clusters: int, dimensions: int, scale: float = SCALE) -> tuple[list[int], list[list[int]]]:
    """What counts and sums of all clusters gain, from the vectors that changed hands."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = [[0] * (dimensions + 1) for _ in range(clusters)]
        for batch in batches:
            vectors, large = _whole(batch.column("embedding"), dimensions, scale)
            vectors = np.concatenate([vectors, np.ones((len(vectors), 1), np.int64)], 1)
            for name, sign in (("owner", 1), ("before", -1)):
                to = batch.column(name).to_numpy()
                for c in np.unique(to[to >= 0]).tolist():
                    moved = vectors[(to == c) & ~large].sum(0)
                    gain[c] = [a + sign * int(b) for a, b in zip(gain[c], moved)]
                for i in np.flatnonzero(large & (to >= 0)).tolist():
                    vector = [*integers(batch.column("embedding")[i].as_py(), scale), 1]
                    gain[to[i]] = [a + sign * b for a, b in zip(gain[to[i]], vector)]
        rows = []
        for c, values in enumerate(gain):
            for place, value in enumerate(values):
                limb = 0
                while value:
                    low = value & ((1 << _LIMB) - 1) if abs(value) >> 60 else value
                    rows.append((c, place, limb, low))
                    value, limb = (value - low) >> _LIMB, limb + 1
        columns = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], ["cluster", "place", "limb", "gain"])

    moved = state.where("owner <> before").select("embedding", "owner", "before")
    parts = common.map_batches(moved, work, "cluster int, place int, limb int, gain long")
    summed = parts.groupBy("cluster", "place", "limb").agg(F.sum(F.col("gain").cast("decimal(38,0)")).alias("gain")).collect()
    out = [[0] * (dimensions + 1) for _ in range(clusters)]
    for row in summed:
        out[row["cluster"]][row["place"]] += int(row["gain"]) << (_LIMB * row["limb"])
    return [x[-1] for x in out], [x[:-1] for x in out]


def cluster(embeddings: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: float = SCALE, seed: int = SEED) -> tuple[DataFrame, list[list[int]]]:
    """vec_id, embedding, owner, distance of every usable vector, and the final centroids."""
    spark = embeddings.sparkSession
    vectors = usable(embeddings, dimensions)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    centroids = [integers(row["embedding"], scale) for row in vectors.orderBy(key, "embedding").limit(clusters).collect()]
    counts, sums = [0] * len(centroids), [[0] * dimensions for _ in centroids]
    state, old = vectors.withColumns({"owner": F.lit(-1), "distance": F.lit(0).cast("long")}), None
    changed = list(range(len(centroids)))
    for step in range(rounds + 1 if centroids else 0):
        path = common.own_folder(spark)
        state = common.materialise(assign(state.select("vec_id", "embedding", "owner", "distance"), centroids, changed, scale), path)
        if old:
            common.discard(spark, old)
        old = path
        if step == rounds:
            break
        more, gained = transfers(state, len(centroids), dimensions, scale)
        counts = [a + b for a, b in zip(counts, more)]
        sums = [[a + b for a, b in zip(x, y)] for x, y in zip(sums, gained)]
        moved = [[x // n for x in s] if n else c for n, s, c in zip(counts, sums, centroids)]
        changed = [i for i, (a, b) in enumerate(zip(moved, centroids)) if a != b]
        centroids = moved
    return state.select("vec_id", "embedding", "owner", "distance"), centroids


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, centroids = cluster(common.table(spark, sf_dir, "embeddings"))
    inertia = {r["owner"]: int(r["d"]) for r in found.groupBy("owner").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    rows = [(i, min(inertia.get(i, 0), _MOST), min(sum(inertia.values()), _MOST), d) for i, d in enumerate(digest)]
    told = spark.createDataFrame(rows, "owner int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(told), "owner").select("vec_id", F.col("owner").alias("cluster"), "distance", "cluster_inertia", "inertia", "centroid_sha256")  # as many rows as clusters


def _sql() -> str:
    steps = [
        "v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x FROM embeddings"
        " WHERE len(embedding) = 64 AND list_count(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: isfinite(x))))",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS k, x AS c FROM (SELECT x, sha256('1:' || coalesce(vec_id::VARCHAR, '')) AS h FROM v ORDER BY h, x LIMIT 16))",
    ]
    for i in range(4):
        steps.append(
            f"a{i} AS MATERIALIZED (SELECT row, vec_id, x, arg_min(k, o) AS k, min(o) // 16 AS d FROM (SELECT row, vec_id, x, k, list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT * 16 + k AS o FROM v, c{i}) GROUP BY row, vec_id, x)"
        )
        if i < 3:
            steps.append(
                f"m{i} AS (SELECT k, list(m ORDER BY place) AS m FROM (SELECT k, place, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS m FROM (SELECT k, unnest(x) AS x, generate_subscripts(x, 1) AS place FROM a{i}) GROUP BY k, place) GROUP BY k)"
            )
            steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c{i}.k, coalesce(m{i}.m::BIGINT[], c{i}.c) AS c FROM c{i} LEFT JOIN m{i} ON m{i}.k = c{i}.k)")
    return (
        "WITH " + ",\n".join(steps) + "\nSELECT vec_id, a3.k::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY a3.k))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,"
        " sha256(array_to_string(c3.c, ',')) AS centroid_sha256 FROM a3 JOIN c3 ON c3.k = a3.k"
    )


SQL = _sql()
