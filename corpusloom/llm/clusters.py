"""Lloyd's centroids with bounds that vectors carry from round to round."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, stored, table
from .intvec import blocks, matrix, scaled, squared, usable

DIM, K, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
#: Vectors of one block, and vectors of a bucket of blocks, which is read by one task.
BLOCK, BUCKET, MOST_BUCKETS = 2048, 131_072, 50_000
#: Relative room for rounding where distances are compared as floating-point numbers.
SLACK = 1e-9


@dataclass
class Bounds:
    """Of every vector: its nearest and second-nearest centroid, at most how far the first is, at least how far all others are."""

    nearest: np.ndarray
    second: np.ndarray
    upper: np.ndarray
    lower: np.ndarray


def _ahead(d: np.ndarray, i: np.ndarray, e: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether centroid i at squared distance d comes before j at e: nearer, or as near with the smaller number."""
    return (d < e) | ((d == e) & (i < j))


def first_scan(x: np.ndarray, centroids: np.ndarray) -> Bounds:
    """All distances: the bounds before the first round."""
    n, k = len(x), len(centroids)
    far = np.stack([squared(x, c) for c in centroids], 1)
    nearest = far.argmin(1)
    least = far[np.arange(n), nearest]
    if k == 1:
        return Bounds(nearest, nearest, np.sqrt(least.astype(float)), np.full(n, np.inf))
    far[np.arange(n), nearest] = np.iinfo(np.int64).max
    second = far.argmin(1)
    return Bounds(nearest, second, np.sqrt(least.astype(float)), np.sqrt(far[np.arange(n), second].astype(float)))


def search(x: np.ndarray, centroids: np.ndarray, moved: np.ndarray, b: Bounds) -> int:
    """Brings the bounds up to date after the centroids have moved by `moved`; the number of distances that it took.

    A vector whose nearest centroid is by its bounds nearer than any other keeps it. The others look at their nearest
    and remembered second-nearest centroid, start from the closer one, and go through that one's neighbours by distance.
    A neighbour further from the start than the vector's distance to it plus its second-best distance so far can be
    neither nearest nor second; that ball shrinks while the search goes on. Survivors are compared as integers.
    """
    k = len(centroids)
    if k == 1:
        b.upper += moved[0]
        return 0
    between = np.sqrt(squared(centroids[:, None], centroids[None]).astype(float))
    order = np.argsort(between + np.where(np.eye(k, dtype=bool), -1.0, 0.0), axis=1, kind="stable")
    two = np.partition(moved, k - 2)[-2:]
    b.upper += moved[b.nearest]
    b.lower -= np.where((moved[b.nearest] == two[1]) & (np.count_nonzero(moved == two[1]) == 1), two[0], two[1])
    apart = between[np.arange(k), order[:, 1]] / 2
    clear = lambda rows: b.upper[rows] * (1 + SLACK) < np.maximum(b.lower[rows], apart[b.nearest[rows]]) * (1 - SLACK)
    open_ = np.flatnonzero(~clear(slice(None)))
    own = squared(x[open_], centroids[b.nearest[open_]])
    took = len(open_)
    b.upper[open_] = np.sqrt(own.astype(float))
    still = ~clear(open_)
    open_, own = open_[still], own[still]
    if not len(open_):
        return took
    one, two_ = b.nearest[open_], b.second[open_]
    other = squared(x[open_], centroids[two_])
    took += len(open_)
    swap = _ahead(other, two_, own, one)
    one, two_ = np.where(swap, two_, one), np.where(swap, one, two_)
    d1, d2 = np.where(swap, other, own), np.where(swap, own, other)
    start, seen, radius = one.copy(), two_.copy(), np.sqrt(d1.astype(float))
    live = np.arange(len(open_))
    for j in range(1, k):
        c = order[start[live], j]
        inside = between[start[live], c] <= (radius[live] + np.sqrt(d2[live].astype(float))) * (1 + SLACK)
        live, c = live[inside], c[inside]
        if not len(live):
            break
        new = c != seen[live]
        rows, c = live[new], c[new]
        d = squared(x[open_[rows]], centroids[c])
        took += len(rows)
        best = _ahead(d, c, d1[rows], one[rows])
        next_ = ~best & _ahead(d, c, d2[rows], two_[rows])
        d2[rows] = np.where(best, d1[rows], np.where(next_, d, d2[rows]))
        two_[rows] = np.where(best, one[rows], np.where(next_, c, two_[rows]))
        d1[rows], one[rows] = np.where(best, d, d1[rows]), np.where(best, c, one[rows])
    b.nearest[open_], b.second[open_] = one, two_
    b.upper[open_], b.lower[open_] = np.sqrt(d1.astype(float)), np.sqrt(d2.astype(float))
    return took


def cluster(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = K,
    rounds: int = ROUNDS,
    dim: int = DIM,
    scale: int = SCALE,
    seed: int = SEED,
    block: int = BLOCK,
) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    The vectors are stored once, in blocks that are bucketed by their number; every round stores the blocks' bounds,
    bucketed alike and a tenth of the size, so that both meet without a shuffle and a lost executor costs a round at
    most. A round sends k centroids to the tasks and gets the blocks' sums, which the shuffle combines. Rounds after one
    that moves no centroid would change nothing and are left out.

    Kept are vectors of exactly `dim` components, none null, NaN or infinite. Components are floor(scale * x), within
    +-2^27 for 64 components so that all distances fit 64 bits. The first centroids are the kept rows with the smallest
    SHA-256 of `seed:id` (null ids last, of equal ids the smaller vectors); fewer rows give fewer centroids. A vector as
    near to two centroids belongs to the one with the smaller number. Repeated rows and ids are rows of their own. Sums
    of distances beyond 64 bits are null. No kept vector gives no row. Other columns are ignored.
    """
    spark = vectors.sparkSession
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).filter((F.size("v") == dim) & usable(F.col("v")))
    kept = kept.withColumn("v", scaled(F.col("v"), scale, dim))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.select(digest.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    schema = "vec_id long, cluster int, distance long"
    if not first:
        return spark.createDataFrame([], schema + ", cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([r["v"] for r in first], np.int64).reshape(len(first), dim)
    k = len(centroids)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for i, b in enumerate(blocks(batches, block)):
            ids = pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([part << 32 | i], pa.int64()), ids, pa.array([matrix(b.column(1), dim).astype("<i8").tobytes()])], ["block", "vec_id", "points"])

    gathered = stored(kept.mapInArrow(gather, "block long, vec_id array<long>, points binary"))
    n = gathered.agg(F.sum(F.size("vec_id").cast("long"))).first()[0]
    buckets = min(MOST_BUCKETS, max(spark.sparkContext.defaultParallelism, -(-n // BUCKET)))
    made: list[str] = []

    def bucketed(df: DataFrame) -> DataFrame:
        """df as a table in the shared folder whose rows are bucketed by block."""
        name = f"loom_{uuid.uuid4().hex}"
        made.append(name)
        df.write.bucketBy(buckets, "block").option("path", f"{shared_dir(spark)}").format("parquet").saveAsTable(name)
        return spark.table(name)

    def told(x: np.ndarray, b: Bounds, took: int) -> list:
        sums = np.zeros((k, dim), np.int64)
        np.add.at(sums, b.nearest, x)
        flat = np.concatenate((sums, np.bincount(b.nearest, minlength=k)[:, None]), 1).reshape(-1)
        bounds = [b.nearest.astype("<i4"), b.second.astype("<i4"), b.upper.astype("<f8"), b.lower.astype("<f8")]
        return [*(pa.array([y.tobytes()]) for y in bounds), pa.array([flat.tolist()], pa.list_(pa.int64())), pa.array([took], pa.int64())]

    state_names = ["nearest", "second", "upper", "lower", "sums", "took"]
    state_schema = "block long, nearest binary, second binary, upper binary, lower binary, sums array<long>, took long"

    def passing(now: np.ndarray, moved: np.ndarray | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in (batch.slice(i, 1) for i in range(batch.num_rows)):
                    x = np.frombuffer(row.column("points")[0].as_py(), "<i8").reshape(-1, dim)
                    if moved is None:
                        b, took = first_scan(x, now), k * len(x)
                    else:
                        kinds = {"nearest": "<i4", "second": "<i4", "upper": "<f8", "lower": "<f8"}
                        b = Bounds(**{c: np.frombuffer(row.column(c)[0].as_py(), t).copy() for c, t in kinds.items()})
                        took = search(x, now, moved, b)
                    yield pa.RecordBatch.from_arrays([row.column("block"), *told(x, b, took)], ["block", *state_names])

        return run

    try:
        points = bucketed(gathered.repartition(buckets, "block"))
        state = bucketed(points.select("block", "points").mapInArrow(passing(centroids, None), state_schema))
        for _ in range(rounds):
            cells = state.select(F.posexplode("sums").alias("cell", "s")).groupBy("cell").agg(F.sum("s").alias("s"))
            sums = np.zeros(k * (dim + 1), np.int64)
            for r in cells.collect():  # k * (dim + 1) rows
                sums[r["cell"]] = r["s"]
            sums = sums.reshape(k, dim + 1)
            count = sums[:, dim:]
            new = np.where(count > 0, sums[:, :dim] // np.maximum(count, 1), centroids)
            moved = np.sqrt(squared(new, centroids).astype(float)) * (1 + SLACK)
            centroids = new
            if not moved.any():
                break
            before = made[-1]
            state = bucketed(points.select("block", "points").join(state.drop("sums", "took"), "block").mapInArrow(passing(centroids, moved), state_schema))
            made.remove(before)
            spark.sql(f"DROP TABLE {before}")
        final = centroids

        def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in (batch.slice(i, 1) for i in range(batch.num_rows)):
                    x = np.frombuffer(row.column("points")[0].as_py(), "<i8").reshape(-1, dim)
                    own = np.frombuffer(row.column("nearest")[0].as_py(), "<i4")
                    yield pa.RecordBatch.from_arrays([row.column("vec_id").flatten(), pa.array(own), pa.array(squared(x, final[own]))], ["vec_id", "cluster", "distance"])

        out = stored(points.join(state.select("block", "nearest"), "block").mapInArrow(last, schema))
    finally:
        for name in made:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
    total = {r["cluster"]: r["s"] for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # k rows
    fits = lambda s: None if s is None or s >= 1 << 63 else int(s)
    of = [(i, fits(total.get(i)), fits(sum(total.values())), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    facts = spark.createDataFrame(of, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    far = "list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    steps = [
        "k AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c, v FROM k QUALIFY c < 8)",
    ]
    for r in range(ROUNDS + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, k.v, min(({far}, c.c)) AS best FROM k, c{r} c GROUP BY ALL)")
        if r < ROUNDS:
            steps.append(f"s{r} AS (SELECT best[2] AS c, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{r}, range(1, 65) t(i) GROUP BY ALL)")
            steps.append(f"n{r} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM s{r} GROUP BY ALL)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c, coalesce(n.v, o.v) AS v FROM c{r} o LEFT JOIN n{r} n USING (c))")
    return "WITH " + ",\n".join(steps) + f"""
SELECT vec_id, best[2]::INT AS cluster, best[1]::BIGINT AS distance, (sum(best[1]) OVER (PARTITION BY best[2]))::BIGINT AS cluster_inertia, (sum(best[1]) OVER ())::BIGINT AS inertia,
sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{ROUNDS} JOIN c{ROUNDS} c ON c.c = best[2]"""


SQL = _sql()
