"""An approximate index of vectors on disk: cells around sampled centroids, exact scores in the nearest cells, and an exact way."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.index import small, top
from corpusloom.operators.vectors import best_of
from corpusloom.sources import snapshots

#: Vectors that the centroids are learned from, most cells, rounds of learning, and queries of the sample that set the number of probes.
SAMPLE, MOST_CELLS, ROUNDS, TRIALS = 20_000, 4096, 8, 200
#: Share of the true neighbours within the sample that the probed cells must hold.
RECALL = 0.97
#: Queries and vectors of a cell that meet in one task; larger cells are split.
PER_BLOCK, PER_PART = 1024, 20_000
_VECTORS, _GONE = "id long, v array<float>, cell int, seg int", "id long, seg int"


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def learn(sample: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 11) -> np.ndarray:
    """Unit centroids of a bounded sample by cosine: the mean direction of a cell's members; an empty cell stays where it is."""
    x = _unit(sample)
    centroids = x[np.random.default_rng(seed).permutation(len(x))[:cells]]
    for _ in range(rounds):
        own = (x @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        full = np.bincount(own, minlength=len(centroids)) > 0
        centroids = np.where(full[:, None], _unit(sums), centroids)
    return centroids


def probes_for(sample: np.ndarray, centroids: np.ndarray, k: int, recall: float) -> int:
    """How many of a query's nearest cells hold the share `recall` of its k neighbours, by queries of the sample against all of it."""
    x = _unit(sample)
    asked = x[:TRIALS]
    score = asked @ x.T
    score[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    near = np.argsort(-score, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    rank = np.argsort(np.argsort(-(asked @ centroids.T), axis=1, kind="stable"), axis=1)
    cell = (x @ centroids.T).argmax(1)
    needed = np.sort(rank[np.arange(len(asked))[:, None], cell[near]].ravel())
    return int(needed[int(np.ceil(recall * len(needed))) - 1]) + 1 if len(needed) else 1


class VectorIndex:
    """Vectors by cell, in segments: added ones bring vectors, deleted or replaced ones gone ids, which hide those of segments before theirs.

    The centroids come from the SAMPLE vectors whose hashed ids are least, so learning takes the same memory at any
    size; every vector is then put into the cell of its nearest centroid. Ids are long and unique within a batch; null
    ids, null vectors and vectors of another length than the sample's smallest id has are left out. A vector of zeros is
    in cell 0 and as far from everything.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.version, self.state = snapshots.current(spark, folder)
        if not self.state:
            raise ValueError(f"no index in {folder}")
        rows = spark.read.schema("cell int, c array<double>").parquet(f"{folder}/cells").orderBy("cell").collect()  # MOST_CELLS at most
        self.centroids = np.array([r["c"] for r in rows]).reshape(len(rows), self.state["dim"])

    @classmethod
    def create(cls, vectors: DataFrame, folder: str, cells: int | None = None, k: int = 10, recall: float = RECALL, sample: int = SAMPLE) -> VectorIndex:
        """An index of vectors (id, v). cells: by default the square root of their number, at most MOST_CELLS."""
        spark = vectors.sparkSession
        rows = vectors.filter("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL)").select("id", "v")
        few = rows.orderBy(F.xxhash64("id"), "id").limit(sample).collect()
        dim = len(min(few, key=lambda r: r["id"])["v"]) if few else 0
        own = [r["v"] for r in few if len(r["v"]) == dim]
        found = np.array(own, float).reshape(len(own), dim)
        wanted = cells or min(MOST_CELLS, int(np.sqrt(rows.count())))
        centroids = learn(found, max(1, min(wanted, len(found)))) if len(found) else np.zeros((1, dim))
        probes = probes_for(found, centroids, k, recall) if len(found) > 1 else 1
        spark.createDataFrame([(i, c) for i, c in enumerate(centroids.tolist())], "cell int, c array<double>").coalesce(1).write.mode("overwrite").parquet(f"{folder}/cells")
        snapshots.commit(spark, folder, -1, {"next": 0, "dim": dim, "probes": probes, "vectors": [], "gone": []})
        index = cls(spark, folder)
        index.add(rows)
        return index

    def _read(self, table: str, schema: str) -> DataFrame:
        own = self.state[table]
        if not own:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{table}").parquet(*(f"{self.folder}/{table}/seg={s}" for s in own))

    def _commit(self, **changes) -> None:
        self.state = self.state | changes
        self.version = snapshots.commit(self.spark, self.folder, self.version, self.state)

    def _celled(self, rows: DataFrame, most: int) -> DataFrame:
        """Rows (id, v) with cells: the numbers of the `most` nearest centroids, the nearest first."""
        centroids, dim = self.centroids, self.state["dim"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    v = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, dim)
                    near = np.argsort(-(v @ centroids.T), axis=1, kind="stable")[:, :most].astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, near.shape[1]), pa.int32()), pa.array(near.ravel()))
                    yield pa.RecordBatch.from_arrays([*batch.columns, lists], ["id", "v", "cells"])

        return rows.mapInArrow(run, "id long, v array<float>, cells array<int>")

    def _fitting(self, rows: DataFrame) -> DataFrame:
        fits = (F.size("v") == self.state["dim"]) & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull())
        return rows.filter("id IS NOT NULL AND v IS NOT NULL").filter(fits).select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<float>").alias("v"))

    def live(self) -> DataFrame:
        """id, v, cell of the vectors that count."""
        rows = self._read("vectors", _VECTORS)
        if self.state["gone"]:
            gone = self._read("gone", _GONE).groupBy("id").agg(F.max("seg").alias("until"))
            rows = rows.join(small(gone), "id", "left").filter("until IS NULL OR seg >= until")
        return rows.select("id", "v", "cell")

    def add(self, vectors: DataFrame) -> None:
        """Adds vectors (id, v); one whose id is there already is replaced."""
        seg, fresh = self.state["next"], self._fitting(vectors)
        if self.state["vectors"]:
            fresh.select("id").distinct().write.mode("overwrite").parquet(f"{self.folder}/gone/seg={seg}")
        placed = snapshots.stored(self._celled(fresh, 1).select("id", "v", F.col("cells")[0].alias("cell")))  # dealing by ranges reads it twice
        placed.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").write.mode("overwrite").parquet(f"{self.folder}/vectors/seg={seg}")
        gone = [*self.state["gone"], seg] if self.state["vectors"] else []
        self._commit(next=seg + 1, vectors=[*self.state["vectors"], seg], gone=gone)

    def delete(self, ids: DataFrame) -> None:
        """Hides the vectors whose id is in the first column of `ids`."""
        seg = self.state["next"]
        ids.select(F.col(ids.columns[0]).cast("long").alias("id")).filter("id IS NOT NULL").distinct().write.mode("overwrite").parquet(f"{self.folder}/gone/seg={seg}")
        self._commit(next=seg + 1, gone=[*self.state["gone"], seg])

    def compact(self) -> None:
        """The vectors that count in one segment."""
        seg = self.state["next"]
        self.live().repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").write.mode("overwrite").parquet(f"{self.folder}/vectors/seg={seg}")
        self._commit(next=seg + 1, vectors=[seg], gone=[])

    def search(self, queries: DataFrame, k: int, probes: int | None = None, exact: bool = False, others: bool = True) -> DataFrame:
        """query_id, doc_id, score, rank of the k nearest vectors by cosine in each query's `probes` nearest cells; exact: in all.

        queries: id, v. Scores are those of the whole vectors, so what is found is ranked exactly. A query meets only the
        vectors of its cells; a cell with many vectors or queries is split by hashes over several tasks, and a window
        takes the best over cells and parts. others: without the one of the query's own id.
        """
        q = self._celled(self._fitting(queries), len(self.centroids) if exact else probes or self.state["probes"])
        q = q.select("id", "v", F.explode("cells").alias("cell"))
        x = self.live()
        size = lambda df, per, name: df.groupBy("cell").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / per)).cast("int").alias(name))
        sizes = F.broadcast(size(x, PER_PART, "parts").join(size(q, PER_BLOCK, "blocks"), "cell"))  # a row per cell
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
        q = q.join(sizes, "cell").select("id", "v", "cell", place("blocks").alias("block"), every("parts").alias("part"))
        x = x.join(sizes, "cell").select("id", "v", "cell", place("parts").alias("part"), every("blocks").alias("block"))
        keys = ["cell", "block", "part"]
        found = q.groupBy(*keys).cogroup(x.groupBy(*keys)).applyInPandas(best_of(k, others), "query_id long, doc_id long, score double")
        return top(found, k)
